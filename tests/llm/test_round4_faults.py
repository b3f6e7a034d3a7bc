"""Faults found in round 4: each test failed on the code before its fix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusworks.llm import common, topk


def test_top_k_broadcasts_nothing_and_stores_no_slices(spark, monkeypatch):
    """Small files of vectors must not make Spark send them, or query blocks copied to every
    slice, through the driver."""
    common.prepare(spark)
    plans, stored, keep = [], set(), topk.keep

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        stored.update(df.columns)
        return keep(df, *more)

    monkeypatch.setattr(topk, "keep", seen)
    for name, value in {"SLICE": 16, "BLOCK": 4}.items():
        monkeypatch.setattr(topk, name, value)
    q = np.random.default_rng(21).integers(-9, 10, (400, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "vec_id long, embedding array<double>")
    best = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, scale=1)
    plans.append(best._jdf.queryExecution().executedPlan().toString())
    want = []
    for i in range(0, 400, 10):
        top = sorted((-int(q[i] @ v), j) for j, v in enumerate(q) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(top)]
    assert sorted(map(tuple, best.collect())) == want
    assert len(plans) > 5 and sum("Join" in p for p in plans) > 3
    assert not [p for p in plans if "Broadcast" in p]
    assert stored and "slice" not in stored                     # a reader would hold thousands of slices at once


def test_every_block_meets_every_slice_once(spark, monkeypatch):
    monkeypatch.setattr(topk, "BAND_BYTES", 8 * topk.BLOCK * 2 * 3)         # 3 blocks of 2 dims, 1 of 6
    rows = [(d, i % 7, f"{d}s{i}") for d in (2, 6) for i in range(20)]
    slices = [(d, sorted(e for c, at, e in rows if c == d and at == a)) for d in (2, 6) for a in range(7)]
    blocks = [(d, b, f"{d}b{b}") for d in (2, 6, 9) for b in range(8)]
    met = topk.meet(spark.createDataFrame(rows, "dims int, at long, entry string"),
                    spark.createDataFrame(blocks, "dims int, block_at long, block string"), 3, 8)
    assert sorted((sorted(r["slice"]), r["block"]) for r in met.collect()) == \
        sorted((s, b) for d, s in slices for e, _, b in blocks if d == e)


def test_lanes_grow_slower_than_slices():
    assert [topk.lanes(n, 6) for n in (1, 20, 300, 3000)] == [1, 20, 24, 188]
