"""Prefix trie, lattice scoring and whitening against brute force and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusworks.llm import common, lattice, prefix_trie, queries, whitening

TALK = "conv_id long, turn long, role string, text string, conv string, p1 string, own string"


# ------------------------------------------------------------------- 11 prefix trie
def rebuilt(rows):
    talks = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            talks[c].append(((turn is not None, turn or 0, mark), (role, text)))
    talks = {c: [t for _, t in sorted(own, key=lambda x: x[0])] for c, own in talks.items()}
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = talks.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def trie_of(talks):
    members = defaultdict(set)
    for c, own in talks.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].add(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(own) if len(talks[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p],
                    sum(children[q] == 0 for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_talks():
    r = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 250, -50, -150]:
        for t in range(r.choice([1, 2, 3, 7, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "yes\nno", "", None, "é\U0001f600"])))
    rows += [(0, t, "user", f"long {t % 3}") for t in range(20, 60)]          # a long one
    rows += [(7, None, "user", "first"), (7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (7, 1, "user", "tie")]
    rows += [(None, 0, "user", "nobody"), (300, 0, None, None), (300, 0, None, None)]
    rows += [(400 + i, t, "user", f"same {t}") for i in range(30) for t in range(8)]        # a hot beginning
    return [(*row, "x", "y", "z") for row in rows]


@pytest.fixture(scope="module")
def talks(spark):
    common.prepare(spark)
    return spark.createDataFrame(odd_talks(), TALK)


def op11(df):
    got = prefix_trie.prefix_trie(df, base=F.expr("conv - conv % 100"),
                                  head=F.crc32(F.col("conv").cast("string").cast("binary")) % 6, most=6)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("segment", [256, 4])
def test_prefix_trie_equals_brute_force(talks, segment, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)          # long conversations become several segments
    assert op11(talks) == trie_of(rebuilt(odd_talks()))


def test_prefix_trie_without_rebuilding_and_on_an_empty_table(spark, talks):
    got = prefix_trie.prefix_trie(talks.where("conv_id >= 400"))
    top = {r["depth"]: (r["n_convs"], r["n_children"], r["n_leaves"]) for r in got.collect()}
    assert top == {d: (30, int(d < 8), 1) for d in range(9)}
    assert op11(talks.where("false")) == []


def test_double_array_finds_what_it_packed():
    r = random.Random(1)
    seqs = [(r.randrange(3), [r.randrange(50) for _ in range(r.randrange(7))]) for _ in range(400)]
    lengths = np.array([len(s) for _, s in seqs])
    ids = np.array([t for _, s in seqs for t in s])
    trie = prefix_trie.DoubleArray.pack(np.array([k for k, _ in seqs]), ids, lengths, 3)
    slots = {}
    for k, s in seqs:
        for d in range(len(s) + 1):
            slots.setdefault((k, *s[:d]), trie.find(k, s[:d]))
            assert slots[(k, *s[:d])] == trie.find(k, s[:d]) >= 0
    assert len(set(slots.values())) == len(slots)                  # a slot for every prefix
    known = set(slots)
    for k, s in seqs:
        other = (k, *s, r.randrange(50))
        assert (trie.find(k, other[1:]) >= 0) == (other in known)


# ---------------------------------------------------------------------- 12 lattice
DOCS = "doc_id long, text string, row string, word string, held string, key string"


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces.from_file(queries.piece_file())


def spelled(pieces, word):
    """Probability of a word by the plain recursion over a dict of pieces."""
    weight = {p: math.exp(w) for p, w in zip(pieces.spelled, pieces.log_weight)}
    text = lattice.MARK + word
    alpha = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        alpha[j] = sum(alpha[i] * weight.get(text[i:j], 0) for i in range(max(0, j - 64), j))
        alpha[j] += alpha[j - 1] * math.exp(pieces.log_byte[text[j - 1]])
    return math.log(alpha[-1])


WORDS = [b"the", b"and", b"cat", "été".encode(), "中文字".encode(), b"qzxv" * 5, b"a", "▁b▁".encode(), b"don't", b"hello"]


def test_word_probability_is_the_sum_over_all_segmentations(pieces):
    got = lattice.log_probabilities(pieces, WORDS)
    assert np.allclose(got, [spelled(pieces, w) for w in WORDS], rtol=1e-12)
    two = lattice.Pieces([b"a", b"b", b"ab", lattice.MARK], np.log([0.1, 0.2, 0.3, 0.4]), np.full(256, lattice.LOW), 0.0)
    assert np.allclose(np.exp(lattice.log_probabilities(two, [b"ab", b"aab"])), [0.4 * (0.02 + 0.3), 0.4 * 0.1 * 0.32])


def test_expected_counts_are_derivatives_and_windows_change_nothing(pieces, monkeypatch):
    times = np.arange(1, len(WORDS) + 1)
    counts = lattice.expected_counts(pieces, WORDS, times)
    for k in np.argsort(-counts[:-256])[:3]:
        moved = object.__new__(lattice.Pieces)
        moved.__dict__.update(pieces.__dict__, log_weight=pieces.log_weight + 1e-6 * (np.arange(len(pieces.spelled)) == k))
        slope = (lattice.log_probabilities(moved, WORDS) - lattice.log_probabilities(pieces, WORDS)) @ times / 1e-6
        assert abs(slope - counts[k]) < 1e-4
    long = [b"thecatandthehat" * 60]
    whole = lattice.log_probabilities(pieces, long), lattice.expected_counts(pieces, long, np.array([3]))
    monkeypatch.setattr(lattice, "LONG", 37)
    assert np.allclose(lattice.log_probabilities(pieces, long), whole[0])
    assert np.allclose(lattice.expected_counts(pieces, long, np.array([3])), whole[1], atol=1e-9)


def expected_scores(rows):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, *_ in rows}
    words = [((t or "").encode().lower().split()) for _, t, *_ in rows]
    c = Counter()
    for (d, *_), own in zip(rows, words):
        if not held[d]:
            c.update([*own, None])
    n, v = sum(c.values()), len(c)
    for (d, *_), own in zip(rows, words):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*own, None])
        yield (d, held[d], len(own) + 1, sum(c[w] > 0 for w in [*own, None]), n, round(base, 7))


def test_lattice_scores_on_odd_rows(spark, pieces, monkeypatch):
    r = random.Random(5)
    common.prepare(spark)
    texts = [" ".join(r.choice(["the", "The", "cat", "été", "x" * 80, "rare%d" % r.randrange(40)]) for _ in range(r.randrange(40)))
             for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (70, None), (71, ""), (72, "\x0b\x1c  a"),
                                                    (73, "w" * 30_000)]
    df = spark.createDataFrame([(*row, "a", "b", "c", "d") for row in rows], DOCS)
    for frequent in (lattice.FREQUENT, 3):                         # 3: nearly all words meet their scores in the join
        monkeypatch.setattr(lattice, "FREQUENT", frequent)
        got = lattice.score_documents(df, "doc_id", "text", queries.piece_file()).collect()
        plain = sorted(((*r[:5], round(r["base_score"], 7)) for r in got), key=str)
        assert plain == sorted(expected_scores(rows), key=str)
        assert all(r["score"] < 0 for r in got)
        best = {r["doc_id"]: r["score"] for r in got}
        if frequent == 3:
            assert all(abs(best[d] - s) < 1e-9 * max(1, -s) for d, s in before.items())
        before = best


def test_training_raises_held_out_scores(spark, pieces):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = {k: lattice.score_documents(df, "doc_id", "text", queries.piece_file(), rounds=k)
            .where("held_out").agg(F.sum("score")).first()[0] for k in (0, 2)}
    assert told[2] > 0.8 * told[0]                                # log10 probabilities are negative


def test_lattice_scores_of_empty_and_of_held_out_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert lattice.score_documents(empty, "doc_id", "text", queries.piece_file()).count() == 0
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    df = spark.createDataFrame([(i, "only held out", *"abcd") for i in ids], DOCS)
    got = lattice.score_documents(df, "doc_id", "text", queries.piece_file()).collect()
    assert {(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(True, 4, 0, 0)}


# --------------------------------------------------------------------- 13 whitening
VECS = "vec_id long, embedding array<float>, n long, white string, dims long"


def brute_white(rows, d):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v, *_ in rows if v is not None and len(v) == d
                  and all(c is not None and math.isfinite(c) for c in v)], dtype=np.int64)
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return n, ((n * x - s) ** 2).sum(1), y, e[::-1], v[:, ::-1]


def test_whitening_equals_the_eigen_decomposition(spark):
    common.prepare(spark)
    rng = np.random.default_rng(2)
    mixed = rng.standard_normal((12, 12))
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(12) @ mixed)], 1, "x", 2) for i in range(300)]
    rows += [rows[0], (None, rows[5][1], 1, "x", 2)]
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [])]
    df = spark.createDataFrame(rows + [(i, v, 1, "x", 2) for i, v in bad], VECS)
    got = whitening.whiten(df, "vec_id", "embedding").collect()
    n, deviation, y, e, v = brute_white(rows, 12)
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n} == {302}
    white = y @ v[:, :8] / np.sqrt(e[:8])
    own = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(8):
        mine = np.array([own[i, k + 1]["whitened"] for i in range(300)])
        sign = np.sign(mine @ white[:300, k])
        assert np.allclose(sign * mine, white[:300, k], atol=1e-10)
        assert abs(own[0, k + 1]["explained"] - e[k] / e.sum()) < 1e-12
    assert [int(own[i, 1]["deviation"]) for i in range(300)] == deviation[:300].tolist()
    assert max(r["identity_error"] for r in got) < 1e-10


def test_whitening_defined_cases(spark):
    few = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 4.0]), (3, [5.0]), (4, [6.0]), (5, [3e38, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "", 0) for i, v in few], VECS)
    got = whitening.whiten(df.where("vec_id < 5"), "vec_id", "embedding").collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (4, 1)]
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    assert abs(abs(by[1, 1]) - 1) < 1e-9 and by[1, 2] is None and by[2, 3] is None and abs(abs(by[3, 1]) - 1) < 1e-9
    assert max(r["identity_error"] for r in got) < 1e-9
    assert whitening.whiten(df, "vec_id", "embedding").where("vec_id = 5").count() == 3       # saturated, no crash
    alike = df.where("vec_id = 3").unionAll(df.where("vec_id = 3"))
    assert [r["whitened"] for r in whitening.whiten(alike, "vec_id", "embedding").collect()] == [None, None]
    assert whitening.whiten(df.where("false"), "vec_id", "embedding").count() == 0


def test_leading_components_of_hard_matrices():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    for spectrum in ([5.0] * 3 + [2.0] * 2 + [1e-9] * 35, [1.0] * 40, list(range(40, 0, -1)), [1.0] + [0.0] * 39,
                     [1 + 1e-7 * i for i in range(40)]):
        v = q @ np.diag(np.array(spectrum, float)) @ q.T
        v = (v + v.T) / 2
        e, x = whitening.leading_components(v, 8)
        assert np.allclose(e, np.sort(spectrum)[::-1][:8], atol=1e-12)
        assert np.linalg.norm(v @ x - x * e) < 1e-12 * max(spectrum) * 40
        assert np.linalg.norm(x.T @ x - np.eye(8)) < 1e-12
