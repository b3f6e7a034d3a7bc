"""Quality classifier from weak labels.

Two questions are asked of every document: is it junk, and is it abusive? For
each, several overlapping heuristics vote (-1 bad, +1 fine, 0 no opinion).
Votes are counted per pattern over all documents (at most 3^labellers rows), and
expectation-maximisation on these counts estimates how often each labeller votes
what for bad and for fine documents, and so a posterior for every pattern.
Posteriors of a bounded, hash-chosen sample of SAMPLE documents train a hashed
linear scorer (sparse logistic regression over word and layout features) with
one set of weights per question. The scorer decides for all documents.

The abuse labellers use word lists, found from labelled documents: words whose
share among abusive documents is far above that among the others. At most
LABELLED labelled documents are read for this, in two halves, so that two lists
are made apart from each other. The labeller of an empty list abstains; if both
are empty, the halves give one list together, from fewer documents if need be,
and a warning tells if there is none in spite of abusive documents. Without
labels nothing counts as abusive.

Defined cases: null or empty text = no votes, kept; very long texts are read
whole; repeated rows are scored each; other columns are kept, columns of the
added names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks.llm.bpe_codec import _schema, _with
from corpusworks.llm.common import keep

SAMPLE = 8_000          # documents that train the scorer
LABELLED = 40_000       # labelled documents that give the word lists
LIST_SIZE = 200         # words in a list
FEATURES = 1 << 18
REMEMBERED = 100_000    # words whose feature number a task remembers
EPOCHS, STEP, LASSO = 12, 0.5, 1e-4
JUNK = ("symbols", "shouting", "bangs", "bars", "echo", "variety")
ABUSE = ("list_a", "list_b", "either_list")
FALSE_ALARMS = 0.002    # a labeller is taken to call at most this share of fine documents bad
_WORD = re.compile(r"[^\W\d_]+")


def layout(text: str) -> dict[str, float]:
    """Shares that the junk labellers look at."""
    words = text.split()
    n = len(words) or 1
    tails = sum(len(w) > 2 and not w[-1].isalnum() and w[-1] == w[-2] == w[-3] for w in words)
    upper = sum(map(len, re.findall(r"[A-Z]{3,}", text)))
    varied = [len(set(words[i:i + 100])) / len(words[i:i + 100]) for i in range(0, max(1, len(words) - 50), 100)] \
        if len(words) > 20 else [1.0]
    return {"symbols": tails / n, "shouting": upper / (len(text) or 1), "bangs": text.count("!!") / n,
            "bars": words.count("|") / n, "echo": sum(a == b for a, b in zip(words, words[1:])) / n,
            "variety": 1 - min(varied)}


# (votes fine below, votes bad from): between them a labeller has no opinion
LIMITS = {"symbols": (0.01, 0.1), "shouting": (0.05, 0.2), "bangs": (0.01, 0.1), "bars": (0.01, 0.1),
          "echo": (0.05, 0.2), "variety": (0.5, 0.75)}


def votes(text: str, shares: dict[str, float], words: set[str], lists: list[set[str]]) -> list[int]:
    if not text:
        return [0] * (len(LIMITS) + 3)
    out = [-1 if shares[k] >= bad else 1 if shares[k] < fine else 0 for k, (fine, bad) in LIMITS.items()]
    if not any(lists):
        return [*out, 0, 0, 0]
    for x in lists:
        n = len(words & x)
        out.append(0 if not x else -1 if n >= 2 else 0 if n else 1)
    either = len(words & (lists[0] | lists[1]))
    return [*out, -1 if either >= 3 else 1 if either < 2 else 0]


def fit_votes(counts: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of "bad" per vote pattern: a two-class mixture in which every
    labeller has its own vote table per class, fitted by EM on pattern counts."""
    patterns = [p for p in counts if any(p)]
    if not patterns:
        return {p: 0.0 for p in counts}
    seen = np.array([[[v == s for s in (-1, 0, 1)] for v in p] for p in patterns], float)
    n = np.array([counts[p] for p in patterns], float)
    bad = np.where((seen[:, :, 0].sum(1) > 0), 0.9, 0.02)      # start: any bad vote
    for _ in range(rounds):
        weight = np.stack([n * bad, n * (1 - bad)])
        table = np.einsum("cp,pjs->cjs", weight, seen) + 0.5
        table /= table.sum(2, keepdims=True)
        table[1, :, 0] = np.minimum(table[1, :, 0], FALSE_ALARMS)
        prior = weight.sum(1) / n.sum()
        like = np.einsum("pjs,cjs->cp", seen, np.log(table)) + np.log(prior + 1e-9)[:, None]
        bad = 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50)))
    return {p: 0.0 for p in counts} | dict(zip(patterns, bad.tolist()))


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) % FEATURES


def features(shares: dict[str, float], words: set[str], seen: dict[str, int]) -> np.ndarray:
    """Hashed feature numbers: the distinct words and layout shares in steps."""
    out = [seen[w] if w in seen else seen.setdefault(w, _slot(w)) for w in words]
    out += [_slot(f"={k}>{cut}") for k, s in shares.items() for cut in (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.75) if s > cut]
    return np.unique(np.array(out, dtype=np.int64))


def fit_scorer(rows: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on soft labels: Adagrad steps with shrinkage."""
    w, g, bias = np.zeros(FEATURES), np.full(FEATURES, 1e-4), -1.0
    order = np.argsort([xxhash.xxh3_64_intdigest(str(i)) for i in range(len(rows))])
    for _ in range(EPOCHS):
        for i in order:
            f = rows[i]
            scale = 1 / np.sqrt(1 + 0.02 * len(f))
            err = target[i] - 1 / (1 + np.exp(-np.clip(bias + w[f].sum(), -30, 30)))
            bias += 0.02 * err
            g[f] += err * err * scale * scale
            move = STEP * 0.2 / np.sqrt(g[f] + 1e-2)
            w[f] += move * err * scale
            w[f] = np.sign(w[f]) * np.maximum(0, np.abs(w[f]) - move * LASSO * 10)
    return w, bias


def _tokens(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_lists(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> list[set[str]]:
    """Two lists of words that mark abusive documents, each from half the labelled
    documents (by a hash of the id)."""
    chosen = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    rows = body.join(F.broadcast(chosen), "doc_id").withColumn(   # at most LABELLED ids
        "half", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(2)))

    def split(batches):
        for b in batches:
            half, bad, words = [], [], []
            for h, t, body in zip(*(b.column(c).to_pylist() for c in ("half", "toxic", "body"))):
                own = _tokens(body or "")
                own.add("")                                     # counts documents
                half += [h] * len(own)
                bad += [t] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(half, pa.int64()), pa.array(bad, pa.int32()),
                                              pa.array(words, pa.string())], names=["half", "bad", "word"])

    counted = keep(rows.select("half", F.col("toxic").cast("int").alias("toxic"), "body")
                   .mapInArrow(split, "half long, bad int, word string")
                   .groupBy("half", "word").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("fine")),
                   "words")
    totals = {r["half"]: (r["bad"], r["fine"]) for r in counted.where("word = ''").collect()}
    def marked(halves: tuple[int, ...], least: int) -> set[str]:
        bad, fine = (sum(totals.get(h, (0, 0))[k] for h in halves) for k in (0, 1))
        if not bad or not fine:
            return set()
        odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("fine") + 0.5) / (fine + 1)))
        own = (counted.where(F.col("half").isin(*halves) & (F.col("word") != "")).groupBy("word")
               .agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")))
        top = (own.where(F.col("bad") >= max(least, 0.02 * bad))
               .withColumn("odds", odds).where("odds > 3").orderBy(F.desc("odds"), "word").limit(LIST_SIZE))
        return {r["word"] for r in top.select("word").collect()}

    lists = [marked((0,), 5), marked((1,), 5)]
    for least in (5, 2):
        if not any(lists):
            lists[0] = marked((0, 1), least)
    if not any(lists) and sum(bad for bad, _ in totals.values()):
        warnings.warn("documents are labelled abusive, but no word marks them: none is rejected as abusive")
    return lists


def drawn_by_hash(share: float, *columns: Column) -> Column:
    """Whether a row is among the ``share`` of all rows that a hash of the columns takes."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(11)), 1) < F.lit(int(share * (1 << 63)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             sample: int = SAMPLE) -> DataFrame:
    """``docs`` with posterior_junk, posterior_abuse (label model), score_junk,
    score_abuse (linear scorer, 0 to 1) and accepted (both scores under 0.5)."""
    lists = word_lists(docs, labels, doc_id, text)

    def look(t: str):
        words, shares = _tokens(t), layout(t)
        return words, shares, votes(t, shares, words, lists)

    def vote(batches):
        for b in batches:
            found = Counter(tuple(look(t or "")[2]) for t in b.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in found], pa.list_(pa.int32())),
                                              pa.array(list(found.values()), pa.int64())], names=["votes", "n"])

    body = docs.select(F.col(text).alias("body"))
    counts = {tuple(r[0]): r[1] for r in body.mapInArrow(vote, "votes array<int>, n long")
              .groupBy("votes").agg(F.sum("n").alias("n")).collect()}      # at most 3^labellers rows
    tables = []
    for part in (slice(0, len(JUNK)), slice(len(JUNK), None)):
        own: Counter = Counter()
        for p, n in counts.items():
            own[p[part]] += n
        tables.append(fit_votes(own))
    junk, abuse = tables

    def posterior(v) -> tuple[float, float]:
        return junk.get(tuple(v[:len(JUNK)]), 0.0), abuse.get(tuple(v[len(JUNK):]), 0.0)

    total = sum(counts.values())
    share = min(1.0, sample / max(1, total))
    drawn = drawn_by_hash(share, F.col(doc_id), F.col(text))

    def draw(batches):
        seen: dict[str, int] = {}
        for b in batches:
            rows, ys = [], []
            for t in b.column("body").to_pylist():
                words, shares, v = look(t or "")
                rows.append(features(shares, words, seen).astype("<i4").tobytes())
                ys.append(list(posterior(v)))
                if len(seen) > REMEMBERED:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(ys, pa.list_(pa.float64()))],
                                             names=["f", "y"])

    taken = (docs.where(drawn).select(F.col(text).alias("body")).limit(2 * sample)
             .mapInArrow(draw, "f binary, y array<double>").collect())
    rows = [np.frombuffer(r[0], "<i4").astype(np.int64) for r in sorted(taken)]
    ys = np.array([r[1] for r in sorted(taken)], float).reshape(-1, 2)
    heads = docs.sparkSession.sparkContext.broadcast([fit_scorer(rows, ys[:, k]) for k in (0, 1)])
    names = ("posterior_junk", "posterior_abuse", "score_junk", "score_abuse")
    schema = _schema(docs, [T.StructField(n, T.DoubleType()) for n in names]
                     + [T.StructField("accepted", T.BooleanType())])

    def score(batches):
        seen: dict[str, int] = {}
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                words, shares, v = look(t or "")
                f = features(shares, words, seen)
                marks = [1 / (1 + np.exp(-np.clip(bias + w[f].sum(), -30, 30))) if t else 0.0
                         for w, bias in heads.value]
                out.append([*posterior(v), *marks])
                if len(seen) > REMEMBERED:
                    seen.clear()
            cols = np.array(out, float).reshape(-1, 4)
            yield _with(b, {**{n: pa.array(cols[:, i]) for i, n in enumerate(names)},
                            "accepted": pa.array((cols[:, 2:] < 0.5).all(1))})

    return docs.mapInArrow(score, schema)
