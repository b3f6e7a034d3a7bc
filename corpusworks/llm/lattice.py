"""Language-model scoring over the lattice of subword segmentations.

A text is words and one end. The model draws pieces of an existing vocabulary one by
one; a word, with the word mark before it, is any sequence of pieces that spells it, and
its probability is the sum over all of them. Pieces hold no word mark inside, so a
document's marginal probability is the product over its words and the end.

1. Words are counted over all documents: in all, and in those that the model learns
   from. Partial counts in each task, then one aggregate by word.
2. The vocabulary's scores (ranks) give the first weights of its pieces, 1 / (1 + rank).
   ROUNDS passes over the distinct words re-estimate them: forward and backward
   recursion in log space give the expected count of every piece over all segmentations
   of all training words; pieces and the end share the probability. The counts of the
   vocabulary (its size is fixed) are all that reaches the driver.
3. The forward recursion scores every distinct word of the table once.
4. One pass over the documents adds up the scores of the FREQUENT most frequent words,
   which travel by broadcast; all other words, none in more than 1 / FREQUENT of the
   tokens, meet their scores in one join by word, added up per document.

Recursions run for many words of one length at a time, piece ids of substrings found
by a rolling hash in a table of all pieces. A word longer than LONG bytes goes through them
in windows, so memory is bounded for any length.

Smoothing: ADDED on top of each piece's expected count. Bytes are pieces, so every word
has a probability. Words are bytes with A-Z lower-cased, split at the six ASCII white
space characters.

Defined cases: null text = empty (its only token is the end); null ids are held out (as the
id ''); repeated rows are documents of their own; a word that holds the word mark's
character is spelled by bytes there or by pieces with that character; without training
documents all counts are 0 and the weights stay the vocabulary's; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import keep

MARK = "▁".encode()     # the word mark of the vocabulary
ROUNDS = 2
FREQUENT = 1 << 18          # words that travel by broadcast, at most
SHORT = 64                  # bytes of a word that may travel by broadcast
LONG = 4096                 # bytes of a window of a very long word
CELLS = 1 << 21             # substrings that are looked up at once
HELD = 200_000              # words whose counts a task holds
ADDED = 0.1
FOLDS = 10
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
SEEN_BITS = 20
LOW = -1e30                 # log of nothing


class Pieces:
    """The vocabulary as byte strings with log weights, found by hashes of substrings.

    Byte pieces are apart from pieces that spell the same single byte."""

    def __init__(self, spelled: list[bytes], log_weight: np.ndarray, log_byte: np.ndarray, log_end: float):
        self.spelled, self.log_weight, self.log_byte, self.log_end = spelled, log_weight, log_byte, log_end
        self.longest = max(map(len, spelled), default=1)
        keys = np.array([_hash(p) for p in spelled], np.uint64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces with one hash")
        self.seen = np.zeros(1 << SEEN_BITS, bool)               # by leading bits: may a piece have this hash?
        self.seen[keys >> np.uint64(64 - SEEN_BITS)] = True

    @classmethod
    def from_file(cls, path: str) -> "Pieces":
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        own = [i for i in own if "▁" not in m.id_to_piece(i)[1:]]          # inside a word there is no mark
        weight = np.array([1 / (1 + max(0.0, -m.get_score(i))) for i in own])
        bytes_ = np.full(256, weight.min())
        total = weight.sum() + bytes_.sum() + weight.max()
        return cls([m.id_to_piece(i).encode() for i in own], np.log(weight / total), np.log(bytes_ / total),
                   math.log(weight.max() / total))

    def weighted(self, counts: np.ndarray, ends: int) -> "Pieces":
        """New weights from expected counts (pieces, then bytes) and the number of ends."""
        log = np.log(counts + ADDED) - math.log(counts.sum() + ADDED * (len(counts) + 1) + ends)
        new = object.__new__(Pieces)
        new.__dict__.update(self.__dict__, log_weight=log[:-256], log_byte=log[-256:],
                            log_end=math.log(ends + ADDED) - math.log(counts.sum() + ADDED * (len(counts) + 1) + ends))
        return new

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes, -1 where there is none."""
        flat, out = keys.ravel(), np.full(keys.size, -1, np.int32)
        may = np.flatnonzero(self.seen[flat >> np.uint64(64 - SEEN_BITS)])
        at = np.minimum(np.searchsorted(self.keys, flat[may]), len(self.keys) - 1)
        hit = self.keys[at] == flat[may]
        out[may[hit]] = self.order[at[hit]]
        return out.reshape(keys.shape)

    def spans(self, text: np.ndarray) -> np.ndarray:
        """texts x length x widest: number of the piece of that many bytes (less one) that
        ends at a byte, -1 where there is none; widest: the longest piece found."""
        rows, size = text.shape
        out, widest = np.full((rows, size, min(self.longest, size)), -1, np.int32), 0
        with np.errstate(over="ignore"):
            key = np.zeros((rows, size), np.uint64)               # of the last m bytes before and with each place
            power, scrambled = np.uint64(1), (text.astype(np.uint64) + np.uint64(1)) * _ODD
            for m in range(out.shape[2]):
                key[:, m:] = key[:, m:] + power * scrambled[:, :size - m]
                power = power * _STEP
                out[:, m:, m] = found = self.find(_mixed(key[:, m:], m + 1))
                widest = m if m and (found >= 0).any() else widest
        return out[:, :, :widest + 1]


def _mixed(total: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = total ^ (np.uint64(length) * _STEP)
        z = (z ^ (z >> np.uint64(29))) * _ODD
    return z ^ (z >> np.uint64(32))


def _hash(piece: bytes) -> int:
    total, power = 0, 1
    for b in reversed(piece):
        total, power = total + power * ((b + 1) * int(_ODD)), power * int(_STEP)
    return int(_mixed(np.array([total & (1 << 64) - 1], np.uint64), len(piece))[0])


def _log_sum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(-1)
    return top + np.log(np.exp(parts - top[..., None]).sum(-1))


def _forward(pieces: Pieces, text: np.ndarray, spans: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Log probability of every prefix. ``alpha`` starts with what lies before the text: its
    last column belongs to the text's first place, earlier ones to places before."""
    before, widest = alpha.shape[1], spans.shape[2]
    weight = np.where(spans >= 0, pieces.log_weight[spans], LOW)
    weight[:, :, 0] = np.logaddexp(weight[:, :, 0], pieces.log_byte[text])
    out = np.concatenate([alpha, np.zeros(text.shape)], 1)
    for i in range(text.shape[1]):
        reach = min(widest, before + i)
        out[:, before + i] = _log_sum(out[:, before + i - reach:before + i][:, ::-1] + weight[:, i, :reach])
    return out


def _words_matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(MARK + w for w in words), np.uint8).reshape(len(words), -1)


def _by_length(words: list[bytes]):
    """(numbers, matrix) of words of one length, of a bounded size; long words alone."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for size, own in sorted(groups.items()):
        width = max(1, CELLS // ((size + len(MARK)) * 24))
        for k in range(0, len(own), width):
            yield own[k:k + width], _words_matrix([words[i] for i in own[k:k + width]])


def log_probabilities(pieces: Pieces, words: list[bytes]) -> np.ndarray:
    """Natural log of the probability of each word, over all segmentations."""
    out = np.zeros(len(words))
    for own, text in _by_length(words):
        alpha = np.zeros((len(own), 1))
        for at in range(0, text.shape[1], LONG):
            back = min(at, pieces.longest - 1)                    # pieces may begin in the window before
            part = text[:, at - back:at + LONG]
            alpha = _forward(pieces, part[:, back:], pieces.spans(part)[:, back:], alpha[:, -pieces.longest:])
        out[own] = alpha[:, -1]
    return out


def expected_counts(pieces: Pieces, words: list[bytes], times: np.ndarray) -> np.ndarray:
    """Expected counts of pieces, then bytes, over all segmentations of words that come
    ``times`` often each."""
    total = np.zeros(len(pieces.spelled) + 256)
    for own, text in _by_length(words):
        size, longest = text.shape[1], pieces.longest
        alpha, windows = np.zeros((len(own), 1)), []
        for at in range(0, size, LONG):
            back = min(at, longest - 1)
            part = text[:, at - back:at + LONG]
            windows.append((at, back, part.shape[1] - back))
            spans = pieces.spans(part)[:, back:]
            alpha = np.concatenate([alpha, _forward(pieces, part[:, back:], spans, alpha[:, -longest:])
                                    [:, -windows[-1][2]:]], 1)
        beta = np.full(alpha.shape, LOW)
        beta[:, -1] = 0
        for at, back, width in reversed(windows):
            if len(windows) > 1:
                spans = pieces.spans(text[:, at - back:at + width])[:, back:]
            places = slice(at - back, at + width + 1)
            _count(pieces, text[:, at:at + width], spans, alpha[:, places], beta[:, places], alpha[:, -1],
                   times[own].astype(float), total)
    return total


def _count(pieces: Pieces, text: np.ndarray, spans: np.ndarray, alpha: np.ndarray, beta: np.ndarray, whole: np.ndarray,
           times: np.ndarray, total: np.ndarray) -> None:
    """Backward recursion over one window, in ``beta``; adds expected counts to ``total``.
    ``alpha`` and ``beta`` also have the places before the window that pieces begin at."""
    size = text.shape[1]
    before, widest = alpha.shape[1] - size - 1, spans.shape[2]
    weight = np.where(spans >= 0, pieces.log_weight[spans], LOW)
    single = pieces.log_byte[text]
    first = np.logaddexp(weight[:, :, 0], single)
    for i in range(size - 1, -1, -1):                              # from the place behind byte i to where pieces begin
        reach = min(widest, before + i + 1)
        step = weight[:, i, :reach].copy()
        step[:, 0] = first[:, i]
        to = slice(before + i + 1 - reach, before + i + 1)
        beta[:, to] = np.logaddexp(beta[:, to], beta[:, before + i + 1, None] + step[:, ::-1])
    ends = beta[:, before + 1:] - whole[:, None]
    word, place, length = np.nonzero(spans >= 0)
    value = np.exp(alpha[word, before + place - length] + weight[word, place, length] + ends[word, place]) * times[word]
    total[:-256] += np.bincount(spans[word, place, length], weights=value, minlength=len(total) - 256)
    value = np.exp(alpha[:, before:-1] + single + ends) * times[:, None]
    total[-256:] += np.bincount(text.ravel(), weights=value.ravel(), minlength=256)


# ------------------------------------------------------------------ passes over tables
def words_of(cell: str | None) -> list[bytes]:
    """Words of a text as bytes, A-Z lower-cased (bytes split at ASCII white space)."""
    return cell.encode().lower().split() if cell else []


def _key(word: bytes) -> bytes:
    """A word, or a digest that is no UTF-8 for a long one."""
    return word if len(word) <= SHORT else b"\xff" + xxhash.xxh3_128_digest(word)


def _count_words(batches):
    """word, how often in documents learned from, in held out ones; a null word stands for
    the ends."""
    held = {True: Counter(), False: Counter()}

    def rows():
        out = [(w, 0 if side else n, n if side else 0) for side in held for w, n in held[side].items()]
        for c in held.values():
            c.clear()
        cols = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
                                           pa.array(cols[2], pa.int64())], names=["word", "learned", "other"])

    for b in batches:
        for side, text in zip(b.column("held").to_pylist(), b.column("body").to_pylist()):
            held[side].update(words_of(text))
            held[side][None] += 1
        if sum(map(len, held.values())) >= HELD:
            yield rows()
    yield rows()


def _gathered(batches, rows: int = 1 << 15, size: int = 8 << 20):
    """Batches put together, so that many words of one length come at a time."""
    held, n, total = [], 0, 0
    for b in batches:
        held, n, total = held + [b], n + len(b), total + b.nbytes
        if n >= rows or total >= size:
            yield pa.Table.from_batches(held)
            held, n, total = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _expect(shared):
    def run(batches):
        total = np.zeros(len(shared.value.spelled) + 256)
        for t in _gathered(batches):
            total += expected_counts(shared.value, t.column("word").to_pylist(), t.column("learned").to_numpy())
        at = np.flatnonzero(total > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])
    return run


def learned_pieces(words: DataFrame, pieces: Pieces, ends: int, rounds: int = ROUNDS) -> Pieces:
    """The pieces with weights from ``rounds`` of expectation and maximisation over
    ``words`` (word, learned: how often)."""
    spark = words.sparkSession
    own = words.where("learned > 0").select("word", "learned")
    for _ in range(rounds if ends else 0):
        counts = np.zeros(len(pieces.spelled) + 256)
        expected = own.mapInArrow(_expect(spark.sparkContext.broadcast(pieces)), "piece long, n double")
        for r in expected.groupBy("piece").agg(F.sum("n")).collect():            # one row per piece at most
            counts[r[0]] = r[1]
        pieces = pieces.weighted(counts, ends)
    return pieces


def _score_words(shared, total: int, distinct: int):
    def run(batches):
        rest = total + ADDED * (distinct + 1)
        for t in _gathered(batches):
            words, c = t.column("word").to_pylist(), t.column("learned").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(_key, words)), pa.binary()), t.column("n").combine_chunks(), pa.array(c > 0),
                 pa.array(np.log10((c + ADDED) / rest)), pa.array(log_probabilities(shared.value, words) / math.log(10))],
                names=["key", "n", "known", "base", "score"])
    return run


def _frequent(scored: DataFrame) -> DataFrame:
    """The words of the highest counts, FREQUENT at most: those above the lowest of
    log-spaced bounds that leaves no more."""
    step = F.floor(F.log2("n") * 4).cast("int")
    left, bound = FREQUENT, None
    for r in scored.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():     # some 250 rows
        if r["count"] > left:
            break
        left, bound = left - r["count"], r["step"]
    return scored.withColumn("frequent", step >= bound if bound is not None else F.lit(False))


def _score_texts(shared, end: tuple[int, float, float]):
    def run(batches):
        known, base, score = (shared.value[c] for c in ("known", "base", "score"))
        number = {k: i for i, k in enumerate(shared.value["key"])}
        for b in batches:
            lists = [[w if len(w) <= SHORT else _key(w) for w in words_of(t)] for t in b.column("body").to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            words = list(chain.from_iterable(lists))
            owner = np.repeat(np.arange(len(lists)), sizes)
            ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
            own, ids_found = owner[ids >= 0], ids[ids >= 0]
            miss = np.flatnonzero(ids < 0)
            rest, offsets = [], np.zeros(len(lists) + 1, np.int32)
            cuts = np.searchsorted(owner[miss], np.arange(len(lists) + 1))
            for d in range(len(lists)):
                rest += Counter(words[i] for i in miss[cuts[d]:cuts[d + 1]].tolist()).items()
                offsets[d + 1] = len(rest)
            keys, times = zip(*rest) if rest else ((), ())
            told = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(times, pa.int64())], names=["key", "n"]))

            def total(values, more):
                return np.bincount(own, weights=values[ids_found], minlength=len(lists)) + more

            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc"), b.column("held"), pa.array(sizes + 1),
                 pa.array(total(known, end[0]).astype(np.int64)), pa.array(total(base, end[1])),
                 pa.array(total(score, end[2])), told],
                names=["row", "doc", "held", "n_tokens", "n_known", "base", "score", "rest"])
    return run


def score_documents(df: DataFrame, doc_id: str, text: str, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    ``vocabulary``: a file of scored pieces."""
    spark = df.sparkSession
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % FOLDS == 0
    docs = df.select(F.col(doc_id).alias("doc"), held.alias("held"), F.col(text).alias("body"))
    counted = keep(docs.select("held", "body").mapInArrow(_count_words, "word binary, learned long, other long")
                   .groupBy("word").agg(F.sum("learned").alias("learned"), F.sum(F.col("learned") + F.col("other")).alias("n")),
                   "counts")
    ends = (counted.where("word IS NULL").first() or {"learned": 0})["learned"]
    words = counted.where("word IS NOT NULL")
    total, distinct = words.agg(F.coalesce(F.sum("learned"), F.lit(0)), F.count_if(F.col("learned") > 0)).first()
    total, distinct = total + ends, distinct + (ends > 0)

    pieces = learned_pieces(words, Pieces.from_file(vocabulary), ends, rounds)
    shared = spark.sparkContext.broadcast(pieces)
    scored = _frequent(keep(words.mapInArrow(_score_words(shared, total, distinct),
                                             "key binary, n long, known boolean, base double, score double"), "scored"))
    rows = scored.where("frequent").select("key", "known", "base", "score").toArrow()          # FREQUENT rows of SHORT bytes
    few = spark.sparkContext.broadcast({"key": rows.column("key").to_pylist()} | {
        c: rows.column(c).to_numpy().astype(np.float64) for c in ("known", "base", "score")})
    end = (int(ends > 0), math.log10((ends + ADDED) / (total + ADDED * (distinct + 1))), pieces.log_end / math.log(10))

    doc_type = df.schema[doc_id].dataType.simpleString()
    numbers = "n_tokens long, n_known long, base double, score double"
    told = keep(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _score_texts(few, end), f"row long, doc {doc_type}, held boolean, {numbers}, rest array<struct<key:binary,n:bigint>>"),
        "texts")
    others = scored.where("NOT frequent").select("key", "known", F.col("base").alias("b"), F.col("score").alias("s"))
    more = (told.select("row", F.explode("rest").alias("w")).select("row", "w.key", "w.n").join(others, "key")
            .groupBy("row").agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("more_known"),
                                F.sum(F.col("n") * F.col("b")).alias("more_base"), F.sum(F.col("n") * F.col("s")).alias("more_score")))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return told.drop("rest").join(more, "row", "left").select(
        F.col("doc").alias(doc_id), F.col("held").alias("held_out"), "n_tokens", plus("n_known", "more_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"),
        plus("score", "more_score").alias("score"))
