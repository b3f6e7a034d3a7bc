"""Benchmark decontamination by latent semantic retrieval.

1. Words: one pass over the texts hashes every word (32 bits) and writes each
   document's hashes to the shared folder; all later passes read these alone.
   A word is a run of letters, digits and "_"; anything else ends it, but marks
   and invisible format characters are passed over. In scripts without spaces
   every ideograph is a word, and every other character with the one after it.
   Words hash into TERMS columns; the same pass counts how many passages (PASSAGE
   words each) hold a term over all documents, giving its idf, log(1 + passages / df):
   damped for frequent terms, never 0, so an item that stands in every document has
   a vector like any other.
2. Randomised SVD of the passage x term matrix A: every task multiplies its
   rows, A'(A G) for a random G, and the products are summed per term; an
   orthogonal basis of the sum and its spectrum give RANK right singular
   directions and their weights, fitted on every passage of every document. A task
   takes PASSAGES passages or an even part of them, so there are far fewer sums than
   files; they are added up FAN at a time, level by level.
3. Retrieval: windows of the documents and the benchmark items are projected and
   scaled by the root of each direction's weight (whole weights would drown what
   many passages share). Items of more than PART words are cut
   into even parts, each retrieved by itself. A window has about the words of the
   parts that it is compared with (one of SPANS), moves by a quarter of that and
   starts anew at every document. Windows whose cosine with a part is at least
   COSINE are candidates. Distinct item texts go by in blocks of ITEMS.
4. Checks: for each candidate the longest common subsequence of words between
   the item and the text around the window, whole and for the item's answer
   (what follows its last question mark or "answer:", else its last quarter). A
   hit has LCS >= STRONG of the item, or >= WEAK of it and ANSWER of the answer.

Only vectors of TERMS x RANK numbers and the items of one block travel to the
tasks, one block at a time; documents are never shuffled. Two words with equal hashes
count as equal (one pair in 2 ** 32).

Defined cases: null or empty texts match nothing; items with fewer than
LEAST_WORDS words are skipped (nothing to recognise); repeated rows are checked
each; equal items are searched once and reported each; of several windows with one item
the best counts (LCS, then answer); documents shorter than a window are one window, very
long ones go by in slabs; other columns are ignored; without documents or items the
result is empty.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import free_name, keep

TERMS, RANK = 1 << 14, 64
PASSAGE = 64
SPANS = (8, 16, 24, 32, 48)
PART = 60                   # words of an item that is projected as a whole
GRID = 24                   # where documents may start among joined ones: a multiple of every step
COSINES = 1 << 22           # cosines that are held at once
TOGETHER = 20_000           # words of documents that are searched at once, a longer document alone
SLAB = 6_144                # words whose windows are projected at once (a multiple of GRID)
MULTIPLIED = 1_000          # passages that are multiplied at once
TERMS_OF_A_ROW = 1024       # of a task's sums in one row
FAN = 16                    # tasks whose sums are added at once
PASSAGES = 250_000          # about, of a task that multiplies: 64 MB of words to 8 MB of sums
ITEMS = 4096                # distinct item texts of a block, about
ITEM_CHARS = 1 << 23        # and their characters
LEAST_WORDS = 5
COSINE, STRONG, WEAK, ANSWER = 0.65, 0.75, 0.6, 0.6
_SPACE = re.compile(r"\s")
TEXT_SLAB = 1 << 18         # characters that are hashed at once, cut at white space
_PLACES = 1 << 16           # multipliers by place in a word; longer words use them again
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, _PLACES, np.uint64) * np.uint64(2) + np.uint64(1)


_IDEOGRAPHS = ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48C), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3040, 0x312F),
             (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F))
LETTER, PASSED, IDEOGRAPH, UNSPACED = 1, 2, 3, 4


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: the kind of character, 0 for those that end a word."""
    kinds = np.array([LETTER if c.isalnum() or c == "_" else PASSED * (unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf"))
                      for c in map(chr, range(0x110000))], np.uint8)
    for kind, ranges in ((IDEOGRAPH, _IDEOGRAPHS), (UNSPACED, _UNSPACED)):
        for first, last in ranges:
            part = kinds[first:last + 1]
            part[part == LETTER] = kind
    return kinds


def _hash(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Multilinear hash of every word, and each one's first place."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, places = _kinds()[points], None
    if not text.isascii():
        places = np.flatnonzero(kind != PASSED)
        points, kind = points[places], kind[places]
    at = np.flatnonzero(kind)
    if not len(at):
        return np.zeros(0, np.uint32), at
    own = kind[at]
    begins = np.r_[True, np.diff(at) > 1]
    if places is not None:
        begins |= own != LETTER
        begins[1:] |= own[:-1] != LETTER
    starts = np.flatnonzero(begins)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    total = np.add.reduceat(_FACTORS[place % _PLACES] * points[at].astype(np.uint64), starts)
    first = at[starts]
    if places is not None:
        two = np.flatnonzero((kind[first] == UNSPACED) & (kind[np.minimum(first + 1, len(kind) - 1)] == UNSPACED)
                             & (first + 1 < len(kind)))
        total[two] += _FACTORS[1] * points[first[two] + 1].astype(np.uint64)
        first = places[first]
    return (total >> np.uint64(32)).astype(np.uint32), first


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """32-bit hashes of the words of each text, upper and lower case alike."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    parts, owners, size = [], [], 0

    def flush():
        nonlocal parts, owners, size
        hashes, at = _hash(" ".join(parts))
        ends = np.cumsum([len(p) + 1 for p in parts])
        for owner, own in zip(owners, np.split(hashes, np.searchsorted(at, ends[:-1]))):
            out[owner].append(own)
        parts, owners, size = [], [], 0

    for i, text in enumerate(texts):
        low, at = (text or "").lower(), 0
        while at < len(low):
            cut = _SPACE.search(low, at + TEXT_SLAB)
            end = cut.end() if cut else len(low)
            parts.append(low[at:end])
            owners.append(i)
            size, at = size + end - at, end
            if size >= TEXT_SLAB:
                flush()
    if parts:
        flush()
    return [np.concatenate(own) if own else np.zeros(0, np.uint32) for own in out]


def words_of(text: str | None) -> np.ndarray:
    return word_hashes([text])[0]


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint32(TERMS - 1)).astype(np.int32)


def hashed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc, body) with each text as the bytes of its word hashes, and the tasks'
    counts of passages by term (packed), both written in one pass."""
    def run(batches):
        df, n = np.zeros(TERMS, np.int64), 0
        for b in batches:
            own = word_hashes(b.column("body").to_pylist())
            for terms, passage in _passages(own):
                df += _passages_with(terms, passage)
                n += int(passage[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([w.tobytes() for w in own], pa.binary()),
                                              pa.nulls(len(b), pa.binary())], names=["doc", "body", "counts"])
            kind = b.schema.field("doc").type
        if n:
            at = np.flatnonzero(df)
            packed = np.stack([np.append(at, -1), np.append(df[at], n)]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())],
                                             names=["doc", "body", "counts"])

    kind = docs.schema["doc"].dataType.simpleString()
    both = keep(docs.mapInArrow(run, f"doc {kind}, body binary, counts binary"), "words")
    return both.where("counts IS NULL").select("doc", "body"), both.where("counts IS NOT NULL").select("counts")


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint32) for t in column.to_pylist()]


def _passages(texts: list[np.ndarray]):
    """(terms, passage of each) of all texts (word hashes), at most MULTIPLIED passages at a time."""
    terms, passage, free = [], [], 0
    for words in texts:
        own = terms_of(words)
        for at in range(0, len(own), MULTIPLIED * PASSAGE):
            part = own[at:at + MULTIPLIED * PASSAGE]
            count = -(-len(part) // PASSAGE)
            if free + count > MULTIPLIED:
                yield np.concatenate(terms), np.concatenate(passage)
                terms, passage, free = [], [], 0
            terms.append(part)
            passage.append(np.arange(len(part), dtype=np.int32) // PASSAGE + np.int32(free))
            free += count
    if free:
        yield np.concatenate(terms), np.concatenate(passage)


def _passages_with(terms: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """In how many of the passages each term stands."""
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    table = np.full((len(starts), PASSAGE), -1, np.int16)                   # TERMS fit 16 bits
    table[passage - passage[0], np.arange(len(terms)) - np.repeat(starts, np.diff(np.r_[starts, len(terms)]))] = terms
    table.sort(axis=1)
    first = table >= 0
    first[:, 1:] &= table[:, 1:] != table[:, :-1]
    return np.bincount(table[first], minlength=TERMS)


def _counted(batches):
    for b in batches:
        for packed in b.column("counts").to_pylist():
            term, df = np.frombuffer(packed, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], names=["term", "df"])


def inverse_frequencies(counts: DataFrame) -> tuple[np.ndarray, int]:
    """idf of every term, 0 for terms that never occur, and the number of passages."""
    found = {r[0]: r[1] for r in counts.mapInArrow(_counted, "term long, df long").groupBy("term")
             .agg(F.sum("df")).collect()}                                # at most TERMS + 1 rows
    n, idf = found.pop(-1, 0), np.zeros(TERMS)
    for t, df in found.items():
        idf[t] = np.log(1 + n / df)
    return idf.astype(np.float32), n


def _joined(docs: DataFrame, passages: int) -> DataFrame:
    """``docs`` in as many partitions as their passages need, two a core at least: every task's sums
    are as large as all others', however few its rows."""
    return docs.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-passages // PASSAGES)))


def _multiply(docs: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis), summed over all tasks; rows of A have unit length."""
    shared = docs.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32)))
    width = basis.shape[1]

    def add(total, terms, passage, weight, g):
        key, tf = np.unique(passage * np.int32(TERMS) + terms, return_counts=True)
        row, col = key // TERMS, key % TERMS
        value = weight[col] * (1 + np.log(tf)).astype(np.float32)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sizes = np.diff(np.r_[starts, len(row)])
        value = value / np.repeat(np.maximum(np.sqrt(np.add.reduceat(value * value, starts)), 1e-6), sizes)
        local = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(row)) - starts[local]                      # a passage has at most PASSAGE terms
        cols, values = np.zeros((len(starts), PASSAGE), np.int32), np.zeros((len(starts), 1, PASSAGE), np.float32)
        cols[local, place], values[local, 0, place] = col, value
        by_column = np.ascontiguousarray(np.matmul(values, g[cols])[:, 0].T)
        for j in range(width):
            total[j] += np.bincount(col, weights=by_column[j][local] * value, minlength=TERMS)

    def run(batches):
        weight, g = shared.value
        total = np.zeros((width, TERMS))
        for b in batches:
            for terms, passage in _passages(_unpack(b.column("body"))):
                add(total, terms, passage, weight, g)
        for k in range(0, TERMS, TERMS_OF_A_ROW):
            part = np.ascontiguousarray(total[:, k:k + TERMS_OF_A_ROW])
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([k]),
                                                  pa.array([part.tobytes()], pa.binary())],
                                                 names=["part", "first", "sums"])

    schema = "part long, first long, sums binary"
    sums, parts = docs.mapInArrow(run, schema), docs.rdd.getNumPartitions()
    while parts > 1:                                                     # FAN rows of a group at most
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "first").applyInArrow(_add_sums, schema)
        parts = -(-parts // FAN)
    out = np.zeros((TERMS, width))
    for r in sums.collect():                                             # TERMS x width numbers
        out[r["first"]:r["first"] + TERMS_OF_A_ROW] = np.frombuffer(r["sums"]).reshape(width, -1).T
    return out


def _add_sums(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_buffer()) for x in t.column("sums")], axis=0)
    return pa.table({"part": t.column("part").slice(0, 1), "first": t.column("first").slice(0, 1),
                     "sums": pa.array([total.tobytes()], pa.binary())})


def latent_space(docs: DataFrame, counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Term weights of a query or window (TERMS x RANK: idf squared times the
    scaled directions) and the spectrum."""
    idf, passages = inverse_frequencies(counts)
    start = np.random.default_rng(7).standard_normal((TERMS, RANK))
    basis, r = np.linalg.qr(_multiply(_joined(docs, passages), idf, start))
    u, s, _ = np.linalg.svd(r)
    scaled = (basis @ u) / np.sqrt(np.maximum(s, 1e-6 * max(1e-6, s[0])))
    return ((idf * idf)[:, None] * scaled).astype(np.float32), s


# ------------------------------------------------------------------- search
def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence (one numpy step per item word)."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (b == x)))
    return int(row[-1])


def answer_of(text: str, words: np.ndarray) -> np.ndarray:
    """The words of what follows the last question mark or "answer:", else the last
    quarter of the text's ``words``."""
    tail = re.split(r"\?|(?i:answer\s*:)", text)
    told = words_of(tail[-1]) if len(tail) > 1 else words[:0]
    return told if len(told) else words[-max(1, len(words) // 4):]


class Items:
    """One block of benchmark items: words, answers and latent vectors of their parts by span."""

    def __init__(self, rows: list[tuple], table: np.ndarray):
        self.table = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])     # last: no word
        self.rows, parts = [], []
        for item, text in rows:
            words = words_of(text)
            if len(words) >= LEAST_WORDS:
                self.rows.append((item, words, answer_of(text, words)))
        by_span: dict[int, list[int]] = {}
        for i, (_, words, _) in enumerate(self.rows):
            count = 1 if len(words) <= PART else -(-len(words) // SPANS[-1])
            at = 0
            for part in np.array_split(words, count):
                by_span.setdefault(min(SPANS, key=lambda s: (abs(s - len(part)), s)), []).append(len(parts))
                parts.append((i, at + len(part) // 2, table[terms_of(part)].sum(0)))
                at += len(part)
        self.known = [np.unique(words, return_counts=True) for _, words, _ in self.rows]
        self.item, self.middle = (np.array([p[k] for p in parts], np.int64) for k in (0, 1))
        self.groups = []
        for span, own in sorted(by_span.items()):
            v = np.array([parts[i][2] for i in own])
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            self.groups.append((span, np.array(own), v.astype(np.float32)))

    def shared(self, i: int, around: np.ndarray) -> int:
        """How many words of item i stand somewhere in ``around``."""
        known, times = self.known[i]
        at = np.minimum(known.searchsorted(around), len(known) - 1)
        found = np.zeros(len(known), bool)
        found[at[known[at] == around]] = True
        return int(times[found].sum())

    def candidates(self, words: list[np.ndarray]):
        """(text number, middle word of the window, part number, cosine) of the windows near parts."""
        sizes = np.array([len(w) for w in words])
        room = -(-sizes // GRID) * GRID
        begins = np.cumsum(room) - room
        terms = np.full(int(room.sum()), TERMS, np.int32)
        terms[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = terms_of(np.concatenate(words))
        owner = np.repeat(np.arange(len(words)), room // GRID)
        for at in range(0, len(terms), SLAB):
            slab = terms[at:at + SLAB + SPANS[-1]]
            rows = np.zeros((SLAB + SPANS[-1], RANK), np.float32)
            rows[:len(slab)] = self.table[slab]
            two = rows[0::2] + rows[1::2]
            four, six = two[0::2] + two[1::2], two[0::3] + two[1::3] + two[2::3]
            sums = {2: two, 4: four, 6: six, 8: four[0::2] + four[1::2], 12: six[0::2] + six[1::2]}   # by step: span / 4
            for span, own, vectors in self.groups:
                step = span // 4
                starts = np.arange(at, min(len(terms), at + SLAB), step)
                doc, n, block = owner[starts // GRID], len(starts), sums[step]
                x = block[:n] + block[1:n + 1] + block[2:n + 2] + block[3:n + 3]
                past = np.flatnonzero(starts + span > begins[doc] + room[doc])           # reach into the next text
                if len(past):
                    x[past] = block[past]
                    for k in (1, 2, 3):
                        inside = past[starts[past] + k * step < (begins + room)[doc[past]]]
                        x[inside] += block[inside + k]
                first = starts - begins[doc]
                use = np.flatnonzero((first == 0) | (first < sizes[doc] - span + step))
                x, first, doc = x[use], first[use], doc[use]
                size = np.sqrt(np.einsum("ij,ij->i", x, x))
                least = np.where(size > 0, COSINE * size, np.inf)[:, None]
                middle = (first + np.minimum(first + span, sizes[doc])) // 2
                width = max(1, COSINES // max(1, len(use)))
                for k in range(0, len(own), width):
                    cos = x @ vectors[k:k + width].T
                    w, i = np.nonzero(cos >= least)
                    yield from zip(doc[w].tolist(), middle[w].tolist(), own[k + i].tolist(), (cos[w, i] / size[w]).tolist())

    def hits(self, words: list[np.ndarray]):
        """(text number, item id, LCS share, answer share, cosine, first word) of the
        best window of each text (its word hashes) and item."""
        if not self.rows or not sum(map(len, words)):
            return []
        best, tried = {}, set()
        for d, mid, part, cos in self.candidates(words):
            i = int(self.item[part])
            item, own, answer = self.rows[i]
            n = len(own)
            start = mid - int(self.middle[part]) - n
            end = start + 3 * n
            if n > PART:                       # many windows lie in a copy: places in steps, each tried once
                start -= start % (n // 4)
                end = start + 3 * n + n // 4
                if (d, i, start) in tried:
                    continue
                tried.add((d, i, start))
            start = max(0, start)
            around = words[d][start:max(0, end)]
            if not self.shared(i, around) >= WEAK * n:
                continue
            share = lcs(own, around) / n
            if share < WEAK:
                continue
            told = lcs(answer, around) / len(answer)
            if (share >= STRONG or told >= ANSWER) and (share, told) > best.get((d, i), (0, 0))[:2]:
                best[d, i] = (share, told, cos, start)
        return [(d, self.rows[i][0], *found) for (d, i), found in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, lcs_share,
    answer_share, cosine, first_word."""
    spark = docs.sparkSession
    body, counts = hashed(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")))
    weights, _ = latent_space(body.select("body"), counts)
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("body")).where("body IS NOT NULL") \
        .withColumn("item", F.md5("body"))
    texts = items.select("item", "body").dropDuplicates(["item"])
    n, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("body")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-chars // ITEM_CHARS))
    doc_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc {doc_type}, item string, lcs_share double, answer_share double, cosine double, first_word long"
    found = None
    for k in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], weights))     # ~ITEMS rows
        part = body.mapInArrow(_search(block, schema), schema)
        if blocks > 1:                                       # one block at a time is in memory
            part = keep(part, "found")
            block.destroy()
        found = part if found is None else found.unionAll(part)
    return found.join(items.select("item", "item_id"), "item").select(
        F.col("doc").alias(doc_id), F.col("item_id").alias(item_id), "lcs_share", "answer_share", "cosine", "first_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item. Rows are told apart by their
    text alone, so ids may be null or repeat; rows without text stay."""
    key = free_name(docs, "leak_text")
    keyed = docs.withColumn(key, F.md5(text))
    leaks = keep(contaminated(keyed, benchmark, key, text, item_id, item_text).select(key).distinct(), "leaks")
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)


def _search(block, schema: str):
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            docs, texts = b.column("doc").to_pylist(), _unpack(b.column("body"))
            rows, at, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= TOGETHER or i == len(texts) - 1:
                    rows += [(docs[at + d], *hit) for d, *hit in block.value.hits(texts[at:i + 1])]
                    at, size = i + 1, 0
            cols = list(zip(*rows)) or [[]] * len(names)
            kinds = [b.schema.field("doc").type, None, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            kinds[1] = pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return run
