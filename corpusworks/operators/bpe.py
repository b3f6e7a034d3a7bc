"""Byte-level BPE on Spark.

Word table: pre-tokenised words and counts (C7). Symbols are UTF-8 bytes, named by
two hex digits a byte. Training (C8, Sennrich et al. 2016): repeatedly merge the most
frequent adjacent pair (ties: smaller left symbol, then smaller right symbol, by bytes)
until the vocabulary (specials + byte alphabet + merges) reaches ``vocab_size`` or the
best count drops below ``min_frequency``.

One round learns every merge down to a count ``least``. A pair that is merged at
``least`` or more consists, at every place, of neighbours that occur ``least`` times or more
already now, as each occurrence of (x, ab) is one of (x, a) too. So the places where
neighbours are rarer cut all words into fragments that don't touch each other, and the
exact merge sequence down to ``least`` follows from the distinct fragments and their counts.

1. Pair counts: a pass over the word table and one aggregate. The most frequent pairs
   (as many as the last round suggests) give ``least`` and the candidates.
2. Fragments: a pass that cuts words at all other pairs, and one aggregate. If there
   are more than ``max_fragments``, the round takes fewer candidates.
3. The merge sequence on these fragments, whose number is bounded at any corpus size.
4. A pass that puts the merged fragments back into the words and writes the new table.

Some ten to thirty rounds learn thousands of merges; nothing but candidates and
fragments reaches the driver. If more pairs tie than MAX_TIED, the best of them is merged
alone.
"""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators.prefix import running_offsets
from corpusworks.operators.tokens import (PRETOKEN_PATTERN, array_blocks, lookup_ids, lookup_packed, packed_counts, packed_tokens,
                                          word_counts)
from corpusworks.session import stored


def byte_symbols(col) -> F.Column:
    """'ab' -> '61 62' (UTF-8 bytes as hex, space separated)."""
    h = F.lower(F.hex(F.encode(col, "UTF-8")))
    return F.trim(F.regexp_replace(h, "(..)", "$1 "))


def byte_alphabet() -> dict[int, str]:
    """Byte-level display alphabet: visible Latin-1 characters stand for their
    own byte, the other bytes follow from code point 256 upward (a rule, not a
    table)."""
    visible = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    hidden = sorted(set(range(256)) - visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()


def display(symbol_hex: str) -> str:
    """Byte-level string of a hex symbol ('c3a9' -> 'Ã©')."""
    return "".join(_ALPHABET[b] for b in bytes.fromhex(symbol_hex))


def _pairs(words: DataFrame) -> DataFrame:
    """(left, right, n) over words with at least two symbols."""
    arr = F.split(F.col("syms"), " ")
    idx = F.sequence(F.lit(0), F.size(arr) - 2)
    p = words.filter(F.instr("syms", " ") > 0).select("n", F.explode(F.transform(idx, lambda i: F.struct(arr[i].alias("l"), arr[i + 1].alias("r"))))
                     .alias("p"))
    return p.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("n").alias("cnt"))


MAX_FRAGMENTS = 100_000     # distinct fragments of a round
MAX_TIED = 1 << 17          # pairs of one count that make a round
FIRST_CANDIDATES = 256


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (int32) of all words of a binary column, and each word's number of them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view(np.int32), np.diff(offsets) // 4


def _neighbours(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places with a right neighbour in the same word, and the pair there as one number."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    at = np.flatnonzero(~last)
    return at, ids[at].astype(np.int64) << 32 | ids[at + 1]


def _larger(batches, rows: int = 1 << 16):
    """Batches of words joined to ``rows`` rows, about: what a task counts is added up before it leaves."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _start(batches):
    for b in batches:
        raw = [np.frombuffer(w.encode(), np.uint8).astype(np.int32).tobytes() for w in b.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(raw, pa.binary())],
                                         names=["word", "n", "ids"])


def _count_pairs(batches):
    for b in _larger(batches):
        ids, lengths = _flat(b.column("ids"))
        at, pair = _neighbours(ids, lengths)
        times = np.repeat(b.column("n").to_numpy(), lengths)[at]
        found, to = np.unique(pair, return_inverse=True)
        cnt = np.zeros(len(found), np.int64)
        np.add.at(cnt, to, times)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(cnt)], names=["pair", "cnt"])


def _symbols(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_flat(b.column("ids"))[0]))], names=["id"])


def _runs(ids: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the maximal runs whose neighbours are all ``chosen`` pairs (sorted)."""
    at, pair = _neighbours(ids, lengths)
    near = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
    hit = np.zeros(len(ids) + 1, bool)
    hit[at] = chosen[near] == pair
    edge = np.diff(np.r_[False, hit].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1


def _cut(chosen):
    def run(batches):
        for b in _larger(batches):
            ids, lengths = _flat(b.column("ids"))
            first, end = _runs(ids, lengths, chosen.value)
            raw, times = ids.tobytes(), np.repeat(b.column("n").to_numpy(), lengths)[first].tolist()
            held: dict[bytes, int] = {}
            for f, e, n in zip((first * 4).tolist(), (end * 4).tolist(), times):
                held[raw[f:e]] = held.get(raw[f:e], 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())],
                                             names=["fragment", "n"])
    return run


def _put_back(chosen, merged):
    def run(batches):
        for b in batches:
            ids, lengths = _flat(b.column("ids"))
            first, end = _runs(ids, lengths, chosen.value)
            raw, parts, done, saved = ids.tobytes(), [], 0, np.zeros(len(first), np.int64)
            for k, (f, e) in enumerate(zip((first * 4).tolist(), (end * 4).tolist())):
                new = merged.value.get(raw[f:e])
                if new is not None:
                    parts += [raw[done:f], new]
                    done, saved[k] = e, e - f - len(new)
            parts.append(raw[done:])
            owner = np.searchsorted(np.cumsum(lengths), first, side="right")
            sizes = lengths.astype(np.int64) * 4
            np.subtract.at(sizes, owner, saved)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), column], names=["word", "n", "ids"])
    return run


_STATE = "word string, n long, ids binary"


def train_bpe(words: DataFrame, vocab_size: int = K.VOCAB_SIZE, min_frequency: int = K.MIN_PAIR_FREQUENCY,
              specials: list[str] | None = None, max_fragments: int = MAX_FRAGMENTS, max_tied: int = MAX_TIED):
    """Returns (merges, alphabet, final_words).

    merges: list of (rank, left_hex, right_hex, count) in merge order;
    alphabet: sorted byte symbols present; final_words: DataFrame word, n, syms.
    """
    sc = words.sparkSession.sparkContext
    specials = list(K.SPECIAL_TOKENS if specials is None else specials)
    state = stored(words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_start, _STATE), "bpe-words")
    names = [f"{b:02x}" for b in range(256)]                        # of the symbols, by number
    number = {name: i for i, name in enumerate(names)}
    alphabet = sorted(names[r[0]] for r in state.select("ids").mapInArrow(_symbols, "id int").distinct().collect())
    budget = vocab_size - len(specials) - len(alphabet)
    merges: list[tuple[int, str, str, int]] = []
    wanted = FIRST_CANDIDATES
    while len(merges) < budget:
        pairs = state.select("n", "ids").mapInArrow(_count_pairs, "pair long, cnt long").groupBy("pair").agg(F.sum("cnt").alias("cnt"))
        top = pairs.where(F.col("cnt") >= min_frequency).orderBy(F.desc("cnt")).limit(max(wanted, 1) + 1).collect()
        if not top:
            break
        fragments = None
        while fragments is None:
            least, chosen, alone = _candidates(pairs, top, wanted, min_frequency, max_tied, names)
            shared = sc.broadcast(np.sort(np.array(chosen, np.int64)))
            found = (state.select("n", "ids").mapInArrow(_cut(shared), "fragment binary, n long").groupBy("fragment")
                     .agg(F.sum("n").alias("n")).limit(max_fragments + 1).collect())
            if len(found) <= max_fragments or alone:
                fragments = found
            else:
                wanted = wanted // 4                                # 0: the best pair alone
        table = [(None, r["n"], tuple(names[i] for i in np.frombuffer(r["fragment"], np.int32).tolist())) for r in fragments]
        new, final = bpe_merges_local(table, 1 if alone else budget - len(merges), least)
        for _, left, right, cnt in new:
            merges.append((len(merges), left, right, cnt))
            if left + right not in number:
                number[left + right] = len(names)
                names.append(left + right)
        back = {bytes(r["fragment"]): np.array([number[x] for x in syms], np.int32).tobytes()
                for r, (_, _, old), syms in zip(fragments, table, final) if len(syms) < len(old)}
        state = stored(state.mapInArrow(_put_back(shared, sc.broadcast(back)), _STATE), "bpe-words")
        wanted = max(wanted, 1) * (4 if len(fragments) < max_fragments // 16 else 2 if len(fragments) < max_fragments // 4 else 1)

    known = sc.broadcast(names)

    def spell(batches):
        for b in batches:
            ids, lengths = _flat(b.column("ids"))
            syms = [known.value[i] for i in ids.tolist()]
            ends = np.cumsum(lengths)
            text = [" ".join(syms[e - k:e]) for e, k in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(text, pa.string())],
                                             names=["word", "n", "syms"])

    return merges, alphabet, state.mapInArrow(spell, "word string, n long, syms string")


def _candidates(pairs: DataFrame, top: list, wanted: int, min_frequency: int, max_tied: int, names: list[str]):
    """(least count, pairs of that count or more, whether one pair is merged alone)."""
    if 0 < wanted < len(top):
        least = top[wanted]["cnt"] + 1
        if top[0]["cnt"] >= least:
            return least, [r["pair"] for r in top[:wanted] if r["cnt"] >= least], False
    elif wanted >= len(top):
        return min_frequency, [r["pair"] for r in top], False      # all there are
    least = top[0]["cnt"]
    tied = pairs.where(F.col("cnt") == least).select("pair")
    if wanted:
        found = tied.limit(max_tied + 1).collect()
        if len(found) <= max_tied:
            return least, [r["pair"] for r in found], False
    place = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[place] = np.arange(len(names))                             # symbols in order of their names
    order = F.lit(rank.tolist())
    best = tied.orderBy(F.get(order, F.shiftright("pair", 32)), F.get(order, F.col("pair").bitwiseAND(0xFFFFFFFF))).first()
    return least, [best["pair"]], True


def _merge_word(syms: tuple, left, right, merged=None) -> tuple:
    """Merge every (left, right) occurrence, left to right, non-overlapping: a
    fold that closes a pair as soon as its right symbol follows a left one."""
    new = left + right if merged is None else merged

    def step(done: list, sym):
        if sym == right and done and done[-1] == left:
            done[-1] = new
        else:
            done.append(sym)
        return done

    return tuple(reduce(step, syms, []))


def bpe_merges_local(words: list[tuple[str, int, tuple]], budget: int, min_frequency: int):
    """The exact merge sequence on a bounded table (a round's fragments): pair
    counts are kept incrementally (only words containing the merged pair are
    touched, and only the pairs that change are updated), the best pair comes
    from a heap with lazy deletion. Order: count desc, then left, then right
    (symbols compared as hex strings). Symbols are small integers internally;
    ``names`` maps them back."""
    import heapq
    names: list[str] = []
    code: dict[str, int] = {}

    def sym(x: str) -> int:
        i = code.get(x)
        if i is None:
            i = code[x] = len(names)
            names.append(x)
        return i

    syms = [tuple(sym(x) for x in w[2]) for w in words]
    cnt = [w[1] for w in words]
    pairs: dict[tuple, int] = {}
    where: dict[tuple, list] = {}      # word indices; may hold stale entries
    for i, sy in enumerate(syms):
        seen = set()
        for p in zip(sy, sy[1:]):
            pairs[p] = pairs.get(p, 0) + cnt[i]
            if p not in seen:
                seen.add(p)
                where.setdefault(p, []).append(i)
    heap = [(-c, names[a], names[b], a, b) for (a, b), c in pairs.items()]
    heapq.heapify(heap)
    merges = []
    while len(merges) < budget and heap:
        negc, _, _, a, b = heapq.heappop(heap)
        c = pairs.get((a, b), 0)
        if c != -negc or c <= 0:
            continue
        if c < min_frequency:
            break
        merges.append((len(merges), names[a], names[b], c))
        ab = sym(names[a] + names[b])
        delta: dict[tuple, int] = {}
        for i in set(where.pop((a, b), ())):
            old = syms[i]
            if a not in old or b not in old:   # stale index entry
                continue
            new = _merge_word(old, a, b, ab)
            if len(new) == len(old):
                continue
            n = cnt[i]
            # only pairs in the changed region differ: skip the common prefix
            # before the first merge site and the common suffix after the last
            f = old.index(a)
            while old[f + 1] != b:
                f = old.index(a, f + 1)
            k = len(old) - f - 2            # symbols after the first site, unchanged at the end
            tail = 0
            while tail < k and old[-1 - tail] == new[-1 - tail] and not (
                    old[-1 - tail] == b and old[-2 - tail] == a):
                tail += 1
            lo = max(f - 1, 0)
            o_seg = old[lo:len(old) - tail + 1] if tail else old[lo:]
            n_seg = new[lo:len(new) - tail + 1] if tail else new[lo:]
            for p in zip(o_seg, o_seg[1:]):
                delta[p] = delta.get(p, 0) - n
            for p in zip(n_seg, n_seg[1:]):
                delta[p] = delta.get(p, 0) + n
                if p[0] == ab or p[1] == ab:
                    where.setdefault(p, []).append(i)
            syms[i] = new
        for p, d in delta.items():
            if d == 0:
                continue
            v = pairs.get(p, 0) + d
            if v > 0:
                pairs[p] = v
                heapq.heappush(heap, (-v, names[p[0]], names[p[1]], p[0], p[1]))
            else:
                pairs.pop(p, None)
                where.pop(p, None)
    return merges, [tuple(names[x] for x in sy) for sy in syms]


def vocabulary(spark: SparkSession, merges, alphabet, specials: list[str] | None = None) -> DataFrame:
    """Id, token (byte-level display form), symbol (hex), kind, count."""
    specials = list(K.SPECIAL_TOKENS if specials is None else specials)
    rows = [(i, s, None, "special", None) for i, s in enumerate(specials)]
    base = len(rows)
    rows += [(base + i, display(a), a, "byte", None) for i, a in enumerate(alphabet)]
    base = len(rows)
    rows += [(base + rank, display(left + right), left + right, "merge", cnt) for rank, left, right, cnt in merges]
    return spark.createDataFrame(rows, "id int, token string, symbol string, kind string, count long")


def merges_frame(spark: SparkSession, merges) -> DataFrame:
    return spark.createDataFrame([(r, display(a), display(b), c) for r, a, b, c in merges],
                                 "rank int, left string, right string, n long")


def merge_symbols(syms: list, ranks: dict) -> list:
    """``syms`` after all merges of ``ranks`` ((left, right) -> rank), the earliest learnt pair
    first and from left to right: a linked list of symbols and a heap of the pairs in it,
    n log n for a word of any length."""
    size = len(syms)
    behind, before, own = list(range(1, size + 1)), list(range(-1, size - 1)), list(syms)
    heap = [(ranks[p], i) for i, p in enumerate(zip(own, own[1:])) if p in ranks]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = behind[i] if own[i] is not None else size
        if j >= size or ranks.get((own[i], own[j])) != rank:        # merged or changed since
            continue
        own[i], own[j] = own[i] + own[j], None
        after = behind[i] = behind[j]
        if after < size:
            before[after] = i
            if (p := (own[i], own[after])) in ranks:
                heappush(heap, (ranks[p], i))
        if before[i] >= 0 and (p := (own[before[i]], own[i])) in ranks:
            heappush(heap, (ranks[p], before[i]))
    return [x for x in own if x is not None]


def apply_merges(words: DataFrame, merges) -> DataFrame:
    """word, syms of any distinct words (column ``word``), seen in training or not:
    the earliest learnt merge that applies goes first. The merge list travels with
    the tasks; its length is bounded by the vocabulary size."""
    ranks = words.sparkSession.sparkContext.broadcast({(left, right): rank for rank, left, right, _ in reversed(merges)})
    names = [f"{b:02x}" for b in range(256)]

    def run(batches):
        for b in batches:
            done = [" ".join(merge_symbols([names[x] for x in w.encode()], ranks.value)) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(done, pa.string())], names=["word", "syms"])

    return words.select("word").mapInArrow(run, "word string, syms string")


def encode_new_texts(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, merges,
                     unk_id: int = 1, pattern: str = PRETOKEN_PATTERN) -> DataFrame:
    """C9 for texts that training has not seen: id, pos, token_id."""
    words = word_counts(docs.select(text_col), text_col, pattern)
    return encode_texts(docs, id_col, text_col, encode_words(apply_merges(words, merges), vocab, unk_id), pattern, unk_id)


def encode_words(final_words: DataFrame, vocab: DataFrame, unk_id: int = 1) -> DataFrame:
    """C9 for words with their symbols: word -> ids (unknown symbol -> <unk>).
    Each distinct word is encoded once; callers join on ``word``."""
    sym = final_words.select("word", F.posexplode(F.split("syms", " ")).alias("k", "symbol"))
    v = vocab.filter(F.col("symbol").isNotNull()).select("symbol", "id")
    j = sym.join(v, "symbol", "left")
    return j.groupBy("word").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("id", F.lit(unk_id)).alias("id")))),
                    lambda x: x["id"]).alias("ids"))


def encode_texts(docs: DataFrame, id_col: str, text_col: str, word_ids: DataFrame,
                 pattern: str = PRETOKEN_PATTERN, unk_id: int = 1) -> DataFrame:
    """C9 over documents: id, pos, token_id (position in the document's
    token sequence). Words are encoded once (distinct) and joined back; a word
    that ``word_ids`` lacks becomes one <unk>."""
    w = docs.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0))
                    .alias("wpos", "word"))
    ids = F.coalesce("ids", F.array(F.lit(unk_id)))
    j = w.join(word_ids, "word", "left").select(id_col, "wpos", F.posexplode(ids).alias("k", "token_id"))
    # position inside the document = tokens of the words before it + k, from a
    # distributed prefix sum (a huge document is spread over partitions)
    wl = j.groupBy(id_col, "wpos").agg(F.count(F.lit(1)).alias("_len"))
    off = running_offsets(wl, [id_col], ["wpos"], "_len")
    j = j.join(off.select(id_col, "wpos", F.col("start").alias("_off")), [id_col, "wpos"])
    return j.select(id_col, (F.col("_off") + F.col("k")).cast("long").alias("pos"), F.col("token_id").cast("long"))


def encode_arrays(docs: DataFrame, text_col: str, word_ids: DataFrame, pattern: str = PRETOKEN_PATTERN,
                  unk_id: int = 1) -> DataFrame:
    """C9 as one array per document: ``docs`` with ``text_col`` replaced by ``ids``. ``word_ids``: word, ids."""
    return lookup_ids(_cut_words(docs, text_col, pattern), text_col, word_ids.withColumnRenamed("word", "token"), [unk_id])


def _cut_words(docs: DataFrame, text_col: str, pattern: str) -> DataFrame:
    return docs.withColumn(text_col, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), 0))


def separator_ids(spark: SparkSession, vocab: DataFrame, merges, text: str = K.PARAGRAPH_SEP, unk_id: int = 1) -> list[int]:
    """Ids of the text between two documents of a corpus."""
    words = word_counts(spark.createDataFrame([(text,)], "text string"))
    ids = encode_words(apply_merges(words, merges), vocab, unk_id)
    row = encode_arrays(spark.createDataFrame([(text,)], "text string"), "text", ids, unk_id=unk_id).first()
    return list(row["ids"])


def training_blocks(ids: DataFrame, order_cols: list[str], vocab: DataFrame, merges, size: int = K.BLOCK_SIZE,
                    stride: int = K.BLOCK_STRIDE, least_blocks: int = K.MIN_BLOCKS) -> DataFrame:
    """P9 behind the encoding (``ids``: order_cols, ids): documents in ``order_cols`` order, separators between
    them, cut into blocks; fewer than ``least_blocks`` raise. Returns block_no, input_ids, labels."""
    sep = separator_ids(ids.sparkSession, vocab, merges)
    blocks = array_blocks(ids.select(*order_cols, "ids"), order_cols, "ids", size, stride, tuple(sep), least_blocks)
    return blocks.select("block_no", F.col("ids").alias("input_ids"), F.col("ids").alias("labels"))


def train_and_encode(docs: DataFrame, text_col: str = "text", vocab_size: int = K.VOCAB_SIZE,
                     min_frequency: int = K.MIN_PAIR_FREQUENCY, unk_id: int = 1, **kw):
    """C7 to C10 over the same documents, whose texts are cut into words once: (vocab, merges, ``docs``
    with ``text_col`` replaced by ``ids``)."""
    blocks = packed_tokens(_cut_words(docs, text_col, PRETOKEN_PATTERN), text_col)
    merges, alphabet, final = train_bpe(packed_counts(blocks), vocab_size, min_frequency, **kw)
    vocab = vocabulary(docs.sparkSession, merges, alphabet)
    ids = encode_words(final, vocab, unk_id).withColumnRenamed("word", "token").withColumn("ids", F.col("ids").cast("array<bigint>"))
    return vocab, merges, lookup_packed(blocks, ids, [unk_id])


def train_from_documents(docs: DataFrame, text_col: str = "text", vocab_size: int = K.VOCAB_SIZE,
                         min_frequency: int = K.MIN_PAIR_FREQUENCY, **kw):
    """C7 + C8 + C10 in one call: (vocab DataFrame, merges list, final words)."""
    words = word_counts(docs, text_col, PRETOKEN_PATTERN)
    merges, alphabet, final = train_bpe(words, vocab_size, min_frequency, **kw)
    return vocabulary(docs.sparkSession, merges, alphabet), merges, final


__all__ = ["train_bpe", "vocabulary", "merges_frame", "encode_words", "encode_texts", "train_from_documents",
           "byte_symbols", "display", "byte_alphabet", "apply_merges", "merge_symbols", "encode_new_texts", "encode_arrays",
           "separator_ids", "training_blocks", "train_and_encode"]
