"""Token operators: regex tokens, global token ids, token blocks (C5),
corpus gates (C6) and the BPE word table (C7).

Block rule: blocks of ``size`` tokens with stride ``stride`` start at
0 <= i < L - size; short blocks are dropped. So L = size gives no block and
L = size + 1 gives one. A token at position p belongs to the blocks
p div stride and p div stride - 1 (for size = 2 * stride), so blocks are
built by a shuffle on the block number with at most ``size`` rows per group -
no per-document or per-corpus arrays.

``array_blocks`` is the plan for tokens that are arrays, one per document: blocks inside a
document are slices of its array; only blocks over a border between documents are shuffled,
as segments of at most ``size`` tokens, and stitched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks import constants as K
from corpusworks.operators.prefix import global_row_index, running_offsets
from corpusworks.session import bound_batches, stored

# Oracle-friendly tokens: runs of letters/digits, or one other non-space char.
SIMPLE_TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\t\n\x0B\x0C\r ]"
# GPT-2 style byte-level pre-tokenizer split (no prefix space added).
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def regex_tokens(df: DataFrame, id_col: str, text_col: str = "text",
                 pattern: str = SIMPLE_TOKEN_PATTERN, with_length: bool = False) -> DataFrame:
    """Long form: id, pos (0-based within the text), token [, n_tokens of the
    text, carried on every row so no count/join pass is needed]."""
    arr = df.select(id_col, F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0).alias("_a"))
    extra = [F.size("_a").cast("long").alias("n_tokens")] if with_length else []
    return arr.select(id_col, *extra, F.posexplode("_a").alias("pos", "token"))


def token_counts(df: DataFrame, id_col: str, text_col: str = "text",
                 pattern: str = SIMPLE_TOKEN_PATTERN) -> DataFrame:
    """id, n (number of tokens of the text), without exploding."""
    return df.select(id_col, F.size(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).cast("long")
                     .alias("n"))


def token_vocabulary(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """token, token_id = rank of the token in binary string order (0-based),
    assigned with a distributed prefix count (no single-partition window)."""
    d = tokens.select(token_col).distinct()
    return global_row_index(d, [token_col]).select(token_col, F.col("row_index").alias("token_id"))


def with_token_ids(tokens: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """Attach ids by an equi join on the token string (AQE splits hot tokens)."""
    return tokens.join(vocab, token_col)


def _block_members(pos_col: str, stride: int, size: int):
    if size != 2 * stride:
        raise ValueError("block membership shortcut needs size == 2 * stride")
    b = F.floor(F.col(pos_col) / stride).cast("long")
    return F.filter(F.array(b - 1, b), lambda x: x >= 0)


def blocks_from_positions(tok: DataFrame, key_cols: list[str], pos_col: str, value_col: str,
                          length_col: str, size: int = K.BLOCK_SIZE, stride: int = K.BLOCK_STRIDE) -> DataFrame:
    """Blocks over positioned tokens. ``tok`` has key_cols, pos, value and the
    sequence length L of its key. Returns key_cols, block_no, ids (ARRAY).

    With size = 2 * stride every token is shuffled once, into its half-block
    (pos div stride, at most ``stride`` rows per group); block b is then half
    b followed by half b + 1, paired by an equi join on the half index."""
    if size != 2 * stride:
        t = tok.select(*key_cols, pos_col, value_col, length_col,
                       F.explode(_block_members(pos_col, stride, size)).alias("block_no"))
        t = t.filter(F.col("block_no") * stride < F.col(length_col) - size)
        g = t.groupBy(*key_cols, "block_no").agg(
            F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(value_col).alias("v"))))
            .alias("_m"))
        return g.select(*key_cols, "block_no", F.transform("_m", lambda x: x["v"]).alias("ids"))
    half = F.floor(F.col(pos_col) / stride).cast("long")
    t = tok.filter(F.col(length_col) > size).select(*key_cols, half.alias("_h"), pos_col, value_col, length_col)
    h = t.groupBy(*key_cols, "_h").agg(
        F.max(length_col).alias("_L"),
        F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(value_col).alias("v")))).alias("_m"))
    h = h.select(*key_cols, "_h", "_L", F.transform("_m", lambda x: x["v"]).alias("_ids"))
    first = h.filter(F.col("_h") * stride < F.col("_L") - size)
    second = h.select(*key_cols, (F.col("_h") - 1).alias("_h"), F.col("_ids").alias("_ids2"))
    j = first.join(second, list(key_cols) + ["_h"])
    return j.select(*key_cols, F.col("_h").alias("block_no"), F.concat("_ids", "_ids2").alias("ids"))


LOOKUP_ROWS, LOOKUP_BYTES = 200_000, 8 << 20          # a table of ids that travels by broadcast, at most
BLOCK_TOKENS = 1 << 22      # tokens, about, of a block of rows that shares one list of distinct tokens
OUT_IDS = 1 << 20           # ids, about, of a batch of rows that come out


def lookup_ids(df: DataFrame, tokens_col: str, table: DataFrame, unknown: list[int], out_col: str = "ids",
               max_rows: int = LOOKUP_ROWS, max_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """``df`` with the array ``tokens_col`` replaced by ``out_col``: the ids of all its tokens, one after
    the other. ``table``: token, ids (array of long), a token once; others become ``unknown``. A table below
    both bounds (counted first) travels by broadcast; a larger one meets the distinct tokens of each block of
    rows in a join, so a token is shuffled once a block and not once a place."""
    bound_batches(df.sparkSession)
    keep_cols = [c for c in df.columns if c != tokens_col]
    t = stored(table.select("token", F.col("ids").cast("array<bigint>").alias("ids")), "lookup-ids")
    n, size = t.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(
        F.octet_length("token") + 8 * F.size("ids") + 8), F.lit(0))).first()
    if n <= max_rows and size <= max_bytes:
        return _lookup_by_broadcast(df, keep_cols, tokens_col, t, unknown, out_col)
    return lookup_packed(packed_tokens(df, tokens_col), t, unknown, out_col)


def _row_blocks(keep_cols: list[str], tokens_col: str):
    """Blocks of rows: their columns and numbers of tokens, all tokens as numbers, and the distinct tokens."""
    def run(batches):
        pid, made, held, count = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            nonlocal made, held, count
            lists = [b.column(tokens_col) for b in held]
            sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists]).astype(np.int32)
            tokens = pa.concat_arrays([c.flatten() for c in lists]).cast(pa.string()).dictionary_encode(null_encoding="encode")
            columns = [pa.concat_arrays([b.column(c) for b in held]) for c in keep_cols]
            rows = pa.StructArray.from_arrays([pa.array(sizes), *columns], names=["_n", *keep_cols])
            codes, made, held, count = tokens.indices.to_numpy().astype(np.int32), made + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([pid << 33 | made]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                 pa.array([codes.tobytes()], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(tokens.dictionary)], pa.int32()), tokens.dictionary)],
                names=["_block", "_rows", "_codes", "_tokens"])

        for b in batches:
            if len(b):
                held.append(b)
                count += len(b.column(tokens_col).flatten())
            if count >= BLOCK_TOKENS:
                yield packed()
        if held:
            yield packed()
    return run


def _spread_ids(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """The ids of rows of ``sizes`` tokens: token ``at`` has ``lengths`` of ``flat``."""
    starts, size = np.cumsum(lengths) - lengths, lengths[at]
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(sizes))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[np.repeat(starts[at], size) + inside]))


def _unpacked(keep_cols: list[str], out_col: str):
    def run(batches):
        for b in batches:
            for r in range(len(b)):
                sizes, *columns = b.column("_rows")[r].values.flatten()
                codes, sizes = np.frombuffer(b.column("_codes")[r].as_py(), np.int32), sizes.to_numpy()
                ids = b.column("_ids")[r].values
                flat = np.zeros(0, np.int64) if ids is None else ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.zeros(0, np.int64) if ids is None else ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
                made = np.append(0, np.cumsum(lengths[codes]))[ends]                  # ids up to each row
                at = 0
                while at < len(sizes):
                    end = max(at + 1, int(np.searchsorted(made, made[at] + OUT_IDS, side="right")) - 1)
                    told = _spread_ids(flat, lengths, codes[ends[at]:ends[end]], sizes[at:end])
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in columns), told], names=[*keep_cols, out_col])
                    at = end
    return run


def packed_tokens(df: DataFrame, tokens_col: str) -> DataFrame:
    """``df`` in blocks of rows, written once: the rows' other columns, the distinct values of the array
    ``tokens_col`` in the block, and its tokens as numbers of them. Null arrays are empty."""
    bound_batches(df.sparkSession)
    keep_cols = [c for c in df.columns if c != tokens_col]
    own = df.select(*keep_cols, F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias(tokens_col))
    row = T.StructType([T.StructField("_n", T.IntegerType()), *[f for f in own.schema.fields if f.name in keep_cols]])
    return stored(own.mapInArrow(_row_blocks(keep_cols, tokens_col), T.StructType([
        T.StructField("_block", T.LongType()), T.StructField("_rows", T.ArrayType(row)), T.StructField("_codes", T.BinaryType()),
        T.StructField("_tokens", T.ArrayType(T.StringType()))])), "lookup")


def _times(batches):
    for b in batches:
        for r in range(len(b)):
            tokens, codes = b.column("_tokens")[r].values, np.frombuffer(b.column("_codes")[r].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([tokens, pa.array(np.bincount(codes, minlength=len(tokens)).astype(np.int64))],
                                             names=["word", "n"])


def packed_counts(blocks: DataFrame) -> DataFrame:
    """``word_counts`` of ``packed_tokens``: a word leaves a block once."""
    return blocks.select("_codes", "_tokens").mapInArrow(_times, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lookup_packed(blocks: DataFrame, t: DataFrame, unknown: list[int], out_col: str = "ids") -> DataFrame:
    """The rows of ``packed_tokens`` with ``out_col``: the ids (table ``t``: token, ids) of all their tokens."""
    fields = blocks.schema["_rows"].dataType.elementType.fields[1:]
    none = F.array(*[F.lit(i).cast("long") for i in unknown]).cast("array<bigint>")
    found = (blocks.select("_block", F.posexplode("_tokens").alias("_code", "token")).join(t, "token", "left")
             .groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_code", F.coalesce("ids", none).alias("ids")))).alias("_m"))
             .select("_block", F.transform("_m", lambda x: x["ids"]).alias("_ids")))            # BLOCK_TOKENS entries at most
    return blocks.select("_block", "_rows", "_codes").join(found, "_block", "left").mapInArrow(
        _unpacked([f.name for f in fields], out_col), T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.LongType()))]))


def _lookup_by_broadcast(df, keep_cols, tokens_col, t, unknown, out_col):
    rows = t.toArrow()
    lists = rows.column("ids").combine_chunks()
    ids = np.append(lists.flatten().to_numpy(zero_copy_only=False), np.array(unknown, np.int64)).astype(np.int64)
    sizes = np.append(np.diff(lists.offsets.to_numpy()), len(unknown)).astype(np.int64)
    shared = df.sparkSession.sparkContext.broadcast((rows.column("token").combine_chunks().cast(pa.string()), ids, sizes))

    def run(batches):
        tokens, flat, lengths = shared.value
        for b in batches:
            column = b.column(tokens_col)
            at = pc.fill_null(pc.index_in(column.flatten().cast(pa.string()), value_set=tokens), len(tokens)).to_numpy()
            told = _spread_ids(flat, lengths, at, np.diff(column.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep_cols), told], names=[*keep_cols, out_col])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep_cols).schema.fields]
    source = df.select(*keep_cols, F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias(tokens_col))
    return source.mapInArrow(run, ", ".join([*types, f"`{out_col}` array<bigint>"]))


def _local_starts(ids_col: str, sep: int):
    def run(batches):
        pid, here = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.diff(b.column(ids_col).offsets.to_numpy()).astype(np.int64)
            ends = here + np.cumsum(n + sep)
            if len(n):
                here = int(ends[-1])
            for name, values in (("_pid", np.full(len(n), pid, np.int32)), ("_start", ends - n - sep), ("_n", n)):
                b = b.append_column(name, pa.array(values))
            yield b
    return run


def array_blocks(rows: DataFrame, order_cols: list[str], ids_col: str = "ids", size: int = K.BLOCK_SIZE,
                 stride: int = K.BLOCK_STRIDE, sep_ids: tuple[int, ...] = (), least_blocks: int = 0) -> DataFrame:
    """C5 over the whole corpus from one array of ids per row: the rows in ``order_cols`` order, with
    ``sep_ids`` between them, are one sequence; block b holds its ``size`` ids from b * stride on, for all
    b * stride < L - size. Fewer than ``least_blocks`` blocks raise. Returns block_no, ids. Null arrays
    are empty; rows with equal order keys stand in any order."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    sep = len(sep_ids)
    own = rows.select(*order_cols, F.coalesce(F.col(ids_col), F.array()).cast("array<bigint>").alias("_ids"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    placed = stored(own.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                    .mapInArrow(_local_starts("_ids", sep), types + ", _pid int, _start long, _n long"), "block-rows")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored(placed.groupBy("_pid").agg(F.sum(F.col("_n") + sep).alias("_tokens")).select(     # a row per partition
        "_pid", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"), "_tokens"), "block-offsets")
    length = max(0, (totals.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0]) - sep)
    blocks = len(range(0, length - size, stride))
    if blocks < least_blocks:
        raise ValueError(f"token_blocks: {blocks} < {least_blocks}")
    s, e = F.col("_s"), F.col("_e")
    last = F.lit(blocks - 1).cast("long")
    floor = lambda x: F.floor(x / stride).cast("long")
    told = (placed.where(F.col("_n") + sep > 0).join(F.broadcast(totals.select("_pid", "_before")), "_pid")
            .select(F.concat("_ids", F.array(*[F.lit(i).cast("long") for i in sep_ids]).cast("array<bigint>")).alias("_own"),
                    (F.col("_before") + F.col("_start")).alias("_s"), "_n")
            .withColumn("_e", s + F.col("_n") + sep)
            .withColumn("_first", floor(s + stride - 1)).withColumn("_last", F.least(floor(e - size), last)))

    def span(lo, hi):
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    def cut(b, lo, hi):
        return F.slice("_own", (lo - s + 1).cast("int"), (hi - lo).cast("int"))

    inner = told.select(F.explode(F.transform(span(F.col("_first"), F.col("_last")), lambda b: F.struct(
        b.alias("block_no"), cut(b, b * stride, b * stride + size).alias("ids")))).alias("x")).select("x.*")
    lowest, highest = F.greatest(floor(s - size) + 1, F.lit(0).cast("long")), F.least(floor(e + stride - 1) - 1, last)
    over = F.concat(span(lowest, F.least(F.col("_first") - 1, highest)),
                    span(F.greatest(F.col("_first"), F.col("_last") + 1), highest))

    def segment(b):
        lo, hi = F.greatest(b * stride, s), F.least(b * stride + size, e)
        return F.struct(b.alias("block_no"), lo.alias("at"), cut(b, lo, hi).alias("part"))

    border = (told.select(F.explode(F.transform(over, segment)).alias("x")).select("x.*")
              .groupBy("block_no").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("m"))     # size ids at most
              .select("block_no", F.flatten(F.transform("m", lambda x: x["part"])).alias("ids")))
    return inner.unionByName(border)


def row_blocks(rows: DataFrame, key_cols: list[str], ids_col: str = "ids", size: int = K.BLOCK_SIZE,
               stride: int = K.BLOCK_STRIDE) -> DataFrame:
    """C5 per row from its array of ids, without a shuffle: key_cols, block_no, ids."""
    n = F.size(ids_col)
    starts = F.when(n > size, F.sequence(F.lit(0), F.floor((n - size - 1) / stride).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return rows.select(*key_cols, F.explode(F.transform(starts, lambda b: F.struct(
        b.cast("long").alias("block_no"), F.slice(ids_col, b * stride + 1, F.lit(size)).alias("ids")))).alias("x")).select(
        *key_cols, "x.*")


def ids_digest(ids_col: str = "ids"):
    return F.md5(F.array_join(F.transform(F.col(ids_col), lambda x: x.cast("string")), ","))


def doc_blocks(tokens_with_ids: DataFrame, id_col: str, size: int = K.BLOCK_SIZE,
               stride: int = K.BLOCK_STRIDE, length_col: str | None = None) -> DataFrame:
    """C5 per document: blocks never cross documents. ``length_col`` (the
    document's token count on every row) avoids a count-and-join pass."""
    t = tokens_with_ids
    if length_col is None:
        lens = t.groupBy(id_col).agg(F.count(F.lit(1)).alias("_L"))
        t, length_col = t.join(lens, id_col), "_L"
    return blocks_from_positions(t, [id_col], "pos", "token_id", length_col, size, stride)


def corpus_blocks(tokens_with_ids: DataFrame, id_col: str, size: int = K.BLOCK_SIZE,
                  stride: int = K.BLOCK_STRIDE, counts: DataFrame | None = None) -> DataFrame:
    """C5 over the whole corpus: documents in ``id_col`` order form one token
    sequence; global positions come from a distributed prefix sum of the
    per-document token counts (``counts``: id, n - e.g. ``token_counts``)."""
    if counts is None:
        counts = tokens_with_ids.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    off = running_offsets(counts.select(id_col, F.col("n").alias("_n")), [], [id_col], "_n")
    t = tokens_with_ids.join(off.select(id_col, F.col("start").alias("_off"), F.col("group_total").alias("_L")),
                             id_col)
    t = t.withColumn("_gpos", F.col("_off") + F.col("pos"))
    return blocks_from_positions(t, [], "_gpos", "token_id", "_L", size, stride)


def block_count(n_tokens_col, size: int = K.BLOCK_SIZE, stride: int = K.BLOCK_STRIDE):
    """Number of blocks for L tokens: len(range(0, L - size, stride))."""
    L = F.col(n_tokens_col) if isinstance(n_tokens_col, str) else n_tokens_col
    return F.when(L > size, F.floor((L - size - 1) / stride) + 1).otherwise(0).cast("long")


def word_counts(df: DataFrame, text_col: str = "text", pattern: str = PRETOKEN_PATTERN) -> DataFrame:
    """Pre-tokenised words and their counts (partial aggregation per task)."""
    w = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
