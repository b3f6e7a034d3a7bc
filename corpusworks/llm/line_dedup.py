"""Line dedup with sharded cuckoo filters over exact reference counts.

``LineIndex`` is kept in files. Every insertion of documents adds one posting (key,
document, +1) per document and distinct line key; deleting documents adds the opposite
postings, so any insertion can be taken back. Each such batch ends with a new version of

- the exact references: keys in at least ``least_docs`` documents with the largest
  document holding them. Only keys of the batch are counted anew, first per (key,
  document), then per key, each with a partial aggregate before its shuffle;
- the cuckoo filters over these keys, one per shard of the key space, of bounded size
  (SHARDS x SHARD_BYTES in all): keys that became common are inserted, keys that are
  no longer common are deleted. A shard that outgrows its filter is built anew from its
  keys; one with more keys than the largest filter holds lets all through to the exact
  table, so no result changes, and its keys stay out of the build.

A version is valid when its number is written, last; a batch that fails leaves none.

Cleaning reads the postings, not the texts: the filters, sent to all tasks, leave those
of likely common keys, the exact references decide, and the dropped keys meet their
texts in one join by document id; only texts that lose a line are hashed again.

A line's key is the line without white space at both ends, A-Z lower-cased.

Defined cases: null or empty text = one empty line; null document id = the
smallest id; rows that repeat an id count as one document and are cleaned each;
repeated lines of one document count once and go or stay together; rows of documents
that are not in the index stay whole; other columns are kept, columns of the added
names are replaced; very long texts are one row each; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from corpusworks.llm.bpe_codec import _schema, _with
from corpusworks.llm.common import free_name, keep

SHARDS = 256
SHARD_BYTES = 1 << 17       # largest filter of a shard: 2 bytes a slot
SLOTS, KICKS, FULL = 4, 500, 0.9
LEAST_DOCS, LEAST_CHARS = 5, 40
SPACE = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
NO_ID = -(1 << 63)


def line_key(line: str) -> str:
    core = line.strip(SPACE)
    return core.lower() if core.isascii() else core.translate(_LOWER)


def key_hashes(text: str | None, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """128-bit key hash of every line; None where the key is too short."""
    keys = map(line_key, (text or "").split("\n"))
    return [xxhash.xxh3_128_digest(k.encode()) if len(k) >= least_chars else None for k in keys]


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; insert, delete, contains."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, capacity / (SLOTS * FULL))))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo.astype(np.uint64) >> np.uint64(48)).astype(np.int64) % 65535 + 1
        first = hi & self.mask
        return mark, first, (first ^ (mark * 0x5BD1E995)) & self.mask

    def insert(self, hi: int, lo: int) -> bool:
        mark, a, b = (int(x[0]) for x in self.places(np.array([hi]), np.array([lo])))
        for kick in range(KICKS):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    return True
            slot = (mark + kick) % SLOTS
            mark, self.table[b, slot] = int(self.table[b, slot]), mark
            a, b = b, (b ^ (mark * 0x5BD1E995)) & self.mask
        return False

    def delete(self, hi: int, lo: int) -> bool:
        mark, a, b = (int(x[0]) for x in self.places(np.array([hi]), np.array([lo])))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(hi, lo)
        m = mark[:, None].astype(np.uint16)
        return (self.table[a] == m).any(1) | (self.table[b] == m).any(1)


def capacity() -> int:
    """Keys that the largest filter of a shard holds."""
    return int(SHARD_BYTES / 2 * FULL)


def build_filter(keys: np.ndarray) -> bytes | None:
    """Table of a filter over ``keys`` (rows of two halves), with room for a third more; None
    if it would be larger than SHARD_BYTES or an insertion fails: everything passes then."""
    if len(keys) > capacity():
        return None
    f = CuckooFilter(min(capacity(), len(keys) * 4 // 3))
    return f.table.tobytes() if all(f.insert(int(hi), int(lo)) for hi, lo in keys) else None


def update_filter(table: bytes, gone: np.ndarray, new: np.ndarray) -> bytes | None:
    """A filter's table after keys are deleted and inserted; None if one finds no room."""
    f = CuckooFilter(0, np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy())
    done = all(f.delete(int(hi), int(lo)) for hi, lo in gone) and all(f.insert(int(hi), int(lo)) for hi, lo in new)
    return f.table.tobytes() if done else None


def _postings(df: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """One row per row of ``df`` and distinct key in it."""
    id_col = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))

    def run(batches):
        for b in batches:
            ids, digests = [], []
            for d, t in zip(b.column("doc").to_pylist(), b.column("body").to_pylist()):
                own = set(key_hashes(t, least_chars)) - {None}
                ids += [d] * len(own)
                digests += own
            k = _halves(digests)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])],
                                             names=["doc", "hi", "lo"])

    return df.select(id_col.alias("doc"), F.col(text).alias("body")).mapInArrow(run, "doc long, hi long, lo long")


_KEY = ["hi", "lo"]


class LineIndex:
    """Postings under ``path`` (shared storage, one writer at a time)."""

    def __init__(self, spark: SparkSession, path: str, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS):
        self.spark, self.path = spark, path
        self.least_docs, self.least_chars = least_docs, least_chars

    # ----------------------------------------------------------- versions
    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def _version(self) -> int:
        try:
            return self._read("versions", "v long").agg(F.max("v")).first()[0] or 0
        except AnalysisException:
            return 0

    def _held(self, upto: int) -> DataFrame:
        """Postings of the documents in the index."""
        rows = self._read("postings", "doc long, hi long, lo long, change int, batch long")
        return (rows.where(F.col("batch") <= upto).groupBy("doc", *_KEY).agg(F.sum("change").cast("int").alias("n"))
                .where("n > 0"))

    def _references(self, v: int) -> DataFrame:
        return self._read(f"common/v={v}", "hi long, lo long, last_doc long")

    def _filters(self, v: int) -> DataFrame:
        return self._read(f"filters/v={v}", "shard int, keys long, filter binary")

    def _commit(self, changes: DataFrame) -> None:
        """Write a batch of postings, then references and filters that take it in."""
        last = self._version()
        v = last + 1
        changes.write.mode("overwrite").parquet(f"{self.path}/postings/batch={v}")
        held, old = self._held(v), None
        if last:
            touched = self._read(f"postings/batch={v}", "hi long, lo long").distinct()
            held, old = held.join(touched, _KEY, "left_semi"), self._references(last)
        now = held.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc")) \
            .where(F.col("n_docs") >= self.least_docs).select(*_KEY, "last_doc")
        if old is not None:
            now = keep(now, "now")
            now = now.unionAll(old.join(touched, _KEY, "left_anti"))
        now.write.mode("overwrite").parquet(f"{self.path}/common/v={v}")
        self._refresh_filters(last, v)
        self.spark.createDataFrame([(v,)], "v long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def _refresh_filters(self, last: int, v: int) -> None:
        shard = F.pmod(F.col("hi"), F.lit(SHARDS)).cast("int").alias("shard")
        now = self._references(v)
        sizes = now.groupBy(shard).agg(F.count(F.lit(1)).alias("keys"))
        if last:
            old = self._references(last)
            filters = self._filters(last).withColumnsRenamed({"keys": "held"})
            changed = (now.join(old, _KEY, "left_anti").select(shard, *_KEY, F.lit(1).alias("change"))
                       .unionAll(old.join(now, _KEY, "left_anti").select(shard, *_KEY, F.lit(-1).alias("change"))))
            changed = keep(changed, "changed")
            moved = changed.groupBy("shard").agg(F.count(F.lit(1)).alias("moved"))
            state = sizes.join(filters, "shard", "full").join(moved, "shard", "left").select(
                "shard", F.coalesce("keys", F.lit(0)).alias("keys"), F.coalesce("moved", F.lit(0)).alias("moved"), "filter")
        else:
            changed = now.select(shard, *_KEY, F.lit(1).alias("change")).limit(0)
            state = sizes.select("shard", "keys", F.col("keys").alias("moved"), F.lit(None).cast("binary").alias("filter"))
        state = keep(state, "filters")                                             # SHARDS rows at most
        room = F.octet_length("filter") / 2 * FULL
        same = (F.col("moved") == 0) & F.col("filter").isNotNull()
        fits = F.col("filter").isNotNull() & (F.col("keys") <= room)
        few = F.col("keys") <= capacity()
        updated = keep(state.where(~same & fits).join(changed, "shard").select("shard", *_KEY, "change", "filter")
                       .groupBy("shard").applyInArrow(_update, "shard int, filter binary"), "updated")
        full = updated.where("filter IS NULL").select("shard")                     # an insertion found no room
        anew = state.where(~same & ~fits & few & (F.col("keys") > 0)).select("shard").unionAll(full)
        built = (now.withColumn("shard", shard).join(F.broadcast(anew), "shard").select("shard", *_KEY)
                 .groupBy("shard").applyInArrow(_build, "shard int, filter binary"))   # groups of capacity() keys at most
        tables = built.unionAll(updated.where("filter IS NOT NULL")).unionAll(state.where(same).select("shard", "filter"))
        (state.where("keys > 0").select("shard", "keys").join(tables, "shard", "left")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/filters/v={v}"))

    # ------------------------------------------------------------ changes
    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        self._commit(_postings(docs, doc_id, text, self.least_chars).withColumn("change", F.lit(1)))

    def delete(self, ids: DataFrame) -> None:
        """Take back the documents whose id is in the only column of ``ids``."""
        gone = ids.select(F.coalesce(F.col(ids.columns[0]).cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        self._commit(keep(self._held(self._version()).join(gone, "doc", "left_semi").withColumn("change", -F.col("n"))
                          .select("doc", *_KEY, "change"), "gone"))

    # -------------------------------------------------------------- reads
    def counts(self) -> DataFrame:
        """The exact reference-count table: hi, lo, n_docs, last_doc."""
        return self._held(self._version()).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))

    def filter_tables(self) -> dict[int, bytes | None]:
        """The filters of the newest version by shard; None: all keys pass. SHARDS at most."""
        v = self._version()
        return {r["shard"]: r["filter"] for r in self._filters(v).collect()} if v else {}

    def clean(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` (documents of the index) without the lines whose key is in ``least_docs``
        documents, except in the last of them; adds n_lines and n_dropped."""
        filters = self.spark.sparkContext.broadcast(self.filter_tables())                # bounded, see above
        v, least = self._version(), self.least_chars

        def likely(batches):
            known = {s: f and CuckooFilter(0, np.frombuffer(f, np.uint16).reshape(-1, SLOTS))
                     for s, f in filters.value.items()}
            for b in batches:
                hi, lo = (b.column(c).to_numpy() for c in _KEY)
                own, yes = hi % SHARDS, np.zeros(len(hi), bool)
                for s in np.unique(own).tolist():
                    if s in known:
                        at = own == s
                        yes[at] = True if known[s] is None else known[s].contains(hi[at], lo[at])
                yield b.filter(pa.array(yes))

        columns = "doc long, hi long, lo long, change int"
        none = self.spark.createDataFrame([], columns + ", batch long")
        rows = self._read("postings", columns + ", batch long") if v else none
        rows = rows.where(F.col("batch") <= v).select("doc", *_KEY, "change").mapInArrow(likely, columns)
        held = rows.groupBy("doc", *_KEY).agg(F.sum("change").alias("n")).where("n > 0")
        common = self._references(v) if v else none.select(*_KEY, F.col("doc").alias("last_doc"))
        gone = (held.join(common, _KEY).where("doc <> last_doc")
                .groupBy("doc").agg(F.collect_list(F.struct(*_KEY)).alias("gone")))
        link, lost = free_name(docs, "line_doc"), free_name(docs, "line_gone")
        joined = (docs.withColumn(link, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)))
                  .join(gone.select(F.col("doc").alias(link), F.col("gone").alias(lost)).hint("shuffle_hash"),
                        link, "left").drop(link))
        names = [n for n in docs.columns if n not in ("n_lines", "n_dropped")]
        schema = _schema(docs, [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def rebuild(batches):
            for b in batches:
                texts, lines, dropped = [], [], []
                for t, g in zip(b.column(text).to_pylist(), b.column(lost).to_pylist()):
                    own = (t or "").split("\n")
                    lines.append(len(own))
                    if g:
                        out = {x["hi"].to_bytes(8, "big", signed=True) + x["lo"].to_bytes(8, "big", signed=True)
                               for x in g}
                        kept = [x for x, h in zip(own, key_hashes(t, least)) if h not in out]
                        dropped.append(len(own) - len(kept))
                        texts.append("\n".join(kept))
                    else:
                        dropped.append(0)
                        texts.append(t)
                slim = b.select(names)
                at = slim.schema.get_field_index(text)
                slim = slim.set_column(at, slim.schema.field(at), pa.array(texts, slim.schema.field(at).type))
                yield _with(slim, {"n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

        return joined.mapInArrow(rebuild, schema)


def _key_rows(t: pa.Table) -> np.ndarray:
    return np.stack([t.column("hi").to_numpy(), t.column("lo").to_numpy()], 1)


def _one_filter(t: pa.Table, made: bytes | None) -> pa.Table:
    return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})


def _build(t: pa.Table) -> pa.Table:
    return _one_filter(t, build_filter(_key_rows(t)))


def _update(t: pa.Table) -> pa.Table:
    keys, change = _key_rows(t), t.column("change").to_numpy()
    return _one_filter(t, update_filter(t.column("filter")[0].as_py(), keys[change < 0], keys[change > 0]))
