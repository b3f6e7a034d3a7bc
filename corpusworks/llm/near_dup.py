"""Near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles. Equal sets are one
*class* from the start. Each class has POSITIONS minwise tokens. As many trees as
RECALL takes (they share the tokens, which is counted in) branch the classes recursively: a node picks one or two token
positions (1 / similarity on average, from a hash of the node), and classes with
the same token there form a child. Similar sets stay together on some path with
good chance at every depth, unlike ones part quickly. Nodes of at most Nodes of at most NODE
classes are compared exhaustively. A node that is still large DEPTHS levels
below a large one holds sets that are mostly alike. Its members are compared
with one pivot; unless that puts all of them in one component (further links
would change nothing), the node is cut into chunks of bounded size and all
chunks are compared pairwise with one another: intersections of two chunks are
one matrix product, and a chunk pair returns only links that join components,
at most one per member. Nothing is capped or dropped.

Candidate pairs of small nodes and pivots are sifted by token agreement (about
five standard deviations below the threshold) and confirmed on the full sets. Components come from alternating stars over the confirmed links.

Defined cases: null or empty text (no word) = empty set, linked with nothing,
its own component; fewer than five words = one shingle of all of them; rows
with a null id stand alone (component null, kept); rows that repeat an id are
rows of their own; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import free_name, keep
from corpusworks.llm.components import components

WORDS, PERCENT = 5, 85      # PERCENT: similarity of op4, the default threshold
POSITIONS, NODE = 64, 24
RECALL = 0.995              # of pairs at the threshold, down to the deepest level of large nodes
DEPTHS = (2, 4, 8)          # levels below a large node whose children are counted
CHUNK_ROWS, CHUNK_SHINGLES = 256, 100_000
COLUMNS = 16_384            # shingles of one matrix product

_WORD = re.compile(r"[^ \t-\r]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_ODD = np.array([xxhash.xxh3_64_intdigest(f"odd{i}") | 1 for i in range(POSITIONS + WORDS)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit scrambler: multiply by an odd number, fold the high half down, twice."""
    for k in (0, 1):
        x = x * _ODD[k]
        x = x ^ (x >> np.uint64(31))
    return x


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, known: _Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    t = text or ""
    words = _WORD.findall(t.lower() if t.isascii() else t.translate(_LOWER))
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(h))
    if not size:
        return h
    s = sum(h[i:len(h) - size + 1 + i] * _ODD[POSITIONS + i] for i in range(size)) + np.uint64(size)
    return np.unique(_mix(s))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS minwise tokens (32 bits)."""
    out = np.full(POSITIONS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(shingles), 2048):
        block = (shingles[at:at + 2048, None] * _ODD[None, :POSITIONS]) >> np.uint64(32)
        out = np.minimum(out, block.min(0).astype(np.uint32))
    return out


def _describe(batches):
    known = _Hashes()
    for b in batches:
        sid, size, sig = [], [], []
        for t in b.column("body").to_pylist():
            s = shingle_set(t, known)
            sid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            size.append(len(s))
            sig.append(minwise(s).tobytes() if len(s) else None)
        own = [b.column("doc"), b.column("text_key")] if "text_key" in b.schema.names else [b.column("doc")]
        if len(known) > 200_000:
            known.clear()
        yield pa.RecordBatch.from_arrays([*own, pa.array(sid, pa.binary()), pa.array(size, pa.int64()),
                                          pa.array(sig, pa.binary())],
                                         names=["doc", "text_key"][:len(own)] + ["sid", "n", "sig"])


@functools.cache
def tree_count(percent: int) -> int:
    """The fewest trees by which a pair at the threshold meets at the deepest level with
    a chance of RECALL. Given how many of the pair's tokens agree (binomial), the trees
    are independent, and a path goes on in its first and second child as below."""
    p, more = percent / 100, 100 / percent - 1
    agree = np.arange(POSITIONS + 1) / POSITIONS
    weight = np.array([math.comb(POSITIONS, k) * p ** k * (1 - p) ** (POSITIONS - k) for k in range(POSITIONS + 1)])
    meet = np.ones(POSITIONS + 1)
    for _ in range(1 + DEPTHS[-1]):
        meet = 1 - (1 - agree * meet) * (1 - more * agree * meet)
    trees = 1
    while weight @ (1 - meet) ** trees > 1 - RECALL:
        trees += 1
    return trees


def sift_share(percent: int) -> float:
    """Share of equal tokens that a pair at the threshold misses by five standard deviations only."""
    p = percent / 100
    return p - 5 * math.sqrt(p * (1 - p) / POSITIONS)


def _choices(node: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows that branch, token position) of the first and second child of each node."""
    r = _mix(node ^ np.uint64(0x9E3779B97F4A7C15))
    more = (r >> np.uint64(40)).astype(np.float64) / float(1 << 24) < 100 / percent - 1
    first = (r & np.uint64(0xFFFF)).astype(np.int64) % POSITIONS
    second = ((r >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) % POSITIONS
    return [(np.arange(len(node)), first), (np.flatnonzero(more), second[more])]


def _children(node: np.ndarray, sig: np.ndarray, row: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of (node, row of sig) pairs: nodes and rows of sig."""
    nodes, rows = [], []
    for at, position in _choices(node, percent):
        token = sig[row[at], position].astype(np.uint64)
        nodes.append(_mix(node[at] + _mix(token + (position.astype(np.uint64) << np.uint64(32)))))
        rows.append(row[at])
    return np.concatenate(nodes), np.concatenate(rows)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, POSITIONS)


def _plant(percent: int):
    """First level of every tree."""
    def run(batches):
        for b in batches:
            sig, sid, n = _matrix(b.column("sig")), b.column("sid"), b.column("n")
            for tree in range(tree_count(percent)):
                root = np.full(len(sig), tree + 1, dtype=np.uint64)
                node, row = _children(root, sig, np.arange(len(sig)), percent)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), sid.take(take), n.take(take)],
                                                 names=["node", "sid", "n"])

    return run


def _grow(percent: int):
    """Nodes at DEPTHS levels below each row's node."""
    def run(batches):
        for b in batches:
            sig, sid, n = _matrix(b.column("sig")), b.column("sid"), b.column("n")
            node, row = b.column("node").to_numpy().view(np.uint64), np.arange(len(sig))
            for depth in range(1, DEPTHS[-1] + 1):
                node, row = _children(node, sig, row, percent)
                if depth in DEPTHS:
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node.view(np.int64)), sid.take(take), n.take(take),
                         pa.array(np.full(len(row), depth, dtype=np.int32))], names=["node", "sid", "n", "depth"])

    return run


def _pairs_of(percent: int):
    """All pairs of a small node whose sizes allow the similarity."""
    def run(batches):
        for b in batches:
            a, c = [], []
            for members in b.column("members").to_pylist():
                members.sort(key=lambda m: m["sid"])
                for i, x in enumerate(members):
                    for y in members[i + 1:]:
                        if x["sid"] != y["sid"] and 100 * min(x["n"], y["n"]) >= percent * max(x["n"], y["n"]):
                            a.append(x["sid"])
                            c.append(y["sid"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary())], names=["a", "b"])

    return run


def _sized(rows: DataFrame, most: int) -> DataFrame:
    """Rows (``most`` about) of nodes with two members at least, with the node's size."""
    sizes = keep(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nodes", most)
    return keep(rows.join(sizes, "node"), "members", most)


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    lists = (members.where(F.col("size") <= NODE).groupBy("node")
             .agg(F.collect_list(F.struct("sid", "n")).alias("members")))     # at most NODE rows each
    return lists.select("members").mapInArrow(_pairs_of(percent), "a binary, b binary")


def _pivot_pairs(large: DataFrame, percent: int) -> DataFrame:
    """Every member of a large node with the node's pivot: the member of least hash,
    so nodes with the same members mostly agree on it."""
    pivots = keep(large.groupBy("node").agg(F.min(F.struct(F.xxhash64("sid").alias("h"), "sid", "n")).alias("p"))
                  .select("node", F.col("p.sid").alias("p"), F.col("p.n").alias("pn")), "pivots")
    return (large.join(pivots, "node")
            .where((F.col("sid") != F.col("p"))
                   & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")))
            .select(F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b")))


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    sets = left + right
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.flatnonzero(np.bincount(at) > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[at]
    out = np.zeros((len(left), len(right)))
    for start in range(0, len(shared), COLUMNS):
        own = (column >= start) & (column < start + COLUMNS)
        m = np.zeros((len(sets), min(COLUMNS, len(shared) - start)), dtype=np.float32)
        m[row[own], column[own] - start] = 1
        out += m[:len(left)] @ m[len(left):].T
    return out


def joining_links(left: list[dict], right: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between members (sid, root, x) of two chunks that join components."""
    sets = [[np.frombuffer(m["x"], np.uint64) for m in side] for side in (left, right)]
    sizes = [np.array([len(x) for x in side], dtype=float) for side in sets]
    common = common_counts(*sets)
    near = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    parent: dict[bytes, bytes] = {}

    def top(r: bytes) -> bytes:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    links = []
    for i, j in np.argwhere(near).tolist():
        p, q = top(left[i]["root"]), top(right[j]["root"])
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((left[i]["sid"], right[j]["sid"]))
    return links


def _compare_chunks(percent: int):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                links = joining_links(b.column("ma")[i].as_py(), b.column("mb")[i].as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()),
                                                  pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

    return run


def _dense_links(large: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, most: int,
                 members_of: int) -> DataFrame:
    """Links inside large nodes that are not yet in one component."""
    tagged = keep(large.join(roots, large["sid"] == roots["of"], "left")
                  .select("node", "sid", "n", F.coalesce("root", "sid").alias("root")), "tagged", members_of)
    cut = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS), F.ceil(F.sum("n") / CHUNK_SHINGLES))
    open_nodes = keep(tagged.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                                 cut.alias("chunks")).where("lo <> hi"), "open", members_of)
    placed = keep(tagged.join(open_nodes.select("node", "chunks"), "node")
                  .withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks"))), "placed", members_of)
    members = keep(placed.join(_sets_of(placed.select("sid").distinct(), classes, docs, most), "sid"),
                   "chunk_sets", 20 * members_of)
    chunks = keep(members.groupBy("node", "chunk").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("chunks").alias("chunks"),
        F.collect_list(F.struct("sid", "root", "x")).alias("m")), "chunks")       # of bounded size, see the cut
    left = chunks.select("node", F.col("chunk").alias("ca"), F.col("lo").alias("la"), F.col("hi").alias("ha"), "chunks")
    pairs = (left.withColumn("cb", F.explode(F.sequence("ca", F.col("chunks") - 1)))
             .join(chunks.select("node", F.col("chunk").alias("cb"), F.col("lo").alias("lb"), F.col("hi").alias("hb")),
                   ["node", "cb"])
             .where((F.col("la") != F.col("ha")) | (F.col("lb") != F.col("hb")) | (F.col("la") != F.col("lb"))))
    pairs = keep(pairs.select("node", "ca", "cb"), "chunk_pairs", members_of)
    one = chunks.select("node", F.col("chunk").alias("ca"), F.col("m").alias("ma"))
    two = chunks.select("node", F.col("chunk").alias("cb"), F.col("m").alias("mb"))
    return pairs.join(one, ["node", "ca"]).join(two, ["node", "cb"]).select("ma", "mb") \
        .mapInArrow(_compare_chunks(percent), "a binary, b binary")


def _sift(percent: int):
    least = sift_share(percent)

    def run(batches):
        for b in batches:
            alike = (_matrix(b.column("sa")) == _matrix(b.column("sb"))).mean(1) >= least
            t = b.select(["a", "b"])
            yield t.filter(pa.array(alike))

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _full_sets(batches):
    known = _Hashes()
    for b in batches:
        sets = [shingle_set(t, known) for t in b.column("body").to_pylist()]
        if len(known) > 200_000:
            known.clear()
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                                          pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "x"])


def _sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """sid, x (packed full set) of the wanted classes, from their first documents."""
    firsts = keep(classes.join(wanted, "sid", "left_semi").select(F.col("first").alias("doc"), "sid"), "wanted", most)
    texts = docs.join(firsts.select("doc").distinct(), "doc", "left_semi").select("body")
    found = texts.mapInArrow(_full_sets, "sid binary, x binary").join(firsts.select("sid"), "sid", "left_semi")
    return keep(found.dropDuplicates(["sid"]), "sets", 20 * most)


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, most: int) -> DataFrame:
    """The pairs whose full sets are similar enough; ``most``: classes."""
    sig = classes.select("sid", "sig")
    sifted = keep(pairs.distinct().join(sig.select(F.col("sid").alias("a"), F.col("sig").alias("sa")), "a")
                  .join(sig.select(F.col("sid").alias("b"), F.col("sig").alias("sb")), "b")
                  .select("a", "b", "sa", "sb").mapInArrow(_sift(percent), "a binary, b binary"), "sifted", 20 * most)
    wanted = sifted.select(F.col("a").alias("sid")).unionAll(sifted.select(F.col("b").alias("sid"))).distinct()
    sets = _sets_of(wanted, classes, docs, most)
    return keep(sifted.join(sets.select(F.col("sid").alias("a"), F.col("x").alias("xa")), "a")
                .join(sets.select(F.col("sid").alias("b"), F.col("x").alias("xb")), "b")
                .select("a", "b", "xa", "xb").mapInArrow(_confirm(percent), "a binary, b binary"), "links", 20 * most)


def _labelled(docs: DataFrame, percent: int, key: str = "") -> tuple[DataFrame, DataFrame]:
    """rows (doc, what ``key`` declares, sid, n, sig) of docs (doc, body, key), and labelled
    (sid, head: the component's smallest doc and key)."""
    rows = keep(docs.mapInArrow(_describe, f"doc long, {key}sid binary, n long, sig binary"), "rows")
    head = F.struct(*[c for c in rows.columns if c in ("doc", "text_key")])
    classes = keep(rows.where("doc IS NOT NULL AND n > 0").groupBy("sid")
                   .agg(F.min(head).alias("head"), F.first("n").alias("n"), F.first("sig").alias("sig"))
                   .withColumn("first", F.col("head.doc")), "classes")

    known = classes.count()
    planted_rows = int(known * tree_count(percent) * 100 / percent)
    planted = _sized(classes.select("sig", "sid", "n").mapInArrow(_plant(percent), "node long, sid binary, n long"), planted_rows)
    wide = planted.where(F.col("size") > NODE)
    grown_rows = int(wide.count() * sum((100 / percent) ** d for d in DEPTHS))
    large = wide.join(classes.select("sid", "sig"), "sid")
    grown = _sized(large.select("node", "sid", "n", "sig")
                   .mapInArrow(_grow(percent), "node long, sid binary, n long, depth int"), grown_rows)
    dense = keep(grown.where((F.col("size") > NODE) & (F.col("depth") == DEPTHS[-1])).select("node", "sid", "n"),
                 "dense", grown_rows)
    links = _links(_small_pairs(planted, percent).unionAll(_small_pairs(grown, percent))
                   .unionAll(_pivot_pairs(dense, percent)), classes, docs, percent, known)

    def roots_of(edges: DataFrame) -> DataFrame:
        return keep(components(edges, edges.count()).select(F.col("node").alias("of"), "root"), "roots", known)

    roots = roots_of(links)
    if not dense.isEmpty():                               # links found so far are stars now: few rounds more
        more = keep(_dense_links(dense, roots, classes, docs, percent, known, grown_rows), "dense_links")
        roots = roots_of(roots.where("of <> root").select(F.col("of").alias("a"), F.col("root").alias("b")).unionAll(more))

    class_root = classes.join(roots, classes["sid"] == roots["of"], "left").select(
        "sid", "head", F.coalesce("root", "sid").alias("root"))
    least = class_root.groupBy("root").agg(F.min("head").alias("least"))
    labelled = keep(class_root.join(least, "root").select("sid", F.col("least").alias("head")), "labelled", known)
    return rows, labelled


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """Per row of ``df``: doc_id, n_shingles, component_id (smallest id reachable
    over links of a similarity of ``percent`` or more, its own included), kept."""
    rows, labelled = _labelled(df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body")), percent)
    component = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc")) \
        .otherwise(F.col("head.doc"))
    return (rows.select("doc", "sid", "n").join(labelled, "sid", "left")
            .select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True))))


def without_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each component: of the rows with its smallest id one
    text stays. Rows are told apart by id and text, so a row goes only for its own
    text. Rows without words go only if they repeat id and text; null ids stay."""
    a, b = free_name(df, "row_doc"), free_name(df, "row_text")
    known = df.where(F.col(doc_id).isNotNull())
    keyed = known.withColumn(a, F.col(doc_id).cast("long")).withColumn(
        b, F.coalesce(F.unhex(F.md5(F.col(text))), F.lit(b"")))
    rows, labelled = _labelled(keyed.select(F.col(a).alias("doc"), F.col(text).alias("body"), F.col(b).alias("text_key")),
                               percent, "text_key binary, ")
    counted = rows.groupBy("doc", "text_key").agg(F.first("sid").alias("sid"), F.count(F.lit(1)).alias("times"))
    stays = F.coalesce(F.col("head") == F.struct("doc", "text_key"), F.lit(True))
    marks = keep(counted.join(labelled, "sid", "left").withColumn("stays", stays)
                 .where(~F.col("stays") | (F.col("times") > 1))
                 .select(F.col("doc").alias(a), F.col("text_key").alias(b), "stays"), "marks")
    out = keyed.join(marks, [a, b], "left_anti").select(*df.columns)
    repeated = marks.where("stays").select(a, b)
    if not repeated.isEmpty():                         # rows that repeat id and text: one of them
        out = out.unionAll(keyed.join(repeated, [a, b], "left_semi").dropDuplicates([a, b]).select(*df.columns))
    return out.unionAll(df.where(F.col(doc_id).isNull()))
