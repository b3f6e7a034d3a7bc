"""Conversation prefix trie from double arrays, one per prefix shard.

Conversations are sequences of turns (role, text). A node is a distinct prefix; the
trie tells how much of the conversations is shared.

1. Turns get their place by distributed prefix sums and two 64-bit hashes. A sequence
   is cut into segments of at most SEGMENT turns, each with the hash of all turns
   before it, so a very long conversation is many rows. A prefix's hash is the
   exclusive or of hashes of (depth, turn): 128 bits, known without a chain.
2. Segments are range partitioned by what they start with. Every task cuts its sorted
   rows into blocks (prefix shards), numbers the block's turns densely, packs the block's
   trie into BASE and CHECK arrays (a child's slot is BASE[slot] + turn id) and walks all
   sequences through them, adding up members and the smallest member per slot.
   Nodes that several shards share, mostly the upper ones, are merged by hash.
3. A second walk adds up the subtrees: a conversation is the smallest member of a
   tail of its own path, so with ``own`` (characters of the nodes it is smallest member
   of) a node's saved tokens are the sum, over members, of what follows in the member
   from this node on less ``own``, where positive; leaves likewise. Both are plain sums,
   again merged by hash, so no tree is held anywhere.

A block has at most BLOCK turns, whatever is shared. A conversation's segments (1 / SEGMENT
of its turns, without texts) pass one window. The ids that end at one node are hashed in
one streaming task, as SHA-256 is a chain; only its running state is held.

Defined cases: null role or text = empty; null turns come first; turns alike are
ordered by the md5 of role and text; repeated rows are turns of their own; rows with a
null conversation id belong to no conversation and take no part; a conversation
without turns is a member of the root alone; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusworks.llm.common import keep
from corpusworks.operators.prefix import running_offsets

SEGMENT = 256               # turns of a segment
BLOCK = 200_000             # turns of a prefix shard, about
TRIES = 64                  # places tried for a node of several children before it goes to the end
HOT_SHARE, HOT_LEAST = 1000, 10_000     # parents with more children than total / share are at most HOT_SHARE
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_EMPTY = hashlib.sha256(b"").hexdigest()


# --------------------------------------------------------------------- double array
class DoubleArray:
    """A trie over sequences of dense ids in two arrays. Slots 0 .. roots - 1 are roots;
    BASE[slot] + id is the child's slot if its CHECK is the slot."""

    def __init__(self, base: np.ndarray, check: np.ndarray):
        self.base, self.check = base, check

    @classmethod
    def pack(cls, root: np.ndarray, ids: np.ndarray, lengths: np.ndarray, roots: int) -> "DoubleArray":
        """``ids``: all sequences one after the other; ``root``: each one's root."""
        parent, turn = _edges(root, ids, lengths, roots)
        nodes = roots + len(parent)
        order = np.lexsort((turn, parent))
        starts = np.searchsorted(parent[order], np.arange(nodes))
        counts = np.diff(np.append(starts, len(order)))
        shift = np.zeros(nodes, np.int64)
        size = int(turn.max(initial=0)) + 2 * len(parent) + roots + 1
        used = np.zeros(size, bool)
        used[:roots] = True
        low, end = roots, roots
        several = np.flatnonzero(counts > 1)
        for node in several[np.argsort(-counts[several], kind="stable")].tolist():
            own = turn[order[starts[node]:starts[node] + counts[node]]]
            span = int(own[-1] - own[0]) + 1
            if end + span >= len(used):
                used = np.append(used, np.zeros(max(end + span + 1 - len(used), len(used)), bool))
            places = np.append((np.flatnonzero(~used[low:end]) + low)[:TRIES], end)
            first = next(int(at) for at in places if not used[at + own - own[0]].any())
            used[first + own - own[0]] = True
            shift[node], end = first - own[0], max(end, first + span)
            while low < end and used[low]:
                low += 1
        single = np.flatnonzero(counts == 1)
        free = np.flatnonzero(~used)[:len(single)]
        free = np.append(free, np.arange(len(used), len(used) + len(single) - len(free)))
        shift[single] = free - turn[order[starts[single]]]
        slot = np.append(np.arange(roots), shift[parent] + turn)
        most = int(slot.max(initial=roots)) + 1
        base, check = np.zeros(most, np.int64), np.full(most, -1, np.int64)
        base[slot] = shift
        check[slot[roots:]] = slot[parent]
        return cls(base, check)

    def step(self, slot: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children's slots; -1 where there is none."""
        to = self.base[slot] + ids
        inside = (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == slot), to, -1)

    def find(self, root: int, sequence) -> int:
        slot = np.array([root])
        for t in sequence:
            slot = self.step(slot, np.array([t]))
            if slot[0] < 0:
                return -1
        return int(slot[0])


def _edges(root: np.ndarray, ids: np.ndarray, lengths: np.ndarray, roots: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents and turn ids of the nodes beyond the roots, level by level."""
    begins = np.cumsum(lengths) - lengths
    here, free = root.astype(np.int64), roots
    parents, turns = [], []
    for depth in range(int(lengths.max(initial=0))):
        go = np.flatnonzero(lengths > depth)
        pair, to = np.unique(np.stack([here[go], ids[begins[go] + depth]], 1), axis=0, return_inverse=True)
        parents.append(pair[:, 0])
        turns.append(pair[:, 1])
        here[go] = free + to.ravel()
        free += len(pair)
    if not parents:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(parents), np.concatenate(turns)


def dense_ids(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers of the distinct rows of ``keys`` by first place, so what stands first in
    sequences, the children of a root, lies close together."""
    _, first, to = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, to.ravel(), place)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((first, least))] = np.arange(len(first))
    return rank[to.ravel()]


def turn_marks(keys: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of (depth, turn) for turns at 1-based depths."""
    out = np.empty(keys.shape, np.uint64)
    with np.errstate(over="ignore"):
        for k in (0, 1):
            z = keys[:, k].astype(np.int64).view(np.uint64) + depth.astype(np.uint64) * np.uint64(_STEP[k])
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = z ^ (z >> np.uint64(31))
    return out.view(np.int64)


# -------------------------------------------------------------------- segments of turns
def ordered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, at (0-based place), h1, h2, chars of all turns of conversations with an id."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).isNotNull().alias("dated"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("tie"),
        F.xxhash64(r, t).alias("h1"), F.xxhash64(F.lit(1), r, t).alias("h2"),
        F.length(t).cast("long").alias("chars"), F.lit(1).alias("one"))
    placed = running_offsets(rows, ["conv"], ["dated", "turn", "tie", "h1", "h2", "chars"], "one")
    return keep(placed.select("conv", F.col("start").alias("at"), "h1", "h2", "chars"), "turns")


def rebuilt_segments(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Segments of the conversations rebuilt from the first ``head`` (< most) turns of
    conversation ``base`` and their own turns after the first ``head``: conv, chunk, depth
    (turns before the segment), turns (h1, h2, chars)."""
    one = F.struct("h1", "h2", "chars")
    heads = (turns.where(F.col("at") < most).groupBy("conv")
             .agg(F.sort_array(F.collect_list(F.struct("at", "h1", "h2", "chars"))).alias("head"))  # < most each
             .select(F.col("conv").alias("base"), F.transform("head", lambda x: F.struct(
                 x["h1"].alias("h1"), x["h2"].alias("h2"), x["chars"].alias("chars"))).alias("head")))
    own = turns.withColumn("skip", head).withColumn("own", F.col("at") >= F.col("skip"))
    chunk = F.when(F.col("own"), F.floor((F.col("at") - F.col("skip")) / SEGMENT)).otherwise(F.lit(0)).cast("long")
    chunks = (own.groupBy("conv", chunk.alias("chunk"))                         # every conversation has a chunk 0
              .agg(F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("at", one.alias("t"))))).alias("own"))
              .withColumn("base", base).withColumn("skip", head))
    joined = chunks.join(heads, "base", "left").withColumn(
        "head", F.slice(F.coalesce("head", F.array().cast("array<struct<h1:bigint,h2:bigint,chars:bigint>>")),
                        F.lit(1), F.col("skip").cast("int")))
    own_turns = F.transform("own", lambda x: x["t"])
    return joined.select(
        "conv", "chunk",
        F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.size("head") + F.col("chunk") * SEGMENT).cast("long").alias("depth"),
        F.when(F.col("chunk") == 0, F.concat("head", own_turns)).otherwise(own_turns).alias("turns"))


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lengths, turn keys (n x 2), characters, 1-based depths of all turns of a batch."""
    column = b.column("turns")
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    keys = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2")], 1).astype(np.int64)
    start = b.column("depth").to_numpy().astype(np.int64)
    inside = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return (lengths, keys, flat.field("chars").to_numpy(zero_copy_only=False).astype(np.int64),
            np.repeat(start, lengths) + inside + 1)


def _measure(batches):
    for b in batches:
        lengths, keys, chars, depth = _cells(b)
        marks, owner = turn_marks(keys, depth), np.repeat(np.arange(len(lengths)), lengths)
        x, total = np.zeros((len(lengths), 2), np.int64), np.zeros(len(lengths), np.int64)
        np.bitwise_xor.at(x, owner, marks)
        np.add.at(total, owner, chars)
        for name, values in (("x1", x[:, 0]), ("x2", x[:, 1]), ("chars", total)):
            b = b.append_column(name, pa.array(values))
        yield b


def placed_segments(segments: DataFrame) -> DataFrame:
    """Segments with s1, s2 (hash of the turns before) and after (characters behind)."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema.fields)
    measured = keep(segments.mapInArrow(_measure, types + ", x1 long, x2 long, chars long"), "segments")
    several = measured.where("chunk > 0").select("conv").distinct()
    order = Window.partitionBy("conv").orderBy("chunk")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    starts = (measured.select("conv", "chunk", "x1", "x2", "chars").join(several, "conv", "left_semi")
              .select("conv", "chunk", F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("s1"),
                      F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("s2"),
                      F.coalesce(F.sum("chars").over(behind), F.lit(0)).alias("after")))
    starts = keep(starts, "starts")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("s1", "s2", "after")]
    joined = measured.join(starts, ["conv", "chunk"], "left").select(
        "conv", "chunk", "depth", "turns", "x1", "x2", *zero)
    near = [F.coalesce(F.get("turns", F.lit(i))["h1"], F.lit(0)) for i in range(3)]
    ranged = joined.withColumns({f"k{i}": near[i] for i in range(3)})
    keys = ["s1", "s2", "k0", "k1", "k2", "conv"]
    return keep(keep(ranged, "placed").repartitionByRange(*keys).sortWithinPartitions(*keys).drop("k0", "k1", "k2"),
                "shards")


# --------------------------------------------------------------------------- walks
def _shard_blocks(batches, columns: tuple[str, ...]):
    """Prefix shards of a task's rows: dicts of arrays."""
    held, size = [], 0

    def join():
        start = np.concatenate([np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("s1", "s2", "depth")], 1)
                                for b in held])
        cells = [_cells(b) for b in held]
        out = {c: np.concatenate([b.column(c).to_numpy().astype(np.int64) for b in held]) for c in columns}
        out |= {n: np.concatenate([c[i] for c in cells]) for i, n in enumerate(("lengths", "keys", "chars", "at"))}
        out["starts"], root = np.unique(start, axis=0, return_inverse=True)
        out["root"] = root.ravel()
        return out

    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += len(b) + len(b.column("turns").flatten())
        if size >= BLOCK:
            yield join()
            held, size = [], 0
    if held:
        yield join()


def _walk(block: dict, visit):
    """Pack a block's trie and lead all sequences through it. ``visit(slots, rows, turn
    numbers)`` is called for every level, with turn numbers None at the roots. Returns
    the double array, hashes and depths of the slots, and the roots that are real ones."""
    lengths, starts = block["lengths"], block["starts"]
    begins = np.cumsum(lengths) - lengths
    ids = dense_ids(block["keys"], block["at"]) if len(block["keys"]) else np.zeros(0, np.int64)
    trie = DoubleArray.pack(block["root"], ids, lengths, len(starts))
    marks = turn_marks(block["keys"], block["at"])
    hashes, depth = np.zeros((len(trie.check), 2), np.int64), np.zeros(len(trie.check), np.int64)
    hashes[:len(starts)], depth[:len(starts)] = starts[:, :2], starts[:, 2]
    slot = block["root"].copy()
    whole = np.flatnonzero(starts[slot, 2] == 0)          # the segment before tells of the other roots
    visit(trie, slot[whole], whole, None)
    for level in range(int(lengths.max(initial=0))):
        go = np.flatnonzero(lengths > level)
        turn = begins[go] + level
        to = trie.step(slot[go], ids[turn])
        hashes[to] = hashes[slot[go]] ^ marks[turn]
        depth[to] = depth[slot[go]] + 1
        slot[go] = to
        visit(trie, to, go, turn)
    return trie, hashes, depth


def _members(batches):
    """Per shard and node: hash, parent's hash, depth, characters, members, smallest member."""
    for block in _shard_blocks(batches, ("conv",)):
        n = least = chars = None

        def visit(trie, slots, rows, turns):
            nonlocal n, least, chars
            if n is None:
                n, chars = (np.zeros(len(trie.check), np.int64) for _ in range(2))
                least = np.full(len(trie.check), np.iinfo(np.int64).max)
            np.add.at(n, slots, 1)
            np.minimum.at(least, slots, block["conv"][rows])
            if turns is not None:
                chars[slots] = block["chars"][turns]

        trie, hashes, depth = _walk(block, visit)
        at = np.flatnonzero(n > 0)
        up = hashes[np.maximum(trie.check[at], 0)]
        root = trie.check[at] < 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[at, 0]), pa.array(hashes[at, 1]), pa.array(up[:, 0], mask=root), pa.array(up[:, 1], mask=root),
             pa.array(depth[at]), pa.array(chars[at]), pa.array(n[at]), pa.array(least[at])],
            names=["p1", "p2", "q1", "q2", "depth", "chars", "n", "conv"])


def _subtrees(batches):
    """Per shard and node: hash, saved tokens and leaves, summed over the members."""
    for block in _shard_blocks(batches, ("after", "own", "leaf")):
        lengths, chars = block["lengths"], block["chars"]
        ends, total = np.cumsum(lengths), np.append(0, np.cumsum(chars))
        saved = leaves = None

        def visit(trie, slots, rows, turns):
            nonlocal saved, leaves
            if saved is None:
                saved, leaves = (np.zeros(len(trie.check), np.int64) for _ in range(2))
            begin = ends[rows] - lengths[rows] if turns is None else turns
            rest = total[ends[rows]] - total[begin] + block["after"][rows]
            np.add.at(saved, slots, np.maximum(0, rest - block["own"][rows]))
            np.add.at(leaves, slots, block["leaf"][rows])

        trie, hashes, _ = _walk(block, visit)
        real = trie.check >= 0
        real[:len(block["starts"])] = block["starts"][:, 2] == 0
        at = np.flatnonzero(real)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[at, 0]), pa.array(hashes[at, 1]), pa.array(saved[at]),
                                          pa.array(leaves[at])], names=["p1", "p2", "saved", "leaves"])


def _ends(batches):
    """SHA-256 of the comma-joined ids of every node, from rows sorted by node and id."""
    now, state = None, None
    for b in batches:
        done = []
        for p1, p2, c in zip(*(b.column(k).to_pylist() for k in ("p1", "p2", "conv"))):
            if now != (p1, p2):
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (p1, p2), hashlib.sha256(str(c).encode())
            else:
                state.update(f",{c}".encode())
        yield _end_rows(done)
    if now is not None:
        yield _end_rows([(*now, state.hexdigest())])


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()))],
                                      names=["p1", "p2", "ends"])


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                base: Column | None = None, head: Column | None = None, most: int = 1) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. ``base`` and ``head`` (expressions over the column
    conv) rebuild every conversation from the first ``head`` < ``most`` turns of another
    one and its own turns after its first ``head``; without them conversations stay as they are."""
    turns = ordered_turns(df, conv, turn, role, text)
    segments = placed_segments(rebuilt_segments(turns, base if base is not None else F.col("conv"),
                                                head if head is not None else F.lit(0), most))
    node = ["p1", "p2"]
    merged = keep(segments.select("conv", "depth", "turns", "s1", "s2").mapInArrow(
        _members, "p1 long, p2 long, q1 long, q2 long, depth long, chars long, n long, conv long")
        .groupBy(*node).agg(F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("depth").alias("depth"),
                            F.max("chars").alias("chars"), F.sum("n").alias("n"), F.min("conv").alias("conv")), "nodes")
    children = keep(merged.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"))
                    .agg(F.count(F.lit(1)).alias("n_children")), "children")
    smallest = (merged.join(children, node, "left").groupBy("conv")
                .agg(F.sum("chars").alias("own"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf")))
    told = segments.join(smallest, "conv", "left").withColumns({
        "own": F.coalesce("own", F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0))})
    sums = (told.select("conv", "depth", "turns", "s1", "s2", "after", "own", "leaf")
            .withColumn("k", F.coalesce(F.get("turns", F.lit(0))["h1"], F.lit(0)))
            .repartitionByRange("s1", "s2", "k", "conv").sortWithinPartitions("s1", "s2", "k", "conv").drop("k")
            .mapInArrow(_subtrees, "p1 long, p2 long, saved long, leaves long"))
    ends = (segments.groupBy("conv").agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
            .repartition(*node).sortWithinPartitions(*node, "conv")
            .mapInArrow(_ends, "p1 long, p2 long, ends string"))

    def facts(rows: DataFrame) -> DataFrame:
        names = ("q1", "q2", "depth", "n", "conv", "n_children", "saved", "leaves")
        return rows.select(*node, *[F.col(c).cast("long") if c in rows.columns else F.lit(None).cast("long").alias(c)
                                    for c in names],
                           F.col("ends") if "ends" in rows.columns else F.lit(None).cast("string").alias("ends"))

    whole = facts(merged).unionAll(facts(children)).unionAll(facts(sums)).unionAll(facts(ends))
    nodes = keep(whole.groupBy(*node).agg(
        *[F.max(c).alias(c) for c in ("q1", "q2", "depth", "n", "conv", "n_children", "ends")],
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie")

    up = nodes.where("n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), "n_children",
                                              F.col("conv").alias("parent_conv_id"))
    hot = max(HOT_LEAST, nodes.count() // HOT_SHARE)
    few = up.where(F.col("n_children") > hot).drop("n_children")                    # at most HOT_SHARE rows
    rest = up.where(F.col("n_children") <= hot).drop("n_children")
    under_few = nodes.join(F.broadcast(few), ["q1", "q2"])
    others = nodes.join(F.broadcast(few), ["q1", "q2"], "left_anti").join(rest, ["q1", "q2"], "left")
    return under_few.unionByName(others).select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))
