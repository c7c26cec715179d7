"""A prefix trie of conversations by a global sort of their turn arrays.

A turn is the first 16 bytes of the SHA-256 of its role and text, so that an array is a byte string whose order keeps
equal beginnings together, whatever the texts' length. The arrays are range-sorted by (array, id). Each task sweeps its run
once: the longest common prefix of neighbours says how many nodes of the open stack end, and a node that ends passes its sums
to the one below. A node on the path of a task's first or last array may go on in the next task, so its sums leave the
task as a fragment. Fragments of a node are added up; where a run's last path and the next run's first share nodes, what
both counted is taken off again. Everything a node returns is such a sum, a minimum or a hash over ids in sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infospan.llm.shared import shuffle_partitions, small, spread_join, written

#: Bytes of a turn.
WIDTH = 16
#: Bytes of a node's list of ids that a task holds; more leave it in chunks. Rows that leave a task at once.
CHUNK, ROWS = 8192, 5000


def turn_arrays(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id long, turns binary, sizes array<long>): each conversation's turns in order, null first, equal ones by their bytes.

    Null roles and texts are empty, null ids no conversation. sizes: UTF-8 bytes of the texts. Texts are hashed before any shuffle.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.struct(F.col(turn_col).isNotNull().alias("set"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"),
    )
    listed = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("id", F.unhex(F.array_join(F.col("ts.digest"), "")).alias("turns"), F.col("ts.size").alias("sizes"))


def grafted(arrays: DataFrame, base: Column, turns: Column, most: int) -> DataFrame:
    """Each array with its first `turns` (at most `most`) turns replaced by those of the array whose id is `base`: all if it has fewer, none if absent."""
    arrays = written(arrays, "turn-arrays")
    heads = arrays.select(F.col("id").alias("_base"), F.substring("turns", 1, WIDTH * most).alias("_head"), F.slice("sizes", 1, most).alias("_sizes"))
    h = F.col("_h")
    joined = arrays.withColumn("_h", turns.cast("int")).withColumn("_base", base).join(heads, "_base", "left")
    return joined.select(
        "id",
        F.concat(F.coalesce(F.substring("_head", F.lit(1), WIDTH * h), F.unhex(F.lit(""))), F.substring("turns", WIDTH * h + 1, F.octet_length("turns"))).alias("turns"),
        F.concat(F.coalesce(F.slice("_sizes", F.lit(1), h), F.array().cast("array<long>")), F.slice("sizes", h + 1, F.size("sizes"))).alias("sizes"),
    )


class _Node:
    """An open node: what the task has seen of it so far."""

    __slots__ = ("key", "size", "first", "conv", "n", "children", "leaves", "saved", "ends", "held", "chunks")

    def __init__(self, key: bytes, size: int, first: bool):
        self.key, self.size, self.first = key, size, first
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[str] = []
        self.held = self.chunks = 0


#: kind 0: a node; 1: a fragment of one; 2: a chunk of the ids that end in a fragment's node.
_SWEPT = "kind int, part int, first boolean, last boolean, key binary, parent_key binary, depth int, conv_id long, n long, children long, leaves long, saved long, size long, seq int, ends string"
_NAMES = [c.split()[0] for c in _SWEPT.split(", ")]


class _Sweep:
    def __init__(self, part: int, chunk: int):
        self.part, self.chunk = part, chunk
        self.stack: list[_Node] = []
        self.path: list = []  # hashes of the open node's path, one a depth
        self.turns = b""
        self.rows: list[tuple] = []

    def add(self, conv: int, turns: bytes, sizes: list[int]) -> None:
        first = not self.stack
        if first:
            self.path = [hashlib.sha256()]
            self.stack.append(_Node(self.path[0].digest()[:WIDTH], 0, True))
        depth, shared = len(turns) // WIDTH, 0
        most = min(depth, len(self.stack) - 1)
        while shared < most and turns[WIDTH * shared : WIDTH * (shared + 1)] == self.turns[WIDTH * shared : WIDTH * (shared + 1)]:
            shared += 1
        while len(self.stack) > shared + 1:
            self.close(False)
        for d in range(shared, depth):
            path = self.path[-1].copy()
            path.update(turns[WIDTH * d : WIDTH * (d + 1)])
            self.path.append(path)
            self.stack.append(_Node(path.digest()[:WIDTH], sizes[d], first))
        top = self.stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(conv, top.conv)
        top.ends.append(str(conv))
        top.held += len(top.ends[-1]) + 1
        if top.held > self.chunk:
            self.rows.append((2, self.part, None, None, top.key, None, None, None, None, None, None, None, None, top.chunks, ",".join(top.ends)))
            top.ends, top.held, top.chunks = [], 0, top.chunks + 1
        self.turns = turns

    def close(self, last: bool) -> None:
        node = self.stack.pop()
        self.path.pop()
        depth, above = len(self.stack), self.stack[-1] if self.stack else None
        node.leaves += not node.children
        node.saved += (node.n - 1) * node.size
        if above:
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
        ends = ",".join(node.ends)
        whole = not (last or node.first or node.chunks)
        self.rows.append((0 if whole else 1, self.part, node.first, last, node.key, above.key if above else None, depth, node.conv, node.n, node.children, node.leaves, node.saved, node.size, node.chunks, hashlib.sha256(ends.encode()).hexdigest() if whole else ends))

    def out(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 6, pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], _NAMES)
            self.rows = []


def swept(arrays: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Nodes, fragments and chunks of each task's run of the sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(TaskContext.get().partitionId(), chunk)
        for batch in batches:
            for i in range(len(batch)):
                sweep.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                yield from sweep.out(ROWS)
        while sweep.stack:
            sweep.close(True)
            yield from sweep.out(ROWS)
        yield from sweep.out(0)

    n = shuffle_partitions(arrays.sparkSession)
    ordered = arrays.select("id", "turns", "sizes").repartitionByRange(n, "turns", "id").sortWithinPartitions("turns", "id")
    return ordered.mapInArrow(run, _SWEPT)


def _corrections(fragments: DataFrame) -> DataFrame:
    """What fragments count twice, of nodes that one run's last path shares with the next run's first."""
    spark = fragments.sparkSession
    parts = sorted(r["part"] for r in fragments.where("depth = 0").select("part").collect())  # one a task
    following = small(spark, list(zip(parts, parts[1:], strict=False)), "part int, next int")
    ended = fragments.where("last").select("part", "key", "depth", "size").join(following, "part")
    begun = fragments.where("first").select(F.col("part").alias("next"), "key")
    lengths = ended.groupBy("part").agg(F.max("depth").alias("length"))
    shared = ended.join(begun, ["next", "key"]).join(lengths, "part")
    below = Window.partitionBy("part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = shared.withColumn("twice", F.sum("size").over(below)).withColumn("deepest", F.max("depth").over(Window.partitionBy("part")))
    return shared.select(
        "key",
        "depth",
        (-(F.col("depth") < F.col("deepest")).cast("long")).alias("children"),
        (-(F.col("deepest") == F.col("length")).cast("long")).alias("leaves"),
        F.col("twice").alias("saved"),
    )


def _stitched(fragments: DataFrame) -> DataFrame:
    columns = ["key", "parent_key", "depth", "conv_id", "n", "children", "leaves", "saved"]
    both = fragments.select(*columns).unionByName(_corrections(fragments), allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    return both.groupBy("key", "depth").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *sums)


def _hashed(chunks: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 of each key's chunks, comma-joined, in one pass that holds a batch of chunks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, found = None, None, []
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        found.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
        if key is not None:
            found.append((key, state.hexdigest()))
        for low in range(0, len(found), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found[low : low + ROWS]], pa.binary()), pa.array([f[1] for f in found[low : low + ROWS]])], ["key", "ends"])

    n = shuffle_partitions(chunks.sparkSession)
    return chunks.repartition(n, "key").sortWithinPartitions("key", "part", "seq").select("key", "text").mapInArrow(run, "key binary, ends string")


def trie(arrays: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the arrays' trie.

    arrays: (id long, turns binary, sizes array<long>), an id once. A node is a distinct beginning of `depth` turns, the root that of
    none; conv_id is its smallest member and, with depth, names it. saved_tokens: over its subtree, the sum of (members - 1) x the bytes of
    the last text. ends_sha256: of the ids, ascending and comma-joined, of the arrays that end there. Arrays without turns belong to the
    root alone; without arrays there are no nodes. A task holds one path of open nodes,
    `chunk` bytes of ids for each, and an array's 24 bytes a turn.
    """
    table = written(swept(written(arrays, "conversation-arrays"), chunk), "swept")
    fragments = table.where("kind = 1")
    chunks = table.where("kind > 0 AND ends <> ''").select("key", "part", "seq", F.col("ends").alias("text"))
    none = F.lit(hashlib.sha256().hexdigest())
    whole = table.where("kind = 0").select("key", "parent_key", "depth", "conv_id", "n", "children", "leaves", "saved", "ends")
    stitched = _stitched(fragments).join(_hashed(chunks), "key", "left").withColumn("ends", F.coalesce("ends", none))
    nodes = written(whole.unionByName(stitched), "nodes")
    above = nodes.where("children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    counts = nodes.where("children > 0").select(F.col("key").alias("parent_key"), F.col("children").alias("rows"))
    named = spread_join(nodes, above, ["parent_key"], F.xxhash64("key"), "left", counts)
    return named.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
