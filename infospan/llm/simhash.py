"""SimHash fingerprints and their near-duplicate groups by a self-join of binary tries.

The join compares distinct fingerprints only. Cut 64 bits into budget + 1 blocks: for a pair within `budget` differing
bits there is a block to begin at, going round, so that the first l blocks always have at most l / (budget + 1) of the
budget (the cycle lemma). The fingerprints are dealt out once for each block, rotated so that it comes first, by its
value, as it must be equal; with many fingerprints also by further bits and by each way in which the two sides of a pair
may differ in these. Each task builds a binary trie over what it gets. From there the nodes on the two sides
of a pair are traversed together, a level at a time: a node pair splits into its child pairs, a differing branch costs
one bit, and pairs over the budget so far are dropped. Work follows the node pairs alive, never the square of a block.

Fingerprints of two halves (128 bits) are joined by a trie over either half, which may differ in `part` bits; the whole
is then held against the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.llm.components import connected_components
from infospan.llm.shared import release, shuffle_partitions, spread_join, whole_groups, written

BITS = 64
#: Shingles whose bits are counted at once, and node pairs traversed at once: bounds on a task's memory.
SHINGLES_AT_ONCE = 1 << 15
PAIRS_AT_ONCE = 1 << 19
#: Key pairs of two nodes below which the keys are compared and the nodes no longer split.
SMALL = 16
#: Fingerprints with equal leading bits, on the average, above which they are dealt by more bits; rows that a task joins at once.
KEYS_AT_ONCE = 1 << 19
#: Leading bits by which fingerprints are dealt at most.
DEALT_BITS = 24


def shingle_digests(text: bytes, words: int) -> list[bytes]:
    """XXH64 (seed 42, big-endian) of every run of `words` words, lower-cased in A-Z; fewer words make one run."""
    parts = text.lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [xxhash.xxh64_digest(b" ".join(parts), 42)]
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    return [digest(line[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A second 64 bits of each hash, by the splitmix64 finaliser."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The signed 64-bit fingerprint of each run of `counts` hashes: bit b is 1 if set in over half of them; none: 0. Whole runs are counted in slices."""
    counts = np.asarray(counts, np.int64)
    ones, ends = np.zeros((len(counts), BITS), np.int64), np.cumsum(counts)
    for low in range(0, int(ends[-1]) if len(ends) else 0, SHINGLES_AT_ONCE):
        part = hashes[low : low + SHINGLES_AT_ONCE]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first, last = np.searchsorted(ends, [low, low + len(part) - 1], "right")
        own = first + np.flatnonzero(counts[first : last + 1])
        ones[own] += np.add.reduceat(bits, np.maximum(ends[own] - counts[own] - low, 0), axis=0, dtype=np.int32)
    return np.packbits((2 * ones > counts[:, None]).astype(np.uint8), axis=1).view(">u8").reshape(-1).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fingerprint): bit b is 1 if set in over half of the hashes of the shingles, repeats included; no words or null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            digests, counts, held = [], [], 0
            for text in batch.column(1).cast(pa.large_binary()):
                own = shingle_digests(text.as_py() or b"", words)
                if held and held + len(own) > SHINGLES_AT_ONCE:
                    found.append(majority(np.frombuffer(b"".join(digests), ">u8"), counts))
                    digests, counts, held = [], [], 0
                digests += own
                counts.append(len(own))
                held += len(own)
            found.append(majority(np.frombuffer(b"".join(digests), ">u8"), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


class Trie:
    """A binary trie over distinct 64-bit keys, sorted within runs that share leading bits; a node is a range of keys with a common prefix.

    Equal keys are for the caller to join: the trie tells keys apart by their bits alone.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.zeros: dict[int, np.ndarray] = {}

    def split(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        """Where the 1-branch of each node of this depth begins."""
        if depth not in self.zeros:
            bit = (self.keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.zeros[depth] = np.concatenate(([0], np.cumsum(bit == 0))).astype(np.int32)
        z = self.zeros[depth]
        return low + z[high] - z[low]

    def join(self, pairs: tuple[np.ndarray, ...], depth: int, allowed: list[int], labels: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i < j) of near keys below the node pairs (low, high, low, high, bits that differ so far) of this depth.

        allowed: bits that may differ in the first d + 1 bits. labels: of the keys, -1 for none; node pairs all of one label are left out.
        """
        budget = allowed[-1]
        changes = None if labels is None else np.concatenate(([0], np.cumsum((labels[1:] != labels[:-1]) | (labels[1:] < 0)))).astype(np.int32)
        kinds = (np.int32, np.int32, np.int32, np.int32, np.int8)
        todo = [(depth, tuple(x.astype(t) for x, t in zip(pairs, kinds, strict=True)))]
        while todo:
            depth, pairs = todo.pop()
            if len(pairs[0]) > PAIRS_AT_ONCE:
                half = len(pairs[0]) // 2
                todo += [(depth, tuple(x[:half] for x in pairs)), (depth, tuple(x[half:] for x in pairs))]
                continue
            a, a_end, b, b_end, used = pairs
            if changes is not None:
                one = (labels[a] == labels[b]) & (labels[a] >= 0) & (changes[a_end - 1] == changes[a]) & (changes[b_end - 1] == changes[b])
                a, a_end, b, b_end, used = pairs = tuple(x[~one] for x in pairs)
            small = (a_end - a).astype(np.int64) * (b_end - b) <= SMALL
            if small.any():
                for i, j in crossed(a[small], a_end[small] - a[small], b[small], b_end[small] - b[small]):
                    near = _popcount(self.keys[i] ^ self.keys[j]) <= budget
                    if near.any():
                        yield i[near], j[near]
                a, a_end, b, b_end, used = (x[~small] for x in pairs)
            if not len(a) or depth == BITS:
                continue
            a_mid, b_mid, same = self.split(a, a_end, depth), self.split(b, b_end, depth), a == b
            children = [(a, a_mid, b, b_mid, used, None), (a_mid, a_end, b_mid, b_end, used, None), (a, a_mid, b_mid, b_end, used + 1, None), (a_mid, a_end, b, b_mid, used + 1, ~same)]
            kept = []
            for x, x_end, y, y_end, cost, also in children:
                alive = (x < x_end) & (y < y_end) & (cost <= allowed[depth])
                alive &= (x != y) | (x_end - x > 1)
                if also is not None:
                    alive &= also
                kept.append(tuple(v[alive] for v in (x, x_end, y, y_end, cost)))
            merged = tuple(np.concatenate(v).astype(t) for v, t in zip(zip(*kept, strict=True), kinds, strict=True))
            if len(merged[0]):
                todo.append((depth + 1, merged))


def stars(n: int, edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n, by hooking and pointer jumping; edges come in bounded slices."""
    root = np.arange(n, dtype=np.int64)
    for i, j in edges:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := root[root], root):
                root = jumped
    return root


def crossed(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of the members of ranges a and b, given by their firsts and sizes, in bounded slices."""
    counts = a_size.astype(np.int64) * b_size
    ends = np.cumsum(counts)
    for low in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        at = np.arange(low, min(low + PAIRS_AT_ONCE, int(ends[-1])))
        first, last = np.searchsorted(ends, [low, at[-1]], "right")
        inside = np.minimum(ends[first : last + 1], at[-1] + 1) - np.maximum(ends[first : last + 1] - counts[first : last + 1], low)
        k = np.repeat(np.arange(first, last + 1), inside)
        off, width = at - (ends - counts)[k], b_size[k]
        i = a[k] + off // width
        j = b[k] + off - off // width * width
        keep = i < j
        yield i[keep], j[keep]


def _rotate(column: F.Column, by: int) -> F.Column:
    return column if not by else F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, BITS - by))


def ring(budget: int) -> list[int]:
    """Where the blocks of a 64-bit fingerprint begin, and its end."""
    return [round(i * BITS / (budget + 1)) for i in range(budget + 2)]


def allowed_bits(budget: int, start: int) -> list[int]:
    """For each depth, the differing bits that the blocks up to there may have, the first being block `start`."""
    cuts, found = ring(budget), []
    for n in range(budget + 1):
        k = (start + n) % (budget + 1)
        found += [(n + 1) * budget // (budget + 1)] * (cuts[k + 1] - cuts[k])
    return found


def differences(allowed: list[int], depth: int) -> list[int]:
    """The ways, as `depth`-bit numbers, in which the leading bits of two near keys may differ."""
    found = [0]
    for d in range(depth):
        found = [m << 1 | bit for m in found for bit in (0, 1) if m.bit_count() + bit <= allowed[d]]
    return found


def links(distinct: DataFrame, budget: int = 3, halves: int = 1, part: int | None = None) -> DataFrame:
    """Edges (src, dst) of the distinct rows (node, fingerprint, second) whose closure is that of all pairs within `budget` bits, `part` of them in one half.

    At most one edge a node and run of a task: it keeps only the star of each group that it found.
    """
    part = budget if part is None else part
    cuts, n_keys = ring(part), distinct.count()
    columns = [("fingerprint", "second"), ("second", "fingerprint")][:halves]
    allowed, depths = [allowed_bits(part, k) for k in range(part + 1)], []
    for k in range(part + 1):
        depth = cuts[k + 1] - cuts[k]
        while n_keys >> depth > KEYS_AT_ONCE and depth < DEALT_BITS:
            depth += 1
        depths.append(depth)
    copies = []
    for own, other in columns:
        for k in range(part + 1):
            ways = F.array(*map(F.lit, differences(allowed[k], depths[k])))
            copies.append(F.struct(F.lit(len(copies)).alias("block"), _rotate(F.col(own), cuts[k]).alias("key"), F.col(other).alias("rest"), F.lit(depths[k]).alias("depth"), ways.alias("ways")))
    dealt = distinct.select("node", F.explode(F.array(*copies)).alias("x")).select("node", "x.*").select("*", F.explode("ways").alias("way"))
    head = F.expr("shiftrightunsigned(key, 64 - depth)")
    task = F.xxhash64("block", "way", F.least(head, head.bitwiseXOR(F.col("way"))))
    dealt = dealt.select(task.alias("task"), "block", "way", "node", "key", "rest")

    def near(task: np.ndarray, way: np.ndarray, keys: np.ndarray, rest: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows, which come by task and key."""
        depth = depths[k]
        new = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]) | (keys[1:] != keys[:-1]))))
        leaves, sizes = keys[new], np.diff(np.append(new, len(keys)))
        low = np.flatnonzero(np.concatenate(([True], task[new][1:] != task[new][:-1])))
        high, differ = np.append(low[1:], len(new)), way[new][low]
        heads = leaves >> np.uint64(BITS - depth)
        middle = np.concatenate(([0], np.cumsum(heads != np.repeat(heads[low], high - low))))
        middle = high - (middle[high] - middle[low])  # where the other side of a task begins
        own = (differ == 0) & (high - low > 1)
        two = (differ != 0) & (middle < high)
        roots = [np.concatenate(x) for x in ((low[own], low[two]), (high[own], middle[two]), (low[own], middle[two]), (high[own], high[two]), (0 * low[own], np.bitwise_count(differ[two])))]
        pairs = Trie(leaves).join(tuple(roots), depth, allowed[k])
        shared = np.flatnonzero((sizes > 1) & (way[new] == 0))  # nodes that differ in the other half only
        for i, j in chain([(shared, shared)], pairs):
            if halves == 1:
                yield new[i], new[j]
                continue
            for a, b in crossed(new[i], sizes[i], new[j], sizes[j]):
                close = _popcount(keys[a] ^ keys[b]).astype(np.int32) + _popcount(rest[a] ^ rest[b]) <= budget
                yield a[close], b[close]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in whole_groups(batches, "task", KEYS_AT_ONCE):
            task, block, way, node, key, rest = (table[c].to_numpy() for c in ("task", "block", "way", "node", "key", "rest"))
            for k in np.unique(block).tolist():
                mine = np.flatnonzero(block == k)
                own, at = np.unique(node[mine], return_inverse=True)
                pairs = near(task[mine], way[mine], key[mine].view(np.uint64), rest[mine].view(np.uint64), k % (part + 1))
                root = stars(len(own), ((at[i], at[j]) for i, j in pairs))  # the smallest node, so that tasks that see a group give the same edges
                found = np.flatnonzero(root != np.arange(len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(own[found]), pa.array(own[root[found]])], ["src", "dst"])

    n = shuffle_partitions(distinct.sparkSession)
    return dealt.repartition(n, "task").sortWithinPartitions("task", "key").mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id): component_id is the smallest id reachable over links of at most `budget` bits.

    One row for each row of docs. Texts of any length are read whole; those without words, null among them, have fingerprint 0
    and are linked like any other. A null id keeps its row; it names a component only if that has no other
    id. Empty input: no rows. Other columns of docs are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words).withColumnRenamed(id_col, "id"), "fingerprints")
    firsts = written(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    edges = written(links(firsts.select(F.col("fingerprint").alias("node"), "fingerprint", F.lit(0).cast("long").alias("second")), budget), "simhash-links")
    named = named_components(edges, firsts.withColumnRenamed("fingerprint", "node")).withColumnRenamed("node", "fingerprint")
    rows = spread_join(prints, named, ["fingerprint"], F.xxhash64("id"))
    return rows.select(F.col("id").alias(id_col), "fingerprint", "component_id")


def named_components(edges: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, component_id) of every row of firsts (node, first_id): the least first_id of its component."""
    grouped = connected_components(edges).join(firsts, "node")
    least = grouped.groupBy("component").agg(F.min("first_id").alias("least"))
    joined = spread_join(grouped, least, ["component"], F.xxhash64("node")).select("node", "least")
    return firsts.join(joined, "node", "left").select("node", F.coalesce("least", "first_id").alias("component_id"))


def hex16(fingerprint: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
