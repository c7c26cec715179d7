"""Near-duplicates by SimHash candidates and the exact Jaccard similarity of their sets of shingles.

Sets are dealt by BANDS keys of BAND minimum hashes each, whatever the corpus' size, so a set has BANDS copies of its two 64-bit
fingerprint halves at most. Sets that share a key are compared by their fingerprints, and pairs within BUDGET of 128 bits by their
sets in full; only pairs at or over the wanted similarity link, and components are taken of such links alone.

Groups of near copies don't expand into pairs: first each key's sets meet one of them, drawn anew in each of STARS rounds, and
what links is one component from then on. Then the binary tries of a key's fingerprints are joined with themselves, node pairs within one
component left out, and each pair that is left is compared.

A pair at similarity 0.8 shares a key with odds 0.9994, and differs in BUDGET bits at most with 0.9999 (the bits by the binomial law);
more similar pairs with more. Sets without a common shingle share a key only if 64-bit hashes collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.llm.components import connected_components
from infospan.llm.shared import release, shuffle_partitions, spread_join, whole_groups, written
from infospan.llm.simhash import BITS, Trie, crossed, majority, mixed, named_components, shingle_digests

#: Bits of 128 that may differ in candidates.
BUDGET = 36
#: Keys of a set, and the minimum hashes of one key.
BANDS, BAND = 14, 4
#: Rounds in which the sets of a key are compared with one of them.
STARS = 2
#: Shingles of a block of sets, of which a bucket may need several; sets compared with one set at once.
BLOCK, COMPARED_AT_ONCE = 250_000, 512


def band_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of sets of hashes, which lie end to end; empty sets have keys of zeros."""
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    own = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[own]
    factors = mixed(np.arange(1, BANDS * BAND + 1, dtype=np.uint64)) | np.uint64(1)  # odd: each product permutes the hashes
    for k in range(BANDS if len(own) else 0):
        key = np.full(len(own), k, np.uint64)
        for m in range(BAND):
            key = mixed(key ^ np.minimum.reduceat(flat * factors[k * BAND + m], starts))
        keys[own, k] = key
    return keys.view(np.int64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text; none: empty."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text, words)), ">u8").astype(np.uint64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), flat.view(np.int64))


def _sets(texts: pa.Array, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the texts, and for each a node: equal sets have equal nodes."""
    sets = [shingle_set(x.as_py() or b"", words) for x in texts.cast(pa.large_binary())]
    return sets, np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def set_prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, node, fingerprint, second, size, bands) of each row's set of shingles: the two halves of its fingerprint and its keys stand for sets like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                sets, nodes = _sets(batch.column(1), words)
                flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets], np.int32)
                halves = [pa.array(majority(h, sizes)) for h in (flat, mixed(flat))]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band_keys(flat, sizes).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), *halves, pa.array(sizes), bands], ["id", "node", "fingerprint", "second", "size", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, node long, fingerprint long, second long, size int, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, shingles) for the nodes of wanted (first_id, node): the set of the row with that id and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                sets, nodes = _sets(batch.column(1), words)
                found = pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["node", "shingles"])
                yield found.filter(pa.array(batch.column(0).to_numpy() == nodes))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text")
    return rows.mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))  # ids may repeat


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, fingerprint, second): nodes (node, fingerprint, second, bands) that share a key; keys of the same nodes are one bucket."""
    dealt = nodes.select("node", F.explode("bands").alias("key"))
    sums = [F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("low"), F.max("node").alias("high")]
    shared = written(dealt.groupBy("key").agg(*sums).where("rows > 1"), "shared-keys")
    named = shared.select("key", F.xxhash64("rows", "x", "low", "high").alias("bucket"))
    found = spread_join(dealt, named, ["key"], F.xxhash64("node"), counts=shared.select("key", "rows")).select("bucket", "node").distinct()
    return found.join(nodes.select("node", "fingerprint", "second"), "node").select("bucket", "node", "fingerprint", "second")


def _differ(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(f"{a}fingerprint").bitwiseXOR(F.col(f"{b}fingerprint"))) + F.bit_count(F.col(f"{a}second").bitwiseXOR(F.col(f"{b}second")))


def stars(members: DataFrame, round_: int) -> DataFrame:
    """(src, dst): each node of a bucket with the one that comes first in this round's order, if within BUDGET bits and of another component."""
    mine = F.struct("node", "fingerprint", "second", "component")
    firsts = members.groupBy("bucket").agg(F.min_by(mine, F.struct(F.xxhash64("node", F.lit(round_)), "node")).alias("first")).select("bucket", F.col("first.node").alias("dst"), F.col("first.fingerprint").alias("_fingerprint"), F.col("first.second").alias("_second"), F.col("first.component").alias("_component"))
    met = spread_join(members, firsts, ["bucket"], F.xxhash64("node")).where((F.col("component") != F.col("_component")) & (_differ("", "_") <= BUDGET))
    return met.select(F.least("node", "dst").alias("src"), F.greatest("node", "dst").alias("dst")).distinct()


def near_pairs(keys: np.ndarray, rest: np.ndarray, labels: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of 128-bit fingerprints within `budget` bits and of different labels: a pair has budget // 2 bits or fewer in one half."""
    for own, other in ((keys, rest), (rest, keys)):
        order = np.argsort(own, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
        sizes = np.diff(np.append(new, len(own)))
        low = np.minimum.reduceat(labels[order], new)
        one = np.where(low == np.maximum.reduceat(labels[order], new), low, -1)  # a leaf's label, if it has one
        whole = (np.zeros(1, np.int64), np.full(1, len(new)), np.zeros(1, np.int64), np.full(1, len(new)), np.zeros(1, np.int64))
        mixed_leaves = np.flatnonzero((sizes > 1) & (one < 0))
        for i, j in chain([(mixed_leaves, mixed_leaves)], Trie(own[order][new]).join(whole, 0, [budget // 2] * BITS, one)):
            for a, b in crossed(new[i], sizes[i], new[j], sizes[j]):
                a, b = order[a], order[b]
                near = np.bitwise_count(own[a] ^ own[b]).astype(np.int32) + np.bitwise_count(other[a] ^ other[b]) <= budget
                near &= labels[a] != labels[b]
                yield a[near], b[near]


class _Sets:
    """Sets of a task, end to end, and the components that its links make of their labels."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, least: Fraction):
        self.ids = np.unique(flat, return_inverse=True)[1]
        self.sizes, self.starts, self.least = sizes, np.cumsum(sizes) - sizes, least
        self.marks = np.zeros(int(self.ids.max(initial=0)) + 1, bool)
        self.root, self.labels = np.arange(int(labels.max(initial=0)) + 1), labels

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.root[self.labels[i]] != self.root[self.labels[j]]

    def _common(self, others: np.ndarray) -> np.ndarray:
        """How many marked elements each of these sets has."""
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[others] - (ends - sizes), sizes)
        return np.add.reduceat(self.marks[self.ids[at]], ends - sizes, dtype=np.int64)

    def link(self, i: int, others: np.ndarray) -> list[int]:
        """Those of the others that set i is alike to, one for each component that it did not reach before."""
        n, found = int(self.sizes[i]), []
        top, bottom = self.least.denominator, self.least.numerator
        others = others[(self.sizes[others] * top >= bottom * n) & (n * top >= bottom * self.sizes[others])]
        self.marks[self.ids[self.starts[i] : self.starts[i] + n]] = True
        while len(others := others[self.root[self.labels[others]] != self.root[self.labels[i]]]):
            some, others = others[:COMPARED_AT_ONCE], others[COMPARED_AT_ONCE:]
            common = self._common(some)
            near = some[top * common >= bottom * (n + self.sizes[some] - common)]
            roots, first = np.unique(self.root[self.labels[near]], return_index=True)
            found += near[first].tolist()
            self.root[np.isin(self.root, roots)] = self.root[self.labels[i]]
        self.marks[self.ids[self.starts[i] : self.starts[i] + n]] = False
        return found


def trie_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (src, dst) between components, enough to connect all that pairs of a bucket (bucket, node, fingerprint, second, component) at or over `least` connect.

    The tries of a bucket's fingerprints are joined with themselves; each pair of two components within BUDGET bits is compared by the
    sets, unless links found before have made them one. Edges, not pairs, leave a task. A bucket over BLOCK shingles is cut
    into blocks, every two of which meet in a task.
    """
    wanted, n = Fraction(str(least)), shuffle_partitions(members.sparkSession)
    sized = sets.select("node", F.size("shingles").alias("size"))
    open_ = members.join(sized, "node").groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("size").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = open_.select("bucket", "rows", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = spread_join(members, blocks.select("bucket", "blocks"), ["bucket"], F.xxhash64("node"), counts=blocks.select("bucket", "rows"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (b != F.col("own")) | (F.col("blocks") == 1))
    dealt = dealt.withColumn("other", F.explode(others)).select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "node", "fingerprint", "second", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in whole_groups(batches, "task"):
            task, node, first, second, label = (table[c].to_numpy() for c in ("task", "node", "fingerprint", "second", "component"))
            lists = table["shingles"].combine_chunks()
            all_sizes, flat = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(all_sizes)))
            starts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
            for low, high in zip(starts, [*starts[1:], len(task)], strict=True):
                labels = np.unique(label[low:high], return_inverse=True)[1]
                own, src, dst = _Sets(flat[ends[low] : ends[high]], all_sizes[low:high], labels, wanted), [], []
                for i, j in near_pairs(first[low:high].view(np.uint64), second[low:high].view(np.uint64), labels, BUDGET):
                    open_pairs = own.apart(i, j)
                    i, j = i[open_pairs], j[open_pairs]
                    order = np.argsort(i, kind="stable")
                    i, j = i[order], j[order]
                    at = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, int)
                    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(i)], strict=False):
                        linked = own.link(int(i[a]), j[a:b])
                        src += [int(i[a])] * len(linked)
                        dst += linked
                yield pa.RecordBatch.from_arrays([pa.array(node[low + np.array(src, int)]), pa.array(node[low + np.array(dst, int)])], ["src", "dst"])

    whole = spread_join(dealt, sets, ["node"], F.xxhash64("task"))
    return whole.repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, "src long, dst long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (src, dst) whose sets (node, shingles) are alike to `least` or more, by the exact counts of common elements."""
    wanted = Fraction(str(least))
    left = spread_join(pairs, sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")), ["src"], F.xxhash64("dst"))
    both = spread_join(left, sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b")), ["dst"], F.xxhash64("src"), counts=pairs.groupBy("dst").agg(F.count("*").alias("rows")))
    common = F.size(F.array_intersect("a", "b")).cast("long")
    alike = common * wanted.denominator >= wanted.numerator * (F.size("a") + F.size("b") - common)
    return both.where(alike).select("src", "dst")


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with the component of each node over the edges."""
    if edges.isEmpty():
        return members.withColumn("component", F.col("node"))
    found = connected_components(edges)
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def alike_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """Edges (src, dst) of nodes (node, first_id, fingerprint, second, bands) at or over `least`, enough to connect all that such pairs connect."""
    members = written(buckets(nodes), "buckets")
    wanted = members.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    sets = written(sets_of(docs, wanted, id_col, text_col, words), "candidate-sets")
    edges = members.select(F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)
    for k in range(STARS):
        found = written(confirmed(written(stars(_labelled(members, edges), k), "stars"), sets, least), "alike")
        edges = edges.union(found)
    return edges.union(written(trie_links(written(_labelled(members, edges), "labelled"), sets, least), "trie-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id_col, component_id): component_id is the smallest id reachable over pairs of texts whose sets of shingles are alike to `least`.

    One row for each row of docs. Texts of any length are read whole; those without words are one group. A null id keeps its row; it names a component only
    if that has no other id. Empty input: no rows. Other columns of docs are not read. The keys and BUDGET are fit for a similarity of 0.8 and more.
    """
    rows = written(set_prints(docs, id_col, text_col, words), "set-prints")
    nodes = written(rows.groupBy("node", "size").agg(F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in ("fingerprint", "second", "bands")]), "shingle-nodes")
    edges = alike_links(docs, nodes.where("size > 0"), id_col, text_col, words, least)
    named = written(named_components(edges, nodes.select("node", "first_id")), "named-sets")
    return spread_join(rows.select("id", "node"), named, ["node"], F.xxhash64("id")).select(F.col("id").alias(id_col), "component_id")


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs with the smallest id of their group, all columns; rows that agree in id stay together."""
    groups = near_duplicates(docs, id_col, text_col, words, least)
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")
