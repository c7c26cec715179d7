"""Best-fit packing of documents into sequences of a fixed capacity by large-item matching.

Only the number of pieces of each length decides a packing, so it is planned on that histogram, which has at most
`capacity` rows whatever the size of the corpus: pieces over a third of the capacity are matched greedily, at most
two in a bin, the largest with the largest that still fits; smaller ones, in falling length, go where the least room
is left. The plan gives the n-th piece of a length its place, and pieces learn their n by a count in salted groups.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infospan.llm.shared import shuffle_partitions, written
from infospan.llm.tokens import binaries, encoded

#: Rows of one task in a row key.
ROW_BITS = 36


@dataclass
class Bins:
    """`count` bins that hold the same lengths."""

    count: int
    lengths: list[int]
    gap: int


def match_large(left: dict[int, int], capacity: int) -> list[Bins]:
    """Pairs pieces longer than a third of the capacity, the largest first, each with the largest that fits."""
    bins, sizes = [], sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in sizes:
        for p in sizes:
            if left[s] < 1:
                break
            if p > s or p + s > capacity or left[p] < 1 + (p == s):
                continue
            n = left[s] // 2 if p == s else min(left[s], left[p])
            left[s] -= n
            left[p] -= n
            bins.append(Bins(n, [s, p], capacity - s - p))
        if left[s]:
            bins.append(Bins(left[s], [s], capacity - s))
            left[s] = 0
    return bins


def fill_small(left: dict[int, int], bins: list[Bins], capacity: int) -> list[Bins]:
    """Best fit of the other pieces in falling length; opens new bins where none has room."""
    room: dict[int, list[Bins]] = defaultdict(list)
    for b in bins:
        room[b.gap].append(b)
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        n = left[s]
        for gap in range(s, capacity + 1):
            if not n:
                break
            each, kept = gap // s, []
            for b in room[gap] if gap < capacity else ():
                full = min(b.count, n // each)
                rest = n - full * each if full < b.count and n - full * each < each else 0
                if full:
                    room[gap - each * s].append(Bins(full, b.lengths + [s] * each, gap - each * s))
                if rest:
                    room[gap - rest * s].append(Bins(1, b.lengths + [s] * rest, gap - rest * s))
                n -= full * each + rest
                b.count -= full + bool(rest)
                if b.count:
                    kept.append(b)
            if gap < capacity:
                room[gap] = kept
        each = capacity // s
        if n >= each:
            room[capacity - each * s].append(Bins(n // each, [s] * each, capacity - each * s))
        if n % each:
            room[capacity - n % each * s].append(Bins(1, [s] * (n % each), capacity - n % each * s))
        left[s] = 0
    return [b for groups in room.values() for b in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[Bins]:
    left = dict(histogram)
    return fill_small(left, match_large(left, capacity), capacity)


def _places(bins: list[Bins]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of pieces of a length: its first (length, n) as one sorted key, the first's sequence, the offset."""
    taken: dict[int, int] = defaultdict(int)
    found, sequence = [], 0
    for b in bins:
        at = 0
        for s in b.lengths:
            found.append((s << 48 | taken[s], sequence, at))
            taken[s] += b.count
            at += s
        sequence += b.count
    keys, firsts, offsets = zip(*sorted(found), strict=True) if found else ((), (), ())
    return np.array(keys, np.int64), np.array(firsts, np.int64), np.array(offsets, np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, cut: str = "spaces", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(piece_row, doc_id, piece, start, length, ids): the token pieces of each text, ids as little-endian uint32.

    A text longer than `capacity` is cut into pieces of `capacity` ids, only the first of which may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << ROW_BITS
        for rows, ids, counts in encoded(batches, 1, tokenizer, cut, end_id):
            each = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), each)
            piece = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            first = counts - (each - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            bounds = np.concatenate(([0], np.cumsum(length)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(doc))), rows.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binaries(ids, bounds).cast(pa.binary())],
                ["piece_row", "doc_id", "piece", "start", "length", "ids"],
            )
            row += len(doc)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"piece_row long, doc_id {kind}, piece int, start long, length long, ids binary")


@dataclass
class Packed:
    """pieces: as from pieces(), written. places: (piece_row, doc_id, piece, start, length, sequence_id, offset) and what was carried."""

    pieces: DataFrame
    places: DataFrame
    plan: list[Bins] = field(repr=False)

    def sequences(self) -> DataFrame:
        """(sequence_id, n_tokens, ids array, doc_ids array): the packed token sequences themselves."""
        parts = self.places.select("piece_row", "sequence_id", "offset").join(self.pieces.select("piece_row", "doc_id", "length", "ids"), "piece_row")
        listed = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
        grouped = parts.groupBy("sequence_id").agg(listed.alias("parts"))  # a sequence has `capacity` tokens at most
        kind = self.pieces.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(1).to_pylist()
                ids = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32) for row in rows]
                doc_ids = pa.array([[p["doc_id"] for p in row] for row in rows], pa.list_(batch.schema.field(1).type.value_type.field("doc_id").type))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), doc_ids], ["sequence_id", "n_tokens", "ids", "doc_ids"])

        return grouped.mapInArrow(run, f"sequence_id long, n_tokens long, ids array<int>, doc_ids array<{kind}>")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, cut: str = "spaces", id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> Packed:
    """Packs all documents into sequences of at most `capacity` tokens.

    Every row is packed: null and empty texts are the end id alone, repeated rows are packed each, ids may be null.
    An empty table gives no places. Other columns of docs are not read. carry: columns over pieces to keep in places.
    """
    spark = docs.sparkSession
    table = written(pieces(docs, tokenizer, capacity, end_id, cut, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins = plan(histogram, capacity)
    keys, firsts, offsets = _places(bins)
    salt = F.pmod(F.xxhash64("piece_row"), F.lit(max(64, shuffle_partitions(spark))))
    narrow = table.select("piece_row", "doc_id", "piece", "start", "length", *[c.alias(k) for k, c in (carry or {}).items()], salt.alias("salt"))
    counts = table.select("length", salt.alias("salt")).groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = narrow.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("piece_row"))).join(before, ["length", "salt"])
    ranked = ranked.withColumn("n", F.col("before") + F.col("n") - 1).drop("salt", "before")
    names = [c for c in ranked.columns if c != "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, length = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("n", "length"))
            key = length.astype(np.int64) << 48 | n
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(firsts[at] + key - keys[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "n")
    return Packed(table, ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long"), bins)
