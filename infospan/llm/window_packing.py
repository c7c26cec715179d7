"""Bounded-space online packing of documents into windows of a fixed capacity.

A task reads its documents once, in whatever order they come, and holds `open_windows` windows at most. A document's
tail goes where it leaves the least room; when no window has room and none may be opened, the fullest is topped up with
the tail's first tokens and emitted. At its end a task pours the emptier windows into the fuller ones; what it then
holds, less than one window, is merged with the others' leftovers by running sums over the tasks. The last remainder
is cut into windows whose lengths are powers of two, which need no padding. No document is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.llm.shared import small, written
from infospan.llm.tokens import binaries, encoded

#: Windows of one task in a sequence id.
WINDOW_BITS = 36
#: The task number that stands for merged windows; tasks count up from 0.
MERGED = (1 << 26) - 1

#: A piece within its task's run of documents: (document, start, length).
Piece = tuple[int, int, int]


@dataclass
class Window:
    used: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += piece[2]


class OpenWindows:
    """At most `most` windows that are not yet full, in order of the room left."""

    def __init__(self, capacity: int, most: int, slack: int = 0):
        self.capacity, self.most, self.slack = capacity, most, slack
        self.rooms: list[tuple[int, int]] = []  # (room, name), ascending
        self.windows: dict[int, Window] = {}
        self.named = 0

    def _keep(self, window: Window) -> list[Window]:
        if window.used == self.capacity:
            return [window]
        self.named += 1
        self.windows[self.named] = window
        insort(self.rooms, (self.capacity - window.used, self.named))
        return []

    def _take(self, at: int) -> Window:
        return self.windows.pop(self.rooms.pop(at)[1])

    def place(self, doc: int, length: int) -> list[Window]:
        """Places a document; returns the windows that it completes or drives out."""
        out, start = [], 0
        while length - start >= self.capacity:
            out.append(Window(self.capacity, [(doc, start, self.capacity)]))
            start += self.capacity
        while start < length:
            left = length - start
            at = bisect_left(self.rooms, (left, 0))
            if at < len(self.rooms):
                window, taken = self._take(at), left
            elif len(self.rooms) < self.most:
                window, taken = Window(), left
            else:  # none has room: the fullest goes, topped up unless its gap is within the slack
                window = self._take(0)
                taken = self.capacity - window.used
                if taken <= self.slack:
                    out.append(window)
                    continue
            window.put((doc, start, taken))
            start += taken
            out += self._keep(window)
        return out

    def drain(self) -> tuple[list[Window], Window]:
        """Pours the emptier windows into the fuller ones: full windows, and the one that is left, which may be empty."""
        held = [self._take(0) for _ in range(len(self.rooms))]
        out = []
        while len(held) > 1:
            window, gap = held[0], self.capacity - held[0].used
            if gap <= self.slack:
                out.append(held.pop(0))
                continue
            source = held[-1]
            doc, start, length = source.pieces.pop()
            taken = min(gap, length)
            window.put((doc, start, taken))
            source.used -= taken
            if taken < length:
                source.pieces.append((doc, start + taken, length - taken))
            if not source.pieces:
                held.pop()
            if window.used == self.capacity:
                out.append(held.pop(0))
        return out, held[0] if held else Window()


def _row_batch(docs: pa.RecordBatch, ids: np.ndarray, counts: np.ndarray, firsts: np.ndarray, found: list[tuple[int, int, int, int | None, int]]) -> pa.RecordBatch:
    """found: (row of docs, start, length, sequence, offset); firsts: where each row's ids begin."""
    row, start, length = (np.array([f[k] for f in found], np.int64) for k in range(3))
    ends = np.cumsum(length)
    at = np.repeat(firsts[row] + start - (ends - length), length) + np.arange(ends[-1])
    return pa.RecordBatch.from_arrays(
        [
            docs.column(0).take(pa.array(row)),
            pa.array(start),
            pa.array(length),
            pa.array(counts[row]),
            pa.array([f[3] for f in found], pa.int64()),
            pa.array([f[4] for f in found], pa.int64()),
            pa.array(np.full(len(found), TaskContext.get().partitionId(), np.int32)),
            binaries(ids[at], np.concatenate(([0], ends))).cast(pa.binary()),
        ],
        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "task", "ids"],
    )


class _Run:
    """One task's documents as they pass: only those with a piece in an open window are held."""

    def __init__(self, capacity: int, open_windows: int, slack: int):
        self.open = OpenWindows(capacity, open_windows, slack)
        self.task = TaskContext.get().partitionId()
        self.emitted = 0
        self.count = 0  # documents so far
        self.held: tuple[pa.RecordBatch, np.ndarray, np.ndarray] | None = None
        self.names = np.zeros(0, np.int64)  # the documents held, ascending

    def _rows(self, windows: list[Window], last: Window | None = None) -> list[tuple]:
        found = []
        for window in windows:
            name, at = self.task << WINDOW_BITS | self.emitted, 0
            self.emitted += 1
            for doc, start, length in window.pieces:
                found.append((doc, start, length, name, at))
                at += length
        at = 0
        for doc, start, length in last.pieces if last else ():
            found.append((doc, start, length, None, at))
            at += length
        return found

    def _emit(self, docs: pa.RecordBatch, ids: np.ndarray, counts: np.ndarray, names: np.ndarray, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            firsts = np.cumsum(counts) - counts
            rows = np.searchsorted(names, [f[0] for f in found])
            yield _row_batch(docs, ids, counts, firsts, [(r, *f[1:]) for r, f in zip(rows.tolist(), found, strict=True)])

    def add(self, docs: pa.RecordBatch, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        docs, names = docs.select([0]), self.count + np.arange(len(counts))
        self.count += len(counts)
        out: list[Window] = []
        for doc, length in zip(names.tolist(), counts.tolist(), strict=True):
            out += self.open.place(doc, length)
        if self.held is not None:
            docs = pa.RecordBatch.from_arrays([pa.concat_arrays([self.held[0].column(0), docs.column(0)])], docs.schema.names)
            ids, counts, names = np.concatenate([self.held[1], ids]), np.concatenate([self.held[2], counts]), np.concatenate([self.names, names])
        yield from self._emit(docs, ids, counts, names, self._rows(out))
        kept = np.unique(np.array([p[0] for w in self.open.windows.values() for p in w.pieces], np.int64))
        at = np.searchsorted(names, kept)
        mask = np.zeros(len(names), bool)
        mask[at] = True
        self.held, self.names = (docs.take(pa.array(at)), ids[np.repeat(mask, counts)], counts[at]), kept

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            full, last = self.open.drain()
            yield from self._emit(*self.held, self.names, self._rows(full, last))


def _placed(docs: DataFrame, tokenizer: str, capacity: int, open_windows: int, slack: int, end_id: int, cut: str, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = _Run(capacity, open_windows, slack)
        for rows, ids, counts in encoded(batches, 1, tokenizer, cut, end_id):
            yield from packing.add(rows, ids, counts)
        yield from packing.end()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, task int, ids binary")


def _merged(left: DataFrame, capacity: int) -> DataFrame:
    """The leftovers of all tasks end to end, cut at every `capacity` tokens and, in the last remainder, at powers of two.

    A task leaves less than a window: its running start comes from one row a task.
    """
    spark = left.sparkSession
    sums = sorted((r["task"], r["n"]) for r in left.groupBy("task").agg(F.sum("length").alias("n")).collect())
    starts, total = [], 0
    for task, n in sums:
        starts.append((task, total))
        total += n
    whole, cuts = total // capacity * capacity, []
    at = whole
    for k in range(capacity.bit_length(), -1, -1):
        if (total - whole) >> k & 1:
            cuts.append(at)
            at += 1 << k
    # Where the windows of the last remainder begin: fewer than the bits of the capacity.
    tail = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    low = F.col("base") + F.col("offset")
    high = low + F.col("length")
    fulls = F.when(low < whole, F.transform(F.sequence(F.floor(low / capacity), F.floor((F.least(high, F.lit(whole)) - 1) / capacity)), lambda k: (k * capacity).cast("long")))
    lasts = F.filter(tail, lambda c: (c < high) & (F.coalesce(F.array_min(F.filter(tail, lambda d: d > c)), F.lit(total)) > low))
    begun = left.join(small(spark, starts, "task int, base long"), "task").withColumn("low", low).withColumn("high", high)
    dealt = begun.withColumn("window", F.explode(F.concat(F.coalesce(fulls, F.array().cast("array<long>")), lasts)))
    after = F.coalesce(F.array_min(F.filter(tail, lambda d: d > F.col("window"))), F.lit(total))
    end = F.when(F.col("window") < whole, F.col("window") + capacity).otherwise(after)
    first, last = F.greatest("low", "window"), F.least(F.col("high"), end)
    skip = first - F.col("low")
    order = F.when(F.col("window") < whole, F.floor(F.col("window") / capacity)).otherwise(F.lit(whole // capacity) + F.array_position(tail, F.col("window")) - 1)
    return dealt.select(
        "doc_id",
        (F.col("start") + skip).alias("start"),
        (last - first).alias("length"),
        "doc_tokens",
        (F.lit(MERGED << WINDOW_BITS) + order).cast("long").alias("sequence_id"),
        (first - F.col("window")).alias("offset"),
        F.substring("ids", (4 * skip + 1).cast("int"), (4 * (last - first)).cast("int")).alias("ids"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_windows: int = 64, slack: int = 0, end_id: int = 1, cut: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all documents, ids as little-endian uint32.

    Each id of each document lies in one piece, pieces fill a sequence without gaps from 0, and sequences hold `capacity` ids
    or, for the last remainder, a power of two. slack: ids of padding accepted in a sequence rather than a cut.
    Null and empty texts are the end id alone; repeated rows are packed each; ids may be null, of any type. An empty table
    gives no pieces. Texts of any length are read whole. Other columns of docs are not read.
    """
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows must be 1 or more")
    placed = written(_placed(docs, tokenizer, capacity, open_windows, slack, end_id, cut, id_col, text_col), "windows")
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return placed.where("sequence_id IS NOT NULL").select(*columns).unionByName(_merged(placed.where("sequence_id IS NULL"), capacity).select(*columns))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): the token sequences themselves, ids as little-endian uint32; a sequence has `capacity` tokens at most."""
    listed = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    grouped = pieces.groupBy("sequence_id").agg(listed.alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return grouped.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"), joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
