"""Codebooks for parts of vectors by Lloyd's rounds with Elkan's bounds, in exact integers.

The vectors stay where they are read: a round is one pass over them, and each is written with its state. For
each part of a vector the state holds its entry, an upper bound of the distance to that entry and a lower bound of the
distance to each entry. When entries move, bounds are shifted by the movement. An entry is left out only where a bound
says strictly that it is farther; the others, ties among them, are decided by integer distances. Bounds are rounded
outwards, so no rounding can leave out an entry that ties. Each batch also writes its sums by entry; only these few numbers
are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.llm.shared import delete, scratch, spread_join, written
from infospan.llm.tokens import binaries

#: Relative error allowed for in a bound, above that of float32 and of the operations that make it.
MARGIN = 2.0**-20


def _up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter((x * (1 + MARGIN)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.maximum(np.nextafter((x * (1 - MARGIN)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _root(squares) -> np.ndarray:
    """Square roots of integers of any size as floats; beyond their range: infinite."""
    flat = np.asarray(squares, object).reshape(-1)
    return np.array([math.sqrt(x) if x < 1 << 1000 else math.inf for x in flat]).reshape(np.shape(squares))


@dataclass(frozen=True)
class Codebook:
    """entries[part][k] is a tuple of integers; all parts have as many entries."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    @property
    def shape(self) -> tuple[int, int, int]:
        return len(self.entries), len(self.entries[0]), len(self.entries[0][0])

    def array(self) -> np.ndarray:
        return np.array(self.entries, object).reshape(self.shape)

    def fits(self, width: int) -> int:
        """Components up to this size keep squared distances within 62 bits."""
        return math.isqrt((1 << 62) // max(1, width)) // 2

    def largest(self) -> int:
        return max((abs(x) for part in self.entries for entry in part for x in entry), default=0)

    def moved_to(self, new: Codebook) -> np.ndarray:
        return _root(((new.array() - self.array()) ** 2).sum(axis=2))

    def apart(self) -> np.ndarray:
        """Distances between the entries of each part."""
        a = self.array()
        return _root(((a[:, :, None, :] - a[:, None, :, :]) ** 2).sum(axis=3))


@dataclass
class State:
    """Of n vectors: entry (n, parts) and, outward rounded, upper (n, parts) and lower (n, parts, entries)."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @staticmethod
    def unknown(n: int, parts: int, entries: int) -> State:
        return State(np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, entries), np.float32))


def assign(vectors: np.ndarray, state: State, book: Codebook, moved: np.ndarray | None) -> tuple[State, np.ndarray, int]:
    """The state after assignment to the book's entries, the squared distances, where known (else -1), and how many were computed.

    vectors: integers (n, parts, width), int64 or, beyond what that holds exactly, Python's. moved: how far each entry moved since the state was made.
    """
    parts, entries, width = book.shape
    n, computed = len(vectors), 0
    squares = np.full((n, parts), -1, vectors.dtype)
    new = State(state.entry.copy(), state.upper.copy(), state.lower.copy())
    centres = book.array()
    if vectors.dtype == object:  # beyond 64 bits: all distances, no bounds
        for p in range(parts):
            all_squares = ((vectors[:, p, None, :] - centres[p][None]) ** 2).sum(axis=2)
            new.entry[:, p] = [min(range(entries), key=row.__getitem__) for row in all_squares.tolist()]
            squares[:, p] = all_squares[np.arange(n), new.entry[:, p]]
        new.upper[:], new.lower[:] = np.inf, 0
        return new, squares, n * parts * entries
    centres = centres.astype(np.int64)
    apart = book.apart()
    for p in range(parts):
        entry, x = new.entry[:, p].astype(np.int64), vectors[:, p]
        if moved is not None:
            new.upper[:, p] = _up(new.upper[:, p].astype(np.float64) + moved[p][entry])
            new.lower[:, p] = _down(new.lower[:, p].astype(np.float64) - np.minimum(moved[p], np.finfo(np.float64).max))
        upper, lower = new.upper[:, p], new.lower[:, p]
        half = _down(apart[p] / 2)
        np.fill_diagonal(half, np.inf)
        todo = np.flatnonzero(~(upper < half.min(axis=1)[entry]))  # strictly below: no other entry is as near
        may = (lower[todo] <= upper[todo, None]) & (half[entry[todo]] <= upper[todo, None])
        todo, may = todo[may.any(axis=1)], may[may.any(axis=1)]
        if not len(todo):
            continue
        own = ((x[todo] - centres[p][entry[todo]]) ** 2).sum(axis=1)
        computed += len(todo)
        new.upper[todo, p] = _up(np.sqrt(own.astype(np.float64)))
        new.lower[todo, p, entry[todo]] = _down(np.sqrt(own.astype(np.float64)))
        squares[todo, p] = own
        may &= (new.lower[todo, p] <= new.upper[todo, p, None]) & (half[entry[todo]] <= new.upper[todo, p, None])
        may[np.arange(len(todo)), entry[todo]] = False
        row, k = np.nonzero(may)
        found = ((x[todo[row]] - centres[p][k]) ** 2).sum(axis=1)
        computed += len(row)
        new.lower[todo[row], p, k] = _down(np.sqrt(found.astype(np.float64)))
        table = np.full(may.shape, np.iinfo(np.int64).max)
        table[np.arange(len(todo)), entry[todo]] = own
        table[row, k] = found
        best = table.argmin(axis=1)  # the first of equals
        new.entry[todo, p] = best
        squares[todo, p] = table[np.arange(len(todo)), best]
        new.upper[todo, p] = _up(np.sqrt(squares[todo, p].astype(np.float64)))
    return new, squares, computed


def _floored(batch: pa.Array, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x) as integers (n, parts, width): int64, or Python's where one is beyond 2^53."""
    lists = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(batch)
    width = len(lists) // (n * parts) if n else 0
    big = np.abs(lists).max(initial=0) >= 2.0**53 / scale
    if big:
        values = np.array([math.floor(scale * int(x)) if x == int(x) else math.floor(scale * x) for x in lists.tolist()], object)
    else:
        values = np.floor(lists * scale).astype(np.int64)
    return values.reshape(n, parts, width)


def _pack(vectors: np.ndarray) -> tuple[bool, pa.Array]:
    """Whether as 32-bit integers, else as text, and each vector's bytes."""
    flat = vectors.reshape(len(vectors), -1)
    if vectors.dtype == object or np.abs(vectors).max(initial=0) >= 1 << 31:
        return False, pa.array([",".join(map(str, row)).encode() for row in flat.tolist()], pa.binary())
    return True, _bytes(flat.astype(np.int32))


def _bytes(rows: np.ndarray) -> pa.Array:
    rows = rows.reshape(len(rows), -1)
    return binaries(rows.reshape(-1), np.arange(len(rows) + 1) * rows.shape[1]).cast(pa.binary())


def _numbers(column: pa.Array, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _unpack(narrow: bool, column: pa.Array, parts: int, width: int, limit: int) -> np.ndarray:
    """int64 where `limit` allows, else Python's integers."""
    if narrow:
        values = _numbers(column, "<i4", (parts, width)).astype(np.int64)
    else:
        values = np.array([int(x) for row in column.to_pylist() for x in row.decode().split(",")], object).reshape(len(column), parts, width)
    small = not values.size or max(abs(int(values.max())), abs(int(values.min()))) <= limit
    return values.astype(np.int64 if small else object)


#: One row a vector; one more for each batch of a task, with nothing but its sums.
_STATE = "narrow boolean, vector binary, entry binary, upper binary, lower binary, sums array<string>, counts array<long>, computed long"


def _sums(vectors: np.ndarray, entry: np.ndarray, entries: int) -> tuple[list[str], list[int]]:
    """By part and entry: the componentwise sums, and how many vectors."""
    n, parts, width = vectors.shape
    flat = (entry.astype(np.int64) + np.arange(parts) * entries).reshape(-1)
    order = np.argsort(flat, kind="stable")
    counts = np.bincount(flat, minlength=parts * entries)
    sums = np.zeros((parts * entries, width), vectors.dtype)
    used = np.flatnonzero(counts)
    if n:
        sums[used] = np.add.reduceat(vectors.reshape(-1, width)[order], (np.cumsum(counts) - counts)[used], axis=0)
    return [str(x) for x in sums.reshape(-1).tolist()], counts.tolist()


class Coder:
    """The passes over vectors of one type of id and label."""

    def __init__(self, id_type: str, label_type: str, parts: int, scale: int):
        self.carried, self.parts, self.scale = f"id {id_type}, label {label_type}", parts, scale

    def first(self, rows: DataFrame, book: Codebook) -> DataFrame:
        """The state of rows (id, label, vector), assigned to the first entries."""
        parts, scale, entries, put = self.parts, self.scale, book.shape[1], self._put

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = _floored(batch.column(2), scale, parts)
                yield from put(batch.column(0), batch.column(1), vectors, State.unknown(len(batch), parts, entries), book, None)

        return rows.mapInArrow(run, f"{self.carried}, {_STATE}")

    @staticmethod
    def _put(ids: pa.Array, labels: pa.Array, vectors: np.ndarray, state: State, book: Codebook, moved: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if not len(vectors):
            return
        n, limit = len(vectors), book.fits(vectors.shape[2])
        wide = vectors.dtype == object or book.largest() > limit or int(np.abs(vectors).max()) > limit
        state, _, computed = assign(vectors.astype(object) if wide else vectors, state, book, moved)
        sums, counts = _sums(vectors.astype(object) if wide else vectors, state.entry, book.shape[1])
        narrow, data = _pack(vectors)
        names = ["id", "label", "narrow", "vector", "entry", "upper", "lower", "sums", "counts", "computed"]
        kinds = [ids.type, labels.type, pa.bool_(), *[pa.binary()] * 4, pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()]
        own = [ids, labels, pa.array(np.full(n, narrow)), data, _bytes(state.entry), _bytes(state.upper), _bytes(state.lower)]
        yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, k) for k in kinds[7:])], names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:7]), *(pa.array([v], k) for v, k in zip((sums, counts, computed), kinds[7:], strict=True))], names)

    @staticmethod
    def _read(batch: pa.RecordBatch, book: Codebook) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, State]]:
        parts, entries, width = book.shape
        for narrow in (True, False):
            part = batch.filter(pc.equal(batch.column("narrow"), narrow))
            if len(part):
                state = State(_numbers(part.column("entry"), "u1", (parts,)), _numbers(part.column("upper"), "<f4", (parts,)), _numbers(part.column("lower"), "<f4", (parts, entries)))
                yield part.column("id"), part.column("label"), _unpack(narrow, part.column("vector"), parts, width, book.fits(width)), state

    def step(self, state: DataFrame, book: Codebook, moved: np.ndarray) -> DataFrame:
        """The state after assignment to the moved entries."""
        read, put = self._read, self._put

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, vectors, before in read(batch, book):
                    yield from put(ids, labels, vectors, before, book, moved)

        return state.where("narrow IS NOT NULL").select("id", "label", "narrow", "vector", "entry", "upper", "lower").mapInArrow(run, f"{self.carried}, {_STATE}")

    def coded(self, state: DataFrame, book: Codebook) -> DataFrame:
        """(id, label, entry array, error) of every vector; an error beyond a long is null."""
        read = self._read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, vectors, last in read(batch, book):
                    wide = vectors.dtype == object or book.largest() > book.fits(book.shape[2])
                    centres = book.array() if wide else book.array().astype(np.int64)
                    squares = ((vectors - centres[np.arange(book.shape[0]), last.entry.astype(np.int64)]) ** 2).sum(axis=2)
                    errors = [e if e < 1 << 63 else None for e in (sum(row) for row in squares.tolist())]
                    entries = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * book.shape[0], pa.int32()), pa.array(last.entry.reshape(-1).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([ids, labels, entries, pa.array(errors, pa.int64())], ["id", "label", "entry", "error"])

        rows = state.where("narrow IS NOT NULL").select("id", "label", "narrow", "vector", "entry", "upper", "lower")
        return rows.mapInArrow(run, f"{self.carried}, entry array<int>, error long")


def _means(state: DataFrame, book: Codebook) -> Codebook:
    """Every entry at the floor of its parts' mean; unused ones stay. As many rows as the book has numbers leave the tasks."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [0] * (parts * entries * width), [0] * (parts * entries)
        for batch in batches:
            for row in range(len(batch)):
                sums = [a + int(b) for a, b in zip(sums, batch.column(0)[row].as_py(), strict=True)]
                counts = [a + b for a, b in zip(counts, batch.column(1)[row].as_py(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(x) for x in sums]]), pa.array([counts], pa.list_(pa.int64()))], ["sums", "counts"])

    partial = state.where("counts IS NOT NULL").select("sums", "counts").mapInArrow(run, "sums array<string>, counts array<long>")
    numbered = partial.select(F.posexplode(F.concat("sums", F.transform("counts", lambda c: c.cast("string")))).alias("at", "x"))
    total = {r["at"]: int(r["x"]) for r in numbered.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    n_sums = parts * entries * width

    def entry(p: int, k: int) -> tuple[int, ...]:
        count, at = total.get(n_sums + p * entries + k, 0), (p * entries + k) * width
        return tuple(total[at + w] // count for w in range(width)) if count else book.entries[p][k]

    return Codebook(tuple(tuple(entry(p, k) for k in range(entries)) for p in range(parts)))


@dataclass
class Coded:
    """rows: (id, label, entry array<int>, error). computed: distances computed in each pass."""

    rows: DataFrame
    book: Codebook
    computed: list[int]


def code(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Coded:
    """Cuts vectors into equal parts, fits a codebook for each part position and gives each part its nearest entry.

    Rows whose vector is null or holds a null or non-finite component are dropped; the others must have one length, a multiple of
    `parts`, else ValueError. Components become floor(scale * x). The first entries are those of the smallest ids, null ids last, equal
    ids by their vectors; with fewer rows there are fewer entries. Repeated rows count each. An empty table gives no rows and an empty
    book. Other columns are not read. Components of any finite size are exact: beyond 64 bits in Python's integers, without bounds.
    """
    if entries > 256:
        raise ValueError("a code has one byte a part: 256 entries at most")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = rows.where(F.col("vector").isNotNull() & finite)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not seeds:
        return Coded(rows.select("id", "label", F.array().cast("array<int>").alias("entry"), F.lit(0).cast("long").alias("error")), Codebook(()), [])
    length = len(seeds[0]["vector"])
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    unequal = f"vectors must have {length} components, as the first has"
    if any(len(r["vector"]) != length for r in seeds):
        raise ValueError(unequal)
    wrong = F.raise_error(F.lit(unequal))
    rows = rows.withColumn("vector", F.when(F.size("vector") == length, F.col("vector")).otherwise(wrong.cast(rows.schema["vector"].dataType)))
    found = np.concatenate([_floored(pa.array([r["vector"]], pa.list_(pa.float64())), scale, parts) for r in seeds])
    book = Codebook(tuple(tuple(tuple(int(x) for x in found[k, p]) for k in range(len(seeds))) for p in range(parts)))
    coder = Coder(rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString(), parts, scale)
    computed, path = [], scratch(spark, "codes-0")
    state = written(coder.first(rows, book), "codes", path=path)
    for r in range(rounds):
        new = _means(state, book)
        computed.append(state.agg(F.sum("computed")).first()[0])
        before, path = path, scratch(spark, f"codes-{r + 1}")
        state, book = written(coder.step(state, new, book.moved_to(new)), "codes", path=path), new
        delete(before)  # a round's state goes when the next is written
    computed.append(state.agg(F.sum("computed")).first()[0])
    return Coded(coder.coded(state, book), book, computed)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors summed over equal labels, nulls together; null beyond a long. A label may hold any share of the rows."""
    keyed = coded.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.bool_or(F.col("error").isNull()).alias("over"))
    sums = sums.select("_key", F.when(~F.col("over"), F.expr("try_cast(total AS BIGINT)")).alias("label_error"))
    return spread_join(keyed, sums, ["_key"], F.xxhash64("id")).drop("_key")
