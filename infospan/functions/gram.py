"""Means and centred products of array columns, summed inside the tasks: one row a task and key leaves them, not one a sample and cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups in which the tasks' rows are merged before the groups are; bytes of sums that a task holds before it lets them go.
LOTS, HELD_BYTES = 64, 64 << 20

Sums = tuple[int, np.ndarray, np.ndarray]


def merged(a: Sums | None, b: Sums) -> Sums:
    """Counts, means and centred products of two sets of rows together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def of_rows(v: np.ndarray) -> Sums:
    mean = v.mean(axis=0)
    return len(v), mean, (v - mean).T @ (v - mean)


def unpacked(row) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(n, entries of x, mean, centred products) of a row of sums(): those of x and y end to end."""
    mean = np.frombuffer(row["mean"], np.float64)
    return int(row["n"]), int(row["dx"]), mean, np.frombuffer(row["products"], np.float64).reshape(len(mean), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by the entries of x and y: keys may differ in them."""
    if len(batch):
        sizes = np.stack([pc.list_value_length(batch[c]).to_numpy() for c in ("x", "y")])
        for size in np.unique(sizes, axis=1).T:
            same = (sizes == size[:, None]).all(axis=0)
            yield batch if same.all() else batch.filter(pa.array(same))


def sums(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, dx, n, mean, products) of samples (keys, x array, y array), a row a key; see unpacked(). Rows with a null or NaN entry are left out; a key's arrays have one size."""
    keys = keys or []
    whole = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    rows = samples.select(*keys, F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    rows = rows.where(F.coalesce(whole("x") & whole("y"), F.lit(False)))
    schema = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys) + "dx int, n long, mean binary, products binary, lot int, task int"
    names = [*keys, "dx", "n", "mean", "products", "lot", "task"]

    def row(key: tuple, dx: int, found: Sums, lot: int, task: int) -> dict:
        return dict(zip(keys, key, strict=True)) | {"dx": dx, "n": found[0], "mean": found[1].tobytes(), "products": np.ascontiguousarray(found[2]).tobytes(), "lot": lot, "task": task}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        task, held, taken = TaskContext.get().partitionId(), {}, 0
        for batch in (part for whole in batches for part in _by_size(whole)):
            x, y = (batch[c].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in ("x", "y"))
            v, named = np.hstack([x, y]), batch.select(keys).to_pandas() if keys else None
            groups = named.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(v)))]
            for key, at in groups:
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(k) else k for k in key)
                if key not in held:
                    taken += 8 * v.shape[1] ** 2
                held[key] = (x.shape[1], merged(held[key][1] if key in held else None, of_rows(v[at])))
            if taken > HELD_BYTES:
                yield pd.DataFrame([row(k, dx, f, task % LOTS, task) for k, (dx, f) in held.items()])[names]
                held, taken = {}, 0
        if held:
            yield pd.DataFrame([row(k, dx, f, task % LOTS, task) for k, (dx, f) in held.items()])[names]

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"dx": pa.int32(), "n": pa.int64(), "mean": pa.binary(), "products": pa.binary(), "lot": pa.int32(), "task": pa.int32()}
        kept = {}

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept.update({k: batch.schema.field(k).type for k in keys})
                yield batch

        for frame in run(seen()):
            yield pa.RecordBatch.from_pandas(frame, pa.schema([(c, (kept | kinds)[c]) for c in names]), preserve_index=False)

    def together(part: pd.DataFrame) -> pd.DataFrame:
        found = None
        for r in part.sort_values(["lot", "task"]).to_dict("records"):
            n, dx, mean, products = unpacked(r)
            found = merged(found, (n, mean, products))
        first = part.iloc[0]
        return pd.DataFrame([row(tuple(first[k] for k in keys), dx, found, 0, int(first["lot"]))])[names]

    each = rows.mapInArrow(arrow, schema)
    lots = each.groupBy(*keys, "lot").applyInPandas(together, schema)  # their own lot is 0
    return lots.groupBy(*(keys or ["lot"])).applyInPandas(together, schema).drop("lot", "task")


def cells(summed: DataFrame, keys: list[str], of) -> DataFrame:
    """(keys, i, j, c): the matrix that `of(n, dx, mean, products)` makes of each row of sums()."""
    schema = "".join(f"`{k}` {summed.schema[k].dataType.simpleString()}, " for k in keys) + "i int, j int, c double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.to_dict("records"):
                c = of(*unpacked(r))
                i, j = np.indices(c.shape)
                yield pd.DataFrame({k: [r[k]] * c.size for k in keys} | {"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "c": c.ravel()})

    return summed.mapInPandas(run, schema)
