"""Alignment, pairing and selection of windowed samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from infospan.functions.scalar import hash_order, seed_of
from infospan.sources.store import shuffle_parts, written


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with `name`: the row's rank from 0 in the order of `order`, nulls first; equal ones follow a hash of their rows.

    Spark sorts df in ranges, as many as the session's shuffle partitions, and df is computed once, as the sorted rows
    are written. A row's rank is its place in its range and the rows of the ranges before, so no task sees the whole
    table; the hash also cuts a value that many rows share.
    """
    plain = [f.name for f in df.schema if f.name != order and isinstance(f.dataType, AtomicType)]
    ties = [F.xxhash64(*plain)] if plain else []
    placed = df.repartitionByRange(shuffle_parts(df.sparkSession), order, *ties).sortWithinPartitions(order, *ties)
    dealt = written(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each shuffle partition
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def paired_windows(x: DataFrame, y: DataFrame) -> DataFrame:
    """(w, id): windows valid in both tables, renumbered from 0."""
    both = x.select("w").distinct().join(y.select("w").distinct(), "w")
    return numbered(both, "w", "id")


def paired_rows(x: DataFrame, y: DataFrame, order_x: str, order_y: str) -> DataFrame:
    """Row n of x with row n of y; what the longer has more is left out."""
    return numbered(x, order_x, "id").join(numbered(y, order_y, "id"), "id")


def lagged(x: DataFrame, y: DataFrame, lag: int, index: str = "idx") -> DataFrame:
    """(idx, x, y): x at idx with y at idx + lag; a negative lag goes the other way."""
    return x.select(F.col(index).alias("idx"), "x").join(y.select((F.col(index) - lag).alias("idx"), "y"), "idx")


def lag_steps(lag: float, rate: float | None = None) -> int:
    return int(round(lag * rate)) if rate else int(lag)


def all_lags(x: DataFrame, y: DataFrame, lags: list[int], index: str = "idx") -> DataFrame:
    """(lag, idx, x, y) for all lags in one join: each y is copied once for each lag."""
    moved = y.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).select("lag", (F.col(index) - F.col("lag")).alias("idx"), "y")
    return x.select(F.col(index).alias("idx"), "x").join(moved, "idx").select("lag", "idx", "x", "y")


def shifted_spikes(spikes: DataFrame, seconds: float) -> DataFrame:
    return spikes.withColumn("t", F.col("t") + seconds)


def epoch_shift(size: float, epoch: int, seed: int) -> float:
    """The shift of a stream in a training epoch: uniform, up to the window's size from the fifth epoch on."""
    most = size * min(1.0, epoch / 5)
    return most * seed_of(seed, epoch) / float(1 << 31)


def randomly_shifted(points: DataFrame, size: float, epoch: int, seed: int) -> DataFrame:
    """Points of any kind at t less the epoch's shift, so that windows begin elsewhere in each epoch."""
    return points.withColumn("t", F.col("t") - epoch_shift(size, epoch, seed))


def histories(series: DataFrame, past: int, future: int = 1, index: str = "idx", value: str = "v") -> DataFrame:
    """(idx, past, future): arrays of the `past` values from idx on and of the `future` ones after them; T - past - future + 1 rows.

    A value joins each array it belongs to by its index, so a long series needs no order in one task.
    """
    span = past + future
    spread = series.select(F.col(index).alias("at"), F.col(value).alias("v")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(span - 1))))
    rows = spread.groupBy((F.col("at") - F.col("k")).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a"))
    full = rows.where(F.size("a") == span).withColumn("a", F.transform("a", lambda s: s["v"]))
    return full.select("idx", F.slice("a", 1, past).alias("past"), F.slice("a", past + 1, future).alias("future"))


def all_pairs(samples: DataFrame, batch: int, order: str = "id") -> DataFrame:
    """(batch, i, j, s): inner products of x_i with every y_j of its batch of `batch` consecutive rows.

    Scores are made in batches as a critic is trained and evaluated in batches; the number of pairs is rows * batch.
    """
    rows = numbered(samples, order, "_n").select(F.floor(F.col("_n") / batch).alias("batch"), F.col(order).alias("i"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        ids, n = part["i"].to_numpy(), len(part)
        s = np.stack(part["x"].to_list()) @ np.stack(part["y"].to_list()).T
        return pd.DataFrame({"batch": part["batch"].iloc[0], "i": np.repeat(ids, n), "j": np.tile(ids, n), "s": s.ravel()})

    kind = rows.schema["i"].dataType.simpleString()
    return rows.groupBy("batch").applyInPandas(score, f"batch long, i {kind}, j {kind}, s double")


def self_pairs(channels: DataFrame) -> DataFrame:
    """(a, b): unordered pairs of channels; as many as channels squared, whatever the number of rows."""
    names = channels.select("channel").distinct()
    return names.select(F.col("channel").alias("a")).join(names.select(F.col("channel").alias("b")), F.col("a") < F.col("b"))


def cross_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b): every channel of x with every one of y."""
    return x.select(F.col("channel").alias("a")).distinct().crossJoin(y.select(F.col("channel").alias("b")).distinct())


def joined_channels(x: DataFrame, z: DataFrame, column: str = "x", other: str = "z") -> DataFrame:
    """(id, xz): the two arrays of an id end to end."""
    return x.join(z, "id").select("id", F.concat(column, other).alias("xz"))


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """(task, names...): every combination, the last name changing fastest."""
    rows: list[tuple] = [()]
    for values in grid.values():
        rows = [(*r, v) for r in rows for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["task", *grid])
    return df


def by_index(windowed: DataFrame, ids: DataFrame, key: str = "w") -> DataFrame:
    return windowed.join(ids.select(key).distinct(), key, "left_semi")


def by_regions(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """(w): windows of regions (a, b): from the last that starts at or before a to the last that starts before b.

    Regions are few, so their first and last windows come from one pass over the windows.
    """
    regions = regions.select("a", "b").distinct()
    pairs = windows.crossJoin(F.broadcast(regions))  # regions are parameters
    found = pairs.groupBy("a", "b").agg(F.max(F.when(F.col("t_start") <= F.col("a"), F.col("w"))).alias("lo"), F.max(F.when(F.col("t_start") < F.col("b"), F.col("w"))).alias("hi"), F.min("w").alias("first"))
    spans = found.select(F.coalesce("lo", "first").alias("lo"), "hi").where("lo <= hi")
    return spans.select(F.explode(F.sequence("lo", "hi")).alias("w")).distinct()


def to_regions(ids: DataFrame, column: str = "w", block: int = 100_000) -> DataFrame:
    """(lo, hi): runs of consecutive ids. Ends of runs are found by two joins with the neighbours, then paired in order."""
    own = ids.select(F.col(column).alias("w")).distinct()
    starts = own.join(own.select((F.col("w") + 1).alias("w")), "w", "left_anti")
    ends = own.join(own.select((F.col("w") - 1).alias("w")), "w", "left_anti")
    return numbered(starts, "w", "k").select("k", F.col("w").alias("lo")).join(numbered(ends, "w", "k").select("k", F.col("w").alias("hi")), "k").select("lo", "hi")


def only_channels(windowed: DataFrame, channels: list) -> DataFrame:
    return windowed.where(F.col("channel").isin(channels))


def picked(column: str, indices: list[int]):
    """Entries of an array column."""
    return F.array(*[F.get(column, F.lit(i)) for i in indices])


def require_finite(df: DataFrame, column: str) -> DataFrame:
    """df, failing on execution if a value is NaN or infinite."""
    bad = F.isnan(column) | (F.abs(column) == float("inf"))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit(f"{column} has NaN or infinite values"))).otherwise(F.col(column)))


def require_not_negative(df: DataFrame, column: str = "t") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) < 0, F.raise_error(F.lit(f"{column} has negative values"))).otherwise(F.col(column)))


def subsample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows by a seeded hash of the key: the same rows however the table is partitioned."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def without_failures(runs: DataFrame, columns: tuple[str, ...] = ("gamma", "train_mi")) -> DataFrame:
    kept = runs.dropna(subset=list(columns))
    for c in columns:
        if runs.schema[c].dataType.typeName() in ("double", "float"):
            kept = kept.where(~F.isnan(c))
    return kept
