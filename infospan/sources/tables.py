"""Streams and samples from tables, and results to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infospan.errors import DataShapeError

KINDS = ("static", "continuous", "spike", "categorical")


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp, with or without zone."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)
    return micros / 1e6


def _require(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise DataShapeError(f"the table lacks {', '.join(missing)}")


def signal(df: DataFrame, t: Column, value: Column, channel: Column | None = None) -> DataFrame:
    """(t, channel, value)"""
    return df.select(t.cast("double").alias("t"), (channel if channel is not None else F.lit(0)).alias("channel"), value.cast("double").alias("value"))


def spikes(df: DataFrame, t: Column, neuron: Column) -> DataFrame:
    """(neuron, t)"""
    return df.select(neuron.alias("neuron"), t.cast("double").alias("t"))


def states(df: DataFrame, t: Column, category: Column, channel: Column | None = None) -> DataFrame:
    """(t, channel, category)"""
    return df.select(t.cast("double").alias("t"), (channel if channel is not None else F.lit(0)).alias("channel"), category.alias("category"))


def wide_to_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, channel, value): a row for each listed column."""
    _require(df, [key, *columns])
    rows = F.array(*[F.struct(F.lit(k).alias("channel"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)])
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.channel", "r.value")


def vector_halves(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(id, x, y): the first `size` entries of a vector and the next `size`."""
    _require(df, [key, vector])
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(key).alias("id"), F.slice(v, 1, size).alias("x"), F.slice(v, size + 1, size).alias("y"))


def single(df: DataFrame, kind: str, grid=None, **options) -> DataFrame:
    """One stream as windows: `static` as it is; `continuous`, `spike` and `categorical` by their encodings on a grid.

    options: seconds or sample_rate (continuous), bin_size (spike: binned), encoding and slots and categories (categorical).
    """
    from infospan.operators import windows as W

    if kind == "static":
        return df
    if kind == "continuous":
        return W.signal_windows(df, grid, options.get("seconds") or 1 / options["sample_rate"])
    if kind == "spike":
        return W.binned_spikes(df, grid, options["bin_size"]) if options.get("bin_size") else W.spike_windows(df, grid, options.get("cap"))
    if kind == "categorical":
        encoding = options.get("encoding", "majority_vote")
        if encoding == "majority_vote":
            return W.majority(df, grid)
        return W.probabilities(df, grid) if encoding == "probability" else W.trajectories(df, grid, options["categories"], options["slots"])
    raise DataShapeError(f"kind is one of {', '.join(KINDS)}")


def valid_windows(df: DataFrame, kind: str, grid, **options) -> DataFrame:
    """(w): windows of the grid with enough of the stream: a spike, or distinct times for `min_coverage` (0.2) of the slots.

    seconds, or sample_rate, gives the slots of continuous and categorical streams; categorical ones may name `slots`.
    """
    from infospan.operators import windows as W

    if kind == "spike":
        return W.spike_coverage(df, grid)
    if kind == "static":
        return df.select("w").distinct()
    seconds = options.get("seconds") or (1 / options["sample_rate"] if options.get("sample_rate") else None)
    slots = options.get("slots") or (W.slots_of(grid.size, seconds, kind == "categorical") if seconds else 1)
    return W.covered(df, grid, slots, options.get("min_coverage", 0.2)).select("w")


def paired(x: DataFrame, y: DataFrame, kind_x: str, kind_y: str | None = None, size: float = 1.0, step: float | None = None, options_x: dict | None = None, options_y: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Two streams on the grid of their common time, windows valid in both, renumbered from 0; y takes x's kind and options if it has none."""
    from infospan.operators import align
    from infospan.operators import windows as W

    kind_y, options_x = kind_y or kind_x, options_x or {}
    options_y = options_x if options_y is None else options_y
    grid = W.grid_for(size, x, y, step=step)
    wx, wy = single(x, kind_x, grid, **options_x), single(y, kind_y, grid, **options_y)
    both = align.paired_windows(valid_windows(x, kind_x, grid, **options_x), valid_windows(y, kind_y, grid, **options_y))
    return tuple(w.join(both, "w").drop("w").withColumnRenamed("id", "w") for w in (wx, wy))


def save(df: DataFrame, path: str) -> None:
    """Parquet; an existing result is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
