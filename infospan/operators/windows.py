"""Half-open time windows over signals (t, channel, value), spikes (neuron, t) and states (t, channel, category).

Window w covers [t0 + w * step, t0 + w * step + size). Points find their windows by arithmetic and an explode, never
by a range join. Orders along time are cut into buckets of time, so no task holds a whole channel.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from infospan.operators.quantiles import medians
from infospan.sources.store import shuffle_parts, written


@dataclass(frozen=True)
class Grid:
    """step None: size; below 1: a fraction of size; else seconds. step_seconds, if given, is always seconds."""

    size: float
    t_start: float
    t_end: float
    step: float | None = None
    step_seconds: float | None = None

    @property
    def every(self) -> float:
        if self.step_seconds is not None:
            return self.step_seconds
        return self.size if self.step is None else self.step * self.size if 0 < self.step < 1 else float(self.step)

    @property
    def count(self) -> int:
        return max(0, math.ceil((self.t_end - self.t_start) / self.every))

    def windows(self, spark: SparkSession) -> DataFrame:
        """(w, t_start)"""
        return spark.range(self.count).select(F.col("id").alias("w"), (F.lit(float(self.t_start)) + F.col("id") * self.every).alias("t_start"))

    def start(self, w: Column) -> Column:
        return F.lit(float(self.t_start)) + w * F.lit(float(self.every))

    def of(self, t: Column) -> Column:
        """The windows that cover t, as an array, empty if none do."""
        high = F.least(F.floor((t - self.t_start) / self.every), F.lit(self.count - 1).cast("long"))
        low = F.greatest(F.floor((t - self.t_start - self.size) / self.every) + 1, F.lit(0).cast("long"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    def assign(self, points: DataFrame) -> DataFrame:
        """points with `w`, a row for each window that covers `t`."""
        return points.withColumn("w", F.explode(self.of(F.col("t"))))


def each_window(names: DataFrame, grid: Grid, block: int = 65_536) -> DataFrame:
    """names with `w`: a row for every window of the grid; a name's windows are made in blocks that spread over tasks."""
    if not grid.count:
        return names.where("false").withColumn("w", F.lit(0).cast("long"))
    blocks = names.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((grid.count - 1) // block)))).repartition("_block", *names.columns)
    first = F.col("_block").cast("long") * block
    windows = F.sequence(first, F.least(first + (block - 1), F.lit(grid.count - 1).cast("long")))
    return blocks.withColumn("w", F.explode(windows)).drop("_block")


def extent(points: DataFrame) -> tuple[float, float]:
    r = points.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return r["a"], r["b"]


def overlap(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
    return max(a[0], b[0]), min(a[1], b[1])


def grid_for(size: float, *streams: DataFrame, step: float | None = None, n_seconds: float | None = None) -> Grid:
    """The grid over the time that all streams share; n_seconds overrides the end."""
    spans = [extent(s) for s in streams]
    start, end = max(s[0] for s in spans), min(s[1] for s in spans)
    return Grid(size, start, start + n_seconds if n_seconds else end, step)


# ---------------------------------------------------------------- spikes


def max_events(spikes: DataFrame, size: float, bucket: float | None = None) -> DataFrame:
    """(neuron, most): the most spikes in any closed span of `size` seconds, at least 1.

    Each spike is two marks: it comes in at t - size and, after all that come in there, goes out at t. The spikes inside a span that ends at t are
    the running sum of the marks up to t - size, so a spike costs the same however many share its span. Marks are
    cut into ranges of equal numbers, or into buckets of time if `bucket` is given; what was inside before a range comes from the ranges' sums.
    """
    counted = spikes.groupBy("neuron", "t").agg(F.count("*").alias("n"))
    kinds = F.array(F.struct((F.col("t") - float(size)).alias("at"), F.lit(False).alias("out"), F.col("n").alias("d")), F.struct(F.col("t").alias("at"), F.lit(True).alias("out"), (-F.col("n")).alias("d")))
    marks = counted.select("neuron", F.explode(kinds).alias("x")).select("neuron", "x.*")
    if bucket is None:
        marks = written(marks.repartitionByRange(shuffle_parts(spikes.sparkSession), "neuron", "at", "out").withColumn("_part", F.spark_partition_id().cast("long")), "marks")
    else:
        marks = marks.withColumn("_part", F.when(~F.isnan("at"), F.floor(F.col("at") / bucket)))
    inside = F.sum("d").over(Window.partitionBy("neuron", "_part").orderBy("at", "out").rowsBetween(Window.unboundedPreceding, 0))
    parts = marks.withColumn("inside", inside).groupBy("neuron", "_part").agg(F.sum("d").alias("d"), F.max("inside").alias("top"))
    before = F.sum("d").over(Window.partitionBy("neuron").orderBy("_part")) - F.col("d")  # a row for each range that a neuron lies in
    return parts.withColumn("most", F.col("top") + before).groupBy("neuron").agg(F.greatest(F.lit(1).cast("long"), F.max("most")).alias("most"))


def without_bursts(spikes: DataFrame, size: float, multiple: float = 5.0) -> DataFrame:
    """Spikes of the neurons whose max_events() is at most `multiple` times the median over neurons."""
    peaks = max_events(spikes, size)
    middle = medians(peaks, [], "most", "middle")
    kept = peaks.crossJoin(F.broadcast(middle)).where(F.col("most") <= multiple * F.col("middle")).select("neuron")  # one row
    return spikes.join(kept, "neuron", "left_semi")


def spike_windows(spikes: DataFrame, grid: Grid, cap: int | None = None) -> DataFrame:
    """(w, neuron, slot, value): value is the time since the window's start, slots count in time order, the first `cap` of them."""
    inside = grid.assign(spikes.select("neuron", "t"))
    slot = F.row_number().over(Window.partitionBy("w", "neuron").orderBy("t")) - 1
    found = inside.withColumn("slot", slot).withColumn("value", F.col("t") - grid.start(F.col("w")))
    return (found if cap is None else found.where(F.col("slot") < cap)).select("w", "neuron", "slot", "value")


def packed_spikes(windowed: DataFrame, slots: int, fill: float = -1.0) -> DataFrame:
    """(w, neuron, x): the values of spike_windows() as an array of `slots`, filled up."""
    listed = windowed.where(F.col("slot") < slots).groupBy("w", "neuron").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda s: s["value"]).alias("x"))
    return listed.select("w", "neuron", F.slice(F.concat("x", F.array_repeat(F.lit(fill), slots)), 1, slots).alias("x"))


def spike_coverage(spikes: DataFrame, grid: Grid) -> DataFrame:
    """(w): windows with a spike of any neuron."""
    return grid.assign(spikes.select("t")).select("w").distinct()


def binned_spikes(spikes: DataFrame, grid: Grid, bin_size: float, normalize: bool = True, neurons: DataFrame | None = None) -> DataFrame:
    """(w, neuron, bin, value) for every window, neuron and bin: counts, divided by bin_size if `normalize`.

    There are ceil(size / bin_size) bins of equal width, which is less than bin_size if that doesn't divide the size.
    """
    n = math.ceil(grid.size / bin_size)
    inside = grid.assign(spikes.select("neuron", "t"))
    at = F.floor((F.col("t") - grid.start(F.col("w"))) / grid.size * n).cast("int")
    counted = inside.withColumn("bin", F.greatest(F.lit(0), F.least(at, F.lit(n - 1)))).groupBy("w", "neuron", "bin").agg(F.count("*").alias("n"))
    names = neurons if neurons is not None else spikes.select("neuron").distinct()
    cells = each_window(names.select("neuron"), grid).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = F.coalesce("n", F.lit(0)).cast("double") / (bin_size if normalize else 1.0)
    return cells.join(counted, ["w", "neuron", "bin"], "left").select("w", "neuron", "bin", value.alias("value"))


# ---------------------------------------------------------------- continuous signals


def gaps(signal: DataFrame, bucket: float) -> DataFrame:
    """(channel, t, gap): seconds since the channel's sample before, null for its first; made in buckets of time."""
    b = F.floor(F.col("t") / bucket)
    rows = signal.select("channel", "t", b.alias("b"))
    ends = rows.groupBy("channel", "b").agg(F.max("t").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(Window.partitionBy("channel").orderBy("b"))).select("channel", "b", "before")
    lagged = rows.withColumn("prev", F.lag("t").over(Window.partitionBy("channel", "b").orderBy("t")))
    return lagged.join(before, ["channel", "b"]).select("channel", "t", (F.col("t") - F.coalesce("prev", "before")).alias("gap"))


def period(signal: DataFrame, bucket: float = 86_400.0, sample_rate: float | None = None) -> DataFrame:
    """(channel, period): the median gap between samples, or 1 / sample_rate; a warning if the first gap differs from that by over 5 %."""
    if sample_rate is None:
        return medians(gaps(signal, bucket), ["channel"], "gap", "period")
    first = [r["t"] for r in signal.select("t").distinct().orderBy("t").limit(2).collect()]
    if len(first) == 2 and abs((first[1] - first[0]) * sample_rate - 1) > 0.05:
        warnings.warn(f"the first gap is {first[1] - first[0]} s, not 1 / {sample_rate} s", stacklevel=2)
    return signal.select("channel").distinct().withColumn("period", F.lit(1 / sample_rate))


def slots_of(size: float, seconds: float, categorical: bool = False) -> int:
    return math.ceil(size / seconds) + (0 if categorical else 1)


def interpolated(signal: DataFrame, targets: DataFrame, bucket: float = 86_400.0) -> DataFrame:
    """targets (channel, t, ...) with `value`: linear between the samples around t, across any gap, and 0 outside of them.

    Samples and targets meet in buckets of time; the nearest samples beyond a bucket's ends come from a table with a
    row for each bucket. Of samples with one time, the last by value counts.
    """
    b = F.floor(F.col("t") / bucket)
    samples = signal.groupBy("channel", "t").agg(F.max("value").alias("value")).withColumn("b", b)
    ends = samples.groupBy("channel", "b").agg(F.max_by(F.struct("t", "value"), "t").alias("last"), F.min_by(F.struct("t", "value"), "t").alias("first"))
    wanted = targets.withColumn("b", b)
    all_b = wanted.select("channel", "b").distinct()
    ends = all_b.join(ends, ["channel", "b"], "full")
    along, back = (Window.partitionBy("channel").orderBy(o) for o in ("b", F.desc("b")))
    ends = ends.select("channel", "b", F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("in"), F.last("first", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("out"))
    own = F.struct("t", "value")
    others = [c for c in targets.columns if c not in ("channel", "t")]
    both = samples.select("channel", "b", "t", own.alias("s"), F.lit(None).cast(targets.select(F.struct(*others) if others else F.struct(F.lit(0).alias("_")) ).schema[0].dataType).alias("o"), F.lit(False).alias("target"))
    both = both.unionByName(wanted.select("channel", "b", "t", F.lit(None).cast(both.schema["s"].dataType).alias("s"), (F.struct(*others) if others else F.struct(F.lit(0).alias("_"))).alias("o"), F.lit(True).alias("target")))
    # Both frames grow from the partition's start, so that each row is added to them once.
    up, down = (Window.partitionBy("channel", "b").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in ("t", F.desc("t")))
    both = both.withColumns({"left": F.last("s", True).over(up), "right": F.last("s", True).over(down)})
    found = both.where("target").join(ends, ["channel", "b"], "left").select("channel", "t", *[F.col(f"o.`{c}`").alias(c) for c in others], F.coalesce("left", "in").alias("l"), F.coalesce("right", "out").alias("r"))
    slope = F.try_divide(F.col("r.value") - F.col("l.value"), F.col("r.t") - F.col("l.t"))
    value = F.when(F.col("l").isNull() | F.col("r").isNull(), 0.0).when(F.col("l.t") == F.col("t"), F.col("l.value")).otherwise(F.col("l.value") + slope * (F.col("t") - F.col("l.t")))
    return found.select("channel", "t", *others, value.alias("value"))


def signal_windows(signal: DataFrame, grid: Grid, seconds: float, channels: DataFrame | None = None, bucket: float = 86_400.0) -> DataFrame:
    """(w, channel, slot, value): each window resampled every `seconds` from its start on."""
    names = channels if channels is not None else signal.select("channel").distinct()
    targets = each_window(names.select("channel"), grid)
    targets = targets.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots_of(grid.size, seconds) - 1))))
    targets = targets.withColumn("t", grid.start(F.col("w")) + F.col("slot") * F.lit(float(seconds)))
    return interpolated(signal, targets, bucket).select("w", "channel", "slot", "value")


def covered(points: DataFrame, grid: Grid, slots: int, fraction: float = 0.2) -> DataFrame:
    """(w, n): windows with max(1, ceil(fraction * slots)) distinct times or more."""
    inside = grid.assign(points.select("t").distinct())
    return inside.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, math.ceil(fraction * slots)))


# ---------------------------------------------------------------- categorical states


def dense_codes(states: DataFrame, column: str = "category") -> DataFrame:
    """states with `column` replaced by its rank among the distinct values, from 0; joins a table of the values."""
    values = states.select(column).distinct()
    codes = values.withColumn("_code", (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))
    return states.join(codes, column).drop(column).withColumnRenamed("_code", column)


def majority(states: DataFrame, grid: Grid) -> DataFrame:
    """(w, channel, category): the most frequent code, of equally frequent ones the smallest."""
    counts = grid.assign(states).groupBy("w", "channel", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("w", "channel").agg(F.max_by("category", F.struct("n", -F.col("category"))).alias("category"))


def one_hot(column: Column, categories: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(categories - 1)), lambda k: (k == column).cast("double"))


def probabilities(states: DataFrame, grid: Grid) -> DataFrame:
    """(w, channel, category, p): shares of the codes that occur."""
    counts = grid.assign(states).groupBy("w", "channel", "category").agg(F.count("*").alias("n"))
    return counts.select("w", "channel", "category", (F.col("n") / F.sum("n").over(Window.partitionBy("w", "channel"))).alias("p"))


def trajectories(states: DataFrame, grid: Grid, categories: int, slots: int) -> DataFrame:
    """(w, channel, slot, category, column): codes in time order, up to `slots`; column = slot * categories + code is the hot one."""
    inside = grid.assign(states)
    placed = inside.withColumn("slot", F.row_number().over(Window.partitionBy("w", "channel").orderBy("t", "category")) - 1).where(F.col("slot") < slots)
    return placed.select("w", "channel", "slot", "category", (F.col("slot") * categories + F.col("category")).alias("column"))


def n_categories(states: DataFrame) -> DataFrame:
    return states.agg((F.max("category") + 1).alias("n_categories"))
