"""Synthetic streams with known dependence, made by seeded columns over ranges.

Series that depend on their own past use windows over blocks of `BLOCK` samples with a warm start, so no series is held by one
task; statistics agree with the continuous process after the warm start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from infospan.functions.scalar import NATS_IN_BIT

BLOCK = 100_000


def rho_of(bits: float, dim: int) -> float:
    return math.sqrt(1 - math.exp(-2.0 / dim * bits * NATS_IN_BIT))


def _arrays(n: int, seed: int, spread: float = 1.0) -> Column:
    return F.array(*[F.randn(seed + k) * spread for k in range(n)])


def correlated_gaussians(spark: SparkSession, n: int, dim: int, mi: float, seed: int = 0) -> DataFrame:
    """(id, x, y): `dim` Gaussian pairs that carry `mi` bits together."""
    rho = rho_of(mi, dim)
    base = spark.range(n).select("id", _arrays(dim, seed).alias("x"), _arrays(dim, seed + 1000).alias("e"))
    return base.select("id", "x", F.zip_with("x", "e", lambda a, e: rho * a + math.sqrt(1 - rho * rho) * e).alias("y"))


def _layer(x: Column, inputs: int, outputs: int, seed: int) -> Column:
    """A random linear layer and a softplus; weights come from the seed."""
    import random

    rng = random.Random(seed)
    rows = [[rng.gauss(0, 1 / math.sqrt(inputs)) for _ in range(inputs)] for _ in range(outputs)]
    unit = lambda w: sum((F.get(x, F.lit(k)) * v for k, v in enumerate(w)), F.lit(0.0))
    return F.array(*[F.log1p(F.exp(unit(w))) for w in rows])


def nonlinear_from_latent(spark: SparkSession, n: int, latent: int, observed: int, mi: float, hidden: int = 8, seed: int = 0) -> DataFrame:
    """(id, x, y, latent_x, latent_y): correlated latents seen through two random networks."""
    z = correlated_gaussians(spark, n, latent, mi, seed).withColumnsRenamed({"x": "latent_x", "y": "latent_y"})
    h = z.withColumns({"hx": _layer(F.col("latent_x"), latent, hidden, seed + 1), "hy": _layer(F.col("latent_y"), latent, hidden, seed + 2)})
    return h.select("id", _layer(F.col("hx"), hidden, observed, seed + 3).alias("x"), _layer(F.col("hy"), hidden, observed, seed + 4).alias("y"), "latent_x", "latent_y")


def _moving_mean(noise: DataFrame, column: str, width: int) -> DataFrame:
    """noise (idx, ...) with `m`: the mean of the `width` values up to idx. Each value goes to the block of its index and, near a block's end, to the next."""
    b = F.floor(F.col("idx") / BLOCK)
    near = F.when(F.col("idx") % BLOCK >= BLOCK - width, F.array(b, b + 1)).otherwise(F.array(b))
    dealt = noise.withColumn("_b", F.explode(near))
    mean = F.avg(column).over(Window.partitionBy("_b").orderBy("idx").rowsBetween(-(width - 1), 0))
    return dealt.withColumn("m", mean).where(F.floor(F.col("idx") / BLOCK) == F.col("_b")).drop("_b")


def _autoregressive(noise: DataFrame, column: str, timescale: float) -> DataFrame:
    """noise (idx, ...) with `m`: a process of unit variance that keeps exp(-1 / timescale) of itself each step.

    A sample is the weighted sum of the noise of its last 8 timescales, whose weights fall to exp(-8) of the first.
    """
    keep = math.exp(-1 / timescale)
    width = math.ceil(8 * timescale)
    b = F.floor(F.col("idx") / BLOCK)
    near = F.when(F.col("idx") % BLOCK >= BLOCK - width, F.array(b, b + 1)).otherwise(F.array(b))
    dealt = noise.withColumn("_b", F.explode(near))
    last = F.collect_list(column).over(Window.partitionBy("_b").orderBy("idx").rowsBetween(-(width - 1), 0))
    m = F.aggregate(last, F.lit(0.0), lambda total, v: total * keep + v) * math.sqrt(1 - keep * keep)
    return dealt.withColumn("m", m).where(F.floor(F.col("idx") / BLOCK) == F.col("_b")).drop("_b")


def _behind(df: DataFrame, column: str, lag: int, name: str) -> DataFrame:
    """df with the value of `column` at idx - lag, 0 before the start."""
    old = df.select((F.col("idx") + lag).alias("idx"), F.col(column).alias(name))
    return df.join(old, "idx", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _noise(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.randn(seed).alias("e"), F.randn(seed + 1).alias("e2"))


def convolved(spark: SparkSession, n: int, lag: int = 30, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(idx, x, y): a slow walk and the walk `lag` samples ahead with noise; steps are summed by blocks, then within them."""
    rows = _noise(spark, n + lag, seed).withColumn("b", F.floor(F.col("idx") / BLOCK))
    sums = rows.groupBy("b").agg(F.sum("e").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.orderBy("b")) - F.col("s")).drop("s")  # a row for each block
    walk = rows.join(before, "b").withColumn("x", F.col("before") + F.sum("e").over(Window.partitionBy("b").orderBy("idx"))).select("idx", "x", "e2")
    moments = walk.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = walk.crossJoin(F.broadcast(moments)).select("idx", ((F.col("x") - F.col("m")) / F.col("s")).alias("x"), "e2")
    ahead = z.select((F.col("idx") - lag).alias("idx"), F.col("x").alias("ahead"))
    return z.join(ahead, "idx").select("idx", "x", (F.col("ahead") + noise * F.col("e2")).alias("y"))


def xor(spark: SparkSession, n: int, noise: float = 0.1, seed: int = 0) -> DataFrame:
    bits = spark.range(n).select("id", (F.rand(seed) < 0.5).cast("int").alias("a"), (F.rand(seed + 1) < 0.5).cast("int").alias("b"), F.randn(seed + 2).alias("e"))
    return bits.select("id", F.array(F.col("a").cast("double"), F.col("b").cast("double")).alias("x"), F.array(F.col("a").bitwiseXOR(F.col("b")) + noise * F.col("e")).alias("y"))


def _poisson(spark: SparkSession, neurons: int, duration: float, rate: float, seed: int) -> DataFrame:
    """(neuron, t): the number of spikes in a second is Poisson, by the gaps of a unit process, and places are uniform."""
    seconds = spark.range(int(math.ceil(duration))).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(neurons - 1))).alias("neuron"))
    most = int(rate + 10 * math.sqrt(rate) + 20)
    arrivals = seconds.select("s", "neuron", F.explode(F.expr(f"transform(sequence(1, {most}), k -> k)")).alias("k"))
    gap = -F.log(1 - F.rand(seed)) / rate
    at = F.sum("gap").over(Window.partitionBy("s", "neuron").orderBy("k"))
    return arrivals.withColumn("gap", gap).withColumn("at", at).where(F.col("at") < 1).select("neuron", (F.col("s") + F.col("at")).alias("t")).where(F.col("t") < duration)


def correlated_spikes(spark: SparkSession, neurons: int, duration: float, rate: float = 5.0, delay: float = 0.02, jitter: float = 0.005, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Poisson trains, and the same delayed and jittered."""
    x = _poisson(spark, neurons, duration, rate, seed)
    return x, x.withColumn("t", F.col("t") + delay + jitter * F.randn(seed + 9)).where((F.col("t") > 0) & (F.col("t") < duration))


def categorical_series(spark: SparkSession, n: int, channels: int = 1, categories: int = 3, transition: float = 0.8, seed: int = 0, stay: float = 0.95) -> DataFrame:
    """(t, channel, x, y): a chain that is redrawn with probability 1 - stay; y copies x with probability `transition`."""
    rows = spark.range(n).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    rows = rows.withColumn("b", F.floor(F.col("t") / BLOCK)).withColumns({"new": F.floor(F.rand(seed) * categories).cast("int"), "other": F.floor(F.rand(seed + 1) * categories).cast("int"), "copy": F.rand(seed + 2) < transition})
    drawn = F.when((F.col("t") % BLOCK == 0) | (F.rand(seed + 3) > stay), F.col("new"))
    x = F.last("drawn", True).over(Window.partitionBy("channel", "b").orderBy("t"))
    return rows.withColumn("drawn", drawn).withColumn("x", x).select("t", "channel", "x", F.when(F.col("copy"), F.col("x")).otherwise(F.col("other")).alias("y"))


def event_related(spark: SparkSession, n: int, lag: int = 20, events: int = 50, length: int = 30, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(idx, x, y): impulses, and half a sine that follows each `lag` later."""
    at = spark.range(events).select(F.floor(F.rand(seed) * (n - lag - length)).cast("long").alias("idx"))
    impulses = at.groupBy("idx").agg(F.lit(1.0).alias("x"))
    shape = at.select("idx", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")).select((F.col("idx") + lag + F.col("k")).alias("idx"), F.sin(math.pi * F.col("k") / length).alias("r"))
    response = shape.groupBy("idx").agg(F.sum("r").alias("r"))
    rows = _noise(spark, n, seed + 1).join(impulses, "idx", "left").join(response, "idx", "left")
    return rows.select("idx", F.coalesce("x", F.lit(0.0)).alias("x"), (F.coalesce("r", F.lit(0.0)) + noise * F.col("e")).alias("y"))


def linear(spark: SparkSession, n: int, lag: int = 10, noise: float = 0.1, seed: int = 0, power: int = 1, width: int = 5) -> DataFrame:
    """(idx, x, y): box-smoothed noise, and its copy (or power) `lag` later."""
    x = _moving_mean(_noise(spark, n, seed), "e", width).select("idx", F.col("m").alias("x"), "e2")
    return _behind(x, "x", lag, "old").select("idx", "x", (F.pow("old", F.lit(power)) + noise * F.col("e2")).alias("y"))


def nonlinear(spark: SparkSession, n: int, lag: int = 10, noise: float = 0.1, seed: int = 0) -> DataFrame:
    return linear(spark, n, lag, noise, seed, power=2)


def history(spark: SparkSession, n: int, duration: int = 20, noise: float = 0.1, seed: int = 0, lag: int = 0) -> DataFrame:
    """(idx, x, y): noise, and tanh of twice its mean over the last `duration` samples, `lag` later."""
    m = _moving_mean(_noise(spark, n, seed), "e", duration).select("idx", F.col("e").alias("x"), F.col("m"), "e2")
    return _behind(m, "m", lag, "old").select("idx", "x", (F.tanh(2 * F.col("old")) + noise * F.col("e2")).alias("y"))


def full(spark: SparkSession, n: int, lag: int = 10, duration: int = 20, noise: float = 0.1, seed: int = 0) -> DataFrame:
    return history(spark, n, duration, noise, seed, lag)


def windowed_dependency(spark: SparkSession, n: int, channels: int = 1, timescale: float = 20.0, window: int = 50, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(idx, channel, x, y): the sum of two autoregressive processes with the time constants `timescale` and a quarter of it, and its causal mean over `window`."""
    found = None
    for c in range(channels):
        base = _noise(spark, n, seed + 10 * c)
        fast = _autoregressive(base, "e", timescale / 4).withColumnRenamed("m", "fast")
        slow = _autoregressive(fast.withColumn("e3", F.randn(seed + 10 * c + 5)), "e3", timescale).withColumn("x", F.col("fast") + F.col("m")).select("idx", "x", "e2")
        part = _moving_mean(slow, "x", window).select("idx", F.lit(c).alias("channel"), "x", (F.col("m") + noise * F.col("e2")).alias("y"))
        found = part if found is None else found.union(part)
    return found


def modulated_spikes(spark: SparkSession, neurons: int, duration: float, rate: float = 10.0, depth: float = 0.8, frequency: float = 1.0, neurons_y: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two groups of trains whose rates follow one sine, by thinning of faster trains."""
    top = rate * (1 + depth)
    keep = (1 + depth * F.sin(2 * math.pi * frequency * F.col("t"))) / (1 + depth)
    made = [_poisson(spark, k, duration, top, s).where(F.rand(s + 1) < keep) for k, s in ((neurons, seed), (neurons_y or neurons, seed + 50))]
    return made[0], made[1]


def timing_code(spark: SparkSession, neurons: int, duration: float, signal: float = 2.0, background: float = 8.0, delay: float = 0.02, jitter: float = 0.002, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Shared spikes, delayed in y, each among independent background spikes."""
    x, y = correlated_spikes(spark, neurons, duration, signal, delay, jitter, seed)
    return x.union(_poisson(spark, neurons, duration, background, seed + 20)), y.union(_poisson(spark, neurons, duration, background, seed + 40))


def oscillatory(spark: SparkSession, windows: int, channels: int = 1, size: int = 64, hertz: list[float] | None = None, rate: float = 256.0, latent_mi: float = 1.0, snr: float = 4.0, distractor: float = 0.0, seed: int = 0) -> DataFrame:
    """(w, channel, x, y): latents that share `latent_mi` bits a channel as amplitudes of carriers, with noise of deviation 1 / snr and, if asked, a second independent carrier."""
    rho, hertz = rho_of(latent_mi, 1), hertz or [20.0] * channels
    rows = spark.range(windows).select(F.col("id").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    rows = rows.withColumns({"a": F.randn(seed), "e": F.randn(seed + 1), "d1": F.randn(seed + 2), "d2": F.randn(seed + 3), "hz": F.get(F.array(*map(F.lit, hertz)), F.col("channel"))})
    rows = rows.withColumn("b", rho * F.col("a") + math.sqrt(1 - rho * rho) * F.col("e")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    wave = F.sin(2 * math.pi * F.col("hz") * F.col("k") / rate)
    other = distractor * F.sin(2 * math.pi * 1.7 * F.col("hz") * F.col("k") / rate)
    rows = rows.withColumns({"vx": F.col("a") * wave + F.col("d1") * other + F.randn(seed + 4) / snr, "vy": F.col("b") * wave + F.col("d2") * other + F.randn(seed + 5) / snr})
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda s: s[c])
    return rows.groupBy("w", "channel").agg(pick("vx").alias("x"), pick("vy").alias("y"))


def oscillatory_mi(channels: int = 1, size: int = 64, hertz: list[float] | None = None, rate: float = 256.0, latent_mi: float = 1.0, snr: float = 4.0) -> float:
    """Bits that x and y of oscillatory() share, without a second carrier: a channel's amplitudes are seen through its carrier's energy and the noise."""
    total = 0.0
    for hz in hertz or [20.0] * channels:
        energy = sum(math.sin(2 * math.pi * hz * k / rate) ** 2 for k in range(size))
        rho = min(rho_of(latent_mi, 1) * energy / (energy + 1 / snr**2), 1 - 1e-8)
        total -= 0.5 * math.log2(1 - rho * rho)
    return total


def bandpower_interference(spark: SparkSession, windows: int, **options) -> DataFrame:
    return oscillatory(spark, windows, distractor=options.pop("distractor", 1.0), **options)


def multichannel(spark: SparkSession, windows: int, channels: int = 4, low: float = 10.0, high: float = 40.0, **options) -> DataFrame:
    """One carrier a channel between two frequencies; the channels' information adds up."""
    step = (high - low) / max(1, channels - 1)
    return oscillatory(spark, windows, channels, hertz=[low + k * step for k in range(channels)], **options)
