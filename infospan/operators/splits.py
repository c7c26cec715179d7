"""Reproducible splits and resamplings, by arithmetic on ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from infospan.functions.scalar import hash_bits, hash_normal, hash_order, seed_of
from infospan.operators.align import numbered
from infospan.sources.store import shuffle_parts


def ranked(df: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """df with its rank from 0 in a seeded pseudo-random order of the key."""
    mixed = df.withColumn("_h", hash_order(F.col(key), seed) * F.lit(4294967296) + F.pmod(F.col(key).cast("long"), F.lit(4294967296)))
    return numbered(mixed, "_h", name).drop("_h")


def random_split(df: DataFrame, key: str = "id", fraction: float = 0.9, seed: int = 0) -> DataFrame:
    """df with `role`: int(n * fraction) rows are `train`, the rest `test`."""
    n = df.count()
    return ranked(df, key, seed).withColumn("role", F.when(F.col("rank") < int(n * fraction), "train").otherwise("test")).drop("rank")


def test_starts(free: int, blocks: int, seed: int = 0) -> list[int]:
    """`blocks` different numbers below `free` in order, every choice of them alike likely.

    Numbers are added one by one: of a range that grows by one each time, a hashed place or, where that is taken, the newest.
    """
    chosen: set[int] = set()
    for newest in range(free - blocks, free):
        place = int(hashlib.md5(f"{seed}:{newest}".encode()).hexdigest()[:13], 16) % (newest + 1)
        chosen.add(newest if place in chosen else place)
    return sorted(chosen)


def test_blocks(spark: SparkSession, n: int, fraction: float = 0.9, blocks: int = 5, seed: int = 0, gap: float = 0.5) -> DataFrame:
    """(block, lo, hi, gap_lo, gap_hi): test rows lo..hi and, around them, the rows that train nothing.

    Blocks are drawn from all placements in which their starts lie at least a block and a row apart: with the blocks
    taken out, that is a choice of different places among the rest. The first blocks are longer by one where the test
    rows don't divide evenly. There are fewer blocks if there are fewer test rows.
    """
    n_test = int(n * (1 - fraction) + 1e-9)
    blocks = min(blocks, n_test)
    size, rest = divmod(n_test, blocks) if blocks else (0, 0)
    margin = int(round(gap * size))
    rows = []
    for b, start in enumerate(test_starts(n - blocks * size, blocks, seed)):
        lo = start + b * size
        hi = lo + size + (b < rest) - 1
        rows.append((b, lo, hi, lo - margin, hi + margin))
    return spark.createDataFrame(rows, "block int, lo long, hi long, gap_lo long, gap_hi long")


def blocked_split(df: DataFrame, index: str = "id", fraction: float = 0.9, blocks: int = 5, seed: int = 0, gap: float = 0.5, n: int | None = None) -> DataFrame:
    """df with `role`: test in a few blocks, gap beside them, train elsewhere; random if there is no room for the blocks."""
    n = df.count() if n is None else n
    n_test = int(n * (1 - fraction) + 1e-9)
    used = min(blocks, n_test)
    if used and n - used * (n_test // used) < used:
        return random_split(df, index, fraction, seed)
    listed = test_blocks(df.sparkSession, n, fraction, blocks, seed, gap).collect()  # a row for each block
    i, role = F.col(index), F.lit("train")
    for b in listed:
        role = F.when(i.between(b["gap_lo"], b["gap_hi"]), "gap").otherwise(role)
    for b in listed:
        role = F.when(i.between(b["lo"], b["hi"]), "test").otherwise(role)
    return df.withColumn("role", role)


def custom_split(df: DataFrame, train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    roles = train.select(key, F.lit("train").alias("role")).union(test.select(key, F.lit("test").alias("role")))
    return df.join(roles, key)


def evaluation_subset(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """The rows on which training information is reported: the same n in every epoch and run."""
    return ranked(df, key, seed).where(F.col("rank") < n).drop("rank")


def halves(channels: DataFrame, method: str = "random", seed: int = 0, first: list | None = None) -> DataFrame:
    """(channel, side): side 0 or 1 of each channel number; method `random`, `spatial` (first half) or `index` (those listed)."""
    names = channels.select("channel").distinct()
    if method == "index":
        return names.withColumn("side", F.when(F.col("channel").isin(list(first or [])), 0).otherwise(1))
    n = names.count()
    rank = ranked(names, "channel", seed) if method == "random" else numbered(names, "channel", "rank")
    return rank.withColumn("side", F.when(F.col("rank") < n // 2, 0).otherwise(1)).drop("rank")


#: Sides of a pixel (h, w) of an image of height H and width W; 1 is the second view.
PIXEL_SIDES = {
    "horizontal": "CAST(w >= W DIV 2 AS INT)",
    "vertical": "CAST(h >= H DIV 2 AS INT)",
    "col_interleaved": "w % 2",
    "row_interleaved": "h % 2",
    "diagonal": "CAST(h > w AS INT)",
    "antidiagonal": "CAST(h + w > W - 1 AS INT)",
}


def pixel_sides(pixels: DataFrame, method: str, height: int, width: int) -> DataFrame:
    """pixels (h, w, ...) with `side`."""
    rule = PIXEL_SIDES[method].replace("W", str(width)).replace("H", str(height))
    return pixels.withColumn("side", F.expr(rule).cast("int"))


def permuted(df: DataFrame, column: str, key: str = "id", seed: int = 0) -> DataFrame:
    """(key, column): the column's values dealt anew over the keys by a seeded order."""
    place = numbered(df.select(key), key, "rank")
    values = ranked(df.select(key, column), key, seed).select("rank", column)
    return place.join(values, "rank").select(key, column)


def permutations(df: DataFrame, key: str, trials: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    """df with (trial, rank) for every trial: ranks from 0 by a hash of (seed, trial, key), so each trial has an order of its own.

    A hash's leading bits deal a trial's rows to ranges of about equal size, as many as the session's shuffle
    partitions unless `parts` is given, which are ranked side by side.
    """
    parts = parts or shuffle_parts(df.sparkSession)
    tasks = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_h", hash_bits(seed, F.col("trial"), F.col(key)))
    dealt = tasks.withColumn("_part", F.floor(F.col("_h") / F.lit((1 << 52) // parts)).cast("int"))
    sizes = dealt.groupBy("trial", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("trial").orderBy("_part")) - F.col("_n")).drop("_n")  # `parts` rows a trial
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("trial", "_part").orderBy("_h", key)) - 1)
    return ranked.join(before, ["trial", "_part"]).withColumn("rank", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before", "_h")


def positions(method: str, n: int, seed: int = 0, split: int = 0, first: list[int] | None = None, shape: tuple[int, int] | None = None) -> tuple[list[int], list[int]]:
    """The entries of an array of n channels that go to the two sides.

    random, spatial (first half), index (those of `first`), or a rule of PIXEL_SIDES over an image of `shape` whose rows follow each other.
    """
    if method == "random":
        order = sorted(range(n), key=lambda k: (seed_of(seed, split, k), k))
        return order[: n // 2], order[n // 2 :]
    if method == "spatial":
        return list(range(n // 2)), list(range(n // 2, n))
    if method == "index":
        own = list(first or [])
        if not own or len(set(own)) != len(own) or not all(0 <= k < n for k in own) or len(own) == n:
            raise ValueError("indices are some of the channels, each once")
        return own, [k for k in range(n) if k not in set(own)]
    height, width = shape or (0, 0)
    if method not in PIXEL_SIDES or height * width != n:
        raise ValueError(f"{method} needs the shape (height, width) of {n} pixels")
    side = {
        "horizontal": lambda h, w: w >= width // 2, "vertical": lambda h, w: h >= height // 2, "col_interleaved": lambda h, w: w % 2,
        "row_interleaved": lambda h, w: h % 2, "diagonal": lambda h, w: h > w, "antidiagonal": lambda h, w: h + w > width - 1,
    }[method]
    sides = [bool(side(k // width, k % width)) for k in range(n)]
    return [k for k in range(n) if not sides[k]], [k for k in range(n) if sides[k]]


def gamma_chunks(df: DataFrame, key: str = "id", gammas: int = 10, seed: int = 0) -> DataFrame:
    """(gamma, chunk, key...): for each gamma, one seeded order cut into gamma parts of nearly equal size, the larger first."""
    n = df.count()
    rows = ranked(df, key, seed).withColumn("gamma", F.explode(F.sequence(F.lit(1), F.lit(gammas))))
    q, r = F.floor(F.lit(n) / F.col("gamma")), F.lit(n) % F.col("gamma")
    chunk = F.when(F.col("rank") < r * (q + 1), F.floor(F.col("rank") / (q + 1))).otherwise(r + F.floor((F.col("rank") - r * (q + 1)) / F.greatest(q, F.lit(1))))
    return rows.withColumn("chunk", chunk.cast("long")).drop("rank")


def fixed_noise(samples: DataFrame, levels: list[float], seed: int, units: str = "relative", key: str = "id", column: str = "x") -> DataFrame:
    """(sigma_add, key, column): at each level the same normal noise, scaled by the level and, if `relative`, the channel's deviation.

    The noise is a hash of (seed, id, channel), so no order or partitioning changes it.
    """
    cells = samples.select(key, F.posexplode(column).alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    sd = cells.groupBy("channel").agg(F.stddev_pop("v").alias("sd"))
    cells = cells.join(F.broadcast(sd), "channel")  # a row for each channel
    noise = hash_normal(seed, F.col(key), F.col("channel"))
    scale = F.col("sd") if units == "relative" else F.lit(1.0)
    cells = cells.withColumn("sigma_add", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("v", F.col("v") + F.col("sigma_add") * scale * noise)
    return cells.groupBy("sigma_add", key).agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "v"))), lambda s: s["v"]).alias(column))
