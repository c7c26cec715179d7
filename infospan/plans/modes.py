"""Analyses as plans over tables, with the Gaussian critic, whose information follows from correlations.

Each analysis lays all its tasks (lags, parameter values, chunks, pairs, permutations) into one table and estimates
them in one aggregation. With `critics.learned()` a task's rows go to a trained critic instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infospan.functions import contours, gram, regression
from infospan.functions.scalar import hash_uniform, rounded
from infospan.operators import align, correlate, splits
from infospan.operators import windows as W

#: Squared correlations are held below this, as no finite sample shows more.
MOST = 1 - 1e-12


def gaussian_mi(rho: Column) -> Column:
    """Bits; 0 where the correlation is undefined."""
    r2 = F.least(F.coalesce(rho * rho, F.lit(0.0)), F.lit(MOST))
    return -0.5 * F.log2(1 - F.when(F.isnan(r2), 0.0).otherwise(r2))


def corr(x: str, y: str) -> Column:
    """Pearson's correlation of rows with both; null where one of them is constant, which F.corr takes for an error in ANSI mode."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def estimate(pairs: DataFrame, keys: list[str] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, n, mi) of scalar columns x and y."""
    return pairs.groupBy(*(keys or [])).agg(F.count("*").alias("n"), gaussian_mi(corr(x, y)).alias("mi"))


def estimate_arrays(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, mi): the sum over dimensions of array columns x and y, taken as independent pairs."""
    keys = keys or []
    cells = samples.select(*keys, F.posexplode(F.arrays_zip("x", "y")).alias("k", "p")).select(*keys, "k", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    return estimate(cells, [*keys, "k"]).groupBy(*keys).agg(F.sum("mi").alias("mi"))


def joint_arrays(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mi) of array columns x and y taken as jointly Gaussian: half the log ratio of the determinants of their correlations.

    Tasks sum the products of their rows; a key's matrix has dimensions, not samples.
    """
    summed = gram.sums(samples, keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for r in part.to_dict("records"):
                n, dx, _, m = gram.unpacked(r)
                sd = np.sqrt(np.maximum(m.diagonal(), 1e-300))
                m = m / np.outer(sd, sd)
                logdet = lambda a: np.log2(np.maximum(np.linalg.eigvalsh(a), 1 - MOST)).sum()
                mi = 0.5 * (logdet(m[:dx, :dx]) + logdet(m[dx:, dx:]) - logdet(m))
                found.append({k: r[k] for k in keys} | {"n": n, "mi": max(0.0, mi)})
            yield pd.DataFrame(found, columns=[*keys, "n", "mi"])

    schema = "".join(f"`{k}` {summed.schema[k].dataType.simpleString()}, " for k in keys)
    return summed.mapInPandas(run, f"{schema}n long, mi double")


def lag_curve(x: DataFrame, y: DataFrame, lags: list[int], equalize: bool = False) -> DataFrame:
    """(lag, n, mi) of series (idx, x) and (idx, y); equalize: all lags use the indices that all of them have."""
    return estimate(lag_pairs(x, y, lags, equalize), ["lag"])


def lag_pairs(x: DataFrame, y: DataFrame, lags: list[int], equalize: bool = False) -> DataFrame:
    pairs = align.all_lags(x, y, lags)
    if equalize:
        full = pairs.groupBy("idx").agg(F.count("*").alias("c")).where(F.col("c") == len(lags))
        pairs = pairs.join(full.select("idx"), "idx", "left_semi")
    return pairs


def sweep(pairs: DataFrame, values: dict[str, list], prepare=None, repeats: int = 1, fraction: float = 1.0, seed: int = 0, by: Callable[[DataFrame, list[str]], DataFrame] | None = None, keys: list[str] | None = None, key: str = "id") -> DataFrame:
    """(keys, names..., run_id, n, mi) for each combination of values; `prepare(pairs)` reads the combination's columns and returns x and y.

    repeats: runs on seeded subsamples of `fraction` of the rows. by: the estimate of a table by keys, estimate() if none. keys: tasks that pairs have already.
    """
    keys = keys or []
    tasks = sweep_tasks(pairs, values, repeats, fraction, seed, key)
    return (by or estimate)(prepare(tasks) if prepare else tasks, [*keys, *values, "run_id"])


def sweep_tasks(pairs: DataFrame, values: dict[str, list], repeats: int = 1, fraction: float = 1.0, seed: int = 0, key: str = "id") -> DataFrame:
    """pairs once for each combination of values and run."""
    grid = align.parameter_grid(pairs.sparkSession, values | {"run_id": list(range(repeats))}).drop("task")
    tasks = pairs.crossJoin(F.broadcast(grid))  # the grid is given by parameters
    if fraction < 1:
        tasks = tasks.where(F.pmod(F.xxhash64(key, "run_id", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))
    return tasks


def summary(runs: DataFrame, keys: list[str], value: str = "mi", population: bool = False) -> DataFrame:
    """(keys, mi_mean, mi_std, n_runs): over runs that didn't fail; a single run's deviation is 0."""
    ok = runs.where(F.col(value).isNotNull() & ~F.isnan(value))
    sd = F.stddev_pop(value) if population else F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return ok.groupBy(*keys).agg(F.avg(value).alias("mi_mean"), sd.alias("mi_std"), F.count("*").alias("n_runs"))


def rigorous(pairs: DataFrame, key: str = "id", gammas: int = 10, seed: int = 0, **options) -> DataFrame:
    """The bias-corrected estimate: all chunks of all gammas at once, then the line to gamma 0."""
    runs = rigorous_runs(pairs, key, gammas, seed)
    return regression.extrapolated(runs, **options)


def rigorous_runs(pairs: DataFrame, key: str = "id", gammas: int = 10, seed: int = 0) -> DataFrame:
    chunks = splits.gamma_chunks(pairs, key, gammas, seed)
    return estimate(chunks, ["gamma", "chunk"]).select("gamma", "chunk", "n", F.col("mi").alias("train_mi"))


def precision_curve(pairs: DataFrame, taus: list[float], target: str = "x") -> DataFrame:
    """(tau, n, mi) with x, y or both rounded to multiples of each tau, and tau 0."""
    listed = sorted({0.0, *map(float, taus)})
    rows = pairs.withColumn("tau", F.explode(F.array(*map(F.lit, listed))))
    return estimate(rows.withColumns({c: rounded(F.col(c), F.col("tau")) for c in ("x", "y") if target in (c, "both")}), ["tau"])


def noise_curve(pairs: DataFrame, taus: list[float], samples: int = 10, target: str = "x", seed: int = 0, key: str = "id") -> DataFrame:
    """(tau, mi, mi_std, n_runs) with noise over (-tau/2, tau/2) added to x, y or both: mean and population deviation over `samples` draws, one at tau 0."""
    listed = sorted({0.0, *map(float, taus)})
    draws = F.flatten(F.array(*[F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(k).alias("draw")) for k in range(samples if t > 0 else 1)]) for t in listed]))
    rows = pairs.withColumn("_d", F.explode(draws)).withColumns({"tau": F.col("_d.tau"), "draw": F.col("_d.draw")}).drop("_d")
    moved = {c: F.col(c) + F.col("tau") * (hash_uniform(seed, c, F.col("draw"), F.col(key)) - 0.5) for c in ("x", "y") if target in (c, "both")}
    return summary(estimate(rows.withColumns(moved), ["tau", "draw"]), ["tau"], population=True).withColumnRenamed("mi_mean", "mi")


def joint_gaussian(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, mi_xz_y, mi_z_y, cmi) of scalar columns x, y, z: I(XZ;Y), I(Z;Y) and their difference."""
    r = pairs.groupBy(*(keys or [])).agg(F.count("*").alias("n"), corr("x", "y").alias("xy"), corr("z", "y").alias("zy"), corr("x", "z").alias("xz"))
    r2 = F.try_divide(F.col("xy") * F.col("xy") + F.col("zy") * F.col("zy") - 2 * F.col("xy") * F.col("zy") * F.col("xz"), 1 - F.col("xz") * F.col("xz"))
    both, alone = gaussian_mi(F.sqrt(F.greatest(F.coalesce(r2, F.col("zy") * F.col("zy")), F.lit(0.0)))), gaussian_mi(F.col("zy"))
    return r.select(*(keys or []), "n", both.alias("mi_xz_y"), alone.alias("mi_z_y"), (both - alone).alias("cmi"))


def conditional_arrays(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, mi_xz_y, mi_z_y, cmi) of array columns x, y, z, taken as jointly Gaussian."""
    keys = keys or []
    terms = [F.struct(F.lit(joint).alias("_joint"), (F.concat("x", "z") if joint else F.col("z")).alias("x"), F.col("y")) for joint in (True, False)]
    found = joint_arrays(samples.select(*keys, F.explode(F.array(*terms)).alias("_r")).select(*keys, "_r.*"), [*keys, "_joint"])
    both = found.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(F.col("_joint"), F.col("mi"))).alias("mi_xz_y"), F.max(F.when(~F.col("_joint"), F.col("mi"))).alias("mi_z_y"))
    return both.withColumn("cmi", F.col("mi_xz_y") - F.col("mi_z_y"))


def conditional_by(samples: DataFrame, keys: list[str], by: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """(keys, mi_xz_y, mi_z_y, cmi) of array columns x, y, z: the estimates `by` of I(XZ;Y) and I(Z;Y), both terms tasks of one table."""
    terms = [F.struct(F.lit(joint).alias("_joint"), (F.concat("x", "z") if joint else F.col("z")).alias("x"), F.col("y")) for joint in (True, False)]
    found = by(samples.select(*keys, "id", F.explode(F.array(*terms)).alias("_r")).select(*keys, "id", "_r.*"), [*keys, "_joint"])
    both = found.groupBy(*keys).agg(F.max(F.when(F.col("_joint"), F.col("mi"))).alias("mi_xz_y"), F.max(F.when(~F.col("_joint"), F.col("mi"))).alias("mi_z_y"))
    return both.withColumn("cmi", F.col("mi_xz_y") - F.col("mi_z_y"))


def rigorous_conditional_runs(samples: DataFrame, key: str = "id", gammas: int = 10, seed: int = 0) -> DataFrame:
    """(gamma, chunk, n, train_mi): I(X;Y|Z) of every chunk, numbers or arrays."""
    by = conditional_arrays if samples.schema["x"].dataType.typeName() == "array" else joint_gaussian
    return by(splits.gamma_chunks(samples, key, gammas, seed), ["gamma", "chunk"]).select("gamma", "chunk", "n", F.col("cmi").alias("train_mi"))


def rigorous_transfer_runs(series: DataFrame, horizon: int = 1, index: str = "idx", gammas: int = 10, seed: int = 0) -> DataFrame:
    """(way, gamma, chunk, n, train_mi): the transfer both ways in every chunk of the pairs of now and then."""
    chunks = splits.gamma_chunks(_ahead(series, horizon, index), index, gammas, seed)
    return joint_gaussian(_both_ways(chunks, ["gamma", "chunk"]), ["way", "gamma", "chunk"]).select("way", "gamma", "chunk", "n", F.col("cmi").alias("train_mi"))


def rigorous_scalar(runs: DataFrame, keys: list[str] | None = None, delta: float = 0.1, least: int = 5, **options) -> DataFrame:
    """regression.extrapolated(); where fewer than `least` gammas stay in the linear region, the line is through all of them."""
    keys = keys or []
    pruned = regression.extrapolated(runs, keys, delta, least, **options)
    every = regression.extrapolated(runs, keys, float("inf"), least, **options)
    short = pruned.where(F.col("n_gammas") < least).select(*keys, F.lit(True).alias("_short"))
    if keys:
        kept, again = pruned.where(F.col("n_gammas") >= least), every.join(short.drop("_short"), keys, "left_semi")
    else:
        kept, again = pruned.where(F.col("n_gammas") >= least), every.crossJoin(F.broadcast(short)).drop("_short")  # one row each
    return kept.withColumn("all_gammas", F.lit(False)).unionByName(again.withColumn("all_gammas", F.lit(True)))


def conditional(x: DataFrame, y: DataFrame, z: DataFrame, key: str = "id") -> DataFrame:
    """I(X;Y|Z) of three tables (id, x), (id, y), (id, z)."""
    return joint_gaussian(x.join(y, key).join(z, key))


def _ahead(series: DataFrame, horizon: int, index: str) -> DataFrame:
    return series.join(series.select((F.col(index) - horizon).alias(index), F.col("x").alias("fx"), F.col("y").alias("fy")), index)


def _both_ways(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    way = lambda name, x, y, z: F.struct(F.lit(name).alias("way"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    return rows.select(*(keys or []), F.explode(F.array(way("xy", "x", "fy", "y"), way("yx", "y", "fx", "x"))).alias("r")).select(*(keys or []), "r.*")


def transfer(series: DataFrame, horizon: int = 1, index: str = "idx") -> DataFrame:
    """(te_xy, te_yx, directionality) of a table (idx, x, y): what one's past tells of the other's future beyond its own past."""
    te = joint_gaussian(_both_ways(_ahead(series, horizon, index)), ["way"]).agg(F.max(F.when(F.col("way") == "xy", F.col("cmi"))).alias("te_xy"), F.max(F.when(F.col("way") == "yx", F.col("cmi"))).alias("te_yx"))
    size = F.abs("te_xy") + F.abs("te_yx")
    return te.select("te_xy", "te_yx", F.when(size <= 1e-10, 0.0).otherwise((F.col("te_xy") - F.col("te_yx")) / F.nullif(size, F.lit(0.0))).alias("directionality"))


def transfer_histories(series: DataFrame, history: int, horizon: int = 1, index: str = "idx") -> DataFrame:
    """transfer() with the past `history` values and the `horizon` values after them, of a series without holes in its index.

    Both ways and both terms are keys of one table, so the histories are built and the correlations summed once.
    """
    h = {c: align.histories(series, history, horizon, index, c).select("idx", F.col("past").alias(f"{c}_past"), F.col("future").alias(f"{c}_future")) for c in ("x", "y")}
    rows = h["x"].join(h["y"], "idx")
    terms = [F.struct(F.lit(f"{a}{b}").alias("way"), F.lit(both).alias("joint"), (F.concat(f"{b}_past", f"{a}_past") if both else F.col(f"{b}_past")).alias("x"), F.col(f"{b}_future").alias("y")) for a, b in (("x", "y"), ("y", "x")) for both in (True, False)]
    found = joint_arrays(rows.select(F.explode(F.array(*terms)).alias("r")).select("r.*"), ["way", "joint"])
    te = lambda way: F.sum(F.when(F.col("way") == way, F.when(F.col("joint"), F.col("mi")).otherwise(-F.col("mi")))).alias(f"te_{way}")
    size = F.abs("te_xy") + F.abs("te_yx")
    return found.agg(te("xy"), te("yx")).select("te_xy", "te_yx", F.when(size <= 1e-10, 0.0).otherwise((F.col("te_xy") - F.col("te_yx")) / F.nullif(size, F.lit(0.0))).alias("directionality"))


#: Pairs of columns that are aggregates of one plan; more are rows.
PAIRS_IN_PLAN = 500


def pairwise(table: DataFrame, columns: list[str], others: list[str] | None = None, pairs: list[tuple[str, str]] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, a, b, mi) of unordered pairs of columns, of all of columns x others, or of those listed; one pass over the table."""
    listed = pairs or (list(combinations(columns, 2)) if others is None else [(a, b) for a in columns for b in others])
    if keys or len(listed) > PAIRS_IN_PLAN:
        keys, names = keys or [], sorted({c for pair in listed for c in pair})
        at = {c: k + 1 for k, c in enumerate(names)}
        wide = table.select(*keys, F.array(*[F.col(c).cast("double") for c in names]).alias("v"))
        places = table.sparkSession.createDataFrame([(a, b, at[a], at[b]) for a, b in listed], "a string, b string, i int, j int")
        cells = wide.crossJoin(F.broadcast(places)).select(*keys, "a", "b", F.expr("v[i - 1]").alias("x"), F.expr("v[j - 1]").alias("y"))  # pairs are parameters; sums combine before the shuffle
        return estimate(cells, [*keys, "a", "b"]).drop("n")
    one = table.agg(*[corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(listed)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("rho")) for k, (a, b) in enumerate(listed)])
    return one.select(F.explode(rows).alias("x")).select("x.a", "x.b", gaussian_mi(F.col("x.rho")).alias("mi"))


def pairwise_samples(table: DataFrame, columns: list[str], others: list[str] | None = None, pairs: list[tuple[str, str]] | None = None, keys: list[str] | None = None, key: str = "id") -> DataFrame:
    """(keys, a, b, id, x array, y array): the samples of every pair of columns, numbers or arrays, for a critic by pairs."""
    listed = pairs or (list(combinations(columns, 2)) if others is None else [(a, b) for a in columns for b in others])
    cell = lambda c: F.col(c).cast("array<double>") if table.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("double"))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a).alias("x"), cell(b).alias("y")) for a, b in listed])
    return table.select(*(keys or []), F.col(key).alias("id"), F.explode(rows).alias("r")).select(*(keys or []), "id", "r.*")


def matrix(found: DataFrame, names: list[str]) -> DataFrame:
    """The symmetric matrix of pairwise(): a row for each name, zeros on the diagonal."""
    both = found.select("a", "b", "mi").union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "mi"))
    diagonal = found.sparkSession.createDataFrame([(n, n, 0.0) for n in names], both.schema)
    return both.union(diagonal).groupBy("a").pivot("b", names).agg(F.first("mi"))


def permutation_null(pairs: DataFrame, trials: int, key: str = "id", seed: int = 0) -> DataFrame:
    """(trial, n, mi) with y dealt anew in each trial by an order of its own, negative values cut to 0 by the estimator itself."""
    return permuted_runs(pairs, trials, estimate, key, seed)


def permuted_runs(pairs: DataFrame, trials: int, by: Callable[[DataFrame, list[str]], DataFrame], key: str = "id", seed: int = 0, column: str = "y") -> DataFrame:
    """`by(table, ["trial"])` of pairs whose `column` is permuted in each trial; the other columns stay together."""
    moved = splits.permutations(pairs.select(key, column), key, trials, seed).select("trial", "rank", column)
    fixed = align.numbered(pairs.drop(column), key, "rank")
    return by(fixed.join(moved, "rank"), ["trial"])


def noise_ladder(runs: DataFrame, margin: float = 0.75, collapse: float = 0.05) -> DataFrame:
    """(sigma_add, mi_mean, mi_std, ceiling, regime) of runs (sigma_add, test_mi, eval_size), in nats."""
    per = runs.groupBy("sigma_add").agg(F.avg("test_mi").alias("mi_mean"), F.coalesce(F.stddev_samp("test_mi"), F.lit(0.0)).alias("mi_std"), F.log(F.avg("eval_size")).alias("ceiling"))
    return per.withColumn("regime", regime(F.col("mi_mean"), F.col("ceiling"), margin, collapse))


def regime(mi: Column, ceiling: Column, margin: float = 0.75, collapse: float = 0.05) -> Column:
    bad = mi.isNull() | F.isnan(mi) | (F.abs(mi) == float("inf"))
    return F.when(~bad & (mi >= ceiling - margin), "pinned").when(bad | (mi <= collapse * ceiling), "collapsed").otherwise("detached")


def dimensionality_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, <metric>_mean, <metric>_std, n_runs) of the columns pr_eig and pr_singular that runs have, and mi as mi_mean; a single run's deviation is 0."""
    found = [c for c in ("mi", "pr_eig", "pr_singular") if c in runs.columns]
    means = [m for c in found for m in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    return runs.groupBy(*keys).agg(*means, F.count("*").alias("n_runs"))


def suggested_level(ladder: DataFrame) -> DataFrame:
    """(level): the geometric middle of the detached levels."""
    levels = ladder.where(F.col("regime") == "detached")
    return levels.agg(F.sqrt(F.min("sigma_add") * F.max("sigma_add")).alias("level"))


def causal_contour(heat: DataFrame) -> DataFrame:
    """(window, mi) of a table (window, lag, mi): the first window at lag 0 whose information is over a tenth of the way from floor to peak.

    The floor is the median over the three smallest windows.
    """
    zero = heat.where(F.col("lag") == 0).select("window", "mi")
    first = zero.orderBy("window").limit(3).agg(F.median("mi").alias("floor"))
    level = zero.agg(F.max("mi").alias("peak")).crossJoin(first)  # one row each
    above = zero.crossJoin(F.broadcast(level)).where(F.col("mi") > F.col("floor") + 0.1 * (F.col("peak") - F.col("floor")))
    return above.orderBy("window").limit(1).select("window", "mi")


def significant_contour(heat: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(lag, window): the points of the longest line along which the information of (window, lag, mi) passes the threshold."""
    return contours.longest_line(contours.contour_lines(heat, threshold)).select("lag", "window")


def windowed_pairs(series: DataFrame, sizes: list[int], lags: list[int]) -> DataFrame:
    """(window, lag, idx, x, y): the mean of x over each whole window of `window` steps from idx on, and that of y over the window `lag` later.

    series (idx, x, y) has a row a step; windows start at every step, and one with missing steps is the mean of the others.
    """
    low, high = series.agg(F.min("idx"), F.max("idx")).first()
    if low is None:
        low, high = 0, -1
    starts = lambda n: W.Grid(n, low, high - n + 2, step_seconds=1.0).of(F.col("idx"))
    covers = [F.transform(starts(n), lambda w: F.struct(F.lit(n).alias("window"), (w + low).alias("idx"))) for n in sizes]  # noqa: B023
    cells = series.select("x", "y", F.explode(F.concat(*covers)).alias("c")).groupBy("c.window", "c.idx").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    x = cells.select("window", "idx", "x", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("at", F.col("idx") + F.col("lag"))
    return x.join(cells.select("window", F.col("idx").alias("at"), "y"), ["window", "at"]).select("window", "lag", "idx", "x", "y")


def parsimonious_circle(heat: DataFrame, threshold: float = 0.2, multiple: float = 1.2) -> DataFrame:
    """(contour, lag, window, length, radius): the shortest bridge from the causal contour's line lag + window = contour to the significant contour.

    lag and window are the bridge's middle, radius is half its length times `multiple`. The line has a point for each
    lag whose window lies within the table's. The significant contour is the longest line at the threshold. No row without a contour
    or a line. The tables have a row for each cell of the heatmap's grid at most.
    """
    ends = heat.agg(F.min("window").alias("low"), F.max("window").alias("high")).crossJoin(causal_contour(heat).select(F.col("window").alias("contour")))  # one row each
    line = heat.select("lag").distinct().crossJoin(F.broadcast(ends)).withColumn("on_line", F.col("contour") - F.col("lag")).where("on_line BETWEEN low AND high")
    line = line.select("contour", F.col("lag").cast("double").alias("line_lag"), F.col("on_line").cast("double").alias("line_window"))
    pairs = line.crossJoin(significant_contour(heat, threshold))
    pairs = pairs.withColumn("length", F.hypot(F.col("lag") - F.col("line_lag"), F.col("window") - F.col("line_window")))
    middle = F.struct("contour", ((F.col("lag") + F.col("line_lag")) / 2).alias("lag"), ((F.col("window") + F.col("line_window")) / 2).alias("window"), "length", (F.col("length") / 2 * multiple).alias("radius"))
    best = pairs.agg(F.min_by(middle, F.struct("length", "line_lag", "lag", "window")).alias("x")).where("x IS NOT NULL")
    return best.select("x.*")


def standardised(df: DataFrame, column: str) -> DataFrame:
    """(idx, column, _n): the column less its mean, by its deviation, and the number of rows; no rows if it is constant."""
    known = df.where(F.col(column).isNotNull())
    stats = known.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"), F.count("*").alias("_n"))  # one row
    return known.crossJoin(F.broadcast(stats)).where("_s > 0").select("idx", ((F.col(column) - F.col("_m")) / F.col("_s")).alias(column), "_n")


def cross_correlation(x: DataFrame, y: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, r): the mean product of the standardised series x at idx and y at idx + lag, over the whole length."""
    zx = standardised(x, "x")
    pairs = align.all_lags(zx.select("idx", F.struct("x", "_n").alias("x")), standardised(y, "y").select("idx", "y"), lags)
    return pairs.groupBy("lag").agg((F.sum(F.col("x.x") * F.col("y")) / F.max("x._n")).alias("r"))


def cross_correlations(x: DataFrame, y: DataFrame, block: int | None = None) -> DataFrame:
    """(lag, r) as cross_correlation() has it, at every lag between a row of x and one of y; a lag without pairs has 0.

    No rows if a series is empty or constant.
    """
    zx = standardised(x, "x")
    count = zx.agg(F.max("_n").alias("_n"))  # one row
    sums = correlate.all_lag_sums(zx, standardised(y, "y"), block)
    return sums.crossJoin(F.broadcast(count)).select("lag", (F.col("s") / F.col("_n")).alias("r"))
