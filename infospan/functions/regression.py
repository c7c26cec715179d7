"""Bias regressions over (keys..., gamma, train_mi) tables, thresholds and smoothing, as aggregates.

A fit is a handful of weighted power sums, so all fits of all groups come from one aggregation by gamma and running
sums over at most a few gammas; no loop runs over fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sums(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted power sums by gamma; every run weighs 1 / (runs of its gamma)."""
    g, y = F.col("gamma").cast("double"), F.col("train_mi")
    per = runs.where(F.col("train_mi").isNotNull() & ~F.isnan("train_mi") & F.col("gamma").isNotNull()).groupBy(*keys, "gamma")
    found = per.agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.avg(y * y).alias("q"))
    return found.select(*keys, "gamma", "n", F.lit(1.0).alias("w0"), g.alias("w1"), (g * g).alias("w2"), (g * g * g).alias("w3"), (g * g * g * g).alias("w4"), F.col("m").alias("y0"), (g * F.col("m")).alias("y1"), (g * g * F.col("m")).alias("y2"), F.col("q").alias("yy"))


POWERS = ["w0", "w1", "w2", "w3", "w4", "y0", "y1", "y2", "yy"]


def _line() -> tuple[Column, Column]:
    d = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
    slope = F.try_divide(F.col("w0") * F.col("y1") - F.col("w1") * F.col("y0"), d)
    return F.try_divide(F.col("w2") * F.col("y0") - F.col("w1") * F.col("y1"), d), slope


def wls_line(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, intercept, slope): train_mi ~ 1 + gamma, weight 1 / count(gamma)."""
    keys = keys or []
    total = _sums(runs, keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in POWERS])
    a, b = _line()
    return total.select(*keys, a.alias("intercept"), b.alias("slope"))


def _det3(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def linear_region(runs: DataFrame, keys: list[str] | None = None, delta: float = 0.1, least: int = 5) -> DataFrame:
    """(keys, gamma_max, n_gammas, curvature): the longest run of gammas from the smallest on whose weighted quadratic fit is straight enough.

    Straight: |a2 / a1| < delta. Where no prefix of `least` gammas or more is, the shortest such prefix is taken.
    """
    keys = keys or []
    sums = _sums(runs, keys)
    w = Window.partitionBy(*keys).orderBy("gamma")
    run = sums.select(*keys, "gamma", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy(*keys)).alias("all"), *[F.sum(c).over(w).alias(c) for c in POWERS])
    c = {p: F.col(p) for p in POWERS}
    a1 = _det3([[c["w0"], c["y0"], c["w2"]], [c["w1"], c["y1"], c["w3"]], [c["w2"], c["y2"], c["w4"]]])
    a2 = _det3([[c["w0"], c["w1"], c["y0"]], [c["w1"], c["w2"], c["y1"]], [c["w2"], c["w3"], c["y2"]]])
    prefix = run.withColumn("curvature", F.when(F.col("k") > 2, F.abs(F.try_divide(a2, a1))))
    ok = (F.col("curvature") < delta) & (F.col("k") >= least)
    first = F.least(F.lit(least), F.col("all"))
    ranked = prefix.withColumn("rank", F.when(ok, F.col("k")).when(F.col("k") == first, F.lit(0))).where("rank IS NOT NULL")
    best = ranked.groupBy(*keys).agg(F.max_by(F.struct("gamma", "k", "curvature"), "rank").alias("x"))
    return best.select(*keys, F.col("x.gamma").alias("gamma_max"), F.col("x.k").cast("long").alias("n_gammas"), F.col("x.curvature").alias("curvature"))


def student_t_quantile(p: float, df: int) -> float:
    """By bisection of the regularised incomplete beta function's continued fraction."""

    def cdf(t: float) -> float:
        x = df / (df + t * t)
        a, b = df / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

        def fraction(x: float, a: float, b: float) -> float:
            c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
            f = d
            for m in range(1, 300):
                for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d, c = 1 / (1 + step * d), 1 + step / c
                    f *= c * d
                if abs(c * d - 1) < 1e-14:
                    break
            return f

        tail = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
        return 1 - tail / 2 if t >= 0 else tail / 2

    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def extrapolated(runs: DataFrame, keys: list[str] | None = None, delta: float = 0.1, least: int = 5, confidence: float = 0.68, residual: float = 2.5, leverage: float = 0.2) -> DataFrame:
    """(keys, mi_corrected, slope, se, mi_error, pi_error, r2, n_runs, gamma_max, n_gammas, max_residual, residual_flag, loo_shift, leverage_flag, reliable).

    The weighted line over the linear region, read at gamma 0. mi_error and pi_error are half-widths of the confidence
    and prediction intervals; max_residual is the largest externally studentized residual; loo_shift is how far the
    intercept moves without gamma 1, against its size.
    """
    keys = keys or []
    region = linear_region(runs, keys, delta, least)
    table = runs.where(F.col("train_mi").isNotNull() & ~F.isnan("train_mi"))
    table = (table.join(region, keys) if keys else table.crossJoin(F.broadcast(region))).where("gamma <= gamma_max")
    n = F.count("*").over(Window.partitionBy(*keys, "gamma"))
    g = F.col("gamma").cast("double")
    table = table.withColumn("w", 1.0 / n).withColumn("g", g)
    base = [F.sum(F.col("w") * e).alias(k) for k, e in (("w0", F.lit(1.0)), ("w1", F.col("g")), ("w2", F.col("g") * F.col("g")), ("y0", F.col("train_mi")), ("y1", F.col("g") * F.col("train_mi")), ("yy", F.col("train_mi") * F.col("train_mi")))]
    rest = [F.sum(F.when(F.col("gamma") > 1, F.col("w") * e)).alias(f"r{k}") for k, e in (("w0", F.lit(1.0)), ("w1", F.col("g")), ("w2", F.col("g") * F.col("g")), ("y0", F.col("train_mi")), ("y1", F.col("g") * F.col("train_mi")))]
    sums = table.groupBy(*keys, "gamma_max", "n_gammas").agg(F.count("*").alias("n_runs"), *base, *rest)
    a, b = _line()
    fit = sums.withColumns({"a": a, "b": b}).withColumn("d", F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1"))
    rd = F.col("rw0") * F.col("rw2") - F.col("rw1") * F.col("rw1")
    fit = fit.withColumn("loo", F.try_divide(F.col("rw2") * F.col("ry0") - F.col("rw1") * F.col("ry1"), rd))
    fit = fit.withColumn("sse", F.greatest(F.lit(0.0), F.col("yy") - F.col("a") * F.col("y0") - F.col("b") * F.col("y1"))).withColumn("df", F.col("n_runs") - 2)
    fit = fit.withColumn("s2", F.try_divide(F.col("sse"), F.col("df").cast("double")))
    fit = fit.withColumn("se", F.sqrt(F.col("s2") * F.col("w2") / F.col("d")))
    quantiles = _quantiles(fit, confidence)
    fit = fit.withColumn("t", quantiles)
    rows = table.join(fit.select(*keys, "a", "b", "sse", "s2", "df", "d", "w0", F.col("w1").alias("sw1"), "w2"), keys) if keys else table.crossJoin(F.broadcast(fit.select("a", "b", "sse", "s2", "df", "d", "w0", F.col("w1").alias("sw1"), "w2")))
    e = F.col("train_mi") - F.col("a") - F.col("b") * F.col("g")
    h = F.col("w") * (F.col("w2") - 2 * F.col("sw1") * F.col("g") + F.col("w0") * F.col("g") * F.col("g")) / F.col("d")
    s_out = F.try_divide(F.col("sse") - F.col("w") * e * e / F.greatest(1 - h, F.lit(1e-12)), (F.col("df") - 1).cast("double"))
    student = F.when(s_out > 1e-20, F.abs(e) * F.sqrt("w") / F.sqrt(s_out * F.greatest(1 - h, F.lit(1e-12)))).otherwise(0.0)
    worst = rows.groupBy(*keys).agg(F.max(student).alias("max_residual"))
    fit = fit.join(worst, keys) if keys else fit.crossJoin(F.broadcast(worst))
    shift = F.abs(F.col("loo") - F.col("a")) / (F.abs(F.col("a")) + 1e-8)
    r2 = 1 - F.try_divide(F.col("sse"), F.col("yy") - F.col("y0") * F.col("y0") / F.col("w0"))
    leveraged = F.coalesce(shift > leverage, F.lit(False))
    return fit.select(
        *keys, F.col("a").alias("mi_corrected"), F.col("b").alias("slope"), "se", (F.col("t") * F.col("se")).alias("mi_error"), (F.col("t") * F.sqrt(F.col("se") * F.col("se") + F.col("s2"))).alias("pi_error"), r2.alias("r2"),
        "n_runs", "gamma_max", "n_gammas", "max_residual", (F.col("max_residual") > residual).alias("residual_flag"), shift.alias("loo_shift"), leveraged.alias("leverage_flag"), ((F.col("n_gammas") >= least) & ~leveraged).alias("reliable"),
    )


def _quantiles(fit: DataFrame, confidence: float) -> Column:
    """Student's t for the degrees of freedom of a row: a table up to 200, then the normal limit's expansion."""
    p = (1 + confidence) / 2
    z = student_t_quantile(p, 10**7)
    listed = F.array(*[F.lit(student_t_quantile(p, d)) for d in range(1, 201)])
    d = F.col("df").cast("double")
    expansion = z + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d * d)
    return F.when(F.col("df").between(1, 200), F.get(listed, (F.col("df") - 1).cast("int"))).when(F.col("df") > 200, expansion)


def precision_threshold(curve: DataFrame, ratios: list[float] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, ratio, baseline, threshold, tau) of (keys, tau, mi): the smallest tau over 0 whose mi is below ratio * mi(0); null if none."""
    keys = keys or []
    base = curve.groupBy(*keys).agg(F.max(F.when(F.col("tau") == 0, F.col("mi"))).alias("baseline"))
    table = curve.join(base, keys) if keys else curve.crossJoin(F.broadcast(base))
    table = table.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios or [0.9]])))
    limit = F.col("ratio") * F.col("baseline")
    return table.groupBy(*keys, "ratio", "baseline").agg(F.min(F.when((F.col("tau") > 0) & (F.col("mi") < limit), F.col("tau"))).alias("tau")).select(*keys, "ratio", "baseline", limit.alias("threshold"), "tau")


def smoothed(history: DataFrame, keys: list[str], order: str, value: str, median: int = 5, sigma: float = 1.0) -> DataFrame:
    """history with `smooth`: a median over `median` values, then a normal kernel, both reflected at the ends.

    Null and NaN take the last value before for the filters and stay null in the result. A history is one group's, so
    short; each is filtered as an array.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.when(F.isnan(value), None).otherwise(F.col(value)).alias("v"))))
    arrays = history.groupBy(*keys).agg(listed.alias("h"))
    filled = F.expr("aggregate(h, CAST(array() AS ARRAY<DOUBLE>), (a, x) -> concat(a, array(coalesce(CAST(x.v AS DOUBLE), get(a, size(a) - 1)))))")
    arrays = arrays.withColumn("a", filled).withColumn("n", F.size("h"))
    r, radius = median // 2, int(4 * sigma + 0.5)
    at = "get({a}, CASE WHEN pmod(i + k, 2 * n) < n THEN pmod(i + k, 2 * n) ELSE 2 * n - 1 - pmod(i + k, 2 * n) END)"
    med = f"transform(a, (v, i) -> get(array_sort(transform(sequence(-{r}, {r}), k -> {at.format(a='a')})), {r}))"
    arrays = arrays.withColumn("m", F.when(F.col("n") >= median, F.expr(med)).otherwise(F.col("a")))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = "array(" + ", ".join(f"{x / sum(kernel)!r}D" for x in kernel) + ")"
    conv = f"transform(m, (v, i) -> aggregate(sequence(-{radius}, {radius}), 0D, (s, k) -> s + get({weights}, k + {radius}) * {at.format(a='m')}))"
    arrays = arrays.withColumn("g", F.expr(conv))
    out = F.expr("transform(h, (x, i) -> struct(x.o AS o, IF(x.v IS NULL, NULL, get(g, i)) AS smooth))")
    return arrays.select(*keys, F.explode(out).alias("x")).select(*keys, F.col("x.o").alias(order), F.col("x.smooth").alias("smooth"))


def guarded(runs: DataFrame, history: str = "test_mi_history") -> DataFrame:
    """runs with raw_train_mi kept and train_mi 0 where no entry of the history is above 0."""
    negative = F.coalesce(F.array_max(history), F.lit(0.0)) <= 0
    return runs.withColumn("raw_train_mi", F.col("train_mi")).withColumn("all_mi_negative", negative).withColumn("train_mi", F.when(negative, 0.0).otherwise(F.col("train_mi")))


def near_ceiling(runs: DataFrame, share: float = 0.85) -> DataFrame:
    """runs (test_mi in nats, eval_size) with `near_ceiling`: whether InfoNCE on that many rows can hardly show more."""
    return runs.withColumn("near_ceiling", F.col("test_mi") > share * F.log(F.col("eval_size")))


def near_dimension(summary: DataFrame, embedding_dim: int, share: float = 0.8, column: str = "pr_eig") -> DataFrame:
    """summary with `near_dimension`: whether the participation ratio comes close to the number of embedding dimensions."""
    return summary.withColumn("near_dimension", F.col(column) >= share * embedding_dim)


def conservative_epoch(history: Column, fraction: float, min_improvement: float = 0.001) -> Column:
    """The first epoch of a (smoothed) history that improves on all before it and reaches `fraction` of the last such value.

    An epoch improves if it is above the best before by more than min_improvement of its size. Where no value is
    positive, the last improving epoch; null for an empty history. NaN and null never improve.
    """
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("i"), F.array().cast("array<struct<epoch:int,value:double>>").alias("found"))

    def step(s: Column, v: Column) -> Column:
        better = F.coalesce(~F.isnan(v) & (s["best"].isNull() | ((v - s["best"]) / (F.abs(s["best"]) + 1e-8) > min_improvement)), F.lit(False))
        one = F.array(F.struct(s["i"].alias("epoch"), v.alias("value")))
        return F.struct(F.when(better, v).otherwise(s["best"]).alias("best"), F.when(better, s["i"]).otherwise(s["last"]).alias("last"), (s["i"] + 1).alias("i"), F.when(better, F.concat(s["found"], one)).otherwise(s["found"]).alias("found"))

    def chosen(s: Column) -> Column:
        reached = F.filter(s["found"], lambda c: c["value"] >= fraction * s["best"])
        return F.when(s["best"] > 0, F.get(reached, F.lit(0))["epoch"]).otherwise(s["last"])

    return F.aggregate(history.cast("array<double>"), start, step, chosen)
