"""Cross-covariances of embedding dimensions and the participation ratios of their spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.functions import gram


def channel_std(samples: DataFrame, column: str = "x") -> DataFrame:
    """(channel, sd): population deviation of each entry of an array column."""
    return samples.select(F.posexplode(column).alias("channel", "v")).groupBy("channel").agg(F.stddev_pop(F.col("v").cast("double")).alias("sd"))


def cross_covariance(samples: DataFrame, whiten: str = "std", keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, c) of arrays x and y: centred, divided by population deviations if `whiten` is `std`, freed of each side's own
    correlations if `zca`, sums over N - 1.

    Tasks sum the products of their rows; a key's matrices have dimensions, not samples. Null where a key has one row.
    """
    keys = keys or []

    def matrix(n: int, dx: int, mean: np.ndarray, products: np.ndarray) -> np.ndarray:
        m = products / (n - 1) if n > 1 else np.full(products.shape, np.nan)
        if whiten == "zca":
            return _inverse_root(m[:dx, :dx]) @ m[:dx, dx:] @ _inverse_root(m[dx:, dx:]) if n > 1 else m[:dx, dx:]
        sd = np.maximum(np.sqrt(products.diagonal() / n), 1e-8) if whiten == "std" else np.ones(len(mean))
        return m[:dx, dx:] / np.outer(sd[:dx], sd[dx:])

    return gram.cells(gram.sums(samples, keys), keys, matrix)


def _inverse_root(a: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(a)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-8))) @ vectors.T


def pr_eig(cov: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pr_eig): (sum s^2)^2 / sum s^4 of the singular values, without a decomposition.

    Sum s^2 is the sum of squares of C and sum s^4 that of C^T C; C has a row for each pair of dimensions only.
    """
    keys = keys or []
    two = cov.groupBy(*keys).agg(F.sum(F.col("c") * F.col("c")).alias("s2"))
    other = cov.select(*keys, "i", F.col("j").alias("k"), F.col("c").alias("d"))
    gram = cov.join(other, [*keys, "i"]).groupBy(*keys, "j", "k").agg(F.sum(F.col("c") * F.col("d")).alias("g"))
    four = gram.groupBy(*keys).agg(F.sum(F.col("g") * F.col("g")).alias("s4"))
    joined = two.join(four, keys) if keys else two.crossJoin(four)  # one row each
    return joined.select(*keys, (F.col("s2") * F.col("s2") / F.col("s4")).alias("pr_eig"))


def singular_values(cov: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, k, sigma) in falling order; each key's matrix has dimensions, not samples, and fits a task."""
    keys = keys or ["_one"]
    table = cov if keys != ["_one"] else cov.withColumn("_one", F.lit(0))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        m[part["i"], part["j"]] = part["c"]
        sigma = np.linalg.svd(m, compute_uv=False)
        return pd.DataFrame({k: v for k, v in zip(keys, key, strict=True)} | {"k": np.arange(len(sigma)), "sigma": sigma})

    schema = ", ".join(f"{k} {table.schema[k].dataType.simpleString()}" for k in keys)
    found = table.groupBy(*keys).applyInPandas(run, f"{schema}, k int, sigma double")
    return found.drop("_one")


def spectrum_summary(sigma: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pr_eig, pr_singular, entropy, effective_rank) of (keys, k, sigma)."""
    keys = keys or []
    s = F.col("sigma")
    total = sigma.groupBy(*keys).agg(F.sum(s).alias("s1"), F.sum(s * s).alias("s2"), F.sum(s * s * s * s).alias("s4"), F.sum(F.when(s > 0, s * F.log(s)).otherwise(0.0)).alias("sl"))
    entropy = F.log("s1") - F.col("sl") / F.col("s1")
    return total.select(*keys, (F.col("s2") * F.col("s2") / F.col("s4")).alias("pr_eig"), (F.col("s1") * F.col("s1") / F.col("s2")).alias("pr_singular"), entropy.alias("entropy"), F.exp(entropy).alias("effective_rank"))


def rotated(samples: DataFrame, whiten: str = "std") -> DataFrame:
    """samples with u and v: centred, unwhitened x and y in the bases of their cross-covariance's singular vectors.

    Only the d * d matrix and the means come to the driver; they grow with dimensions, not with rows.
    """
    listed = cross_covariance(samples, whiten).collect()
    m = np.zeros((1 + max(r["i"] for r in listed), 1 + max(r["j"] for r in listed)))
    for r in listed:
        m[r["i"], r["j"]] = r["c"]
    left, _, right = np.linalg.svd(m)
    mean = {c: np.array([r["m"] for r in samples.select(F.posexplode(c).alias("k", "v")).groupBy("k").agg(F.avg(F.col("v").cast("double")).alias("m")).orderBy("k").collect()]) for c in ("x", "y")}

    @F.pandas_udf("array<double>")
    def u(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.to_list()) - mean["x"]) @ left))

    @F.pandas_udf("array<double>")
    def v(y: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(y.to_list()) - mean["y"]) @ right.T))

    return samples.withColumns({"u": u("x"), "v": v("y")})
