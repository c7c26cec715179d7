"""Lower bounds of mutual information from scores; the true pairs have i = j.

A bound reads either a table of scores (keys..., i, j, s) or what scored_rows() leaves of them: the sums of each row of a
batch's score matrix. The matrices are made in the workers a few rows at a time and never become rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infospan.functions.scalar import clamped, softplus
from infospan.operators.splits import ranked

#: Rows of a score matrix that a worker holds at once.
ROWS_AT_ONCE = 256
ROW = "top double, all_e double, off_e double, own double, own_sp double, off_sp double"


def scored_rows(samples: DataFrame, batch: int = 5_000, seed: int = 0, key: str = "id", clip: float | None = None) -> DataFrame:
    """(batch, i, sums of row i): inner products of x_i with every y_j of its batch of `batch` rows, dealt by a seeded order of the key.

    clip: scores are cut to +-clip first, as smile() wants them. The last batch has what is left.
    """
    rows = ranked(samples, key, seed, "_n").select(F.floor(F.col("_n") / batch).alias("batch"), F.col(key).alias("i"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(part["x"].to_list()), np.stack(part["y"].to_list())
        found = []
        for low in range(0, len(x), ROWS_AT_ONCE):
            s = x[low : low + ROWS_AT_ONCE] @ y.T
            if clip is not None:
                s = np.clip(s, -clip, clip)
            at = np.arange(len(s))
            top, own = s.max(axis=1), s[at, low + at]
            e = np.exp(s - top[:, None])
            sp = np.logaddexp(0, s)
            found.append(np.stack([top, e.sum(axis=1), e.sum(axis=1) - e[at, low + at], own, np.logaddexp(0, -own), sp.sum(axis=1) - sp[at, low + at]], axis=1))
        names = [c.split()[0] for c in ROW.split(", ")]
        return pd.DataFrame({"batch": part["batch"].iloc[0], "i": part["i"].to_numpy()} | dict(zip(names, np.concatenate(found).T, strict=True)))

    return rows.groupBy("batch").applyInPandas(score, f"batch long, i {rows.schema['i'].dataType.simpleString()}, {ROW}")


def _by_row(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Log-sum-exp of each row of scores, over all columns and without the diagonal, about the row's largest."""
    joined = scores.withColumn("top", F.max("s").over(Window.partitionBy(*keys, "i")))  # a row of scores is one batch wide
    e = F.exp(F.col("s") - F.col("top"))
    off = F.col("i") != F.col("j")
    return joined.groupBy(*keys, "i", "top").agg(
        F.sum(e).alias("all_e"), F.sum(F.when(off, e)).alias("off_e"), F.sum(F.when(~off, F.col("s"))).alias("own"),
        F.sum(F.when(~off, softplus(-F.col("s")))).alias("own_sp"), F.sum(F.when(off, softplus(F.col("s")))).alias("off_sp"),
    )


def _means(scores: DataFrame, keys: list[str]) -> DataFrame:
    rows = scores if "off_e" in scores.columns else _by_row(scores, keys)
    if keys:
        rows = rows.withColumn("most", F.max("top").over(Window.partitionBy(*keys)))
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max("top").alias("most"))))  # one row
    n = F.count("*").cast("double")
    off = F.col("most").alias("m")
    return rows.groupBy(*keys, off).agg(
        F.count("*").alias("n"), F.avg("own").alias("own"), F.avg(F.col("own") - (F.col("top") + F.log("all_e"))).alias("nce"),
        F.sum(F.col("off_e") * F.exp(F.col("top") - F.col("most"))).alias("off_e"), F.sum("own_sp").alias("own_sp"), F.sum("off_sp").alias("off_sp"), n.alias("nd"),
    ).withColumn("lme", F.col("m") + F.log("off_e") - F.log(F.col("nd") * (F.col("nd") - 1)))


def _one(scores: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return _means(scores, keys).select(*keys, "n", value.alias("mi"))


def infonce(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ln N + mean(s_ii - logsumexp_j s_ij); at most ln N."""
    return _one(scores, keys or [], F.log("nd") + F.col("nce"))


def tuba(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """1 + mean(s_ii) - the mean of exp(s_ij) over i != j."""
    return _one(scores, keys or [], 1 + F.col("own") - F.exp("lme"))


def nwj(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """TUBA of the scores less one."""
    return _one(scores, keys or [], F.col("own") - F.exp(F.col("lme") - 1))


def js(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """-mean softplus(-s_ii) - the mean of softplus(s_ij) over i != j."""
    return _one(scores, keys or [], -F.col("own_sp") / F.col("nd") - F.col("off_sp") / (F.col("nd") * (F.col("nd") - 1)))


def smile(scores: DataFrame, keys: list[str] | None = None, clip: float | None = 5.0) -> DataFrame:
    """mean(s_ii) - log mean exp(s_ij) over i != j, of scores clipped to +-clip; scored_rows() must have clipped its own."""
    if "s" in scores.columns:
        scores = scores.withColumn("s", clamped(F.col("s"), clip))
    return _one(scores, keys or [], F.col("own") - F.col("lme"))


def log_mean_exp_off_diagonal(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _one(scores, keys or [], F.col("lme"))


#: Bounds by name; the first two are what the modes offer.
BOUNDS: dict[str, Callable[..., DataFrame]] = {"infonce": infonce, "smile": smile, "tuba": tuba, "nwj": nwj, "js": js}
