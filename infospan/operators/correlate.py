"""Cross-correlation of two long series at all lags, by transforms of blocks and then across blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Complex numbers of one side that a task holds at most while it transforms across blocks.
HELD = 1 << 22


def all_lag_sums(x: DataFrame, y: DataFrame, block: int | None = None) -> DataFrame:
    """(lag, s): the sum over idx of x at idx times y at idx + lag, for every lag between two rows' places.

    x (idx, x) and y (idx, y); rows without idx or value count as 0, values of one idx add up. Both are cut into blocks
    of about the root of the span, padded and transformed; for each frequency the blocks' values are a series, which is
    correlated by a transform of its own; a transform back gives the sums of one distance between blocks. So n places cost
    n log n, each of the three steps is a shuffle of about 2 n numbers, and a task holds blocks, never the series.
    No rows if a side is empty.
    """
    sides = [x.select(F.lit(0).alias("side"), "idx", F.col("x").cast("double").alias("v")), y.select(F.lit(1).alias("side"), "idx", F.col("y").cast("double").alias("v"))]
    points = sides[0].unionAll(sides[1]).where("idx IS NOT NULL AND v IS NOT NULL")
    spans = {r["side"]: (r["lo"], r["hi"]) for r in points.groupBy("side").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).collect()}  # two rows
    if len(spans) < 2:
        return x.sparkSession.createDataFrame([], "lag long, s double")
    start, end = min(lo for lo, _ in spans.values()), max(hi for _, hi in spans.values())
    block = block or 1 << (max(0, (end - start).bit_length()) + 1) // 2
    blocks = (end - start) // block + 1
    width = max(1, min(block + 1, HELD // (2 * blocks)))  # neighbouring frequencies of a task
    least, most = spans[1][0] - spans[0][1], spans[1][1] - spans[0][0]
    place = F.col("idx") - F.lit(start)
    points = points.groupBy("side", place.alias("p")).agg(F.sum("v").alias("v")).select("side", F.expr(f"p DIV {block}").alias("b"), F.expr(f"CAST(p % {block} AS INT)").alias("k"), "v")

    def pieces(found: np.ndarray, **columns) -> pd.DataFrame:
        cuts = range(0, block + 1, width)
        parts = [found[c : c + width] for c in cuts]
        return pd.DataFrame({**columns, "chunk": range(len(parts)), "re": [p.real for p in parts], "im": [p.imag for p in parts]})

    def spectrum(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(2 * block)
        held[rows["k"].to_numpy()] = rows["v"].to_numpy()
        return pieces(np.fft.rfft(held), side=key[0], b=key[1])

    def across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((2, 2 * blocks, len(rows["re"].iloc[0])), complex)
        for side, b, re, im in zip(rows["side"], rows["b"], rows["re"], rows["im"], strict=True):
            held[side, b] = re + 1j * im
        found = np.fft.fft(held, axis=1)
        product = np.fft.ifft(np.conj(found[0]) * found[1], axis=0)
        apart = np.arange(1 - blocks, blocks)
        return pd.DataFrame({"apart": apart, "chunk": key[0], "re": list(product.real[apart]), "im": list(product.imag[apart])})

    def back(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        held = np.concatenate(rows["re"].to_list()) + 1j * np.concatenate(rows["im"].to_list())
        delta = np.arange(1 - block, block)
        return pd.DataFrame({"lag": key[0] * block + delta, "s": np.fft.irfft(held, 2 * block)[delta]})

    # conj(X) per frequency: a real series' own conjugate symmetry lets the half spectrum stand for the whole.
    spectra = points.groupBy("side", "b").applyInPandas(spectrum, "side int, b long, chunk int, re array<double>, im array<double>")
    products = spectra.groupBy("chunk").applyInPandas(across, "apart long, chunk int, re array<double>, im array<double>")
    sums = products.groupBy("apart").applyInPandas(back, "lag long, s double")
    return sums.where(F.col("lag").between(least, most)).groupBy("lag").agg(F.sum("s").alias("s"))
