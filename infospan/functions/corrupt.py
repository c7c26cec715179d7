"""Lower precision and added noise for the cells of each kind of stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infospan.errors import DataShapeError
from infospan.functions.scalar import hash_normal, hash_uniform, rounded

KINDS = ("static", "continuous", "spike", "binned", "categorical")


def _cells(kind: str, value: Column) -> Column:
    """Which cells change: of a continuous stream those that aren't 0, of raw spikes those that are real (a filled slot is negative)."""
    if kind not in KINDS:
        raise DataShapeError(f"kind is one of {', '.join(KINDS)}")
    if kind == "categorical":
        raise DataShapeError("categories have neither precision nor noise")
    return value != 0 if kind == "continuous" else value >= 0 if kind == "spike" else F.lit(True)


def apply_precision(cells: DataFrame, kind: str, level: float, column: str = "value") -> DataFrame:
    """cells with the values rounded to multiples of `level`; 0 leaves them as they are."""
    changed = _cells(kind, F.col(column))
    return cells if level == 0 else cells.withColumn(column, F.when(changed, rounded(F.col(column), level)).otherwise(F.col(column)))


def apply_noise(cells: DataFrame, kind: str, amplitude: float, seed: int, keys: list[str], column: str = "value") -> DataFrame:
    """cells with noise by a hash of (seed, keys); 0 leaves them as they are.

    Static and continuous: normal with that deviation. Spikes: uniform over `amplitude` seconds about each. Binned: the same, on bins
    that aren't empty, cut at 0.
    """
    changed = _cells(kind, F.col(column))
    if amplitude == 0:
        return cells
    at, v = [F.col(k) for k in keys], F.col(column)
    if kind in ("static", "continuous"):
        new = v + amplitude * hash_normal(seed, *at)
    else:
        new = v + amplitude * (hash_uniform(seed, *at) - 0.5)
    if kind == "binned":
        changed, new = v > 0, F.greatest(new, F.lit(0.0))
    return cells.withColumn(column, F.when(changed, new).otherwise(v))
