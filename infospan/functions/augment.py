"""Augmentations of samples held as nested arrays (height x width), as column functions with seeded choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sometimes(changed: Column, image: Column, p: float, seed: int) -> Column:
    return F.when(F.rand(seed) < p, changed).otherwise(image)


def flip_h(image: Column, p: float = 0.5, seed: int = 0) -> Column:
    return _sometimes(F.transform(image, F.reverse), image, p, seed)


def flip_v(image: Column, p: float = 0.5, seed: int = 0) -> Column:
    return _sometimes(F.reverse(image), image, p, seed)


def rotate_90(image: Column, turns: int = 1) -> Column:
    """Counter-clockwise; all rows have one length."""
    for _ in range(turns % 4):
        image = _turned(image)
    return image


def _turned(image: Column) -> Column:
    columns = F.sequence(F.lit(1), F.size(F.get(image, F.lit(0))))
    return F.transform(F.reverse(columns), lambda j: F.transform(image, lambda row: F.element_at(row, j)))


def _band(values: Column, start: Column, width: int, empty: Callable[[Column], Column]) -> Column:
    return F.transform(values, lambda v, i: F.when((i >= start) & (i < start + width), empty(v)).otherwise(v))


def time_mask(image: Column, start: Column, width: int) -> Column:
    """Zeros in `width` columns from `start` on."""
    return F.transform(image, lambda row: _band(row, start, width, lambda v: F.lit(0.0)))


def freq_mask(image: Column, start: Column, width: int) -> Column:
    """Zeros in `width` rows from `start` on."""
    return _band(image, start, width, lambda row: F.transform(row, lambda v: F.lit(0.0)))


def erase(image: Column, top: Column, left: Column, height: int, width: int) -> Column:
    return F.transform(image, lambda row, i: F.when((i >= top) & (i < top + height), _band(row, left, width, lambda v: F.lit(0.0))).otherwise(row))


def crop(image: Column, top: Column, left: Column, height: int, width: int) -> Column:
    return F.transform(F.slice(image, top + 1, F.lit(height)), lambda row: F.slice(row, left + 1, F.lit(width)))


def intensity_scale(values: Column, low: float = 0.8, high: float = 1.2, seed: int = 0) -> Column:
    """One factor for a sample; values: a flat array."""
    return F.transform(F.arrays_zip(values.alias("v"), F.array_repeat(low + (high - low) * F.rand(seed), F.size(values)).alias("k")), lambda x: x["v"] * x["k"])


def gaussian_noise(values: list[Column], std: float = 0.1, seed: int = 0) -> Column:
    """An array of the columns, each with noise of its own."""
    return F.array(*[v + F.randn(seed + k) * std for k, v in enumerate(values)])


def channel_dropout(values: list[Column], p: float = 0.1, seed: int = 0) -> Column:
    return F.array(*[F.when(F.rand(seed + k) < p, 0.0).otherwise(v) for k, v in enumerate(values)])
