"""Column functions."""

from __future__ import annotations

import hashlib

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NATS_IN_BIT = 0.6931471805599453


def mi_to_rho(bits: Column, dim: int) -> Column:
    """The correlation of each of `dim` Gaussian pairs that together carry `bits` of information."""
    return F.sqrt(1 - F.exp(-2.0 / dim * bits * NATS_IN_BIT))


def rho_to_mi(rho: Column) -> Column:
    """Bits carried by a Gaussian pair of correlation rho."""
    return -0.5 * F.log2(1 - rho * rho)


def anscombe(x: Column) -> Column:
    """Makes the variance of counts nearly constant."""
    return 2 * F.sqrt(F.greatest(x, F.lit(0.0)) + 0.375)


def to_bits(nats: Column) -> Column:
    return nats / NATS_IN_BIT


def rounded(x: Column, tau: float | Column) -> Column:
    """x to the nearest multiple of tau, halves to the even one; tau 0 changes nothing."""
    tau = tau if isinstance(tau, Column) else F.lit(float(tau))
    return F.when(tau == 0, x).otherwise(tau * F.rint(x / F.nullif(tau, F.lit(0.0))))


def plain_text(x: Column) -> Column:
    """Text of a double as SQL engines and Python write it: digits without exponent from 1e-4 up to 1e16, else as in 9.5e-05.

    Spark's own text has an exponent below 1e-3 and from 1e7 on.
    """
    text = x.cast("string")
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    sign, first, rest, power = part(1), part(2), F.when(part(3) == "0", "").otherwise(part(3)), F.try_to_number(part(4), F.lit("S999")).cast("int")
    digits = F.concat(first, rest)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole, after = F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.substr(digits, power + 2)
    large = F.concat(whole, F.lit("."), F.when(after == "", "0").otherwise(after))
    short = F.concat(first, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    shown = F.concat(sign, F.when(power.between(-4, -1), small).when(power.between(0, 15), large).otherwise(short))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(odd, F.when(text.contains("E"), shown).otherwise(text))


def jittered(x: Column, tau: float, seed: int) -> Column:
    """x with uniform noise of width tau."""
    return x + (F.rand(seed) - 0.5) * tau


def noisy(x: Column, sigma: float, seed: int) -> Column:
    """x with normal noise."""
    return x + F.randn(seed) * sigma


def dot(x: Column, y: Column) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def softplus(s: Column) -> Column:
    return F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s)))


def clamped(s: Column, c: float | None) -> Column:
    return s if c is None else F.least(F.greatest(s, F.lit(-float(c))), F.lit(float(c)))


def sigmoid(s: Column) -> Column:
    return 1 / (1 + F.exp(-s))


def softmax(x: Column) -> Column:
    """Of an array, shifted by its largest entry."""
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def geometric_grid(low: float, high: float, n: int) -> Column:
    """n values from low to high in equal ratios, as an array."""
    if n == 1:
        return F.array(F.lit(float(low)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(F.log(F.lit(float(low))) + i / (n - 1.0) * (F.log(F.lit(float(high))) - F.log(F.lit(float(low))))))


def seed_of(*parts: object) -> int:
    """A 31-bit seed that depends on its parts only."""
    return int(hashlib.md5("_".join(map(str, parts)).encode()).hexdigest(), 16) % 2**31


def hash_order(column: Column, seed: int) -> Column:
    """A reproducible pseudo-random rank of an integer id: two multiplications modulo the prime 2**31 - 1.

    Plain arithmetic, so any SQL engine gives the same order.
    """
    prime = 2147483647
    once = F.pmod(F.pmod(column.cast("long"), F.lit(prime)) * 48271 + F.lit(seed % prime), F.lit(prime))
    return F.pmod(once * 69621 + F.pmod(once, F.lit(1009)) * 16807, F.lit(prime))


def hash_bits(*parts: Column | str | int) -> Column:
    """The first 52 bits of the MD5 sum of the parts, joined by colons."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number between 0 and 1 for each different row of parts, however the table is partitioned."""
    return (hash_bits(*parts) + 0.5) / float(1 << 52)


def hash_normal(*parts: Column | str | int) -> Column:
    """A standard normal number by the Box-Muller rule."""
    return F.sqrt(-2 * F.log(hash_uniform(0, *parts))) * F.cos(2 * math.pi * hash_uniform(1, *parts))
