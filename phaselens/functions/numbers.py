"""Sizes for fast transforms, divisors, and the Bessel function of order 0."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def smooth(n: int, primes: tuple[int, ...] = (2, 3, 5, 7)) -> bool:
    for p in primes:
        while n % p == 0:
            n //= p
    return n == 1


def next_smooth(n: int, multiple: int = 1, primes: tuple[int, ...] = (2, 3, 5, 7)) -> int:
    """The least multiple of ``multiple``, n or more, whose other factor has only these primes."""
    k = -(-n // multiple)
    while not smooth(k, primes):
        k += 1
    return k * multiple


def smooth_table(spark: SparkSession, most: int) -> DataFrame:
    """(n, size): for each n up to ``most`` the least 7-smooth number that isn't smaller; made by products, not by search."""
    made = spark.range(1).select(F.lit(1.0).alias("s"))
    for p in (2, 3, 5, 7):
        powers = F.array(*(F.lit(float(p**e)) for e in range(int(math.log(2 * most, p)) + 1)))
        made = made.select("s", F.explode(powers).alias("k")).select((F.col("s") * F.col("k")).alias("s")).where(F.col("s") <= 2 * most)
    sizes = made.agg(F.sort_array(F.collect_set(F.col("s").cast("long"))).alias("all"))
    return spark.range(1, most + 1).select(F.col("id").alias("n"), sizes.scalar().alias("all")).select("n", F.array_min(F.filter("all", lambda s: s >= F.col("n"))).alias("size"))


def largest_divisor(n: Column, most: Column) -> Column:
    """The largest divisor of n that isn't more than ``most``."""
    return F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(n, most))), lambda k: n % k == 0))


def best_divisors(shape: list[Column], target: list[int], most: list[int] | None = None) -> list[Column]:
    """For each axis the largest divisor up to its target; where that is just 1, up to ``most``."""
    found = []
    for axis, (n, t) in enumerate(zip(shape, target, strict=True)):
        best = largest_divisor(n, F.lit(t).cast("long"))
        found.append(F.when(best > 1, best).otherwise(largest_divisor(n, F.lit(most[axis]).cast("long"))) if most and t > 1 else best)
    return found


def prime_factors(n: int) -> list[int]:
    """The prime factors of n, the least first, as often as they divide it."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def padded_sizes(spark: SparkSession, most: int, multiple: int) -> DataFrame:
    """(n, size): for each n up to ``most`` the least multiple of ``multiple`` that isn't smaller and whose other factor is 7-smooth."""
    cells = F.ceil(F.col("p") / multiple)
    sizes = smooth_table(spark, -(-most // multiple))
    return spark.range(1, most + 1).select(F.col("id").alias("p")).withColumn("n", cells).join(sizes, "n").select(F.col("p").alias("n"), (F.col("size") * multiple).alias("size"))


def bessel_j(order: int, x: np.ndarray) -> np.ndarray:
    """J of a whole order by the trapezoidal rule on its integral over a period, which converges exponentially: exact to rounding up to |x| of 200."""
    t = (np.arange(512) + 0.5) * (np.pi / 512)
    x = np.asarray(x, float)[..., None]
    return np.cos(order * t - x * np.sin(t)).mean(-1)


def bessel_i(order: int, x: np.ndarray) -> np.ndarray:
    """I of a whole order, likewise."""
    t = (np.arange(512) + 0.5) * (np.pi / 512)
    x = np.asarray(x, float)[..., None]
    return (np.exp(x * np.cos(t)) * np.cos(order * t)).mean(-1)


def bessel_k(order: int, x: np.ndarray) -> np.ndarray:
    """K of a whole order for x > 0: its integrand falls double-exponentially, so the trapezoidal rule is exact to rounding."""
    t = np.arange(4001) * 0.005
    x = np.asarray(x, float)[..., None]
    y = np.exp(-x * np.cosh(t) + np.logaddexp(order * t, -order * t) - np.log(2))
    return 0.005 * (y.sum(-1) - y[..., 0] / 2)


def bessel_y(order: int, x: np.ndarray) -> np.ndarray:
    """Y of a whole order for x > 0: Gauss-Legendre on both integrals of its definition, the second cut where nothing is left."""
    u, w = np.polynomial.legendre.leggauss(400)
    x = np.asarray(x, float)[..., None]
    a = (u + 1) * np.pi / 2
    near = (np.sin(x * np.sin(a) - order * a) * w).sum(-1) * np.pi / 2
    top = np.arcsinh(700 / x) + 0 * u
    t = (u + 1) * top / 2
    far = ((np.exp(order * t - x * np.sinh(t)) + (-1) ** order * np.exp(-order * t - x * np.sinh(t))) * w * top / 2).sum(-1)
    return (near - far) / np.pi


def bessel_j0(x: np.ndarray) -> np.ndarray:
    """J0 by the trapezoidal rule on its integral over a period, which converges exponentially: exact to rounding up to |x| of 200."""
    t = (np.arange(256) + 0.5) * (np.pi / 256)
    x = np.asarray(x, float)
    return np.cos(x[..., None] * np.sin(t)).mean(-1)
