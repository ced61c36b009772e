"""Noise. Released tables are small, so their noise is drawn on the driver from the operating system's entropy;
hash noise is for tests only: its seed is known, so it protects nothing."""

from __future__ import annotations

import math
import secrets
from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def generator(seed: int | None = None) -> np.random.Generator:
    return np.random.default_rng(secrets.randbits(256) if seed is None else seed)


def uniform_hash(key: Column, seed: str) -> Column:
    """A number in (0, 1) from md5(seed|key): the same in any engine that has md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def gaussian_hash(key: Column, sigma: float | Column, seed: str) -> Column:
    """Box-Muller on two hashes."""
    return F.sqrt(-2.0 * F.log(uniform_hash(key, f"{seed}a"))) * F.cos(2 * math.pi * uniform_hash(key, f"{seed}b")) * sigma


def laplace_hash(key: Column, scale: float, seed: str) -> Column:
    u = uniform_hash(key, seed) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def gumbel_hash(key: Column, scale: float, seed: str) -> Column:
    return -scale * F.log(-F.log(uniform_hash(key, seed)))


def _bernoulli(p: Fraction) -> bool:
    return secrets.randbelow(p.denominator) < p.numerator


def _bernoulli_exp(x: Fraction) -> bool:
    """True with probability exp(-x), exactly."""
    while x > 1:
        if not _bernoulli_exp(Fraction(1)):
            return False
        x -= 1
    k = 1
    while _bernoulli(x / k):
        k += 1
    return k % 2 == 1


def discrete_laplace(scale: Fraction | int) -> int:
    scale = Fraction(scale)
    while True:
        u = secrets.randbelow(scale.numerator)
        if not _bernoulli_exp(Fraction(u, scale.numerator)):
            continue
        v = 0
        while _bernoulli_exp(Fraction(1)):
            v += 1
        size = (u + scale.numerator * v) // scale.denominator
        negative = bool(secrets.randbelow(2))
        if not (negative and size == 0):
            return -size if negative else size


def discrete_gaussian(variance: Fraction | int) -> int:
    """An exact sample of the discrete Gaussian (Canonne, Kamath and Steinke 2020)."""
    variance = Fraction(variance)
    t = math.isqrt(int(variance)) + 1
    while True:
        y = discrete_laplace(t)
        if _bernoulli_exp((abs(y) - variance / t) ** 2 / (2 * variance)):
            return y


def added(values: np.ndarray, sigma: float, rng: np.random.Generator, exact: bool = False) -> np.ndarray:
    """Counts with Gaussian noise: of floating-point numbers from rng, or exact ones, that are whole and that no seed repeats."""
    values = np.asarray(values, float)
    if not exact:
        return values + rng.normal(0, sigma, values.shape)
    if sigma == 0:
        return values.copy()
    # The next larger thousandth, so that rounding never lessens the noise.
    variance = Fraction(math.ceil(sigma * sigma * 1000), 1000)
    return values + np.array([discrete_gaussian(variance) for _ in range(values.size)], float).reshape(values.shape)
