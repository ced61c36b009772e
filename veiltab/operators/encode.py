"""Encoders: values to small integer codes and back. Each is fitted by one aggregation and applied as an expression;
only tables of distinct values that were counted first are sent to executors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import placed

#: Columns of fewer distinct values are kept as they are; the others are binned.
BINS, RARE_LABEL = 100, "R"
#: Most rows of a value table that may be broadcast.
TABLE_ROWS = 1_000_000


def lookup_join(df: DataFrame, table: DataFrame, on: str, rows: int) -> DataFrame:
    return df.join(F.broadcast(table) if rows <= TABLE_ROWS else table, on, "left")


def ordinal(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, code): distinct values in order, from 0."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return placed(values, "value").select("value", F.col("rank").cast("int").alias("code"))


def ordinal_encoded(df: DataFrame, column: str, out: str) -> DataFrame:
    table = ordinal(df, column).select(F.col("value").alias(column), F.col("code").alias(out))
    return df.join(table, column, "left")


def by_frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, code): values by falling count, ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return placed(counts, F.desc("n"), F.col("value")).select("value", "n", F.col("rank").cast("int").alias("code"))


def uniform_bin(x: Column, low: float, high: float, bins: int = BINS) -> Column:
    """Equal-width bins over [low, high]; the last is closed, values outside go to the end bins."""
    if high <= low:
        return F.lit(0)
    return F.greatest(F.lit(0), F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))).cast("int")


def log_bin(x: Column, low: float, high: float, bins: int = BINS) -> Column:
    """Equal-width bins on log2(x - low + 0.01)."""
    return uniform_bin(F.log2(x - low + 0.01), math.log2(0.01), math.log2(high - low + 0.01), bins)


def log_bin_middle(code: Column, low: float, high: float, bins: int = BINS) -> Column:
    a, b = math.log2(0.01), math.log2(high - low + 0.01)
    return F.pow(F.lit(2.0), (code + 0.5) * ((b - a) / bins) + a) - 0.01 + low


def min_max(x: Column, low: float, high: float) -> Column:
    return (x - low) / (high - low) if high > low else F.lit(0.0)


def min_max_inverse(y: Column, low: float, high: float) -> Column:
    return y * (high - low) + low


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """A value on an inner edge goes up; values outside go to the end bins."""
    code: Column = F.lit(0)
    for e in edges[1:-1]:
        code = code + (x >= float(e)).cast("int")
    return code.cast("int")


def edge_middle(code: Column, edges: Sequence[float]) -> Column:
    middles = F.array(*(F.lit((a + b) / 2) for a, b in zip(edges, edges[1:], strict=False)))
    return F.get(middles, F.greatest(F.lit(0), F.least(code, F.lit(len(edges) - 2))))


def interval_code(x: Column, intervals: Sequence[tuple[float, float]]) -> Column:
    """The number of the half-open interval that holds x, else -1."""
    out: Column = F.lit(-1)
    for k, (a, b) in enumerate(intervals):
        out = F.when((x >= a) & (x < b), k).otherwise(out)
    return out.cast("int")


def interval_draw(code: Column, intervals: Sequence[tuple[float, float]], row_id: Column, seed: int) -> Column:
    """Uniform in the interval, by a stable hash of the row id."""
    low, high = (F.array(*(F.lit(float(p[k])) for p in intervals)) for k in (0, 1))
    at = F.greatest(F.lit(0), F.least(code, F.lit(len(intervals) - 1)))
    u = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return F.get(low, at) + u * (F.get(high, at) - F.get(low, at))


def one_hot(column: Column, values: Sequence, prefix: str) -> list[Column]:
    return [F.when(column == v, 1).otherwise(0).alias(f"{prefix}{k}") for k, v in enumerate(values)]


def one_hot_inverse(columns: Sequence[Column], values: Sequence) -> Column:
    """The value of the largest of relaxed one-hot columns (the first of equals)."""
    whole = F.array(*columns)
    return F.get(F.array(*map(F.lit, values)), (F.array_position(whole, F.array_max(whole)) - 1).cast("int"))


def rare_values(counts: DataFrame, rows: int, threshold: float, sigma: float = 0.0) -> DataFrame:
    """Of (value, n), the values to merge: n at most rows * threshold, or lost in the noise."""
    return counts.where(F.col("n") <= max(rows * threshold, 3 * sigma)) if threshold >= 0 else counts.limit(0)


def rare_merged(df: DataFrame, column: str, threshold: float, label: str = RARE_LABEL) -> DataFrame:
    """column with its rare values replaced by label."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__rows"))
    common = counts.crossJoin(F.broadcast(total)).where(F.col("__n") > F.col("__rows") * threshold).select(column, F.lit(True).alias("__common"))
    return df.join(common, column, "left").withColumn(column, F.when(F.col("__common"), F.col(column)).otherwise(F.lit(label))).drop("__common")


def budget_shares(num_distinct: Sequence[int], cat_distinct: Sequence[int], least: int = BINS) -> tuple[float, float]:
    """Shares of the preprocessing budget for numerical and categorical columns that need any."""
    num, cat = sum(n >= least for n in num_distinct), sum(n >= least for n in cat_distinct)
    return (num / (num + cat), cat / (num + cat)) if num + cat else (0.0, 0.0)


def quantile_interval(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Values of the data at two ranks: rounded up for low, down for high."""
    return df.agg(F.expr(f"percentile_disc({low}) WITHIN GROUP (ORDER BY {column})").alias("low"), F.expr(f"percentile_disc({high}) WITHIN GROUP (ORDER BY {column})").alias("high"))


# Histogram-based private discretisers: one Spark job makes the histogram, the rest works on its cells.


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> np.ndarray:
    rows = df.where(F.col(column).isNotNull()).groupBy(uniform_bin(F.col(column), low, high, bins).alias("bin")).count().collect()
    out = np.zeros(bins)
    for r in rows:  # a row per bin
        out[r["bin"]] = r["count"]
    return out


def privtree(counts: np.ndarray, low: float, high: float, rho: float, noise: Callable[[float], float], columns: int = 1, theta: float = 0.0) -> list[tuple[float, float]]:
    """Intervals by private recursive halving of a histogram of 2^k fine bins over public bounds.

    A node of depth d is split if max(count - d * delta, theta - delta) + Laplace(lambda) > theta."""
    lam = 3 * math.sqrt(columns / (2 * rho))
    delta = lam * math.log(2)
    before = np.concatenate(([0.0], np.cumsum(counts)))
    out, queue = [], [(0, len(counts), 0)]
    while queue:
        a, b, depth = queue.pop(0)
        value = max(before[b] - before[a] - depth * delta, theta - delta) + noise(lam)
        if value > theta and b - a > 1:
            queue += [(a, (a + b) // 2, depth + 1), ((a + b) // 2, b, depth + 1)]
        else:
            out.append((a, b))
    step = (high - low) / len(counts)
    return [(low + a * step, low + b * step) for a, b in sorted(out)]


def absolute_deviation(x: Sequence[float]) -> float:
    mean = sum(x) / len(x)
    return float(sum(abs(v - mean) for v in x))


def l1_partition(x: np.ndarray, epsilon: float, ratio: float, noise: Callable[[float], float], lengths: str = "all") -> list[tuple[int, int]]:
    """Buckets [a, b) of least noisy cost: a bucket costs its absolute deviation plus a charge for its own count.

    lengths "all" weighs every interval, "powers" those of power-of-two length. Deviations of growing intervals come
    from trees of counts and sums over the sorted values, so the work is n^2 log n."""
    n = len(x)
    e1, e2 = epsilon * ratio, epsilon * (1 - ratio)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    ordered = np.sort(np.asarray(x, float))
    place = np.argsort(np.argsort(x, kind="stable"), kind="stable") + 1  # of each value among all, from 1
    for end in range(1, n + 1):
        wanted = set(range(1, end + 1) if lengths == "all" else [1 << k for k in range(end.bit_length()) if 1 << k <= end])
        counts, sums, total = [0] * (n + 1), [0.0] * (n + 1), 0.0  # binary indexed trees over the sorted values
        for size in range(1, max(wanted) + 1):
            v = float(x[end - size])
            total += v
            at = int(place[end - size])
            while at <= n:
                counts[at] += 1
                sums[at] += v
                at += at & -at
            if size in wanted:
                mean = total / size
                at, k, low = int(np.searchsorted(ordered, mean, "right")), 0, 0.0
                while at:
                    k, low, at = k + counts[at], low + sums[at], at & (at - 1)
                cost = 2 * (mean * k - low) if size > 1 else 0.0
                cost += (noise(2 / e1) if e1 > 0 else 0.0) + 1 / e2
                if best[end - size] + cost < best[end]:
                    best[end], back[end] = best[end - size] + cost, end - size
    out, at = [], n
    while at:
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


def dawa(x: np.ndarray, epsilon: float, ratio: float, noise: Callable[[float], float], lengths: str = "powers") -> tuple[list[tuple[int, int]], np.ndarray]:
    """(buckets, denoised counts): data-aware partition, then one noisy total per bucket spread evenly."""
    buckets = l1_partition(x, epsilon, ratio, noise, lengths)
    out = np.zeros(len(x))
    for a, b in buckets:
        out[a:b] = (float(np.sum(x[a:b])) + noise(1 / (epsilon * (1 - ratio)))) / (b - a)
    return buckets, out


PARTITIONS = {"l1partition": "all", "l1approx": "powers"}


def equal_frequency(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows (value, bin): a value's bin by the share of rows below the middle of its own."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return placed(counts, "value", n="n").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__total")))).select(
        "value", F.least(F.floor((F.col("before") + F.col("n") / 2) * bins / F.col("__total")), F.lit(bins - 1)).cast("int").alias("bin"))
