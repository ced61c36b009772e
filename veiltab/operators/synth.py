"""Records from marginals.

Whatever the number of records, they are a DataFrame: ids from a range, values by comparing each id's place with a
table of cumulative counts. The tables of counts are small, so they go along as literals; no rows are collected."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import in_cells


#: Of the permutation of row ids.
ROUNDS = 32


def whole_counts(shares: np.ndarray, n: int) -> np.ndarray:
    """n split by shares into whole numbers of exactly that sum: differences of rounded running sums."""
    shares = np.maximum(np.asarray(shares, float).ravel(), 0)
    if not shares.sum():
        shares = np.ones_like(shares)
    upto = np.rint(np.cumsum(shares) / shares.sum() * n).astype(np.int64)
    upto[-1] = n
    return np.diff(np.concatenate(([0], upto)))


def value_at(place: Column, counts: np.ndarray) -> Column:
    """The code whose run of `counts` holds a place from 0."""
    ends = np.cumsum(counts)
    if len(ends) <= 64:
        out: Column = F.lit(0)
        for e in ends[:-1]:
            out = out + (place >= int(e)).cast("int")
        return out.cast("int")
    table = F.array(*(F.lit(int(e)) for e in ends[:-1]))
    return F.size(F.filter(table, lambda e: e <= place)).cast("int")


def initial_records(spark: SparkSession, n: int, one_way: dict[str, np.ndarray], seed: int = 0, exact: bool = True) -> DataFrame:
    """n records with independent attributes that have the given counts: exactly or on average."""
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    for k, (attr, shares) in enumerate(one_way.items()):
        counts = whole_counts(shares, n)
        if exact:
            rows = rows.withColumn(attr, value_at(place_of(n, seed + k), counts))
        else:
            rows = rows.withColumn(attr, value_at(F.pmod(F.xxhash64(F.col("row_id"), F.lit(seed + k)), F.lit(n)), counts))
    return rows


def place_of(n: int, salt: int) -> Column:
    """A keyed permutation of row ids 0 .. n-1 without sorting: rounds of swap-or-not (Hoang, Morris and Rogaway 2012).

    A round pairs each x with its mirror key - x modulo n and swaps the two or not, by a hash of the larger."""
    keys = F.array(*(F.lit(int(k)) for k in np.random.default_rng(salt).integers(0, max(n, 1), ROUNDS)))

    def swapped(x: Column, key: Column) -> Column:
        mirror = F.pmod(key - x, F.lit(n))
        return F.when(F.xxhash64(F.greatest(x, mirror), key, F.lit(salt)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(keys, F.col("row_id"), swapped)


def independent(spark: SparkSession, n: int, sizes: dict[str, int], seed: int = 0) -> DataFrame:
    """n records with uniform codes, by a stable hash of the row id."""
    return spark.range(n).select(F.col("id").alias("row_id"), *(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(a)), F.lit(s)).cast("int").alias(a) for a, s in sizes.items()))


def append_attribute(df: DataFrame, anchors: Sequence[str], attr: str, joint: np.ndarray, sizes: Sequence[int], seed: int = 0) -> DataFrame:
    """A new attribute by its distribution given the anchors: within each anchor cell the rows are ranked by a stable
    hash, and exact counts are dealt by rank. joint has a row per anchor cell (row-major)."""
    joint = np.asarray(joint, float).reshape(-1, np.shape(joint)[-1])
    empty = joint.sum(axis=1) <= 0
    joint[empty] = joint.sum(axis=0) if joint.sum() > 0 else 1.0
    upto = np.cumsum(np.maximum(joint, 0), axis=1)
    upto = upto / upto[:, -1:]
    spark = df.sparkSession
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(upto)], "__cell long, __upto array<double>")
    cell: Column = F.lit(0).cast("long")
    for a, s in zip(anchors, sizes, strict=True):
        cell = cell * s + F.col(a)
    ranked = in_cells(df.withColumn("__cell", cell), "__cell", "row_id", seed)
    code = F.size(F.filter("__upto", lambda u: F.rint(u * F.col("__size")) < F.col("__rank")))
    out = ranked.join(F.broadcast(table), "__cell").withColumn(attr, F.least(code, F.lit(joint.shape[1] - 1)).cast("int"))
    return out.drop("__cell", "__rank", "__size", "__upto")


# Gradual update of records to match marginals.


def alpha_schedule(name: str, iteration: int) -> float:
    # The step sizes by schedule name.
    table: dict[str, Callable[[int], float]] = {
        "U1": lambda i: 1.0, "U2": lambda i: 0.98**i, "U3": lambda i: 0.98**i if i < 100 else 0.98**100 * 0.99 ** (i - 100), "U4": lambda i: 0.84 ** (i // 20), "U5": lambda i: float(np.exp(-0.008 * i)), "U6": lambda i: 1 / (1 + 0.02 * i),
        "U7": lambda i: float(1 / np.sqrt(0.12 * i + 1)), "U8": lambda i: 1.0, "U9": lambda i: 0.2, "U10": lambda i: 0.3, "U11": lambda i: 0.5, "U12": lambda i: 0.1,
    }
    return table[name](iteration)


def cell_changes(actual: np.ndarray, target: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows to add, rows to free) per cell, whole numbers of equal sums; empty cells in demand are served first."""
    actual, target = np.asarray(actual, float).ravel(), np.asarray(target, float).ravel()
    need = np.where(target > actual, np.where(actual > 0, np.minimum(target - actual, alpha * actual), target), 0.0)
    over = np.where(target < actual, actual - target, 0.0)
    moves = int(min(np.rint(need.sum()), np.floor(over.sum())))
    if moves <= 0:
        return np.zeros(len(actual), np.int64), np.zeros(len(actual), np.int64)
    first = np.where(actual == 0, need, 0.0)
    served = whole_counts(first, min(moves, int(np.rint(first.sum())))) if first.sum() >= 0.5 else np.zeros(len(actual), np.int64)
    left, rest = moves - int(served.sum()), np.where(actual > 0, need, 0.0)
    add = served + (whole_counts(rest, left) if left and rest.sum() > 0 else 0)
    return add, np.minimum(whole_counts(over, int(add.sum())), actual.astype(np.int64))


def updated(records: DataFrame, attrs: Sequence[str], sizes: Sequence[int], target: np.ndarray, alpha: float, seed: int) -> DataFrame:
    """One update: in cells of too many rows some are freed (the first by a stable hash) and take the wanted cells' values."""
    cell: Column = F.lit(0).cast("long")
    for a, s in zip(attrs, sizes, strict=True):
        cell = cell * s + F.col(a)
    coded = records.withColumn("__cell", cell)
    actual = np.zeros(int(np.prod(sizes)), np.int64)
    for r in coded.groupBy("__cell").count().collect():  # a row per cell
        actual[r["__cell"]] = r["count"]
    add, free = cell_changes(actual, target, alpha)
    add = add.copy()
    total = int(min(add.sum(), free.sum()))
    if total == 0:
        return records
    frees = {int(c): int(n) for c, n in enumerate(free) if n}
    start, at = {}, 0
    for c, n in frees.items():
        start[c], at = at, at + n
    table = records.sparkSession.createDataFrame([(c, n, start[c]) for c, n in frees.items()], "__cell long, __free long, __start long")
    marked = in_cells(coded, "__cell", "row_id", seed).join(F.broadcast(table), "__cell", "left")
    freed = F.col("__rank") <= F.coalesce("__free", F.lit(0))
    wanted = np.repeat(np.arange(len(add)), add)[:total]
    ends = np.flatnonzero(np.diff(np.concatenate((wanted, [-1])))) + 1  # runs of equal wanted cells
    cells, bounds = [int(wanted[e - 1]) for e in ends], [int(e) for e in ends]
    place = F.col("__start") + F.col("__rank") - 1
    run = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda e: e <= place))
    new = F.when(freed & (place < total), F.get(F.array(*map(F.lit, cells)), run)).otherwise(F.col("__cell"))
    out = marked.withColumn("__new", new)
    stride = 1
    for a, s in reversed(list(zip(attrs, sizes, strict=True))):
        out = out.withColumn(a, F.pmod(F.floor(F.col("__new") / stride), F.lit(s)).cast("int"))
        stride *= s
    return out.select(*records.columns)


def gradual_update(records: DataFrame, sizes: dict[str, int], margins: dict[tuple[str, ...], np.ndarray], iterations: int = 5, schedule: str = "U4", seed: int = 0, worst_first: bool = False, errors: list[dict] | None = None, progress: Callable[[int, float], None] | None = None) -> DataFrame:
    """Rounds over all marginals; lineage is cut by a written table each round, in the folder that executors share.

    worst_first: in each round those of largest error first. errors: gets the L1 error of each before each round."""
    from ..plans.tables import forget, written
    from .gum import by_error

    last = None
    for i in range(iterations):
        order = list(margins)
        if worst_first or errors is not None:
            found = by_error(records, sizes, margins)
            order = [c for c, _ in found] if worst_first else order
            if errors is not None:
                errors += [{"round": i, "marginal": c, "error": e} for c, e in found]
        for k, attrs in enumerate(order):
            target = margins[attrs]
            records = updated(records, attrs, [sizes[a] for a in attrs], target, alpha_schedule(schedule, i), seed + 1000 * i + k)
        records, before = written(records, "records"), last
        last = records
        if before is not None:
            forget(before)
        if progress:
            progress(i + 1, (i + 1) / iterations)
    return records
