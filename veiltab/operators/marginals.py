"""Marginals (k-way counts) and what is computed from them.

All marginals of a table come from one scan: grouping sets, or a roll-up of a finer marginal where the cells are
few. Counts are partial sums before they are shuffled, so the shuffle has a row per cell and task at most."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import noise
from .infer import NULL_TOKEN

#: Most grouping sets of one scan: rows are multiplied by their number before the partial sums.
SETS = 64


def marginal(df: DataFrame, attrs: Sequence[str], weight: str | None = None) -> DataFrame:
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*attrs).agg(total.alias("n"))


def key_grid(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """All combinations of the values of some encoded attributes (cells, not rows: their product is bounded by the domain)."""
    grid = df.select(attrs[0]).distinct()
    for a in attrs[1:]:
        grid = grid.crossJoin(df.select(a).distinct())
    return grid


def dense(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """The marginal with its empty cells."""
    return key_grid(df, attrs).join(marginal(df, attrs), list(attrs), "left").fillna(0, ["n"])


def normalized(counts: DataFrame, by: str = "n") -> DataFrame:
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(by).alias("__total")))).withColumn("p", F.col(by) / F.col("__total")).drop("__total")


def cell_key(attrs: Sequence[str], sizes: Sequence[int]) -> Column:
    """The row-major number of a cell."""
    key: Column = F.lit(0).cast("long")
    for a, size in zip(attrs, sizes, strict=True):
        key = key * size + F.col(a)
    return key


def rollup_to(counts: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """A coarser marginal from a finer one."""
    return counts.groupBy(*attrs).agg(F.sum("n").alias("n"))


def subsets(attrs: Sequence[str], ways: Iterable[int]) -> list[tuple[str, ...]]:
    return [c for k in ways for c in combinations(attrs, k)]


def all_marginals(df: DataFrame, attrs: Sequence[str], ways: Iterable[int]) -> DataFrame:
    """Rows (marginal, attrs as strings, n): every k-way marginal for k in ways, by grouping sets over one scan each SETS of them."""
    attrs, wanted = list(attrs), subsets(attrs, ways)
    out = None
    for a in range(0, len(wanted), SETS):
        some = wanted[a : a + SETS]
        grouped = df.select(*attrs).groupingSets([list(s) for s in some], *attrs).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*attrs).alias("gid"))
        bit = {x: 1 << (len(attrs) - 1 - k) for k, x in enumerate(attrs)}
        names = {sum(bit[x] for x in attrs if x not in s): ",".join(s) for s in some}
        name = F.create_map(*(v for g, s in names.items() for v in (F.lit(g).cast("long"), F.lit(s))))
        part = grouped.select(F.element_at(name, F.col("gid").cast("long")).alias("marginal"), *(F.col(x).cast("string").alias(x) for x in attrs), "n")
        out = part if out is None else out.unionAll(part)
    return out


def pair_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (a, b, n, na, nb, total) over the whole grid of two attributes, from their joint marginal alone."""
    joint = marginal(df, [a, b])
    one, two = rollup_to(joint, [a]).withColumnRenamed("n", "na"), rollup_to(joint, [b]).withColumnRenamed("n", "nb")
    total = joint.agg(F.sum("n").alias("total"))
    return one.crossJoin(two).join(joint, [a, b], "left").fillna(0, ["n"]).crossJoin(F.broadcast(total))


def indif(df: DataFrame, a: str, b: str) -> Column | DataFrame:
    """One row: the dependency of two attributes, the sum over cells of |n - na * nb / total|."""
    return pair_table(df, a, b).agg(F.sum(F.abs(F.col("n") - F.col("na") * F.col("nb") / F.col("total"))).alias("indif"), F.count(F.lit(1)).alias("num_cells"))


def indif_pairs(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Rows (a, b, indif, num_cells) for all pairs, from one scan for the cells and a count of the rows.

    Cells that no row has add na * nb / total each, in sum the total less what the cells that are there expect: so the
    grid is never made."""
    text = [F.coalesce(F.col(x).cast("string"), F.lit(NULL_TOKEN)).alias(x) for x in attrs]
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb")) for a, b in combinations(attrs, 2))))
    records = df.select(*text).groupBy(*attrs).agg(F.count(F.lit(1)).alias("n"))
    cells = records.select("n", pairs.alias("p")).groupBy("p").agg(F.sum("n").alias("n")).select("p.*", "n")
    cells = cells.withColumn("na", F.sum("n").over(Window.partitionBy("a", "b", "va"))).withColumn("nb", F.sum("n").over(Window.partitionBy("a", "b", "vb")))
    cells = cells.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).withColumn("expected", F.col("na") * F.col("nb") / F.col("total"))
    return cells.groupBy("a", "b").agg(
        (F.sum(F.abs(F.col("n") - F.col("expected")) - F.col("expected")) + F.first("total")).alias("indif"), (F.count_distinct("va") * F.count_distinct("vb")).alias("num_cells"))


def entropy(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """One row: the entropy of a marginal in nats."""
    return normalized(marginal(df, attrs)).agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = pair_table(df, a, b).where("n > 0")
    return cells.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))).alias("mutual_information"))


def pair_tvd(df: DataFrame, a: str, b: str) -> DataFrame:
    """Half the distance from independence, as a share of the rows."""
    return indif(df, a, b).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("rows")))).select((F.col("indif") / (2.0 * F.col("rows"))).alias("tvd"))


def l1_distance(x: DataFrame, y: DataFrame, attrs: Sequence[str]) -> DataFrame:
    both = x.select(*attrs, F.col("n").alias("nx")).join(y.select(*attrs, F.col("n").alias("ny")), list(attrs), "full").fillna(0, ["nx", "ny"])
    return both.agg(F.sum(F.abs(F.col("nx") - F.col("ny"))).alias("l1"))


def noisy(counts: DataFrame, attrs: Sequence[str], sigma: float, seed: str, clip: bool = False) -> DataFrame:
    """A dense marginal with hash noise, for tests; releases draw theirs on the driver."""
    value = F.col("n") + noise.gaussian_hash(F.concat_ws("|", *(F.col(a).cast("string") for a in attrs)), sigma, seed)
    return counts.withColumn("noisy", F.greatest(value, F.lit(0.0)) if clip else value)


def top_by_gumbel(scores: DataFrame, name: str, score: str, q: int, scale: float, seed: str) -> DataFrame:
    """Report-noisy-max: the q best of score plus Gumbel noise."""
    return scores.withColumn("noisy", F.col(score) + noise.gumbel_hash(F.col(name), scale, seed)).orderBy(F.desc("noisy"), name).limit(q)
