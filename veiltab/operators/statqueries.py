"""Counting queries other than marginals: prefixes, half-spaces, ranges, moments, Fourier features, kernels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import placed


def share(df: DataFrame, queries: dict[str, Column]) -> DataFrame:
    """Rows (query, answer): the share of rows for which each predicate holds, in one pass."""
    one = df.agg(*(F.avg(F.coalesce(q, F.lit(False)).cast("int")).alias(n) for n, q in queries.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("query"), F.col(n).alias("answer")) for n in queries))))


def prefix(thresholds: dict[str, float], fixed: dict[str, object] | None = None) -> Column:
    """All of x < t, and the given categories."""
    out: Column = F.lit(True)
    for c, t in thresholds.items():
        out = out & (F.col(c) < float(t))
    for c, v in (fixed or {}).items():
        out = out & (F.col(c) == v)
    return out


def projection(weights: dict[str, float], bias: float) -> Column:
    out: Column = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.col(c).cast("double") * float(w)
    return out - float(bias)


def halfspace(weights: dict[str, float], bias: float, fixed: dict[str, object] | None = None) -> Column:
    return prefix({}, fixed) & (projection(weights, bias) > 0)


def sigmoid(x: Column, slope: float) -> Column:
    return 1 / (1 + F.exp(-slope * x))


def smooth_halfspace(df: DataFrame, weights: dict[str, float], bias: float, slope: float) -> DataFrame:
    return df.agg(F.avg(sigmoid(projection(weights, bias), slope)).alias("answer"))


def smooth_prefix(df: DataFrame, thresholds: dict[str, float], slope: float) -> DataFrame:
    product: Column = F.lit(1.0)
    for c, t in thresholds.items():
        product = product * sigmoid(F.lit(float(t)) - F.col(c), slope)
    return df.agg(F.avg(product).alias("answer"))


def conditional(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows (features, target, n, p): counts and the share of the target within its features."""
    counts = df.groupBy(*features, target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*features)))


# Linear workloads over the cells of one attribute: windows over its marginal, not over the rows.


def prefix_sums(counts: DataFrame, attr: str) -> DataFrame:
    return placed(counts, attr, n="n").withColumn("prefix", F.col("before") + F.col("n")).drop("rank", "before")


def suffix_sums(counts: DataFrame, attr: str) -> DataFrame:
    whole = F.broadcast(counts.agg(F.sum("n").alias("__total")))
    return placed(counts, attr, n="n").crossJoin(whole).withColumn("suffix", F.col("__total") - F.col("before")).drop("rank", "before", "__total")


def width_sums(counts: DataFrame, attr: str, width: int) -> DataFrame:
    """Sums of `width` neighbouring cells, where so many follow: differences of running sums."""
    rows = placed(counts, attr, n="n")
    last = rows.select((F.col("rank") - (width - 1)).alias("rank"), (F.col("before") + F.col("n")).alias("__upto"))
    return rows.join(last, "rank").select(attr, (F.col("__upto") - F.col("before")).alias("total"))


def all_ranges(counts: DataFrame, attr: str) -> DataFrame:
    """Rows (lo, hi, total) for all lo <= hi: differences of prefix sums of a marginal (cells squared, by definition)."""
    upto = prefix_sums(counts, attr)
    lo = upto.select(F.col(attr).alias("lo"), (F.col("prefix") - F.col("n")).alias("before"))
    hi = upto.select(F.col(attr).alias("hi"), "prefix")
    return lo.join(hi, F.col("lo") <= F.col("hi")).select("lo", "hi", (F.col("prefix") - F.col("before")).alias("total"))


def moments(df: DataFrame, column: str, most: int) -> DataFrame:
    return df.agg(*(F.sum(F.pow(F.col(column), F.lit(float(k)))).alias(f"m{k}") for k in range(most + 1)))


def fourier_mean(df: DataFrame, columns: Sequence[str], frequencies: Sequence[Sequence[float]], label: str | None = None) -> DataFrame:
    """Mean cosine and sine features for fixed frequencies, by label if one is given."""
    sums = []
    for k, ws in enumerate(frequencies):
        z: Column = F.lit(0.0)
        for c, w in zip(columns, ws, strict=True):
            z = z + F.col(c) * float(w)
        sums += [F.avg(F.cos(z)).alias(f"cos{k}"), F.avg(F.sin(z)).alias(f"sin{k}")]
    return df.groupBy(label).agg(*sums) if label else df.agg(*sums)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy()))


def distribution_rank(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, cume_dist): the share of rows at or below each value, from its counts."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("__total")))
    return placed(counts, "value", n="n").crossJoin(total).select("value", ((F.col("before") + F.col("n")) / F.col("__total")).alias("cume_dist"))


def mmd_linear(x: DataFrame, y: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Squared maximum mean discrepancy with the linear kernel: the distance of the means, with no pairs of rows."""
    a = x.agg(*(F.avg(c).alias(f"x{k}") for k, c in enumerate(columns)))
    b = y.agg(*(F.avg(c).alias(f"y{k}") for k, c in enumerate(columns)))
    total: Column = F.lit(0.0)
    for k in range(len(columns)):
        total = total + F.pow(F.col(f"x{k}") - F.col(f"y{k}"), F.lit(2.0))
    return a.crossJoin(b).select(total.alias("mmd2"))


def support(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """The distinct records with their share of the rows."""
    counts = df.groupBy(*attrs).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__t")))).withColumn("weight", F.col("n") / F.col("__t")).drop("__t")


def missing(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Values of a category list (column `value`) that no row has."""
    return values.join(df.select(F.col(column).alias("value")).distinct(), "value", "left_anti")


def sparse(answers: DataFrame, threshold: float) -> DataFrame:
    return answers.where(F.col("noisy") > threshold)


def trimmed(answers: DataFrame, workload: str, limit: float) -> DataFrame:
    """Per workload, by falling value, what keeps the running sum below limit."""
    upto = F.sum("noisy").over(Window.partitionBy(workload).orderBy(F.desc("noisy"), "query").rowsBetween(Window.unboundedPreceding, 0))
    return answers.withColumn("__upto", upto).where(F.col("__upto") < limit).drop("__upto")
