"""Total variation distance of two tables, and error reports of query answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import edge_bin
from .marginals import all_marginals


def _tvd(p: DataFrame, q: DataFrame, on: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Half the L1 distance of two tables of shares (on.., p) and (on.., q), by groups."""
    both = p.join(q, list(on), "full").fillna(0.0, ["__p", "__q"])
    half = (F.sum(F.abs(F.col("__p") - F.col("__q"))) / 2).alias("tvd")
    return both.groupBy(*by).agg(half) if by else both.agg(F.coalesce(half, F.lit(0.0)).alias("tvd"))


def _shares(df: DataFrame, column, out: str) -> DataFrame:
    counts = df.select(column.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__total")))).select("value", (F.col("n") / F.col("__total")).alias(out))


def categorical_tvd(original: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """Over the values that are not null."""
    c = F.col(column).cast("string")
    return _tvd(_shares(original, c, "__p"), _shares(synthetic, c, "__q"), ["value"])


def combined_edges(original: DataFrame, synthetic: DataFrame, column: str, bins: int = 10) -> list[float]:
    x = original.select(F.col(column).cast("string").try_cast("double").alias("x")).unionAll(synthetic.select(F.col(column).cast("string").try_cast("double")))
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return [0.0, 1.0]
    return [low + (high - low) * k / bins for k in range(bins)] + [high] if high > low else [low, low + 1.0]


def numeric_tvd(original: DataFrame, synthetic: DataFrame, column: str, edges: Sequence[float] | None = None) -> DataFrame:
    """Over bins; the last is closed, and values outside the edges are left out before shares are taken."""
    edges = list(edges) if edges else combined_edges(original, synthetic, column)
    x = F.col(column).cast("string").try_cast("double")
    code = F.when((x >= float(edges[0])) & (x <= float(edges[-1])), edge_bin(x, edges))
    return _tvd(_shares(original, code, "__p"), _shares(synthetic, code, "__q"), ["value"])


def tvd_table(original: DataFrame, synthetic: DataFrame, kinds: dict[str, str], edges: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Rows (column, tvd) for the columns that both have, in two aggregations however many columns there are."""
    shared = [c for c in original.columns if c in synthetic.columns and c in kinds]
    if not shared:
        raise ValueError("the tables have no column in common")
    values = {}
    for c in shared:
        if kinds[c] == "categorical":
            values[c] = F.col(c).cast("string")
        else:
            cut = list((edges or {}).get(c) or combined_edges(original, synthetic, c))
            x = F.col(c).cast("string").try_cast("double")
            values[c] = F.when((x >= float(cut[0])) & (x <= float(cut[-1])), edge_bin(x, cut)).cast("string")

    def shares(df: DataFrame, out: str) -> DataFrame:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()))).alias("s")).select("s.column", "s.value").where("value is not null")
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(counts.groupBy("column").agg(F.sum("n").alias("__total")), "column").select("column", "value", (F.col("n") / F.col("__total")).alias(out))

    return _tvd(shares(original, "__p"), shares(synthetic, "__q"), ["column", "value"], ["column"])


def marginal_tvd(original: DataFrame, synthetic: DataFrame, attrs: Sequence[str], ways: Sequence[int]) -> DataFrame:
    """Rows (marginal, tvd) for every k-way marginal, joined on the values themselves."""
    attrs = list(attrs)

    def shares(df: DataFrame, out: str) -> DataFrame:
        counts = all_marginals(df.select(*(F.coalesce(F.col(a).cast("string"), F.lit("__NULL__")).alias(a) for a in attrs)), attrs, ways)
        counts = counts.select("marginal", *(F.coalesce(F.col(a), F.lit("")).alias(a) for a in attrs), "n")
        total = counts.groupBy("marginal").agg(F.sum("n").alias("__total"))
        return counts.join(total, "marginal").select("marginal", *attrs, (F.col("n") / F.col("__total")).alias(out))

    return _tvd(shares(original, "__p"), shares(synthetic, "__q"), ["marginal", *attrs], ["marginal"])


def answer_errors(real: DataFrame, fake: DataFrame, key: str = "query") -> DataFrame:
    """One row: largest, mean and median absolute error, mean squared error of answers by query."""
    gap = F.abs(F.col("real") - F.col("fake"))
    both = real.select(key, F.col("answer").alias("real")).join(fake.select(key, F.col("answer").alias("fake")), key)
    return both.agg(F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error"), F.median(gap).alias("median_error"), F.avg(gap * gap).alias("mean_squared"))


def grouped_tvd(tvd: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Mean TVD of two-way marginals by the kinds of their attributes."""
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    names = F.array_sort(F.transform(F.split("marginal", ","), lambda a: F.element_at(kind, a)))
    return tvd.groupBy(F.array_join(names, "-").alias("kinds")).agg(F.avg("tvd").alias("tvd"), F.count(F.lit(1)).alias("n"))
