"""Column metadata of a table, from one aggregation per column in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The thresholds and tokens of the metadata contract.
INT_FEW, INT_SPARSE_SHARE, INT_SPARSE_MOST, FLOAT_FEW = 20, 0.05, 100, 10
NULL_TOKEN, OTHER_TOKEN = "__NULL__", "__OTHER__"
PREVIEW = 50


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    kind: str
    reason: str
    distinct: int
    size: int
    rows: int
    nulls: int


def decide(dtype: T.DataType, distinct: int, rows: int) -> tuple[str, str]:
    """(kind, reason) by the number of distinct values, a null among them."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if distinct < INT_FEW:
            return "categorical", "integer_unique_below_threshold"
        if rows and distinct / rows < INT_SPARSE_SHARE and distinct < INT_SPARSE_MOST:
            return "categorical", "integer_sparse_unique"
        return "numerical", "integer_dense_unique"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return ("categorical", "float_unique_low") if distinct < FLOAT_FEW else ("numerical", "float_unique_high")
    if isinstance(dtype, (T.BooleanType, T.DecimalType)):
        return "numerical", "other_numeric"
    return "categorical", "non_numeric"


def counted(df: DataFrame) -> DataFrame:
    """Rows (name, size: distinct values, nulls, rows). Each column is counted by value on its own: the scan reads that
    column alone, and partial counts are what is shuffled, where distinct counts side by side would copy every row once
    per column. A table that is costly to make should be written first, as its plan runs once per column."""
    parts = []
    for c in df.columns:
        values = df.groupBy(F.col(f"`{c}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls")
        parts.append(values.agg(F.count("value").alias("size"), nulls, F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit(c).alias("name"), "size", "nulls", "rows"))
    return reduce(DataFrame.unionAll, parts)


def infer(df: DataFrame) -> list[ColumnInfo]:
    types, out = {f.name: f.dataType for f in df.schema.fields}, []
    for r in counted(df).collect():  # a row per column
        distinct = r["size"] + (r["nulls"] > 0)
        kind, reason = decide(types[r["name"]], distinct, r["rows"])
        out.append(ColumnInfo(r["name"], kind, reason, distinct, r["size"], r["rows"], r["nulls"]))
    return out


def inferred(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c.name, c.kind, c.reason, c.distinct, c.size) for c in infer(df)], "name string, kind string, reason string, n_distinct long, size long")


def canonical(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NULL_TOKEN))


def value_counts(df: DataFrame, column: str, most: int | None = PREVIEW) -> DataFrame:
    out = df.groupBy(canonical(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(most) if most else out


def first_seen(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Categories with their first row, in order of appearance."""
    return df.groupBy(canonical(F.col(column)).alias("value")).agg(F.min(row_id).alias("first_row")).orderBy("first_row")


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))


def candidate_summary(df: DataFrame, column: str) -> DataFrame:
    """min and max of what reads as a number; nulls if nothing does."""
    c = F.col(column).cast("string").try_cast("double")
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"))


def split_by_kind(df: DataFrame, info: list[ColumnInfo]) -> DataFrame:
    """Numerical columns first, categorical ones after them as strings."""
    num, cat = ([c.name for c in info if c.kind == k] for k in ("numerical", "categorical"))
    return df.select(*num, *(canonical(F.col(c)).alias(c) for c in cat))
