"""Hierarchies of an attribute's values: levels of ever finer groups of like frequency, and roll-up to a level."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import lookup_join


def hierarchy(df: DataFrame, column: str, fan: int = 2, levels: int = 3) -> DataFrame:
    """Rows (value, n, path): in each group of a level its values, in order, are split into `fan` runs of near-equal
    counts (a value goes where the middle of its run lies). path holds a group number per level.

    The rows are counted once; windows run over the distinct values only. Nulls belong to no group."""
    if fan < 2 or levels < 1:
        raise ValueError("fan must be at least 2 and levels at least 1")
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("path", F.array().cast("array<int>"))
    for _ in range(levels):
        group = Window.partitionBy("path")
        upto, total = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("n").over(group)
        out = out.withColumn("__part", F.floor((2 * upto - F.col("n")) * fan / (2 * total)).cast("int")).withColumn("path", F.concat("path", F.array("__part"))).drop("__part")
    return out


def group_at(path: Column, fan: int, level: int) -> Column:
    """A group's number within its level."""
    return F.aggregate(F.slice(path, 1, level), F.lit(0).cast("long"), lambda a, x: a * fan + x)


def rolled_up(df: DataFrame, column: str, table: DataFrame, level: int, fan: int = 2, out: str | None = None, rows: int | None = None) -> DataFrame:
    """df with column's group at a level; rows: those of the table if known, so that it is broadcast only when small."""
    rows = table.count() if rows is None else rows
    sent = table.select(F.col("value").alias(column), group_at(F.col("path"), fan, level).alias("__group"))
    name = out or column
    joined = lookup_join(df, sent, column, rows)
    return joined.withColumn(name, F.col("__group")).drop("__group") if name != column else joined.drop(column).withColumnRenamed("__group", column).select(*df.columns)


def rolled_back(df: DataFrame, column: str, table: DataFrame, level: int, row_id: Column, fan: int = 2, seed: int = 0) -> DataFrame:
    """Groups back to values, by each value's share of its group and a stable hash of row_id."""
    group = Window.partitionBy("__group")
    upto = table.withColumn("__group", group_at(F.col("path"), fan, level))
    upto = upto.withColumn("__upto", F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("n").over(group))
    values = upto.groupBy("__group").agg(F.array_sort(F.collect_list(F.struct("__upto", "value"))).alias("__values"))  # a group of the domain
    u = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    pick = F.get(F.filter("__values", lambda v: v["__upto"] > u), F.lit(0))["value"]
    joined = df.withColumnRenamed(column, "__group").join(values, "__group", "left").withColumn(column, pick)
    return joined.select(*df.columns)


def to_json(table: DataFrame) -> str:
    """The hierarchy as text: value to path."""
    return json.dumps({str(r["value"]): list(r["path"]) for r in table.orderBy("value").collect()})  # a row per value of the domain
