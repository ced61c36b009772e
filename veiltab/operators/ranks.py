"""Ranks and running sums of tables of distinct values, and ranks of rows inside cells, without a task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written

#: Most rows of a table that one task orders.
ONE_TASK = 1_000_000
#: Parts that the rows of one cell are ranked in.
PARTS = 64


def placed(table: DataFrame, *order: Column | str, n: str | None = None, one_task: int | None = None) -> DataFrame:
    """table with `rank`, a row's place from 0 in the given order (of distinct keys), and `before`, the sum of n before it.

    The table is written first: a range partitioning that is evaluated twice may cut elsewhere the second time. Up to
    one_task rows one window does; more are dealt by ranges, ranked there, and each range starts where the last ended."""
    one_task = ONE_TASK if one_task is None else one_task
    table = written(table, "placed")
    total = F.col(n) if n else F.lit(0)
    before = lambda w: F.coalesce(F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if table.count() <= one_task:
        w = Window.orderBy(*order)
        return table.select("*", (F.row_number().over(w) - 1).cast("long").alias("rank"), before(w).alias("before"))
    parts = written(table.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = sorted(parts.groupBy("__part").agg(F.count(F.lit(1)), F.sum(total)).collect())  # a row per partition
    starts, rows, upto = [], 0, 0
    for part, count, own in sums:
        starts.append(F.struct(F.lit(part).alias("__part"), F.lit(rows).cast("long").alias("__rows"), F.lit(upto).alias("__upto")))
        rows, upto = rows + count, upto + (own or 0)
    offsets = F.broadcast(table.sparkSession.range(1).select(F.inline(F.array(*starts))))
    w = Window.partitionBy("__part").orderBy(*order)
    out = parts.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).withColumn("before", before(w)).join(offsets, "__part")
    return out.select(*table.columns, (F.col("rank") + F.col("__rows")).alias("rank"), (F.col("before") + F.col("__upto")).alias("before"))


def in_cells(df: DataFrame, cell: str, row_id: str, seed: int, parts: int = PARTS) -> DataFrame:
    """df with __rank (from 1, in an order given by a stable hash of the row id) and __size of its cell.

    A cell's rows are dealt into parts by that hash, so that a cell with most of the rows is many tasks' work."""
    drawn = F.xxhash64(row_id, F.lit(seed))
    rows = df.withColumn("__draw", drawn).withColumn("__part", F.pmod(F.col("__draw"), F.lit(parts)).cast("int"))
    counts = rows.groupBy(cell, "__part").agg(F.count(F.lit(1)).alias("__n"))  # cells * parts rows at most
    w = Window.partitionBy(cell)
    starts = counts.select(cell, "__part", (F.sum("__n").over(w.orderBy("__part")) - F.col("__n")).alias("__start"), F.sum("__n").over(w).alias("__size"))
    own = F.row_number().over(Window.partitionBy(cell, "__part").orderBy("__draw", row_id))
    return rows.withColumn("__own", own).join(starts, [cell, "__part"]).withColumn("__rank", F.col("__own") + F.col("__start")).drop("__draw", "__part", "__own", "__start")
