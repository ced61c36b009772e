"""What the corpus operators share: size-checked broadcasts, bounded Arrow batches, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.plans.tables import Scratch, bytes_of, forget, fresh_path, scratch, written

__all__ = ["Scratch", "bytes_of", "components", "forget", "fresh_path", "lower_ascii", "mapped", "remainder", "scratch", "small", "written"]

#: Most bytes that a table may take in an executor's memory to be sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch to and from Python, and its bytes: JVM buffers and Python's copies grow with both.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small(df: DataFrame, limit: int = BROADCAST_BYTES, row_bytes: int | None = None) -> DataFrame:
    """df, a written table, with a broadcast hint if it fits `limit` bytes of memory; else a shuffled join takes it.

    Its size in memory is counted as rows times row_bytes if that is given; else as four times that of its files (they
    are compressed), but 48 bytes a row at least."""
    rows = df.count()
    size = rows * row_bytes if row_bytes else max(4 * bytes_of(df), 48 * rows)
    return F.broadcast(df) if size <= limit else df.hint("shuffle_merge")


def freed() -> None:
    """Gives back what a Python worker, which is used again, holds but does not need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow with batches within BATCHES (settings of the session, lowered where they are higher)."""
    conf = df.sparkSession.conf
    for name, most in BATCHES.items():
        now = conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(parts)
        freed()

    return df.mapInArrow(run, schema)


def remainder(doc_id: Column | str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % by


def lower_ascii(text: Column) -> Column:
    """A-Z only, as the contracts ask; a null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star rounds, so their number grows with the logarithm of a component's
    diameter and no node's neighbours are ever held together: each round is a minimum by key and a join.
    Links may repeat, be listed either way or join a node to itself (that gives no row). No links: no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())

    now = mark(edges)
    for _ in range(rounds):
        if not now[0]:
            break
        # u > v in every row. Large star: the larger neighbours of a node go to its smallest neighbour.
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small_star.where("u <> v").distinct(), "star")
        forget(edges)
        edges, last, now = after, now, mark(after)
        if now == last:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots), "components")
    forget(edges)
    return out


#: DuckDB's connected components of links(a, b), as rows (node, component): the smallest id reachable.
COMPONENTS_SQL = """
reach(node, other) AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT r.node, l.other
  FROM reach r JOIN (SELECT a AS node, b AS other FROM links UNION SELECT b, a FROM links) l ON r.other = l.node),
found AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)
"""
#: The text of a row with A-Z lowered, a null as the empty one.
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
