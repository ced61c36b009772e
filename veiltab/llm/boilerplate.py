"""Boilerplate lines by site-relative frequency, in DataFrame functions only.

Lines are trimmed of blanks, tabs and carriage returns at both ends to be compared. Per host the number of pages
that hold a line is divided by the host's pages; lines above PERCENT of them, on at least PAGES pages, are dropped
from every page of that host, the others stay as they were. Equal texts of a host are one page in both numbers: else
a page copied often enough would lose all its lines in every copy.

Counts are partial sums per (host, line hash) before they are shuffled, so a host with a third of all rows is no hot
group. A host has at most (its lines per page) / PERCENT such lines, so they are kept as one short array per host; that
table is broadcast when its measured size allows, and joined otherwise.

Edge cases. A null host is a host like any other. A null text stays null and has no lines. A blank line is never
boilerplate. A line counts once per page however often it is repeated there. Repeated rows are one page.
A page that loses all its lines stays, with the empty text. An empty table gives no rows. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A line goes if it stands on more than this percentage of a host's pages, and on at least PAGES of them.
PERCENT, PAGES = 5, 4
_BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def repeated(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, pages: int = PAGES) -> DataFrame:
    """A row per host with boilerplate: (host, dropped: hashes of its lines), as a written table."""
    own = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    held = F.filter(_lines(F.col(text)), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0)
    page = F.xxhash64(F.col(text)).alias("page")
    filled = docs.where(F.col(text).isNotNull())
    lines = filled.select(own, page, F.explode(F.array_distinct(F.transform(held, _hash))).alias("line")).groupBy("host", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= pages)
    totals = filled.select(own, page).groupBy("host").agg(F.count_distinct("page").alias("total"))
    return common.written(lines.join(totals, "host").where(F.col("n") * 100 > F.col("total") * percent).groupBy("host").agg(F.collect_set("line").alias("dropped")), "boilerplate")


def cleaned(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, pages: int = PAGES) -> DataFrame:
    """docs with its lines dropped from text, and columns n_lines and n_dropped (of those names, docs' own go)."""
    found = repeated(docs, host, text, percent, pages)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    sent = common.small(found.select(F.col("host").alias("__host"), F.col("dropped").alias("__dropped")))
    rows = docs.join(sent, F.coalesce(docs[host].cast("string"), F.lit("")) == F.col("__host"), "left")
    lines = _lines(F.col(text))
    stay = F.when(F.col("__dropped").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(F.btrim(x, F.lit(_BLANKS))) == 0) | ~F.array_contains("__dropped", _hash(x))))
    rows = rows.withColumn("__stay", stay)
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return rows.select(*(F.array_join("__stay", "\n").alias(c) if c == text else F.col(f"`{c}`") for c in names),
                       F.when(F.col(text).isNull(), F.lit(0)).otherwise(n).alias("n_lines"),
                       F.when(F.col(text).isNull(), F.lit(0)).otherwise(n - F.size("__stay")).alias("n_dropped"))


def op9_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows; n_chars is counted anew where lines went."""
    out = cleaned(docs)
    return out.select(*(F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


SQL = f"""
WITH lines AS (SELECT DISTINCT source, text, trim(line, ' ' || chr(9) || chr(13)) AS line
               FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM documents)),
boiler AS (SELECT l.source, l.line FROM (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line) l
           JOIN (SELECT source, count(DISTINCT text) AS total FROM documents GROUP BY source) t ON l.source = t.source
           WHERE n >= {PAGES} AND n * 100 > total * {PERCENT}),
placed AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
kept AS (SELECT p.doc_id, p.line, p.k, b.line IS NULL AS stays FROM placed p
         LEFT JOIN boiler b ON b.source = p.source AND b.line = trim(p.line, ' ' || chr(9) || chr(13)))
SELECT d.doc_id, d.source, coalesce(k.text, '') AS text, k.n_lines, k.n_dropped FROM documents d JOIN
  (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE stays) AS text, count(*) AS n_lines,
          count(*) FILTER (WHERE NOT stays) AS n_dropped FROM kept GROUP BY doc_id) k ON d.doc_id = k.doc_id
"""
