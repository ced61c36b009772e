"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over some tokens; the tokens it ignores may differ. The masks are lossless: wherever the tokens
that may differ in a window stand, some seed in it is whole. Every position of every document and of every benchmark item gives one hash per mask; hashes
that both have are hits, and each names an item and a diagonal (place in the document less place in the item). On a
diagonal, document and item are compared token by token in windows of WINDOW tokens (or the item's length if it is
shorter): a document is contaminated if at least PERCENT of some window's tokens agree. Items shorter than SPAN
are seeds as a whole, and must agree whole.

The seed table follows the benchmark. It is broadcast when its measured size allows; otherwise the hashes are joined
by shuffle, from which only (document, item, diagonal) goes on.

Edge cases. A null or empty text or item has no tokens and matches nothing. Rows that share an id are judged together.
Repeated items count once per item_id. Whole texts are searched. An empty table gives no rows; an empty benchmark
contaminates nothing. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words: splitting there takes a small part of the time of finding every word.
GAP = WORD.replace("^", "")
SPAN, WINDOW, PERCENT = 9, 13, 80
#: For items of WINDOW tokens or more: any 13 tokens of which any 2 differ hold a whole seed of one of them.
MASKS = ("11101011", "110100111")
#: For items from SPAN to WINDOW - 1: so do any 10 tokens of which any 2 differ, and any 9 of which any one does.
LIGHT = ("111011", "1101011", "1110011")


def tokens(text: Column) -> Column:
    """Hashes of the words, A-Z lowered, without punctuation."""
    return F.transform(F.filter(F.split(common.lower_ascii(text), GAP), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """rows (id, tokens) to (id, at, seed): a seed of each mask at each position where the mask fits.

    Rows without tokens go here: a filter on tokens before would be pushed below and find the words of every text twice."""
    shortest = min(map(len, masks))
    places = F.when(F.size("tokens") >= shortest, F.sequence(F.lit(0), F.size("tokens") - shortest))
    placed = rows.select("id", "tokens", F.explode(places).alias("at"))

    def seed(mask: str) -> Column:
        return F.when(F.col("at") + len(mask) <= F.size("tokens"), F.xxhash64(F.lit(int(mask, 2)), *(F.get("tokens", F.col("at") + o) for o, bit in enumerate(mask) if bit == "1")))

    return placed.select("id", "at", F.explode(F.array(*(seed(m) for m in masks))).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id, item_id, agreed: most tokens that agree in a window): the verified overlaps, one per document and item. A written table."""
    with common.scratch() as own:
        bench = items.select(F.col(item_key).cast("long").alias("item_id"), tokens(F.col(item_text)).alias("item")).where(F.size("item") > 0)
        bench = own.written(bench.withColumn("n", F.size("item")), "items")
        short = [r.n for r in bench.where(F.col("n") < SPAN).select("n").distinct().orderBy("n").collect()]  # SPAN - 1 lengths at most
        light = LIGHT if bench.where(F.col("n").between(SPAN, WINDOW - 1)).take(1) else ()
        masks = (*MASKS, *light, *("1" * n for n in short))
        named = bench.select(F.col("item_id").alias("id"), F.col("item").alias("tokens"))
        whole = seeds(named.where(F.size("tokens") >= WINDOW), MASKS)
        if light:
            whole = whole.unionAll(seeds(named.where(F.size("tokens").between(SPAN, WINDOW - 1)), light))
        for n in short:
            whole = whole.unionAll(seeds(named.where(F.size("tokens") == n), ("1" * n,)))
        table = own.written(whole.select("seed", F.col("id").alias("item_id"), F.col("at").alias("item_at")).distinct(), "seeds")
        rows = docs.select(F.col(key).cast("long").alias("id"), tokens(F.col(text)).alias("tokens"))
        hits = seeds(rows, masks).join(common.small(table), "seed").select("id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
        hits = own.written(hits, "hits")
        ids = own.written(hits.select("id").distinct(), "ids")
        again = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(common.small(ids), "id", "left_semi").select("id", tokens(F.col("text")).alias("tokens"))
        pairs = hits.join(common.small(bench), "item_id").join(again, "id")
        size = F.least(F.lit(WINDOW), F.col("n"))
        same = F.transform("item", lambda x, i: F.when((i + F.col("diagonal") >= 0) & (F.get("tokens", i + F.col("diagonal")) == x), 1).otherwise(0))
        window = lambda s: F.aggregate(F.slice("same", s, F.col("size")), F.lit(0), lambda a, b: a + b)
        checked = pairs.withColumn("size", size).withColumn("same", same).withColumn("agreed", F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), window)))
        least = F.when(F.col("n") < SPAN, F.col("size") * 100).otherwise(F.col("size") * PERCENT)
        return common.written(checked.where(F.col("agreed") * 100 >= least).groupBy("id", "item_id").agg(F.max("agreed").cast("long").alias("agreed")), "overlaps")


def judged(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, contaminated, n_items, item_ids (sorted, comma-joined), agreed (0 if clean)."""
    found = overlaps(docs, items, key, text).groupBy("id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids"), F.max("agreed").alias("agreed"))
    found = common.written(found, "contaminated")
    return docs.select(F.col(key).cast("long").alias("id")).join(common.small(found), "id", "left").select(
        "id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("agreed", F.lit(0)).alias("agreed"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = common.written(overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("id").alias("doc_id")).distinct(), "contaminated")
    found = found.withColumnRenamed("doc_id", "__found")
    return docs.join(common.small(found), F.col("doc_id") == F.col("__found"), "left_anti")


#: All places where a document and an item agree in a word, by diagonal; the most in a window that begins with one, or in the last window.
SQL = rf"""
WITH bench AS (SELECT item_id, regexp_extract_all({common.LOWER_SQL}, '{WORD}') AS words FROM benchmark),
items AS (SELECT item_id, len(words) AS n, least({WINDOW}, len(words)) AS size, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM bench),
said AS (SELECT doc_id, regexp_extract_all({common.LOWER_SQL}, '{WORD}') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS at FROM said),
same AS (SELECT p.doc_id, i.item_id, i.n, i.size, p.at - i.place AS diagonal, i.place FROM placed p JOIN items i ON p.word = i.word),
dense AS (SELECT doc_id, item_id, diagonal FROM same GROUP BY doc_id, item_id, diagonal, size, n HAVING count(*) * 100 >= size * CASE WHEN n < {SPAN} THEN 100 ELSE {PERCENT} END),
counted AS (SELECT s.doc_id, s.item_id, s.n, s.size, count(*) OVER (PARTITION BY s.doc_id, s.item_id, s.diagonal ORDER BY s.place RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS own,
                   count(*) FILTER (WHERE s.place >= s.n - s.size) OVER (PARTITION BY s.doc_id, s.item_id, s.diagonal) AS last
            FROM same s JOIN dense USING (doc_id, item_id, diagonal)),
best AS (SELECT doc_id, item_id, max(greatest(own, last)) AS agreed FROM counted
         WHERE greatest(own, last) * 100 >= size * CASE WHEN n < {SPAN} THEN 100 ELSE {PERCENT} END GROUP BY doc_id, item_id),
judged AS (SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(item_id))::VARCHAR[], ',') AS item_ids, max(agreed) AS agreed FROM best GROUP BY doc_id)
SELECT s.doc_id, j.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(agreed, 0) AS agreed
FROM said s LEFT JOIN judged j ON s.doc_id = j.doc_id
"""
