"""Licence scans with a positional rare-token index, in DataFrame functions only.

Templates are short word sequences with a label; the base ones are phrases, the others sentences of well-known
licences with a mandatory key phrase inside. A base phrase must match whole, another template in COVERAGE percent of
its words and in all of its key phrase, at the places where the template has them.

One pass over the texts leaves, per document, its licence words at their places; how many documents hold each gives its
IDF. A template of which e words may differ is posted in the index under its e + 2 words of highest IDF, with their
places: a document that matches has two of them at least, whichever e differ, and one of the e + 1 rarest, without
which it is not looked up at all. Where a posted word stands in a document, its place less that in the template is a
start; starts that two postings of a template share are checked word by word. So the index loses no match, and which
words are rare in a corpus changes the work but not the result. score is the best share of words of what matched.

The index is a table that is joined, so the plan does not grow with the number of templates. Rows of a document are
grouped by a number of its own; a text with very many starts is a row per start, never a list.

Edge cases. A null or empty text has no words. Whole texts are scanned. Words of equal IDF rank by name. Repeated rows
and rows that share an id each give a row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words; percent of a template's words that must agree.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVERAGE = 80


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())


# The base phrases, and opening or telling sentences of licences.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software"),
    Template("lgpl", "gnu lesser general public license", "lesser general public"),
    Template("agpl", "gnu affero general public license", "affero general public"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("cc-by-sa", "creative commons attribution sharealike", "attribution sharealike"),
    Template("cc-by", "creative commons attribution license", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    Template("bsl", "boost software license version 1 0", "boost software license"),
    Template("epl", "eclipse public license", "eclipse public license"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(common.lower_ascii(text), F.lit(f"({WORD})"), 1)


def least_found(t: Template) -> int:
    """Words of a template that must stand in their places."""
    return len(t.words) if t.base else -(-COVERAGE * len(t.words) // 100)


def key_place(t: Template) -> tuple[int, int]:
    """Where a template's key phrase begins and ends in it."""
    key, said = re.findall(WORD, t.key.lower()), t.words
    return next((k, k + len(key)) for k in range(len(said)) if said[k : k + len(key)] == key)


def postings(templates: tuple[Template, ...], counts: dict[str, int]) -> tuple[list[tuple[str, int, int, int]], list[str]]:
    """(word, template, place, postings that must agree) of the index, and the words of which a document must have one."""
    out, some = [], set()
    for number, t in enumerate(templates):
        said, spare = t.words, len(t.words) - least_found(t)
        ranked = sorted(range(len(said)), key=lambda k: (counts.get(said[k], 0), said[k], k))
        out += [(said[k], number, k, min(2, len(said))) for k in ranked[: spare + 2]]
        some |= {said[k] for k in ranked[: spare + 1]}
    return out, sorted(some)


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small local table."""

    def said(x: object) -> str:
        return f"array({', '.join(map(said, x))})" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x).lower()

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)} AS t({names})")


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score. A written table."""
    spark, vocabulary = docs.sparkSession, sorted({w for t in templates for w in t.words})
    with common.scratch() as own:
        said = docs.select(F.col(key).cast("long").alias("id"), words_of(F.col(text)).alias("words"))
        marks = F.transform("words", lambda x: F.when(x.isin(vocabulary), x))
        marked = own.written(said.select("id", F.size("words").cast("long").alias("n_words"), marks.alias("marks")).withColumn("row", F.monotonically_increasing_id()), "marked")
        counts = {r["word"]: r["n"] for r in marked.select(F.explode(F.array_distinct("marks")).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row per licence word
        index, some = postings(templates, counts)
        posted = F.broadcast(_values(spark, index, "word, template, place, least"))  # as many rows as the templates have words at most
        known = F.broadcast(_values(spark, [(k, t.label, t.base, t.words, least_found(t), *((0, 0) if t.base else key_place(t))) for k, t in enumerate(templates)], "template, label, base, said, least, key_from, key_to"))
        likely = marked.where(F.arrays_overlap("marks", F.array(*map(F.lit, some)))).select("row", F.posexplode("marks").alias("at", "word"))
        likely = likely.where(F.col("word").isin(sorted({w for w, *_ in index}))).join(posted, "word")
        starts = likely.groupBy("row", "template", (F.col("at") - F.col("place")).alias("start")).agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("row", "template", "start")
        starts = own.written(starts, "starts")
        agrees = lambda k: F.coalesce(F.get("marks", F.col("start") + k) == F.get("said", k), F.lit(False))
        checked = marked.select("row", "marks").join(common.small(starts), "row").join(known, "template")
        checked = checked.withColumn("found", F.size(F.filter(F.sequence(F.lit(0), F.size("said") - 1), agrees)))
        checked = checked.where((F.col("found") >= F.col("least")) & (F.col("base") | F.forall(F.sequence("key_from", F.col("key_to") - 1), agrees)))
        base, joined = lambda x: F.when(F.col("base"), x), lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
        place = F.col("start").cast("long")
        judged = checked.groupBy("row").agg(
            F.count(base(place)).alias("n_base"), F.min(base(place)).alias("first_word"), F.max(base(place)).alias("last_word"),
            joined(base(F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max(F.col("found") / F.size("said")).alias("score"))
        judged = own.written(judged, "judged")
        return common.written(marked.select("row", "id", "n_words").join(common.small(judged), "row", "left").select(
            "id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")), "licences")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    """The same rows from all alignments of all templates, without an index."""
    rows = ", ".join(f"({k}, '{t.label}', {t.base}, {len(t.words)}, {least_found(t)}, {p}, '{w}', {t.base or key_place(t)[0] <= p < key_place(t)[1]}, {0 if t.base else key_place(t)[1] - key_place(t)[0]})".lower() for k, t in enumerate(TEMPLATES) for p, w in enumerate(t.words))
    return rf"""
WITH t(template, label, base, size, least, place, word, in_key, key_size) AS (VALUES {rows}),
said AS (SELECT doc_id, regexp_extract_all({common.LOWER_SQL}, '{WORD}') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS at FROM said),
hits AS (SELECT p.doc_id, t.template, t.label, t.base, t.size, p.at - t.place AS start, count(*) AS found
         FROM placed p JOIN t ON p.word = t.word GROUP BY p.doc_id, t.template, t.label, t.base, t.size, t.least, t.key_size, p.at - t.place
         HAVING count(*) >= t.least AND (t.base OR count(*) FILTER (WHERE t.in_key) = t.key_size)),
judged AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
                  array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
                  max(found::DOUBLE / size) AS score FROM hits GROUP BY doc_id)
SELECT s.doc_id, len(s.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM said s LEFT JOIN judged j ON s.doc_id = j.doc_id
"""


SQL = _sql()
