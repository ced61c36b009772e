"""Faults that small tables hide, each at a size where it showed."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veiltab.operators import encode, overrides, ranks, statqueries, synth
from veiltab.plans import api
from veiltab.sources import tables


def test_ordinal_of_a_million(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ONE_TASK", 1000)
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("v"))
    codes = encode.ordinal(df, "v")
    n, distinct, least, most = codes.agg(F.count("*"), F.count_distinct("code"), F.min("code"), F.max("code")).first()
    assert (n, distinct, least, most) == (1_000_000, 1_000_000, 0, 999_999)
    some = [r.value for r in codes.where("code % 50000 = 0").orderBy("code").collect()]
    assert some == sorted(some)


@pytest.mark.parametrize("one_task", [1_000_000, 10])
def test_running_sums(spark, monkeypatch, one_task):
    monkeypatch.setattr(ranks, "ONE_TASK", one_task)
    n = np.random.default_rng(0).integers(0, 9, 300)
    counts = spark.createDataFrame([(i, int(v)) for i, v in enumerate(n)], "a int, n long")
    got = {r.a: r.prefix for r in statqueries.prefix_sums(counts, "a").collect()}
    assert [got[i] for i in range(300)] == np.cumsum(n).tolist()
    got = {r.a: r.suffix for r in statqueries.suffix_sums(counts, "a").collect()}
    assert [got[i] for i in range(300)] == np.cumsum(n[::-1])[::-1].tolist()
    got = {r.a: r.total for r in statqueries.width_sums(counts, "a", 7).collect()}
    assert got == {i: int(n[i : i + 7].sum()) for i in range(294)}
    rows = spark.createDataFrame([(i,) for i, v in enumerate(n) for _ in range(v)], "a int")
    got = [r.value for r in encode.by_frequency(rows, "a").orderBy("code").collect()]
    assert got == sorted((i for i in range(300) if n[i]), key=lambda i: (-n[i], i))
    assert max(r.cume_dist for r in statqueries.distribution_rank(rows, "a").collect()) == 1


def test_metadata_holds_all_categories(spark):
    df = spark.createDataFrame([(f"c{i % 120}",) for i in range(500)], "k string")
    domain, _ = tables.metadata(df)
    assert domain["k"]["size"] == len(domain["k"]["categories"]) == len(domain["k"]["value_counts"]) == 120


def test_unknown_categories(spark):
    df = spark.createDataFrame([("x",), ("zzz",), (None,)], "k string")
    with pytest.raises(Exception, match="no category"):
        api.Codes({"k": {"type": "categorical", "categories": ["x", "y"]}}).encoded(df).collect()
    codes = api.Codes({"k": {"type": "categorical", "categories": ["x", "__OTHER__", "__NULL__"]}})
    assert [r.k for r in codes.encoded(df).collect()] == [0, 1, 2]


def test_schema_keeps_long_numbers(spark):
    big = 9007199254740993
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("c", T.IntegerType())])
    df = spark.createDataFrame([(big, str(big), "12.6"), (1, "x", str(1 << 40))], "a long, b string, c string")
    assert [tuple(r) for r in overrides.enforce_schema(df, schema).collect()] == [(big, big, 13), (1, 0, 0)]


def test_unknown_binning():
    with pytest.raises(overrides.InvalidBinning):
        overrides.bin_edges(0, 1, "logarithmic")


def test_labels_fold_alike(spark):
    df = spark.createDataFrame([("straße",), (" Straße ",), ("STRASSE",), ("other",)], "k string")
    assert [r[0] for r in df.select(overrides.map_categories(F.col("k"), ["Straße"])).collect()] == ["Straße", "Straße", "__OTHER__", "__OTHER__"]
    assert {r[0] for r in overrides.excluded(df, "k", ["straße", "other"]).collect()} == {"STRASSE"}


def test_initial_attributes_are_unrelated(spark):
    for n in (1000, 9973):
        names = [f"x{k}" for k in range(16)]
        rows = synth.initial_records(spark, n, {a: np.ones(2) for a in names}, 0).toPandas()
        corr = np.corrcoef(rows[names].to_numpy().T)
        assert np.abs(corr - np.eye(16)).max() < 5 / np.sqrt(n) and (rows[names].sum() - n / 2).abs().max() <= 1
    far = 4_000_000_000
    got = spark.range(far - 5, far).withColumnRenamed("id", "row_id").select(synth.place_of(far, 3).alias("p")).collect()
    assert len({r.p for r in got}) == 5 and all(0 <= r.p < far for r in got)


def test_ranks_in_one_hot_cell(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 4900, 0).otherwise(F.col("id")).alias("c"))
    got = ranks.in_cells(df, "c", "row_id", 1).where("c = 0").toPandas()
    assert sorted(got["__rank"]) == list(range(1, 4901)) and set(got["__size"]) == {4900}


def test_partition_work_is_not_cubic():
    x = np.random.default_rng(1).integers(0, 50, 400).astype(float)
    buckets = encode.l1_partition(x, 1.0, 0.5, lambda s: 0.0)
    assert buckets[0][0] == 0 and buckets[-1][1] == 400 and all(a[1] == b[0] for a, b in zip(buckets, buckets[1:], strict=False))
