"""Domains, accounting, encoders, selection, consistency, synthesis and sessions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.functions import noise, privacy
from veiltab.functions.domain import Domain
from veiltab.operators import consistency, encode, evaluate, infer, marginals, overrides, select, synth
from veiltab.plans import api
from veiltab.sources import tables
from veiltab.streaming import marginals as streamed


def test_domain():
    d = Domain.of({"a": 3, "b": 2, "c": 4})
    assert d.size() == 24 and d.project(["c", "a"]).shape == (4, 3) and d.without(["b"]).attrs == ("a", "c")
    assert (d | Domain.of({"b": 2, "d": 5})).attrs == ("a", "b", "c", "d") and d.places(["c"]) == (2,) and d.by_size().attrs == ("b", "a", "c")
    assert d.strides(["a", "b", "c"]) == (8, 4, 1) and d.ordered(["c", "a"]) == ("a", "c") and list(d.project("b")) == ["b"]


def test_accounting():
    rho = privacy.rho_of(1.0, 1e-5)
    assert privacy.epsilon_of(rho, 1e-5) == pytest.approx(1, abs=1e-6) and privacy.delta_of(rho, 1.0) == pytest.approx(1e-5, rel=1e-4)
    assert privacy.delta_of(rho, 1.0) < privacy.delta_standard(rho, 1.0)
    ledger = privacy.Ledger(1.0)
    ledger.charge("x", 0.75)
    with pytest.raises(privacy.BudgetError):
        ledger.charge("y", 0.5)
    draws = [noise.discrete_gaussian(4) for _ in range(2000)]
    assert abs(np.mean(draws)) < 0.3 and 3 < np.var(draws) < 5


@pytest.mark.parametrize(("rows", "indif", "cells"), [([(0, 0), (0, 1), (1, 0), (1, 1)], 0.0, 4), ([(i, i) for i in range(4)], 6.0, 16)])
def test_indif(spark, rows, indif, cells):
    df = spark.createDataFrame(rows, "A int, B int")
    assert tuple(marginals.indif(df, "A", "B").first()) == (indif, cells)
    assert marginals.indif_pairs(df, ["A", "B"]).first().indif == indif


def test_marginal_cells(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 1)], "a int, b int")
    got = {(r.a, r.b): r.n for r in marginals.dense(df, ["a", "b"]).collect()}
    assert len(got) == 6 and sum(got.values()) == 6 and got[(2, 1)] == 2 and got[(0, 1)] == 0


def test_edges_and_overrides(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (7.9,), (12.1,), (4.0,), (-5.0,), (99.0,)], "x double")
    assert [r[0] for r in df.select(encode.edge_bin(F.col("x"), [0, 4, 8, 12, 16])).collect()] == [0, 0, 1, 3, 1, 0, 3]
    ages = spark.createDataFrame([(10, "A"), (80, "B"), (35, "a")], "age int, d string")
    assert [tuple(r) for r in ages.select(overrides.clip(F.col("age"), 18, 65), overrides.map_categories(F.col("d"), ["A"])).collect()] == [(18, "A"), (65, "__OTHER__"), (35, "A")]
    assert overrides.bin_edges(0, 40, "exponential", 4, growth=1.5)[0::4] == [0, 40] and len(overrides.bin_edges(18, 65, count=5)) == 6
    with pytest.raises(overrides.InvalidBinning):
        overrides.check_binning([0, 5], 3)
    assert infer.infer(ages)[0].reason == "integer_unique_below_threshold"
    assert overrides.final_categories(["A", "a"], ["C"], has_null=True) == ["A", "C", "__OTHER__", "__NULL__"]


def test_tvd(spark):
    a, b = spark.createDataFrame([("NY",), ("SF",), ("NY",)], "c string"), spark.createDataFrame([("NY",)] * 3, "c string")
    assert evaluate.categorical_tvd(a, b, "c").first().tvd == pytest.approx(1 / 3)
    x, y = (spark.createDataFrame([(float(v),) for v in vs], "x double") for vs in ([10, 20, 30, 40], [12, 22, 32, 42]))
    assert evaluate.numeric_tvd(x, y, "x", [0, 20, 40, 60]).first().tvd < 0.5 and evaluate.numeric_tvd(x, x, "x").first().tvd == 0
    assert all(r.tvd == 0 for r in evaluate.marginal_tvd(a, a, ["c"], (1,)).collect())


def test_partitions():
    assert encode.l1_partition(np.array([5.0, 5, 5, 50, 50]), 100.0, 0.5, lambda s: 0.0) == [(0, 3), (3, 5)]
    buckets, out = encode.dawa(np.array([1.0, 2, 3, 4]), 1.0, 0.5, lambda s: 0.0)
    assert buckets[0][0] == 0 and len(out) == 4 and out.sum() == pytest.approx(10)
    tree = encode.privtree(np.array([50.0] + [0.0] * 7), 0.0, 8.0, 50.0, lambda s: 0.0)
    assert tree[0] == (0.0, 1.0) and tree[-1][1] == 8.0


def test_selection():
    scores = {("a", "b"): 1000.0, ("a", "c"): 1.0, ("b", "c"): 1.0}
    chosen = select.greedy_pairs(scores, dict.fromkeys(scores, 4), 1.0)
    assert chosen == [("a", "b")] and select.with_isolated(["a", "b", "c"], chosen, scores)[-1] in {("a", "c"), ("b", "c")}
    d = Domain.of({"A": 2, "B": 2, "C": 2})
    assert select.combined(d, [("A", "B"), ("B", "C"), ("A", "C")]) == [("A", "B", "C")]
    rng = np.random.default_rng(0)
    assert select.exponential_mechanism([0, 0, 100], 10, 1, rng) == 2 and select.permute_and_flip([0, 0, 100], 10, 1, rng) == 2
    assert select.pareto_efficient(np.array([[1, 2], [2, 1], [2, 2]])).tolist() == [True, True, False]


def test_consistency():
    d = Domain.of({"a": 2, "b": 2, "c": 2})
    rng = np.random.default_rng(1)
    out = consistency.consistent(d, {("a", "b"): np.array([[3.0, 1], [-1, 4]]) + rng.normal(size=(2, 2)), ("b", "c"): np.array([[2.0, 2], [1, 3]])})
    assert all(v.min() >= 0 for v in out.values()) and out[("a", "b")].sum() == pytest.approx(out[("b", "c")].sum())
    assert out[("a", "b")].sum(axis=0) == pytest.approx(out[("b", "c")].sum(axis=1), abs=0.3)
    assert consistency.norm_cut(np.array([-1.0, 1, 4]), 4).tolist() == [0, 0, 4]


def test_records(spark):
    df = synth.initial_records(spark, 1000, {"a": np.array([1, 2, 1]), "b": np.array([3, 1])}, 3)
    assert {r.a: r["count"] for r in df.groupBy("a").count().collect()} == {0: 250, 1: 500, 2: 250}
    joint = np.array([[250.0, 0], [0, 500], [125, 125]])
    done = synth.append_attribute(df.drop("b"), ["a"], "b", joint, [3])
    assert {(r.a, r.b): r["count"] for r in done.groupBy("a", "b").count().collect()} == {(0, 0): 250, (1, 1): 500, (2, 0): 125, (2, 1): 125}
    target = np.array([[250.0, 0], [0, 500], [125, 125]])
    moved = synth.gradual_update(df, {"a": 3, "b": 2}, {("a", "b"): target}, 6)
    cells = np.zeros((3, 2))
    for r in moved.groupBy("a", "b").count().collect():
        cells[r.a, r.b] = r["count"]
    assert cells.sum() == 1000 and np.abs(cells - target).sum() < 60
    add, free = synth.cell_changes(np.array([0, 10, 10]), np.array([5, 10, 5]), 1.0)
    assert add.tolist() == [5, 0, 0] and free.tolist() == [0, 0, 5]
    assert synth.alpha_schedule("U4", 40) == pytest.approx(0.84**2) and synth.alpha_schedule("U6", 50) == pytest.approx(0.5)


def test_synthesize(spark):
    df = spark.range(2000).select((F.col("id") % 3).cast("string").alias("c"), ((F.col("id") % 3) * 10 + F.col("id") % 7).cast("int").alias("x"))
    kinds = {"c": {"type": "categorical", "categories": ["0", "1", "2"]}, "x": {"type": "numerical", "min": 0, "max": 27, "bins": 9}}
    out = api.synthesize("Marginals", df, kinds, privacy.PrivacySpec(10.0), 500, api.RunConfig(seed=1))
    assert out.schema.names == ["c", "x"] and out.schema["x"].dataType == df.schema["x"].dataType and out.count() == 500
    assert evaluate.categorical_tvd(df, out, "c").first().tvd < 0.1
    assert evaluate.marginal_tvd(df.select("c", F.floor(F.col("x") / 10).alias("t")), out.select("c", F.floor(F.col("x") / 10).alias("t")), ["c", "t"], (2,)).first().tvd < 0.4
    with pytest.raises(KeyError):
        api.synthesize("none", df, kinds, privacy.PrivacySpec(1.0), 5)


def test_sessions():
    now, gone = [0.0], []
    s = api.Sessions(10, lambda k, v: gone.append(k), lambda: now[0])
    s.set("a", 1)
    s.set("b", 2, ttl=100)
    now[0] = 50
    assert "a" not in s and s.get("b") == 2 and gone == ["a"] and s.pop("b") == 2 and s.keys() == []


def test_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.write(tmp_path / "t.csv", "in/t.csv")
    assert [tuple(r) for r in tables.load(spark, f"file://{tmp_path}/t.zip").orderBy("a").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        tables.load(spark, "t.xlsx")
    assert tables.random_table(spark, Domain.of({"a": 4}), 50).agg(F.max("a")).first()[0] <= 3
    domain, info = tables.metadata(tables.load(spark, f"file://{tmp_path}/t.csv"))
    assert info["cat_columns"] == ["a", "b"] and domain["b"]["categories"] == ["x", "y"]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, k string")
    df.write.parquet(f"{tmp_path}/in")
    q = streamed.running(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["k"]).writeStream.outputMode("complete").format("memory").queryName("m").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.n for r in spark.table("m").collect()} == {"a": 2, "b": 1} and math.isclose(1, 1)


def test_exact_deltas():
    assert privacy.gaussian_delta(1.0, 1.0) == pytest.approx(0.12693674, abs=1e-7)
    sigma = privacy.gaussian_sigma_exact(1.0, 1e-5)
    assert privacy.gaussian_delta(sigma, 1.0) == pytest.approx(1e-5, rel=1e-6) and sigma < privacy.gaussian_sigma(1, privacy.rho_of(1.0, 1e-5))
    assert privacy.discrete_gaussian_delta(400.0, 0.1) == pytest.approx(privacy.gaussian_delta(20.0, 0.1), rel=0.05)
    assert privacy.discrete_gaussian_delta(1.0, 1.0) <= privacy.delta_of(0.5, 1.0)
