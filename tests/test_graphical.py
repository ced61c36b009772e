"""Factors, junction trees, estimation and the adaptive synthesizer, against full tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.functions import privacy
from veiltab.functions.domain import Domain
from veiltab.operators import evaluate, graphical
from veiltab.operators.graphical import Factor, Measurement
from veiltab.plans import api

D = Domain.of({"a": 2, "b": 3, "c": 2, "d": 3})
LOOP = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]


def whole(model):
    out = Factor.zeros(D)
    for f in model.potentials.values():
        out = Factor(D, out.values + f.to(D))
    p = np.exp(out.values - out.values.max())
    return p / p.sum() * model.total


def test_factors():
    rng = np.random.default_rng(0)
    f, g = Factor(D.project(("a", "b")), rng.normal(size=(2, 3))), Factor(D.project(("c", "b")), rng.normal(size=(2, 3)))
    h = f + g
    assert h.domain.attrs == ("a", "b", "c") and h.values[1, 2, 0] == pytest.approx(f.values[1, 2] + g.values[0, 2])
    assert h.project(("c", "a")).values[1, 0] == pytest.approx(h.values[0, :, 1].sum()) and (h - g).log_project(("b",)).values == pytest.approx(np.log(2 * np.exp(f.values).sum(0)))
    assert h.condition({"b": 1}).values.shape == (2, 2) and h.log_project(()).values == pytest.approx(np.log(np.exp(h.values).sum()))


def test_tree_and_propagation():
    tree = graphical.JunctionTree(D, LOOP)
    assert all(any(set(e) <= set(c) for c in tree.cliques) for e in LOOP) and len(tree.messages()) == 2 * (len(tree.cliques) - 1)
    rng = np.random.default_rng(1)
    model = graphical.Model(tree, {c: Factor(D.project(c), rng.normal(size=D.project(c).shape)) for c in tree.cliques}, 100.0)
    joint = Factor(D, whole(model))
    for attrs in [("a",), ("d", "b"), ("a", "c"), ("b", "d", "a", "c"), ("a", "b")]:
        assert model.project(attrs).values == pytest.approx(joint.project(attrs).values)
    with pytest.raises(ValueError):
        graphical.JunctionTree(D, [D.attrs], most_cells=10)
    apart = graphical.JunctionTree(D, [("a", "b")])
    assert {frozenset(c) for c in apart.cliques} == {frozenset("ab"), frozenset("c"), frozenset("d")}


@pytest.mark.parametrize(("how", "norm", "within"), [("mirror", "L2", 0.01), ("dual", "L2", 0.05), ("dual", "L1", 0.05)])
def test_estimate(how, norm, within):
    truth = np.random.default_rng(2).gamma(0.7, size=D.shape)
    truth = Factor(D, truth / truth.sum() * 1000)
    made = [Measurement(c, truth.project(c).values) for c in LOOP]
    model = graphical.estimate(D, made, rounds=3000, how=how, norm=norm)
    assert model.total == pytest.approx(1000)
    assert graphical.feasibility(model, made) < within


def test_measurements_by_matrix_zeros_and_warm_start():
    sums = np.tril(np.ones((3, 3)))
    truth = np.array([10.0, 0, 90])
    model = graphical.estimate(D, [Measurement(("b",), sums @ truth, 1.0, sums)], impossible={("b",): [(1,)]}, rounds=1000)
    assert model.total == pytest.approx(100) and model.project(("b",)).values == pytest.approx(truth, abs=0.5) and model.project(("a", "b")).values[:, 1].sum() == 0
    again = graphical.estimate(D, [Measurement(("b",), sums @ truth, 1.0, sums)], warm=model, rounds=5)
    assert again.project(("b",)).values == pytest.approx(truth, abs=0.5)


@pytest.mark.parametrize("how", ["sample", "round"])
def test_records_of_a_model(spark, how):
    rng = np.random.default_rng(3)
    tree = graphical.JunctionTree(D, LOOP)
    model = graphical.Model(tree, {c: Factor(D.project(c), rng.normal(size=D.project(c).shape)) for c in tree.cliques}, 4000.0)
    records = model.sample(spark, 4000, 7, how)
    assert records.columns == ["row_id", "a", "b", "c", "d"] and records.select("row_id").distinct().count() == 4000
    for c in LOOP:
        got = np.zeros(D.project(c).shape)
        for r in records.groupBy(*c).count().collect():
            got[r[0], r[1]] = r["count"]
        assert np.abs(got - model.project(c).values).sum() / 8000 < 0.04
    if how == "sample":
        assert "Exchange hashpartitioning" not in records._jdf.queryExecution().toString()


def test_adaptive(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("c"), ((F.col("id") % 3) * 10 + F.col("id") % 7).cast("int").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    kinds = {"c": {"type": "categorical", "categories": ["0", "1", "2"]}, "x": {"type": "numerical", "min": 0, "max": 27, "bins": 9}, "y": {"type": "categorical", "categories": ["0", "1"]}}
    fit = api.fit_adaptive(df, kinds, privacy.PrivacySpec(5.0), api.RunConfig(seed=4, extra={"rounds": 12, "steps": 100}))
    assert fit.ledger.spent <= fit.ledger.total * (1 + 1e-9) and any(r["chosen"] == ("c", "x") for r in fit.log)
    out = fit.sample(1000, 4)
    assert out.schema.names == ["c", "x", "y"] and out.count() == 1000 and out.schema["x"].dataType == df.schema["x"].dataType
    pair = [t.select("c", F.floor(F.col("x") / 10).alias("t")) for t in (df, out)]
    assert evaluate.marginal_tvd(*pair, ["c", "t"], (2,)).first().tvd < 0.15
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, fit.sample(1000, 4).collect())) and "adaptive" in api.methods()
