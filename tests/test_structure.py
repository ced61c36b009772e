"""Searched graphs, the sets they offer, private choices, and the synthesizers on them."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.functions import noise, privacy
from veiltab.functions.domain import Domain
from veiltab.operators import evaluate, search, structure
from veiltab.plans import api, structured

D = Domain.of({"a": 2, "b": 3, "c": 4, "d": 2})
SCORES = {p: 0.0 for p in combinations(D.attrs, 2)} | {("a", "b"): 5.0, ("b", "c"): 4.0, ("a", "d"): 3.0}


def test_graph():
    edges, cliques = structure.search_graph(D, SCORES, 1000, price=0.01)
    assert edges == {("a", "b"), ("b", "c"), ("a", "d")} and {frozenset(c) for c in cliques} == {frozenset("ab"), frozenset("bc"), frozenset("ad")}
    assert structure.search_graph(D, SCORES, 1000, price=100.0)[0] == {("a", "d")}  # noise outweighs the others; a and d have 4 cells apart as well as together
    assert structure.search_graph(D, SCORES, 6, price=0.01)[0] == {("a", "b"), ("a", "d")}  # b and c have 12 cells
    loop = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]
    filled, cliques = structure.triangulated(D, loop)
    assert set(loop) <= filled and len(filled) == 5 and all(len(c) == 3 for c in cliques)
    assert structure.search_graph(Domain.of({"a": 2}), {}, 10) == (set(), [("a",)])


def test_graph_is_the_best_of_all_on_trees():
    rng = np.random.default_rng(0)
    for _ in range(5):
        scores = {p: float(rng.normal(1, 1)) for p in combinations(D.attrs, 2)}

        def worth(edges, scores=scores):
            filled, cliques = structure.triangulated(D, edges)
            return sum(scores[p] for p in filled) - 0.05 * sum(D.size(c) for c in cliques)

        found = structure.search_graph(D, scores, 10_000, price=0.05)[0]
        assert all(worth(found) >= worth(set(found) ^ {p}) - 1e-9 for p in scores)  # no single edge helps


def test_sets():
    names = ["a", "b", "c", "d"]
    brute = [s for k in range(5) for s in combinations(names, k) if D.size(s) <= 12]
    assert structure.maximal_sets(D, names, 12) == sorted(s for s in brute if not any(set(s) < set(o) for o in brute))
    cliques = [("a", "b", "c"), ("a", "d")]
    order = structure.network(D, cliques, SCORES, 8)
    assert sorted(a for a, _ in order) == names and order[0] == ("a", ()) or order[0][1] == ()
    for k, (a, parents) in enumerate(order):
        assert set(parents) <= {x for x, _ in order[:k]} and D.size((a, *parents)) <= 8 and any({a, *parents} <= set(c) for c in cliques)
    assert structure.initial_sets(D, cliques, SCORES, 8, "none") == [("a",), ("b",), ("c",), ("d",)]
    assert structure.initial_sets(D, cliques, SCORES, 8, "pairs")[4:] == [("a", "b"), ("a", "c"), ("a", "d")]
    assert structure.initial_sets(D, cliques, SCORES, 24, "cliques")[4:] == cliques
    assert all(D.size(s) <= 8 for s in structure.initial_sets(D, cliques, SCORES, 8))
    assert structure.candidate_sets(D, cliques, 12) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")]
    with pytest.raises(ValueError):
        structure.initial_sets(D, cliques, SCORES, 8, "all")


@pytest.mark.parametrize("how", ["exponential", "laplace"])
def test_choices(how):
    rng = np.random.default_rng(1)
    errors = {("a",): 0.0, ("b",): 50.0, ("c",): 100.0}
    assert structure.chosen(errors, 2, 10.0, 1.0, rng, how) == [("c",), ("b",)]
    assert sorted(structure.chosen(errors, 9, 1e-6, 1.0, rng, how)) == sorted(errors)
    even = [structure.chosen({("a",): 0.0, ("b",): 0.0}, 1, 1.0, 1.0, rng, how)[0] for _ in range(400)]
    assert 140 < even.count(("a",)) < 260
    assert structure.choice_rho(2.0) == 0.5 and structure.choice_rho(2.0, "laplace") == 2.0


def test_counted_sets(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 3).cast("int").alias("b"), (F.col("id") % 4).cast("int").alias("c"), F.lit(1).alias("d"))
    got = structured.counted_sets(df, D, [("b",), ("a", "c"), ("a", "b", "d")])
    assert got[("b",)].tolist() == [334, 333, 333] and got[("a", "c")].tolist() == [[250, 0, 250, 0], [0, 250, 0, 250]]
    assert got[("a", "b", "d")].sum() == 1000 and got[("a", "b", "d")][:, :, 0].sum() == 0
    assert structured.counted_sets(df, D, []) == {}


def test_exact_noise():
    made = noise.added(np.zeros((40, 50)), 3.0, np.random.default_rng(0), exact=True)
    assert made.shape == (40, 50) and (made == np.rint(made)).all() and made.std() == pytest.approx(3.0, rel=0.1) and abs(made.mean()) < 0.3
    again = [noise.added(np.ones(5), 2.0, np.random.default_rng(7)) for _ in range(2)]
    assert (again[0] == again[1]).all() and (noise.added(np.ones(3), 0.0, np.random.default_rng(0), exact=True) == 1).all()


def test_relaxed_of_three_attributes():
    truth = np.random.default_rng(3).gamma(0.5, size=(2, 3, 2))
    three = Domain.of({"a": 2, "b": 3, "c": 2})
    table = search.relaxed(three, {("a", "b", "c"): truth}, 1000, 400)
    assert search.Cells(three, {("a", "b", "c"): truth}).error(table) < 6e-3


@pytest.mark.parametrize("method", ["structured", "genetic_rounds"])
@pytest.mark.parametrize("exact", [False, True])
def test_methods(spark, method, exact):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 3 + F.col("id") % 2).cast("string").alias("k"), ((F.col("id") % 3) * 10 + F.col("id") % 7).cast("int").alias("x"))
    kinds = {"c": {"type": "categorical", "categories": ["0", "1", "2"]}, "k": {"type": "categorical", "categories": ["0", "1", "2", "3"]}, "x": {"type": "numerical", "min": 0, "max": 27, "bins": 9}}
    fit = {"structured": structured.fit_structured, "genetic_rounds": structured.fit_genetic_rounds}[method]
    made = fit(df, kinds, privacy.PrivacySpec(10.0), api.RunConfig(seed=3, exact=exact))
    assert made.ledger.spent <= made.ledger.total * (1 + 1e-9)
    out = made.sample(2000, 5)
    assert out.schema.names == ["c", "k", "x"] and out.count() == 2000
    both = evaluate.marginal_tvd(df.select("c", "k"), out.select("c", "k"), ["c", "k"], [2]).first()
    assert both["tvd"] < 0.1 and method in api.methods()


def test_methods_of_one_column_and_no_rows(spark):
    kinds = {"c": {"type": "categorical", "categories": ["x", "y"]}}
    df = spark.createDataFrame([], "c string")
    for method in ("structured", "genetic_rounds"):
        assert api.synthesize(method, df, kinds, privacy.PrivacySpec(1.0), 10, api.RunConfig(seed=1)).count() == 10
