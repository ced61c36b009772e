"""Workload matrices and strategies, hierarchies, and tables found by search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.functions import privacy
from veiltab.functions.domain import Domain
from veiltab.operators import evaluate, hierarchy, search, workloads
from veiltab.plans import api


def test_matrices():
    x = np.arange(12.0)
    w = workloads.Product((workloads.prefix(3), workloads.ranges(4)), 2.0)
    assert w.answers(x) == pytest.approx(w.dense() @ x) and w.shape == w.dense().shape
    assert w.gram().dense() == pytest.approx(w.dense().T @ w.dense()) and w.pinv().dense() == pytest.approx(np.linalg.pinv(w.dense()))
    assert w.sensitivity(1) == pytest.approx(np.abs(w.dense()).sum(axis=0).max()) and w.sensitivity(2) == pytest.approx(np.sqrt((w.dense() ** 2).sum(axis=0).max()))
    assert w.gram().trace() == pytest.approx(np.trace(w.dense().T @ w.dense()))
    assert (workloads.suffix(4) @ np.ones(4)).tolist() == [4, 3, 2, 1] and len(workloads.ranges(5, [2])) == 4
    assert [m.answers(np.ones(6)).tolist() for m in workloads.marginals([2, 3], 1)] == [[3, 3], [2, 2, 2]]
    h = workloads.haar(8)
    assert np.linalg.matrix_rank(h) == 8 and h @ h.T == pytest.approx(np.diag(np.diag(h @ h.T)))
    assert workloads.moments(3, 2)[2].tolist() == [0, 1, 4] and workloads.grid_ranges(2, 2).shape == (9, 4) and workloads.permuted(h).sum() == h.sum()


def test_strategy():
    w = workloads.prefix(32)
    found = workloads.best_strategy(w, restarts=3)
    assert workloads.sensitivity(found) == pytest.approx(1)
    assert workloads.root_mean_error(w, found) < 0.8 * workloads.root_mean_error(w, workloads.identity(32))
    assert workloads.query_errors(w, found).sum() == pytest.approx(workloads.squared_error(w.T @ w, found))
    product = workloads.product_strategy(workloads.Product((workloads.prefix(4), workloads.identity(3))), restarts=1)
    assert workloads.measured(np.arange(12.0), product, 1.0, lambda scale, n: np.zeros(n)) == pytest.approx(np.arange(12.0))
    rng = np.random.default_rng(0)  # expected error against drawn noise
    errors = [((w @ workloads.measured(np.zeros(32), found, 1.0, lambda s, n: rng.laplace(0, s, n))) ** 2).sum() for _ in range(400)]
    assert np.mean(errors) == pytest.approx(workloads.squared_error(w.T @ w, found), rel=0.2)


def test_unions():
    cells = np.arange(12.0)
    w = workloads.Union((workloads.Product((workloads.prefix(3), workloads.total(4))), workloads.Product((workloads.total(3), workloads.ranges(4)), 2.0)))
    assert w.answers(cells) == pytest.approx(w.dense() @ cells) and w.shape == w.dense().shape
    assert w.sensitivity(1) == pytest.approx(np.abs(w.dense()).sum(axis=0).max()) and w.sensitivity(2) == pytest.approx(np.sqrt((w.dense() ** 2).sum(axis=0).max()))
    quiet = lambda scale, n: np.zeros(n)
    for make in (workloads.union_strategy, workloads.best_template):
        found = make(w, restarts=1)
        assert found.answered(w, cells, 1.0, quiet) == pytest.approx(w.answers(cells))
        rng = np.random.default_rng(0)
        drawn = [((found.answered(w, cells * 0, 1.0, lambda s, n: rng.laplace(0, s, n))) ** 2).sum() for _ in range(600)]  # noqa: B023
        assert np.mean(drawn) == pytest.approx(found.error(w), rel=0.2)
    split = workloads.union_strategy(w, restarts=1)
    assert sum(split.shares) == pytest.approx(1) and workloads.best_template(w, restarts=1).error(w) <= split.error(w)
    even = workloads.UnionStrategy(split.parts, (0.5, 0.5))
    assert split.error(w) <= even.error(w) + 1e-9
    whole = workloads.Union((workloads.Product((workloads.identity(6),)), workloads.Product((workloads.identity(6),))))
    assert workloads.best_template(whole, restarts=1).shared  # the cells, measured once, serve both
    p = workloads.product_strategy(w.parts[1], restarts=1)
    assert workloads.product_error(w.parts[1], p) == pytest.approx(workloads.squared_error(w.parts[1].dense().T @ w.parts[1].dense(), p.dense()))
    a, b = workloads.prefix(2), workloads.total(3)
    assert workloads.block_diagonal(a, b).tolist() == [[1, 0, 0, 0, 0], [1, 1, 0, 0, 0], [0, 0, 1, 1, 1]]
    assert workloads.side_by_side(a, a).shape == (2, 4) and workloads.weighted(a, [1, 3]).tolist() == [[1, 0], [3, 3]]
    with pytest.raises(ValueError):
        workloads.Union((workloads.Product((a,)), workloads.Product((b,))))


def test_hierarchy(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (1,), (2,), (3,), (4,), (5,), (None,)], "x int")
    table = hierarchy.hierarchy(df, "x", 2, 2)
    paths = {r.value: list(r.path) for r in table.collect()}
    assert [paths[v][0] for v in range(1, 6)] == [0, 1, 1, 1, 1] and [paths[v][1] for v in range(2, 6)] == [0, 0, 1, 1]
    up = hierarchy.rolled_up(df, "x", table, 2)
    assert {r.x: r["count"] for r in up.groupBy("x").count().collect()} == {1: 4, 2: 2, 3: 2, None: 1}  # value 1 holds all of its group: its middle is at one half
    back = hierarchy.rolled_back(up.withColumn("row_id", F.monotonically_increasing_id()), "x", table, 2, F.col("row_id"))
    again = hierarchy.rolled_up(back.drop("row_id"), "x", table, 2)
    assert {r.x: r["count"] for r in again.groupBy("x").count().collect()} == {r.x: r["count"] for r in up.groupBy("x").count().collect()}
    assert hierarchy.to_json(table).startswith('{"1": [0') and hierarchy.hierarchy(df.limit(0), "x").count() == 0
    with pytest.raises(ValueError):
        hierarchy.hierarchy(df, "x", fan=1)


D = Domain.of({"a": 3, "b": 4, "c": 2})
TRUTH = np.random.default_rng(5).gamma(0.5, size=D.shape)
MARGINS = {("a", "b"): TRUTH.sum(2), ("b", "c"): TRUTH.sum(0), ("a",): TRUTH.sum((1, 2)), ("c",): TRUTH.sum((0, 1))}


@pytest.mark.parametrize(("find", "within"), [(lambda: search.genetic(D, MARGINS, 500, 3000), 2e-4), (lambda: search.relaxed(D, MARGINS, 500, 400), 6e-3)])
def test_tables_found(spark, find, within):
    table = find()
    cells = search.Cells(D, MARGINS)
    assert table.min() >= 0 and (table.max(axis=0) < np.array(D.shape)).all() and cells.error(table) < within
    assert cells.error(table) < cells.error(search._start(D, MARGINS, 500, np.random.default_rng(1)))
    out = search.drawn(spark, D, table, 5000)
    got = np.zeros((3, 4))
    for r in out.groupBy("a", "b").count().collect():
        got[r.a, r.b] = r["count"] / 5000
    assert np.abs(got - MARGINS[("a", "b")] / TRUTH.sum()).sum() / 2 < 0.08


def test_mixture(spark):
    rng = np.random.default_rng(6)
    records = np.array(np.unravel_index(rng.choice(24, 300), D.shape)).T
    w = search.best_mixture(D, MARGINS, records)
    cells = search.Cells(D, MARGINS)
    share = np.bincount(cells.of(records).ravel(), weights=np.repeat(w, 4), minlength=len(cells.wanted))
    assert w.sum() == pytest.approx(1) and ((share - cells.wanted) ** 2).sum() < 1e-3
    assert search.drawn(spark, D, records, 100, weights=w).count() == 100


@pytest.mark.parametrize("method", ["genetic", "relaxed"])
def test_search_methods(spark, method):
    df = spark.range(2000).select((F.col("id") % 3).cast("string").alias("c"), ((F.col("id") % 3) * 10 + F.col("id") % 7).cast("int").alias("x"))
    kinds = {"c": {"type": "categorical", "categories": ["0", "1", "2"]}, "x": {"type": "numerical", "min": 0, "max": 27, "bins": 9}}
    out = api.synthesize(method, df, kinds, privacy.PrivacySpec(10.0), 800, api.RunConfig(seed=2))
    assert out.schema.names == ["c", "x"] and out.count() == 800
    assert evaluate.categorical_tvd(df, out, "c").first().tvd < 0.1
