"""Preprocessing with its inverse, statistics over many marginals, steering of updates, sources and the service."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.functions.domain import Domain
from veiltab.operators import consistency, distances, encode, evaluate, graphical, gum, measures, preprocess, select, synth
from veiltab.plans import service
from veiltab.sources import tables


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.gamma(3, 9)), int(rng.integers(0, 12)), f"c{min(int(rng.exponential(30)), 400)}", "MF"[i % 2]) for i in range(3000)]
    return spark.createDataFrame(rows, "row_id long, income double, kids int, city string, sex string").cache()


@pytest.mark.parametrize("method", preprocess.METHODS)
def test_round_trip(people, method):
    p = preprocess.Preprocessor({"income": (0.0, 200.0), "kids": (0, 11)}, ["city", "sex"], rho=2.0, method=method, threshold=0.004, seed=3).fit(people)
    coded = p.transform(people)
    back = {r.row_id: r for r in p.inverse(coded).collect()}
    codes = {r.row_id: r for r in coded.collect()}
    merged = {r.value for r in p.coded["city"].values.where("merged").collect()}
    assert p.coded["city"].merged == len(merged) > 0
    edges = p.coded["income"].edges
    for r in people.collect():
        b, c = back[r.row_id], codes[r.row_id]
        assert b.sex == r.sex and (b.city in merged if r.city in merged else b.city == r.city)
        if method == "none":
            assert 0 <= c.income <= 1 and b.income == pytest.approx(r.income) and b.kids == pytest.approx(r.kids)
        else:
            assert b.kids == r.kids and edges[c.income] <= b.income <= edges[c.income + 1] and edges[c.income] <= r.income <= edges[c.income + 1]


def test_preprocessing_details(spark, people):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 7.9), (3, 12.1)], "row_id int, feature double")
    p = preprocess.Preprocessor({"feature": (0, 16)}, [], edges={"feature": [0, 4, 8, 12, 16]}).fit(df)
    assert [r.feature for r in p.transform(df).orderBy("row_id").collect()] == [0, 0, 1, 3]
    p = preprocess.Preprocessor({"feature": (0, 10)}, [], method="none").fit(df)
    some = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 10.0)], "row_id int, feature double")
    assert [r.feature for r in p.transform(some).orderBy("row_id").collect()] == [0, 0.5, 1]
    with pytest.raises(ValueError):
        preprocess.Preprocessor({}, ["sex"], method="no").fit(people)
    never = preprocess.Preprocessor({}, ["city"], threshold=-1).fit(people)
    assert never.coded["city"].merged == 0 and never.transform(spark.createDataFrame([(0, "new")], "row_id int, city string")).first().city == -1
    assert preprocess.merge_limit(1000, 0.01, 5) == 15 and preprocess.merge_limit(1000, 0.01, 0) == 10 and preprocess.merge_limit(10, -1, 5) == -math.inf
    assert preprocess.partition_histogram(np.array([1.0, 3, 5]), [(0, 2), (2, 3)], 1.0, lambda s: 0.0).tolist() == [2, 2, 5]
    assert encode.budget_shares([200, 5], [300, 400]) == (1 / 3, 2 / 3)
    edges = preprocess.privtree_edges(people, "income", 0, 200, 5.0, lambda s: 0.0)
    assert edges[0] == 0 and edges[-1] == 200 and edges == sorted(edges) and len(edges) > 4


def test_mixture(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x),) for x in np.concatenate((rng.normal(0, 1, 500), rng.normal(100, 2, 500)))], "x double")
    m = preprocess.Mixture.fit(df, "x", 2)
    assert m.means == pytest.approx([0, 100], abs=0.5) and sum(m.weights) == pytest.approx(1)
    at, place = m.normalized(F.col("x"))
    got = df.select("x", at.alias("at"), place.alias("place")).withColumn("back", m.restored(F.col("at"), F.col("place"))).collect()
    assert all(r.back == pytest.approx(r.x) and abs(r.place) <= 0.99 and r.at == int(r.x > 50) for r in got)


def test_queries_by_number():
    d = Domain({"a": 2, "b": 3, "c": 2})
    ways = [("a", "b"), ("c",), ("b", "c")]
    assert measures.number_of_queries(d, ways) == 14 and measures.query_starts(d, ways) == {("a", "b"): 0, ("c",): 6, ("b", "c"): 8}
    members = measures.query_members(d, ways)
    assert members.shape == (14, 7) and members.sum(axis=1).tolist() == [2] * 6 + [1] * 2 + [2] * 6
    rows = np.random.default_rng(0).integers(0, 2, (50, 3))
    assert measures.query_answers(members, rows, d)[4] == ((rows[:, 0] == 1) & (rows[:, 1] == 1)).mean()
    assert measures.query_members(d, ways, [6]).tolist() == [[False] * 5 + [True, False]]


def test_smoothing_and_chains():
    assert measures.smoothed(np.array([0.2, 0.4, 1.2, 9.0]), 1.0, 2.0) == pytest.approx([0.3, 0.3, 1.2, 9.0])
    rng = np.random.default_rng(0)
    chain = measures.Chained({"x": np.array([0.1, 0.9]), "y": np.array([0.5, 0.5])}, 10_000)
    got = chain.measure(1.0, rng)
    assert all(np.abs(got[k] - v).max() < 0.01 and got[k].min() >= 0 and got[k].max() <= 1 for k, v in chain.answers.items())
    fake = {"x": np.array([0.9, 0.1]), "y": np.array([0.5, 0.5])}
    assert chain.select(fake, 1.0, rng) == "x" and chain.select(fake, 1.0, rng) == "y" and chain.exact(["y"])["y"].tolist() == [0.5, 0.5]
    assert measures.workload_sensitivity(5, 100) == pytest.approx(math.sqrt(10) / 100)


def test_median_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, round(float(rng.normal(0, 50)), 2), int(rng.integers(0, 9))) for i in range(1500)]
    rows += [(2000 + i, *r[1:]) for i, r in enumerate(rows[:300])]  # equal rows

    def agrees(rows):
        whole = [r for r in rows if None not in r]
        ids, x = np.array([r[0] for r in whole]), np.array([r[1:] for r in whole], float)
        i, j = np.triu_indices(len(whole), 1)
        i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
        with np.errstate(invalid="ignore"):
            far = np.sort(np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)))  # NaN last, as in SQL
        want = 0.5 * far[(len(far) - 1) // 2] + 0.5 * far[len(far) // 2]
        got = measures.median_distance(spark.createDataFrame(rows, "id long, a double, b int"), ["a", "b"], "id").first().distance
        assert got == pytest.approx(want, rel=1e-12)

    agrees(rows)
    agrees([(None if k % 17 == 0 else r[0] % 90, None if k % 7 == 0 else r[1], None if k % 11 == 0 else r[2]) for k, r in enumerate(rows)])
    agrees([(r[0], math.inf if k % 2 else r[1], r[2]) for k, r in enumerate(rows[:200])])
    assert measures.median_distance(spark.createDataFrame([(1, 2.0), (1, 3.0)], "id long, a double"), ["a"], "id").first().distance is None


def test_pairs_of_tiles():
    rng = np.random.default_rng(6)
    x, n = np.sort(rng.normal(0, 9, 300))[:, None], rng.integers(1, 4, 300)
    each = np.repeat(x, n)
    i, j = np.triu_indices(len(each), 1)
    bits = np.sort(((each[i] - each[j]) ** 2).view(np.int64))
    for lo, hi, inside in ((0, int(bits[-1]), len(bits)), (int(bits[9000]), int(bits[50_000]), len(bits)), (int(bits[9000]), int(bits[9500]), 501), (0, 0, 9)):
        b = distances.Bracket(lo, hi, inside)
        want = distances.summed(b.place(bits[bits <= lo + ((b.last + 1) << b.shift) - 1]), np.ones(int((bits <= lo + ((b.last + 1) << b.shift) - 1).sum()), np.int64))
        got = distances.tally(x, n, x, n, True, b)
        halves = [distances.tally(x[p], n[p], x[q], n[q], p == q, b) for p, q in ((slice(0, 99), slice(0, 99)), (slice(0, 99), slice(99, 300)), (slice(99, 300), slice(99, 300)))]
        for places, counts in (got, distances.summed(*(np.concatenate(v) for v in zip(*halves, strict=True)))):
            assert places.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()


def test_public_samples(people):
    n = people.count()
    some = measures.public_sample(people, "row_id", 0.25, 1)
    assert some.count() == round(n / 4) == some.select("row_id").distinct().count()
    biased = measures.biased_sample(people, "row_id", 0.2, "sex", "M", 4.0).groupBy("sex").count().collect()
    counts = {r.sex: r["count"] for r in biased}
    assert counts["M"] == n // 2 and 0.15 * n / 2 < counts["F"] < 0.25 * n / 2
    coded = people.select("row_id", "kids", (F.col("row_id") % 2).cast("int").alias("sex"))
    rows = measures.corrupted_sample(coded, "row_id", Domain({"kids": 12, "sex": 2}), 0.5, 0.3).collect()
    assert sum(r.n for r in rows) == n // 2 and sum(r.weight for r in rows) == pytest.approx(1) and all(0 <= r.kids < 12 and r.sex in (0, 1) for r in rows)


def test_steering(spark):
    cliques = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("b", "c", "e")]
    parts = gum.parts_of(cliques, ["a", "b", "c", "d", "e", "x", "y", "z"])
    assert [p for p, _ in parts] == [("a", "b", "c", "d", "e"), ("x", "y"), ("z",)] and parts[1][1] == [("x", "y")]
    left, peeled = gum.layers(cliques[:3])
    assert peeled[0] == [("a", ("a", "b")), ("d", ("c", "d"))] and left == [("b", "c")]
    assert [gum.ratio("S4", i) for i in range(3)] == [1, 0, 1] and gum.ratio("S2", 5) == 1
    d = {"a": 2, "b": 2, "c": 2}
    records = spark.range(100).select(F.col("id").alias("row_id"), *((F.col("id") % 2).cast("int").alias(k) for k in d))
    margins = {("a", "b"): np.array([[50.0, 0], [0, 50]]), ("b", "c"): np.array([[25.0, 25], [25, 25]])}
    assert gum.by_error(records, d, margins) == [(("b", "c"), 100.0), (("a", "b"), 0.0)]
    assert gum.error(records, ("b", "c"), (2, 2), margins[("b", "c")]) == 100
    log: list[dict] = []
    done = synth.gradual_update(records, d, margins, 4, "U1", worst_first=True, errors=log)
    assert done.count() == 100 and gum.error(done, ("b", "c"), (2, 2), margins[("b", "c")]) < 100 and log[0]["error"] == 100
    domain, rng = Domain(d), np.random.default_rng(0)
    linked = spark.range(400).select((F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"), (F.floor(F.col("id") / 2) % 2).cast("int").alias("c"))
    assert select.two_way(linked, domain, 50.0, 50.0, rng)[0] == ("a", "b")


def test_models_are_kept(tmp_path):
    d = Domain({"a": 2, "b": 3})
    made = [graphical.Measurement(("a", "b"), np.arange(6.0).reshape(2, 3) + 1)]
    model = graphical.estimate(d, made, rounds=50)
    model.save(f"{tmp_path}/m.json")
    assert graphical.Model.load(f"{tmp_path}/m.json").project(("a", "b")).values == pytest.approx(model.project(("a", "b")).values)
    assert consistency.norm_cut(np.array([1.0]), 1).tolist() == [1]


def test_kept_tables(spark, people, tmp_path):
    made = []
    make = lambda: made.append(1) or people.groupBy("sex").count()
    for _ in range(2):
        assert tables.cached(spark, f"file://{tmp_path}/cache", {"method": "x", "epsilon": 1.0}, make).count() == 2
    assert len(made) == 1
    tables.register_sample("people", lambda s: people)
    assert tables.sample(spark, "People").count() == 3000
    with pytest.raises(KeyError):
        tables.sample(spark, "none")
    tables.save_tsv(people.select("kids", "city"), f"file://{tmp_path}/t.tsv", {"name": "p"})
    back, meta = tables.load_tsv(spark, f"file://{tmp_path}/t.tsv")
    assert back.schema["kids"].dataType.simpleString() == "int" and back.count() == 3000 and meta["name"] == "p"
    tables.save_parts(people, f"file://{tmp_path}/parts", ["income", "kids"], ["city", "sex"])
    assert spark.read.parquet(f"file://{tmp_path}/parts/num").columns == ["row_id", "income", "kids"]


def test_service(spark, people, tmp_path, capsys):
    df = people.select("kids", "sex", "income")
    out = service.run_synthesis(df, "independent", 5.0, n=400, seed=1, domain={"kids": {}, "sex": {}})
    scores = out.metrics()
    assert out.records.columns == ["kids", "sex"] and scores["record_count"] == 400 and set(scores["tvd"]) == {"kids", "sex"} and scores["mean_tvd"] < 0.2
    with pytest.raises(ValueError):
        service.run_synthesis(df, wrong=1)
    df.write.parquet(f"{tmp_path}/in.parquet")
    assert service.main([f"file://{tmp_path}/in.parquet", f"file://{tmp_path}/out", "--method", "independent", "--records", "50", "--seed", "2", "--metrics"]) == 0
    assert '"record_count": 50' in capsys.readouterr().out and spark.read.parquet(f"file://{tmp_path}/out").count() == 50
    assert evaluate.categorical_tvd(df, df, "sex").first().tvd == 0
