"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import noise
from .operators import encode, evaluate, hierarchy, infer, marginals, measures, overrides, preprocess, statqueries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]
INFERRED = {"lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(), "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
            "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(), "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(), "events": "event_id ts user_id event_type value props".split()}
KINDS = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "o_orderkey": "int", "o_custkey": "int", "o_totalprice": "float",
         "c_custkey": "int", "c_nationkey": "int", "c_acctbal": "float", "p_partkey": "int", "p_size": "int", "p_retailprice": "float", "event_id": "int", "user_id": "int", "value": "float"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def add(name: str, sql: str | None, of: str | None = None):
    """Registers a query; of: the table that it takes in place of (spark, sf_dir)."""

    def keep(f):
        QUERIES[name] = f if of is None else (lambda spark, sf_dir: f(table(spark, sf_dir, of)))
        if sql:
            SQL[name] = sql
        return f

    return keep


# Scans and metadata.


def _infer_sql(name: str) -> str:
    parts = []
    for c in INFERRED[name]:
        d, n = f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)", "count(*)"
        kind = KINDS.get(c, "other")
        if kind == "int":
            few, thin = f"{d} < 20", f"({d}) / {n}::DOUBLE < 0.05 AND {d} < 100"
            k, r = f"CASE WHEN {few} OR ({thin}) THEN 'categorical' ELSE 'numerical' END", f"CASE WHEN {few} THEN 'integer_unique_below_threshold' WHEN {thin} THEN 'integer_sparse_unique' ELSE 'integer_dense_unique' END"
        elif kind == "float":
            k, r = f"CASE WHEN {d} < 10 THEN 'categorical' ELSE 'numerical' END", f"CASE WHEN {d} < 10 THEN 'float_unique_low' ELSE 'float_unique_high' END"
        else:
            k, r = "'categorical'", "'non_numeric'"
        parts.append(f"SELECT '{c}' AS name, {k} AS kind, {r} AS reason, {d} AS n_distinct, count(DISTINCT {c}) AS size FROM {name}")
    return " UNION ALL ".join(parts)


for _name in INFERRED:
    add(f"infer_{_name}", _infer_sql(_name), _name)(lambda df: infer.inferred(df))

add("value_counts", "SELECT coalesce(o_orderpriority, '__NULL__') AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 50", "orders")(lambda df: infer.value_counts(df, "o_orderpriority"))
add("value_counts_null", "SELECT coalesce(CAST(nullif(l_linenumber, 1) AS VARCHAR), '__NULL__') AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 50", "lineitem")(
    lambda df: infer.value_counts(df.select(F.nullif(F.col("l_linenumber"), F.lit(1)).alias("x")), "x"))
add("first_seen", "SELECT p_brand AS value, min(p_partkey) AS first_row FROM part GROUP BY 1", "part")(lambda df: infer.first_seen(df, "p_brand", "p_partkey"))
add("numeric_summary", "SELECT round(min(l_extendedprice), 6) AS min, round(max(l_extendedprice), 6) AS max, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem", "lineitem")(
    lambda df: rounded(rounded(infer.numeric_summary(df, "l_extendedprice"), "min", "max"), "mean", "std", places=4))
add("candidate_summary", "SELECT min(TRY_CAST(substr(p_name, length(p_name) - 1, 2) AS DOUBLE)) AS min, max(TRY_CAST(substr(p_name, length(p_name) - 1, 2) AS DOUBLE)) AS max FROM part", "part")(
    lambda df: infer.candidate_summary(df.select(F.expr("substr(p_name, length(p_name) - 1, 2)").alias("x")), "x"))

# Overrides.

add("override_map_special", "SELECT CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN upper(c_mktsegment) ELSE '__OTHER__' END AS segment, count(*) AS n FROM customer GROUP BY 1", "customer")(
    lambda df: df.groupBy(overrides.map_categories(F.col("c_mktsegment"), ["BUILDING", "MACHINERY", "building"]).alias("segment")).agg(F.count("*").alias("n")))
add("override_keep", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1", "events")(
    lambda df: df.groupBy(overrides.map_categories(F.col("event_type"), ["click"], None).alias("kind")).agg(F.count("*").alias("n")))
add("override_excluded", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE lower(c_mktsegment) NOT IN ('building')", "customer")(lambda df: overrides.excluded(df, "c_mktsegment", ["Building"]))
add("clip_fill", "SELECT round(greatest(least(coalesce(nullif(l_tax, 0.0), 0.02), 0.06), 0.02), 6) AS tax, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")(
    lambda df: df.groupBy(F.round(overrides.clip(F.nullif(F.col("l_tax"), F.lit(0.0)), 0.02, 0.06), 6).alias("tax")).agg(F.count("*").alias("n")))
_UNIFORM, _EXP = overrides.bin_edges(0.0, 50.0, count=5), overrides.bin_edges(0.0, 50.0, "exponential", 4, growth=1.5)


def _edge_sql(x: str, edges: list[float]) -> str:
    return " + ".join(f"CAST({x} >= CAST({e!r} AS DOUBLE) AS INTEGER)" for e in edges[1:-1])


add("bin_edges_uniform", f"SELECT {_edge_sql('l_quantity', _UNIFORM)} AS bin, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")(lambda df: df.groupBy(encode.edge_bin(F.col("l_quantity"), _UNIFORM).alias("bin")).agg(F.count("*").alias("n")))
add("bin_edges_exponential", f"SELECT {_edge_sql('l_quantity', _EXP)} AS bin, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")(lambda df: df.groupBy(encode.edge_bin(F.col("l_quantity"), _EXP).alias("bin")).agg(F.count("*").alias("n")))

# Encoders.

add("bin_uniform", "SELECT CAST(greatest(0, least(floor((l_extendedprice - 900.0) / ((105000.0 - 900.0) / 100)), 99)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")(
    lambda df: df.groupBy(encode.uniform_bin(F.col("l_extendedprice"), 900.0, 105000.0).alias("bin")).agg(F.count("*").alias("n")))
add("bin_log", "SELECT CAST(greatest(0, least(floor((log2(o_totalprice + 0.01) - log2(0.01)) / ((log2(600000.01) - log2(0.01)) / 50)), 49)) AS INTEGER) AS bin, count(*) AS n FROM orders GROUP BY 1", "orders")(
    lambda df: df.groupBy(encode.log_bin(F.col("o_totalprice"), 0.0, 600000.0, 50).alias("bin")).agg(F.count("*").alias("n")))
add("min_max", "SELECT o_orderkey, round(o_totalprice / 654321.0, 6) AS scaled FROM orders", "orders")(lambda df: df.select("o_orderkey", F.round(encode.min_max(F.col("o_totalprice"), 0.0, 654321.0), 6).alias("scaled")))
add("edge_middle", f"SELECT {_edge_sql('l_quantity', _UNIFORM)} * 10.0 + 5.0 AS middle, count(*) AS n FROM lineitem GROUP BY 1".replace("SELECT ", "SELECT (").replace(" * 10.0", ") * 10.0"), "lineitem")(
    lambda df: df.groupBy(encode.edge_middle(encode.edge_bin(F.col("l_quantity"), _UNIFORM), _UNIFORM).alias("middle")).agg(F.count("*").alias("n")))
add("ordinal", "SELECT p_name AS value, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_name FROM part)", "part")(lambda df: encode.ordinal(df, "p_name"))
add("ordinal_encoded", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders", "orders")(
    lambda df: encode.ordinal_encoded(df, "o_orderpriority", "code").select("o_orderkey", "code"))
add("by_frequency", "SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS code FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1)", "part")(lambda df: encode.by_frequency(df, "p_brand"))
add("one_hot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS s0, CAST(o_orderstatus = 'O' AS INTEGER) AS s1, CAST(o_orderstatus = 'P' AS INTEGER) AS s2 FROM orders", "orders")(
    lambda df: df.select("o_orderkey", *encode.one_hot(F.col("o_orderstatus"), ["F", "O", "P"], "s")))
add("rare_merge", "SELECT CASE WHEN n > (SELECT count(*) FROM part) * 0.0405 THEN p_brand ELSE 'R' END AS brand, CAST(sum(n) AS BIGINT) AS n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) GROUP BY 1", "part")(
    lambda df: encode.rare_merged(df.select("p_brand"), "p_brand", 0.0405).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")))
add("interval_code", "SELECT CASE WHEN l_quantity >= 10 AND l_quantity < 20 THEN 0 WHEN l_quantity >= 20 AND l_quantity < 45 THEN 1 ELSE -1 END AS code, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")(
    lambda df: df.groupBy(encode.interval_code(F.col("l_quantity"), [(10, 20), (20, 45)]).alias("code")).agg(F.count("*").alias("n")))
add("quantile_interval", "SELECT quantile_disc(l_extendedprice, 0.05) AS low, quantile_disc(l_extendedprice, 0.95) AS high FROM lineitem", "lineitem")(lambda df: encode.quantile_interval(df, "l_extendedprice", 0.05, 0.95))
add("equal_frequency", "SELECT value, CAST(least(floor((upto - n / 2.0) * 8 / total), 7) AS INTEGER) AS bin FROM (SELECT value, n, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total FROM (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1))", "lineitem")(
    lambda df: encode.equal_frequency(df, "l_quantity", 8))

# Marginals.

for _k in (1, 2, 3):
    add(f"marginal_{_k}way", f"SELECT {', '.join(FLAGS[:_k])}, count(*) AS n FROM lineitem GROUP BY {', '.join(FLAGS[:_k])}", "lineitem")(lambda df, k=_k: marginals.marginal(df, FLAGS[:k]))
add("marginal_weighted", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS n FROM lineitem GROUP BY 1, 2", "lineitem")(lambda df: rounded(marginals.marginal(df, FLAGS[:2], "l_quantity"), "n", places=4))
_DENSE = "SELECT a.o_orderstatus, b.o_orderpriority, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'P') o ON o.o_orderstatus = a.o_orderstatus AND o.o_orderpriority = b.o_orderpriority GROUP BY 1, 2"
add("marginal_dense", _DENSE.replace("(SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'P')", "orders"), "orders")(lambda df: marginals.dense(df, ["o_orderstatus", "o_orderpriority"]))
add("marginal_normalized", "SELECT l_returnflag, n, round(n / sum(n) OVER (), 6) AS p FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)", "lineitem")(lambda df: rounded(marginals.normalized(marginals.marginal(df, ["l_returnflag"])), "p"))
add("marginal_rollup", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")(lambda df: marginals.rollup_to(marginals.marginal(df, FLAGS), ["l_linestatus"]))
add("cell_keys", "SELECT CAST((l_linenumber - 1) * 11 + CAST(round(l_discount * 100) AS INTEGER) AS BIGINT) AS cell, count(*) AS n FROM lineitem GROUP BY 1", "lineitem")(
    lambda df: df.select((F.col("l_linenumber") - 1).alias("a"), F.round(F.col("l_discount") * 100).cast("int").alias("b")).groupBy(marginals.cell_key(["a", "b"], [7, 11]).alias("cell")).agg(F.count("*").alias("n")))


def _kway_sql(attrs: list[str], ways: tuple[int, ...], source: str) -> str:
    parts = []
    for s in marginals.subsets(attrs, ways):
        cols = ", ".join(f"CAST({a} AS VARCHAR) AS {a}" if a in s else f"CAST(NULL AS VARCHAR) AS {a}" for a in attrs)
        parts.append(f"SELECT '{','.join(s)}' AS marginal, {cols}, count(*) AS n FROM {source} GROUP BY {', '.join(s)}")
    return " UNION ALL ".join(parts)


add("kway_all", _kway_sql(FLAGS, (1, 2, 3), "lineitem"), "lineitem")(lambda df: marginals.all_marginals(df, FLAGS, (1, 2, 3)))


def _pair_sql(t: str, a: str, b: str) -> str:
    return (f"SELECT x.{a} AS va, y.{b} AS vb, x.n AS na, y.n AS nb, coalesce(j.n, 0) AS n, (SELECT count(*) FROM {t}) AS total FROM (SELECT {a}, count(*) AS n FROM {t} GROUP BY 1) x "
            f"CROSS JOIN (SELECT {b}, count(*) AS n FROM {t} GROUP BY 1) y LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM {t} GROUP BY 1, 2) j ON j.{a} = x.{a} AND j.{b} = y.{b}")  # fmt: skip


for _t, _a, _b in (("lineitem", "l_returnflag", "l_linestatus"), ("orders", "o_orderstatus", "o_orderpriority"), ("part", "p_brand", "p_type")):
    _cells = _pair_sql(_t, _a, _b)
    add(f"indif_{_t}", f"SELECT round(sum(abs(n - na * nb / total::DOUBLE)), 4) AS indif, count(*) AS num_cells FROM ({_cells})", _t)(lambda df, a=_a, b=_b: rounded(marginals.indif(df, a, b), "indif", places=4))
    add(f"pair_tvd_{_t}", f"SELECT round(sum(abs(n - na * nb / total::DOUBLE)) / 2 / max(total), 6) AS tvd FROM ({_cells})", _t)(lambda df, a=_a, b=_b: rounded(marginals.pair_tvd(df, a, b), "tvd"))
    add(f"mutual_info_{_t}", f"SELECT round(sum(n / total::DOUBLE * ln(n * total::DOUBLE / (na::DOUBLE * nb))), 6) AS mutual_information FROM ({_cells}) WHERE n > 0", _t)(lambda df, a=_a, b=_b: rounded(marginals.mutual_information(df, a, b), "mutual_information"))
    add(f"entropy_{_t}", f"SELECT round(sum(-p * ln(p)), 6) AS entropy FROM (SELECT n / sum(n) OVER () AS p FROM (SELECT count(*) AS n FROM {_t} GROUP BY {_a}, {_b}))", _t)(lambda df, a=_a, b=_b: rounded(marginals.entropy(df, [a, b]), "entropy"))
add("indif_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(abs(n - na * nb / total::DOUBLE)), 4) AS indif, count(*) AS num_cells FROM ({_pair_sql('lineitem', a, b)})" for a, b in (FLAGS[:2], (FLAGS[0], FLAGS[2]), FLAGS[1:])), "lineitem")(
    lambda df: rounded(marginals.indif_pairs(df, FLAGS), "indif", places=4))
_HALVES = ("(SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)", "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)")


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("l_orderkey % 2 = 0"), df.where("l_orderkey % 2 = 1")


add("l1_distance", f"SELECT CAST(sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0))) AS BIGINT) AS l1 FROM (SELECT l_linenumber AS v, count(*) AS n FROM {_HALVES[0]} GROUP BY 1) x FULL JOIN (SELECT l_linenumber AS v, count(*) AS n FROM {_HALVES[1]} GROUP BY 1) y ON x.v = y.v", "lineitem")(
    lambda df: marginals.l1_distance(*(marginals.marginal(h, ["l_linenumber"]) for h in _halves(df)), ["l_linenumber"]))


def _u_sql(key: str, seed: str) -> str:
    return f"((('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


add("noisy_marginal_hash", f"SELECT l_returnflag, l_linestatus, n, round(n + sqrt(-2.0 * ln({_u_sql('k', 'sa')})) * cos(2 * pi() * {_u_sql('k', 'sb')}) * 10.0, 4) AS noisy FROM (SELECT l_returnflag, l_linestatus, l_returnflag || '|' || l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)", "lineitem")(
    lambda df: rounded(marginals.noisy(marginals.marginal(df, FLAGS[:2]), FLAGS[:2], 10.0, "s"), "noisy", places=4))
add("topq_gumbel_hash", f"SELECT p_brand, n, round(n - ln(-ln({_u_sql('p_brand', 'g')})) * 5.0, 4) AS noisy FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY noisy DESC, p_brand LIMIT 5", "part")(
    lambda df: rounded(marginals.top_by_gumbel(marginals.marginal(df, ["p_brand"]), "p_brand", "n", 5, 5.0, "g"), "noisy", places=4))

# Counting queries.

add("prefix_queries", "SELECT 'p0' AS query, avg(CAST(l_quantity < 25 AND l_discount < 0.05 AS INTEGER)) AS answer FROM lineitem UNION ALL SELECT 'p1', avg(CAST(l_tax < 0.04 AND l_returnflag = 'R' AS INTEGER)) FROM lineitem".replace("avg(", "round(avg(").replace("INTEGER))", "INTEGER)), 6)"), "lineitem")(
    lambda df: rounded(statqueries.share(df, {"p0": statqueries.prefix({"l_quantity": 25, "l_discount": 0.05}), "p1": statqueries.prefix({"l_tax": 0.04}, {"l_returnflag": "R"})}), "answer"))
add("halfspace_queries", "SELECT 'h0' AS query, round(avg(CAST(l_quantity * 0.02::DOUBLE + l_discount * (-3.0)::DOUBLE - 0.35::DOUBLE > 0 AS INTEGER)), 6) AS answer FROM lineitem", "lineitem")(
    lambda df: rounded(statqueries.share(df, {"h0": statqueries.halfspace({"l_quantity": 0.02, "l_discount": -3.0}, 0.35)}), "answer"))
add("smooth_prefix", "SELECT round(avg(1 / (1 + exp(-4.0 * (0.05::DOUBLE - l_discount))) * (1 / (1 + exp(-4.0 * (0.04::DOUBLE - l_tax))))), 6) AS answer FROM lineitem", "lineitem")(
    lambda df: rounded(statqueries.smooth_prefix(df, {"l_discount": 0.05, "l_tax": 0.04}, 4.0), "answer"))
add("conditional_marginal", "SELECT l_returnflag, l_linestatus, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS p FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)", "lineitem")(
    lambda df: rounded(statqueries.conditional(df, ["l_returnflag"], "l_linestatus"), "p"))
_Q = "(SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)"
add("prefix_sums", f"SELECT l_quantity, n, CAST(sum(n) OVER (ORDER BY l_quantity) AS BIGINT) AS prefix FROM {_Q}", "lineitem")(lambda df: statqueries.prefix_sums(marginals.marginal(df, ["l_quantity"]), "l_quantity"))
add("suffix_sums", f"SELECT l_quantity, n, CAST(sum(n) OVER (ORDER BY l_quantity DESC) AS BIGINT) AS suffix FROM {_Q}", "lineitem")(lambda df: statqueries.suffix_sums(marginals.marginal(df, ["l_quantity"]), "l_quantity"))
add("width_sums", f"SELECT l_quantity, total FROM (SELECT l_quantity, CAST(sum(n) OVER w AS BIGINT) AS total, count(*) OVER w AS c FROM {_Q} WINDOW w AS (ORDER BY l_quantity ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5", "lineitem")(
    lambda df: statqueries.width_sums(marginals.marginal(df, ["l_quantity"]), "l_quantity", 5))
add("all_ranges", f"SELECT a.l_quantity AS lo, b.l_quantity AS hi, CAST(sum(c.n) AS BIGINT) AS total FROM {_Q} a JOIN {_Q} b ON a.l_quantity <= b.l_quantity JOIN {_Q} c ON c.l_quantity BETWEEN a.l_quantity AND b.l_quantity GROUP BY 1, 2", "lineitem")(
    lambda df: statqueries.all_ranges(marginals.marginal(df, ["l_quantity"]), "l_quantity"))
add("moments", "SELECT CAST(count(*) AS DOUBLE) AS m0, round(sum(l_quantity), 2) AS m1, round(sum(l_quantity ** 2), 2) AS m2, round(sum(l_quantity ** 3), 2) AS m3 FROM lineitem", "lineitem")(
    lambda df: rounded(statqueries.moments(df, "l_quantity", 3), "m0", "m1", "m2", "m3", places=2))
add("fourier_mean", "SELECT l_returnflag, round(avg(cos(l_discount * 7.0 + l_tax * (-3.0))), 6) AS cos0, round(avg(sin(l_discount * 7.0 + l_tax * (-3.0))), 6) AS sin0 FROM lineitem GROUP BY 1", "lineitem")(
    lambda df: rounded(statqueries.fourier_mean(df, ["l_discount", "l_tax"], [[7.0, -3.0]], "l_returnflag"), "cos0", "sin0"))
add("class_weights", "SELECT o_orderpriority, n, round(n / sum(n) OVER (), 6) AS weight FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)", "orders")(lambda df: rounded(statqueries.class_weights(df, "o_orderpriority"), "weight"))
add("distribution_rank", "SELECT DISTINCT l_quantity AS value, round(cume_dist() OVER (ORDER BY l_quantity), 6) AS cume_dist FROM lineitem", "lineitem")(lambda df: rounded(statqueries.distribution_rank(df, "l_quantity"), "cume_dist"))
add("mmd_linear", f"SELECT round((x.a - y.a) ** 2 + (x.b - y.b) ** 2, 8) AS mmd2 FROM (SELECT avg(l_quantity) AS a, avg(l_discount) AS b FROM {_HALVES[0]}) x, (SELECT avg(l_quantity) AS a, avg(l_discount) AS b FROM {_HALVES[1]}) y", "lineitem")(
    lambda df: rounded(statqueries.mmd_linear(*_halves(df), ["l_quantity", "l_discount"]), "mmd2", places=8))
add("support", "SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (), 6) AS weight FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)", "orders")(lambda df: rounded(statqueries.support(df, ["o_orderstatus", "o_orderpriority"]), "weight"))

# Hierarchies.

_LEVELS = """
WITH c AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1),
a AS (SELECT value, n, CAST((2 * sum(n) OVER (ORDER BY value) - n) * 2 // (2 * sum(n) OVER ()) AS BIGINT) AS g1 FROM c),
h AS (SELECT value, n, g1, g1 * 2 + CAST((2 * sum(n) OVER (PARTITION BY g1 ORDER BY value) - n) * 2 // (2 * sum(n) OVER (PARTITION BY g1)) AS BIGINT) AS g2 FROM a)
"""
add("hierarchy", _LEVELS + "SELECT value, n, g1, g2 FROM h", "lineitem")(
    lambda df: hierarchy.hierarchy(df, "l_quantity", 2, 2).select("value", "n", hierarchy.group_at(F.col("path"), 2, 1).alias("g1"), hierarchy.group_at(F.col("path"), 2, 2).alias("g2")))
add("rolled_up", _LEVELS + "SELECT l_returnflag, g2 AS quantity_group, count(*) AS n FROM lineitem l JOIN h ON l.l_quantity = h.value GROUP BY 1, 2", "lineitem")(
    lambda df: hierarchy.rolled_up(df.select("l_returnflag", "l_quantity"), "l_quantity", hierarchy.hierarchy(df, "l_quantity", 2, 2), 2, out="quantity_group").groupBy("l_returnflag", "quantity_group").agg(F.count("*").alias("n")))

# Evaluation: even order keys against odd ones.


def _tvd_sql(value: str, label: str | None = None) -> str:
    side = [f"(SELECT v, n / sum(n) OVER () AS p FROM (SELECT v, count(*) AS n FROM (SELECT {value} AS v FROM {h}) WHERE v IS NOT NULL GROUP BY 1))" for h in _HALVES]
    return f"SELECT {f"'{label}' AS column, " if label else ''}round(sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) / 2, 6) AS tvd FROM {side[0]} x FULL JOIN {side[1]} y ON x.v = y.v"


_CUT = [0.0, 10.0, 20.0, 30.0, 40.0]
_CUT_SQL = f"CASE WHEN l_quantity >= 0 AND l_quantity <= 40 THEN {_edge_sql('l_quantity', _CUT)} END"
add("tvd_categorical", _tvd_sql("nullif(l_returnflag, 'A')"), "lineitem")(lambda df: rounded(evaluate.categorical_tvd(*(h.select(F.nullif(F.col("l_returnflag"), F.lit("A")).alias("x")) for h in _halves(df)), "x"), "tvd"))
add("tvd_numeric_edges", _tvd_sql(_CUT_SQL), "lineitem")(lambda df: rounded(evaluate.numeric_tvd(*_halves(df), "l_quantity", _CUT), "tvd"))
add("tvd_numeric", _tvd_sql("least(floor((l_quantity - 1.0) / 4.9), 9)"), "lineitem")(lambda df: rounded(evaluate.numeric_tvd(*_halves(df), "l_quantity"), "tvd"))
add("tvd_table", " UNION ALL ".join((_tvd_sql("l_returnflag", "l_returnflag"), _tvd_sql("l_linenumber", "l_linenumber"), _tvd_sql(_CUT_SQL, "l_quantity"))).replace("AS column", 'AS "column"'), "lineitem")(
    lambda df: rounded(evaluate.tvd_table(*_halves(df), {"l_returnflag": "categorical", "l_linenumber": "categorical", "l_quantity": "numerical"}, {"l_quantity": _CUT}), "tvd"))


def _kway_tvd_sql(ways: tuple[int, ...]) -> str:
    parts = []
    for s in marginals.subsets(FLAGS, ways):
        key = " || '|' || ".join(f"CAST({a} AS VARCHAR)" for a in s)
        parts.append(_tvd_sql(key).replace("SELECT round", f"SELECT '{','.join(s)}' AS marginal, round", 1))
    return " UNION ALL ".join(parts)


add("tvd_kway", _kway_tvd_sql((1, 2, 3)), "lineitem")(lambda df: rounded(evaluate.marginal_tvd(*_halves(df), FLAGS, (1, 2, 3)), "tvd"))
add("answer_errors", "WITH g AS (SELECT abs(x.p - y.p) AS e FROM (SELECT l_linenumber AS v, count(*) / (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 0)::DOUBLE AS p FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) x JOIN "
    "(SELECT l_linenumber AS v, count(*) / (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 1)::DOUBLE AS p FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1) y ON x.v = y.v) SELECT round(max(e), 6) AS max_error, round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error, round(avg(e * e), 8) AS mean_squared FROM g", "lineitem")(
    lambda df: rounded(rounded(evaluate.answer_errors(*(marginals.normalized(marginals.marginal(h, ["l_linenumber"])).select(F.col("l_linenumber").alias("query"), F.col("p").alias("answer")) for h in _halves(df))), "max_error", "mean_error", "median_error"), "mean_squared", places=8))


# Fitted preprocessing, without noise so that SQL can follow it.


def _prepared(df: DataFrame, **more: object) -> preprocess.Preprocessor:
    return preprocess.Preprocessor({"l_extendedprice": (900.0, 105000.0), "l_quantity": (1.0, 50.0)}, ["l_returnflag", "l_partkey"], threshold=0.0006, **more).fit(df)


_KEPT = "(SELECT l_partkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1)"
_CODES = f"""
WITH total AS (SELECT count(*) AS t, count(DISTINCT l_partkey) AS d FROM lineitem), counts AS {_KEPT},
marked AS (SELECT value, d >= 100 AND n <= t * 0.0006 AS merged FROM counts, total),
kept AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM marked WHERE NOT merged),
quantities AS (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) - 1 AS code FROM (SELECT DISTINCT l_quantity FROM lineitem)),
flags AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem))
"""
add("preprocess_codes", _CODES + """SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(floor((l_extendedprice - 900.0) / 1041.0), 99)) AS INTEGER) AS l_extendedprice, CAST(q.code AS INTEGER) AS l_quantity,
CAST(f.code AS INTEGER) AS l_returnflag, CAST(coalesce(k.code, (SELECT count(*) FROM kept)) AS INTEGER) AS l_partkey
FROM lineitem l JOIN quantities q ON l.l_quantity = q.l_quantity JOIN flags f ON l.l_returnflag = f.l_returnflag LEFT JOIN kept k ON l.l_partkey::VARCHAR = k.value""", "lineitem")(
    lambda df: _prepared(df).transform(df).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag", "l_partkey"))
add("preprocess_round_trip", "SELECT l_returnflag, l_quantity::VARCHAR AS l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2", "lineitem")(
    lambda df: (lambda p: p.inverse(p.transform(df).withColumn("row_id", F.monotonically_increasing_id())))(_prepared(df)).groupBy("l_returnflag", F.col("l_quantity").cast("string").alias("l_quantity")).agg(F.count("*").alias("n")))
add("rare_categories", _CODES + "SELECT m.value, CAST(coalesce(k.code, (SELECT count(*) FROM kept)) AS INTEGER) AS code, m.merged FROM marked m LEFT JOIN kept k ON m.value = k.value", "lineitem")(
    lambda df: _prepared(df).coded["l_partkey"].values)
add("clipped_codes", "SELECT l_orderkey, l_linenumber, greatest(0, least(l_linenumber - 3, 2)) AS code FROM lineitem", "lineitem")(lambda df: df.select("l_orderkey", "l_linenumber", preprocess.clipped(F.col("l_linenumber") - 3, 3).alias("code")))
add("angles", "SELECT o_orderkey, round(o_totalprice / 654321.0 * pi(), 6) AS angle FROM orders", "orders")(lambda df: df.select("o_orderkey", F.round(preprocess.to_angle(F.col("o_totalprice"), 0.0, 654321.0), 6).alias("angle")))

# Statistics over many marginals.

_FINE = "CAST(greatest(0, least(floor((l_quantity - 1.0) / (49.0 / 32)), 31)) AS INTEGER)"
_MULTI = " UNION ALL ".join(
    [f"SELECT 'l_returnflag' AS first, 'l_quantity' AS second, {b} AS bins, l_returnflag AS a, CAST(floor({_FINE} * {b} / 32.0) AS BIGINT)::VARCHAR AS b, count(*) AS n FROM lineitem GROUP BY ALL" for b in (2, 8, 32)]
    + ["SELECT 'l_returnflag', 'l_linestatus', 0, l_returnflag, l_linestatus, count(*) FROM lineitem GROUP BY ALL"]
    + [f"SELECT 'l_linestatus', 'l_quantity', {b}, l_linestatus, CAST(floor({_FINE} * {b} / 32.0) AS BIGINT)::VARCHAR, count(*) FROM lineitem GROUP BY ALL" for b in (2, 8, 32)])
add("multiresolution", _MULTI, "lineitem")(lambda df: measures.multiresolution(df, ["l_returnflag", "l_linestatus"], {"l_quantity": (1.0, 50.0)}, (2, 8, 32)))
add("count_matrix", "SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (WHERE l_linenumber = {k + 1}) AS c{k}" for k in range(7)) + " FROM lineitem GROUP BY 1", "lineitem")(
    lambda df: measures.count_matrix(df, "l_returnflag", "l_linenumber", range(1, 8)))
add("record_count", "SELECT count(*) AS record_count FROM lineitem", "lineitem")(measures.record_count)


def _answers(df: DataFrame) -> DataFrame:
    out = None
    for name in ("l_linenumber", "l_returnflag"):
        part = marginals.normalized(marginals.marginal(df, [name])).select(F.lit(name).alias("workload"), F.col(name).cast("string").alias("query"), F.col("p").alias("answer"))
        out = part if out is None else out.unionAll(part)
    return out


def _answer_sql(odd: int) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS workload, {c}::VARCHAR AS query, count(*) / (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = {odd})::DOUBLE AS answer FROM lineitem WHERE l_orderkey % 2 = {odd} GROUP BY 2" for c in ("l_linenumber", "l_returnflag"))


_ERRORS = f"""SELECT workload, max(abs(coalesce(x.answer, 0) - coalesce(y.answer, 0))) AS max_error, avg((coalesce(x.answer, 0) - coalesce(y.answer, 0)) ** 2) AS mean_squared
FROM ({_answer_sql(0)}) x FULL JOIN ({_answer_sql(1)}) y USING (workload, query) GROUP BY workload"""
add("workload_errors", f"SELECT workload, round(max_error, 6) AS max_error, round(mean_squared, 9) AS mean_squared FROM ({_ERRORS})", "lineitem")(
    lambda df: rounded(rounded(measures.workload_errors(*(_answers(h) for h in _halves(df))), "max_error"), "mean_squared", places=9))
add("two_level_error", f"SELECT round(max(max_error), 6) AS max_error, round(avg(mean_squared), 9) AS mean_squared FROM ({_ERRORS})", "lineitem")(
    lambda df: rounded(rounded(measures.two_level_error(measures.workload_errors(*(_answers(h) for h in _halves(df)))), "max_error"), "mean_squared", places=9).select("max_error", "mean_squared"))
add("median_distance", "SELECT round(median(sqrt((x.s_acctbal - y.s_acctbal) ** 2 + (x.s_nationkey - y.s_nationkey) ** 2)), 6) AS distance FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey", "supplier")(
    lambda df: rounded(measures.median_distance(df, ["s_acctbal", "s_nationkey"], "s_suppkey"), "distance"))
_MEAN = "(SELECT avg(exp(-((x.s_nationkey - y.s_nationkey) ** 2) / 50.0)) FROM (SELECT * FROM supplier WHERE s_suppkey % 2 = {0}) x, (SELECT * FROM supplier WHERE s_suppkey % 2 = {1}) y)"
add("mmd_gaussian", f"SELECT round({_MEAN.format(0, 0)} + {_MEAN.format(1, 1)} - 2 * {_MEAN.format(0, 1)}, 9) AS mmd2", "supplier")(
    lambda df: rounded(measures.mmd_gaussian(df.where("s_suppkey % 2 = 0"), df.where("s_suppkey % 2 = 1"), ["s_nationkey"], "s_suppkey", 5.0), "mmd2", places=9))
