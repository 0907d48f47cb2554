"""Queries of preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import preprocess as P
from quarry.plans.metrics import _t

X = ["l_quantity", "l_extendedprice", "l_discount"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def line(s, d, columns=X):
    return _t(s, d, "lineitem").select(*KEY, *columns)


def holes(s, d):
    return _t(s, d, "orders").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.col("o_totalprice")).alias("x"), F.when(F.pmod("o_orderkey", F.lit(5)) != 0, F.substring("o_orderpriority", 1, 1).cast("double")).alias("z"))


HOLES = "t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x, CASE WHEN o_orderkey % 5 <> 0 THEN substr(o_orderpriority, 1, 1)::DOUBLE END AS z FROM orders)"
K = ", ".join(KEY)


def scaled(f):
    """SQL that applies ``f(column, alias of the statistics)`` to each feature."""
    return f"SELECT {K}, " + ", ".join(f"round({f(c)}, 6) AS {c}" for c in X) + " FROM lineitem, z"


def stats(*fs):
    return "WITH z AS (SELECT " + ", ".join(f"{f.format(c)} AS {c}_{i}" for c in X for i, f in enumerate(fs)) + " FROM lineitem) "


QUERIES = {
    "standard_scaler": (lambda s, d: rounded(P.standard_scaler(line(s, d), X).transform(line(s, d))), stats("avg({})", "stddev_pop({})") + scaled(lambda c: f"({c} - {c}_0) / {c}_1")),
    "standard_scaler_inverse": (lambda s, d: rounded((m := P.standard_scaler(line(s, d), X)).inverse_transform(m.transform(line(s, d))), 4), f"SELECT {K}, " + ", ".join(f"round({c}, 4) AS {c}" for c in X) + " FROM lineitem"),
    "min_max_scaler": (lambda s, d: rounded(P.min_max_scaler(line(s, d), X).transform(line(s, d))), stats("min({})", "max({})") + scaled(lambda c: f"({c} - {c}_0) / ({c}_1 - {c}_0)")),
    "max_abs_scaler": (lambda s, d: rounded(P.max_abs_scaler(line(s, d), X).transform(line(s, d))), stats("max(abs({}))") + scaled(lambda c: f"{c} / {c}_0")),
    "robust_scaler": (lambda s, d: rounded(P.robust_scaler(line(s, d), X).transform(line(s, d))), stats("quantile_cont({}, 0.5)", "quantile_cont({}, 0.75) - quantile_cont({0}, 0.25)".replace("{}", "{0}")) + scaled(lambda c: f"({c} - {c}_0) / {c}_1")),
    "normalize_l1": (lambda s, d: rounded(P.normalize(line(s, d), X, "l1")), f"SELECT {K}, " + ", ".join(f"round({c} / (abs(l_quantity) + abs(l_extendedprice) + abs(l_discount)), 6) AS {c}" for c in X) + " FROM lineitem"),
    "normalize_l2": (lambda s, d: rounded(P.normalize(line(s, d), X)), f"SELECT {K}, " + ", ".join(f"round({c} / sqrt(l_quantity ** 2 + l_extendedprice ** 2 + l_discount ** 2), 6) AS {c}" for c in X) + " FROM lineitem"),
    "binarizer": (lambda s, d: P.binarize(line(s, d, ["l_quantity"]), ["l_quantity"], 25.0), f"SELECT {K}, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l_quantity FROM lineitem"),
    "function_transformer": (lambda s, d: rounded(P.function_transform(line(s, d, ["l_extendedprice"]), ["l_extendedprice"], F.log1p)), f"SELECT {K}, round(ln(1 + l_extendedprice), 6) AS l_extendedprice FROM lineitem"),
    "polynomial_features": (lambda s, d: rounded(P.polynomial(_t(s, d, "lineitem").select(*KEY, "l_quantity", "l_discount"), ["l_quantity", "l_discount"])), f"SELECT {K}, l_quantity, l_discount, 1.0::DOUBLE AS poly_0, l_quantity AS poly_1, l_discount AS poly_2, round(l_quantity * l_quantity, 6) AS poly_3, round(l_quantity * l_discount, 6) AS poly_4, round(l_discount * l_discount, 6) AS poly_5 FROM lineitem"),
    "kbins_uniform": (lambda s, d: P.kbins(p := _t(s, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).transform(p), "WITH z AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) SELECT p_partkey, ((p_retailprice >= a + (b - a) * 1 / 5)::INT + (p_retailprice >= a + (b - a) * 2 / 5)::INT + (p_retailprice >= a + (b - a) * 3 / 5)::INT + (p_retailprice >= a + (b - a) * 4 / 5)::INT)::DOUBLE AS p_retailprice FROM part, z"),
    "kbins_quantile": (lambda s, d: P.kbins(p := _t(s, d, "part").select("p_partkey", "p_size"), ["p_size"], 4, "quantile").transform(p), "WITH z AS (SELECT quantile_cont(p_size, [0.25, 0.5, 0.75]) AS q FROM part) SELECT p_partkey, ((p_size >= q[1])::INT + (p_size >= q[2])::INT + (p_size >= q[3])::INT)::DOUBLE AS p_size FROM part, z"),
    "kbins_kmeans": (lambda s, d: P.kbins(p := _t(s, d, "part").select("p_partkey", "p_size"), ["p_size"], 3, "kmeans").transform(p), """
WITH RECURSIVE s AS (SELECT min(p_size) AS a, (max(p_size) - min(p_size)) / 3 AS w FROM part), g AS (SELECT p_size::DOUBLE AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT 0 AS it, a + w / 2 AS x, a + w * 1.5 AS y, a + w * 2.5 AS z, true AS moved FROM s
UNION ALL SELECT it + 1, u, v, w, u <> x OR v <> y OR w <> z FROM (SELECT it, x, y, z, coalesce(sum(g.v * n) FILTER (g.v < (x + y) / 2) / sum(n) FILTER (g.v < (x + y) / 2), x) AS u, coalesce(sum(g.v * n) FILTER (g.v >= (x + y) / 2 AND g.v < (y + z) / 2) / sum(n) FILTER (g.v >= (x + y) / 2 AND g.v < (y + z) / 2), y) AS v,
coalesce(sum(g.v * n) FILTER (g.v >= (y + z) / 2) / sum(n) FILTER (g.v >= (y + z) / 2), z) AS w FROM r, g WHERE moved AND it < 300 GROUP BY it, x, y, z)), l AS (FROM r ORDER BY it DESC LIMIT 1) SELECT p_partkey, ((p_size >= (x + y) / 2)::INT + (p_size >= (y + z) / 2)::INT)::DOUBLE AS p_size FROM part, l"""),
    "quantile_transformer": (lambda s, d: rounded(P.quantile_transformer(p := _t(s, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], 5).transform(p)), """
WITH z AS (SELECT quantile_cont(p_retailprice, 0) AS a, quantile_cont(p_retailprice, 0.25) AS b, quantile_cont(p_retailprice, 0.5) AS c, quantile_cont(p_retailprice, 0.75) AS e, quantile_cont(p_retailprice, 1) AS f FROM part)
SELECT p_partkey, round(CASE WHEN p_retailprice < b THEN (p_retailprice - a) / (b - a) WHEN p_retailprice < c THEN 1 + (p_retailprice - b) / (c - b) WHEN p_retailprice < e THEN 2 + (p_retailprice - c) / (e - c) ELSE 3 + (p_retailprice - e) / (f - e) END / 4, 6) AS p_retailprice FROM part, z"""),
    "power_transformer": (lambda s, d: rounded(P.power_transformer(p := _t(s, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("x")), ["x"]).transform(p), 3), None),
    "spline_transformer": (lambda s, d: rounded(P.spline_basis(_t(s, d, "part").select("p_partkey", "p_size"), "p_size", 3, 1)), """
WITH z AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b FROM part), t AS (SELECT p_partkey, p_size, (p_size - a) / ((b - a) / 2) AS u FROM part, z)
SELECT p_partkey, p_size, round(greatest(0, 1 - u), 6) AS p_size_sp0, round(greatest(0, 1 - abs(u - 1)), 6) AS p_size_sp1, round(greatest(0, u - 1), 6) AS p_size_sp2 FROM t"""),
    "one_hot_encoder": (lambda s, d: P.one_hot(_t(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 4).alias("n")), "n"), "SELECT s_suppkey, s_nationkey % 4 AS n, (s_nationkey % 4 = 0)::INT::DOUBLE AS n_0, (s_nationkey % 4 = 1)::INT::DOUBLE AS n_1, (s_nationkey % 4 = 2)::INT::DOUBLE AS n_2, (s_nationkey % 4 = 3)::INT::DOUBLE AS n_3 FROM supplier"),
    "label_encoder": (lambda s, d: P.encode(c := _t(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", P.label_encoder(c, "c_mktsegment")), "WITH l AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_mktsegment, c_custkey, code FROM customer JOIN l USING (c_mktsegment)"),
    "ordinal_encoder": (lambda s, d: P.encode(c := _t(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", P.ordinal_encoder(c, "c_mktsegment", "c_custkey")), "WITH l AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY min(c_custkey)) - 1)::INT AS code FROM customer GROUP BY 1) SELECT c_mktsegment, c_custkey, code FROM customer JOIN l USING (c_mktsegment)"),
    "label_binarizer": (lambda s, d: P.label_binarizer(_t(s, d, "lineitem").select(*KEY, "l_linestatus"), "l_linestatus"), f"SELECT {K}, l_linestatus, (l_linestatus = 'O')::INT AS l_linestatus_is_O FROM lineitem"),
    "multi_label_binarizer": (lambda s, d: P.multi_label_binarizer(_t(s, d, "nation").select("n_nationkey", F.array((F.col("n_regionkey")).cast("string"), (F.col("n_nationkey") % 2).cast("string")).alias("tags")), "tags").drop("tags"), "SELECT n_nationkey, " + ", ".join(f"(n_regionkey = {k} OR n_nationkey % 2 = {k})::INT AS tags_has_{k}" for k in range(5)) + " FROM nation"),
    "binary_encoder": (lambda s, d: P.binary_encoder(_t(s, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey"), "SELECT s_suppkey, s_nationkey, " + ", ".join(f"((s_nationkey >> {4 - k}) & 1)::DOUBLE AS s_nationkey_b{k}" for k in range(5)) + " FROM supplier"),
    "target_encoder": (lambda s, d: rounded(P.target_encoder(_t(s, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1000).alias("y")), "o_orderpriority", "y")), "WITH g AS (SELECT avg(o_totalprice / 1000) AS m FROM orders) SELECT o_orderpriority, round((sum(o_totalprice / 1000) + any_value(m)) / (count(*) + 1), 6) AS encoded FROM orders, g GROUP BY 1"),
    "impute_mean": (lambda s, d: rounded(P.simple_imputer(holes(s, d), ["x", "z"]), 4), f"WITH {HOLES} SELECT o_orderkey, round(coalesce(x, (SELECT avg(x) FROM t)), 4) AS x, round(coalesce(z, (SELECT avg(z) FROM t)), 4) AS z FROM t"),
    "impute_median": (lambda s, d: rounded(P.simple_imputer(holes(s, d), ["x", "z"], "median"), 4), f"WITH {HOLES} SELECT o_orderkey, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM t)), 4) AS x, round(coalesce(z, (SELECT quantile_cont(z, 0.5) FROM t)), 4) AS z FROM t"),
    "impute_most_frequent": (lambda s, d: rounded(P.simple_imputer(holes(s, d).drop("x"), ["z"], "most_frequent")), f"WITH {HOLES} SELECT o_orderkey, coalesce(z, (SELECT z FROM t WHERE z IS NOT NULL GROUP BY z ORDER BY count(*) DESC, z LIMIT 1)) AS z FROM t"),
    "impute_constant": (lambda s, d: P.simple_imputer(holes(s, d).drop("x"), ["z"], "constant", -1.0), f"WITH {HOLES} SELECT o_orderkey, coalesce(z, -1.0) AS z FROM t"),
    "count_vectorizer": (lambda s, d: P.count_vectorizer(_t(s, d, "benchmark"), "item_id", "text"), r"SELECT item_id, term, count(*) AS count FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark) WHERE term <> '' GROUP BY 1, 2"),
    "count_vectorizer_limits": (lambda s, d: P.count_vectorizer(_t(s, d, "documents"), "doc_id", "text", min_df=5, max_df=0.5, max_features=200), r"""
WITH c AS (SELECT doc_id, term, count(*) AS count FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2),
v AS (SELECT term FROM c GROUP BY term HAVING count(*) >= 5 AND count(*) <= ceil((SELECT count(*) FROM documents) * 0.5) ORDER BY sum(count) DESC, term LIMIT 200) SELECT doc_id, term, count FROM c WHERE term IN (SELECT term FROM v)"""),
    "tfidf": (lambda s, d: rounded(P.tfidf(P.count_vectorizer(_t(s, d, "benchmark"), "item_id", "text"), "item_id")), r"""
WITH c AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark) WHERE term <> '' GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT item_id, term, n * (ln((1 + (SELECT count(DISTINCT item_id) FROM c)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term))
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS tfidf FROM w"""),
    "f_classif": (lambda s, d: rounded(P.f_classif(_t(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], "l_returnflag"), 4), " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(b / (k - 1) / (w / (n - k)), 4) AS f, k - 1 AS df1, (n - k)::DOUBLE AS df2 FROM (SELECT sum(n) AS n, count(*) AS k, sum(n * (m - g) ** 2) AS b, sum(v * n) AS w FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) AS g FROM lineitem))""" for c in ("l_quantity", "l_discount"))),
    "f_regression": (lambda s, d: rounded(P.f_regression(_t(s, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"), 3), " UNION ALL ".join(f"SELECT '{c}' AS feature, round(r * r * (n - 2) / (1 - r * r), 3) AS f FROM (SELECT corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem)" for c in ("l_quantity", "l_discount"))),
    "chi2": (lambda s, d: rounded(P.chi2(_t(s, d, "lineitem"), ["l_quantity", "l_linenumber"], "l_returnflag"), 5), " UNION ALL ".join(f"SELECT '{c}' AS feature, round(sum((s - e) ** 2 / e), 5) AS chi2 FROM (SELECT sum({c})::DOUBLE AS s, count(*) / (SELECT count(*) FROM lineitem) * (SELECT sum({c}) FROM lineitem)::DOUBLE AS e FROM lineitem GROUP BY l_returnflag)" for c in ("l_quantity", "l_linenumber"))),
}
