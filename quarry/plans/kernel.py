"""Queries of kernel models, imputation by models, factorisation, robust covariance and meta-estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import kernel_models as K
from quarry.operators import linear as L
from quarry.operators import preprocess as P
from quarry.plans.linear import DATA, PAIRS, REST, XS
from quarry.plans.linear import data as rows
from quarry.plans.metrics import _t


def part(s, d):
    return _t(s, d, "part").select(F.col("p_partkey").alias("i"), ((F.col("p_size") - 25) / 15).alias("a"), ((F.col("p_retailprice") - 950) / 30).alias("b"))


def mse(x, p):
    return rounded(x.withColumn("p", p).agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("mse")), 3)


def curve(s, d):
    return part(s, d).withColumn("y", F.sin(F.col("a") * 2) + F.col("b") / 10)


def holes(s, d):
    return _t(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") / 1000).alias("a"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey").cast("double")).alias("b"))


def ridge(s, d):
    m, w = K.kernel_ridge(x := curve(s, d), ["a"], "y", "i", 0.1, "rbf", 1.0, 30)
    return mse(m.transform(x), w.predict())


def classifier(s, d):
    f, m = K.kernel_classifier(x := part(s, d).withColumn("y", (F.col("a") ** 2 > 0.7).cast("int")), ["a"], "y", 1.0, 100.0, 6)
    return rounded(f(x).agg(F.avg(((m.predict() > 0).cast("int") == F.col("y")).cast("double")).alias("accuracy")), 3)


OLS = f"""WITH {DATA}, g AS (SELECT count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t),
w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM g), e AS (SELECT abs(y - (my + wa * (a - ma) + wb * (b - mb))) AS e FROM t, w)"""


def interval(s, d):
    x = L.ols(L.gram(x := rows(s, d), XS, ["y"])).transform(x, "p")
    low, high = K.conformal(x, "y", "p", 0.9)
    return rounded(x.agg(F.avg(high - low).alias("width"), F.avg(F.col("y").between(low, high).cast("double")).alias("covered")), 2)


QUERIES = {
    "rbf_sampler": (lambda s, d: rounded(K.rbf_sampler(part(s, d), ["a", "b"], 0.5, 4).agg(*[F.avg(f"rf{j}").alias(f"rf{j}") for j in range(4)]), 3), None),
    "kernel_ridge_nystroem": (ridge, None),
    "kernel_svc": (classifier, None),
    "local_linear_regression": (lambda s, d: rounded(K.local_linear(_t(s, d, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") * 0.4 - 1).alias("x")), _t(s, d, "customer").select((F.col("c_acctbal") / 1000).alias("u"), F.col("c_nationkey").cast("double").alias("y")), 1.0), 5), """
WITH q AS (SELECT n_nationkey AS i, n_nationkey * 0.4::DOUBLE - 1 AS x FROM nation), t AS (SELECT c_acctbal / 1000 AS u, c_nationkey AS y FROM customer), k AS (SELECT i, y, u - x AS d, exp(-((u - x) ** 2) / 2) AS w FROM q, t), z AS (SELECT i, sum(w) AS a, sum(w * d) AS b, sum(w * d * d) AS c, sum(w * y) AS p, sum(w * d * y) AS q FROM k GROUP BY 1) SELECT i, round((c * p - b * q) / (a * c - b * b), 5) AS prediction FROM z"""),
    "conformal_interval": (interval, f"""{OLS}, r AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS r, count(*) OVER () AS n FROM e), h AS (SELECT DISTINCT (n - 1) * least(1, ceil((n + 1) * 0.9::DOUBLE) / n) AS h FROM r),
q AS (SELECT a.e + (h - floor(h)) * (b.e - a.e) AS q FROM h JOIN r a ON a.r = floor(h) JOIN r b ON b.r = ceil(h)) SELECT round(2 * max(q), 2) AS width, round(avg((e <= q)::INT), 2) AS covered FROM e, q"""),
    "iterative_imputer": (lambda s, d: rounded(K.iterative_imputer(holes(s, d), ["a", "b"]).agg(F.count("a").alias("n"), F.count("b").alias("m"))), "SELECT count(*) AS n, count(*) AS m FROM supplier"),
    "knn_imputer": (lambda s, d: rounded(K.knn_imputer(holes(s, d), ["a", "b"], "s_suppkey", 3)), """
WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 1000 END AS a, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey::DOUBLE END AS b FROM supplier), p AS (SELECT x.s_suppkey, y.s_suppkey AS j, coalesce((x.a - y.a) ** 2, 0) + coalesce((x.b - y.b) ** 2, 0) AS d, y.a, y.b FROM t x JOIN t y ON x.s_suppkey <> y.s_suppkey WHERE x.a IS NULL OR x.b IS NULL),
fa AS (SELECT s_suppkey, avg(a) AS f FROM (SELECT * FROM p WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY d, j) <= 3) GROUP BY 1), fb AS (SELECT s_suppkey, avg(b) AS f FROM (SELECT * FROM p WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY d, j) <= 3) GROUP BY 1)
SELECT t.s_suppkey, round(coalesce(t.a, fa.f), 6) AS a, round(coalesce(t.b, fb.f), 6) AS b FROM t LEFT JOIN fa USING (s_suppkey) LEFT JOIN fb USING (s_suppkey)"""),
    "nmf": (lambda s, d: rounded(s.createDataFrame([tuple(map(float, r)) for r in K.nmf(_t(s, d, "lineitem").select("l_quantity", "l_linenumber"), ["l_quantity", "l_linenumber"], 1, 10)], "a double, b double").select((F.col("b") / F.col("a")).alias("ratio")), 3), "SELECT round(((aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) - aa) / ab, 3) AS ratio FROM (SELECT sum(l_quantity * l_quantity)::DOUBLE AS aa, sum(l_quantity * l_linenumber)::DOUBLE AS ab, sum(l_linenumber * l_linenumber)::DOUBLE AS bb FROM lineitem)"),
    "fast_ica": (lambda s, d: rounded(s.createDataFrame([(float(abs(v)),) for v in K.fast_ica(part(s, d), ["a", "b"], 2, 10)[1]], "mean double"), 4), "SELECT round(abs(avg((p_size - 25) / 15)), 4) AS mean FROM part UNION ALL SELECT round(abs(avg((p_retailprice - 950) / 30)), 4) FROM part"),
    "elliptic_envelope": (lambda s, d: (x := part(s, d)).withColumn("p", K.elliptic_envelope(x, ["a", "b"])).groupBy("p").agg(F.count("*").alias("n")), None),
    "one_vs_one": (lambda s, d: (x := rows(s, d)).withColumn("p", K.one_vs_one(x, "c", lambda y, t: L.ols(L.gram(y, XS, [t])).predict() - 0.5)).groupBy("c", "p").agg(F.count("*").alias("n")), PAIRS),
    "one_vs_rest": (lambda s, d: (x := rows(s, d)).withColumn("p", L.one_vs_rest(x, "c", lambda y, t: L.ols(L.gram(y, XS, [t]))).predict()).groupBy("c", "p").agg(F.count("*").alias("n")), REST),
    "transformed_target": (lambda s, d: mse(x := rows(s, d), K.transformed_target(x, "y", lambda y, t: L.ols(L.gram(y, XS, [t])).predict(), lambda v: v * 2, lambda v: v / 2)), f"{OLS} SELECT round(avg(e * e), 3) AS mse FROM e"),
    "self_training": (lambda s, d: rounded((x := rows(s, d).withColumn("l", F.when(F.col("f") == 0, F.col("s").cast("double")))).withColumn("p", K.self_training(x, "l", lambda y, t: L.probability(L.logistic(y, XS, t)), 0.75, 2)).agg(F.count("p").alias("n"))), "SELECT count(*) AS n FROM lineitem"),
    "ransac": (lambda s, d: mse(x := rows(s, d).withColumn("id", F.xxhash64("a", "b", "y", "f")), K.ransac(x, XS, "y", "id", 5).predict()), None),
    "topics": (lambda s, d: K.topics(_t(s, d, "benchmark").select("item_id", P.tokens(F.col("text")).alias("w")), "item_id", "w", 2, 3).select("topic", F.size("terms").alias("n")), "SELECT range::INT AS topic, 8 AS n FROM range(2)"),
}
