"""Queries of naive Bayes, neighbours, distances and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import bayes as B
from quarry.operators import neighbors as N
from quarry.plans.linear import DATA, XS, data, predicted
from quarry.plans.metrics import _t


def vec(s, d, i="i", x="x", where="true"):
    return _t(s, d, "embeddings").where(where).select(F.col("vec_id").alias(i), F.col("embedding").cast("array<double>").alias(x))


def sup(s, d, i="i", x="x"):
    return _t(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias(i), N.vector("s_nationkey").alias("_n"), F.array((F.col("s_acctbal") / 1000), F.col("s_nationkey").cast("double")).alias(x)).drop("_n")


SUP = "p AS (SELECT s_suppkey::BIGINT AS i, s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b FROM supplier)"
EMB = "e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS x, label FROM embeddings), q AS (SELECT * FROM e WHERE i % 20 = 0), n AS (SELECT q.i, e.i AS j, list_distance(q.x, e.x) AS distance, e.label FROM q, e), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM n QUALIFY rank <= 5)"
QRY = "vec_id % 20 = 0"


def pair(f):
    return lambda s, d: rounded(N.pairwise(sup(s, d), sup(s, d, "j", "y"), f))


def pair_sql(e):
    return f"WITH {SUP} SELECT p.i, r.i AS j, round({e}, 6) AS value FROM p, p r"


def near(s, d):
    return N.knn(vec(s, d, where=QRY), vec(s, d, "j", "y"))


def labels(s, d):
    return _t(s, d, "embeddings").select(F.col("vec_id").alias("j"), "label")


D2 = "((p.a - r.a) ** 2 + (p.b - r.b) ** 2)"
GNB = f"""WITH {DATA}, g AS (SELECT c, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, count(*) / (SELECT count(*) FROM t) AS pr FROM t GROUP BY c), e AS (SELECT 1e-9 * greatest(1, max(greatest(va, vb))) AS e FROM g), u AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT u.*, g.c AS p, ln(pr) - (a - ma) ** 2 / (2 * (va + e)) - (b - mb) ** 2 / (2 * (vb + e)) - 0.5 * ln(va + e) - 0.5 * ln(vb + e) AS z FROM u, g, e) SELECT c, p, sum(n)::BIGINT AS n FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY z DESC, p) = 1) GROUP BY 1, 2"""


def nb_sql(score: str, order: str = "DESC", table: str = "sum(a) AS sa, sum(b) AS sb, count(*) AS k") -> str:
    return f"""WITH {DATA}, w AS (SELECT count(*) AS n_, sum(a) AS ta, sum(b) AS tb FROM t), g AS (SELECT c, {table} FROM t GROUP BY c), u AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT u.*, g.c AS p, round({score}, 9) AS z FROM u, g, w)
SELECT c, p, sum(n)::BIGINT AS n FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY z {order}, p) = 1) GROUP BY 1, 2"""


def binary(s, d):
    return data(s, d).select((F.col("a") > 2.5).cast("int").alias("a"), (F.col("b") > 1).cast("int").alias("b"), "c")


QUERIES = {
    "gaussian_nb": (predicted(lambda x: B.gaussian(B.moments(x, XS, "c"), XS, "c").predict()), GNB),
    "multinomial_nb": (predicted(lambda x: B.multinomial(B.moments(x, XS, "c"), XS, "c").predict()), nb_sql("ln(k / n_) + a * ln((sa + 1) / (sa + sb + 2)) + b * ln((sb + 1) / (sa + sb + 2))")),
    "complement_nb": (predicted(lambda x: B.complement(B.moments(x, XS, "c"), XS, "c").predict(False)), nb_sql("a * ln((ta - sa + 1) / (ta - sa + tb - sb + 2)) + b * ln((tb - sb + 1) / (ta - sa + tb - sb + 2))", "ASC")),
    "bernoulli_nb": (lambda s, d: (x := binary(s, d)).withColumn("p", B.bernoulli(B.moments(x, XS, "c"), XS, "c").predict()).groupBy("c", "p").agg(F.count("*").alias("n")), nb_sql("ln(k / n_) + a * ln((sa + 1) / (k + 2)) + (1 - a) * ln(1 - (sa + 1) / (k + 2)) + b * ln((sb + 1) / (k + 2)) + (1 - b) * ln(1 - (sb + 1) / (k + 2))").replace(DATA, DATA.replace("l_quantity / 10 AS a", "(l_quantity / 10 > 2.5)::INT AS a").replace("l_discount * 20 AS b", "(l_discount * 20 > 1)::INT AS b"))),
    "categorical_nb": (lambda s, d: (x := binary(s, d)).withColumn("p", B.categorical(x, XS, "c").predict()).groupBy("c", "p").agg(F.count("*").alias("n")), nb_sql("ln(k / n_) + ln((CASE a WHEN 1 THEN sa ELSE k - sa END + 1) / (k + 2)) + ln((CASE b WHEN 1 THEN sb ELSE k - sb END + 1) / (k + 2))").replace(DATA, DATA.replace("l_quantity / 10 AS a", "(l_quantity / 10 > 2.5)::INT AS a").replace("l_discount * 20 AS b", "(l_discount * 20 > 1)::INT AS b"))),
    "posterior_normal": (lambda s, d: rounded(B.posterior_normal(_t(s, d, "part").select((F.col("p_retailprice") / 100).alias("m"), F.col("p_size").cast("double").alias("v")), "m", "v")), "SELECT round(sum(p_retailprice / 100 / p_size) / (1 + sum(1 / p_size)), 6) AS mean, round(1 / (1 + sum(1 / p_size)), 6) AS var FROM part"),
    "euclidean_distances": (pair(N.DISTANCES["euclidean"]), pair_sql(f"sqrt{D2}")),
    "manhattan_distances": (pair(N.DISTANCES["manhattan"]), pair_sql("abs(p.a - r.a) + abs(p.b - r.b)")),
    "chebyshev_distances": (pair(N.DISTANCES["chebyshev"]), pair_sql("greatest(abs(p.a - r.a), abs(p.b - r.b))")),
    "cosine_distances": (pair(N.DISTANCES["cosine"]), pair_sql("1 - greatest(-1, least(1, coalesce((p.a * r.a + p.b * r.b) / nullif(sqrt((p.a ** 2 + p.b ** 2) * (r.a ** 2 + r.b ** 2)), 0), 0)))")),
    "rbf_kernel": (pair(lambda x, y: N.kernel("rbf", x, y, 0.1)), pair_sql(f"exp(-0.1 * {D2})")),
    "polynomial_kernel": (lambda s, d: rounded(N.pairwise(sup(s, d), sup(s, d, "j", "y"), lambda x, y: N.kernel("polynomial", x, y, 0.01, 2, 1.0))), pair_sql("(0.01 * (p.a * r.a + p.b * r.b) + 1) ** 2")),
    "sigmoid_kernel": (pair(lambda x, y: N.kernel("sigmoid", x, y, 0.01)), pair_sql("tanh(0.01 * (p.a * r.a + p.b * r.b))")),
    "laplacian_kernel": (pair(lambda x, y: N.kernel("laplacian", x, y, 0.1)), pair_sql("exp(-0.1 * (abs(p.a - r.a) + abs(p.b - r.b)))")),
    "matern_kernel": (pair(lambda x, y: N.GP_KERNELS["matern32"](N.squared(x, y), None, 2.0)), pair_sql(f"(1 + sqrt(3 * {D2}) / 2) * exp(-sqrt(3 * {D2}) / 2)")),
    "kneighbors": (lambda s, d: rounded(near(s, d)), f"WITH {EMB} SELECT i, j, round(distance, 6) AS distance, rank::INT AS rank FROM k"),
    "kneighbors_classifier": (lambda s, d: N.vote(near(s, d), labels(s, d)), f"WITH {EMB}, v AS (SELECT i, label, count(*) AS n FROM k GROUP BY 1, 2) SELECT i, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, label) = 1"),
    "kneighbors_regressor": (lambda s, d: rounded(N.average(near(s, d), labels(s, d).withColumnRenamed("label", "y"))), f"WITH {EMB} SELECT i, round(avg(label), 6) AS prediction FROM k GROUP BY 1"),
    "radius_neighbors": (lambda s, d: rounded(N.radius_join(p := _t(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b")), p.withColumnRenamed("i", "j"), 2.0, ["a", "b"])), f"WITH {SUP} SELECT p.i, r.i AS j, round(sqrt{D2}, 6) AS distance FROM p, p r WHERE sqrt{D2} <= 2"),
    "nearest_centroid": (lambda s, d: N.nearest_centroid(data(s, d), XS, "c").groupBy("c", "prediction").agg(F.count("*").alias("n")), f"""WITH {DATA}, g AS (SELECT c, avg(a) AS ma, avg(b) AS mb FROM t GROUP BY c), u AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT u.*, g.c AS prediction, (a - ma) ** 2 + (b - mb) ** 2 AS z FROM u, g)
SELECT c, prediction, sum(n)::BIGINT AS n FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY z, prediction) = 1) GROUP BY 1, 2"""),
    "local_outlier_factor": (lambda s, d: rounded(N.local_outlier_factor(sup(s, d), 10)), f"""WITH {SUP}, n AS (SELECT p.i, r.i AS j, sqrt{D2} AS d FROM p JOIN p r ON p.i <> r.i QUALIFY row_number() OVER (PARTITION BY p.i ORDER BY sqrt{D2}, r.i) <= 10), kd AS (SELECT i, max(d) AS kd FROM n GROUP BY 1), l AS (SELECT n.i, 10 / sum(greatest(d, kd)) AS lrd FROM n JOIN kd ON n.j = kd.i GROUP BY 1)
SELECT n.i, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof FROM n JOIN l a ON n.i = a.i JOIN l b ON n.j = b.i GROUP BY 1"""),
    "nadaraya_watson": (lambda s, d: rounded(N.nadaraya_watson(_t(s, d, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") * 0.4 - 1).alias("x")), _t(s, d, "customer").select((F.col("c_acctbal") / 1000).alias("u"), F.col("c_nationkey").cast("double").alias("y")), 0.5, "epanechnikov")), """
WITH q AS (SELECT n_nationkey AS i, n_nationkey * 0.4::DOUBLE - 1 AS x FROM nation), t AS (SELECT c_acctbal / 1000 AS u, c_nationkey AS y FROM customer), k AS (SELECT i, y, CASE WHEN abs((x - u) / 0.5) <= 1 THEN 0.75 * (1 - ((x - u) / 0.5) ** 2) ELSE 0 END AS k FROM q, t) SELECT i, round(sum(k * y) / sum(k), 6) AS prediction FROM k GROUP BY 1"""),
}
