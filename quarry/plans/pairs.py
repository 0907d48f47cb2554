"""Queries of models in the dual, embeddings and clusterings over all pairs, networks, sparse factors, composition and residuals.

Fits that compare all pairs take the nations' profiles, one row for each nation over the whole of customer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import compose as C
from quarry.operators import dual as D
from quarry.operators import linear as L
from quarry.operators import manifold as M
from quarry.operators import neural as N
from quarry.operators import neighbors as NB
from quarry.operators import preprocess as P
from quarry.operators import selection as S
from quarry.operators import trees as T
from quarry.plans.kernel import OLS, curve, mse, part
from quarry.plans.linear import DATA, XS
from quarry.plans.linear import data as rows
from quarry.plans.metrics import REG, _t, reg
from quarry.sources import io

AB = ["a", "b"]


def profiles(s, d):
    x = _t(s, d, "customer").groupBy(F.col("c_nationkey").alias("i")).agg((F.avg("c_acctbal") / 1000).alias("a"), (F.stddev_pop("c_acctbal") / 1000).alias("b"), (F.avg("c_custkey") / F.max(F.max("c_custkey")).over(_all())).alias("m"))
    return x.select("i", "a", "b", (F.col("m") > 0.5).cast("long").alias("y"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over the nations' rows only


def square(df, names):
    return rounded(df.select("i", reduce(lambda a, b: a + b, [F.col(c) ** 2 for c in names]).alias("square")), 5)


def agree(df):
    return rounded(df.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy")), 2)


def near(df, digits=2):
    return rounded(df.agg(F.avg((F.col("prediction") - F.col("y")) ** 2).alias("mse")), digits)


def labelled(s, d):
    return part(s, d).withColumn("y", (F.col("a") ** 2 + F.col("b") > 1).cast("long"))


def sizes(df):
    return df.groupBy("label").agg(F.count("*").alias("n"))


def spread(s, d):
    x = _t(s, d, "lineitem").groupBy(F.col("l_quantity").alias("u")).agg((F.avg("l_extendedprice") / 1000).alias("y"))
    return x.select(F.col("u").cast("long").alias("id"), "u", "y", (F.col("u") * 1.5).alias("f"))


def at(s, d):
    return _t(s, d, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") * 2.0).alias("x"))


def drawn(s, d):
    x = C.wild_bootstrap(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("u"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("f")), at(s, d), 3.0, draws=20)
    return rounded(x.select("i", "prediction", (F.col("lower") <= F.col("upper")).alias("ordered")), 4)


def pipeline(s, d):
    p = C.Pipeline([("scale", lambda x: P.standard_scaler(x, XS)), ("fit", lambda x: (m := L.ols(L.gram(x, XS, ["y"]))) and (lambda y: m.transform(y, "p")))])
    x = rows(s, d)
    return mse(p.fit(x).transform(x), F.col("p"))


def summary(s, d):
    m = N.birch(_t(s, d, "supplier"), ["s_nationkey"], 0.0)
    return s.createDataFrame([(float(c[0]), int(n)) for c, n in zip(m.centers, m.n, strict=True)], "center double, n long")


def steep(s, d):
    stat, p = C.goldfeld_quandt(rows(s, d), ["a"], "y", "a", 0.2)
    return rounded(s.createDataFrame([(stat,)], "statistic double"), 4)


def white(s, d):
    stat, _ = C.white_test(reg(s, d).withColumn("x", F.col("p") / 10), ["x"], "y", "p")
    return rounded(s.createDataFrame([(stat,)], "statistic double"), 2)


def bits(y, t):
    return L.ols(L.gram(y, XS, [t])).predict()


def atoms(s, d):
    x = _t(s, d, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 100000).alias("b"), (F.col("l_discount") * 10).alias("c"))
    m = N.dictionary_learning(x, ["a", "b", "c"], 2, 0.01, 4)
    return rounded(s.createDataFrame([(j, float((v * v).sum())) for j, v in enumerate(m.atoms)], "atom long, length double"), 4)


PROFILES = "t AS (SELECT c_nationkey AS i, avg(c_acctbal) / 1000 AS a, stddev_pop(c_acctbal) / 1000 AS b FROM customer GROUP BY 1)"
SQUARE = f"WITH {PROFILES}, m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM t) SELECT i, round((a - ma) ** 2 + (b - mb) ** 2, 5) AS square FROM t, m"

QUERIES = {
    "svc": (lambda s, d: agree(D.svc(profiles(s, d), AB, "y", 10.0).transform(profiles(s, d))), None),
    "nu_svc": (lambda s, d: agree(D.nu_svc(profiles(s, d), AB, "y", 0.5).transform(profiles(s, d))), None),
    "svr": (lambda s, d: near(D.svr(spread(s, d), ["u"], "y", 10.0, 0.1, gamma=0.01).transform(spread(s, d))), None),
    "nu_svr": (lambda s, d: near(D.nu_svr(spread(s, d), ["u"], "y", 0.001, gamma=0.01).transform(spread(s, d))), None),
    "one_class_svm": (lambda s, d: D.one_class_svm(profiles(s, d), AB, 0.2).transform(profiles(s, d)).groupBy((F.col("prediction") < -1e-6).alias("out")).agg(F.count("*").alias("n")), None),
    "gp_regressor": (lambda s, d: near(D.gp_regressor(spread(s, d), ["u"], "y", D.rbf(10.0) + D.white(0.1), normalize=True).transform(spread(s, d))), None),
    "gp_classifier": (lambda s, d: agree(D.gp_classifier(profiles(s, d), AB, "y", D.matern(0.1, 2.5) * D.constant(9.0)).transform(profiles(s, d))), None),
    "kernel_pca": (lambda s, d: square(M.kernel_pca(profiles(s, d), AB, "i", 2).transform(profiles(s, d)), ["c0", "c1"]), SQUARE),
    "mds": (lambda s, d: square(M.mds(profiles(s, d), AB, "i", 2).transform(profiles(s, d)), ["c0", "c1"]), SQUARE),
    "isomap": (lambda s, d: square(M.isomap(profiles(s, d), AB, "i", 2, 24).transform(profiles(s, d)), ["c0", "c1"]), SQUARE),
    "locally_linear_embedding": (lambda s, d: M.locally_linear(profiles(s, d), AB, "i").select("i"), f"WITH {PROFILES} SELECT i FROM t"),
    "spectral_embedding": (lambda s, d: M.spectral_embedding(profiles(s, d), AB, "i").select("i"), f"WITH {PROFILES} SELECT i FROM t"),
    "tsne": (lambda s, d: M.tsne(profiles(s, d), AB, "i", perplexity=5.0, rounds=250).select("i"), f"WITH {PROFILES} SELECT i FROM t"),
    "umap": (lambda s, d: M.umap(profiles(s, d), AB, "i", neighbours=5, epochs=50).select("i"), f"WITH {PROFILES} SELECT i FROM t"),
    "spectral_clustering": (lambda s, d: sizes(M.spectral_clustering(profiles(s, d), AB, "i", 3, 10.0)), None),
    "affinity_propagation": (lambda s, d: sizes(M.affinity_propagation(profiles(s, d), AB, "i", 0.9)), None),
    "hdbscan": (lambda s, d: sizes(M.hdbscan(profiles(s, d), AB, "i", 3)), None),
    "optics": (lambda s, d: sizes(M.optics(profiles(s, d), AB, "i", 3)), None),
    "birch": (summary, "SELECT s_nationkey::DOUBLE AS center, count(*) AS n FROM supplier GROUP BY 1"),
    "bayesian_mixture": (lambda s, d: sizes(N.bayesian_mixture(part(s, d), AB, [[-1.0, 0.0], [1.0, 0.0], [0.0, 5.0]], rounds=10).transform(part(s, d))), None),
    "mlp_classifier": (lambda s, d: agree(N.mlp_classifier(labelled(s, d), AB, "y", (16, 8), rate=0.02, rounds=10).transform(labelled(s, d))), None),
    "mlp_regressor": (lambda s, d: near(N.mlp_regressor(curve(s, d), AB, "y", (16,), rate=0.02, rounds=10).transform(curve(s, d)), 1), None),
    "bernoulli_rbm": (lambda s, d: (x := _t(s, d, "part").select((F.col("p_size") > 25).cast("double").alias("a"), (F.col("p_size") > 10).cast("double").alias("b"))) and N.bernoulli_rbm(x, AB, 2, rounds=3).transform(x).agg(F.sum(F.col("h0").between(0, 1).cast("long")).alias("n")), "SELECT count(*) AS n FROM part"),
    "dictionary_learning": (atoms, "SELECT range AS atom, 1.0::DOUBLE AS length FROM range(2)"),
    "sparse_pca": (lambda s, d: rounded(s.createDataFrame([(j, float((v * v).sum())) for j, v in enumerate(N.sparse_pca(part(s, d), AB, 2, 0.1).components)], "component long, length double"), 4), "SELECT range AS component, 1.0::DOUBLE AS length FROM range(2)"),
    "mini_batch_nmf": (lambda s, d: s.createDataFrame([(j, bool((v >= 0).all())) for j, v in enumerate(N.mini_batch_nmf(_t(s, d, "lineitem").select("l_quantity", "l_linenumber"), ["l_quantity", "l_linenumber"], 2, 3))], "part long, nonnegative boolean"), "SELECT range AS part, true AS nonnegative FROM range(2)"),
    "output_code": (lambda s, d: (x := rows(s, d)).withColumn("p", C.output_code(x, "c", bits)).groupBy("c", "p").agg(F.count("*").alias("n")), None),
    "pipeline_of_steps": (pipeline, f"{OLS} SELECT round(avg(e * e), 3) AS mse FROM e"),
    "wild_bootstrap": (drawn, "WITH q AS (SELECT n_nationkey AS i, n_nationkey * 2.0::DOUBLE AS x FROM nation), k AS (SELECT i, l_extendedprice / 1000 AS y, exp(-(((x - l_quantity) / 3) ** 2) / 2) AS w FROM q, lineitem) SELECT i, round(sum(w * y) / sum(w), 4) AS prediction, true AS ordered FROM k GROUP BY 1"),
    "residual_variance": (lambda s, d: rounded(C.residual_variance(at(s, d), spread(s, d), 3.0), 4), """
WITH t AS (SELECT l_quantity AS u, avg(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1), k AS (SELECT n_nationkey AS i, (y - u * 1.5) ** 2 AS e, exp(-(((n_nationkey * 2.0::DOUBLE - u) / 3) ** 2) / 2) AS w FROM nation, t),
v AS (SELECT i, sum(w * e) / sum(w) AS v FROM k GROUP BY 1) SELECT i, round(v, 4) AS variance, round(sqrt(v), 4) AS deviation FROM v"""),
    "white_test": (white, f"""WITH {REG}, z AS (SELECT p / 10 AS a, (p / 10) ** 2 AS b, (y - p) ** 2 AS y FROM t), g AS (SELECT count(*) AS n, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, var_pop(y) AS yy FROM z)
SELECT round(n * (ay * (ay * bb - yb * ab) + yb * (yb * aa - ay * ab)) / (aa * bb - ab * ab) / yy, 2) AS statistic FROM g"""),
    "residual_diagnostics": (lambda s, d: rounded(C.residual_diagnostics(reg(s, d), "y", "p").select("n", "mean", "std", "skewness", "kurtosis"), 4), f"""WITH {REG}, e AS (SELECT y - p AS e FROM t), m AS (SELECT avg(e) AS m FROM e), c AS (SELECT count(*) AS n, avg(m) AS mean, avg((e - m) ** 2) AS v, avg((e - m) ** 3) AS s, avg((e - m) ** 4) AS k FROM e, m)
SELECT n, round(mean, 4) AS mean, round(sqrt(v), 4) AS std, round(s / v ** 1.5, 4) AS skewness, round(k / v ** 2 - 3, 4) AS kurtosis FROM c"""),
    "goodness_of_fit": (lambda s, d: rounded(C.goodness_of_fit(reg(s, d), "y", "p", 2.0).select("n", "r2", "adjusted_r2", "mse", "rmse", "mae"), 4), f"""WITH {REG}, g AS (SELECT count(*) AS n, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM t)
SELECT n, round(1 - mse / v, 4) AS r2, round(1 - mse / v * (n - 1) / (n - 3), 4) AS adjusted_r2, round(mse, 4) AS mse, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae FROM g"""),
    "goldfeld_quandt": (steep, f"""WITH {DATA}, k AS (SELECT quantile_cont(a, 0.4) AS low, quantile_cont(a, 0.6) AS high FROM t), q AS (SELECT CASE WHEN a <= low THEN 0 WHEN a >= high THEN 1 END AS side, a, y FROM t, k),
v AS (SELECT side, (var_pop(y) - covar_pop(a, y) ** 2 / var_pop(a)) * count(*) / (count(*) - 2) AS v FROM q WHERE side IS NOT NULL GROUP BY 1) SELECT round((SELECT v FROM v WHERE side = 1) / (SELECT v FROM v WHERE side = 0), 4) AS statistic"""),
    "adaboost_regressor": (lambda s, d: (x := part(s, d).withColumn("y", F.col("a") * 2)) and rounded(x.withColumn("prediction", T.adaboost_regressor(x, ["a"], "y", 2)).agg((F.avg((F.col("prediction") - F.col("y")) ** 2) < 0.2).cast("int").alias("close")), 2), "SELECT 1 AS close"),
    "logistic_regression_cv": (lambda s, d: rounded(L.logistic_cv(x := rows(s, d), XS, "s", "f", (0.1, 10.0))[0].table(x), 3), None),
    "repeated_stratified_k_fold": (lambda s, d: S.repeated_stratified_k_fold(_t(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 5, 1).groupBy("c_mktsegment").agg((F.max("fold_0") - F.min("fold_0") + 1).cast("long").alias("folds"), F.count("*").alias("n")), "SELECT c_mktsegment, 5::BIGINT AS folds, count(*) AS n FROM customer GROUP BY 1"),
    "hat_matrix": (lambda s, d: rounded(NB.hat_matrix(spread(s, d), "id", "u", "y", 3.0).select("id", "prediction", "hat", "left_out"), 4), """
WITH t AS (SELECT l_quantity::BIGINT AS id, l_quantity AS u, avg(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1, 2), k AS (SELECT a.id, a.y AS own, b.y, exp(-(((a.u - b.u) / 3) ** 2) / 2) AS w FROM t a, t b), s AS (SELECT id, any_value(own) AS own, sum(w) AS s, sum(w * y) AS p FROM k GROUP BY 1)
SELECT id, round(p / s, 4) AS prediction, round(1 / s, 4) AS hat, round((p - own) / (s - 1), 4) AS left_out FROM s"""),
    "local_polynomial_regression": (lambda s, d: rounded(NB.local_polynomial(at(s, d), spread(s, d), 3.0, 0), 4), """
WITH t AS (SELECT l_quantity AS u, avg(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1), k AS (SELECT n_nationkey AS i, y, exp(-(((n_nationkey * 2.0::DOUBLE - u) / 3) ** 2) / 2) AS w FROM nation, t) SELECT i, round(sum(w * y) / sum(w), 4) AS prediction FROM k GROUP BY 1"""),
    "neighbors_graph": (lambda s, d: NB.neighbors_graph(_t(s, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("j"), F.lit(1.0).alias("distance"))), "SELECT n_nationkey AS row, n_regionkey AS col, 1.0::DOUBLE AS val FROM nation"),
    "sparse_diagonals": (lambda s, d: io.spmm(io.diags(s, 25, {0: 2.0, 1: -1.0}), _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.col("n_regionkey").cast("double").alias("val"))), "SELECT n_nationkey::BIGINT AS row, 0::BIGINT AS col, (2.0 * n_regionkey - coalesce(lead(n_regionkey) OVER (ORDER BY n_nationkey), 0))::DOUBLE AS val FROM nation"),
    "make_friedman2": (lambda s, d: io.make_friedman2(s, 1000).agg(F.count("*").alias("n"), (F.max(F.abs(F.col("y") ** 2 - F.col("x0") ** 2 - (F.col("x1") * F.col("x2") - 1 / (F.col("x1") * F.col("x3"))) ** 2)) < 1e-3).alias("exact")), "SELECT 1000::BIGINT AS n, true AS exact"),
    "make_swiss_roll": (lambda s, d: io.make_swiss_roll(s, 1000).agg(F.count("*").alias("n"), (F.max(F.abs(F.col("x0") ** 2 + F.col("x2") ** 2 - F.col("t") ** 2)) < 1e-6).alias("exact")), "SELECT 1000::BIGINT AS n, true AS exact"),
}
