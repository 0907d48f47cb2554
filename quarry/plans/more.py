"""Queries of splits, feature rules by p-values, meta-estimators, gradient steps and component models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import kernel_models as K
from quarry.operators import linear as L
from quarry.operators import preprocess as P
from quarry.operators import selection as S
from quarry.plans.linear import COV, DATA, SUMS, XS, coefficients, data, matrix
from quarry.plans.metrics import _t
from quarry.plans.rules import COLUMNS, FOLDS, SPREAD, features, mse, ridge
from quarry.streaming import models as M


def chances(v):
    """A stand-in for p-values: smaller where the variance is larger."""
    return [(c, 1 / (1 + x)) for c, x in v]


CHANCES = SPREAD + ", p AS (SELECT k, feature, 1 / (1 + v) AS p FROM v)"


def customers(s, d):
    return _t(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("g"))


def sizes(df, prefix):
    """Rows by fold of each repeat."""
    parts = [df.groupBy(F.col(c).cast("int").alias("fold")).agg(F.count("*").alias("n")).select(F.lit(c).alias("repeat"), "fold", "n") for c in df.columns if c.startswith(prefix)]
    return reduce(lambda a, b: a.unionByName(b), parts)


EVEN = "SELECT '{p}' || r AS repeat, f AS fold, n // {k} + (f < n % {k})::INT AS n FROM (SELECT count(*) AS n FROM customer), (SELECT unnest(range({r}))::INT AS r), (SELECT unnest(range({k}))::INT AS f)"


def scored(s, d):
    x = data(s, d).withColumn("fold", F.col("f"))
    test, both = S.cross_val_score(x, ridge(5e4), mse, [0, 1, 2]), S.cross_validate(x, ridge(5e4), mse, [0, 1, 2])
    return rounded(s.createDataFrame([(k, -test[k], -both["test_score"][k], -both["train_score"][k]) for k in range(3)], "fold int, score double, test double, train double"), 4)


def chained(s, d):
    x = data(s, d)
    fit = lambda df, used, t: L.ols(L.gram(df, used, [t])).predict()
    b, y = K.chain(x, ["a"], ["b", "y"], fit)
    return rounded(x.select("a").distinct().withColumn("b", b).withColumn("y", y), 4)


def outputs(s, d):
    x = data(s, d)
    b, y = K.multi_output(x, ["b", "y"], lambda df, t: L.ols(L.gram(df, ["a"], [t])).predict())
    return rounded(x.select("a").distinct().withColumn("b", b).withColumn("y", y), 4)


STEPS = [("scale", lambda df, cs: P.standard_scaler(df, cs).transform(df), ["a"]), ("as_is", lambda df, cs: df, ["b"])]
SCALED = f"WITH {DATA}, m AS (SELECT avg(a) AS m, stddev_pop(a) AS d FROM t)"


def parts(s, d):
    """Each part of a union adds its own columns to all there are."""
    return rounded(K.feature_union(data(s, d).select("a", "b").distinct(), [lambda x: x.withColumn("sum", F.col("a") + F.col("b")), lambda x: x.withColumn("square", F.col("a") ** 2)]), 4)


def epochs(s, d):
    x = data(s, d)
    m = M.SGD(["a", "b"], "y", eta0=0.02, alpha=0.01, tol=0.0).fit(x, lambda e: F.col("f"), 3, 4)
    return rounded(s.createDataFrame([(c, float(v)) for c, v in zip(["intercept", "a", "b"], m.w[0], strict=True)], "term string, value double"), 4)


def stepped(rounds: int, eta: str, alpha: str) -> str:
    """SQL of the same steps: the mean gradient of mini-batch it % 3 by its sums."""
    g = "w0 * n + wa * a + wb * b - y AS g0, w0 * a + wa * aa + wb * ab - ay AS ga, w0 * b + wa * ab + wb * bb - yb AS gb"
    return f"""WITH RECURSIVE {DATA}, g AS (SELECT f, count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM t GROUP BY f),
r AS (SELECT 0 AS it, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb UNION ALL SELECT it + 1, w0 - {eta} * g0 / n, wa - {eta} * (ga / n + {alpha} * wa), wb - {eta} * (gb / n + {alpha} * wb) FROM (SELECT it, w0, wa, wb, n, {g} FROM r JOIN g ON g.f = it % 3 WHERE it < {rounds})), z AS (FROM r WHERE it = {rounds})
SELECT 'intercept' AS term, round(w0, 4) AS value FROM z UNION ALL SELECT 'a', round(wa, 4) FROM z UNION ALL SELECT 'b', round(wb, 4) FROM z"""


def classified(loss):
    """Weights of a score for each class, by four steps on all rows."""

    def q(s, d):
        m = M.SGD(["a", "b"], "c", loss, 0.1, 0.01, "constant", tol=0.0).fit(data(s, d), lambda e: F.lit(0), 1, 4, True)
        return rounded(s.createDataFrame([(k, *map(float, w)) for k, w in zip(m.classes, m.w, strict=True)], "c string, w0 double, wa double, wb double"), 5)

    return q


def against_rest(slope: str) -> str:
    """SQL of these; ``slope`` is the derivative in the score f for the goal z of -1 or 1."""
    return f"""WITH RECURSIVE {DATA}, k AS (SELECT u.c, a, b, CASE WHEN t.c = u.c THEN 1 ELSE -1 END AS z, count(*)::DOUBLE AS n FROM t, (SELECT DISTINCT c FROM t) u GROUP BY ALL),
r AS (SELECT c, 0 AS it, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb FROM (SELECT DISTINCT c FROM t) UNION ALL SELECT c, it + 1, w0 - 0.1 * g0, wa - 0.1 * (ga + 0.01 * wa), wb - 0.1 * (gb + 0.01 * wb)
FROM (SELECT c, it, w0, wa, wb, sum(n * g) / sum(n) AS g0, sum(n * g * a) / sum(n) AS ga, sum(n * g * b) / sum(n) AS gb FROM (SELECT r.c, it, w0, wa, wb, a, b, n, {slope} AS g FROM (SELECT r.*, a, b, z, n, w0 + wa * a + wb * b AS f FROM r JOIN k ON k.c = r.c WHERE it < 4) r) GROUP BY ALL))
SELECT c, round(w0, 5) AS w0, round(wa, 5) AS wa, round(wb, 5) AS wb FROM r WHERE it = 4"""


def batches(s, d):
    """Components from three batches, one after the other."""
    x = data(s, d)
    m = L.IncrementalPCA(XS, 2)
    for k in range(3):
        m.update(x.where(F.col("f") == k))
    p = m.model()
    return rounded(s.createDataFrame([(k, float(v), float(r)) for k, (v, r) in enumerate(zip(p.variance, p.ratio, strict=True))], "k int, variance double, ratio double"), 5)


def white(s, d):
    x = data(s, d)
    p = L.whitened(L.pca(L.gram(x, XS, []), 2)).transform(x)
    return rounded(p.agg(F.var_samp("pc0").alias("first"), F.var_samp("pc1").alias("second"), F.covar_samp("pc0", "pc1").alias("both")), 5)


#: Alphas judged by the folds left out; with two columns the shrunk covariance has a closed form.
LASSO = f"""WITH {DATA}, f AS (SELECT f, count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM t GROUP BY f), v(alpha) AS (VALUES (0.01::DOUBLE), (0.1), (1.0)),
r AS (SELECT u.f, sum(z.n) AS n, sum(z.a) AS a, sum(z.b) AS b, sum(z.aa) AS aa, sum(z.ab) AS ab, sum(z.bb) AS bb FROM f u JOIN f z ON u.f <> z.f GROUP BY u.f),
c AS (SELECT alpha, f, aa / n - (a / n) ** 2 + alpha AS p, bb / n - (b / n) ** 2 + alpha AS q, sign(ab / n - a * b / n / n) * greatest(abs(ab / n - a * b / n / n) - alpha, 0) AS o FROM r, v),
e AS (SELECT f, aa / n - (a / n) ** 2 AS p, bb / n - (b / n) ** 2 AS q, ab / n - a * b / n / n AS o FROM f)
SELECT alpha, round(avg((-(e.p * c.q - 2 * e.o * c.o + e.q * c.p) / (c.p * c.q - c.o * c.o) - ln(c.p * c.q - c.o * c.o) - 2 * ln(2 * pi())) / 2), 4) AS score FROM c JOIN e USING (f) GROUP BY alpha"""


def lasso_scores(s, d):
    alphas = [0.01, 0.1, 1.0]
    return rounded(s.createDataFrame(list(zip(alphas, L.graphical_lasso_cv(data(s, d), XS, "f", alphas, tol=1e-9)[1], strict=True)), "alpha double, score double"), 4)


def weights(mode):
    """Coefficients of one component."""
    return lambda s, d: rounded(s.createDataFrame([(c, float(w)) for c, w in zip(XS, L.pls(L.gram(data(s, d), XS, ["y"]), 1, mode)[:, 0], strict=True)], "term string, value double"), 4)


CORR = f"WITH {DATA}, m AS (SELECT corr(a, y) AS u, corr(b, y) AS v, corr(a, b) AS r, stddev_samp(y) AS sy, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM t)"
#: w = (u, v) over its length; the loading is w'xy over w'xx w.
ONE = CORR + ", q AS (SELECT *, (u * u + v * v) / (u * u + v * v + 2 * r * u * v) AS k FROM m) SELECT 'a' AS term, round(u * k * sy / sa, 4) AS value FROM q UNION ALL SELECT 'b', round(v * k * sy / sb, 4) FROM q"
#: Against one target, the direction of the highest correlation is that of least squares.
MOST = CORR + ", q AS (SELECT *, (u - r * v) / (1 - r * r) AS x, (v - r * u) / (1 - r * r) AS z FROM m) SELECT 'a' AS term, round(x * sy / sa, 4) AS value FROM q UNION ALL SELECT 'b', round(z * sy / sb, 4) FROM q"

def sides(mode, k):
    return lambda x: L.pairing(L.gram(x, XS, ["y", "s"]), k, mode)


def agreement(s, d):
    """Correlations of the scores of both sides."""
    x = data(s, d)
    z = sides("cca", 2)(x).transform(x)
    return rounded(z.agg(F.corr("u0", "v0").alias("first"), F.corr("u1", "v1").alias("second"), F.corr("u0", "u1").alias("between")), 4)


def directions(s, d):
    m = sides("canonical", 1)(data(s, d))
    return rounded(s.createDataFrame([(c, float(v)) for c, v in zip([*XS, "y", "s"], np.r_[m.x[:, 0], m.y[:, 0]], strict=True)], "term string, value double"), 4)


CROSS = f"WITH {DATA}, m AS (SELECT corr(a, b) AS r, corr(y, s) AS q, corr(a, y) AS ay, corr(a, s) AS az, corr(b, y) AS yb, corr(b, s) AS zb FROM t)"
#: The squares of both correlations are the eigenvalues of a product of two-by-two matrices.
AGREEMENT = CROSS + """, i AS (SELECT (ay - r * yb) / (1 - r * r) AS p, (az - r * zb) / (1 - r * r) AS o, (yb - r * ay) / (1 - r * r) AS u, (zb - r * az) / (1 - r * r) AS v, (ay - q * az) / (1 - q * q) AS e, (yb - q * zb) / (1 - q * q) AS f, (az - q * ay) / (1 - q * q) AS g, (zb - q * yb) / (1 - q * q) AS h FROM m),
k AS (SELECT p * e + o * g AS k1, p * f + o * h AS k2, u * e + v * g AS k3, u * f + v * h AS k4 FROM i), x AS (SELECT (k1 + k4) / 2 AS half, sqrt(((k1 + k4) / 2) ** 2 - (k1 * k4 - k2 * k3)) AS d FROM k) SELECT round(sqrt(half + d), 4) AS first, round(sqrt(half - d), 4) AS second, 0.0::DOUBLE AS between FROM x"""
DIRECTIONS = CROSS + """, k AS (SELECT *, atan2(2 * (ay * yb + az * zb), ay * ay + az * az - yb * yb - zb * zb) / 2 AS w FROM m), x AS (SELECT *, cos(w) * z AS wa, sin(w) * z AS wb FROM (SELECT *, CASE WHEN abs(cos(w)) >= abs(sin(w)) THEN sign(cos(w)) ELSE sign(sin(w)) END AS z FROM k)),
c AS (SELECT wa, wb, ay * wa + yb * wb AS cy, az * wa + zb * wb AS cs FROM x) SELECT 'a' AS term, round(wa, 4) AS value FROM c UNION ALL SELECT 'b', round(wb, 4) FROM c UNION ALL SELECT 'y', round(cy / sqrt(cy * cy + cs * cs), 4) FROM c UNION ALL SELECT 's', round(cs / sqrt(cy * cy + cs * cs), 4) FROM c"""

QUERIES = {
    "cca": (agreement, AGREEMENT),
    "pls_canonical": (directions, DIRECTIONS),
    "select_fpr": (features(lambda x, v: P.select_fpr(chances(v), 0.01)), f"WITH {CHANCES} SELECT feature FROM p WHERE p < 0.01"),
    "select_fwe": (features(lambda x, v: P.select_fwe(chances(v), 0.01)), f"WITH {CHANCES} SELECT feature FROM p WHERE p < 0.01 / 4"),
    "select_fdr": (features(lambda x, v: P.select_fdr(chances(v), 0.01)), f"WITH {CHANCES} SELECT feature FROM p WHERE p <= (SELECT max(p) FROM (SELECT p, row_number() OVER (ORDER BY p) AS i FROM p) WHERE p <= 0.01 * i / 4)"),
    "repeated_k_fold": (lambda s, d: sizes(S.repeated_k_fold(customers(s, d), "id", 4, 2), "fold_"), EVEN.format(p="fold_", k=4, r=2)),
    "leave_one_out": (lambda s, d: s.createDataFrame([(t[0],) for t in S.leave_one_out(_t(s, d, "nation").count())], "place long"), "SELECT n_nationkey::BIGINT AS place FROM nation"),
    "leave_p_out": (lambda s, d: s.createDataFrame(list(S.leave_p_out(_t(s, d, "nation").count(), 2)), "a long, b long"), "SELECT x.n_nationkey::BIGINT AS a, y.n_nationkey::BIGINT AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey"),
    "leave_p_groups_out": (lambda s, d: s.createDataFrame(S.leave_p_groups_out(_t(s, d, "customer"), "c_mktsegment", 2), "a string, b string"), "WITH g AS (SELECT DISTINCT c_mktsegment AS g FROM customer) SELECT x.g AS a, y.g AS b FROM g x JOIN g y ON x.g < y.g"),
    "predefined_split": (lambda s, d: s.createDataFrame([(f,) for f in S.predefined_split(data(s, d).withColumn("f", F.col("f") - 1), "f")], "fold long"), f"WITH {DATA} SELECT DISTINCT (f - 1)::BIGINT AS fold FROM t WHERE f >= 1"),
    "time_series_split": (lambda s, d: S.time_series_split(customers(s, d), "id", 3, gap=2).select("id", *[f"{k}_{i}" for i in range(3) for k in ("train", "test")]), "WITH x AS (SELECT c_custkey::BIGINT AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT id, " + ", ".join(f"i < n - {3 - k} * (n // 4) - 2 AS train_{k}, i >= n - {3 - k} * (n // 4) AND i < n - {2 - k} * (n // 4) AS test_{k}" for k in range(3)) + " FROM x"),
    "cross_val_score": (scored, f"WITH {FOLDS} SELECT f::INT AS fold, round(max(mse) FILTER (test), 4) AS score, round(max(mse) FILTER (test), 4) AS test, round(max(mse) FILTER (NOT test), 4) AS train FROM k WHERE alpha = 5e4 GROUP BY f"),
    "column_transformer": (lambda s, d: rounded(P.ColumnTransformer(STEPS, "drop").transform(data(s, d)).select("a", "b").distinct(), 5), f"{SCALED} SELECT DISTINCT round((a - m) / d, 5) AS a, round(b, 5) AS b FROM t, m"),
    "feature_union": (parts, f"WITH {DATA} SELECT DISTINCT round(a, 4) AS a, round(b, 4) AS b, round(a + b, 4) AS sum, round(a * a, 4) AS square FROM t"),
    "multi_output": (outputs, f"WITH {DATA}, m AS (SELECT regr_slope(b, a) AS p, regr_intercept(b, a) AS q, regr_slope(y, a) AS u, regr_intercept(y, a) AS v FROM t) SELECT DISTINCT round(a, 4) AS a, round(p * a + q, 4) AS b, round(u * a + v, 4) AS y FROM t, m"),
    "regressor_chain": (chained, f"WITH {DATA}, g AS ({SUMS}), w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ab / aa AS p FROM g), c AS (SELECT DISTINCT a FROM t), x AS (SELECT a, mb + p * (a - ma) AS b, ma, mb, my, wa, wb FROM c, w) SELECT round(a, 4) AS a, round(b, 4) AS b, round(my + wa * (a - ma) + wb * (b - mb), 4) AS y FROM x"),
    "transformed_target": (coefficients(lambda x: L.ols(L.gram(x.withColumn("y", F.log1p("y")), ["a"], ["y"]))), f"WITH {DATA}, m AS (SELECT regr_intercept(ln(1 + y), a) AS i, regr_slope(ln(1 + y), a) AS w FROM t) SELECT 'intercept' AS term, round(i, 5) AS value FROM m UNION ALL SELECT 'a', round(w, 5) FROM m"),
    "sgd_regressor": (epochs, stepped(12, "(0.02 / (it + 1) ** 0.25)", "0.01")),
    "sgd_classifier_hinge": (classified("hinge"), against_rest("CASE WHEN z * f < 1 THEN -z ELSE 0 END")),
    "sgd_classifier_log_loss": (classified("log_loss"), against_rest("-z / (1 + exp(z * f))")),
    "sgd_classifier_modified_huber": (classified("modified_huber"), against_rest("CASE WHEN z * f < -1 THEN -4 * z WHEN z * f < 1 THEN -2 * z * (1 - z * f) ELSE 0 END")),
    "incremental_pca": (batches, f"WITH {DATA}, z AS ({COV.format(e='covar_samp')}), e AS (SELECT (aa + bb) / 2 AS m, sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS d FROM z) SELECT 0 AS k, round(m + d, 5) AS variance, round((m + d) / (2 * m), 5) AS ratio FROM e UNION ALL SELECT 1, round(m - d, 5), round((m - d) / (2 * m), 5) FROM e"),
    "whitened_pca": (white, "SELECT 1.0::DOUBLE AS first, 1.0::DOUBLE AS second, 0.0::DOUBLE AS both"),
    "graphical_lasso_cv": (lasso_scores, LASSO),
    "pls_one_component": (weights("regression"), ONE),
    "cca_one_component": (weights("cca"), MOST),
    "log_likelihood": (lambda s, d: rounded(s.createDataFrame([(L.log_likelihood(c := L.covariance(L.gram(data(s, d), XS, [])), np.linalg.inv(c)),)], "value double"), 5), f"WITH {DATA}, m AS ({COV.format(e='covar_pop')}) SELECT round((-2 - ln(aa * bb - ab * ab) - 2 * ln(2 * pi())) / 2, 5) AS value FROM m"),
    "gram_matrix": (lambda s, d: matrix(s, L.gram(data(s, d), XS, []).m / 1000, 3), f"WITH {DATA}, m AS (SELECT [count(*)::DOUBLE, sum(a), sum(b)] AS x, [sum(a), sum(a * a), sum(a * b)] AS y, [sum(b), sum(a * b), sum(b * b)] AS z FROM t) SELECT i, j, round([x, y, z][i + 1][j + 1] / 1000, 3) AS value FROM m, (SELECT unnest(range(3))::INT AS i), (SELECT unnest(range(3))::INT AS j)"),
}
