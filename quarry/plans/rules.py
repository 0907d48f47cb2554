"""Queries of selection rules, validation, multiclass scores, bandwidths and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import cluster as C
from quarry.operators import kernel_models as K
from quarry.operators import linear as L
from quarry.operators import metrics as M
from quarry.operators import neighbors as N
from quarry.operators import preprocess as P
from quarry.operators import selection as S
from quarry.plans.cluster import EDGES, edges
from quarry.plans.linear import DATA, SUMS, XS, data
from quarry.plans.metrics import AGREE, REG, _t, clf, reg

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPREAD = "v AS (" + " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS feature, var_pop({c}) AS v FROM lineitem" for k, c in enumerate(COLUMNS)) + ")"


def features(rule):
    """The names that ``rule(scores of all columns by their variance)`` keeps."""

    def q(s, d):
        x = _t(s, d, "lineitem")
        row = x.agg(*[F.var_pop(c) for c in COLUMNS]).first()
        return s.createDataFrame([(c,) for c in rule(x, list(zip(COLUMNS, map(float, row), strict=True)))], "feature string")

    return q


def three(s, d):
    """Targets of three classes with a column of scores for each."""
    q = F.col("l_quantity") / 51
    return _t(s, d, "lineitem").select(F.col("l_returnflag").alias("y"), q.alias("pa"), ((1 - q) * F.col("l_discount") * 5).alias("pn"), (1 - q).alias("pr"))


THREE = "t AS (SELECT l_returnflag AS y, l_quantity / 51 AS pa, (1 - l_quantity / 51) * l_discount * 5 AS pn, 1 - l_quantity / 51 AS pr FROM lineitem)"
PROBS = {"A": "pa", "N": "pn", "R": "pr"}


def area(k: str, c: str, part: str = "true") -> str:
    """SQL of the area below the curve of class ``k`` by the score ``c``, on some rows."""
    g = f"SELECT {c} AS p, count(*) FILTER (y = '{k}') AS pos, count(*) FILTER (y <> '{k}') AS neg FROM t WHERE {part} GROUP BY 1"
    return f"(SELECT sum(neg * (cp - pos / 2)) / (sum(pos)::DOUBLE * sum(neg)) FROM (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp FROM ({g})))"


FOLDS = f"""{DATA}, m AS (SELECT x.f, z.f = x.f AS test, count(*) AS n, avg(a) AS ma, avg(y) AS my, var_pop(a) AS aa, covar_pop(a, y) AS ay, var_pop(y) AS yy FROM (SELECT DISTINCT f FROM t) x, t z GROUP BY 1, 2),
e AS (SELECT r.f, alpha, r.ay * r.n / (r.aa * r.n + alpha) AS w, r.my - r.ma * (r.ay * r.n / (r.aa * r.n + alpha)) AS i FROM m r, (VALUES (0.0::DOUBLE), (5e4), (1e6)) v(alpha) WHERE NOT r.test),
k AS (SELECT f, alpha, test, yy - 2 * w * ay + w * w * aa + (my - i - w * ma) ** 2 AS mse FROM e JOIN m USING (f))"""


def ridge(alpha=0.0):
    def fit(train):
        m = L.ridge(L.gram(train, ["a"], ["y"]), alpha)
        return lambda x: x.withColumn("p", m.predict())

    return fit


def mse(x):
    return -float(x.agg(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0])


def out_of_fold(s, d):
    x = data(s, d)
    return rounded(S.cross_val_predict(x, ridge(), [0, 1, 2], "f").groupBy("f").agg(F.avg("p").alias("mean"), F.avg((F.col("y") - F.col("p")) ** 2).alias("mse")), 4)


def validated(s, d):
    r = S.validation_curve(data(s, d).withColumn("fold", F.col("f")), ridge, "alpha", [0.0, 5e4, 1e6], mse, [0, 1, 2])
    return rounded(s.createDataFrame([(a, k, -u, -v) for a, train, test in r for k, (u, v) in enumerate(zip(train, test, strict=True))], "alpha double, fold int, train double, test double"), 4)


def searched(s, d):
    best, rows = S.search(data(s, d).withColumn("fold", F.col("f")), ridge, S.param_grid({"alpha": [0.0, 5e4, 1e6]}), mse, [0, 1, 2])
    return rounded(s.createDataFrame([(c["alpha"], -m, c == best) for c, m, _ in rows], "alpha double, mse double, best boolean"), 4)


def breusch_pagan(s, d):
    x = data(s, d)
    m = L.ols(L.gram(x, XS, ["y"]))
    return rounded(s.createDataFrame([(K.breusch_pagan(x.withColumn("p", m.predict()), ["a"], "y", "p")[0],)], "statistic double"), 3)


def holed(s, d, i, x):
    n = F.col("n_nationkey")
    cell = lambda k: F.when(n % (k + 3) == 0, float("nan")).otherwise((n * (k + 1) % 7).cast("double"))
    return _t(s, d, "nation").select(n.cast("long").alias(i), F.array(*map(cell, range(3))).alias(x))


HOLED = "n AS (SELECT n_nationkey AS k, [" + ", ".join(f"CASE WHEN n_nationkey % {k + 3} = 0 THEN NULL ELSE n_nationkey * {k + 1} % 7 END" for k in range(3)) + "] AS x FROM nation)"

QUERIES = {
    "adjusted_mutual_info": (lambda s, d: rounded(s.createDataFrame([(M.adjusted_mutual_info(clf(s, d), "y", "s"),)], "score double")), f"""WITH {AGREE}, x AS (SELECT na, nb, N_, unnest(range(greatest(1, na + nb - N_)::BIGINT, least(na, nb)::BIGINT + 1)) AS k FROM a, b, z),
p AS (SELECT sum(k / N_ * ln(N_ * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(N_ - na + 1) + lgamma(N_ - nb + 1) - lgamma(N_ + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(N_ - na - nb + k + 1))) AS emi FROM x)
SELECT round((mi - emi) / (greatest(ha, hb) - emi), 6) AS score FROM z, p"""),
    "multiclass_log_loss": (lambda s, d: rounded(M.multiclass_log_loss(three(s, d), "y", PROBS)), f"WITH {THREE}, c AS (SELECT y, " + ", ".join(f"greatest(1e-15, least(1 - 1e-15, {c})) AS {c}" for c in PROBS.values()) + " FROM t) SELECT round(-avg(ln(CASE y WHEN 'A' THEN pa WHEN 'N' THEN pn ELSE pr END / (pa + pn + pr))), 6) AS log_loss FROM c"),
    "multiclass_roc_auc": (lambda s, d: rounded(M.multiclass_roc_auc(three(s, d), "y", PROBS)), f"WITH {THREE} " + " UNION ALL ".join(f"SELECT '{k}' AS label, (SELECT count(*) FROM t WHERE y = '{k}') AS support, round({area(k, c)}, 6) AS roc_auc_score" for k, c in PROBS.items())),
    "multiclass_roc_auc_pairs": (lambda s, d: rounded(M.multiclass_roc_auc_pairs(three(s, d), "y", PROBS)), f"WITH {THREE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(({area(a, PROBS[a], part)} + {area(b, PROBS[b], part)}) / 2, 6) AS roc_auc_score" for a, b in (("A", "N"), ("A", "R"), ("N", "R")) for part in [f"y IN ('{a}', '{b}')"])),
    "scorers": (lambda s, d: rounded(s.createDataFrame([(n, float(M.get_scorer(n)(reg(s, d), "y", "p"))) for n in ("r2", "neg_mean_squared_error", "neg_mean_absolute_error")], "name string, score double")), f"WITH {REG} SELECT 'r2' AS name, round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS score FROM t UNION ALL SELECT 'neg_mean_squared_error', round(-avg((y - p) ** 2), 6) FROM t UNION ALL SELECT 'neg_mean_absolute_error', round(-avg(abs(y - p)), 6) FROM t"),
    "nan_euclidean": (lambda s, d: rounded(N.pairwise(holed(s, d, "i", "x"), holed(s, d, "j", "y"), N.nan_euclidean).where(~F.isnan("value"))), f"WITH {HOLED}, q AS (SELECT u.k AS i, v.k AS j, count(*) AS m, sum((u.x[g] - v.x[g]) ** 2) AS d FROM n u, n v, (VALUES (1), (2), (3)) z(g) WHERE u.x[g] IS NOT NULL AND v.x[g] IS NOT NULL GROUP BY 1, 2) SELECT i::BIGINT AS i, j::BIGINT AS j, round(sqrt(d * 3 / m), 6) AS value FROM q"),
    "variance_threshold": (features(lambda x, v: P.variance_threshold(x, COLUMNS, 0.01)), f"WITH {SPREAD} SELECT feature FROM v WHERE v > 0.01"),
    "select_k_best": (features(lambda x, v: P.select_k_best(v, 2)), f"WITH {SPREAD} SELECT feature FROM v ORDER BY v DESC, k LIMIT 2"),
    "select_percentile": (features(lambda x, v: P.select_percentile(v, 70)), f"WITH {SPREAD} SELECT feature FROM v ORDER BY v DESC, k LIMIT 3"),
    "select_from_model": (features(lambda x, v: P.select_from_model(v)), f"WITH {SPREAD} SELECT feature FROM v WHERE v >= (SELECT avg(v) FROM v)"),
    "rfe": (lambda s, d: s.createDataFrame(list(P.rfe([(c, float(v)) for c, v in zip(COLUMNS, _t(s, d, "lineitem").agg(*[F.var_pop(c) for c in COLUMNS]).first(), strict=True)], 1).items()), "feature string, rank int"), f"WITH {SPREAD} SELECT feature, (row_number() OVER (ORDER BY v DESC, k DESC))::INT AS rank FROM v"),
    "cross_val_predict": (out_of_fold, f"WITH {FOLDS} SELECT k.f, round((SELECT e.i + e.w * m.ma FROM e JOIN m USING (f) WHERE e.alpha = 0 AND m.test AND e.f = k.f), 4) AS mean, round(mse, 4) AS mse FROM k WHERE test AND alpha = 0"),
    "validation_curve": (validated, f"WITH {FOLDS} SELECT alpha, f::INT AS fold, round(max(mse) FILTER (NOT test), 4) AS train, round(max(mse) FILTER (test), 4) AS test FROM k GROUP BY 1, 2"),
    "grid_search": (searched, f"WITH {FOLDS}, g AS (SELECT alpha, avg(mse) AS mse FROM k WHERE test GROUP BY 1) SELECT alpha, round(mse, 4) AS mse, row_number() OVER (ORDER BY mse, alpha) = 1 AS best FROM g"),
    "leave_one_group_out": (lambda s, d: s.createDataFrame([(g,) for g in S.leave_one_group_out(_t(s, d, "customer"), "c_mktsegment")], "g string"), "SELECT DISTINCT c_mktsegment AS g FROM customer"),
    "breusch_pagan": (breusch_pagan, f"WITH {DATA}, g AS ({SUMS}), w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM g), e AS (SELECT a, (y - my - wa * (a - ma) - wb * (b - mb)) ** 2 AS e FROM t, w) SELECT round(count(*) * corr(a, e) ** 2, 3) AS statistic FROM e"),
    "bandwidths": (lambda s, d: rounded(s.createDataFrame([(float(N.silverman(x := data(s, d), "y")), float(N.scott(x, "y")))], "silverman double, scott double")), f"WITH {DATA}, q AS (SELECT count(*) AS n, stddev_samp(y) AS sd, (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.349 AS iqr FROM t) SELECT round(1.06 * n ** -0.2 * least(sd, iqr), 6) AS silverman, round(sd * n ** -0.2, 6) AS scott FROM q"),
    "alpha_grid": (lambda s, d: rounded(s.createDataFrame([(k, float(v)) for k, v in enumerate(L.alpha_grid(L.gram(data(s, d), XS, ["y"]), 5))], "k int, alpha double")), f"WITH {DATA}, m AS (SELECT greatest(abs(covar_pop(a, y)), abs(covar_pop(b, y))) AS top FROM t) SELECT k::INT AS k, round(top * 10 ** (-3 * k / 4), 6) AS alpha FROM m, range(5) r(k)"),
    "pls_svd": (lambda s, d: rounded(s.createDataFrame([(c, abs(float(w))) for c, w in zip(XS, L.pls_svd(L.gram(data(s, d), XS, ["y"]), 1)[0][:, 0], strict=True)], "term string, weight double")), f"WITH {DATA}, m AS (SELECT abs(corr(a, y)) AS a, abs(corr(b, y)) AS b FROM t) SELECT 'a' AS term, round(a / sqrt(a * a + b * b), 6) AS weight FROM m UNION ALL SELECT 'b', round(b / sqrt(a * a + b * b), 6) FROM m"),
    "all_pairs_shortest_paths": (lambda s, d: C.all_pairs_shortest_paths(edges(s, d)), f"WITH RECURSIVE {EDGES}, r AS (SELECT n AS source, n AS node, 0.0::DOUBLE AS distance, 0 AS hops FROM (SELECT u AS n FROM e UNION SELECT v FROM e) UNION SELECT source, e.v, r.distance + e.w, hops + 1 FROM r JOIN e ON r.node = e.u WHERE hops < 30) SELECT source::BIGINT AS source, node::BIGINT AS node, min(distance) AS distance FROM r GROUP BY 1, 2"),
}
