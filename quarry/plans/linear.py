"""Queries of linear models, covariance and components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import linear as L
from quarry.plans.metrics import _t

XS = ["a", "b"]
DATA = "t AS (SELECT l_quantity / 10 AS a, l_discount * 20 AS b, l_extendedprice / 1000 + l_quantity / 5 AS y, l_orderkey % 3 AS f, l_returnflag AS c, (l_linestatus = 'O')::INT AS s FROM lineitem)"


def data(s, d):
    return _t(s, d, "lineitem").select((F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 20).alias("b"), (F.col("l_extendedprice") / 1000 + F.col("l_quantity") / 5).alias("y"), (F.col("l_orderkey") % 3).alias("f"), F.col("l_returnflag").alias("c"), (F.col("l_linestatus") == "O").cast("int").alias("s"))


def matrix(s, m, digits=5):
    m = np.asarray(m)
    return rounded(s.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "i int, j int, value double"), digits)


def coefficients(model, digits=5):
    """A query that gives the terms of ``model(df)``."""
    return lambda s, d: rounded(model(x := data(s, d)).table(x), digits)


def solved(alpha: str) -> str:
    """SQL of a two-feature ridge by Cramer's rule on deviations."""
    return f"""WITH {DATA}, g AS (SELECT count(*) * var_pop(a) + {alpha} AS aa, count(*) * var_pop(b) + {alpha} AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t),
w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM g)
SELECT 'a' AS term, round(wa, 5) AS value FROM w UNION ALL SELECT 'b', round(wb, 5) FROM w UNION ALL SELECT 'intercept', round(my - wa * ma - wb * mb, 5) FROM w"""


COV = "SELECT {e}(a, a) AS aa, {e}(a, b) AS ab, {e}(b, b) AS bb, count(*)::DOUBLE AS n FROM t"
CELLS = "SELECT 0 AS i, 0 AS j, round({aa}, 5) AS value FROM m UNION ALL SELECT 0, 1, round({ab}, 5) FROM m UNION ALL SELECT 1, 0, round({ab}, 5) FROM m UNION ALL SELECT 1, 1, round({bb}, 5) FROM m"


def newton(cells: str, weights: str, matrix: list[str], right: list[str], new: str, rounds: int = 40, first: str = "0.0::DOUBLE") -> str:
    """SQL of rounds w = ``new`` with {x} the solution of a symmetric system of three unknowns (Cramer's rule), whose sums are over ``cells`` with the columns ``weights``."""
    h = dict(zip(("h00", "h01", "h02", "h11", "h12", "h22"), matrix, strict=True)) | dict(zip(("g0", "g1", "g2"), right, strict=True))
    sums = ", ".join(f"{e} AS {k}" for k, e in h.items())
    c = {"c00": "h11 * h22 - h12 * h12", "c01": "h02 * h12 - h01 * h22", "c02": "h01 * h12 - h02 * h11", "c11": "h00 * h22 - h02 * h02", "c12": "h01 * h02 - h00 * h12", "c22": "h00 * h11 - h01 * h01"}
    x = [f"(c0{k} * g0 + {f'c1{k}' if k else 'c01'} * g1 + {f'c2{k}' if k == 2 else f'c{k}2'} * g2) / (h00 * c00 + h01 * c01 + h02 * c02)" for k in range(3)]
    step = ", ".join(new.format(w=w, x=e) for w, e in zip(("w0", "wa", "wb"), x, strict=True))
    return f"""WITH RECURSIVE {DATA}, z AS ({cells}), r AS (SELECT 0 AS it, {first} AS w0, {first} AS wa, {first} AS wb UNION ALL SELECT it + 1, {step} FROM (SELECT *, {", ".join(f"{e} AS {k}" for k, e in c.items())}
FROM (SELECT it, w0, wa, wb, {sums} FROM (SELECT *, {weights} FROM r, z WHERE it < {rounds}) GROUP BY it, w0, wa, wb)))
SELECT 'a' AS term, round(wa, 5) AS value FROM r WHERE it = {rounds} UNION ALL SELECT 'b', round(wb, 5) FROM r WHERE it = {rounds} UNION ALL SELECT 'intercept', round(w0, 5) FROM r WHERE it = {rounds}"""


def squares(weight: str, aim: str, ridge: tuple[str, str, str], scale: str = "1") -> tuple[list[str], list[str]]:
    """Weighted normal equations of (1, a, b), with additions to the diagonal."""
    s = lambda e: f"{scale} * sum({weight} * {e})"
    return [s("1") + f" + {ridge[0]}", s("a"), s("b"), s("a * a") + f" + {ridge[1]}", s("a * b"), s("b * b") + f" + {ridge[2]}"], [s(aim), s(f"({aim}) * a"), s(f"({aim}) * b")]


def glm_sql(power: float, alpha: float) -> str:
    mu = "CASE WHEN it = 0 THEN ln(y) ELSE greatest(-20, least(20, w0 + wa * a + wb * b)) END"
    return newton("SELECT a, b, greatest(y, 1e-10) AS y FROM t", f"{mu} AS eta, exp(eta) AS mu, exp(eta * {2 - power}) AS q", *squares("q", "(eta + (y - mu) / mu)", (str(alpha),) * 3), "{x}", 25)


#: Products of deviations, means and the number of rows; least squares from them.
SUMS = "SELECT count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb, count(*) * var_pop(y) AS yy, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t"
TERMS = "SELECT 'a' AS term, round(wa, 5) AS value FROM last UNION ALL SELECT 'b', round(wb, 5) FROM last UNION ALL SELECT 'intercept', round(my - wa * ma - wb * mb, 5) FROM last, g"


def reweighted(weight: str, ridge: str, rounds: int) -> str:
    """SQL of least squares on deviations by rounds of weights of the residual e, from ridge at first, until no weight moves by 1e-5."""
    solve = "(ay * (bb + {r}) - yb * ab) / ((aa + {r}) * (bb + {r}) - ab * ab) AS {a}, (yb * (aa + {r}) - ay * ab) / ((aa + {r}) * (bb + {r}) - ab * ab) AS {b}"
    return f"""WITH RECURSIVE {DATA}, g AS ({SUMS}), c AS (SELECT a - ma AS a, b - mb AS b, y - my AS y FROM t, g), r AS (SELECT 0 AS it, {solve.format(r=ridge, a="wa", b="wb")}, 1e9::DOUBLE AS d FROM g
UNION ALL SELECT it + 1, na, nb, greatest(abs(na - wa), abs(nb - wb)) FROM (SELECT it, wa, wb, {solve.format(r=ridge, a="na", b="nb")} FROM (SELECT it, wa, wb, sum(q * a * a) AS aa, sum(q * b * b) AS bb, sum(q * a * b) AS ab, sum(q * a * y) AS ay, sum(q * b * y) AS yb
FROM (SELECT *, {weight} AS q FROM (SELECT *, y - wa * a - wb * b AS e FROM r, c WHERE d >= 1e-5 AND it < {rounds})) GROUP BY it, wa, wb))), last AS (SELECT * FROM r WHERE it = (SELECT max(it) FROM r)) """ + TERMS


#: Rounds of the evidence: q is the ratio of the precisions; the answer is that of the first round that moves the weights by less than 1e-3 in all.
EVIDENCE = f"""WITH RECURSIVE {DATA}, g AS ({SUMS}), r AS (SELECT 0 AS it, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 1.0::DOUBLE AS lam, 1.0::DOUBLE AS alpha, 1e9::DOUBLE AS d
UNION ALL SELECT it + 1, na, nb, gamma / (na * na + nb * nb), (n - gamma) / (yy - 2 * (na * ay + nb * yb) + na * na * aa + 2 * na * nb * ab + nb * nb * bb), abs(na - wa) + abs(nb - wb)
FROM (SELECT *, (ay * (bb + q) - yb * ab) / det AS na, (yb * (aa + q) - ay * ab) / det AS nb, 2 - q * (aa + bb + 2 * q) / det AS gamma FROM (SELECT *, (aa + q) * (bb + q) - ab * ab AS det FROM (SELECT *, lam / alpha AS q FROM r, g WHERE d >= 1e-3 AND it < 300)))), last AS (SELECT * FROM r WHERE it = (SELECT max(it) FROM r)) """ + TERMS
#: The same with a precision for each weight.
RELEVANCE = f"""WITH RECURSIVE {DATA}, g AS ({SUMS}), r AS (SELECT 0 AS it, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 1.0::DOUBLE AS la, 1.0::DOUBLE AS lb, n / yy AS alpha, 1e9::DOUBLE AS d FROM g
UNION ALL SELECT it + 1, na, nb, (ga + 2e-6) / (na * na + 2e-6), (gb + 2e-6) / (nb * nb + 2e-6), (n - ga - gb + 2e-6) / (yy - 2 * (na * ay + nb * yb) + na * na * aa + 2 * na * nb * ab + nb * nb * bb + 2e-6), abs(na - wa) + abs(nb - wb)
FROM (SELECT *, alpha * (ay * hb - yb * alpha * ab) / det AS na, alpha * (yb * ha - ay * alpha * ab) / det AS nb, 1 - la * hb / det AS ga, 1 - lb * ha / det AS gb FROM (SELECT *, ha * hb - alpha * alpha * ab * ab AS det FROM (SELECT *, la + alpha * aa AS ha, lb + alpha * bb AS hb FROM r, g WHERE d >= 1e-3 AND it < 300)))), last AS (SELECT * FROM r WHERE it = (SELECT max(it) FROM r)) """ + TERMS
#: Ridge of three alphas on all folds but one, judged on that one.
FOLDS = f"""WITH {DATA}, g AS ({SUMS}), m AS (SELECT f, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb, sum(y * y) AS yy FROM t GROUP BY f),
o AS (SELECT x.f, sum(z.n) AS n, sum(z.a) / sum(z.n) AS ma, sum(z.b) / sum(z.n) AS mb, sum(z.y) / sum(z.n) AS my, sum(z.aa) - sum(z.a) ** 2 / sum(z.n) AS aa, sum(z.bb) - sum(z.b) ** 2 / sum(z.n) AS bb, sum(z.ab) - sum(z.a) * sum(z.b) / sum(z.n) AS ab, sum(z.ay) - sum(z.a) * sum(z.y) / sum(z.n) AS ay, sum(z.yb) - sum(z.b) * sum(z.y) / sum(z.n) AS yb FROM m x JOIN m z ON x.f <> z.f GROUP BY 1),
w AS (SELECT f, alpha, ma, mb, my, (ay * (bb + alpha) - yb * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, (yb * (aa + alpha) - ay * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM o, (VALUES (0.1::DOUBLE), (1.0), (10.0)) v(alpha)),
e AS (SELECT alpha, (m.yy - 2 * (i * m.y + wa * m.ay + wb * m.yb) + i * i * n + 2 * i * (wa * m.a + wb * m.b) + wa * wa * m.aa + 2 * wa * wb * m.ab + wb * wb * m.bb) / n AS mse FROM m JOIN (SELECT *, my - wa * ma - wb * mb AS i FROM w) USING (f)),
k AS (SELECT alpha FROM e GROUP BY 1 ORDER BY avg(mse), alpha LIMIT 1), last AS (SELECT (ay * (bb + alpha) - yb * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, (yb * (aa + alpha) - ay * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM g, k) """ + TERMS
def descended(candidates: str) -> str:
    """SQL of coordinate descent for each of ``candidates`` (c, l1, l2) on all folds but one, judged on that one; the best is fitted to all rows (fold -1)."""
    step = "sign({x} - ab * {o}) * greatest(abs({x} - ab * {o}) - l1, 0) / ({d} + l2)"
    return f"""WITH RECURSIVE {DATA}, m AS (SELECT f::BIGINT AS f, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb, sum(y * y) AS yy FROM t GROUP BY f),
q AS (SELECT x.f, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(ay) AS ay, sum(yb) AS yb FROM (SELECT f FROM m UNION ALL SELECT -1) x JOIN m ON m.f <> x.f GROUP BY 1),
o AS (SELECT f, a / n AS ma, b / n AS mb, y / n AS my, aa / n - (a / n) ** 2 AS aa, ab / n - a * b / n / n AS ab, bb / n - (b / n) ** 2 AS bb, ay / n - a * y / n / n AS ay, yb / n - b * y / n / n AS yb FROM q),
v AS ({candidates}), r AS (SELECT 0 AS it, f, c, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 1e9::DOUBLE AS shift FROM o, v UNION ALL SELECT it + 1, f, c, na, nb, greatest(abs(na - wa), abs(nb - wb))
FROM (SELECT *, {step.format(x="yb", o="na", d="bb")} AS nb FROM (SELECT *, {step.format(x="ay", o="wb", d="aa")} AS na FROM r JOIN o USING (f) JOIN v USING (c) WHERE shift >= 1e-4 AND it < 1000))),
l AS (SELECT f, c, wa, wb, my - wa * ma - wb * mb AS i FROM (FROM r QUALIFY row_number() OVER (PARTITION BY f, c ORDER BY it DESC) = 1) JOIN o USING (f)),
e AS (SELECT c, avg((yy - 2 * (i * y + wa * ay + wb * yb) + i * i * n + 2 * i * (wa * a + wb * b) + wa * wa * aa + 2 * wa * wb * ab + wb * wb * bb) / n) AS mse FROM l JOIN m USING (f) GROUP BY c),
last AS (SELECT l.* FROM l JOIN (SELECT c FROM e ORDER BY mse, c LIMIT 1) USING (c) WHERE f = -1)
SELECT 'a' AS term, round(wa, 5) AS value FROM last UNION ALL SELECT 'b', round(wb, 5) FROM last UNION ALL SELECT 'intercept', round(i, 5) FROM last"""


def path(ratios: str) -> str:
    """SQL of 20 alphas for each share of the first penalty, from the least that leaves no weight."""
    return f"SELECT 20 * r + k AS c, alpha * ratio AS l1, alpha * (1 - ratio) AS l2 FROM (SELECT r, k, ratio, top / ratio * 10 ** (-3 * k / 19) AS alpha FROM (SELECT greatest(abs(ay), abs(yb)) AS top FROM o WHERE f = -1), (VALUES {ratios}) x(r, ratio), (SELECT unnest(range(20)) AS k))"


#: The class with the largest least-squares score of its indicator.
REST = f"""WITH {DATA}, q AS (SELECT k.c AS p, a, b, (t.c = k.c)::INT::DOUBLE AS y FROM t, (SELECT DISTINCT c FROM t) k), g AS (SELECT p, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM q GROUP BY p),
k AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT k.*, p, my + (a - ma) * (ay * bb - yb * ab) / (aa * bb - ab * ab) + (b - mb) * (yb * aa - ay * ab) / (aa * bb - ab * ab) AS z FROM k, g) SELECT c, p, sum(n)::BIGINT AS n FROM (FROM r QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY z DESC, p) = 1) GROUP BY 1, 2"""
#: Votes of least squares for each pair of classes.
PAIRS = f"""WITH {DATA}, q AS (SELECT u.c AS u, v.c AS v, a, b, (t.c = v.c)::INT::DOUBLE AS y FROM (SELECT DISTINCT c FROM t) u JOIN (SELECT DISTINCT c FROM t) v ON u.c < v.c JOIN t ON t.c IN (u.c, v.c)), g AS (SELECT u, v, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM q GROUP BY 1, 2),
k AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT k.*, CASE WHEN my - 0.5 + (a - ma) * (ay * bb - yb * ab) / (aa * bb - ab * ab) + (b - mb) * (yb * aa - ay * ab) / (aa * bb - ab * ab) > 0 THEN v ELSE u END AS p FROM k, g),
h AS (SELECT a, b, c, n, p, count(*) AS votes FROM r GROUP BY ALL) SELECT c, p, sum(n)::BIGINT AS n FROM (FROM h QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY votes DESC, p) = 1) GROUP BY 1, 2"""


def predicted(model):
    def f(s, d):
        x = data(s, d)
        return x.withColumn("p", model(x)).groupBy("c", "p").agg(F.count("*").alias("n"))

    return f


QUERIES = {
    "linear_regression": (coefficients(lambda x: L.ols(L.gram(x, XS, ["y"]))), solved("0")),
    "linear_regression_1d": (coefficients(lambda x: L.ols(L.gram(x, ["a"], ["y"]))), f"WITH {DATA} SELECT 'a' AS term, round(regr_slope(y, a), 5) AS value FROM t UNION ALL SELECT 'intercept', round(regr_intercept(y, a), 5) FROM t"),
    "ridge": (coefficients(lambda x: L.ridge(L.gram(x, XS, ["y"]), 100.0)), solved("100")),
    "ridge_cv": (coefficients(lambda x: L.ridge_cv(x, XS, "y", "f")[0]), FOLDS),
    "lasso": (coefficients(lambda x: L.lasso(L.gram(x, ["a"], ["y"]), 0.5)), f"WITH {DATA}, w AS (SELECT sign(covar_pop(a, y)) * greatest(abs(covar_pop(a, y)) - 0.5, 0) / var_pop(a) AS w, avg(a) AS ma, avg(y) AS my FROM t) SELECT 'a' AS term, round(w, 5) AS value FROM w UNION ALL SELECT 'intercept', round(my - w * ma, 5) FROM w"),
    "elastic_net": (coefficients(lambda x: L.elastic_net(L.gram(x, ["a"], ["y"]), 0.4, 0.25)), f"WITH {DATA}, w AS (SELECT sign(covar_pop(a, y)) * greatest(abs(covar_pop(a, y)) - 0.1, 0) / (var_pop(a) + 0.3) AS w, avg(a) AS ma, avg(y) AS my FROM t) SELECT 'a' AS term, round(w, 5) AS value FROM w UNION ALL SELECT 'intercept', round(my - w * ma, 5) FROM w"),
    "lasso_cv": (coefficients(lambda x: L.lasso_cv(x, XS, "y", "f", n_alphas=20)[0]), descended(path("(0, 1.0::DOUBLE)"))),
    "elastic_net_cv": (coefficients(lambda x: L.elastic_net_cv(x, XS, "y", "f")[0]), descended(path("(0, 0.1::DOUBLE), (1, 0.5), (2, 0.9)"))),
    "bayesian_ridge": (coefficients(lambda x: L.bayesian_ridge(L.gram(x, XS, ["y"]))), EVIDENCE),
    "ard_regression": (coefficients(lambda x: L.ard(L.gram(x, XS, ["y"]))), RELEVANCE),
    "orthogonal_matching_pursuit": (coefficients(lambda x: L.omp(L.gram(x, XS, ["y"]), 2)), solved("0")),
    "lars": (coefficients(lambda x: L.lars(L.gram(x, XS, ["y"]))), solved("0")),
    "lasso_lars": (coefficients(lambda x: L.lasso_lars(L.gram(x, ["a"], ["y"]), 0.5)), f"WITH {DATA}, w AS (SELECT sign(covar_pop(a, y)) * greatest(abs(covar_pop(a, y)) - 0.5, 0) / var_pop(a) AS w, avg(a) AS ma, avg(y) AS my FROM t) SELECT 'a' AS term, round(w, 5) AS value FROM w UNION ALL SELECT 'intercept', round(my - w * ma, 5) FROM w"),
    "huber_regressor": (coefficients(lambda x: L.huber(x, XS, "y")), reweighted("CASE WHEN abs(e) <= 1.35 THEN 1 ELSE 1.35 / abs(e) END", "1e-4", 100)),
    "quantile_regressor": (coefficients(lambda x: L.quantile_regression(x, XS, "y", 0.5, 0.0, 20), 3), reweighted("0.5 / greatest(abs(e), 1e-6)", "0", 20).replace(", 5)", ", 3)")),
    "poisson_regressor": (coefficients(lambda x: L.glm(x, XS, "y", "poisson", 0.0)), glm_sql(1.0, 0.0)),
    "gamma_regressor": (coefficients(lambda x: L.glm(x, XS, "y", "gamma", 1.0)), glm_sql(2.0, 1.0)),
    "tweedie_regressor": (coefficients(lambda x: L.glm(x, XS, "y", "tweedie", 1.0)), glm_sql(1.5, 1.0)),
    "logistic_regression": (coefficients(lambda x: L.logistic(x, XS, "s")), newton("SELECT a, b, s, count(*) AS n, (SELECT count(*) FROM t) AS m FROM t GROUP BY ALL", "1 / (1 + exp(-(w0 + wa * a + wb * b))) AS p", squares("n * p * (1 - p) / m", "0", ("0", "1", "1"))[0], ["sum(n * (p - s) / m)", "sum(n * (p - s) / m * a) + wa", "sum(n * (p - s) / m * b) + wb"], "{w} - {x}")),
    "linear_svc": (coefficients(lambda x: L.linear_svc(x, XS, "s")), newton("SELECT a, b, 2 * s - 1 AS s, count(*) AS n, (SELECT count(*) FROM t) AS m FROM t GROUP BY ALL", "CASE WHEN 1 - s * (w0 + wa * a + wb * b) > 0 THEN n / m ELSE 0 END AS q", *squares("q", "s", ("0", "1", "1"), "2"), "{x}")),
    "linear_svr": (coefficients(lambda x: L.linear_svr(x, XS, "y")), newton("SELECT a, b, y, 1 / (SELECT count(*) FROM t) AS n FROM t", "y - w0 - wa * a - wb * b AS e, CASE WHEN abs(e) > 0.1 THEN n ELSE 0 END AS q", *squares("q", "(y - sign(e) * 0.1)", ("0", "1", "1"), "2"), "{x}", 30)),
    "ridge_classifier": (predicted(lambda x: L.ridge_classifier(x, XS, "c").predict()), f"""WITH {DATA}, q AS (SELECT k.c AS p, a, b, CASE WHEN t.c = k.c THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM t, (SELECT DISTINCT c FROM t) k), g AS (SELECT p, count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM q GROUP BY p),
k AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT k.*, p, my + (a - ma) * (ay * bb - yb * ab) / (aa * bb - ab * ab) + (b - mb) * (yb * aa - ay * ab) / (aa * bb - ab * ab) AS z FROM k, g) SELECT c, p, sum(n)::BIGINT AS n FROM (FROM r QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY z DESC, p) = 1) GROUP BY 1, 2"""),
    "lda": (predicted(lambda x: L.lda(x, XS, "c").predict()), f"""WITH {DATA}, g AS (SELECT c, avg(a) AS ma, avg(b) AS mb, count(*) AS n, sum(a * a) - count(*) * avg(a) ** 2 AS aa, sum(b * b) - count(*) * avg(b) ** 2 AS bb, sum(a * b) - count(*) * avg(a) * avg(b) AS ab FROM t GROUP BY c),
v AS (SELECT sum(aa) / (sum(n) - count(*)) AS va, sum(bb) / (sum(n) - count(*)) AS vb, sum(ab) / (sum(n) - count(*)) AS w, sum(n) AS total FROM g), k AS (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT k.*, g.c AS p, -0.5 * ((a - ma) ** 2 * vb - 2 * (a - ma) * (b - mb) * w + (b - mb) ** 2 * va) / (va * vb - w * w) + ln(g.n / total) AS z FROM k, g, v) SELECT c, p, sum(n)::BIGINT AS n FROM (FROM r QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY z DESC, p) = 1) GROUP BY 1, 2"""),
    "qda": (predicted(lambda x: L.qda(x, XS, "c").predict()), f"""WITH {DATA}, g AS (SELECT c, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab, count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY c),
r AS (SELECT a, b, t.c, g.c AS p, -0.5 * ln(va * vb - ab * ab) - 0.5 * ((a - ma) ** 2 * vb - 2 * (a - ma) * (b - mb) * ab + (b - mb) ** 2 * va) / (va * vb - ab * ab) + ln(p) AS z FROM (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL) t, g),
q AS (SELECT a, b, c, p FROM r QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY z DESC, p) = 1) SELECT c, p, sum(n)::BIGINT AS n FROM q JOIN (SELECT a, b, c, count(*) AS n FROM t GROUP BY ALL) USING (a, b, c) GROUP BY 1, 2"""),
    "isotonic_regression": (lambda s, d: rounded(L.isotonic(x := data(s, d), "a", "y").transform(x.select("a").distinct()), 4), f"""WITH {DATA}, v AS (SELECT a, count(*) AS n, sum(y) AS s, row_number() OVER (ORDER BY a) AS i FROM t GROUP BY a), m AS (SELECT x.i, z.i AS j, (SELECT sum(s) / sum(n) FROM v q WHERE q.i BETWEEN x.i AND z.i) AS mean FROM v x JOIN v z ON x.i <= z.i),
k AS (SELECT w.a, m.i, min(m.mean) AS low FROM v w JOIN m ON m.i <= w.i AND m.j >= w.i GROUP BY 1, 2) SELECT round(a, 4) AS a, round(max(low), 4) AS prediction FROM k GROUP BY a"""),
    "empirical_covariance": (lambda s, d: matrix(s, L.covariance(L.gram(data(s, d), XS, []))), f"WITH {DATA}, m AS ({COV.format(e='covar_pop')}) " + CELLS.format(aa="aa", ab="ab", bb="bb")),
    "shrunk_covariance": (lambda s, d: matrix(s, L.shrunk_covariance(L.covariance(L.gram(data(s, d), XS, [])), 0.1)), f"WITH {DATA}, m AS ({COV.format(e='covar_pop')}) " + CELLS.format(aa="0.9 * aa + 0.05 * (aa + bb)", ab="0.9 * ab", bb="0.9 * bb + 0.05 * (aa + bb)")),
    "ledoit_wolf": (lambda s, d: matrix(s, L.ledoit_wolf(data(s, d), XS)[0]), f"""WITH {DATA}, z AS ({COV.format(e='covar_pop')}), f AS (SELECT avg(((a - x) ** 2 + (b - y2) ** 2) ** 2) AS q FROM t, (SELECT avg(a) AS x, avg(b) AS y2 FROM t)),
k AS (SELECT *, (aa + bb) / 2 AS mu, (q - (aa * aa + 2 * ab * ab + bb * bb)) / (n * 2) / (((aa - (aa + bb) / 2) ** 2 + 2 * ab * ab + (bb - (aa + bb) / 2) ** 2) / 2) AS k FROM z, f), m AS (SELECT aa, ab, bb, mu, least(1, greatest(0, k)) AS k FROM k) """ + CELLS.format(aa="(1 - k) * aa + k * mu", ab="(1 - k) * ab", bb="(1 - k) * bb + k * mu")),
    "oas": (lambda s, d: matrix(s, L.oas(L.gram(data(s, d), XS, []))[0]), f"""WITH {DATA}, z AS ({COV.format(e='covar_pop')}), k AS (SELECT *, (aa + bb) / 2 AS mu, (aa * aa + 2 * ab * ab + bb * bb) / 4 AS al FROM z), m AS (SELECT *, least(1, (al + mu * mu) / ((n + 1) * (al - mu * mu / 2))) AS k FROM k) """ + CELLS.format(aa="(1 - k) * aa + k * mu", ab="(1 - k) * ab", bb="(1 - k) * bb + k * mu")),
    "graphical_lasso": (lambda s, d: matrix(s, L.graphical_lasso(L.covariance(L.gram(data(s, d), XS, [])), 0.05)[0]), f"WITH {DATA}, m AS ({COV.format(e='covar_pop')}) " + CELLS.format(aa="aa + 0.05", ab="sign(ab) * greatest(abs(ab) - 0.05, 0)", bb="bb + 0.05")),
    "pca": (lambda s, d: rounded(L.pca(L.gram(x := data(s, d), XS, []), 2).transform(x.select("a", "b").distinct()), 4), f"""WITH {DATA}, z AS ({COV.format(e='covar_samp')}), e AS (SELECT *, (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS l1, (aa + bb) / 2 - sqrt(((aa - bb) / 2) ** 2 + ab * ab) AS l2 FROM z),
v AS (SELECT l1 - bb AS p, ab AS q, l2 - bb AS p2, ab AS q2, avg_a, avg_b FROM e, (SELECT avg(a) AS avg_a, avg(b) AS avg_b FROM t)), u AS (SELECT avg_a, avg_b, p * s1 / n1 AS p, q * s1 / n1 AS q, p2 * s2 / n2 AS p2, q2 * s2 / n2 AS q2 FROM (SELECT *, sqrt(p * p + q * q) AS n1, sqrt(p2 * p2 + q2 * q2) AS n2, CASE WHEN abs(p) >= abs(q) THEN sign(p) ELSE sign(q) END AS s1, CASE WHEN abs(p2) >= abs(q2) THEN sign(p2) ELSE sign(q2) END AS s2 FROM v))
SELECT round(a, 4) AS a, round(b, 4) AS b, round((a - avg_a) * p + (b - avg_b) * q, 4) AS pc0, round((a - avg_a) * p2 + (b - avg_b) * q2, 4) AS pc1 FROM (SELECT DISTINCT a, b FROM t), u"""),
    "truncated_svd": (lambda s, d: rounded(L.truncated_svd(L.gram(x := data(s, d), XS, []), 1).transform(x.select("a", "b").distinct()), 4), f"""WITH {DATA}, z AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM t), e AS (SELECT (aa + bb) / 2 + sqrt(((aa - bb) / 2) ** 2 + ab * ab) - bb AS p, ab AS q FROM z), u AS (SELECT p * k AS p, q * k AS q FROM (SELECT *, CASE WHEN abs(p) >= abs(q) THEN sign(p) ELSE sign(q) END / sqrt(p * p + q * q) AS k FROM e))
SELECT round(a, 4) AS a, round(b, 4) AS b, round(a * p + b * q, 4) AS pc0 FROM (SELECT DISTINCT a, b FROM t), u"""),
    "factor_analysis": (lambda s, d: rounded(s.createDataFrame([(float(v),) for v in L.factor_analysis(L.gram(data(s, d), [*XS, "y"], []), 1)[1]], "noise double"), 3), None),
    "mahalanobis": (lambda s, d: (lambda x, g: rounded(x.agg(F.avg(L.mahalanobis(XS, g.mean(), np.linalg.inv(L.covariance(g)))).alias("mean"))))(x := data(s, d), L.gram(x, XS, [])), f"WITH {DATA}, m AS (SELECT var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS w, avg(a) AS ma, avg(b) AS mb FROM t) SELECT round(avg(((a - ma) ** 2 * vb - 2 * (a - ma) * (b - mb) * w + (b - mb) ** 2 * va) / (va * vb - w * w)), 6) AS mean FROM t, m"),
    "pls_regression": (lambda s, d: rounded(s.createDataFrame([(c, float(w)) for c, w in zip(XS, L.pls(L.gram(data(s, d), XS, ["y"]), 2)[:, 0], strict=True)], "term string, value double"), 5), solved("0").split("UNION ALL SELECT 'intercept'")[0]),
}
