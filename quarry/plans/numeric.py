"""Queries of special functions, distributions, quadrature, minimisation, eigenvalues and splines, at points that come from the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import special as X
from quarry.functions.stats import rounded
from quarry.plans.metrics import _t

KEYS = "WITH k AS (SELECT n_nationkey AS k, (n_nationkey + 1) / 5 AS x FROM nation)"


def at(*columns):
    """A query of (name, function of x = (key + 1) / 5) over the keys of nations."""

    def q(s, d):
        keys = [r[0] for r in _t(s, d, "nation").select("n_nationkey").collect()]
        return rounded(s.createDataFrame([(k, *[float(f((k + 1) / 5)) for _, f in columns]) for k in keys], "k int, " + ", ".join(f"{n} double" for n, _ in columns)), 6)

    return q


def sql(**columns):
    return f"{KEYS} SELECT k, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items()) + " FROM k"


#: Simpson's rule over 2,000 panels from 0 to x, with v the place in the expression.
def simpson(f: str) -> str:
    cell = f.replace("v", "(x * i / 2000)")
    return f"(SELECT x / 6000 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {cell}) FROM (SELECT unnest(range(2001)) AS i))"


NORMAL = simpson("exp(- v * v / 2)") + " / sqrt(2 * pi())"
G = X.normal()


def solution(s, name, x):
    return rounded(s.createDataFrame([(name, k, float(v)) for k, v in enumerate(x)], "method string, k int, value double"), 4)


def quadratic(s, d):
    """The least squares of two rows of sums by both second-order methods."""
    r = _t(s, d, "nation").agg(F.count("*"), F.sum("n_regionkey"), F.sum(F.col("n_regionkey") ** 2), F.sum("n_nationkey"), F.sum(F.col("n_nationkey") * F.col("n_regionkey"))).first()
    a, b = np.array([[r[0], r[1]], [r[1], r[2]]], float) / r[0], np.array([r[3], r[4]], float) / r[0]
    f, g, h = (lambda x: x @ a @ x / 2 - b @ x), (lambda x: a @ x - b), (lambda x, v: a @ v)
    return solution(s, "newton_cg", X.newton_cg(f, g, np.zeros(2), h)).unionByName(solution(s, "trust_region", X.trust_region(f, g, np.zeros(2), h)))


def path_values(s, d):
    """The largest eigenvalues of the Laplacian of the path through all nations, by products alone."""
    n = _t(s, d, "nation").count()
    degree = np.full(n, 2.0)
    degree[[0, -1]] = 1
    product = lambda v: degree * v - np.r_[v[1:], 0] - np.r_[0, v[:-1]]
    return rounded(s.createDataFrame([(k, float(v)) for k, v in enumerate(X.lanczos(product, n, 4)[0])], "k int, value double"), 6)


def spline(s, d):
    """A natural spline through three points, read at the keys."""
    f = X.CubicSpline([0, 10, 24], [0, 5, 1])
    return rounded(s.createDataFrame([(r[0], float(f(r[0]))) for r in _t(s, d, "nation").select("n_nationkey").collect()], "k int, value double"), 6)


#: With the second derivative m at the inner knot from 2 (h0 + h1) m = 6 (s1 - s0); both ends have none.
SPLINE = """WITH k AS (SELECT n_nationkey AS k FROM nation), m AS (SELECT 6 * ((1 - 5) / 14 - (5 - 0) / 10) / (2 * 24) AS m)
SELECT k, round(CASE WHEN k < 10 THEN m * k ** 3 / 60 + (5 / 10 - m * 10 / 6) * k ELSE m * (24 - k) ** 3 / (6 * 14) + (5 / 14 - m * 14 / 6) * (24 - k) + 1 / 14 * (k - 10) END, 6) AS value FROM k, m"""

QUERIES = {
    "gamma_functions": (at(("beta", lambda x: X.beta(x, 1.5)), ("lbeta", lambda x: X.lbeta(x, 2.5)), ("digamma", lambda x: X.digamma(round(5 * x))), ("gamma", X.gamma)), sql(beta="exp(lgamma(x) + lgamma(1.5) - lgamma(x + 1.5))", lbeta="lgamma(x) + lgamma(2.5) - lgamma(x + 2.5)", digamma="-0.5772156649015329 + coalesce((SELECT sum(1 / i) FROM (SELECT unnest(range(1, k + 1)) AS i)), 0)", gamma="gamma(x)")),
    "error_function": (at(("erf", X.erf), ("erfc", X.erfc)), sql(erf=simpson("exp(- v * v)") + " * 2 / sqrt(pi())", erfc="1 - " + simpson("exp(- v * v)") + " * 2 / sqrt(pi())")),
    "normal_distribution": (at(("pdf", G.pdf), ("cdf", G.cdf), ("sf", X.norm_sf), ("back", lambda x: G.ppf(G.cdf(x / 2)))), sql(pdf="exp(-x * x / 2) / sqrt(2 * pi())", cdf="0.5 + " + NORMAL, sf="0.5 - " + NORMAL, back="x / 2")),
    "chi_squared_distribution": (at(("pdf", X.chi_squared(4).pdf), ("cdf", X.chi_squared(2).cdf), ("sf", lambda x: X.chi2_sf(x, 4)), ("ppf", lambda x: X.chi_squared(2).ppf(x / 6))), sql(pdf="x / 4 * exp(-x / 2)", cdf="1 - exp(-x / 2)", sf="exp(-x / 2) * (1 + x / 2)", ppf="-2 * ln(1 - x / 6)")),
    "gamma_distribution": (at(("pdf", X.gamma_distribution(2.5, 1.5).pdf), ("cdf", X.gamma_distribution(3, 1).cdf)), sql(pdf="exp(2.5 * ln(1.5) + 1.5 * ln(x) - 1.5 * x - lgamma(2.5))", cdf="1 - exp(-x) * (1 + x + x * x / 2)")),
    "f_distribution": (at(("sf", lambda x: X.f_sf(x, 2, 7)), ("cdf", X.f_distribution(2, 7).cdf), ("pdf", X.f_distribution(2, 7).pdf)), sql(sf="(1 + 2 * x / 7) ** -3.5", cdf="1 - (1 + 2 * x / 7) ** -3.5", pdf="(1 + 2 * x / 7) ** -4.5")),
    "students_t_distribution": (at(("two_tailed", lambda x: X.t_test_two_tailed(x, 2)), ("cdf", X.students_t(1).cdf), ("pdf", X.students_t(3).pdf)), sql(two_tailed="1 - x / sqrt(2 + x * x)", cdf="0.5 + atan(x) / pi()", pdf="2 / (pi() * sqrt(3) * (1 + x * x / 3) ** 2)")),
    "beta_distribution": (at(("pdf", lambda x: X.beta_distribution(2, 3).pdf(x / 6)), ("cdf", lambda x: X.beta_distribution(2, 3).cdf(x / 6))), sql(pdf="12 * (x / 6) * (1 - x / 6) ** 2", cdf="6 * (x / 6) ** 2 - 8 * (x / 6) ** 3 + 3 * (x / 6) ** 4")),
    "dirichlet_distribution": (at(("log_pdf", lambda x: (D := X.Dirichlet((2.0, 0.5, x))).log_pdf((0.2, 0.3, 0.5))), ("mean", lambda x: X.Dirichlet((2.0, 0.5, x)).mean[2])), sql(log_pdf="lgamma(2.5 + x) - lgamma(2) - lgamma(0.5) - lgamma(x) + ln(0.2) - 0.5 * ln(0.3) + (x - 1) * ln(0.5)", mean="x / (2.5 + x)")),
    "quadrature": (at(("quad", lambda x: X.quad(np.cos, 0, x)), ("gauss_legendre", lambda x: X.gauss_legendre(np.exp, 0, x)), ("composite", lambda x: X.gauss_legendre(lambda v: 1 / (1 + v), 0, x, 5, 8))), sql(quad="sin(x)", gauss_legendre="exp(x) - 1", composite="ln(1 + x)")),
    "minimize_bounded": (at(("place", lambda x: round(X.minimize_bounded(lambda v: (v - x) ** 2 + 1, -1, 9)[0], 5)), ("least", lambda x: X.minimize_bounded(lambda v: (v - x) ** 2 + 1, -1, 9)[1])), sql(place="x", least="1.0::DOUBLE")),
    "newton_methods": (quadratic, "WITH m AS (SELECT regr_intercept(n_nationkey, n_regionkey) AS i, regr_slope(n_nationkey, n_regionkey) AS w FROM nation) " + " UNION ALL ".join(f"SELECT '{m}' AS method, {k} AS k, round({e}, 4) AS value FROM m" for m in ("newton_cg", "trust_region") for k, e in enumerate("iw"))),
    "lanczos": (path_values, "WITH n AS (SELECT count(*) AS n FROM nation) SELECT k, round(2 - 2 * cos(pi() * (n - 1 - k) / n), 6) AS value FROM n, (SELECT unnest(range(4))::INT AS k)"),
    "cubic_spline": (spline, SPLINE),
}
