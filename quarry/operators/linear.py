"""Linear models from one pass of sufficient statistics.

``gram`` sums all products of the columns once, in partial sums by the tasks; every solver then works on a small matrix on the driver, so
that fitting paths, folds and penalties doesn't read the data again. Models are plain coefficients; ``predict`` is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many columns products are summed by expressions; beyond, by numpy on Arrow batches.
EXPRESSIONS = 12


@dataclass
class Gram:
    """Products (with a column of ones first) of the features and targets: n, sums and cross products."""

    features: list[str]
    targets: list[str]
    m: np.ndarray

    @property
    def n(self) -> float:
        return self.m[0, 0]

    def mean(self) -> np.ndarray:
        return self.m[0, 1:] / self.n

    def centered(self) -> np.ndarray:
        """Cross products of deviations from the means."""
        return self.m[1:, 1:] - np.outer(self.m[0, 1:], self.m[0, 1:]) / self.n

    def parts(self, intercept: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """X'X and X'Y (of deviations, if there is an intercept), and the means."""
        d = len(self.features)
        c = self.centered() if intercept else self.m[1:, 1:]
        mean = self.mean() if intercept else np.zeros(len(self.m) - 1)
        return c[:d, :d], c[:d, d:], mean[:d], mean[d:]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for b in batches:
        key = b.column(0).to_pylist() if b.num_rows else []
        x = np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]]])
        for k in set(key):
            rows = x[[v == k for v in key]] if len(set(key)) > 1 else x
            total[k] = total.get(k, 0) + rows.T @ rows
    if total:
        yield pa.record_batch([pa.array([str(k) for k in total], pa.string()), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], names=["g", "m"])


def grams(df: DataFrame, features: list[str], targets: list[str], by: str | None = None) -> dict:
    """The Gram matrix of each value of ``by`` (few values: folds or classes), as {value: Gram}; rows with a null are left out."""
    cols = features + targets
    g = F.col(by).cast("string") if by else F.lit("")
    x = df.select(g.alias("g"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).where(reduce(lambda a, b: a & b, [F.col(f"x{i}").isNotNull() for i in range(len(cols))], F.lit(True)))
    d = len(cols)
    if d <= EXPRESSIONS:
        v = [F.lit(1.0), *[F.col(f"x{i}") for i in range(d)]]
        at = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        rows = x.groupBy("g").agg(*[F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i, j in at]).collect()
        out = {}
        for r in rows:
            m = np.zeros((d + 1, d + 1))
            for i, j in at:
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
            out[r["g"]] = Gram(features, targets, m)
        return out
    part = x.mapInArrow(_partial, "g string, m array<double>").select("g", F.posexplode("m").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v"))
    out = {}
    for r in part.collect():  # (d + 1) ** 2 rows for each value
        out.setdefault(r["g"], np.zeros((d + 1) ** 2))[r["i"]] = r["v"]
    return {k: Gram(features, targets, m.reshape(d + 1, d + 1)) for k, m in out.items()}


def gram(df: DataFrame, features: list[str], targets: list[str]) -> Gram:
    found = grams(df, features, targets)
    if not found:
        raise ValueError("no complete rows")
    return found[""]


def dot(features: list[str], coef: np.ndarray, intercept: float) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(features, coef, strict=True)], F.lit(float(intercept)))


@dataclass
class LinearModel:
    features: list[str]
    coef: np.ndarray
    intercept: float
    link: str = "identity"
    info: dict = field(default_factory=dict)

    def predict(self) -> Column:
        z = dot(self.features, self.coef, self.intercept)
        return F.exp(z) if self.link == "log" else z

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.predict())

    def table(self, df: DataFrame) -> DataFrame:
        """(term, value) of the intercept and coefficients."""
        return df.sparkSession.createDataFrame([("intercept", float(self.intercept)), *[(c, float(w)) for c, w in zip(self.features, self.coef, strict=True)]], "term string, value double")


def _model(g: Gram, w: np.ndarray, intercept: bool, k: int = 0, **info) -> LinearModel:
    _, _, mx, my = g.parts(intercept)
    return LinearModel(g.features, w, float(my[k] - mx @ w), info=info)


def ols(g: Gram, intercept: bool = True) -> LinearModel:
    """Normal equations by Cholesky, least squares where they are singular."""
    a, b, _, _ = g.parts(intercept)
    try:
        low = np.linalg.cholesky(a)
        w = np.linalg.solve(low.T, np.linalg.solve(low, b[:, 0]))
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(a, b[:, 0], rcond=None)[0]
    return _model(g, w, intercept)


def ridge(g: Gram, alpha: float = 1.0, intercept: bool = True, target: int = 0) -> LinearModel:
    """(X'X + alpha I) w = X'y on deviations; the intercept has no penalty."""
    a, b, _, _ = g.parts(intercept)
    return _model(g, np.linalg.solve(a + alpha * np.eye(len(a)), b[:, target]), intercept, target, alpha=alpha)


def elastic_net(g: Gram, alpha: float = 1.0, l1_ratio: float = 0.5, intercept: bool = True, max_iter: int = 1000, tol: float = 1e-4) -> LinearModel:
    """RSS / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) / 2 |w|^2) by cyclic coordinate descent on the products."""
    a, b, _, _ = g.parts(intercept)
    a, b = a / g.n, b[:, 0] / g.n
    w = np.zeros(len(b))
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(max_iter):
        shift = 0.0
        for j in range(len(w)):
            if a[j, j] + l2 == 0:
                continue
            r = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - l1, 0) / (a[j, j] + l2)
            shift, w[j] = max(shift, abs(new - w[j])), new
        if shift < tol:
            break
    return _model(g, w, intercept, alpha=alpha, l1_ratio=l1_ratio)


def lasso(g: Gram, alpha: float = 1.0, **options) -> LinearModel:
    return elastic_net(g, alpha, 1.0, **options)


def alpha_grid(g: Gram, n_alphas: int = 100, l1_ratio: float = 1.0, eps: float = 1e-3) -> list[float]:
    _, b, _, _ = g.parts()
    top = float(np.abs(b[:, 0]).max() / g.n / l1_ratio)
    return list(np.logspace(np.log10(top), np.log10(top * eps), n_alphas))


def _mse(g: Gram, m: LinearModel) -> float:
    v = np.concatenate([[-m.intercept], -m.coef, [1.0]])
    return float(v @ g.m @ v / g.n)


def cross_validated(df: DataFrame, features: list[str], y: str, fold: str, candidates: list[dict], solve) -> tuple[LinearModel, list[float]]:
    """The candidate of the lowest mean error over folds, fitted to all rows, and the errors of all. One pass over the data, whatever the number of candidates."""
    parts = grams(df, features, [y], by=fold)
    whole = Gram(features, [y], sum(p.m for p in parts.values()))
    errors = [float(np.mean([_mse(p, solve(Gram(features, [y], whole.m - p.m), **c)) for p in parts.values()])) for c in candidates]
    return solve(whole, **candidates[int(np.argmin(errors))]), errors


def ridge_cv(df, features, y, fold, alphas=(0.1, 1.0, 10.0)):
    return cross_validated(df, features, y, fold, [{"alpha": a} for a in alphas], ridge)


def lasso_cv(df, features, y, fold, alphas=None, n_alphas=100):
    alphas = alphas or alpha_grid(gram(df, features, [y]), n_alphas)
    return cross_validated(df, features, y, fold, [{"alpha": a} for a in alphas], lasso)


def elastic_net_cv(df, features, y, fold, l1_ratios=(0.1, 0.5, 0.9), n_alphas=20):
    g = gram(df, features, [y])
    return cross_validated(df, features, y, fold, [{"alpha": a, "l1_ratio": r} for r in l1_ratios for a in alpha_grid(g, n_alphas, r)], elastic_net)


def bayesian_ridge(g: Gram, max_iter: int = 300, tol: float = 1e-3, alpha: float = 1.0, lam: float = 1.0) -> LinearModel:
    """Evidence maximisation of the precisions of noise (alpha) and weights (lam)."""
    a, b, _, _ = g.parts()
    yy = g.centered()[-1, -1]
    values, vectors = np.linalg.eigh(a)
    w = np.zeros(len(b))
    for _ in range(max_iter):
        new = vectors @ ((vectors.T @ b[:, 0]) / (values + lam / alpha))
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        rss = float(yy - 2 * new @ b[:, 0] + new @ a @ new)
        lam, alpha = gamma / max(float(new @ new), 1e-300), (g.n - gamma) / max(rss, 1e-300)
        done = np.abs(new - w).sum() < tol
        w = new
        if done:
            break
    return _model(g, w, True, alpha=alpha, lam=lam)


def ard(g: Gram, max_iter: int = 300, tol: float = 1e-3, prune: float = 1e4, prior: float = 1e-6) -> LinearModel:
    """A precision for each weight; features whose precision passes ``prune`` are dropped."""
    a, b, _, _ = g.parts()
    yy, d = g.centered()[-1, -1], len(b)
    lam, alpha, w = np.ones(d), g.n / max(yy, 1e-300), np.zeros(d)
    keep = np.arange(d)
    for _ in range(max_iter):
        s = np.linalg.inv(np.diag(lam[keep]) + alpha * a[np.ix_(keep, keep)])
        new = np.zeros(d)
        new[keep] = alpha * s @ b[keep, 0]
        gamma = 1 - lam[keep] * np.diag(s)
        lam[keep] = (gamma + 2 * prior) / (new[keep] ** 2 + 2 * prior)
        rss = float(yy - 2 * new @ b[:, 0] + new @ a @ new)
        alpha = (g.n - gamma.sum() + 2 * prior) / (rss + 2 * prior)
        keep = keep[lam[keep] < prune]
        new[np.setdiff1d(np.arange(d), keep)] = 0
        done = np.abs(new - w).sum() < tol
        w = new
        if done or not len(keep):
            break
    return _model(g, w, True, alpha=alpha, lam=lam)


def omp(g: Gram, n_nonzero: int | None = None, tol: float | None = None) -> LinearModel:
    """Greedy support, least squares on it."""
    a, b, _, _ = g.parts()
    d, yy = len(b), g.centered()[-1, -1]
    support, w = [], np.zeros(d)
    for _ in range(n_nonzero or max(1, d // 10)):
        r = b[:, 0] - a @ w
        r[support] = 0
        j = int(np.argmax(np.abs(r) / np.sqrt(np.maximum(np.diag(a), 1e-300))))
        if abs(r[j]) < 1e-12:
            break
        support.append(j)
        w = np.zeros(d)
        w[support] = np.linalg.solve(a[np.ix_(support, support)], b[support, 0])
        if tol is not None and yy - 2 * w @ b[:, 0] + w @ a @ w <= tol:
            break
    return _model(g, w, True, support=support)


def lars(g: Gram, n_nonzero: int | None = None, drop: bool = False, alpha: float = 0.0) -> LinearModel:
    """Least-angle path on standardised products; ``drop`` removes a coefficient that reaches 0 (the lasso path), down to ``alpha``."""
    a, b, _, _ = g.parts()
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300)) if not drop else np.full(len(b), np.sqrt(g.n))
    k, c0 = a / np.outer(scale, scale), b[:, 0] / scale
    d = len(c0)
    w, active = np.zeros(d), []
    limit = alpha * np.sqrt(g.n) if drop else 0.0
    for _ in range(8 * d):
        c = c0 - k @ w
        top = np.abs(c).max()
        if top <= limit + 1e-12 or (not drop and len(active) >= (n_nonzero or d)):
            break
        out = [j for j in range(d) if j not in active]
        active += [j for j in out if abs(c[j]) >= top - 1e-9 * max(1, top)][:1] if not active or out else []
        s = np.sign(c[active])
        u = np.linalg.solve(k[np.ix_(active, active)], s)
        move = k[:, active] @ u
        step = top - limit
        for j in range(d):
            if j not in active:
                for z in ((top - c[j]) / (1 - move[j]) if move[j] != 1 else np.inf, (top + c[j]) / (1 + move[j]) if move[j] != -1 else np.inf):
                    if 1e-12 < z < step:
                        step = z
        gone = None
        if drop:
            for q, j in enumerate(active):
                z = -w[j] / u[q] if u[q] else np.inf
                if 1e-12 < z < step:
                    step, gone = z, j
        w[active] += step * u
        if gone is not None:
            w[gone] = 0
            active.remove(gone)
    return _model(g, w / scale, True)


def lasso_lars(g: Gram, alpha: float = 1.0) -> LinearModel:
    return lars(g, drop=True, alpha=alpha)


# --- iteratively reweighted: each round is one aggregate over the data ---------


def _weighted(df: DataFrame, features: list[str], y: Column, weight: Column, intercept: bool = False) -> np.ndarray:
    v = [*([F.lit(1.0)] if intercept else []), *[F.col(c).cast("double") for c in features], y]
    at = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    r = df.agg(*[F.sum(weight * v[i] * v[j]) for i, j in at]).first()
    m = np.zeros((len(v), len(v)))
    for (i, j), x in zip(at, r, strict=True):
        m[i, j] = m[j, i] = x
    return m


def huber(df: DataFrame, features: list[str], y: str, epsilon: float = 1.35, alpha: float = 1e-4, max_iter: int = 100, tol: float = 1e-5) -> LinearModel:
    """Weights min(1, epsilon / |r|) on raw residuals of centred data, ridge alpha."""
    if epsilon <= 1:
        raise ValueError("epsilon must be larger than 1")
    g = gram(df, features, [y])
    mean, d = g.mean(), len(features)
    x = df.select(*[(F.col(c) - float(m)).alias(c) for c, m in zip([*features, y], mean, strict=True)])
    w = ridge(g, alpha).coef
    for _ in range(max_iter):
        r = F.abs(F.col(y) - dot(features, w, 0.0))
        m = _weighted(x, features, F.col(y), F.when(r <= epsilon, 1.0).otherwise(epsilon / r))
        new = np.linalg.solve(m[:d, :d] + alpha * np.eye(d), m[:d, d])
        done = np.abs(new - w).max() < tol
        w = new
        if done:
            break
    return _model(g, w, True)


def quantile_regression(df: DataFrame, features: list[str], y: str, quantile: float = 0.5, alpha: float = 1.0, max_iter: int = 50, tol: float = 1e-5) -> LinearModel:
    """Weights q / |r| above and (1 - q) / |r| below on centred data; the L1 penalty as a ridge of n alpha / |w|."""
    g = gram(df, features, [y])
    mean, d = g.mean(), len(features)
    x = df.select(*[(F.col(c) - float(m)).alias(c) for c, m in zip([*features, y], mean, strict=True)])
    w = ols(g).coef
    for _ in range(max_iter):
        r = F.col(y) - dot(features, w, 0.0)
        m = _weighted(x, features, F.col(y), F.when(r >= 0, quantile).otherwise(1 - quantile) / F.greatest(F.abs(r), F.lit(1e-6)))
        new = np.linalg.solve(m[:d, :d] + np.diag(alpha * g.n / np.maximum(np.abs(w), 1e-6)) * (alpha > 0), m[:d, d])
        done = np.abs(new - w).max() < tol
        w = new
        if done:
            break
    return _model(g, w, True)


def glm(df: DataFrame, features: list[str], y: str, family: str = "poisson", alpha: float = 1.0, power: float = 1.5, max_iter: int = 100, tol: float = 1e-4) -> LinearModel:
    """Log-link model by reweighting, from mu = y at first; the ridge term also holds for the intercept and isn't divided by n."""
    var = {"poisson": 1.0, "gamma": 2.0, "tweedie": power}[family]
    t = F.greatest(F.col(y).cast("double"), F.lit(1e-10))
    w = None
    for _ in range(max_iter):
        eta = F.log(t) if w is None else F.greatest(F.lit(-20.0), F.least(F.lit(20.0), dot(features, w[1:], w[0])))
        mu = F.exp(eta)
        m = _weighted(df, features, eta + (t - mu) / mu, F.pow(mu, F.lit(2 - var)), True)
        k = len(features) + 1
        new = np.linalg.solve(m[:k, :k] + alpha * np.eye(k), m[:k, k])
        done = w is not None and np.abs(new - w).max() < tol
        w = new
        if done:
            break
    return LinearModel(features, w[1:], float(w[0]), "log")


def logistic(df: DataFrame, features: list[str], y: str, c: float = 1.0, intercept: bool = True, max_iter: int = 50, tol: float = 1e-8) -> LinearModel:
    """Mean log-loss + |w|^2 / (2 c) of a 0/1 target by Newton steps, each one aggregate; the intercept has no penalty."""
    d = len(features) + intercept
    w = np.zeros(d)
    penalty = np.eye(d) / c
    if intercept:
        penalty[0, 0] = 0
    v = [*([F.lit(1.0)] if intercept else []), *[F.col(x).cast("double") for x in features]]
    for _ in range(max_iter):
        z = reduce(lambda a, b: a + b, [x * float(k) for x, k in zip(v, w, strict=True)])
        p = 1 / (1 + F.exp(-z))
        at = [(i, j) for i in range(d) for j in range(i, d)]
        r = df.agg(F.count("*"), *[F.sum((p - F.col(y)) * x) for x in v], *[F.sum(p * (1 - p) * v[i] * v[j]) for i, j in at]).first()
        grad = np.array(r[1 : d + 1]) / r[0] + penalty @ w
        h = np.zeros((d, d))
        for (i, j), x in zip(at, r[d + 1 :], strict=True):
            h[i, j] = h[j, i] = x / r[0]
        step = np.linalg.solve(h + penalty + 1e-12 * np.eye(d), grad)
        w = w - step
        if np.abs(step).max() < tol:
            break
    return LinearModel(features, w[1:] if intercept else w, float(w[0]) if intercept else 0.0)


def logistic_cv(df: DataFrame, features: list[str], y: str, fold: str, cs=(0.01, 0.1, 1.0, 10.0)) -> tuple[LinearModel, list[float]]:
    """The ``c`` of the best mean accuracy over folds (the smallest of equals), fitted to all rows, and the accuracies of all; all models of a fold are judged in one pass."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    total = np.zeros(len(cs))
    for f in folds:
        models = [logistic(df.where(F.col(fold) != f), features, y, c) for c in cs]
        total += np.array(df.where(F.col(fold) == f).agg(*[F.avg(((m.predict() > 0).cast("int") == F.col(y).cast("int")).cast("double")) for m in models]).first(), float)
    return logistic(df, features, y, cs[int(np.argmax(total))]), [float(v) for v in total / len(folds)]


def probability(m: LinearModel) -> Column:
    return 1 / (1 + F.exp(-m.predict()))


@dataclass
class OneVsRest:
    classes: list
    models: list[LinearModel]

    def predict(self) -> Column:
        """The class of the largest score, the first of equals."""
        s = F.array(*[m.predict() for m in self.models])
        return F.element_at(F.array(*map(F.lit, self.classes)), F.array_position(s, F.array_max(s)).cast("int"))


def one_vs_rest(df: DataFrame, y: str, fit) -> OneVsRest:
    """``fit(df, target column)`` for each class against all others."""
    classes = sorted(r[0] for r in df.select(y).distinct().collect())
    return OneVsRest(classes, [fit(df.withColumn("_is", (F.col(y) == k).cast("double")), "_is") for k in classes])


def ridge_classifier(df: DataFrame, features: list[str], y: str, alpha: float = 1.0) -> OneVsRest:
    """Ridge on one column of 1 and -1 for each class, all from a single Gram matrix."""
    classes = sorted(r[0] for r in df.select(y).distinct().collect())
    names = [f"_t{k}" for k in range(len(classes))]
    g = gram(df.withColumns({n: F.when(F.col(y) == c, 1.0).otherwise(-1.0) for n, c in zip(names, classes, strict=True)}), features, names)
    return OneVsRest(classes, [ridge(g, alpha, target=k) for k in range(len(classes))])


def linear_svc(df: DataFrame, features: list[str], y: str, c: float = 1.0, max_iter: int = 100, tol: float = 1e-6) -> LinearModel:
    """|w|^2 / 2 + c times the mean squared hinge of a 0/1 target, by Newton steps on the rows within the margin."""
    d = len(features) + 1
    w, v, t = np.zeros(d), [F.lit(1.0), *[F.col(x).cast("double") for x in features]], 2 * F.col(y) - 1
    penalty = np.eye(d)
    penalty[0, 0] = 0
    for _ in range(max_iter):
        z = reduce(lambda a, b: a + b, [x * float(k) for x, k in zip(v, w, strict=True)])
        inside = F.when(1 - t * z > 0, 1.0).otherwise(0.0)
        at = [(i, j) for i in range(d) for j in range(i, d)]
        r = df.agg(F.count("*"), *[F.sum(inside * t * x) for x in v], *[F.sum(inside * v[i] * v[j]) for i, j in at]).first()
        h = np.zeros((d, d))
        for (i, j), x in zip(at, r[d + 1 :], strict=True):
            h[i, j] = h[j, i] = 2 * c * x / r[0]
        new = np.linalg.solve(h + penalty + 1e-10 * np.eye(d), 2 * c * np.array(r[1 : d + 1]) / r[0])
        done = np.abs(new - w).max() < tol
        w = new
        if done:
            break
    return LinearModel(features, w[1:], float(w[0]))


def linear_svr(df: DataFrame, features: list[str], y: str, c: float = 1.0, epsilon: float = 0.1, max_iter: int = 100, tol: float = 1e-6) -> LinearModel:
    """|w|^2 / 2 + c times the mean squared epsilon-insensitive loss."""
    d = len(features) + 1
    w, v = np.zeros(d), [F.lit(1.0), *[F.col(x).cast("double") for x in features]]
    penalty = np.eye(d)
    penalty[0, 0] = 0
    for _ in range(max_iter):
        r_ = F.col(y) - reduce(lambda a, b: a + b, [x * float(k) for x, k in zip(v, w, strict=True)])
        on = F.when(F.abs(r_) > epsilon, 1.0).otherwise(0.0)
        aim = F.col(y) - F.signum(r_) * epsilon
        at = [(i, j) for i in range(d) for j in range(i, d)]
        r = df.agg(F.count("*"), *[F.sum(on * aim * x) for x in v], *[F.sum(on * v[i] * v[j]) for i, j in at]).first()
        h = np.zeros((d, d))
        for (i, j), x in zip(at, r[d + 1 :], strict=True):
            h[i, j] = h[j, i] = 2 * c * x / r[0]
        new = np.linalg.solve(h + penalty + 1e-10 * np.eye(d), 2 * c * np.array(r[1 : d + 1]) / r[0])
        done = np.abs(new - w).max() < tol
        w = new
        if done:
            break
    return LinearModel(features, w[1:], float(w[0]))


def isotonic(df: DataFrame, x: str, y: str, increasing: bool = True):
    """Pool-adjacent-violators by Spark's own distributed implementation; predictions interpolate."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=x, labelCol=y, isotonic=increasing).fit(df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)))


# --- discriminants ------------------------------------------------------------


@dataclass
class Discriminant:
    classes: list
    features: list[str]
    #: For each class: constant, linear and quadratic terms of its score.
    terms: list[tuple[float, np.ndarray, np.ndarray]]

    def scores(self) -> list[Column]:
        d = range(len(self.features))
        x = [F.col(c) for c in self.features]
        return [reduce(lambda a, b: a + b, [x[i] * float(w[i]) for i in d] + [x[i] * x[j] * float(q[i, j]) for i in d for j in d if q[i, j]], F.lit(float(c))) for c, w, q in self.terms]

    def predict(self) -> Column:
        s = F.array(*self.scores())
        return F.element_at(F.array(*map(F.lit, self.classes)), F.array_position(s, F.array_max(s)).cast("int"))


def qda(df: DataFrame, features: list[str], y: str, reg: float = 0.0) -> Discriminant:
    """Mean, covariance (n - 1) and prior of each class."""
    parts = grams(df, features, [], by=y)
    total = sum(g.n for g in parts.values())
    terms = []
    for k in sorted(parts):
        g = parts[k]
        if g.n < 2:
            raise ValueError("a class has fewer than two rows")
        s = (1 - reg) * g.centered() / (g.n - 1) + reg * np.eye(len(features))
        p, m = np.linalg.inv(s), g.mean()
        terms.append((-0.5 * np.linalg.slogdet(s)[1] - 0.5 * m @ p @ m + np.log(g.n / total), p @ m, -0.5 * p))
    return Discriminant(sorted(parts), features, terms)


def lda(df: DataFrame, features: list[str], y: str) -> Discriminant:
    """One pooled covariance (n - classes)."""
    parts = grams(df, features, [], by=y)
    total = sum(g.n for g in parts.values())
    p = np.linalg.inv(sum(g.centered() for g in parts.values()) / (total - len(parts)))
    return Discriminant(sorted(parts), features, [(-0.5 * g.mean() @ p @ g.mean() + np.log(g.n / total), p @ g.mean(), np.zeros_like(p)) for _, g in sorted(parts.items())])


# --- covariance and components ------------------------------------------------


def covariance(g: Gram, centered: bool = False) -> np.ndarray:
    """Maximum likelihood (divided by n)."""
    return (g.m[1:, 1:] if centered else g.centered()) / g.n


def shrunk_covariance(s: np.ndarray, shrinkage: float = 0.1) -> np.ndarray:
    return (1 - shrinkage) * s + shrinkage * np.trace(s) / len(s) * np.eye(len(s))


def oas(g: Gram) -> tuple[np.ndarray, float]:
    s = covariance(g)
    p, n = len(s), g.n
    mu, alpha = np.trace(s) / p, np.mean(s * s)
    num, den = alpha + mu * mu, (n + 1) * (alpha - mu * mu / p)
    k = 1.0 if den == 0 else min(num / den, 1.0)
    return (1 - k) * s + k * mu * np.eye(p), k


def ledoit_wolf(df: DataFrame, features: list[str]) -> tuple[np.ndarray, float]:
    """A second pass sums |x|^4 of the centred rows."""
    g = gram(df, features, [])
    s, mean, n, p = covariance(g), g.mean(), g.n, len(features)
    q = reduce(lambda a, b: a + b, [(F.col(c) - float(m)) ** 2 for c, m in zip(features, mean, strict=True)])
    fourth = df.agg(F.sum(q * q)).first()[0]
    mu = np.trace(s) / p
    delta = np.sum((s - mu * np.eye(p)) ** 2) / p
    beta = (fourth / n - np.sum(s * s)) / (n * p)
    k = 0.0 if delta == 0 else float(np.clip(beta / delta, 0, 1))
    return (1 - k) * s + k * mu * np.eye(p), k


def graphical_lasso(s: np.ndarray, alpha: float, max_iter: int = 100, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Covariance and sparse precision by block coordinate descent."""
    p = len(s)
    w = s + alpha * np.eye(p) if p == 1 else s.copy()
    w[np.diag_indices(p)] = np.diag(s) + alpha
    betas = np.zeros((p, p))
    for _ in range(max_iter):
        before = w.copy()
        for j in range(p):
            o = np.arange(p) != j
            v, b = w[np.ix_(o, o)], betas[j][o]
            for _ in range(100):
                old = b.copy()
                for k in range(p - 1):
                    r = s[o, j][k] - v[k] @ b + v[k, k] * b[k]
                    b[k] = np.sign(r) * max(abs(r) - alpha, 0) / v[k, k]
                if np.abs(b - old).max(initial=0) < tol:
                    break
            betas[j][o] = b
            w[o, j] = w[j, o] = v @ b
        if np.abs(w - before).mean() < tol:
            break
    return w, np.linalg.inv(w)


def graphical_lasso_cv(df: DataFrame, features: list[str], fold: str, alphas: list[float], **options) -> tuple[float, list[float], np.ndarray, np.ndarray]:
    """(alpha, mean score of each alpha, covariance, precision): of ``alphas`` the first with the highest mean log-likelihood of the folds left out. All rows are read once, as sums for each fold."""
    parts = grams(df, features, [], by=fold)
    whole = Gram(features, [], sum(g.m for g in parts.values()))
    rest = {k: Gram(features, [], whole.m - g.m) for k, g in parts.items()}
    scores = [float(np.mean([log_likelihood(covariance(g), graphical_lasso(covariance(rest[k]), a, **options)[1]) for k, g in parts.items()])) for a in alphas]
    best = alphas[int(np.argmax(scores))]
    return best, scores, *graphical_lasso(covariance(whole), best, **options)


def log_likelihood(s: np.ndarray, precision: np.ndarray) -> float:
    return float(-np.sum(s * precision) + np.linalg.slogdet(precision)[1] - len(s) * np.log(2 * np.pi)) / 2


def mahalanobis(features: list[str], mean: np.ndarray, precision: np.ndarray) -> Column:
    """Squared distance as an expression."""
    x = [F.col(c) - float(m) for c, m in zip(features, mean, strict=True)]
    return reduce(lambda a, b: a + b, [x[i] * x[j] * float(precision[i, j]) for i in range(len(x)) for j in range(len(x))])


@dataclass
class Projection:
    features: list[str]
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        return df.withColumns({f"{prefix}{k}": reduce(lambda a, b: a + b, [(F.col(c) - float(m)) * float(w) for c, m, w in zip(self.features, self.mean, v, strict=True)]) for k, v in enumerate(self.components)})

    def inverse_transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        return df.withColumns({c: reduce(lambda a, b: a + b, [F.col(f"{prefix}{k}") * float(v[i]) for k, v in enumerate(self.components)], F.lit(float(self.mean[i]))) for i, c in enumerate(self.features)})


def pca(g: Gram, k: int, center: bool = True) -> Projection:
    """Eigenvectors of the covariance (n - 1); without centring, of X'X (a truncated singular value decomposition)."""
    c = g.centered() if center else g.m[1:, 1:]
    values, vectors = np.linalg.eigh(c / (g.n - 1))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    # the largest entry of each component is positive, so that results can be compared
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return Projection(g.features, g.mean() if center else np.zeros(len(g.features)), vectors[:k], values[:k], values[:k] / max(values.sum(), 1e-300))


@dataclass
class IncrementalPCA:
    """Components of all batches seen: the state is the sum of their products, so any order and size of batches gives the components of all rows at once.
    ``update`` is for foreachBatch."""

    features: list[str]
    k: int
    state: Gram | None = None

    def update(self, batch: DataFrame, _epoch: int = 0) -> None:
        for g in grams(batch, self.features, []).values():  # none for an empty batch
            self.state = g if self.state is None else Gram(self.features, [], self.state.m + g.m)

    def model(self) -> Projection:
        if self.state is None:
            raise ValueError("no rows yet")
        return pca(self.state, self.k)


def whitened(p: Projection) -> Projection:
    """Components scaled so that the projected columns have variance 1."""
    return Projection(p.features, p.mean, p.components / np.sqrt(np.maximum(p.variance, 1e-300))[:, None], p.variance, p.ratio)


def truncated_svd(g: Gram, k: int) -> Projection:
    return pca(g, k, False)


def factor_analysis(g: Gram, k: int, max_iter: int = 1000, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (k, d) and noise variances by EM on the covariance."""
    s = covariance(g)
    psi = np.diag(s).copy()
    values, vectors = np.linalg.eigh(s)
    w = (vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-12))).copy()
    for _ in range(max_iter):
        m = np.linalg.inv(np.eye(k) + w.T @ (w / psi[:, None]))
        beta = m @ (w / psi[:, None]).T
        e = m + beta @ s @ beta.T
        new = s @ beta.T @ np.linalg.inv(e)
        psi = np.maximum(np.diag(s - new @ beta @ s), 1e-12)
        done = np.abs(new - w).max() < tol
        w = new
        if done:
            break
    return w.T, psi


def pls_svd(g: Gram, k: int, scale: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both sides from the singular vectors of the (scaled) cross products."""
    d, c = len(g.features), g.centered()
    s = np.sqrt(np.diag(c) / (g.n - 1)) if scale else np.ones(len(c))
    s[s == 0] = 1
    u, _, vt = np.linalg.svd(c[:d, d:] / np.outer(s[:d], s[d:]))
    return u[:, :k], vt[:k].T


@dataclass
class Pairing:
    """Scores of two sets of columns: ``x`` and ``y`` turn deviations (scaled by ``scale``) into them."""

    features: list[str]
    targets: list[str]
    mean: np.ndarray
    scale: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with u0, u1, ... of the features and v0, v1, ... of the targets."""
        c, d = self.features + self.targets, len(self.features)
        z = [(F.col(n) - float(m)) / float(s) for n, m, s in zip(c, self.mean, self.scale, strict=True)]
        side = lambda name, part, w: {f"{name}{k}": reduce(lambda a, b: a + b, [e * float(v) for e, v in zip(part, w[:, k], strict=True)]) for k in range(w.shape[1])}
        return df.withColumns(side("u", z[:d], self.x) | side("v", z[d:], self.y))


def pairing(g: Gram, k: int, mode: str = "canonical", scale: bool = True) -> Pairing:
    """Canonical partial least squares (directions of the largest covariance), or ``cca`` (of the largest correlation): after each component both sides lose what their own score explains.
    Works on products alone; the largest entry of each direction of the features is positive."""
    d, c = len(g.features), g.centered()
    s = np.sqrt(np.diag(c) / (g.n - 1)) if scale else np.ones(len(c))
    s[s == 0] = 1
    c = c / np.outer(s, s)
    xx, xy, yy = c[:d, :d], c[:d, d:], c[d:, d:]
    ws, cs, ps, qs = [], [], [], []
    for _ in range(k):
        if mode == "cca":
            lx, ly = (_root_inverse(z) for z in (xx, yy))
            u, size, v = np.linalg.svd(lx @ xy @ ly)
            w, v = lx @ u[:, 0], ly @ v[0]
        else:
            u, size, v = np.linalg.svd(xy)
            w, v = u[:, 0], v[0]
        if size[0] < 1e-12 or not np.linalg.norm(w) or not np.linalg.norm(v):
            break
        turn = np.sign(w[np.abs(w).argmax()])
        w, v = turn * w / np.linalg.norm(w), turn * v / np.linalg.norm(v)
        tt, uu, tu = w @ xx @ w, v @ yy @ v, w @ xy @ v
        p, q = xx @ w / tt, yy @ v / uu
        for out, one in ((ws, w), (cs, v), (ps, p), (qs, q)):
            out.append(one)
        xy = xy - np.outer(p, xy.T @ w) - np.outer(xy @ v, q) + tu * np.outer(p, q)
        xx, yy = xx - tt * np.outer(p, p), yy - uu * np.outer(q, q)
    if not ws:
        raise ValueError("features and targets share nothing")
    w, c, p, q = (np.array(v).T for v in (ws, cs, ps, qs))
    return Pairing(g.features, g.targets, g.mean(), s, w @ np.linalg.pinv(p.T @ w), c @ np.linalg.pinv(q.T @ c))


def _root_inverse(m: np.ndarray) -> np.ndarray:
    """The inverse of the root of a symmetric matrix within its own range."""
    values, vectors = np.linalg.eigh(m)
    some = values > 1e-10 * max(values.max(), 1e-300)
    return vectors[:, some] / np.sqrt(values[some]) @ vectors[:, some].T


def pls(g: Gram, k: int, mode: str = "regression", scale: bool = True) -> np.ndarray:
    """Coefficients (features, targets) of partial least squares on products alone. Modes: regression and canonical; ``cca`` whitens both sides first."""
    d, c = len(g.features), g.centered()
    s = np.sqrt(np.diag(c) / (g.n - 1)) if scale else np.ones(len(c))
    s[s == 0] = 1
    c = c / np.outer(s, s)
    xx, xy, yy = c[:d, :d].copy(), c[:d, d:].copy(), c[d:, d:].copy()
    ws, ps, qs = [], [], []
    for _ in range(k):
        if mode == "cca":
            lx, ly = (np.linalg.inv(np.linalg.cholesky(z + 1e-10 * np.trace(z) / len(z) * np.eye(len(z)))) for z in (xx, yy))
            u, _, _ = np.linalg.svd(lx @ xy @ ly.T)
            w = lx.T @ u[:, 0]
            w /= np.linalg.norm(w)
        else:
            w = np.linalg.svd(xy)[0][:, 0]
        t2 = float(w @ xx @ w)
        if t2 < 1e-12:
            break
        p, q = xx @ w / t2, xy.T @ w / t2
        ws.append(w)
        ps.append(p)
        qs.append(q)
        xy = xy - t2 * np.outer(p, q)
        xx = xx - t2 * np.outer(p, p)
        if mode != "regression":
            yy = yy - t2 * np.outer(q, q)
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs).T
    return w @ np.linalg.pinv(p.T @ w) @ q.T * np.outer(1 / s[:d], s[d:])
