"""Models in the dual: support-vector machines and Gaussian processes with exact kernels.

Their training is quadratic in rows, so it takes at most ``most`` rows (checked by a limit before any is brought to the driver) and refuses more;
kernel_models has the versions on landmarks and random features for data of any size. Prediction runs on Arrow batches wherever the rows are,
against the support vectors or training rows, whose number has the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.operators.kernel_models import KERNELS

MOST = 4000


def bounded(df: DataFrame, columns: list[str], most: int = MOST) -> list:
    """All rows of ``df``, or an error where there are more than ``most``; rows with a null are left out."""
    rows = df.select(*columns).dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"at most {most} rows; use the versions on landmarks or random features")
    return rows


def scored(df: DataFrame, features: list[str], names: dict[str, T.DataType], f: Callable[[np.ndarray], list]) -> DataFrame:
    """``df`` with columns ``names``, which ``f`` makes of each batch's matrix; a null feature counts as NaN."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in features])
            yield pa.record_batch([*b.columns, *map(pa.array, f(x))], names=[*b.schema.names, *names])

    return df.mapInArrow(go, T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in names.items()]]))


# --- support-vector machines --------------------------------------------------


def dual(q: np.ndarray, p: np.ndarray, s: np.ndarray, a: np.ndarray, upper: float, tol: float = 1e-3, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """(a, offset) that minimises a'Qa/2 + p'a with s'a as it is and 0 <= a <= upper, moving the pair that violates the conditions most."""
    a = a.astype(float).copy()
    g, edge = q @ a + p, 1e-12 * upper
    for _ in range(rounds):
        v = -s * g
        rise = np.where(s > 0, a < upper - edge, a > edge)
        fall = np.where(s > 0, a > edge, a < upper - edge)
        i, j = int(np.argmax(np.where(rise, v, -np.inf))), int(np.argmin(np.where(fall, v, np.inf)))
        gap = v[i] - v[j]
        if not rise[i] or not fall[j] or gap < tol:
            break
        step = gap / max(q[i, i] + q[j, j] - 2 * s[i] * s[j] * q[i, j], 1e-12)
        step = min(step, upper - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else upper - a[j])
        a[i], a[j] = a[i] + s[i] * step, a[j] - s[j] * step
        g = g + step * (s[i] * q[:, i] - s[j] * q[:, j])
    v, free = -s * g, (a > edge) & (a < upper - edge)
    if free.any():
        return a, float(v[free].mean())
    rise, fall = np.where(s > 0, a < upper - edge, a > edge), np.where(s > 0, a > edge, a < upper - edge)
    ends = [v[rise].max()] if rise.any() else []
    return a, float(np.mean([*ends, *([v[fall].min()] if fall.any() else [])]))


@dataclass
class Machine:
    """f(x) = sum of weights times kernels, plus the offset."""

    features: list[str]
    points: np.ndarray
    weights: np.ndarray
    offset: float
    kernel: str
    gamma: float
    degree: int
    coef0: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.full(len(x), self.offset)
        return KERNELS[self.kernel](x, self.points, self.gamma, self.degree, self.coef0) @ self.weights + self.offset

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return scored(df, self.features, {name: T.DoubleType()}, lambda x: [self.decision(x)])


def _machine(features: list[str], x: np.ndarray, w: np.ndarray, offset: float, call: tuple) -> Machine:
    keep = np.abs(w) > 1e-10
    return Machine(features, x[keep], w[keep], offset, *call)


@dataclass
class Votes:
    """A machine for each pair of classes; the class with most votes, the first of equals."""

    classes: list
    pairs: list[tuple[int, int]]
    machines: list[Machine]
    features: list[str]

    def decide(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(x), len(self.classes)), int)
        for (i, j), m in zip(self.pairs, self.machines, strict=True):
            f = m.decision(x)
            votes[:, i] += f > 0
            votes[:, j] += f <= 0
        return votes.argmax(1)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        kind = T.StringType() if isinstance(self.classes[0], str) else T.LongType()
        return scored(df, self.features, {name: kind}, lambda x: [[self.classes[k] for k in self.decide(x)]])


def svc(df: DataFrame, features: list[str], y: str, c: float = 1.0, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0, tol: float = 1e-3, most: int = MOST) -> Votes:
    """C-support classification, one machine for each pair of classes."""
    rows = bounded(df, [*features, y], most)
    classes = sorted({r[-1] for r in rows})
    x, lab = np.array([list(map(float, r[:-1])) for r in rows]), np.array([classes.index(r[-1]) for r in rows])
    call, pairs, machines = (kernel, gamma, degree, coef0), [], []
    for i in range(len(classes)):
        for j in range(i + 1, len(classes)):
            z, s = x[(lab == i) | (lab == j)], np.where(lab[(lab == i) | (lab == j)] == i, 1.0, -1.0)
            k = KERNELS[kernel](z, z, gamma, degree, coef0)
            a, b = dual(k * s[:, None] * s, -np.ones(len(z)), s, np.zeros(len(z)), c, tol)
            pairs.append((i, j))
            machines.append(_machine(features, z, a * s, b, call))
    return Votes(classes, pairs, machines, features)


def nu_svc(df: DataFrame, features: list[str], y: str, nu: float = 0.5, most: int = MOST, **kernel) -> Votes:
    """C-support classification with c = 1 / (nu n)."""
    if not 0 < nu <= 1:
        raise ValueError("nu must be above 0 and at most 1")
    return svc(df, features, y, 1 / (nu * max(len(bounded(df, [*features, y], most)), 1)), most=most, **kernel)


def svr(df: DataFrame, features: list[str], y: str, c: float = 1.0, epsilon: float = 0.1, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0, tol: float = 1e-3, most: int = MOST) -> Machine:
    """Regression that ignores errors within ``epsilon``."""
    r = np.array([list(map(float, r)) for r in bounded(df, [*features, y], most)]).reshape(-1, len(features) + 1)
    x, t, n = r[:, :-1], r[:, -1], len(r)
    k = KERNELS[kernel](x, x, gamma, degree, coef0)
    s = np.repeat([1.0, -1.0], n)
    a, b = dual(np.block([[k, -k], [-k, k]]), np.concatenate([epsilon - t, epsilon + t]), s, np.zeros(2 * n), c, tol)
    return _machine(features, x, a[:n] - a[n:], b, (kernel, gamma, degree, coef0))


def nu_svr(df: DataFrame, features: list[str], y: str, nu: float = 0.5, most: int = MOST, **kernel) -> Machine:
    """Support-vector regression with epsilon = 0 and c = 1 / (nu n)."""
    if not 0 < nu <= 1:
        raise ValueError("nu must be above 0 and at most 1")
    return svr(df, features, y, 1 / (nu * max(len(bounded(df, [*features, y], most)), 1)), 0.0, most=most, **kernel)


def one_class_svm(df: DataFrame, features: list[str], nu: float = 0.5, kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0, tol: float = 1e-4, most: int = MOST) -> Machine:
    """A machine that is negative for outliers: at most the share ``nu`` of the training rows lies outside."""
    x = np.array([list(map(float, r)) for r in bounded(df, features, most)])
    n, c = len(x), 1 / (nu * len(x))
    k, a = KERNELS[kernel](x, x, gamma, degree, coef0), np.zeros(n)
    full = int(nu * n)
    a[:full] = c
    if full < n:
        a[full] = 1 - full * c
    a, b = dual(k, np.zeros(n), np.ones(n), a, c, tol / n)
    return _machine(features, x, a, b, (kernel, gamma, degree, coef0))


# --- Gaussian processes -------------------------------------------------------


def _sq(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


@dataclass
class Covariance:
    """A covariance function: ``f(x, y, same)``, where same tells that both are the same rows. Sums and products are covariance functions again."""

    f: Callable[[np.ndarray, np.ndarray, bool], np.ndarray]

    def __call__(self, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        return self.f(x, x if y is None else y, y is None)

    def diagonal(self, x: np.ndarray) -> np.ndarray:
        return np.array([float(self(r[None])[0, 0]) for r in x])

    def __add__(self, o: Covariance) -> Covariance:
        return Covariance(lambda x, y, same: self.f(x, y, same) + o.f(x, y, same))

    def __mul__(self, o: Covariance) -> Covariance:
        return Covariance(lambda x, y, same: self.f(x, y, same) * o.f(x, y, same))


def rbf(length: float = 1.0) -> Covariance:
    return Covariance(lambda x, y, same: np.exp(-_sq(x, y) / (2 * length**2)))


def matern(length: float = 1.0, nu: float = 1.5) -> Covariance:
    """``nu`` of 1/2, 3/2 or 5/2."""
    if nu not in (0.5, 1.5, 2.5):
        raise ValueError("nu must be 0.5, 1.5 or 2.5")

    def f(x, y, same):
        r = np.sqrt(2 * nu * _sq(x, y)) / length
        return np.exp(-r) * {0.5: 1, 1.5: 1 + r, 2.5: 1 + r + r * r / 3}[nu]

    return Covariance(f)


def constant(value: float = 1.0) -> Covariance:
    return Covariance(lambda x, y, same: np.full((len(x), len(y)), value))


def white(noise: float = 1.0) -> Covariance:
    return Covariance(lambda x, y, same: noise * np.eye(len(x)) if same else np.zeros((len(x), len(y))))


def dot_product(sigma: float = 1.0) -> Covariance:
    return Covariance(lambda x, y, same: sigma**2 + x @ y.T)


@dataclass
class Process:
    features: list[str]
    x: np.ndarray
    kernel: Covariance
    root: np.ndarray
    alpha: np.ndarray
    mean: float
    scale: float
    log_likelihood: float

    def transform(self, df: DataFrame, name: str = "prediction", deviation: str | None = None) -> DataFrame:
        def f(x: np.ndarray) -> list:
            k = self.kernel(x, self.x)
            out = [k @ self.alpha * self.scale + self.mean]
            if deviation:
                v = np.linalg.solve(self.root, k.T)
                out.append(np.sqrt(np.maximum(self.kernel.diagonal(x) - (v * v).sum(0), 0)) * self.scale)
            return out

        return scored(df, self.features, dict.fromkeys([name, *([deviation] if deviation else [])], T.DoubleType()), f)

    def samples(self, x: np.ndarray, n: int = 1, seed: int = 0) -> np.ndarray:
        """Draws of the function at the rows of ``x``."""
        k = self.kernel(x, self.x)
        v = np.linalg.solve(self.root, k.T)
        s = self.kernel(x) - v.T @ v
        return np.random.default_rng(seed).multivariate_normal(k @ self.alpha * self.scale + self.mean, s * self.scale**2, n, method="eigh").T


def gp_regressor(df: DataFrame, features: list[str], y: str, kernel: Covariance | None = None, alpha: float = 1e-10, normalize: bool = False, most: int = MOST) -> Process:
    """Exact Gaussian process regression by a Cholesky root of the kernel matrix plus ``alpha``."""
    kernel = kernel or rbf()
    r = np.array([list(map(float, r)) for r in bounded(df, [*features, y], most)])
    x, t = r[:, :-1], r[:, -1]
    mean, scale = (t.mean(), t.std() or 1.0) if normalize else (0.0, 1.0)
    z = (t - mean) / scale
    root = np.linalg.cholesky(kernel(x) + alpha * np.eye(len(x)))
    a = np.linalg.solve(root.T, np.linalg.solve(root, z))
    return Process(features, x, kernel, root, a, float(mean), float(scale), float(-z @ a / 2 - np.log(np.diag(root)).sum() - len(x) / 2 * math.log(2 * math.pi)))


@dataclass
class ProcessClassifier:
    """A latent function for each class against the rest (one for two classes)."""

    features: list[str]
    classes: list
    x: np.ndarray
    kernel: Covariance
    gradients: list[np.ndarray]
    roots: list[np.ndarray]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        k, own, p = self.kernel(x, self.x), self.kernel.diagonal(x), []
        for g, root, w in zip(self.gradients, self.roots, self.weights, strict=True):
            v = np.linalg.solve(root, w[:, None] * k.T)
            var = np.maximum(own - (v * v).sum(0), 0)
            p.append(1 / (1 + np.exp(-(k @ g) / np.sqrt(1 + math.pi * var / 8))))
        if len(p) == 1:
            return np.column_stack([1 - p[0], p[0]])
        q = np.column_stack(p)
        return q / q.sum(1, keepdims=True)

    def transform(self, df: DataFrame, name: str = "prediction", probability: str = "probability") -> DataFrame:
        kind = T.StringType() if isinstance(self.classes[0], str) else T.LongType()

        def f(x: np.ndarray) -> list:
            p = self.probabilities(x)
            return [[self.classes[k] for k in p.argmax(1)], p.max(1)]

        return scored(df, self.features, {name: kind, probability: T.DoubleType()}, f)


def gp_classifier(df: DataFrame, features: list[str], y: str, kernel: Covariance | None = None, rounds: int = 100, tol: float = 1e-6, most: int = MOST) -> ProcessClassifier:
    """Laplace's approximation: Newton steps to the mode of the latent function under the logistic likelihood."""
    kernel = kernel or rbf()
    rows = bounded(df, [*features, y], most)
    classes = sorted({r[-1] for r in rows})
    x = np.array([list(map(float, r[:-1])) for r in rows])
    k, n = kernel(x), len(rows)
    out = ProcessClassifier(features, classes, x, kernel, [], [], [])
    for c in classes[1:] if len(classes) == 2 else classes:
        t, f = np.array([float(r[-1] == c) for r in rows]), np.zeros(n)
        last = -np.inf
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            w = np.sqrt(np.maximum(p * (1 - p), 1e-12))
            root = np.linalg.cholesky(np.eye(n) + w[:, None] * k * w)
            b = w * w * f + t - p
            a = b - w * np.linalg.solve(root.T, np.linalg.solve(root, w * (k @ b)))
            f = k @ a
            now = -a @ f / 2 - np.logaddexp(0, np.where(t > 0, -f, f)).sum()
            if abs(now - last) < tol:
                break
            last = now
        p = 1 / (1 + np.exp(-f))
        w = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        out.gradients.append(t - p)
        out.roots.append(np.linalg.cholesky(np.eye(n) + w[:, None] * k * w))
        out.weights.append(w)
    return out
