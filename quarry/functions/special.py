"""Special functions, distributions, quadrature, minimisation and splines in plain Python, for p-values and small solves on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

gamma, lgamma, erf, erfc = math.gamma, math.lgamma, math.erf, math.erfc


def lbeta(a: float, b: float) -> float:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def beta(a: float, b: float) -> float:
    return math.exp(lbeta(a, b))


def digamma(x: float) -> float:
    """By recurrence up to 10, then the asymptotic series."""
    if x <= 0 and x == math.floor(x):
        return math.nan
    if x < 0:
        return digamma(1 - x) - math.pi / math.tan(math.pi * x)
    s = 0.0
    while x < 10:
        s -= 1 / x
        x += 1
    y = 1 / (x * x)
    return s + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def inc_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - inc_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - lbeta(a, b)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def inc_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - scale * h


@dataclass(frozen=True)
class Distribution:
    pdf: Callable[[float], float]
    cdf: Callable[[float], float]
    mean: float
    var: float
    low: float = -math.inf
    high: float = math.inf

    def sf(self, x: float) -> float:
        return 1 - self.cdf(x)

    def ppf(self, p: float) -> float:
        """By bisection of the distribution function."""
        if not 0 < p < 1:
            return self.low if p <= 0 else self.high
        a, b = (max(self.low, -1.0), 1.0) if self.low > -math.inf else (-1.0, 1.0)
        while self.cdf(a) > p:
            a *= 2
        while self.cdf(b) < p and b < self.high:
            b = min(self.high, b * 2 if b > 0 else 1.0)
        for _ in range(200):
            m = (a + b) / 2
            a, b = (m, b) if self.cdf(m) < p else (a, m)
        return (a + b) / 2


def normal(mu: float = 0.0, sigma: float = 1.0) -> Distribution:
    return Distribution(lambda x: math.exp(-(((x - mu) / sigma) ** 2) / 2) / (sigma * math.sqrt(2 * math.pi)), lambda x: erfc(-(x - mu) / (sigma * math.sqrt(2))) / 2, mu, sigma**2)


def gamma_distribution(shape: float, rate: float = 1.0) -> Distribution:
    return Distribution(lambda x: math.exp(shape * math.log(rate) + (shape - 1) * math.log(x) - rate * x - lgamma(shape)) if x > 0 else 0.0, lambda x: inc_gamma(shape, rate * x), shape / rate, shape / rate**2, 0.0)


def chi_squared(df: float) -> Distribution:
    return gamma_distribution(df / 2, 0.5)


def beta_distribution(a: float, b: float) -> Distribution:
    return Distribution(lambda x: math.exp((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) - lbeta(a, b)) if 0 < x < 1 else 0.0, lambda x: inc_beta(x, a, b), a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1)), 0.0, 1.0)


def f_distribution(d1: float, d2: float) -> Distribution:
    pdf = lambda x: math.exp(d1 / 2 * math.log(d1) + d2 / 2 * math.log(d2) + (d1 / 2 - 1) * math.log(x) - (d1 + d2) / 2 * math.log(d2 + d1 * x) - lbeta(d1 / 2, d2 / 2)) if x > 0 else 0.0
    mean = d2 / (d2 - 2) if d2 > 2 else math.nan
    var = 2 * d2 * d2 * (d1 + d2 - 2) / (d1 * (d2 - 2) ** 2 * (d2 - 4)) if d2 > 4 else math.nan
    return Distribution(pdf, lambda x: inc_beta(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0, mean, var, 0.0)


def students_t(df: float) -> Distribution:
    def cdf(x: float) -> float:
        tail = inc_beta(df / (df + x * x), df / 2, 0.5) / 2
        return 1 - tail if x > 0 else tail

    return Distribution(lambda x: math.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2), cdf, 0.0 if df > 1 else math.nan, df / (df - 2) if df > 2 else math.inf)


@dataclass(frozen=True)
class Dirichlet:
    """Shares that add up to 1, with concentrations ``alpha``."""

    alpha: tuple[float, ...]

    def __post_init__(self):
        if len(self.alpha) < 2 or min(self.alpha) <= 0:
            raise ValueError("two or more positive concentrations")

    @property
    def mean(self) -> tuple[float, ...]:
        return tuple(a / sum(self.alpha) for a in self.alpha)

    def log_pdf(self, x) -> float:
        if len(x) != len(self.alpha) or min(x) <= 0 or abs(sum(x) - 1) > 1e-6:
            raise ValueError("shares must be positive, as many as concentrations, and add up to 1")
        return lgamma(sum(self.alpha)) + sum((a - 1) * math.log(v) - lgamma(a) for a, v in zip(self.alpha, x, strict=True))

    def pdf(self, x) -> float:
        return math.exp(self.log_pdf(x))

    def sample(self, rng: np.random.Generator, n: int = 1) -> np.ndarray:
        g = rng.gamma(self.alpha, size=(n, len(self.alpha)))
        return g / g.sum(1, keepdims=True)


def chi2_sf(x: float, df: float) -> float:
    return 1 - inc_gamma(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return inc_beta(d2 / (d2 + d1 * x), d2 / 2, d1 / 2) if x > 0 else 1.0


def norm_sf(z: float) -> float:
    return erfc(z / math.sqrt(2)) / 2


def t_test_two_tailed(t: float, df: float) -> float:
    return inc_beta(df / (df + t * t), df / 2, 0.5)


def quad(f: Callable[[float], float], a: float, b: float, tol: float = 1e-10, depth: int = 50) -> float:
    """Adaptive Simpson."""

    def go(a, b, fa, fm, fb, whole, tol, depth):
        m = (a + b) / 2
        f1, f2 = f((a + m) / 2), f((m + b) / 2)
        left, right = (m - a) / 6 * (fa + 4 * f1 + fm), (b - m) / 6 * (fm + 4 * f2 + fb)
        if depth <= 0 or abs(left + right - whole) <= 15 * tol:
            return left + right + (left + right - whole) / 15
        return go(a, m, fa, f1, fm, left, tol / 2, depth - 1) + go(m, b, fm, f2, fb, right, tol / 2, depth - 1)

    fa, fm, fb = f(a), f((a + b) / 2), f(b)
    return go(a, b, fa, fm, fb, (b - a) / 6 * (fa + 4 * fm + fb), tol, depth)


def gauss_legendre(f: Callable[[float], float], a: float, b: float, n: int = 10, panels: int = 1) -> float:
    x, w = np.polynomial.legendre.leggauss(n)
    h = (b - a) / panels
    return float(sum(h / 2 * wi * f(a + h * (p + 0.5) + h / 2 * xi) for p in range(panels) for xi, wi in zip(x, w, strict=True)))


def minimize_bounded(f: Callable[[float], float], a: float, b: float, tol: float = 1e-8, max_iter: int = 500) -> tuple[float, float]:
    """(x, f(x)) by golden section with a parabola step where it helps."""
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(max_iter):
        if abs(b - a) < tol:
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return x, f(x)


def newton_cg(f, grad, x0: np.ndarray, hess_vec=None, max_iter: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Truncated Newton with a backtracking line search; without ``hess_vec`` products come from differences of gradients."""
    x = np.array(x0, float)
    for _ in range(max_iter):
        g = grad(x)
        if np.linalg.norm(g) < tol:
            break
        hv = hess_vec or (lambda x, v: (grad(x + 1e-6 * v) - grad(x - 1e-6 * v)) / 2e-6)
        p, r = np.zeros_like(x), -g
        d = r.copy()
        for _ in range(2 * len(x) + 10):
            h = hv(x, d)
            curve = d @ h
            if curve <= 0:
                p = p if p.any() else -g
                break
            a = r @ r / curve
            p = p + a * d
            new = r - a * h
            if np.linalg.norm(new) < min(0.5, np.sqrt(np.linalg.norm(g))) * np.linalg.norm(g):
                break
            d, r = new + (new @ new) / (r @ r) * d, new
        t, f0 = 1.0, f(x)
        while f(x + t * p) > f0 + 1e-4 * t * (g @ p) and t > 1e-12:
            t /= 2
        x = x + t * p
    return x


def trust_region(f, grad, x0: np.ndarray, hess_vec=None, radius: float = 1.0, largest: float = 100.0, max_iter: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Conjugate gradients within a region that grows where the quadratic model foretells well and shrinks where it doesn't; steps end at its edge on negative curvature."""
    x = np.array(x0, float)
    hv = hess_vec or (lambda x, v: (grad(x + 1e-6 * v) - grad(x - 1e-6 * v)) / 2e-6)

    def edge(p, d):
        a, b, c = d @ d, 2 * p @ d, p @ p - radius**2
        return p + (-b + math.sqrt(max(b * b - 4 * a * c, 0))) / (2 * a) * d

    for _ in range(max_iter):
        g = grad(x)
        size = np.linalg.norm(g)
        if size < tol:
            break
        p, r = np.zeros_like(x), g.copy()
        d = -r
        for _ in range(2 * len(x) + 10):
            h = hv(x, d)
            curve = d @ h
            a = r @ r / curve if curve > 0 else 0.0
            if curve <= 0 or np.linalg.norm(p + a * d) >= radius:
                p = edge(p, d)
                break
            p, new = p + a * d, r + a * h
            if np.linalg.norm(new) < min(0.5, math.sqrt(size)) * size:
                break
            d, r = -new + (new @ new) / (r @ r) * d, new
        hope = -(g @ p + p @ hv(x, p) / 2)
        rho = (f(x) - f(x + p)) / hope if hope > 0 else 0.0
        if rho < 0.25:
            radius /= 4
        elif rho > 0.75 and np.linalg.norm(p) > 0.99 * radius:
            radius = min(2 * radius, largest)
        if rho > 1e-4:
            x = x + p
        elif radius < 1e-14:
            break
    return x


def lanczos(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, which: str = "largest", steps: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``k`` largest or smallest eigenvalues of a symmetric operator given by its ``product`` with a vector (which may be a pass over a distributed
    matrix), by Lanczos steps with full reorthogonalisation."""
    steps = min(n, steps or max(2 * k + 20, 40))
    q = np.zeros((n, steps))
    rng, alpha, beta = np.random.default_rng(seed), [], []
    v = rng.normal(size=n)
    v /= np.linalg.norm(v)
    for j in range(steps):
        q[:, j] = v
        w = np.asarray(product(v), float)
        alpha.append(v @ w)
        for _ in range(2):
            w = w - q[:, : j + 1] @ (q[:, : j + 1].T @ w)
        b = np.linalg.norm(w)
        if b < 1e-10 and j + 1 < steps:  # an invariant space: goes on with a new direction
            w, b = rng.normal(size=n), 0.0
            for _ in range(2):
                w = w - q[:, : j + 1] @ (q[:, : j + 1].T @ w)
        beta.append(b)
        v = w / max(np.linalg.norm(w), 1e-300)
    t = np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1)
    values, y = np.linalg.eigh(t)
    pick = np.argsort(-values if which == "largest" else values)[:k]
    return values[pick], q @ y[:, pick]


class CubicSpline:
    """Interpolating cubic through increasing knots, with natural or not-a-knot ends."""

    def __init__(self, x, y, ends: str = "natural"):
        x, y = np.asarray(x, float), np.asarray(y, float)
        n = len(x)
        if n < 2 or (np.diff(x) <= 0).any():
            raise ValueError("knots must increase, and be two at least")
        h, s = np.diff(x), np.diff(y) / np.diff(x)
        a, b = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * (s[i] - s[i - 1])
        if ends == "natural" or n < 4:
            a[0, 0] = a[-1, -1] = 1
        else:
            a[0, :3] = h[1], -(h[0] + h[1]), h[0]
            a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
        self.x, self.y, self.h, self.m = x, y, h, np.linalg.solve(a, b)

    def __call__(self, at):
        at = np.asarray(at, float)
        i = np.clip(np.searchsorted(self.x, at, side="right") - 1, 0, len(self.h) - 1)
        h, l, r = self.h[i], at - self.x[i], self.x[i + 1] - at
        m, n = self.m[i], self.m[i + 1]
        return m * r**3 / (6 * h) + n * l**3 / (6 * h) + (self.y[i] / h - m * h / 6) * r + (self.y[i + 1] / h - n * h / 6) * l
