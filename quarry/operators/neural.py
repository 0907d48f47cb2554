"""Networks, sparse factors and summaries trained where the rows are.

A round is one pass: every task makes one vector of statistics from its rows (gradient sums, trained weights, code products), vectors are added up in two steps,
and the driver receives at most MERGERS of them, whose length depends on the model alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.cluster import agglomerate
from quarry.operators.dual import scored

MERGERS = 64


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, without rows that lack one."""
    return df.select(*[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(columns)]).dropna()


def summed(x: DataFrame, f: Callable[[Iterator[np.ndarray]], np.ndarray], width: int) -> np.ndarray:
    """The sum over tasks of ``f`` (a vector of ``width`` from the task's matrices of rows)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = f(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % MERGERS]), pa.array([out.astype(float).tobytes()], pa.binary())], names=["g", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(width), False
        for b in batches:
            for v in b.column(1):
                total, any_ = total + np.frombuffer(v.as_py()), True
        if any_:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = x.mapInArrow(make, "g long, s binary").repartition("g").mapInArrow(add, "s binary").collect()  # at most MERGERS rows
    return np.sum([np.frombuffer(bytes(r[0])) for r in parts], axis=0) if parts else np.zeros(width)


# --- networks -----------------------------------------------------------------

ACTIVATIONS = {"relu": lambda z: np.maximum(z, 0), "tanh": np.tanh, "logistic": lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), "identity": lambda z: z}
SLOPES = {"relu": lambda h: (h > 0).astype(float), "tanh": lambda h: 1 - h * h, "logistic": lambda h: h * (1 - h), "identity": np.ones_like}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Network:
    features: list[str]
    sizes: list[int]
    weights: np.ndarray
    activation: str
    classes: list | None
    losses: list[float]
    mean: np.ndarray
    scale: np.ndarray

    def layers(self, w: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        w, out, at = self.weights if w is None else w, [], 0
        for a, b in pairwise(self.sizes):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray, w: np.ndarray | None = None) -> list[np.ndarray]:
        out, layers = [(x - self.mean) / self.scale], self.layers(w)
        for k, (a, b) in enumerate(layers):
            z = out[-1] @ a + b
            out.append(ACTIVATIONS[self.activation](z) if k < len(layers) - 1 else softmax(z) if self.classes else z)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
        """(gradient, loss), both means over the rows; ``y`` holds class numbers or targets."""
        h, layers, n = self.forward(x, w), self.layers(w), len(x)
        if self.classes:
            p = h[-1][range(n), y.astype(int)]
            loss = -np.log(np.maximum(p, 1e-300)).mean()
            e = h[-1].copy()
            e[range(n), y.astype(int)] -= 1
        else:
            e = h[-1] - y[:, None]
            loss = (e * e).mean() / 2
        back, parts = e / n, []
        for k in range(len(layers) - 1, -1, -1):
            parts.append(np.concatenate([(h[k].T @ back + alpha / n * layers[k][0]).ravel(), back.sum(0)]))
            if k:
                back = back @ layers[k][0].T * SLOPES[self.activation](h[k])
        return np.concatenate(parts[::-1]), float(loss)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if not self.classes:
            return scored(df, self.features, {name: T.DoubleType()}, lambda x: [self.forward(x)[-1][:, 0]])
        kind = T.StringType() if isinstance(self.classes[0], str) else T.LongType()
        return scored(df, self.features, {name: kind}, lambda x: [[self.classes[k] for k in self.forward(x)[-1].argmax(1)]])


def _train(df: DataFrame, m: Network, y: str, solver: str, rate: float, rounds: int, batch: int, alpha: float, tol: float, patience: int, validation: float, seed: int) -> Network:
    """Each round every task goes over its rows once in mini-batches from the common weights; weights and the solver's state are averaged by numbers of rows.
    With ``validation`` that share of the rows (by a hash of their values) measures the loss instead of training."""
    cols = [*m.features, y]
    x = numbers(df, cols)
    if validation:
        held = F.pmod(F.xxhash64(F.lit(seed), *x.columns), F.lit(1000)) < round(validation * 1000)
        x, judge = x.where(~held), x.where(held)
    size = len(m.weights)
    state, best, since = np.concatenate([m.weights, np.zeros(2 * size + 1)]), (np.inf, m.weights), 0
    for r in range(rounds):

        def go(parts: Iterator[np.ndarray], state=state, r=r) -> np.ndarray:
            w, a, v, t = state[:size].copy(), state[size : 2 * size].copy(), state[2 * size : 3 * size].copy(), state[-1]
            rng = np.random.default_rng([seed, r, TaskContext.get().partitionId()])
            n, loss = 0, 0.0
            for p in parts:
                p = p[rng.permutation(len(p))]
                for s in range(0, len(p), batch):
                    z = p[s : s + batch]
                    g, q = m.gradient(z[:, :-1], z[:, -1], w, alpha)
                    t += 1
                    if solver == "adam":
                        a, v = 0.9 * a + 0.1 * g, 0.999 * v + 0.001 * g * g
                        w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                    else:
                        a = 0.9 * a - rate * g
                        w += a
                    n, loss = n + len(z), loss + q * len(z)
            return np.concatenate([n * np.concatenate([w, a, v, [t]]), [loss, n]])

        got = summed(x, go, 3 * size + 3)
        if not got[-1]:
            break
        state, loss = got[:-2] / got[-1], got[-2] / got[-1]
        if validation:

            def check(parts: Iterator[np.ndarray], w=state[:size]) -> np.ndarray:
                t = np.zeros(2)
                for p in parts:
                    t += [m.gradient(p[:, :-1], p[:, -1], w, 0.0)[1] * len(p), len(p)]
                return t

            q = summed(judge, check, 2)
            loss = q[0] / max(q[1], 1)
        m.losses.append(float(loss))
        since = 0 if loss < best[0] - tol else since + 1
        if loss < best[0]:
            best = (loss, state[:size])
        if since >= patience:
            break
    m.weights = best[1] if validation else state[:size]
    return m


def _network(df: DataFrame, features: list[str], hidden: list[int], outputs: int, activation: str, classes: list | None, seed: int) -> Network:
    """Weights uniform within the square root of 6 / (inputs + outputs); features are scaled by their moments within the network."""
    rng, sizes = np.random.default_rng(seed), [len(features), *hidden, outputs]
    w = np.concatenate([np.append(rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in pairwise(sizes)])
    s = df.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    d = len(features)
    return Network(features, sizes, w, activation, classes, [], np.array([v or 0.0 for v in s[:d]], float), np.array([v or 1.0 for v in s[d:]], float))


def mlp_classifier(
    df: DataFrame, features: list[str], y: str, hidden: tuple[int, ...] = (100,), activation: str = "relu", solver: str = "adam", rate: float = 1e-3, rounds: int = 200, batch: int = 200, alpha: float = 1e-4, tol: float = 1e-4,
    patience: int = 10, validation: float = 0.0, seed: int = 0,
) -> Network:
    """Any number of hidden layers, softmax output."""
    classes = sorted(r[0] for r in df.select(y).distinct().dropna().collect())
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(y)) - 1
    m = _network(df, features, list(hidden), len(classes), activation, classes, seed)
    return _train(df.where(F.col(y).isNotNull()).withColumn("_class", number), m, "_class", solver, rate, rounds, batch, alpha, tol, patience, validation, seed)


def mlp_regressor(
    df: DataFrame, features: list[str], y: str, hidden: tuple[int, ...] = (100,), activation: str = "relu", solver: str = "adam", rate: float = 1e-3, rounds: int = 200, batch: int = 200, alpha: float = 1e-4, tol: float = 1e-4,
    patience: int = 10, validation: float = 0.0, seed: int = 0,
) -> Network:
    """Any number of hidden layers, half the squared error."""
    m = _network(df, features, list(hidden), 1, activation, None, seed)
    return _train(df, m, y, solver, rate, rounds, batch, alpha, tol, patience, validation, seed)


@dataclass
class Boltzmann:
    features: list[str]
    w: np.ndarray
    hidden: np.ndarray
    visible: np.ndarray

    def up(self, v: np.ndarray) -> np.ndarray:
        return ACTIVATIONS["logistic"](v @ self.w + self.hidden)

    def down(self, h: np.ndarray) -> np.ndarray:
        return ACTIVATIONS["logistic"](h @ self.w.T + self.visible)

    def gibbs(self, v: np.ndarray, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        h = self.up(v)
        p = self.down((rng.random(h.shape) < h).astype(float))
        return (rng.random(p.shape) < p).astype(float)

    def transform(self, df: DataFrame, prefix: str = "h") -> DataFrame:
        return scored(df, self.features, {f"{prefix}{j}": T.DoubleType() for j in range(self.w.shape[1])}, lambda x: list(self.up(x).T))


def bernoulli_rbm(df: DataFrame, features: list[str], k: int, rate: float = 0.1, rounds: int = 10, batch: int = 10, seed: int = 0) -> Boltzmann:
    """One-step contrastive divergence on features within 0 and 1; tasks train from common weights, which are averaged by numbers of rows after each round."""
    d, x = len(features), numbers(df, features)
    state = np.concatenate([np.random.default_rng(seed).normal(0, 0.01, d * k), np.zeros(k + d)])
    cuts = [d * k, d * k + k]
    for r in range(rounds):

        def go(parts: Iterator[np.ndarray], state=state, r=r) -> np.ndarray:
            w, b, c = (v.copy() for v in np.split(state, cuts))
            m = Boltzmann(features, w.reshape(d, k), b, c)
            rng, n = np.random.default_rng([seed, r, TaskContext.get().partitionId()]), 0
            for p in parts:
                for s in range(0, len(p), batch):
                    v = p[s : s + batch]
                    h = m.up(v)
                    u = m.down((rng.random(h.shape) < h).astype(float))
                    g = m.up(u)
                    m.w += rate / len(v) * (v.T @ h - u.T @ g)
                    m.hidden += rate * (h - g).mean(0)
                    m.visible += rate * (v - u).mean(0)
                    n += len(v)
            return np.append(n * np.concatenate([m.w.ravel(), m.hidden, m.visible]), n)

        got = summed(x, go, len(state) + 1)
        if not got[-1]:
            break
        state = got[:-1] / got[-1]
    w, b, c = np.split(state, cuts)
    return Boltzmann(features, w.reshape(d, k), b, c)


# --- sparse factors -----------------------------------------------------------


def lasso_codes(x: np.ndarray, atoms: np.ndarray, alpha: float, rounds: int = 50) -> np.ndarray:
    """Codes C that lower |X - C D|^2 / 2 + alpha |C|, coordinate by coordinate for all rows at once."""
    g, b = atoms @ atoms.T, x @ atoms.T
    c = np.zeros_like(b)
    for _ in range(rounds):
        last = c.copy()
        for j in range(len(atoms)):
            if g[j, j] > 0:
                z = b[:, j] - c @ g[:, j] + c[:, j] * g[j, j]
                c[:, j] = np.sign(z) * np.maximum(np.abs(z) - alpha, 0) / g[j, j]
        if np.abs(c - last).max(initial=0) < 1e-8:
            break
    return c


def pursuit_codes(x: np.ndarray, atoms: np.ndarray, nonzero: int) -> np.ndarray:
    """Codes with at most ``nonzero`` entries, by orthogonal matching pursuit."""
    out = np.zeros((len(x), len(atoms)))
    for i, row in enumerate(x):
        used, rest, w = [], row, np.zeros(0)
        for _ in range(min(nonzero, len(atoms))):
            j = int(np.abs(atoms @ rest).argmax())
            if j in used or np.abs(atoms[j] @ rest) < 1e-12:
                break
            used.append(j)
            w = np.linalg.lstsq(atoms[used].T, row, rcond=None)[0]
            rest = row - w @ atoms[used]
        out[i, used] = w
    return out


@dataclass
class Dictionary:
    features: list[str]
    atoms: np.ndarray
    alpha: float
    method: str = "lasso"
    nonzero: int | None = None

    def codes(self, x: np.ndarray) -> np.ndarray:
        return lasso_codes(x, self.atoms, self.alpha) if self.method == "lasso" else pursuit_codes(x, self.atoms, self.nonzero or max(1, len(self.features) // 10))

    def transform(self, df: DataFrame, prefix: str = "code") -> DataFrame:
        return scored(df, self.features, {f"{prefix}{j}": T.DoubleType() for j in range(len(self.atoms))}, lambda x: list(self.codes(x).T))


def dictionary_learning(df: DataFrame, features: list[str], k: int, alpha: float = 1.0, rounds: int = 100, tol: float = 1e-8, method: str = "lasso", nonzero: int | None = None, seed: int = 0) -> Dictionary:
    """Rows' codes are found where they are; from the sums of C'C and C'X the driver renews the atoms one by one, each of length 1."""
    d, x = len(features), numbers(df, features)
    atoms = np.random.default_rng(seed).normal(size=(k, d))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    last = np.inf
    for _ in range(rounds):

        def go(parts: Iterator[np.ndarray], atoms=atoms) -> np.ndarray:
            a, b, cost = np.zeros((k, k)), np.zeros((k, d)), 0.0
            for p in parts:
                c = lasso_codes(p, atoms, alpha)
                a, b = a + c.T @ c, b + c.T @ p
                cost += ((p - c @ atoms) ** 2).sum() / 2 + alpha * np.abs(c).sum()
            return np.concatenate([a.ravel(), b.ravel(), [cost]])

        s = summed(x, go, k * k + k * d + 1)
        a, b, cost = s[: k * k].reshape(k, k), s[k * k : -1].reshape(k, d), s[-1]
        for j in range(k):
            if a[j, j] > 1e-12:
                u = (b[j] - a[j] @ atoms) / a[j, j] + atoms[j]
                atoms[j] = u / max(np.linalg.norm(u), 1e-12)
        if abs(last - cost) <= tol * max(abs(cost), 1.0):
            break
        last = cost
    return Dictionary(features, atoms, alpha, method, nonzero)


@dataclass
class SparseComponents:
    features: list[str]
    mean: np.ndarray
    components: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "spc", ridge: float = 0.01) -> DataFrame:
        """Least squares on the components, with a small ridge."""
        v = self.components
        back = v.T @ np.linalg.inv(v @ v.T + ridge * np.eye(len(v)))
        cols = [sum((F.col(c) - float(m)) * float(w) for c, m, w in zip(self.features, self.mean, back[:, j], strict=True)) for j in range(len(v))]
        return df.withColumns({f"{prefix}{j}": c for j, c in enumerate(cols)})


def sparse_pca(df: DataFrame, features: list[str], k: int, alpha: float = 1.0, rounds: int = 1000, tol: float = 1e-8) -> SparseComponents:
    """Components with an absolute penalty. Scores are linear in the rows, so all steps need the Gram matrix alone: one pass over the data."""
    from quarry.operators.linear import gram

    g = gram(df, features, [])
    c, mean = g.centered(), g.mean()
    values, vectors = np.linalg.eigh(c)
    v = vectors[:, ::-1][:, :k].T * np.sqrt(np.maximum(values[::-1][:k], 0))[:, None]
    for _ in range(rounds):
        p = v.T @ np.linalg.pinv(v @ v.T)
        norm = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", p, c, p), 1e-300))
        p = p / norm  # scores of length 1
        a, b, last = p.T @ c @ p, p.T @ c, v.copy()
        for _ in range(50):
            before = v.copy()
            for j in range(k):
                z = b[j] - a[j] @ v + a[j, j] * v[j]
                v[j] = np.sign(z) * np.maximum(np.abs(z) - alpha, 0) / max(a[j, j], 1e-300)
            if np.abs(v - before).max() < 1e-12 * max(np.abs(v).max(), 1):
                break
        if np.abs(v - last).max() < tol * max(np.abs(v).max(), 1e-300):
            break
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return SparseComponents(features, mean, v / np.where(n > 0, n, 1))


def mini_batch_nmf(df: DataFrame, features: list[str], k: int, rounds: int = 50, share: float = 0.25, forget: float = 0.7, seed: int = 0) -> np.ndarray:
    """Nonnegative parts H (k, features): each round reads a random share of the rows and mixes its W'W and W'X into those of the rounds before."""
    d, x = len(features), numbers(df, features)
    h = np.random.default_rng(seed).uniform(0.1, 1, (k, d))
    a, b = np.zeros((k, k)), np.zeros((k, d))
    for r in range(rounds):

        def go(parts: Iterator[np.ndarray], h=h) -> np.ndarray:
            p, q = np.zeros((k, k)), np.zeros((k, d))
            for v in parts:
                w = np.full((len(v), k), 0.5)
                for _ in range(20):
                    w *= (v @ h.T) / (w @ (h @ h.T) + 1e-12)
                p, q = p + w.T @ w, q + w.T @ v
            return np.concatenate([p.ravel(), q.ravel()])

        s = summed(x.where(F.rand(seed + r) < share), go, k * k + k * d)
        if not s.any():
            continue
        a, b = forget * a + s[: k * k].reshape(k, k), forget * b + s[k * k :].reshape(k, d)
        for _ in range(5):
            h = h * b / (a @ h + 1e-12)
    return h


# --- summaries of clusters ----------------------------------------------------


@dataclass
class Summary:
    """Counts, sums and sums of squares of subclusters; a row's label is that of the nearest centre."""

    features: list[str]
    n: np.ndarray
    total: np.ndarray
    square: np.ndarray
    threshold: float
    labels: np.ndarray | None = None

    @property
    def centers(self) -> np.ndarray:
        return self.total / self.n[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        c = self.centers
        return self.labels[((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T).argmin(1)]

    def transform(self, df: DataFrame, name: str = "label") -> DataFrame:
        return scored(df, self.features, {name: T.LongType()}, lambda x: [self.nearest(x)])


def absorb(entries: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, float]:
    """Entries (count, sum of squares, sums ...) joined one after another to the nearest centre, if the radius then stays within ``threshold``. Where more than ``most``
    subclusters are needed the threshold grows by half and they are joined again."""
    d = entries.shape[1] - 2
    out, used = np.zeros((most + 1, d + 2)), 0
    for e in entries:
        if used:
            own = out[:used]
            c = own[:, 2:] / own[:, :1]
            j = int(((c - e[2:] / e[0]) ** 2).sum(1).argmin())
            new = own[j] + e
            if new[1] / new[0] - ((new[2:] / new[0]) ** 2).sum() <= threshold**2 + 1e-12:
                out[j] = new
                continue
        out[used] = e
        used += 1
        if used > most:
            again = out[:used].copy()
            while used > most:
                threshold = max(threshold * 1.5, 1e-9)
                joined, _ = absorb(again, threshold, len(again))
                used = len(joined)
            out[:used] = joined
    return out[:used].copy(), threshold


def birch(df: DataFrame, features: list[str], threshold: float = 0.5, n_clusters: int | None = None, most: int = 1000) -> Summary:
    """Subclusters within a radius, made by each task and joined in two steps, then merged into ``n_clusters`` by Ward's criterion (or each its own cluster)."""
    d = len(features)

    def packed(entries: list[np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
        if entries:
            got, t = absorb(np.concatenate(entries), threshold, most)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % MERGERS]), pa.array([got.tobytes()], pa.binary()), pa.array([t])], names=["g", "s", "t"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, t = np.zeros((0, d + 2)), threshold
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            held, t = absorb(np.concatenate([held, np.column_stack([np.ones(len(x)), (x * x).sum(1), x])]), t, most)
        yield from packed([held] if len(held) else [], t)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, t = np.zeros((0, d + 2)), threshold
        for b in batches:
            for s, own in zip(b.column(1), b.column(2), strict=True):
                held, t = absorb(np.concatenate([held, np.frombuffer(s.as_py()).reshape(-1, d + 2)]), max(t, own.as_py()), most)
        yield from packed([held] if len(held) else [], t)

    shape = "g long, s binary, t double"
    rows = numbers(df, features).mapInArrow(make, shape).repartition("g").mapInArrow(join, shape).collect()  # at most MERGERS rows
    if not rows:
        raise ValueError("no rows")
    parts = sorted((np.frombuffer(bytes(r[1])).reshape(-1, d + 2) for r in rows), key=lambda p: p[0].tolist())
    got, t = absorb(np.concatenate(parts), max(r[2] for r in rows), most)
    got = got[np.lexsort((got[:, 2:] / got[:, :1]).T[::-1])]
    s = Summary(features, got[:, 0], got[:, 2:], got[:, 1], t)
    s.labels = np.arange(len(got)) if n_clusters is None or n_clusters >= len(got) else agglomerate(s.centers, n_clusters)
    return s


# --- variational mixture ------------------------------------------------------


@dataclass
class Variational:
    features: list[str]
    concentration: np.ndarray
    counts: np.ndarray
    means: np.ndarray
    strength: np.ndarray
    freedom: np.ndarray
    scale: np.ndarray
    process: bool
    bound: float = -np.inf

    def weights(self) -> np.ndarray:
        if not self.process:
            return self.concentration / self.concentration.sum()
        a, b = self.concentration.reshape(2, -1)
        v = a / (a + b)
        w = v * np.cumprod(np.append(1.0, 1 - v[:-1]))
        return w / w.sum()

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the expected densities times weights."""
        from quarry.functions.special import digamma

        d = x.shape[1]
        if self.process:
            a, b = self.concentration.reshape(2, -1)
            both = [digamma(float(v)) for v in a + b]
            stay = np.array([digamma(float(v)) for v in a]) - both
            go = np.array([digamma(float(v)) for v in b]) - both
            pi = stay + np.append(0.0, np.cumsum(go)[:-1])
        else:
            pi = np.array([digamma(float(v)) for v in self.concentration]) - digamma(float(self.concentration.sum()))
        out = []
        for k in range(len(self.means)):
            z = x - self.means[k]
            det = sum(digamma((float(self.freedom[k]) - i) / 2) for i in range(d)) + d * np.log(2) + np.linalg.slogdet(self.scale[k])[1]
            out.append(pi[k] + (det - d * np.log(2 * np.pi) - d / self.strength[k] - self.freedom[k] * np.einsum("ij,jk,ik->i", z, self.scale[k], z)) / 2)
        return np.column_stack(out)

    def transform(self, df: DataFrame, name: str = "label") -> DataFrame:
        return scored(df, self.features, {name: T.LongType()}, lambda x: [self.logs(x).argmax(1)])


def bayesian_mixture(
    df: DataFrame, features: list[str], start: list[list[float]], process: bool = True, prior: float | None = None, kind: str = "full", rounds: int = 100, tol: float = 1e-3, reg: float = 1e-6
) -> Variational:
    """The first round gives each row to the nearest of ``start``. Variational mixture of Gaussians with Dirichlet (process) weights and normal-Wishart components: responsibilities are found where the rows are, and
    the driver gets their sums of counts, values and products. ``kind`` full, tied, diag or spherical constrains the scatter before it is inverted."""
    x, d, k = numbers(df, features), len(features), len(start)
    s = df.agg(*[F.avg(c) for c in features], *[F.var_pop(c) for c in features]).first()
    centre, spread = np.array(s[:d], float), np.diag(np.array(s[d:], float) + reg)
    prior = 1 / k if prior is None else prior
    first = np.stack([np.full(k, 1.0), np.full(k, prior)]) if process else np.full(k, prior + 1.0)
    m = Variational(features, first.ravel(), np.ones(k), np.array(start, float), np.full(k, 1.0), np.full(k, float(d)), np.array([np.linalg.inv(spread * d)] * k), process)
    for t in range(rounds):

        def go(parts: Iterator[np.ndarray], m=m, t=t) -> np.ndarray:
            n, a, b, ll, rows = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0, 0
            for p in parts:
                q = m.logs(p) if t else -1e6 * ((p[:, None] - m.means) ** 2).sum(-1)
                top = q.max(1, keepdims=True)
                lse = top + np.log(np.exp(q - top).sum(1, keepdims=True))
                r = np.exp(q - lse)
                z = p - centre
                n, a, b, ll, rows = n + r.sum(0), a + r.T @ z, b + np.einsum("nk,ni,nj->kij", r, z, z), ll + lse.sum(), rows + len(p)
            return np.concatenate([n, a.ravel(), b.ravel(), [ll, rows]])

        v = summed(x, go, k + k * d + k * d * d + 2)
        n, a, b = v[:k] + 1e-10, v[k : k + k * d].reshape(k, d), v[k + k * d : -2].reshape(k, d, d)
        mean = a / n[:, None]
        cov = b / n[:, None, None] - mean[:, :, None] * mean[:, None] + reg * np.eye(d)
        if kind == "tied":
            cov[:] = np.einsum("k,kij->ij", n, cov) / n.sum()
        elif kind in ("diag", "spherical"):
            cov = np.array([np.diag(np.diag(c)) if kind == "diag" else np.eye(d) * np.trace(c) / d for c in cov])
        strength, freedom = 1.0 + n, d + n
        w = np.array([np.linalg.inv(spread + n[j] * cov[j] + n[j] / strength[j] * np.outer(mean[j], mean[j])) for j in range(k)])
        con = np.stack([1.0 + n, prior + np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)]).ravel() if process else prior + n
        bound = float(v[-2] / max(v[-1], 1))
        done = t > 1 and abs(bound - m.bound) < tol
        m = Variational(features, con, n, centre + a / strength[:, None], strength, freedom, w, process, bound)
        if done:
            break
    return m
