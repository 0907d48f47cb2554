"""Kernel feature maps, kernel and local regression, imputation by models, matrix factorisation, robust covariance, and meta-estimators.

Kernel methods work on features: random Fourier features or landmarks (a documented number of rows) turn a kernel model into a linear one whose
Gram matrix is one pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import order_statistics, present
from quarry.operators import linear as L


def _sum(xs):
    return reduce(lambda a, b: a + b, xs)


def rbf_sampler(df: DataFrame, features: list[str], gamma: float = 1.0, k: int = 100, seed: int = 0, prefix: str = "rf") -> DataFrame:
    """sqrt(2 / k) cos(w x + b): inner products approach exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (len(features), k)), rng.uniform(0, 2 * np.pi, k)
    return df.withColumns({f"{prefix}{j}": np.sqrt(2 / k) * F.cos(_sum([F.col(c) * float(w[i, j]) for i, c in enumerate(features)]) + float(b[j])) for j in range(k)})


KERNELS = {
    "rbf": lambda x, y, gamma=1.0, degree=3, coef0=0.0: np.exp(-gamma * ((x[:, None] - y[None]) ** 2).sum(-1)),
    "linear": lambda x, y, gamma=1.0, degree=3, coef0=0.0: x @ y.T,
    "polynomial": lambda x, y, gamma=1.0, degree=3, coef0=0.0: (gamma * x @ y.T + coef0) ** degree,
    "sigmoid": lambda x, y, gamma=1.0, degree=3, coef0=0.0: np.tanh(gamma * x @ y.T + coef0),
}


def landmarks(df: DataFrame, features: list[str], key: str, k: int) -> np.ndarray:
    """``k`` rows in order of a hash of the key."""
    return np.array([list(map(float, r)) for r in df.orderBy(F.xxhash64(key), key).select(*features).limit(k).collect()])


@dataclass
class Nystroem:
    """Features whose inner products are the kernel's, exact at the landmarks."""

    features: list[str]
    points: np.ndarray
    kernel: str = "rbf"
    gamma: float = 1.0
    degree: int = 3
    coef0: float = 0.0

    def transform(self, df: DataFrame, prefix: str = "ny") -> DataFrame:
        k = KERNELS[self.kernel](self.points, self.points, self.gamma, self.degree, self.coef0)
        u, s, vt = np.linalg.svd(k)
        keep = s > 1e-10 * s[0]
        m = (u[:, keep] / np.sqrt(s[keep])) @ vt[keep]
        pts, f, names = self.points, self.features, [f"{prefix}{j}" for j in range(len(m))]
        call = (self.kernel, self.gamma, self.degree, self.coef0)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in f])
                z = KERNELS[call[0]](x, pts, *call[1:]) @ m.T
                yield pa.record_batch([*b.columns, *[pa.array(z[:, j]) for j in range(z.shape[1])]], names=[*b.schema.names, *names])

        return df.mapInArrow(go, T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))


def kernel_ridge(df: DataFrame, features: list[str], y: str, key: str, alpha: float = 1.0, kernel: str = "rbf", gamma: float = 1.0, k: int = 100) -> tuple[Nystroem, L.LinearModel]:
    """Ridge without intercept on landmark features: the exact kernel ridge when all rows are landmarks."""
    m = Nystroem(features, landmarks(df, features, key, k), kernel, gamma)
    z = m.transform(df.select(*features, y))
    return m, L.ridge(L.gram(z, [f"ny{j}" for j in range(len(m.points))], [y]), alpha, intercept=False)


def kernel_classifier(df: DataFrame, features: list[str], y: str, gamma: float = 1.0, c: float = 1.0, k: int = 60, seed: int = 0) -> tuple[Callable[[DataFrame], DataFrame], L.LinearModel]:
    """A support-vector machine with an RBF kernel by random features (squared hinge)."""
    f = lambda d: rbf_sampler(d, features, gamma, k, seed)
    return f, L.linear_svc(f(df), [f"rf{j}" for j in range(k)], y, c)


def local_linear(queries: DataFrame, train: DataFrame, bandwidth: float, most: int = 20_000) -> DataFrame:
    """(i, prediction): weighted line through ``train`` (u, y) at each of ``queries`` (i, x), Gaussian weights."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} points to predict at once")
    d = F.col("u") - F.col("x")
    w = F.exp(-((d / bandwidth) ** 2) / 2)
    s = train.crossJoin(F.broadcast(queries)).groupBy("i").agg(F.sum(w).alias("a"), F.sum(w * d).alias("b"), F.sum(w * d * d).alias("c"), F.sum(w * F.col("y")).alias("p"), F.sum(w * d * F.col("y")).alias("q"))
    det = F.col("a") * F.col("c") - F.col("b") ** 2
    return s.select("i", F.when(F.abs(det) > 1e-12, (F.col("c") * F.col("p") - F.col("b") * F.col("q")) / det).otherwise(F.col("p") / F.col("a")).alias("prediction"))


def conformal(df: DataFrame, y: str, p: str, level: float = 0.9) -> tuple[Column, Column]:
    """(lower, upper) around a prediction: the quantile of absolute residuals of a calibration set."""
    e = F.nanvl(F.abs(F.col(y) - F.col(p)).cast("double"), F.lit(float("inf")))
    n, m = df.agg(F.count("*"), F.count(e)).first()
    at = (m - 1) * float(min(1.0, np.ceil((n + 1) * level) / n))
    low, high = order_statistics(df, e, [int(np.floor(at)), int(np.ceil(at))])
    q = low + (at - np.floor(at)) * (high - low)
    return F.col(p) - q, F.col(p) + q


def breusch_pagan(df: DataFrame, features: list[str], y: str, p: str) -> tuple[float, float]:
    """(statistic, p-value): n R^2 of squared residuals on the features."""
    from quarry.functions.special import chi2_sf

    x = df.select(*features, ((F.col(y) - F.col(p)) ** 2).alias("_e"))
    g = L.gram(x, features, ["_e"])
    c, w = g.centered(), L.ols(g).coef
    stat = float(g.n * (w @ c[:-1, -1]) / c[-1, -1])
    return stat, chi2_sf(stat, len(features))


# --- missing values -----------------------------------------------------------


def iterative_imputer(df: DataFrame, columns: list[str], rounds: int = 10, alpha: float = 1.0, tol: float = 1e-3) -> DataFrame:
    """Each column in turn from a ridge on the others, round by round; a Gram matrix for each column and round."""
    x = {c: present(F.col(c).cast("double")) for c in columns}
    means = df.agg(*[F.avg(x[c]) for c in columns]).first()
    expr = {c: F.coalesce(x[c], F.lit(float(m or 0.0))) for c, m in zip(columns, means, strict=True)}
    base = df.withColumns({f"_x_{c}": x[c] for c in columns})
    cur = base.withColumns({c: expr[c] for c in columns})
    last = None
    for _ in range(rounds):
        shift = []
        for c in columns:
            others = [o for o in columns if o != c]
            m = L.ridge(L.gram(cur.where(F.col(f"_x_{c}").isNotNull()), others, [c]), alpha)
            cur = cur.withColumn(c, F.coalesce(F.col(f"_x_{c}"), m.predict()))
            shift.append(np.append(m.coef, m.intercept))
        now = np.concatenate(shift)
        if last is not None and np.abs(now - last).max() < tol:
            break
        last = now
    return cur.drop(*[f"_x_{c}" for c in columns])


def _nearest_donors(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
    """For each missing value of the rows ``x`` its ``k`` nearest donors in one block: row, column, donor, squared distance over the features both have, value."""
    out: list[tuple] = []
    for r in range(len(i)):
        d = np.nansum((y - x[r]) ** 2, axis=1)
        for c in np.flatnonzero(np.isnan(x[r])).tolist():
            some = np.flatnonzero(~np.isnan(y[:, c]) & (j != i[r]))
            best = some[np.lexsort((j[some], d[some]))[:k]]
            out += [(int(i[r]), c, int(j[t]), float(d[t]), float(y[t, c])) for t in best]
    kinds = (np.int64, np.int32, np.int64, np.float64, np.float64)
    return [np.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [np.zeros(0)] * 5


def knn_imputer(df: DataFrame, columns: list[str], key: str, k: int = 5) -> DataFrame:
    """Means over the nearest rows that have the feature, by distances over the features both have (not rescaled), ties by key; 0 where no row has it. Rows and donors meet in packed blocks,
    of which each gives a missing value its nearest few only."""
    from quarry.operators.neighbors import in_blocks

    x = {c: present(F.col(c).cast("double")) for c in columns}
    whole = df.withColumns({c: x[c] for c in columns})
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    rows = whole.select(F.col(key).cast("long").alias("i"), F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns]).alias("x"), missing.alias("m"))
    near = in_blocks(rows.where("m").select("i", "x"), rows.select("i", "x"), lambda i, a, j, b: _nearest_donors(i, a, j, b, k), "i long, c int, j long, d double, v double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("i", "c").orderBy("d", "j"))).where(F.col("r") <= k)
    fill = best.groupBy("i").agg(*[F.avg(F.when(F.col("c") == at, F.col("v"))).alias(f"_f_{c}") for at, c in enumerate(columns)]).withColumnRenamed("i", "_i")
    joined = whole.join(fill, F.col(key) == F.col("_i"), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_f_{c}"), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- factorisation and robust covariance --------------------------------------


def nmf(df: DataFrame, features: list[str], k: int, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """The nonnegative parts H (k, features) of rows W H: each round solves rows' weights by a few multiplicative steps where they are, and sums W'W and W'X."""
    rng = np.random.default_rng(seed)
    h = rng.uniform(0.1, 1, (k, len(features)))
    x = df.select(*[F.col(c).cast("double") for c in features])
    for _ in range(rounds):

        def go(batches: Iterator[pa.RecordBatch], h=h) -> Iterator[pa.RecordBatch]:
            a, b = np.zeros((k, k)), np.zeros((k, len(features)))
            for t in batches:
                v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in t.columns])
                w = np.full((len(v), k), 0.5)
                for _ in range(20):
                    w *= (v @ h.T) / (w @ (h @ h.T) + 1e-12)
                a, b = a + w.T @ w, b + w.T @ v
            yield pa.record_batch([pa.array(range(k * k + b.size)), pa.array(np.concatenate([a.ravel(), b.ravel()]))], names=["i", "v"])

        r = dict(x.mapInArrow(go, "i long, v double").groupBy("i").agg(F.sum("v")).collect())  # k (k + features) rows
        s = np.array([r[i] for i in range(k * k + h.size)])
        h = h * (s[k * k :].reshape(h.shape) / (s[: k * k].reshape(k, k) @ h + 1e-12))
    return h


def fast_ica(df: DataFrame, features: list[str], k: int, rounds: int = 100, tol: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(unmixing matrix, mean): whitening from the Gram matrix, then symmetric fixed-point rounds with tanh, each one aggregate."""
    g = L.gram(df, features, [])
    values, vectors = np.linalg.eigh(L.covariance(g))
    white = (vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])).T
    mean, w = g.mean(), np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        u = w @ white
        s = [_sum([(F.col(c) - float(m)) * float(v) for c, m, v in zip(features, mean, row, strict=True)]) for row in u]
        z = [_sum([(F.col(c) - float(m)) * float(v) for c, m, v in zip(features, mean, row, strict=True)]) for row in white]
        r = df.agg(*[F.avg(F.tanh(a) * b) for a in s for b in z], *[F.avg(1 - F.tanh(a) ** 2) for a in s]).first()
        new = np.array(r[: k * k]).reshape(k, k) - np.array(r[k * k :])[:, None] * w
        p, _, q = np.linalg.svd(new)
        new = p @ q
        done = np.abs(np.abs(np.sum(new * w, 1)) - 1).max() < tol
        w = new
        if done:
            break
    return w @ white, mean


def min_cov_det(df: DataFrame, features: list[str], support: float = 0.75, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(location, covariance) of the ``support`` share of rows closest to each other: concentration steps, each a quantile and a Gram matrix."""
    g = L.gram(df, features, [])
    mean, s = np.array(df.agg(*[F.percentile_approx(c, 0.5) for c in features]).first(), float), np.diag(np.diag(L.covariance(g)))
    for _ in range(rounds):
        d = L.mahalanobis(features, mean, np.linalg.inv(s))
        cut = df.agg(F.percentile_approx(d, support, 100_000)).first()[0]
        g = L.gram(df.where(d <= cut), features, [])
        new, s = g.mean(), L.covariance(g)
        done = np.abs(new - mean).max() < 1e-9
        mean = new
        if done:
            break
    return mean, s


def elliptic_envelope(df: DataFrame, features: list[str], contamination: float = 0.1, support: float = 0.75) -> Column:
    """-1 for the ``contamination`` share of the largest robust distances, else 1."""
    mean, s = min_cov_det(df, features, support)
    d = L.mahalanobis(features, mean, np.linalg.inv(s))
    cut = df.agg(F.percentile(d, F.lit(1 - contamination))).first()[0]
    return F.when(d > cut, -1).otherwise(1)


# --- meta-estimators ----------------------------------------------------------


def one_vs_one(df: DataFrame, y: str, fit: Callable[[DataFrame, str], Column]) -> Column:
    """Votes of a model for each pair of classes (``fit(df, 0/1 column)`` gives a score, positive for 1); the first of equals."""
    classes = sorted(r[0] for r in df.select(y).distinct().collect())
    votes = {c: F.lit(0) for c in classes}
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            s = fit(df.where(F.col(y).isin(a, b)).withColumn("_is", (F.col(y) == b).cast("double")), "_is")
            votes[a], votes[b] = votes[a] + (s <= 0).cast("int"), votes[b] + (s > 0).cast("int")
    arr = F.array(*votes.values())
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(arr, F.array_max(arr)).cast("int"))


def multi_output(df: DataFrame, targets: list[str], fit: Callable[[DataFrame, str], Column]) -> list[Column]:
    return [fit(df, t) for t in targets]


def chain(df: DataFrame, features: list[str], targets: list[str], fit: Callable[[DataFrame, list[str], str], Column]) -> list[Column]:
    """Each target from the features and the targets before it; predictions stand in for these later."""
    out, used = [], list(features)
    for t in targets:
        out.append(fit(df, used, t).alias(t))
        used = [*used, t]
    return out


def transformed_target(df: DataFrame, y: str, fit: Callable[[DataFrame, str], Column], f: Callable[[Column], Column], inverse: Callable[[Column], Column]) -> Column:
    return inverse(fit(df.withColumn("_y", f(F.col(y))), "_y"))


def self_training(df: DataFrame, y: str, fit: Callable[[DataFrame, str], Column], threshold: float = 0.75, rounds: int = 10) -> Column:
    """``y`` is 0, 1 or null; confident predictions (probabilities by ``fit``) become labels until none is left."""
    cur, known = df, df.where(F.col(y).isNotNull()).count()
    p = fit(cur.where(F.col(y).isNotNull()), y)
    for _ in range(rounds):
        cur = df.withColumn(y, F.coalesce(F.col(y).cast("double"), F.when(p >= threshold, 1.0).when(p <= 1 - threshold, 0.0)))
        n = cur.where(F.col(y).isNotNull()).count()
        if n == known:
            break
        known = n
        p = fit(cur.where(F.col(y).isNotNull()), y)
    return p


def feature_union(df: DataFrame, parts: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda d, f: f(d), parts, df)


def ransac(df: DataFrame, features: list[str], y: str, key: str, trials: int = 20, seed: int = 42) -> L.LinearModel:
    """Of models through random minimal subsets, the one with the most inliers (absolute residuals within the median absolute deviation); refitted on these. All trials are
    judged in one pass."""
    med = df.agg(F.percentile_approx(y, 0.5)).first()[0]
    limit = df.agg(F.percentile_approx(F.abs(F.col(y) - med), 0.5)).first()[0] or 1e-6
    k = len(features) + 1
    rows = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).select(*features, y).limit(k * trials).collect()
    models = []
    for t in range(trials):
        part = np.array([list(map(float, r)) for r in rows[t * k : (t + 1) * k]])
        if len(part) == k:
            w = np.linalg.lstsq(np.column_stack([np.ones(k), part[:, :-1]]), part[:, -1], rcond=None)[0]
            models.append(L.LinearModel(features, w[1:], float(w[0])))
    ok = [F.abs(F.col(y) - m.predict()) <= limit for m in models]
    n = df.agg(*[F.sum(o.cast("long")) for o in ok]).first()
    return L.ols(L.gram(df.where(ok[int(np.argmax(n))]), features, [y]))


def topics(df: DataFrame, key: str, tokens: str, k: int, rounds: int = 10, vocabulary: int = 10_000, seed: int = 1) -> DataFrame:
    """(topic, terms) of Spark's own latent Dirichlet allocation."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    cv = CountVectorizer(inputCol=tokens, outputCol="_v", vocabSize=vocabulary).fit(df)
    m = LDA(featuresCol="_v", k=k, maxIter=rounds, seed=seed).fit(cv.transform(df).select(key, "_v"))
    words = F.array(*map(F.lit, cv.vocabulary))
    return m.describeTopics(8).select("topic", F.transform("termIndices", lambda i: F.element_at(words, i + 1)).alias("terms"))
