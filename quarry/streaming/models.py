"""Streaming: models whose state is sums, and windows over event time.

Moments by class are a streaming aggregate, so naive Bayes, scalers and Gram-based models can be read off at any time; gradient
models and mini-batch k-means take each micro-batch in foreachBatch and keep a small model on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.bayes import moments
from quarry.operators.cluster import Centers


def class_moments(stream: DataFrame, features: list[str], y: str) -> DataFrame:
    """The streaming state of Gaussian, multinomial and other naive Bayes models; use output mode ``complete``."""
    return moments(stream, features, y)


def windowed(stream: DataFrame, ts: str, late: str, size: str, slide: str | None, keys: list[str], value: str) -> DataFrame:
    """Counts, sums and means in tumbling or sliding windows; rows later than ``late`` are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def sessions(stream: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    g = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


@dataclass
class PartialKMeans:
    """Mini-batch k-means over micro-batches: ``update`` is for foreachBatch."""

    model: Centers
    counts: list[float] = field(default_factory=list)

    def update(self, batch: DataFrame, _epoch: int = 0) -> None:
        m = self.model
        self.counts = self.counts or [1.0] * len(m.centers)
        rows = batch.select(*m.features, m.predict().alias("_k")).groupBy("_k").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in m.features]).collect()
        for r in rows:
            k = r["_k"]
            m.centers[k] = [(self.counts[k] * v + r[c]) / (self.counts[k] + r["n"]) for c, v in zip(m.features, m.centers[k], strict=True)]
            self.counts[k] += r["n"]


#: Derivatives of losses in the score f, as column expressions of (y, f).
LOSSES = {
    "squared_error": lambda y, f: f - y,
    "hinge": lambda y, f: F.when(y * f < 1, -y).otherwise(0.0),
    "log_loss": lambda y, f: -y / (1 + F.exp(y * f)),
    "modified_huber": lambda y, f: F.when(y * f < -1, -4 * y).when(y * f < 1, -2 * y * (1 - y * f)).otherwise(0.0),
    "huber": lambda y, f: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), f - y)),
    "epsilon_insensitive": lambda y, f: F.when(F.abs(y - f) <= 0.1, 0.0).otherwise(F.signum(f - y)),
}


@dataclass
class PartialSGD:
    """A linear model that takes one gradient step of the mean loss for each batch; schedules constant, invscaling and optimal."""

    features: list[str]
    y: str
    loss: str = "squared_error"
    eta0: float = 0.01
    alpha: float = 1e-4
    schedule: str = "invscaling"
    power: float = 0.25
    t: int = 0
    w: np.ndarray | None = None

    def score(self):
        w = self.w if self.w is not None else np.zeros(len(self.features) + 1)
        out = F.lit(float(w[0]))
        for c, v in zip(self.features, w[1:], strict=True):
            out = out + F.col(c) * float(v)
        return out

    def update(self, batch: DataFrame, _epoch: int = 0) -> None:
        g = LOSSES[self.loss](F.col(self.y), self.score())
        r = batch.agg(F.count("*"), F.avg(g), *[F.avg(g * F.col(c)) for c in self.features]).first()
        if not r[0]:
            return
        self.t += 1
        w = self.w if self.w is not None else np.zeros(len(self.features) + 1)
        eta = {"constant": self.eta0, "invscaling": self.eta0 / self.t**self.power, "optimal": 1 / (max(self.alpha, 1e-12) * self.t)}[self.schedule]
        penalty = self.alpha * w
        penalty[0] = 0
        self.w = w - eta * (np.array(r[1:], float) + penalty)


#: The losses themselves, for the rule that stops.
VALUES = {
    "squared_error": lambda y, f: (f - y) ** 2 / 2,
    "hinge": lambda y, f: F.greatest(F.lit(0.0), 1 - y * f),
    "log_loss": lambda y, f: F.log1p(F.exp(-y * f)),
    "modified_huber": lambda y, f: F.when(y * f < -1, -4 * y * f).otherwise(F.greatest(F.lit(0.0), 1 - y * f) ** 2),
    "huber": lambda y, f: F.when(F.abs(f - y) <= 1, (f - y) ** 2 / 2).otherwise(F.abs(f - y) - 0.5),
    "epsilon_insensitive": lambda y, f: F.greatest(F.lit(0.0), F.abs(y - f) - 0.1),
}


@dataclass
class SGD:
    """Linear models by epochs of mini-batch gradient steps. ``classes`` None: a regression; two classes: one score (-1 for the first); more: a score for each against the rest.

    Rows are dealt to ``batches`` mini-batches by ``deal``, a function of the epoch that gives a column of batch numbers (a shuffle by hash, say); each batch is one aggregate for all
    scores. Stops when the mean loss of an epoch moves by less than ``tol``. Classes are fixed by the first batch of ``partial_fit``."""

    features: list[str]
    y: str
    loss: str = "squared_error"
    eta0: float = 0.01
    alpha: float = 1e-4
    schedule: str = "invscaling"
    power: float = 0.25
    tol: float = 1e-3
    classes: list | None = None
    t: int = 0
    w: np.ndarray | None = None

    def _goals(self) -> list:
        y = F.col(self.y)
        if self.classes is None:
            return [y]
        return [F.when(y == k, 1.0).otherwise(-1.0) for k in (self.classes[1:] if len(self.classes) == 2 else self.classes)]

    def scores(self) -> list:
        w = self.w if self.w is not None else np.zeros((len(self._goals()), len(self.features) + 1))
        return [sum((F.col(c) * float(x) for c, x in zip(self.features, v[1:], strict=True)), F.lit(float(v[0]))) for v in w]

    def predict(self):
        s = self.scores()
        if self.classes is None:
            return s[0]
        if len(s) == 1:
            return F.when(s[0] >= 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))
        best = F.greatest(*[F.struct(v.alias("s"), F.lit(-k).alias("k")) for k, v in enumerate(s)])
        return F.element_at(F.array(*map(F.lit, self.classes)), 1 - best["k"])

    def step(self, batch: DataFrame) -> tuple[float, int]:
        """One gradient step; (sum of losses before it, rows)."""
        goals, scores = self._goals(), self.scores()
        aggs = [F.count("*")]
        for y, f in zip(goals, scores, strict=True):
            g = LOSSES[self.loss](y, f)
            aggs += [F.sum(VALUES[self.loss](y, f)), F.avg(g), *[F.avg(g * F.col(c)) for c in self.features]]
        r = batch.where(F.col(self.y).isNotNull()).agg(*aggs).first()
        if not r[0]:
            return 0.0, 0
        self.t += 1
        m = np.array(r[1:], float).reshape(len(goals), -1)
        w = self.w if self.w is not None else np.zeros((len(goals), len(self.features) + 1))
        eta = {"constant": self.eta0, "invscaling": self.eta0 / self.t**self.power, "optimal": 1 / (max(self.alpha, 1e-12) * self.t)}[self.schedule]
        self.w = w - eta * (m[:, 1:] + self.alpha * w * (np.arange(w.shape[1]) > 0))
        return float(m[:, 0].sum()), r[0]

    def partial_fit(self, batch: DataFrame, classifier: bool = False) -> SGD:
        if classifier and self.classes is None:
            self.classes = sorted(r[0] for r in batch.select(self.y).where(F.col(self.y).isNotNull()).distinct().collect())
            if len(self.classes) < 2:
                raise ValueError("the first batch must hold two classes or more")
        self.step(batch)
        return self

    def fit(self, df: DataFrame, deal, batches: int = 10, epochs: int = 20, classifier: bool = False) -> SGD:
        if classifier:
            self.classes = sorted(r[0] for r in df.select(self.y).where(F.col(self.y).isNotNull()).distinct().collect())
            if len(self.classes) < 2:
                raise ValueError("two classes or more")
        before = float("inf")
        for e in range(epochs):
            done = [self.step(df.where(deal(e) == b)) for b in range(batches)]
            mean = sum(v for v, _ in done) / max(1, sum(n for _, n in done))
            if abs(before - mean) < self.tol:
                break
            before = mean
        return self


def each_batch(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``update`` on all that is there, batch by batch, and stops."""
    q = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
