"""Naive Bayes: counts and sums by class are the whole model, so models merge, and a stream keeps them up to date."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


@dataclass
class ByClass:
    """A score (column expression) for each class."""

    classes: list
    scores: list[Column]

    def predict(self, largest: bool = True) -> Column:
        s = F.array(*self.scores)
        return F.element_at(F.array(*map(F.lit, self.classes)), F.array_position(s, F.array_max(s) if largest else F.array_min(s)).cast("int"))

    def log_proba(self) -> Column:
        top = F.greatest(*self.scores) if len(self.scores) > 1 else self.scores[0]
        z = top + F.log(_sum([F.exp(s - top) for s in self.scores]))
        return F.array(*[s - z for s in self.scores])


def moments(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """One row for each class: n, sums and sums of squares. Rows of two such tables add up."""
    return df.groupBy(y).agg(F.count("*").alias("n"), *[F.sum(c).cast("double").alias(f"s_{c}") for c in features], *[F.sum(F.col(c) * F.col(c)).cast("double").alias(f"q_{c}") for c in features])


def merged(a: DataFrame, b: DataFrame, y: str) -> DataFrame:
    """The moments of both, new classes included."""
    u = a.unionByName(b)
    return u.groupBy(y).agg(*[F.sum(c).alias(c) for c in u.columns if c != y])


def gaussian(table: DataFrame, features: list[str], y: str, smoothing: float = 1e-9) -> ByClass:
    """Means and population variances; the smoothing is of the largest variance of a class, at least 1."""
    rows = sorted(table.collect(), key=lambda r: r[y])  # a row for each class
    total = sum(r["n"] for r in rows)
    par = [(r["n"] / total, [(r[f"s_{c}"] / r["n"], max(0.0, r[f"q_{c}"] / r["n"] - (r[f"s_{c}"] / r["n"]) ** 2)) for c in features]) for r in rows]
    eps = smoothing * max(1.0, max(v for _, p in par for _, v in p))
    return ByClass([r[y] for r in rows], [_sum([F.lit(math.log(prior))] + [-(F.col(c) - m) ** 2 / (2 * (v + eps)) - 0.5 * math.log(2 * math.pi * (v + eps)) for c, (m, v) in zip(features, p, strict=True)]) for prior, p in par])


def multinomial(table: DataFrame, features: list[str], y: str, alpha: float = 1.0, fit_prior: bool = True) -> ByClass:
    rows = sorted(table.collect(), key=lambda r: r[y])
    total = sum(r["n"] for r in rows)
    out = []
    for r in rows:
        s = sum(r[f"s_{c}"] for c in features) + alpha * len(features)
        out.append(_sum([F.lit(math.log(r["n"] / total if fit_prior else 1 / len(rows)))] + [F.col(c) * math.log((r[f"s_{c}"] + alpha) / s) for c in features]))
    return ByClass([r[y] for r in rows], out)


def bernoulli(table: DataFrame, features: list[str], y: str, alpha: float = 1.0) -> ByClass:
    """Features are used as they are: 0 or 1 unless binarised before."""
    rows = sorted(table.collect(), key=lambda r: r[y])
    total = sum(r["n"] for r in rows)
    out = []
    for r in rows:
        p = [(r[f"s_{c}"] + alpha) / (r["n"] + 2 * alpha) for c in features]
        out.append(_sum([F.lit(math.log(r["n"] / total))] + [F.col(c) * math.log(q) + (1 - F.col(c)) * math.log(1 - q) for c, q in zip(features, p, strict=True)]))
    return ByClass([r[y] for r in rows], out)


def complement(table: DataFrame, features: list[str], y: str, alpha: float = 1.0) -> ByClass:
    """Weights of all other classes; the smallest score wins, and priors don't enter."""
    rows = sorted(table.collect(), key=lambda r: r[y])
    whole = {c: sum(r[f"s_{c}"] for r in rows) for c in features}
    out = []
    for r in rows:
        other = {c: whole[c] - r[f"s_{c}"] + alpha for c in features}
        out.append(_sum([F.col(c) * math.log(other[c] / sum(other.values())) for c in features]))
    return ByClass([r[y] for r in rows], out)


def categorical_counts(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(y, feature, value, n) in long form, from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features]))
    return df.select(F.col(y), pairs.alias("p")).groupBy(y, "p.feature", "p.value").agg(F.count("*").alias("n"))


def categorical(df: DataFrame, features: list[str], y: str, alpha: float = 1.0) -> ByClass:
    rows = categorical_counts(df, features, y).collect()  # classes times values of the features
    n: dict = {}
    values: dict = {c: set() for c in features}
    count: dict = {}
    for r in rows:
        count[r[y], r["feature"], r["value"]] = r["n"]
        values[r["feature"]].add(r["value"])
        if r["feature"] == features[0]:
            n[r[y]] = n.get(r[y], 0) + r["n"]
    total = sum(n.values())
    out = []
    for k in sorted(n):
        parts = [F.lit(math.log(n[k] / total))]
        for c in features:
            d = n[k] + alpha * len(values[c])
            cases = [x for v in sorted(values[c], key=str) for x in (F.lit(v), F.lit(math.log((count.get((k, c, v), 0) + alpha) / d)))]
            parts.append(F.element_at(F.create_map(*cases), F.col(c).cast("string")))
        out.append(_sum(parts))
    return ByClass(sorted(n), out)


def posterior_normal(df: DataFrame, mean: str, var: str, prior_mean: float = 0.0, prior_var: float = 1.0) -> DataFrame:
    """(mean, var) of a normal mean after observations with known variances."""
    p = 1 / prior_var + F.sum(1 / F.col(var))
    return df.agg(((prior_mean / prior_var + F.sum(F.col(mean) / F.col(var))) / p).alias("mean"), (1 / p).alias("var"))
