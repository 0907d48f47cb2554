"""Pipelines, output codes, and inference on smoothers and residuals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import linear as L
from quarry.operators.dual import bounded
from quarry.operators.neural import numbers, summed


@dataclass
class FittedPipeline:
    steps: list[tuple[str, object]]

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: s[1].transform(d) if hasattr(s[1], "transform") else s[1](d), self.steps, df)

    def __getitem__(self, name: str):
        return dict(self.steps)[name]


@dataclass
class Pipeline:
    """Named steps, each a function of the data that the step before made, which gives a model with ``transform`` or a function of a DataFrame."""

    steps: list[tuple[str, Callable[[DataFrame], object]]]

    def __post_init__(self):
        names = [n for n, _ in self.steps]
        if not names or len(set(names)) < len(names):
            raise ValueError("a pipeline needs steps with different names")

    def fit(self, df: DataFrame) -> FittedPipeline:
        out = FittedPipeline([])
        for name, f in self.steps:
            m = f(df)
            out.steps.append((name, m))
            if len(out.steps) < len(self.steps):
                df = m.transform(df) if hasattr(m, "transform") else m(df)
        return out


def make_pipeline(*steps: Callable[[DataFrame], object]) -> Pipeline:
    """Steps named by their functions, with numbers."""
    return Pipeline([(f"{getattr(f, '__name__', 'step').strip('<>')}_{k}", f) for k, f in enumerate(steps)])


def output_code(df: DataFrame, y: str, fit: Callable[[DataFrame, str], Column], size: float = 1.5, seed: int = 0) -> Column:
    """Each class has a random code word of about ``size`` bits a class; ``fit(df, 0/1 column)`` gives the score of a bit (about 0 to 1), and the class of the nearest
    word is predicted, the first of equals."""
    classes = sorted(r[0] for r in df.select(y).distinct().dropna().collect())
    bits, rng = max(1, int(np.ceil(size * len(classes)))), np.random.default_rng(seed)
    code = rng.integers(0, 2, (len(classes), bits))
    for _ in range(1000):  # two classes of one word couldn't be told apart
        if len({tuple(c) for c in code}) == len(classes):
            break
        code = rng.integers(0, 2, (len(classes), bits))
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(y))
    scores = []
    for b in range(bits):
        ones = [i + 1 for i in range(len(classes)) if code[i, b]]
        scores.append(F.lit(float(code[0, b])) if len(ones) in (0, len(classes)) else fit(df.withColumn("_bit", number.isin(ones).cast("double")), "_bit"))
    far = F.array(*[reduce(lambda a, b: a + b, [(s - float(v)) ** 2 for s, v in zip(scores, w, strict=True)]) for w in code])
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(far, F.array_min(far)).cast("int"))


# --- smoothers ----------------------------------------------------------------


def wild_bootstrap(train: DataFrame, queries: DataFrame, bandwidth: float, key: str = "id", draws: int = 200, level: float = 0.95, seed: int = 0, most: int = 2000) -> DataFrame:
    """(i, prediction, lower, upper) at ``queries`` (i, x) of a Gaussian smoother of ``train`` (key, u, y, f), where f is the fitted value of a row: residuals y - f
    are kept or turned by a sign for each draw, all draws in one pass. A row's signs depend on its key alone. At most ``most`` queries."""
    rows = bounded(queries, ["i", "x"], most)
    q = np.array([float(r[1]) for r in rows])

    def signs(keys: np.ndarray) -> np.ndarray:
        z = keys.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(draws) + np.arange(draws, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.where((z ^ (z >> np.uint64(31))) & np.uint64(1), 1.0, -1.0)

    def go(parts: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(q), draws + 2))
        for p in parts:
            for s in range(0, len(p), 2000):
                k, u, y, f = p[s : s + 2000].T
                w = np.exp(-(((q[:, None] - u) / bandwidth) ** 2) / 2)
                total += w @ np.column_stack([np.ones(len(u)), y, f[:, None] + (y - f)[:, None] * signs(k)])
        return total.ravel()

    t = summed(numbers(train, [key, "u", "y", "f"]), go, len(q) * (draws + 2)).reshape(len(q), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        m = t[:, 1:] / t[:, :1]
    low, high = np.quantile(m[:, 1:], [(1 - level) / 2, (1 + level) / 2], axis=1)
    out = [(r[0], float(a), float(b), float(c)) for r, a, b, c in zip(rows, m[:, 0], low, high, strict=True)]
    return train.sparkSession.createDataFrame(out, f"i {queries.schema['i'].dataType.simpleString()}, prediction double, lower double, upper double")


def residual_variance(queries: DataFrame, train: DataFrame, bandwidth: float) -> DataFrame:
    """(i, variance, deviation): squared residuals of ``train`` (u, y, f) smoothed at ``queries`` (i, x)."""
    from quarry.operators.neighbors import nadaraya_watson

    v = nadaraya_watson(queries, train.select("u", ((F.col("y") - F.col("f")) ** 2).alias("y")), bandwidth)
    return v.select("i", F.col("prediction").alias("variance"), F.sqrt("prediction").alias("deviation"))


# --- residuals ----------------------------------------------------------------


def white_test(df: DataFrame, features: list[str], y: str, p: str) -> tuple[float, float]:
    """(statistic, p-value): n R^2 of squared residuals on features, their squares and products."""
    from quarry.functions.special import chi2_sf

    terms = {f"_{i}_{j}": F.col(a) * F.col(b) for i, a in enumerate(features) for j, b in enumerate(features) if j >= i}
    x = df.select(*features, *[v.alias(k) for k, v in terms.items()], ((F.col(y) - F.col(p)) ** 2).alias("_e"))
    g = L.gram(x, [*features, *terms], ["_e"])
    c = g.centered()
    w = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
    stat = float(g.n * (w @ c[:-1, -1]) / c[-1, -1]) if c[-1, -1] > 0 else 0.0
    return stat, chi2_sf(stat, len(features) + len(terms))


def goldfeld_quandt(df: DataFrame, features: list[str], y: str, by: str, drop: float = 0.2) -> tuple[float, float]:
    """(statistic, p-value): the ratio of residual variances of regressions above and below the middle share ``drop`` in order of ``by``; two quantiles and one pass."""
    from quarry.functions.special import f_sf

    low, high = df.agg(F.percentile(by, F.array(F.lit((1 - drop) / 2), F.lit((1 + drop) / 2)))).first()[0]
    side = df.withColumn("_side", F.when(F.col(by) <= low, 0).when(F.col(by) >= high, 1)).where("_side is not null")
    s, free = [], []
    for g in (v for _, v in sorted(L.grams(side, features, [y], "_side").items())):
        c = g.centered()
        w = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
        free.append(g.n - len(features) - 1)
        s.append((c[-1, -1] - w @ c[:-1, -1]) / free[-1])
    stat = float(s[1] / s[0])
    return stat, f_sf(stat, free[1], free[0])


def residual_diagnostics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: mean, std, skewness, kurtosis (excess) of residuals, and the Jarque-Bera statistic with its p-value."""
    e = F.col(y) - F.col(p)
    r = df.agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.skewness(e).alias("skewness"), F.kurtosis(e).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4)
    return r.withColumn("normality", jb).withColumn("p_value", F.exp(-F.col("normality") / 2))


def goodness_of_fit(df: DataFrame, y: str, p: str, edf: float) -> DataFrame:
    """One row: r2, adjusted_r2, mse, rmse, mae, aic and bic of a fit with ``edf`` effective parameters."""
    a, e = F.col(y), F.col(y) - F.col(p)
    r = df.agg(F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(a).alias("_v"))
    r = r.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).otherwise(0.0)).withColumn("rmse", F.sqrt("mse"))
    ll = F.col("n") * F.log("mse")
    return r.select("n", "r2", (1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - edf - 1)).alias("adjusted_r2"), "mse", "rmse", "mae", (ll + 2 * edf).alias("aic"), (ll + edf * F.log("n")).alias("bic"))
