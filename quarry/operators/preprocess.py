"""Scalers, encoders, imputers, discretisers, text vectorisers and feature selection.

``fit`` makes a model of plain parameters from one aggregate (a few numbers for each column reach the driver); ``transform`` is column expressions, so
Catalyst fuses it into the scan. Missing values are null or NaN alike: they stay out of statistics.
A constant column is left as it is by every scaler.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stats import present, quantiles


def _row(df: DataFrame, aggs: list[Column]) -> list:
    return list(df.agg(*aggs).first())


@dataclass
class Affine:
    """x -> (x - shift) / scale in each column; where scale is 0 the column stays."""

    columns: list[str]
    shift: list[float]
    scale: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s if s else F.col(c).cast("double") for c, m, s in zip(self.columns, self.shift, self.scale, strict=True)})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m if s else F.col(c).cast("double") for c, m, s in zip(self.columns, self.shift, self.scale, strict=True)})


def standard_scaler(df: DataFrame, columns: list[str]) -> Affine:
    r = _row(df, [f(present(F.col(c))) for c in columns for f in (F.avg, F.stddev_pop)])
    return Affine(columns, r[::2], r[1::2])


def min_max_scaler(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> Affine:
    r = _row(df, [f(present(F.col(c))) for c in columns for f in (F.min, F.max)])
    scale = [(b - a) / (high - low) for a, b in zip(r[::2], r[1::2], strict=True)]
    return Affine(columns, [a - low * s for a, s in zip(r[::2], scale, strict=True)], scale)


def max_abs_scaler(df: DataFrame, columns: list[str]) -> Affine:
    return Affine(columns, [0.0] * len(columns), _row(df, [F.max(F.abs(present(F.col(c)))) for c in columns]))


def robust_scaler(df: DataFrame, columns: list[str]) -> Affine:
    """Median and interquartile range, exact with linear interpolation."""
    q = _row(df, [quantiles(c, [0.25, 0.5, 0.75]) for c in columns])
    return Affine(columns, [x[1] for x in q], [x[2] - x[0] for x in q])


def normalize(df: DataFrame, columns: list[str], norm: str = "l2") -> DataFrame:
    """Rows scaled to norm 1 (``l1``, ``l2`` or ``max``); a row of zeros stays."""
    xs = [F.col(c).cast("double") for c in columns]
    n = {"l1": reduce(lambda a, b: a + b, [F.abs(x) for x in xs]), "l2": F.sqrt(reduce(lambda a, b: a + b, [x * x for x in xs])), "max": F.greatest(*[F.abs(x) for x in xs]) if len(xs) > 1 else F.abs(xs[0])}[norm]
    return df.withColumns({c: F.when(n == 0, x).otherwise(x / n) for c, x in zip(columns, xs, strict=True)})


def binarize(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.when(present(F.col(c)) > threshold, 1.0).otherwise(0.0) for c in columns})


def function_transform(df: DataFrame, columns: list[str], f: Callable[[Column], Column]) -> DataFrame:
    """``f`` maps column expressions, so it stays inside the plan."""
    return df.withColumns({c: f(F.col(c)) for c in columns})


def polynomial_terms(n: int, degree: int, interaction_only: bool = False, bias: bool = True) -> list[tuple[int, ...]]:
    pick = itertools.combinations if interaction_only else itertools.combinations_with_replacement
    return [t for d in range(0 if bias else 1, degree + 1) for t in pick(range(n), d)]


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, bias: bool = True) -> DataFrame:
    """Columns poly_0, poly_1, ... by degree, then in order of the columns."""
    terms = polynomial_terms(len(columns), degree, interaction_only, bias)
    return df.withColumns({f"poly_{k}": reduce(lambda a, b: a * b, [F.col(columns[i]).cast("double") for i in t], F.lit(1.0)) for k, t in enumerate(terms)})


@dataclass
class Bins:
    columns: list[str]
    edges: list[list[float]]

    def transform(self, df: DataFrame, onehot: bool = False) -> DataFrame:
        """Left-closed bins; what lies outside goes to the first or last."""
        out = {}
        for c, e in zip(self.columns, self.edges, strict=True):
            b = reduce(lambda a, x: a + (F.col(c) >= x).cast("int"), e[1:-1], F.lit(0))
            if onehot:
                out |= {f"{c}_{k}": (b == k).cast("double") for k in range(len(e) - 1)}
            else:
                out[c] = b.cast("double")
        return df.withColumns(out)


def kbins(df: DataFrame, columns: list[str], n_bins: int = 5, strategy: str = "uniform", max_iter: int = 100) -> Bins:
    """Edges of equal width, of linear quantiles, or between means of one-dimensional k-means (each round one aggregate)."""
    if strategy == "quantile":
        return Bins(columns, [list(q) for q in _row(df, [quantiles(c, [k / n_bins for k in range(n_bins + 1)]) for c in columns])])
    r = _row(df, [f(present(F.col(c))) for c in columns for f in (F.min, F.max)])
    edges = [[a + (b - a) * k / n_bins for k in range(n_bins + 1)] for a, b in zip(r[::2], r[1::2], strict=True)]
    if strategy == "kmeans":
        for i, c in enumerate(columns):
            centers = [(a + b) / 2 for a, b in zip(edges[i][:-1], edges[i][1:], strict=True)]
            for _ in range(max_iter):
                mid = [(a + b) / 2 for a, b in zip(centers[:-1], centers[1:], strict=True)]
                k = reduce(lambda a, x: a + (F.col(c) >= x).cast("int"), mid, F.lit(0))
                got = {x["k"]: x["m"] for x in df.where(present(F.col(c)).isNotNull()).groupBy(k.alias("k")).agg(F.avg(c).alias("m")).collect()}  # n_bins rows
                new = sorted(got.get(j, centers[j]) for j in range(n_bins))
                if new == centers:
                    break
                centers = new
            edges[i][1:-1] = [(a + b) / 2 for a, b in zip(centers[:-1], centers[1:], strict=True)]
    return Bins(columns, edges)


#: Coefficients of the published rational approximation of the normal quantile function (Abramowitz and Stegun 26.2.23).
PROBIT = ((2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308))


def probit(p: Column) -> Column:
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    c, d = PROBIT
    x = t - (c[0] + c[1] * t + c[2] * t * t) / (1 + d[0] * t + d[1] * t * t + d[2] * t * t * t)
    return F.when(p < 0.5, -x).otherwise(x)


@dataclass
class QuantileMap:
    columns: list[str]
    marks: list[list[float]]
    normal: bool

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, q in zip(self.columns, self.marks, strict=True):
            x, a, n = present(F.col(c)), F.array(*map(F.lit, q)), len(q) - 1
            k = F.greatest(F.lit(1), F.least(F.lit(n), F.size(F.filter(a, lambda v: v <= F.col(c)))))
            lo, hi = F.element_at(a, k), F.element_at(a, k + 1)
            u = F.when(x <= q[0], 0.0).when(x >= q[-1], 1.0).otherwise((k - 1 + F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)) / n)
            out[c] = F.when(x.isNull(), F.col(c)).otherwise(probit(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), u))) if self.normal else u)
        return df.withColumns(out)


def quantile_transformer(df: DataFrame, columns: list[str], n_quantiles: int = 1000, normal: bool = False) -> QuantileMap:
    n = min(n_quantiles, df.count())
    return QuantileMap(columns, [list(q) for q in _row(df, [quantiles(c, [k / (n - 1) for k in range(n)]) for c in columns])], normal)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


@dataclass
class PowerMap:
    columns: list[str]
    lambdas: list[float]
    scaler: Affine | None

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({c: yeo_johnson(F.col(c).cast("double"), lam) for c, lam in zip(self.columns, self.lambdas, strict=True)})
        return self.scaler.transform(out) if self.scaler else out


def power_transformer(df: DataFrame, columns: list[str], standardize: bool = True, points: int = 25, rounds: int = 6) -> PowerMap:
    """Yeo-Johnson with the exponent of the largest likelihood in [-3, 3]. All columns and a grid of exponents are evaluated
    in one pass, and each round narrows the grid, so that the number of passes is fixed."""
    low, high = [-3.0] * len(columns), [3.0] * len(columns)
    for _ in range(rounds):
        grids = [[a + (b - a) * k / (points - 1) for k in range(points)] for a, b in zip(low, high, strict=True)]
        aggs = []
        for c, grid in zip(columns, grids, strict=True):
            x = present(F.col(c).cast("double"))
            aggs += [F.count(x), F.sum(F.when(x >= 0, 1).otherwise(-1) * F.log1p(F.abs(x)))] + [F.var_pop(yeo_johnson(x, lam)) for lam in grid]
        r = _row(df, aggs)
        for i, grid in enumerate(grids):
            n, s, var = r[i * (points + 2)], r[i * (points + 2) + 1], r[i * (points + 2) + 2 : (i + 1) * (points + 2)]
            import math

            like = [-n / 2 * math.log(v) + (lam - 1) * s if v and v > 0 else -math.inf for v, lam in zip(var, grid, strict=True)]
            k = max(range(points), key=like.__getitem__)
            low[i], high[i] = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    lambdas = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    model = PowerMap(columns, lambdas, None)
    if standardize:
        model = PowerMap(columns, lambdas, standard_scaler(model.transform(df), columns))
    return model


def spline_basis(df: DataFrame, column: str, n_knots: int = 5, degree: int = 3, knots: str = "uniform") -> DataFrame:
    """Columns <column>_sp0, ... of the B-spline basis (n_knots + degree - 1 of them), built by the recursion over degrees."""
    if knots == "uniform":
        a, b = _row(df, [F.min(column), F.max(column)])
        base = [a + (b - a) * k / (n_knots - 1) for k in range(n_knots)]
    else:
        base = list(_row(df, [quantiles(column, [k / (n_knots - 1) for k in range(n_knots)])])[0])
    first, last = base[1] - base[0], base[-1] - base[-2]
    t = [base[0] - first * k for k in range(degree, 0, -1)] + base + [base[-1] + last * k for k in range(1, degree + 1)]
    x = F.greatest(F.lit(base[0]), F.least(F.lit(base[-1]), F.col(column).cast("double")))
    top = degree + n_knots - 2  # the last inner interval is closed
    basis = [F.when(((x > t[i]) if i > top else (x >= t[i])) & ((x <= t[i + 1]) if i == top else (x < t[i + 1])), 1.0).otherwise(0.0) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        basis = [(x - t[i]) / (t[i + d] - t[i]) * basis[i] + (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[i + 1] for i in range(len(basis) - 1)]
    return df.withColumns({f"{column}_sp{k}": b for k, b in enumerate(basis)})


# --- categories ---------------------------------------------------------------


def label_encoder(df: DataFrame, column: str) -> DataFrame:
    """(column, code) by sorted value; the table has one row for each distinct value."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def ordinal_encoder(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, code) by first appearance in order of ``order``."""
    return df.groupBy(column).agg(F.min(order).alias("_o")).select(column, (F.row_number().over(Window.orderBy("_o", column)) - 1).alias("code"))


def encode(df: DataFrame, column: str, table: DataFrame, name: str = "code") -> DataFrame:
    """``df`` with the code of ``column`` (null for a value that isn't in ``table``); Spark broadcasts the table where its size allows."""
    return df.join(table.withColumnRenamed("code", name), column, "left")


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """0/1 columns <column>_0 ... <column>_max of an integer column, gaps included."""
    top = df.agg(F.max(column)).first()[0]
    return df.withColumns({f"{column}_{k}": (F.col(column) == k).cast("double") for k in range(top + 1)})


def label_binarizer(df: DataFrame, column: str) -> DataFrame:
    """One 0/1 column for two classes, else one for each class in sorted order."""
    classes = sorted(r[0] for r in df.select(column).distinct().collect())  # columns of the result
    return df.withColumns({f"{column}_is_{c}": (F.col(column) == c).cast("int") for c in (classes[1:] if len(classes) == 2 else classes)})


def multi_label_binarizer(df: DataFrame, column: str) -> DataFrame:
    classes = sorted(r[0] for r in df.select(F.explode(column)).distinct().collect())
    return df.withColumns({f"{column}_has_{c}": F.array_contains(column, c).cast("int") for c in classes})


def binary_encoder(df: DataFrame, column: str) -> DataFrame:
    """Bits of an integer column, the highest first."""
    top = df.agg(F.max(column)).first()[0]
    bits = max(1, (top).bit_length())
    return df.withColumns({f"{column}_b{bits - 1 - k}": F.shiftright(F.col(column).cast("long"), k).bitwiseAND(1).cast("double") for k in range(bits - 1, -1, -1)})


def target_encoder(df: DataFrame, column: str, y: str, smooth: float = 1.0) -> DataFrame:
    """(column, encoded): (n mean + smooth global) / (n + smooth)."""
    whole = F.broadcast(df.agg(F.avg(y).alias("_g")))
    g = df.groupBy(column).agg(F.sum(y).alias("_s"), F.count(y).alias("_n")).crossJoin(whole)
    return g.select(column, ((F.col("_s") + smooth * F.col("_g")) / (F.col("_n") + smooth)).alias("encoded"))


# --- missing values -----------------------------------------------------------


def simple_imputer(df: DataFrame, columns: list[str], strategy: str = "mean", fill: float = 0.0) -> DataFrame:
    """Mean, median, most frequent (the smallest of equals) or a constant; a column without values becomes 0."""
    x = {c: present(F.col(c).cast("double")) for c in columns}
    if strategy == "constant":
        v = [fill if n else 0.0 for n in _row(df, [F.count(x[c]) for c in columns])]
    else:
        f = {"mean": F.avg, "median": lambda z: F.percentile(z, F.lit(0.5)), "most_frequent": lambda z: F.mode(z, True)}[strategy]
        v = [0.0 if m is None else m for m in _row(df, [f(x[c]) for c in columns])]
    return df.withColumns({c: F.coalesce(x[c], F.lit(m)) for c, m in zip(columns, v, strict=True)})


# --- text ---------------------------------------------------------------------


def tokens(text: Column, lowercase: bool = True) -> Column:
    t = F.lower(text) if lowercase else text
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def count_vectorizer(df: DataFrame, key: str, text: str, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, binary: bool = False) -> DataFrame:
    """(key, term, count) in long form: the vocabulary never has to be columns, nor on the driver."""
    c = df.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("count"))
    if min_df > 1 or max_df < 1 or max_features:
        v = c.groupBy("term").agg(F.count("*").alias("_df"), F.sum("count").alias("_tf"))
        if max_df < 1:
            v = v.crossJoin(F.broadcast(df.agg(F.ceil(F.count("*") * max_df).alias("_most")))).where("_df <= _most")
        v = v.where(F.col("_df") >= min_df)
        if max_features:
            v = v.orderBy(F.desc("_tf"), "term").limit(max_features)
        c = c.join(v.select("term"), "term", "left_semi")
    return c.withColumn("count", F.lit(1).cast("long")) if binary else c.select(key, "term", "count")


def tfidf(counts: DataFrame, key: str, n_docs: int | None = None, norm: str | None = "l2", smooth: bool = True, sublinear: bool = False) -> DataFrame:
    """(key, term, tfidf) from (key, term, count): idf ln((1 + n) / (1 + df)) + 1, rows of norm 1."""
    n = F.broadcast(counts.agg(F.count_distinct(key).alias("_n"))) if n_docs is None else F.broadcast(counts.sparkSession.range(1).select(F.lit(n_docs).alias("_n")))
    df = counts.groupBy("term").agg(F.count("*").alias("_df"))
    idf = (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) if smooth else F.log(F.col("_n") / F.col("_df"))) + 1
    tf = 1 + F.log("count") if sublinear else F.col("count")
    w = counts.join(df, "term").crossJoin(n).select(key, "term", (tf * idf).alias("w"))
    if norm is None:
        return w.withColumnRenamed("w", "tfidf")
    size = w.groupBy(key).agg((F.sqrt(F.sum(F.col("w") ** 2)) if norm == "l2" else F.sum(F.abs("w"))).alias("_z"))
    return w.join(size, key).select(key, "term", (F.col("w") / F.col("_z")).alias("tfidf"))


# --- scores of features and selection -----------------------------------------


def f_classif(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(feature, f) of a one-way analysis of variance; one grouped pass for all features."""
    g = df.groupBy(y).agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in columns])
    out = []
    for c in columns:
        s, q, n = F.col(f"s_{c}"), F.col(f"q_{c}"), F.col("n")
        between = F.sum(s * s / n) - F.sum(s) * F.sum(s) / F.sum(n)
        within = F.sum(q) - F.sum(s * s / n)
        k, total = F.count("*"), F.sum("n")
        f = F.when(total == k, 0.0).when(within == 0, float("inf")).otherwise(between / (k - 1) / (within / (total - k)))
        out.append(F.struct(F.lit(c).alias("feature"), f.alias("f"), (k - 1).alias("df1"), (total - k).alias("df2")))
    return g.agg(F.array(*out).alias("a")).select(F.inline("a"))


def f_regression(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(feature, f): r^2 (n - 2) / (1 - r^2)."""
    r = [F.corr(F.col(c).cast("double"), F.col(y).cast("double")) for c in columns]
    out = [F.struct(F.lit(c).alias("feature"), (x * x * (F.count("*") - 2) / (1 - x * x)).alias("f")) for c, x in zip(columns, r, strict=True)]
    return df.agg(F.array(*out).alias("a")).select(F.inline("a"))


def chi2(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(feature, chi2) of class sums against the classes' frequencies; a column of zeros has 0."""
    g = df.groupBy(y).agg(F.count("*").cast("double").alias("n"), *[F.sum(c).cast("double").alias(f"s_{c}") for c in columns])
    total = F.broadcast(g.agg(F.sum("n").alias("N_"), *[F.sum(f"s_{c}").alias(f"t_{c}") for c in columns]))
    x = g.crossJoin(total)
    e = {c: F.col("n") / F.col("N_") * F.col(f"t_{c}") for c in columns}
    return x.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.sum(F.when(e[c] > 0, (F.col(f"s_{c}") - e[c]) ** 2 / e[c])), F.lit(0.0)).alias("chi2")) for c in columns]).alias("a")).select(F.inline("a"))


def variance_threshold(df: DataFrame, columns: list[str], threshold: float = 0.0) -> list[str]:
    return [c for c, v in zip(columns, _row(df, [F.var_pop(c) for c in columns]), strict=True) if v > threshold]


def select_k_best(scores: list[tuple[str, float]], k: int) -> list[str]:
    """The features of the ``k`` highest scores, earlier ones first among equals, in their own order."""
    if k > len(scores):
        raise ValueError("k is larger than the number of features")
    best = sorted(range(len(scores)), key=lambda i: (-scores[i][1], i))[:k]
    return [scores[i][0] for i in sorted(best)]


def select_percentile(scores: list[tuple[str, float]], percentile: float = 10) -> list[str]:
    return select_k_best(scores, -(-len(scores) * percentile // 100).__int__())


def select_fpr(p_values: list[tuple[str, float]], alpha: float = 0.05) -> list[str]:
    return [c for c, p in p_values if p < alpha]


def select_fwe(p_values: list[tuple[str, float]], alpha: float = 0.05) -> list[str]:
    return [c for c, p in p_values if p < alpha / len(p_values)]


def select_fdr(p_values: list[tuple[str, float]], alpha: float = 0.05) -> list[str]:
    ranked = sorted(p for _, p in p_values)
    cut = max((p for k, p in enumerate(ranked, 1) if p <= alpha * k / len(ranked)), default=None)
    return [] if cut is None else [c for c, p in p_values if p <= cut]


def select_from_model(importances: list[tuple[str, float]], threshold: float | None = None) -> list[str]:
    t = sum(v for _, v in importances) / len(importances) if threshold is None else threshold
    return [c for c, v in importances if v >= t]


def rfe(importances: list[tuple[str, float]], k: int) -> dict[str, int]:
    """Ranks by eliminating the least important feature again and again; 1 for the ``k`` that stay."""
    left, rank = list(range(len(importances))), {}
    while len(left) > k:
        worst = min(left, key=lambda i: (importances[i][1], i))
        rank[importances[worst][0]] = len(left) - k + 1
        left.remove(worst)
    return {c: rank.get(c, 1) for c, _ in importances}


def rfe_cv(columns: list[str], importances: Callable[[list[str]], list[float]], score: Callable[[list[str]], float], least: int = 1, step: int = 1) -> tuple[list[str], dict[int, float]]:
    """(best set, score of each size): the least important features of the set at hand go, ``step`` at a time, and ``score`` (a mean over folds) judges every set; the
    smallest of equals is best."""
    left, scores, sets = list(columns), {}, {}
    while True:
        scores[len(left)], sets[len(left)] = score(left), list(left)
        if len(left) <= least:
            break
        v = importances(left)
        drop = sorted(range(len(left)), key=lambda i: (v[i], i))[: min(step, len(left) - least)]
        left = [c for i, c in enumerate(left) if i not in drop]
    best = max(scores, key=lambda n: (scores[n], -n))
    return sets[best], scores


def sequential_selection(columns: list[str], k: int, score: Callable[[list[str]], float], forward: bool = True) -> list[str]:
    """Greedy: adds (or drops) the feature whose set scores best."""
    chosen = [] if forward else list(columns)
    while len(chosen) != k:
        options = [c for c in columns if (c in chosen) != forward]
        best = max(options, key=lambda c: score(sorted(chosen + [c] if forward else [x for x in chosen if x != c], key=columns.index)))
        chosen = chosen + [best] if forward else [x for x in chosen if x != best]
    return sorted(chosen, key=columns.index)


def random_projection(df: DataFrame, columns: list[str], k: int, seed: int = 0, density: float | None = None) -> DataFrame:
    """Columns rp_0 ...: a Gaussian matrix of variance 1/k, or with ``density`` a sparse one of three values."""
    import numpy as np

    rng = np.random.default_rng(seed)
    d = len(columns)
    if density is None:
        m = rng.normal(0, 1 / np.sqrt(k), (d, k))
    else:
        m = rng.choice([-1.0, 0.0, 1.0], (d, k), p=[density / 2, 1 - density, density / 2]) / np.sqrt(density * k)
    return df.withColumns({f"rp_{j}": reduce(lambda a, b: a + b, [F.col(c) * float(m[i, j]) for i, c in enumerate(columns) if m[i, j]], F.lit(0.0)) for j in range(k)})


@dataclass
class ColumnTransformer:
    """Named steps (name, function of df and columns, columns), and what becomes of the other columns: ``drop`` or ``passthrough``."""

    steps: list[tuple[str, Callable[[DataFrame, list[str]], DataFrame], list[str]]]
    remainder: str = "drop"

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        out, made = df, list(keep)
        for _, f, columns in self.steps:
            before = set(out.columns)
            out = f(out, columns)
            made += columns + [c for c in out.columns if c not in before]
        used = {c for _, _, columns in self.steps for c in columns}
        rest = [c for c in df.columns if c not in used and c not in made] if self.remainder == "passthrough" else []
        return out.select(*dict.fromkeys([*made, *rest]))
