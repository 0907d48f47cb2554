"""Splits, cross-validation, searches, dummies, thresholds and inspection.

A split is a column: rows are put in order by a key (for shuffles by a hash of seed and key) and folds are intervals of that order, so a
fold is a filter and nothing is copied. Places in a global order come from per-bucket counts, not from one window over all rows.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import present
from quarry.functions.tables import cut


def numbered(df: DataFrame, order: str | Column, name: str = "_n", by: str | None = None, buckets: int = 64) -> DataFrame:
    """``df`` with places 0, 1, ... in ``order`` (a unique numeric key). Rows are counted in ranges of the key first, so no task gets them all."""
    key = F.col(order) if isinstance(order, str) else order
    x, inside = df.withColumn("_key", key), ["_b"] if by is None else ["_b", by]
    marks = x.select(F.percentile_approx("_key", [k / buckets for k in range(1, buckets)], 10_000).alias("_m"))
    x = x.crossJoin(F.broadcast(marks)).withColumn("_b", F.size(F.filter("_m", lambda v: v < F.col("_key")))).drop("_m")
    before = x.groupBy(*inside).agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy(*inside[1:]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*[F.col(c).alias(f"_p{j}") for j, c in enumerate(inside)], F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_o"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p{j}")) for j, c in enumerate(inside)])
    x = x.join(F.broadcast(before) if by is None else before, same)
    x = x.withColumn(name, (F.row_number().over(Window.partitionBy(*inside).orderBy("_key")) - 1 + F.col("_o")).cast("long"))
    return x.select(*df.columns, name)


def shuffled(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def _fold(place: Column, n: Column, k: int) -> Column:
    """Contiguous folds; the first n % k have one row more."""
    q, r = F.floor(n / k), n % k
    return F.when(place < r * (q + 1), F.floor(place / (q + 1))).otherwise(r + F.floor((place - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")


def k_fold(df: DataFrame, key: str, k: int = 5, seed: int | None = None) -> DataFrame:
    n = df.count()
    if not 2 <= k <= n:
        raise ValueError("folds must be at least 2 and at most the rows")
    return numbered(df, key if seed is None else shuffled(key, seed)).withColumn("fold", _fold(F.col("_n"), F.lit(n), k)).drop("_n")


def repeated_k_fold(df: DataFrame, key: str, k: int = 5, repeats: int = 10, seed: int = 0) -> DataFrame:
    """Columns fold_0, fold_1, ..."""
    out = df
    for r in range(repeats):
        out = k_fold(out, key, k, seed + r).withColumnRenamed("fold", f"fold_{r}")
    return out


def repeated_stratified_k_fold(df: DataFrame, key: str, y: str, k: int = 5, repeats: int = 10, seed: int = 0) -> DataFrame:
    """Columns fold_0, fold_1, ..."""
    out = df
    for r in range(repeats):
        out = stratified_k_fold(out, key, y, k, seed + r).withColumnRenamed("fold", f"fold_{r}")
    return out


def stratified_k_fold(df: DataFrame, key: str, y: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """Folds of each class; where a class leaves a remainder, the extra rows go to folds after those of the class before."""
    counts = sorted((r[0], r[1]) for r in df.groupBy(y).count().collect())  # a row for each class
    rows, start = [], 0
    for c, n in counts:
        rows.append((c, n, start))
        start = (start + n % k) % k
    table = F.broadcast(df.sparkSession.createDataFrame(rows, df.select(y).schema.add("_c", T.LongType()).add("_s", T.IntegerType())))
    x = numbered(df, key if seed is None else shuffled(key, seed), by=y).join(table, y)
    # extra rows rotate: fold (s + j) % k is the j-th largest
    return x.withColumn("fold", ((_fold(F.col("_n"), F.col("_c"), k) + F.col("_s")) % k).cast("int")).select(*df.columns, "fold")


def _turns(load: list[float], step: float, n: int) -> list[tuple[int, int, list[int]]]:
    """How ``n`` equal groups are dealt, each to the fold of least load (the first of equals), which then grows by ``step``: (first, last + 1, folds that take turns).
    Folds join the turns as the others reach their load, so there are at most as many parts as folds. ``load`` is updated."""
    out, at = [], 0
    while at < n:
        least = min((v, f) for f, v in enumerate(load))
        turn = sorted((v, f) for f, v in enumerate(load) if (v, f) < (least[0] + step, least[1]))
        rounds = -(-(n - at) // len(turn))
        for f, v in enumerate(load):
            if (v, f) not in turn:
                wait = max(1, int((v - least[0]) // step) - 1)
                while (v, f) >= (least[0] + (wait + 1) * step, least[1]):
                    wait += 1
                rounds = min(rounds, wait)
        end = min(n, at + rounds * len(turn))
        out.append((at, end, [f for _, f in turn]))
        for j, (_, f) in enumerate(turn):
            load[f] += step * ((end - at - j + len(turn) - 1) // len(turn))
        at = end
    return out


def _dealt(df: DataFrame, groups: DataFrame, group: str, parts: list[tuple]) -> DataFrame:
    """``df`` with ``fold``: ``groups`` (a row each) of one kind are numbered in their order, and ``parts`` (kind, first, last + 1, folds) say where they go."""
    table = df.sparkSession.createDataFrame(parts, "_kind long, _a long, _e long, _folds array<int>")
    place = numbered(groups, group, by="_kind")
    found = place.join(F.broadcast(table), (place["_kind"] == table["_kind"]) & (F.col("_n") >= F.col("_a")) & (F.col("_n") < F.col("_e")))
    fold = F.element_at("_folds", (F.pmod(F.col("_n") - F.col("_a"), F.size("_folds")) + 1).cast("int")).alias("fold")
    return df.join(found.select(F.col(group), fold), group)


def group_k_fold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Whole groups (numeric keys) to the lightest fold, the largest first (ties by group). The driver gets a row for each distinct *size* of a group; groups of one size are
    numbered in Spark and take turns."""
    sizes = cut(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_kind")))
    load, parts = [0] * k, []
    for n, c in sorted(((r[0], r[1]) for r in sizes.groupBy("_kind").count().collect()), reverse=True):
        parts += [(n, a, e, f) for a, e, f in _turns(load, n, c)]
    return _dealt(df, sizes, group, parts)


def _least_deviation(batches: Iterator[pa.RecordBatch], k: int, share: list[float]) -> Iterator[pa.RecordBatch]:
    load = np.zeros((k, len(share))) - share
    for batch in batches:
        counts = np.stack([c.to_numpy() for c in batch.columns[1:]], 1).astype(float)
        folds = []
        for c in counts:
            f = int(((load + c) ** 2).sum(1).argmin())
            load[f] += c
            folds.append(f)
        yield pa.record_batch([batch.column(0), pa.array(folds, pa.int32())], names=["_g", "fold"])


def stratified_group_k_fold(df: DataFrame, group: str, y: str, k: int = 5) -> DataFrame:
    """Whole groups, the largest first (ties by group), to the fold whose class counts then have the least squared deviation from an even share, the first of equals.

    Each choice depends on all before, so the groups' counts (a row each) stream in order through one task, which holds the folds' counts only; nothing is collected."""
    classes = sorted(r[0] for r in df.select(y).distinct().collect())
    names = [f"_c{i}" for i in range(len(classes))]
    table = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(*[F.count_if(F.col(y).eqNullSafe(F.lit(c))).alias(n) for n, c in zip(names, classes, strict=True)])
    table = cut(table)
    total = table.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first()
    size = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    kind = T.StructType([T.StructField("_g", table.schema["_g"].dataType), T.StructField("fold", T.IntegerType())])
    folds = table.repartition(1).sortWithinPartitions(size.desc(), "_g").mapInArrow(partial(_least_deviation, k=k, share=[t / k for t in total]), kind)
    return df.join(folds, F.col(group) == F.col("_g")).select(*df.columns, "fold")


def train_test_split(df: DataFrame, key: str, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """``df`` with a boolean ``test``: round(n * test_size) rows, at least one on each side."""
    n = df.count()
    m = min(max(int(n * test_size + 0.5), 1), n - 1)
    return numbered(df, shuffled(key, seed)).withColumn("test", F.col("_n") >= n - m).drop("_n")


def shuffle_split(df: DataFrame, key: str, n_splits: int = 10, test_size: float = 0.1, seed: int = 0, y: str | None = None) -> DataFrame:
    """Booleans test_0, test_1, ...; with ``y`` rounded within each class."""
    n, out = df.count(), df
    for s in range(n_splits):
        x = numbered(out, shuffled(key, seed + s), by=y)
        if y is None:
            size = F.lit(int(n * test_size + 0.5))
        else:
            sizes = out.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("_c"))
            x = x.join(sizes, F.col(y).eqNullSafe(F.col("_y")))
            size = F.greatest(F.lit(1), F.least(F.col("_c") - 1, F.floor(F.col("_c") * test_size + 0.5)))
        out = x.withColumn(f"test_{s}", F.col("_n") < size).select(*out.columns, f"test_{s}")
    return out


def group_shuffle_split(df: DataFrame, group: str, n_splits: int = 5, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    g = df.select(group).distinct()
    return df.join(shuffle_split(g, group, n_splits, test_size, seed), group)


def leave_one_out(n: int) -> list[tuple[int, ...]]:
    return [(i,) for i in range(n)]


def leave_p_out(n: int, p: int):
    """Test places of every split, one after the other."""
    return itertools.combinations(range(n), p)


def leave_one_group_out(df: DataFrame, group: str) -> list:
    return sorted(r[0] for r in df.select(group).distinct().collect())


def leave_p_groups_out(df: DataFrame, group: str, p: int) -> list[tuple]:
    return list(itertools.combinations(leave_one_group_out(df, group), p))


def predefined_split(df: DataFrame, fold: str) -> list[int]:
    """Folds of a column; -1 is always in training."""
    return sorted(r[0] for r in df.select(fold).where(F.col(fold) >= 0).distinct().collect())


def time_series_split(df: DataFrame, order: str, k: int = 5, max_train: int | None = None, test_size: int | None = None, gap: int = 0) -> DataFrame:
    """``df`` with train_0, test_0, ...: expanding windows, each followed by its test rows."""
    n = df.count()
    t = test_size or n // (k + 1)
    x = numbered(df, order)
    out = {}
    for s in range(k):
        start = n - (k - s) * t
        end = start - gap
        if end <= 0:
            raise ValueError("too many splits for the rows")
        low = max(0, end - max_train) if max_train else 0
        out |= {f"train_{s}": (F.col("_n") >= low) & (F.col("_n") < end), f"test_{s}": (F.col("_n") >= start) & (F.col("_n") < start + t)}
    return x.withColumns(out).drop("_n")


# --- cross-validation and searches --------------------------------------------

#: Fits on a DataFrame and returns a function that adds a prediction column.
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def cross_val_predict(df: DataFrame, fit: Fit, folds: list[int], fold: str = "fold") -> DataFrame:
    """Each row predicted by the model that didn't see its fold."""
    out = None
    for f in folds:
        part = fit(df.where(F.col(fold) != f))(df.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def cross_val_score(df: DataFrame, fit: Fit, score: Callable[[DataFrame], float], folds: list[int], fold: str = "fold") -> list[float]:
    return [score(fit(df.where(F.col(fold) != f))(df.where(F.col(fold) == f))) for f in folds]


def cross_validate(df: DataFrame, fit: Fit, score, folds: list[int], fold: str = "fold") -> dict[str, list[float]]:
    import time

    out: dict[str, list[float]] = {"test_score": [], "train_score": [], "fit_time": [], "score_time": []}
    for f in folds:
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        a = time.perf_counter()
        m = fit(train)
        b = time.perf_counter()
        out["test_score"].append(score(m(test)))
        out["train_score"].append(score(m(train)))
        out["fit_time"].append(b - a)
        out["score_time"].append(time.perf_counter() - b)
    return out


def permutation_test_score(df: DataFrame, fit: Fit, score, folds: list[int], key: str, y: str, permutations: int = 20, seed: int = 0) -> tuple[float, list[float], float]:
    real = sum(cross_val_score(df, fit, score, folds)) / len(folds)
    perm = []
    for p in range(permutations):
        s = cross_val_score(shuffle_column(df, y, key, seed + p), fit, score, folds)
        perm.append(sum(s) / len(folds))
    return real, perm, (sum(x >= real for x in perm) + 1) / (permutations + 1)


def param_grid(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]


class Uniform:
    def __init__(self, low: float, high: float):
        self.low, self.high = low, high

    def sample(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)


class LogUniform(Uniform):
    def sample(self, rng: random.Random) -> float:
        import math

        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


class IntUniform(Uniform):
    def sample(self, rng: random.Random) -> int:
        return rng.randint(int(self.low), int(self.high))


class Choice:
    def __init__(self, values: list):
        self.values = values

    def sample(self, rng: random.Random):
        return rng.choice(self.values)


def sampled(distributions: dict, n: int, seed: int = 0) -> list[dict]:
    rng = random.Random(seed)
    return [{k: d.sample(rng) for k, d in distributions.items()} for _ in range(n)]


def search(df: DataFrame, fit: Callable[..., Fit], candidates: list[dict], score, folds: list[int]) -> tuple[dict, list[tuple[dict, float, list[float]]]]:
    """The best candidate and (parameters, mean, scores) of all; ``fit(**parameters)`` makes a Fit."""
    rows = []
    for c in candidates:
        s = cross_val_score(df, fit(**c), score, folds)
        rows.append((c, sum(s) / len(s), s))
    return max(rows, key=lambda r: r[1])[0], rows


def halving_search(df: DataFrame, key: str, fit: Callable[..., Fit], candidates: list[dict], score, folds: list[int], smallest: int, factor: int = 3) -> dict:
    """Candidates are scored on the first rows in order of ``key``; a third stays, on three times the rows."""
    n, budget, left = df.count(), smallest, list(candidates)
    x = numbered(df, key)
    while True:
        best, rows = search(x.where(F.col("_n") < min(budget, n)).drop("_n"), fit, left, score, folds)
        if len(left) == 1 or budget >= n:
            return best
        rows.sort(key=lambda r: -r[1])
        left, budget = [r[0] for r in rows[: -(-len(left) // factor)]], budget * factor


def learning_curve(df: DataFrame, key: str, fit: Fit, score, folds: list[int], fractions=(0.1, 0.33, 0.55, 0.78, 1.0)) -> list[tuple[float, list[float], list[float]]]:
    n, x, out = df.count(), numbered(df, key), []
    for f in fractions:
        part = x.where(F.col("_n") < int(n * f)).drop("_n")
        r = cross_validate(part, fit, score, folds)
        out.append((f, r["train_score"], r["test_score"]))
    return out


def validation_curve(df: DataFrame, fit: Callable[..., Fit], name: str, values: list, score, folds: list[int]) -> list[tuple]:
    return [(v, (r := cross_validate(df, fit(**{name: v}), score, folds))["train_score"], r["test_score"]) for v in values]


# --- inspection ---------------------------------------------------------------


def partial_dependence(df: DataFrame, predict: Callable[[], Column], feature: str, grid: list[float]) -> DataFrame:
    """(value, mean prediction): one aggregate for the whole grid."""
    aggs = [F.avg(_with(df, feature, v, predict)).alias(f"p{i}") for i, v in enumerate(grid)]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(float(v)).alias("value"), F.col(f"p{i}").alias("mean_prediction")) for i, v in enumerate(grid)])))


def _with(df: DataFrame, feature: str, value: float, predict: Callable[[str | None, float | None], Column]) -> Column:
    return predict({feature: F.lit(float(value))})


def shuffle_column(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """``df`` with the values of ``column`` dealt anew: the row at place n in order of the key gets the value at place n in a hashed order."""
    a = numbered(df.drop(column), key)
    b = numbered(df.select(key, column), shuffled(key, seed)).select("_n", column)
    return a.join(b, "_n").select(*df.columns)


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], float], features: list[str], key: str, repeats: int = 5, seed: int = 0) -> dict[str, list[float]]:
    base = score(df)
    return {c: [base - score(shuffle_column(df, c, key, seed + j * repeats + r)) for r in range(repeats)] for j, c in enumerate(features)}


# --- dummies, thresholds, calibration -----------------------------------------


def dummy_classifier(df: DataFrame, y: str, strategy: str = "prior", constant=None, key: str | None = None, seed: int = 0) -> Column:
    counts = sorted((r[0], r[1]) for r in df.groupBy(y).count().collect())
    if strategy in ("most_frequent", "prior"):
        return F.lit(max(counts, key=lambda r: r[1])[0])
    if strategy == "constant":
        return F.lit(constant)
    u = F.pmod(shuffled(key, seed), F.lit(1 << 30)) / (1 << 30)
    total, edge, out = sum(n for _, n in counts), 0.0, F.lit(counts[-1][0])
    cuts = []
    for c, n in counts[:-1]:
        edge += n / total if strategy == "stratified" else 1 / len(counts)
        cuts.append((edge, c))
    for e, c in reversed(cuts):
        out = F.when(u < e, F.lit(c)).otherwise(out)
    return out


def dummy_regressor(df: DataFrame, y: str, strategy: str = "mean", quantile: float = 0.5, constant: float = 0.0) -> Column:
    f = {"mean": F.avg(y), "median": F.percentile(y, F.lit(0.5)), "quantile": F.percentile(y, F.lit(quantile))}
    return F.lit(constant if strategy == "constant" else df.agg(f[strategy]).first()[0])


def fixed_threshold(score: Column, threshold: float = 0.5) -> Column:
    return (score >= threshold).cast("int")


def tuned_threshold(df: DataFrame, y: str, score: str, measure: Callable[[Column, Column, Column, Column], Column], grid: list[float] | None = None) -> float:
    """The threshold of the grid with the best ``measure(tp, fp, fn, tn)``; all are counted in one pass."""
    grid = grid or [k / 20 for k in range(21)]
    t = F.col(y) == 1
    aggs = []
    for g in grid:
        p = F.col(score) >= g
        n = lambda q: F.sum(q.cast("double"))
        aggs.append(measure(n(t & p), n(~t & p), n(t & ~p), n(~t & ~p)))
    r = df.agg(*aggs).first()
    return grid[max(range(len(grid)), key=lambda i: (r[i] if r[i] is not None else float("-inf"), -i))]


def platt(df: DataFrame, y: str, score: str, max_iter: int = 50) -> Column:
    """Calibrated probability: a sigmoid of the score fitted to the smoothed targets by Newton steps, each one aggregate."""
    pos, neg = df.agg(F.sum((F.col(y) == 1).cast("double")), F.sum((F.col(y) != 1).cast("double"))).first()
    t = F.when(F.col(y) == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    a, b, s = 0.0, 0.0, present(F.col(score))
    for _ in range(max_iter):
        p = 1 / (1 + F.exp(-(s * a + b)))
        w = p * (1 - p)
        g0, g1, h00, h01, h11 = df.agg(F.sum((p - t) * s), F.sum(p - t), F.sum(w * s * s), F.sum(w * s), F.sum(w)).first()
        det = (h00 + 1e-12) * (h11 + 1e-12) - h01 * h01
        da, db = ((h11 + 1e-12) * g0 - h01 * g1) / det, ((h00 + 1e-12) * g1 - h01 * g0) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-10:
            break
    return 1 / (1 + F.exp(-(F.col(score) * a + b)))
