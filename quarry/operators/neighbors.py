"""Neighbours, distances and kernels between a table of queries and a table of points.

Vectors are array<double> columns. Exact search compares queries with all points: both are packed into blocks
of rows (a matrix in one row), each pair of blocks gives each query its nearest few, and these are merged, so neither
all pairs nor all points are ever in one place, and nothing passes through the driver. Range search in few dimensions joins on grid cells instead.
Ties in distance are broken by the points' ids.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a packed block at most, and its numbers.
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 18


def vector(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _add(f, x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda a, b: a + b)


def inner(x: Column, y: Column) -> Column:
    return _add(lambda a, b: a * b, x, y)


def squared(x: Column, y: Column) -> Column:
    return _add(lambda a, b: (a - b) * (a - b), x, y)


#: Distances of two array columns.
DISTANCES = {
    "euclidean": lambda x, y: F.sqrt(squared(x, y)),
    "manhattan": lambda x, y: _add(lambda a, b: F.abs(a - b), x, y),
    "chebyshev": lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b)),
    "cosine": lambda x, y: 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(inner(x, x) * inner(y, y) == 0, 0.0).otherwise(inner(x, y) / F.sqrt(inner(x, x) * inner(y, y))))),
}


def nan_euclidean(x: Column, y: Column) -> Column:
    """Over the places present in both, scaled to all; NaN if there is none."""
    d = F.filter(F.zip_with(x, y, lambda a, b: F.when(~F.isnan(a) & ~F.isnan(b), (a - b) * (a - b))), lambda v: v.isNotNull())
    return F.when(F.size(d) == 0, float("nan")).otherwise(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, b: a + b) * F.size(x) / F.size(d)))


def kernel(name: str, x: Column, y: Column, gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> Column:
    """linear, polynomial, rbf, sigmoid, laplacian or cosine."""
    return {
        "linear": lambda: inner(x, y),
        "polynomial": lambda: F.pow(gamma * inner(x, y) + coef0, F.lit(degree)),
        "rbf": lambda: F.exp(-gamma * squared(x, y)),
        "sigmoid": lambda: F.tanh(gamma * inner(x, y) + coef0),
        "laplacian": lambda: F.exp(-gamma * DISTANCES["manhattan"](x, y)),
        "cosine": lambda: 1 - DISTANCES["cosine"](x, y),
    }[name]()


#: Covariance kernels of Gaussian processes as functions of the squared distance (and the inner product).
GP_KERNELS = {
    "rbf": lambda d2, ip, ell=1.0: F.exp(-d2 / (2 * ell * ell)),
    "matern12": lambda d2, ip, ell=1.0: F.exp(-F.sqrt(d2) / ell),
    "matern32": lambda d2, ip, ell=1.0: (1 + F.sqrt(3 * d2) / ell) * F.exp(-F.sqrt(3 * d2) / ell),
    "matern52": lambda d2, ip, ell=1.0: (1 + F.sqrt(5 * d2) / ell + 5 * d2 / (3 * ell * ell)) * F.exp(-F.sqrt(5 * d2) / ell),
    "constant": lambda d2, ip, c=1.0: F.lit(c),
    "white": lambda d2, ip, noise=1.0: F.when(d2 == 0, noise).otherwise(0.0),
    "dot": lambda d2, ip, sigma=1.0: sigma * sigma + ip,
}

#: Smoothing kernels of one scaled difference.
SMOOTHERS = {
    "gaussian": lambda u: F.exp(-u * u / 2) / np.sqrt(2 * np.pi),
    "epanechnikov": lambda u: F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0),
    "tricube": lambda u: F.when(F.abs(u) <= 1, 70 / 81 * F.pow(1 - F.pow(F.abs(u), 3), 3)).otherwise(0.0),
    "biweight": lambda u: F.when(F.abs(u) <= 1, 15 / 16 * F.pow(1 - u * u, 2)).otherwise(0.0),
    "triweight": lambda u: F.when(F.abs(u) <= 1, 35 / 32 * F.pow(1 - u * u, 3)).otherwise(0.0),
    "uniform": lambda u: F.when(F.abs(u) <= 1, 0.5).otherwise(0.0),
    "cosine": lambda u: F.when(F.abs(u) <= 1, np.pi / 4 * F.cos(np.pi / 2 * u)).otherwise(0.0),
}


def pairwise(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """(i, j, value) of all rows of ``a`` (i, x) and ``b`` (j, y): the matrix is the result, so its size is the only limit. Both sides are dealt over the cores,
    and Spark broadcasts the smaller one only if it is below its own threshold."""
    parts = 2 * a.sparkSession.sparkContext.defaultParallelism
    return a.repartition(parts).crossJoin(b.repartition(parts)).select("i", "j", f(F.col("x"), F.col("y")).alias("value"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) as blocks: ids and a matrix as bytes. A null in a vector is NaN."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1)
        ids = batch.column(0).to_numpy()
        size = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, values.shape[1])))
        for at in range(0, n, size):
            yield pa.record_batch([pa.array([ids[at : at + size].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(values[at : at + size]).tobytes()], pa.binary())], names=["ids", "rows"])


def in_blocks(queries: DataFrame, points: DataFrame, f, schema: str) -> DataFrame:
    """The rows of ``f(query ids, query matrix, point ids, point matrix)`` (a list of columns) for every pair of blocks of ``queries`` (i long, x) and ``points`` (j long, y)."""
    kind = "{0}_ids binary, {0}_rows binary"
    pack = lambda df, side: df.mapInArrow(lambda it: (b.rename_columns([f"{side}_ids", f"{side}_rows"]) for b in _packed(it)), kind.format(side))
    names = [c.split()[0] for c in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qx, pj, py in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, j = np.frombuffer(qi, np.int64), np.frombuffer(pj, np.int64)
                columns = f(i, np.frombuffer(qx).reshape(len(i), -1), j, np.frombuffer(py).reshape(len(j), -1))
                if len(columns[0]):
                    yield pa.record_batch([pa.array(c) for c in columns], names=names)

    return pack(queries, "q").crossJoin(pack(points, "p")).mapInArrow(go, schema)


def _nearest(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each query the ``k`` nearest points of one block, ties by id: i, j, distance."""
    out: list[list[np.ndarray]] = []
    norms = (y * y).sum(1)
    for at in range(0, len(i), 256):
        q = x[at : at + 256]
        near = np.maximum(norms + (q * q).sum(1)[:, None] - 2 * q @ y.T, 0)
        m = min(k, len(j))
        # a few more than k by the fast formula; exact distances then decide
        wide = min(len(j), m + 8)
        edge = np.partition(near, wide - 1, axis=1)[:, wide - 1]
        for r in range(len(q)):
            c = np.flatnonzero(near[r] <= edge[r] * (1 + 1e-9) + 1e-12)
            d = np.sqrt(((y[c] - q[r]) ** 2).sum(1))
            best = np.lexsort((j[c], d))[:m]
            out.append([np.full(m, i[at + r]), j[c[best]], d[best]])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def knn(queries: DataFrame, points: DataFrame, k: int = 5, exclude_self: bool = False) -> DataFrame:
    """(i, j, distance, rank): the ``k`` nearest of ``points`` (j long, y) to each of ``queries`` (i long, x), Euclidean and exact."""
    wanted = k + exclude_self
    found = in_blocks(queries.select(F.col("i").cast("long"), "x"), points.select(F.col("j").cast("long"), "y"), lambda i, x, j, y: _nearest(i, x, j, y, wanted), "i long, j long, distance double")
    if exclude_self:
        found = found.where("i <> j")
    w = Window.partitionBy("i").orderBy("distance", "j")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def radius_join(a: DataFrame, b: DataFrame, radius: float, columns: list[str]) -> DataFrame:
    """(i, j, distance) of rows of ``a`` (i, columns) and ``b`` (j, columns) at most ``radius`` apart: an equi-join on grid cells of that width.
    Each row of ``b`` goes to the 3 ** d cells around its own."""
    cell = lambda c: F.floor(F.col(c) / radius)
    left = a.select("i", *[F.col(c).alias(f"x_{c}") for c in columns], F.array(*[cell(c) for c in columns]).alias("cell"))
    around = F.array(*[F.array(*[cell(c) + s for c, s in zip(columns, shift, strict=True)]) for shift in itertools.product((-1, 0, 1), repeat=len(columns))])
    right = b.select("j", *[F.col(c).alias(f"y_{c}") for c in columns], F.explode(around).alias("cell"))
    d = F.sqrt(reduce(lambda p, q: p + q, [(F.col(f"x_{c}") - F.col(f"y_{c}")) ** 2 for c in columns]))
    return left.join(right, "cell").select("i", "j", d.alias("distance")).where(F.col("distance") <= radius)


def _weights(uniform: bool) -> Column:
    """Inverse distances; where some distance is 0, only those count."""
    if uniform:
        return F.lit(1.0)
    zero = F.min("distance").over(Window.partitionBy("i")) < 1e-15
    return F.when(zero, (F.col("distance") < 1e-15).cast("double")).otherwise(1 / F.col("distance"))


def vote(neighbors: DataFrame, labels: DataFrame, uniform: bool = True) -> DataFrame:
    """(i, prediction): the label with the most weight among the neighbours, the lowest of equals. ``labels``: (j, label)."""
    w = neighbors.withColumn("w", _weights(uniform)).join(labels, "j").groupBy("i", "label").agg(F.sum("w").alias("w"))
    return w.groupBy("i").agg(F.max(F.struct("w", (-F.col("label")).alias("m"))).alias("b")).select("i", (-F.col("b.m")).alias("prediction"))


def average(neighbors: DataFrame, targets: DataFrame, uniform: bool = True) -> DataFrame:
    """(i, prediction): the weighted mean of the neighbours' targets. ``targets``: (j, y)."""
    x = neighbors.withColumn("w", _weights(uniform)).join(targets, "j")
    return x.groupBy("i").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))


def local_outlier_factor(points: DataFrame, k: int = 20) -> DataFrame:
    """(i, lof) of ``points`` (i, x) from their exact neighbours; joins on ids only."""
    n = knn(points, points.select(F.col("i").alias("j"), F.col("x").alias("y")), k, exclude_self=True)
    kd = n.groupBy("i").agg(F.max("distance").alias("kd"))
    reach = n.join(kd.select(F.col("i").alias("j"), "kd"), "j").groupBy("i").agg(F.sum(F.greatest("distance", "kd")).alias("s"), F.count("*").alias("m"))
    lrd = reach.select("i", F.when(F.col("s") < 1e-15, 1e10).otherwise(F.col("m") / F.col("s")).alias("lrd"))
    return n.join(lrd.select(F.col("i").alias("j"), F.col("lrd").alias("r")), "j").groupBy("i").agg(F.avg("r").alias("r")).join(lrd, "i").select("i", (F.col("r") / F.col("lrd")).alias("lof"))


def nearest_centroid(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """``df`` with ``prediction``: the class of the nearest mean, the first of equals."""
    c = sorted(df.groupBy(y).agg(*[F.avg(f) for f in features]).collect())  # a row for each class
    d = F.array(*[reduce(lambda a, b: a + b, [(F.col(f) - m) ** 2 for f, m in zip(features, r[1:], strict=True)]) for r in c])
    return df.withColumn("prediction", F.element_at(F.array(*[F.lit(r[0]) for r in c]), F.array_position(d, F.array_min(d)).cast("int")))


def nadaraya_watson(queries: DataFrame, train: DataFrame, bandwidth: float, kernel_name: str = "gaussian", most: int = 20_000) -> DataFrame:
    """(i, prediction): kernel-weighted mean of the targets of ``train`` (u, y) at ``queries`` (i, x). The smaller side is broadcast after a check of its size."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} points to predict at once")
    k = SMOOTHERS[kernel_name]((F.col("x") - F.col("u")) / bandwidth)
    return train.crossJoin(F.broadcast(queries)).groupBy("i").agg((F.sum(k * F.col("y")) / F.sum(k)).alias("prediction"))


def silverman(df: DataFrame, x: str) -> float:
    """1.06 n^(-1/5) min(std, IQR / 1.349); 1 where both are 0."""
    n, sd, q = df.agg(F.count(x), F.stddev_samp(x), F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))).first()
    spread = min([v for v in (sd, (q[1] - q[0]) / 1.349) if v], default=0)
    return 1.06 * n**-0.2 * spread if spread else 1.0


def scott(df: DataFrame, x: str, d: int = 1) -> float:
    n, sd = df.agg(F.count(x), F.stddev_samp(x)).first()
    return sd * n ** (-1 / (d + 4)) if sd else 1.0


def hat_matrix(df: DataFrame, key: str, u: str, y: str, bandwidth: float, kernel_name: str = "gaussian", most: int = 20_000) -> DataFrame:
    """(key, y, prediction, hat, left_out) of every row smoothed by all: ``hat`` is the weight of its own target, and ``left_out`` the prediction without it,
    (prediction - hat y) / (1 - hat). All pairs are compared, so there may be at most ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} rows")
    f = SMOOTHERS[kernel_name]
    q = df.select(F.col(key).alias("_i"), F.col(u).alias("_x"), F.col(y).alias("_y"))
    k = f((F.col("_x") - F.col(u)) / bandwidth)
    s = df.crossJoin(F.broadcast(q)).groupBy("_i", "_y").agg(F.sum(k).alias("_s"), F.sum(k * F.col(y)).alias("_p"))
    hat = f(F.lit(0.0)) / F.col("_s")
    p = F.col("_p") / F.col("_s")
    return s.select(F.col("_i").alias(key), F.col("_y").alias(y), p.alias("prediction"), hat.alias("hat"), F.when(hat < 1, (p - hat * F.col("_y")) / (1 - hat)).alias("left_out"))


def effective_df(hat: DataFrame) -> float:
    """The trace of the smoother."""
    return hat.agg(F.sum("hat")).first()[0]


def cross_validated_bandwidth(df: DataFrame, key: str, u: str, y: str, grid: list[float], kernel_name: str = "gaussian", most: int = 20_000) -> tuple[float, list[float]]:
    """The bandwidth of the smallest mean squared error of left-out predictions (the smallest of equals), and the errors of all; rows that no other row reaches don't count,
    and a bandwidth by which none is reached has an infinite error."""
    errors = []
    for h in grid:
        e = hat_matrix(df, key, u, y, h, kernel_name, most).agg(F.avg((F.col(y) - F.col("left_out")) ** 2)).first()[0]
        errors.append(float("inf") if e is None else e)
    return grid[int(np.argmin(errors))], errors


def neighbors_graph(pairs: DataFrame, mode: str = "connectivity") -> DataFrame:
    """A triplet matrix (row, col, val) of pairs (i, j, distance), as knn and radius_join give them: ones or distances."""
    if mode not in ("connectivity", "distance"):
        raise ValueError("mode must be connectivity or distance")
    return pairs.select(F.col("i").alias("row"), F.col("j").alias("col"), (F.lit(1.0) if mode == "connectivity" else F.col("distance")).alias("val"))


def local_polynomial(queries: DataFrame, train: DataFrame, bandwidth: float, order: int = 1, kernel_name: str = "gaussian", reg: float = 1e-10, most: int = 20_000) -> DataFrame:
    """(i, prediction): the weighted polynomial of ``order`` through ``train`` (u, y) around each of ``queries`` (i, x); one pass for the moments, small solves where the
    queries are. Null where no row is reached."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} points to predict at once")
    d = (F.col("u") - F.col("x")) / bandwidth
    w = SMOOTHERS[kernel_name](d)
    sums = [F.sum(w * F.pow(d, F.lit(k))).alias(f"m{k}") for k in range(2 * order + 1)] + [F.sum(w * F.col("y") * F.pow(d, F.lit(k))).alias(f"t{k}") for k in range(order + 1)]
    s = train.crossJoin(F.broadcast(queries)).groupBy("i").agg(*sums)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]])
            out = []
            for r in v:
                a = np.array([[r[i + j] for j in range(order + 1)] for i in range(order + 1)]) + reg * np.eye(order + 1)
                out.append(float(np.linalg.solve(a, r[2 * order + 1 :])[0]) if r[0] > 0 else None)
            yield pa.record_batch([b.column(0), pa.array(out, pa.float64())], names=["i", "prediction"])

    return s.mapInArrow(solve, f"i {queries.schema['i'].dataType.simpleString()}, prediction double")
