"""Clustering, mixtures, graphs and label propagation on DataFrames.

Each round of an iterative algorithm is one aggregate over the data against a small model, or one join of an edge table; models of cluster
centres are the only things that reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.tables import cut
from quarry.operators.neighbors import in_blocks, radius_join

#: Numbers that label propagation holds in memory at most, and values of one feature.
GRID, GRID_VALUES = 1 << 22, 4096


def _sum(xs):
    return reduce(lambda a, b: a + b, xs)


@dataclass
class Centers:
    features: list[str]
    centers: list[list[float]]
    inertia: float = 0.0
    rounds: int = 0

    def distances(self) -> Column:
        return F.array(*[_sum([(F.col(c) - float(m)) ** 2 for c, m in zip(self.features, v, strict=True)]) for v in self.centers])

    def predict(self) -> Column:
        """The nearest centre, the first of equals."""
        d = self.distances()
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def first_rows(df: DataFrame, features: list[str], key: str, k: int) -> list[list[float]]:
    """A reproducible start: the ``k`` smallest keys."""
    return [list(map(float, r)) for r in df.orderBy(key).select(*features).limit(k).collect()]


def kmeans_parallel(df: DataFrame, features: list[str], k: int, seed: int = 0, rounds: int = 4) -> list[list[float]]:
    """Oversampled start (each round keeps rows with probability proportional to their squared distance, about 2 k of them), reduced to ``k`` on the driver."""
    chosen = first_rows(df, features, features[0], 1)
    for r in range(rounds):
        d = F.array_min(Centers(features, chosen).distances())
        total = df.agg(F.sum(d)).first()[0]
        if not total:
            break
        more = df.where(F.rand(seed + r) < d * (2 * k / total)).select(*features).limit(20 * k).collect()
        chosen += [list(map(float, x)) for x in more]
    pts, rng = np.unique(np.array(chosen), axis=0), np.random.default_rng(seed)
    out = [pts[0]]
    while len(out) < min(k, len(pts)):
        d = np.min([((pts - c) ** 2).sum(1) for c in out], 0)
        out.append(pts[rng.choice(len(pts), p=d / d.sum())])
    return [list(map(float, c)) for c in out]


def kmeans(df: DataFrame, features: list[str], start: list[list[float]], max_iter: int = 300, tol: float = 1e-4) -> Centers:
    """Lloyd rounds until no centre moves by ``tol``; the inertia is that of the last assignment. An empty cluster keeps its centre."""
    m = Centers(features, [list(c) for c in start])
    for r in range(max_iter):
        d = m.distances()
        rows = df.select(*features, m.predict().alias("_k"), F.array_min(d).alias("_d")).groupBy("_k").agg(F.sum("_d").alias("d"), *[F.avg(c).alias(c) for c in features]).collect()
        new = [list(c) for c in m.centers]
        for x in rows:
            new[x["_k"]] = [x[c] for c in features]
        shift = max(math.dist(a, b) for a, b in zip(new, m.centers, strict=True))
        m = Centers(features, new, sum(x["d"] for x in rows), r + 1)
        if shift < tol:
            break
    return m


def mini_batch_kmeans(df: DataFrame, features: list[str], start: list[list[float]], fraction: float = 0.1, max_iter: int = 20, seed: int = 0, tol: float = 0.0) -> Centers:
    """Centres move towards the means of random batches with rates 1 / count."""
    m, counts = Centers(features, [list(c) for c in start]), [1.0] * len(start)
    for r in range(max_iter):
        rows = df.sample(fraction, seed + r).select(*features, m.predict().alias("_k")).groupBy("_k").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in features]).collect()
        new = [list(c) for c in m.centers]
        for x in rows:
            k = x["_k"]
            new[k] = [(counts[k] * v + x[c]) / (counts[k] + x["n"]) for c, v in zip(features, new[k], strict=True)]
            counts[k] += x["n"]
        shift = max(math.dist(a, b) for a, b in zip(new, m.centers, strict=True))
        m = Centers(features, new, 0.0, r + 1)
        if shift < tol:
            break
    return m


def bisecting_kmeans(df: DataFrame, features: list[str], k: int, largest_sse: bool = False) -> Centers:
    """Splits the cluster with the most rows (or the largest error) in two until there are ``k``."""
    m = Centers(features, [list(df.agg(*[F.avg(c) for c in features]).first())])
    while len(m.centers) < k:
        d = df.withColumns({"_k": m.predict(), "_d": F.array_min(m.distances())})
        worst = d.groupBy("_k").agg(F.count("*").alias("n"), F.sum("_d").alias("d")).orderBy(F.desc("d" if largest_sse else "n"), "_k").first()["_k"]
        part = d.where(F.col("_k") == worst)
        spread = np.array(part.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in features]).first(), float)
        c = np.array(m.centers[worst])
        two = kmeans(part, features, [list(c - spread / 2), list(c + spread / 2)], 50)
        m = Centers(features, [*m.centers[:worst], *two.centers, *m.centers[worst + 1 :]])
    return m


@dataclass
class Mixture:
    features: list[str]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    mean_log_likelihood: float
    rounds: int

    def log_densities(self) -> list[Column]:
        out = []
        for w, m, s in zip(self.weights, self.means, self.covariances, strict=True):
            p = np.linalg.inv(s)
            x = [F.col(c) - float(v) for c, v in zip(self.features, m, strict=True)]
            q = _sum([x[i] * x[j] * float(p[i, j]) for i in range(len(x)) for j in range(len(x))])
            out.append(F.lit(float(np.log(w) - 0.5 * (len(x) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1]))) - q / 2)
        return out

    def score_samples(self) -> Column:
        d = self.log_densities()
        top = F.greatest(*d) if len(d) > 1 else d[0]
        return top + F.log(_sum([F.exp(x - top) for x in d]))

    def predict(self) -> Column:
        a = F.array(*self.log_densities())
        return (F.array_position(a, F.array_max(a)) - 1).cast("int")

    def parameters(self, kind: str) -> int:
        k, d = self.means.shape
        return {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[kind] + k * d + k - 1

    def bic(self, n: int, kind: str = "full") -> float:
        return -2 * self.mean_log_likelihood * n + self.parameters(kind) * math.log(n)

    def aic(self, n: int, kind: str = "full") -> float:
        return -2 * self.mean_log_likelihood * n + 2 * self.parameters(kind)


def gaussian_mixture(df: DataFrame, features: list[str], start: list[list[float]], kind: str = "full", max_iter: int = 100, tol: float = 1e-3, reg: float = 1e-6, prior: float = 0.0) -> Mixture:
    """EM with one aggregate a round (weighted sums and products of each component); full, tied, diag or spherical covariances. ``prior`` is added to the component counts
    (a Dirichlet prior on the weights, which lets the weights of needless components shrink)."""
    k, d = len(start), len(features)
    base = np.diag(np.array(df.agg(*[F.var_pop(c) for c in features]).first(), float)) + reg * np.eye(d)
    m = Mixture(features, np.full(k, 1 / k), np.array(start, float), np.array([base] * k), -np.inf, 0)
    x = [F.col(c) for c in features]
    at = [(i, j) for i in range(d) for j in range(i, d)]
    for r in range(max_iter):
        total = m.score_samples()
        dens = m.log_densities()
        y = df.select(*features, total.alias("_ll"), *[F.exp(q - total).alias(f"_r{i}") for i, q in enumerate(dens)])
        aggs = [F.count("*"), F.avg("_ll")] + [f for i in range(k) for f in [F.sum(f"_r{i}"), *[F.sum(F.col(f"_r{i}") * v) for v in x], *[F.sum(F.col(f"_r{i}") * x[a] * x[b]) for a, b in at]]]
        v = y.agg(*aggs).first()
        n, ll, step = v[0], v[1], 1 + d + len(at)
        w, means, covs = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for i in range(k):
            part = v[2 + i * step : 2 + (i + 1) * step]
            w[i] = max(part[0], 1e-300)
            means[i] = np.array(part[1 : 1 + d]) / w[i]
            for (a, b), q in zip(at, part[1 + d :], strict=True):
                covs[i, a, b] = covs[i, b, a] = q / w[i] - means[i, a] * means[i, b]
        if kind == "tied":
            covs[:] = (covs * w[:, None, None]).sum(0) / w.sum()
        elif kind in ("diag", "spherical"):
            for i in range(k):
                g = np.diag(covs[i])
                covs[i] = np.diag(g if kind == "diag" else np.full(d, g.mean()))
        covs += reg * np.eye(d)
        weights = np.maximum(w + prior, 1e-10) / np.maximum(w + prior, 1e-10).sum()
        done = abs(ll - m.mean_log_likelihood) < tol
        m = Mixture(features, weights, means, covs, ll, r + 1)
        if done:
            break
    return m


def dbscan(df: DataFrame, features: list[str], key: str, eps: float, min_samples: int = 5) -> DataFrame:
    """(key, label): clusters of core points within ``eps`` of each other, numbered by their smallest key; border points go to the lowest-numbered cluster that reaches them, noise is -1.
    Rows of equal features are one place, counted and named by its smallest key, so that copies make no pairs. Neighbourhoods of places are a grid join in few dimensions;
    components are found by label joins."""
    pts = df.select(F.col(key).cast("long").alias("i"), *features)
    places = cut(pts.groupBy(*features).agg(F.min("i").alias("i"), F.count("*").alias("n")))
    near = cut(radius_join(places.select("i", *features), places.select(F.col("i").alias("j"), *features), eps, features).select("i", "j"))
    rows = places.select(F.col("i").alias("j"), "n")
    core = cut(near.join(rows, "j").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("i"))
    links = near.where("i < j").join(core, "i", "left_semi").join(core.withColumnRenamed("i", "j"), "j", "left_semi")
    comp = connected_components(links.select(F.col("i").alias("u"), F.col("j").alias("v")), core.select(F.col("i").alias("node")))
    number = comp.select("root").distinct().select("root", (F.dense_rank().over(Window.orderBy("root")) - 1).alias("label"))
    core_label = comp.join(number, "root").select(F.col("node").alias("j"), "label")
    reach = near.join(core_label, "j").groupBy("i").agg(F.min("label").alias("label"))
    own = core_label.withColumnRenamed("j", "i")
    lab = reach.join(own.withColumnRenamed("label", "own"), "i", "left").select("i", F.coalesce("own", "label").alias("label"))
    lab = places.drop("n").join(lab, "i").drop("i")
    return pts.join(lab, features, "left").select(F.col("i").alias(key), F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


# --- graphs -------------------------------------------------------------------


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_iter: int = 100) -> DataFrame:
    """(node, root): the smallest node of each component of undirected ``edges`` (u, v). Labels take the minimum over neighbours and then that of their label's node, so that
    the number of rounds is logarithmic on most graphs."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = cut(both)
    label = both.select(F.col("u").alias("node")).distinct()
    label = (label.unionByName(nodes).distinct() if nodes is not None else label).withColumn("root", F.col("node"))
    state = None
    for _ in range(max_iter):
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("m"))
        new = label.join(near, label["node"] == near["u"], "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("r2"))
        new = new.join(jump, "root", "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"))
        label = cut(new)
        now = label.agg(F.sum("root"), F.count_distinct("root")).first()
        if now == state:
            break
        state = now
    return label


def shortest_paths(edges: DataFrame, source: int, max_iter: int = 100) -> DataFrame:
    """(node, distance, predecessor) from ``source`` over weighted directed ``edges`` (u, v, w >= 0): rounds of relaxation until nothing improves."""
    spark = edges.sparkSession
    best = spark.createDataFrame([(source, 0.0, None)], "node long, distance double, predecessor long")
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    state = None
    for _ in range(max_iter):
        step = best.join(edges, F.col("node") == F.col("u")).select(F.col("v").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), F.col("u").alias("predecessor"))
        new = best.unionByName(step).groupBy("node").agg(F.min(F.struct("distance", "predecessor")).alias("b")).select("node", "b.distance", "b.predecessor")
        best = cut(new)
        now = best.agg(F.sum("distance"), F.count("*")).first()
        if now == state:
            break
        state = now
    return best


def all_pairs_shortest_paths(edges: DataFrame, max_iter: int = 100) -> DataFrame:
    """(source, node, distance) of every node that each source reaches over weighted directed ``edges`` (u, v, w >= 0): rounds of relaxation for all sources at once.
    The result has a row for each such pair."""
    edges = cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w")).groupBy("u", "v").agg(F.min("w").alias("w")))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    best = cut(nodes.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")))
    state = None
    for _ in range(max_iter):
        step = best.join(edges, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("distance") + F.col("w")).alias("distance"))
        best = cut(best.unionByName(step).groupBy("source", "node").agg(F.min("distance").alias("distance")))
        now = best.agg(F.sum("distance"), F.count("*")).first()
        if now == state:
            break
        state = now
    return best


def minimum_spanning_tree(edges: DataFrame, max_iter: int = 64) -> DataFrame:
    """(u, v, w) of a minimum spanning forest of undirected edges: in each round every component takes its cheapest edge (ties by w, u, v), and components merge."""
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))
    e = cut(e)
    chosen = None
    comp = e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("root", F.col("node"))
    for _ in range(max_iter):
        a, b = comp.select(F.col("node").alias("u"), F.col("root").alias("ru")), comp.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        out = e.join(a, "u").join(b, "v").where("ru <> rv")
        cheapest = out.select(F.col("ru").alias("r"), F.struct("w", "u", "v").alias("s")).unionByName(out.select(F.col("rv").alias("r"), F.struct("w", "u", "v").alias("s"))).groupBy("r").agg(F.min("s").alias("s"))
        new = cut(cheapest.select("s.u", "s.v", "s.w").distinct())
        if new.limit(1).count() == 0:
            break
        chosen = new if chosen is None else cut(chosen.unionByName(new).distinct())
        comp = connected_components(chosen.select("u", "v"), comp.select("node"))
    return chosen if chosen is not None else e.limit(0)


def _spread(n: np.ndarray, f: np.ndarray, r: np.ndarray, near: np.ndarray, alpha: float | None) -> tuple[np.ndarray, float]:
    """One round for places with ``n`` (places, states) rows, their values ``f`` (places, states, classes), scales ``r`` and sums ``near`` of all other places: new values and the squared change."""
    classes = f.shape[2]
    y = np.vstack([np.eye(classes), np.full((1, classes), 1 / classes)])
    r = r[:, None, None]
    others = np.maximum((n[:, :, None] * f).sum(1, keepdims=True) - f, 0) * r  # a row isn't its own neighbour
    new = near[:, None] + others
    if alpha is None:
        new[:, :classes] = y[:classes]
    else:
        new = alpha * r * new + (1 - alpha) * y
    z = new.sum(2, keepdims=True)
    new = np.divide(new, z, out=new, where=z > 0)
    return new, float((n * ((new - f) ** 2).sum(2)).sum())


def _scale(degree: np.ndarray, alpha: float | None) -> np.ndarray:
    """1 / sqrt(degree) for spreading; in propagation the sums of rows make up for it."""
    return np.ones(len(degree)) if alpha is None else np.divide(1, np.sqrt(degree), out=np.zeros(len(degree)), where=degree > 0)


def _spread_on_grid(x: np.ndarray, n: np.ndarray, gamma: float, max_iter: int, tol: float, alpha: float | None) -> np.ndarray:
    """The states' classes by place. A Gaussian is the product of one kernel for each feature, so sums over all places are one small product along each axis of the grid of
    feature values. Kernels have no diagonal: I x B0 + A0 x B, for A = I + A0, sums over the other places without a difference of large numbers."""
    found = [np.unique(c, return_inverse=True) for c in x.T]
    shape = tuple(len(u) for u, _ in found)
    cell = np.ravel_multi_index([i for _, i in found], shape)
    kernels = [np.exp(-gamma * (u[:, None] - u) ** 2) - np.eye(len(u)) for u, _ in found]

    def near(v):
        full = np.zeros((math.prod(shape), v.shape[1]))
        full[cell] = v
        full = full.reshape(*shape, -1)
        out = np.zeros_like(full)
        for axis in reversed(range(len(shape))):
            more = np.moveaxis(np.tensordot(kernels[axis], full, (1, axis)), 0, axis)
            out, full = out + more, full + more
        return out.reshape(-1, v.shape[1])[cell]

    classes = n.shape[1] - 1
    rows = n.sum(1)
    r = _scale(near(rows[:, None])[:, 0] + rows - 1, alpha)
    f = np.tile(np.vstack([np.eye(classes), np.full((1, classes), 1 / classes)]), (len(n), 1, 1))
    for _ in range(max_iter):
        f, change = _spread(n, f, r, near(r[:, None] * (n[:, :, None] * f).sum(1)), alpha)
        if math.sqrt(change) < tol:
            break
    return f.argmax(2)


def _spread_by_blocks(places: DataFrame, gamma: float, classes: int, max_iter: int, tol: float, alpha: float | None) -> DataFrame:
    """``places`` (x, n arrays) with ``best``, the states' classes: each round sums kernels over all pairs of packed blocks."""
    spark = places.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    states = classes + 1

    def near(state, width):
        def sums(i, x, j, y):
            x_j, v, out = y[:, : x.shape[1]], y[:, x.shape[1] :], []
            for at in range(0, len(i), 256):
                q = x[at : at + 256]
                w = np.exp(-gamma * sum((q[:, k, None] - x_j[:, k]) ** 2 for k in range(x.shape[1])))
                out.append((w * (i[at : at + 256, None] != j)) @ v)
            return [i, list(np.concatenate(out))]

        s = in_blocks(state.select("i", "x").repartition(parts), state.select(F.col("i").alias("j"), F.concat("x", "v").alias("y")).repartition(parts), sums, "i long, v array<double>")
        return s.groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("near"))

    schema = "i long, x array<double>, n array<double>, r double, f array<double>, v array<double>, change double"

    def rounds(first):
        def go(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                read = lambda c, b=b: np.array(b.column(c).to_pylist(), float).reshape(b.num_rows, -1)
                n, s = read("n"), read("near")
                if first:
                    r, change = _scale(s[:, 0] + n.sum(1) - 1, alpha), 0.0
                    f = np.tile(np.vstack([np.eye(classes), np.full((1, classes), 1 / classes)]), (len(n), 1, 1))
                else:
                    r = read("r")[:, 0]
                    f, change = _spread(n, read("f").reshape(-1, states, classes), r, s, alpha)
                v = r[:, None] * (n[:, :, None] * f).sum(1)
                yield pa.record_batch([b.column("i"), b.column("x"), b.column("n"), pa.array(r), pa.array(list(f.reshape(len(f), -1)), pa.list_(pa.float64())), pa.array(list(v), pa.list_(pa.float64())), pa.array([change] + [0.0] * (len(n) - 1))],
                                      names=[c.split()[0] for c in schema.split(", ")])

        return go

    place = cut(places.withColumn("i", F.monotonically_increasing_id()))
    rows = place.withColumn("v", F.array(F.aggregate("n", F.lit(0.0), lambda p, q: p + q)))
    state = cut(place.join(near(rows, 1), "i").mapInArrow(rounds(True), schema))
    for _ in range(max_iter):
        state = cut(state.join(near(state, classes), "i").mapInArrow(rounds(False), schema))
        if math.sqrt(state.agg(F.sum("change")).first()[0]) < tol:
            break
    values = [F.slice("f", 1 + s * classes, classes) for s in range(states)]
    return state.select("x", F.array(*[(F.array_position(v, F.array_max(v)) - 1).cast("int") for v in values]).alias("best"))


def label_propagation(df: DataFrame, features: list[str], key: str, label: str, gamma: float = 20.0, max_iter: int = 1000, tol: float = 1e-4, alpha: float | None = None) -> DataFrame:
    """(key, label): labelled rows (``label`` not null) spread theirs over the RBF graph of all pairs of rows until the values of all rows move by less than ``tol``. Rows without a
    label start with all classes alike, values of a row are scaled to sum 1 each round, and the first of equal classes wins. Labelled rows keep theirs; with ``alpha``
    (label spreading) weights are scaled by both degrees, and ``1 - alpha`` of a row's start is mixed in. A row with a missing feature reaches none and keeps its own label or null.

    Rows of equal features and label have equal values, so that rounds are over the different places, with counts. They run in memory where places and the grid of feature values
    are few (``GRID``), else over pairs of blocks, quadratic in the places; both are exact."""
    x = [f"_x{k}" for k in range(len(features))]
    pts = df.select(F.col(key).cast("long").alias("_k"), F.col(label).alias("_l"), *[F.col(c).cast("double").alias(v) for c, v in zip(features, x, strict=True)])
    classes = sorted(r[0] for r in pts.where("_l IS NOT NULL").select("_l").distinct().collect())  # a row for each class
    if not classes:
        raise ValueError("no row has a label")
    c, kind = len(classes), pts.schema["_l"].dataType
    known = F.array(*[F.lit(v).cast(kind) for v in classes])
    pts = pts.withColumn("_s", F.when(F.col("_l").isNull(), c).otherwise(F.array_position(known, F.col("_l")) - 1).cast("int"))
    whole = reduce(lambda a, b: a & b, [F.col(v).isNotNull() & ~F.isnan(v) for v in x])
    places = cut(pts.where(whole).groupBy(*x).agg(*[F.sum((F.col("_s") == k).cast("double")).alias(f"_n{k}") for k in range(c + 1)]))
    size, *values = places.agg(F.count("*"), *[F.count_distinct(v) for v in x]).first()
    if size * (c + 1) * c <= GRID and math.prod(values) * c <= GRID and max(values) <= GRID_VALUES:
        t = places.toArrow()
        read = lambda names: np.column_stack([t.column(v).to_numpy() for v in names])
        xs = read(x)
        best = _spread_on_grid(xs, read([f"_n{k}" for k in range(c + 1)]), gamma, max_iter, tol, alpha) if size else np.zeros((0, c + 1), int)
        found = df.sparkSession.createDataFrame(pa.table({**{v: xs[:, k] for k, v in enumerate(x)}, **{f"_b{k}": best[:, k].astype(np.int32) for k in range(c + 1)}})).select(*x, F.array(*[f"_b{k}" for k in range(c + 1)]).alias("best"))
    else:
        found = _spread_by_blocks(places.select(F.array(*x).alias("x"), F.array(*[f"_n{k}" for k in range(c + 1)]).alias("n")), gamma, c, max_iter, tol, alpha).select(*[F.col("x")[k].alias(v) for k, v in enumerate(x)], "best")
    out = pts.join(found, x, "left")
    return out.select(F.col("_k").alias(key), F.when(F.col("best").isNotNull(), F.get(known, F.get("best", F.col("_s")))).otherwise(F.col("_l")).alias(label))


def mean_shift(df: DataFrame, features: list[str], bandwidth: float, seeds: list[list[float]], max_iter: int = 300, tol: float = 1e-3) -> list[list[float]]:
    """Modes that the seeds climb to under a flat kernel; every round is one aggregate for all seeds. Modes closer than the bandwidth are one."""
    at = [list(map(float, s)) for s in seeds]
    for _ in range(max_iter):
        inside = [_sum([(F.col(c) - v) ** 2 for c, v in zip(features, s, strict=True)]) <= bandwidth**2 for s in at]
        r = df.agg(*[F.avg(F.when(q, F.col(c))) for q in inside for c in features]).first()
        new = [[r[i * len(features) + j] if r[i * len(features) + j] is not None else v for j, v in enumerate(s)] for i, s in enumerate(at)]
        shift = max(math.dist(a, b) for a, b in zip(at, new, strict=True))
        at = new
        if shift < tol:
            break
    out: list[list[float]] = []
    for s in sorted(at):
        if all(math.dist(s, o) > bandwidth for o in out):
            out.append(s)
    return out


def agglomerate(points: np.ndarray, n_clusters: int, linkage: str = "ward", most: int = 2000) -> np.ndarray:
    """Labels of a small matrix by repeated merging on squared distances (Lance-Williams); clusters are numbered by their smallest row.
    Quadratic in memory: larger data should be reduced first (cluster its k-means centres)."""
    n = len(points)
    if n > most:
        raise ValueError(f"at most {most} rows")
    return merged(((points[:, None] - points[None]) ** 2).sum(-1), n_clusters, linkage)


def merged(d: np.ndarray, n_clusters: int, linkage: str = "ward") -> np.ndarray:
    """Labels from squared distances."""
    n, d = len(d), d.astype(float)
    np.fill_diagonal(d, np.inf)
    size, group = np.ones(n), np.arange(n)
    for _ in range(n - n_clusters):
        i, j = sorted(np.unravel_index(int(np.argmin(d)), d.shape))
        a, b, m = size[i], size[j], np.isfinite(d[i]) & np.isfinite(d[j])
        if linkage == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        else:
            new = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (a * d[i] + b * d[j]) / (a + b)}[linkage]
        d[i, m] = d[m, i] = new[m]
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        group[group == j] = i
    return np.unique(group, return_inverse=True)[1]


def column_distances(df: DataFrame, features: list[str]) -> np.ndarray:
    """Squared distances of columns, summed from differences (products lose small ones); rows with a null are left out."""
    from quarry.operators.linear import EXPRESSIONS

    d = len(features)
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).where(reduce(lambda a, b: a & b, [F.col(f"x{i}").isNotNull() for i in range(d)]))
    at = [(i, j) for i in range(d) for j in range(i + 1, d)]

    def partial(batches):
        total, n = np.zeros((d, d)), 0
        for b in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            total += [((v - v[:, i : i + 1]) ** 2).sum(0) for i in range(d)]
            n += len(v)
        if n:
            yield pa.record_batch([pa.array(range(d * d), pa.int32()), pa.array(total.ravel()), pa.array([n] * (d * d), pa.int64())], names=["i", "v", "n"])

    out = np.zeros((d, d))
    if d <= EXPRESSIONS:
        n, *sums = x.agg(F.count("*"), *[F.sum((F.col(f"x{i}") - F.col(f"x{j}")) ** 2) for i, j in at]).first()
        if n:
            for (i, j), v in zip(at, sums, strict=True):
                out[i, j] = out[j, i] = v
    else:
        rows = x.mapInArrow(partial, "i int, v double, n long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # d ** 2 rows
        n = rows[0].n if rows else 0
        for r in rows:
            out[divmod(r.i, d)] = r.v
    if not n:
        raise ValueError("no complete rows")
    return out


def feature_agglomeration(df: DataFrame, features: list[str], n_clusters: int, linkage: str = "ward", pooling: str = "mean") -> DataFrame:
    """Columns fa_0 ...: features are clustered by the distances of their columns and pooled."""
    if len(features) > 2000:
        raise ValueError("at most 2000 features")
    label = merged(column_distances(df, features), n_clusters, linkage)
    out = {}
    for k in range(n_clusters):
        cols = [F.col(c) for c, v in zip(features, label, strict=True) if v == k]
        out[f"fa_{k}"] = _sum(cols) / len(cols) if pooling == "mean" else (F.greatest(*cols) if len(cols) > 1 else cols[0])
    return df.withColumns(out)
