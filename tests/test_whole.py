"""Whole jobs on inputs beyond former limits, and methods against plain computations."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from quarry.functions import stats
from quarry.operators import cluster as C
from quarry.operators import kernel_models as K
from quarry.operators import metrics as M
from quarry.operators import neighbors as N

PAIRWISE = {
    "chebyshev_distances": (N.DISTANCES["chebyshev"], lambda x, y: np.abs(x - y).max(-1)),
    "cosine_distances": (N.DISTANCES["cosine"], lambda x, y: 1 - (x * y).sum(-1) / np.sqrt((x * x).sum(-1) * (y * y).sum(-1))),
    "euclidean_distances": (N.DISTANCES["euclidean"], lambda x, y: np.sqrt(((x - y) ** 2).sum(-1))),
    "laplacian_kernel": (lambda x, y: N.kernel("laplacian", x, y, 0.1), lambda x, y: np.exp(-0.1 * np.abs(x - y).sum(-1))),
    "manhattan_distances": (N.DISTANCES["manhattan"], lambda x, y: np.abs(x - y).sum(-1)),
    "matern_kernel": (lambda x, y: N.GP_KERNELS["matern32"](N.squared(x, y), None, 2.0), lambda x, y: (1 + (z := np.sqrt(3 * ((x - y) ** 2).sum(-1)) / 2)) * np.exp(-z)),
    "polynomial_kernel": (lambda x, y: N.kernel("polynomial", x, y, 0.01, 2, 1.0), lambda x, y: (0.01 * (x * y).sum(-1) + 1) ** 2),
    "rbf_kernel": (lambda x, y: N.kernel("rbf", x, y, 0.1), lambda x, y: np.exp(-0.1 * ((x - y) ** 2).sum(-1))),
    "sigmoid_kernel": (lambda x, y: N.kernel("sigmoid", x, y, 0.01), lambda x, y: np.tanh(0.01 * (x * y).sum(-1))),
}


@pytest.mark.parametrize("name", PAIRWISE)
def test_pairwise_has_no_limit(spark, name):
    """Over 5,000 columns."""
    f, plain = PAIRWISE[name]
    v = np.random.default_rng(0).uniform(1, 9, (5003, 2))
    a = spark.createDataFrame([(i, v[i].tolist()) for i in range(3)], "i long, x array<double>")
    b = spark.createDataFrame([(j, r.tolist()) for j, r in enumerate(v)], "j long, y array<double>")
    got = N.pairwise(a, b, f).toPandas().sort_values(["i", "j"])
    assert len(got) == 3 * 5003 and np.allclose(got["value"], plain(v[:3, None], v[None]).ravel())


def propagated(x, y, gamma, alpha=None, rounds=1000, tol=1e-4):
    """Plain loops over the full matrix; -1 has no label."""
    w = np.exp(-gamma * ((x[:, None] - x) ** 2).sum(-1))
    np.fill_diagonal(w, 0)
    c = y.max() + 1
    start = np.where((y >= 0)[:, None], np.eye(c)[np.maximum(y, 0)], 1 / c)
    d = w.sum(1)
    s = w / d[:, None] if alpha is None else w / np.sqrt(d[:, None] * d)
    f = start
    for _ in range(rounds):
        new = s @ f if alpha is None else alpha * s @ f + (1 - alpha) * start
        if alpha is None:
            new[y >= 0] = start[y >= 0]
        new /= new.sum(1, keepdims=True)
        last, f = f, new
        if np.sqrt(((f - last) ** 2).sum()) < tol:
            break
    return f.argmax(1)


@pytest.mark.parametrize(("alpha", "grid", "rounds"), [(None, 1 << 22, 1000), (0.2, 1 << 22, 1000), (0.9, 1 << 22, 1000), (None, 0, 2), (0.2, 0, 2)])
def test_labels_spread_over_all_pairs(spark, monkeypatch, alpha, grid, rounds):
    """Copies, labelled and unlabelled rows at one place, places beyond any short radius, and a missing feature; in memory and by blocks."""
    monkeypatch.setattr(C, "GRID", grid)
    g = np.random.default_rng(1)
    x = np.round(g.normal(size=(60, 2)) * [1, 0.6], 1)
    x = np.concatenate([x, x[:25], [[6.0, 6.0]]])
    y = np.where(g.random(len(x)) < 0.3, (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5), -1)
    y[-1] = -1
    df = spark.createDataFrame([(i, float(a), float(b), None if c < 0 else int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(1000, None, 1.0, None), (1001, 1.0, float("nan"), 2)], "i long, a double, b double, l int")
    got = dict(C.label_propagation(df, ["a", "b"], "i", "l", 2.0, rounds, alpha=alpha).collect())
    assert got.pop(1000) is None and got.pop(1001) == 2
    assert [got[i] for i in range(len(x))] == propagated(x, y, 2.0, alpha, rounds).tolist()


@pytest.mark.parametrize("wide", [False, True])
def test_features_of_one_direction_merge(spark, monkeypatch, wide):
    """Two columns are multiples of each other, and rounding of long sums makes their matrix of products indefinite."""
    from quarry.operators import linear as L

    if wide:
        monkeypatch.setattr(L, "EXPRESSIONS", 2)
    df = spark.range(0, 60_000, 1, 1).selectExpr("IF(id = 0, 1e8D, 1D) AS a", "IF(id = 0, 1e8D, 1D) * 1.01D AS b", "CAST(id AS double) AS e")
    got = C.feature_agglomeration(df, ["a", "e", "b"], 2).where("e = 7").first()
    assert (got.fa_0, got.fa_1) == ((1 + 1.01) / 2, 7.0)


def test_order_statistics(spark):
    """Many ties, few huge values, both signs; narrowed to 50 rows."""
    g = np.random.default_rng(0)
    v = np.concatenate([g.normal(size=3000), np.repeat([0.25, -0.5, 0.0], 700), 10.0 ** g.uniform(-300, 300, 200), [-np.inf, np.inf]])
    df = spark.createDataFrame([(float(a),) for a in v], "v double").union(spark.createDataFrame([(None,)], "v double")).repartition(3)
    ranks = [0, 1, 17, 1500, 2600, 2601, 3999, len(v) - 2, len(v) - 1]
    assert stats.order_statistics(df, F.col("v"), ranks, 50) == np.sort(v)[ranks].tolist()


def test_conformal_without_one_buffer_of_all_values(spark, monkeypatch):
    """The quantile isn't an aggregate over all distinct values."""
    monkeypatch.setattr(K.F, "percentile", None)
    v = np.random.default_rng(2).normal(size=500)
    low, high = K.conformal(df := spark.createDataFrame([(float(a), 0.0) for a in v], "y double, p double"), "y", "p", 0.9)
    want = np.quantile(np.abs(v), np.ceil(501 * 0.9) / 500)
    assert abs(df.select(high).first()[0] - want) < 1e-12 and abs(df.select(low).first()[0] + want) < 1e-12


def test_dbscan_makes_no_pairs_of_copies(spark, monkeypatch):
    """Copies count towards cores; the join sees each place once. Noise, a border point of two clusters, and a missing feature."""
    seen = []
    join = C.radius_join
    monkeypatch.setattr(C, "radius_join", lambda a, b, *r: (seen.append((a.count(), b.count())), join(a, b, *r))[1])
    x = [0.0] * 40 + [1.0] * 3 + [2.0] * 3 + [3.0] + [4.0] * 4 + [9.0] + [20.0] * 4
    df = spark.createDataFrame([(100 - i, a, 0.5) for i, a in enumerate(x)] + [(500, None, 0.5)], "i long, a double, b double")
    got = dict(C.dbscan(df, ["a", "b"], "i", 1.0, 4).collect())
    assert seen == [(8, 8)]
    v = np.array(x)
    near = np.abs(v[:, None] - v) <= 1
    core = near.sum(1) >= 4
    root = np.where(core, [100 - i for i in range(len(v))], 10**6)
    for _ in v:
        root = np.where(core, np.where(near & core, root, 10**6).min(1), 10**6)
    number = {r: k for k, r in enumerate(sorted(set(root[core])))}
    want = [number[root[i]] if core[i] else min([number[r] for r in root[near[i] & core]], default=-1) for i in range(len(v))]
    assert [got[100 - i] for i in range(len(v))] == want and got[500] == -1 and len(got) == len(v) + 1


def test_silhouettes_of_more_rows_than_the_former_limit(spark):
    """Over 20,000 rows in two columns, clusters of three sizes, one of a single row, noise and a missing feature; some rows against plain sums."""
    g = np.random.default_rng(3)
    n = 20_050
    v, c = g.normal(size=(n, 2)).round(3), g.choice([0, 1, 2], n, p=[0.6, 0.3, 0.1])
    c[5], c[6] = 7, -1
    df = spark.createDataFrame([(f"k{i}", float(a), float(b), int(z)) for i, ((a, b), z) in enumerate(zip(v, c, strict=True))] + [("none", None, 1.0, 0)], "k string, a double, b double, l int")
    got = dict(M.silhouette(df, ["a", "b"], "l", "k").collect())
    assert len(got) == n + 1 and got["none"] == got["k6"] == 0
    for i in (0, 1, 2, 5, n - 1):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        a = d[c == c[i]].sum() / max((c == c[i]).sum() - 1, 1)
        b = min(d[c == z].mean() for z in {0, 1, 2, 7} - {c[i]})
        assert abs(got[f"k{i}"] - (b - a) / max(a, b)) < 1e-9
