"""Models in the dual, embeddings, clusterings over all pairs, networks and composition against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import compose as C
from quarry.operators import dual as D
from quarry.operators import linear as L
from quarry.operators import manifold as M
from quarry.operators import neural as N
from quarry.sources import io

X2, X3 = ["x0", "x1"], ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def moons(spark):
    return io.make_moons(spark, 200, 0.1).cache()


@pytest.fixture(scope="module")
def blobs(spark):
    return io.make_blobs(spark, 200, 4, 3, 0.4).cache()


def accuracy(df, y="label"):
    return df.agg(F.avg((F.col("prediction") == F.col(y)).cast("double"))).first()[0]


def same_groups(df, a, b):
    pairs = {tuple(r) for r in df.select(a, b).distinct().collect()}
    return len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_dual_meets_the_conditions_of_its_optimum():
    rng = np.random.default_rng(0)
    x, s = rng.normal(size=(60, 2)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    a, b = D.dual(k * s[:, None] * s, -np.ones(60), s, np.zeros(60), 1.0, 1e-6)
    assert abs(s @ a) < 1e-9 and a.min() >= 0 and a.max() <= 1
    m = s * (k @ (a * s) + b)
    assert (m[a < 1e-9] >= 1 - 1e-4).all() and (m[a > 1 - 1e-9] <= 1 + 1e-4).all()
    assert np.abs(m[(a > 1e-9) & (a < 1 - 1e-9)] - 1).max() < 1e-4


def test_support_vector_machines(moons, blobs):
    assert accuracy(D.svc(moons, X2, "label", 10.0, gamma=2.0).transform(moons)) == 1.0
    named = blobs.withColumn("label", F.concat(F.lit("c"), F.col("label")))
    assert accuracy(D.svc(named, X3, "label", kernel="linear").transform(named)) == 1.0
    curve = moons.withColumn("y", F.sin(F.col("x0") * 2))
    worst = D.svr(curve, ["x0"], "y", 100.0, 0.05).transform(curve).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert worst < 0.06
    out = D.one_class_svm(moons, X2, 0.1).transform(moons).where("prediction < -1e-6").count()
    assert out <= 20
    for f in (D.nu_svc, D.nu_svr):
        with pytest.raises(ValueError):
            f(moons, X2, "label", 1.5)


def test_bounds_are_checked_and_nulls_left_out(spark, moons):
    for f in (lambda: D.svc(moons, X2, "label", most=50), lambda: M.mds(moons, X2, "id", most=50), lambda: M.hdbscan(moons, X2, "id", most=50)):
        with pytest.raises(ValueError):
            f()
    holes = spark.createDataFrame([(1, 0.0, 0), (2, None, 1), (3, 5.0, 1), (4, 6.0, 1)], "id long, x double, label long")
    assert len(D.svc(holes, ["x"], "label").classes) == 2
    assert M.mds(holes, ["x"], "id", 1).keys == [1, 3, 4]


def test_gaussian_process_against_the_formula(moons):
    t = moons.withColumn("y", F.sin(F.col("x0"))).orderBy("id").limit(50)
    kernel = D.rbf(0.7) + D.white(0.01)
    m = D.gp_regressor(t, ["x0"], "y", kernel)
    got = m.transform(moons, deviation="d").orderBy("id").limit(5).collect()
    r = np.array([(v.x0, v.y) for v in t.collect()])
    k = np.exp(-((r[:, :1] - r[:, 0]) ** 2) / (2 * 0.49)) + 0.01 * np.eye(50)
    for v in got:
        q = np.exp(-((v.x0 - r[:, 0]) ** 2) / (2 * 0.49))
        assert v.prediction == pytest.approx(q @ np.linalg.solve(k, r[:, 1]), abs=1e-6)
        assert v.d == pytest.approx(math.sqrt(max(1.01 - q @ np.linalg.solve(k, q), 0)), abs=1e-6)
    want = -r[:, 1] @ np.linalg.solve(k, r[:, 1]) / 2 - np.linalg.slogdet(k)[1] / 2 - 25 * math.log(2 * math.pi)
    assert m.log_likelihood == pytest.approx(want, abs=1e-6)
    assert m.samples(np.zeros((3, 1)), 4).shape == (3, 4)
    assert accuracy(D.gp_classifier(moons, X2, "label", D.matern(0.5) * D.constant(4.0)).transform(moons)) > 0.97


def test_matern_limits():
    x = np.array([[0.0], [1.0]])
    assert D.matern(2.0, 0.5)(x)[0, 1] == pytest.approx(math.exp(-0.5))
    assert D.matern(1.0, 1.5)(x)[0, 1] == pytest.approx((1 + math.sqrt(3)) * math.exp(-math.sqrt(3)))
    with pytest.raises(ValueError):
        D.matern(1.0, 2.0)


@pytest.mark.parametrize("fit", [lambda b: M.kernel_pca(b, X3, "id", 3, "rbf", 0.1), lambda b: M.mds(b, X3, "id", 3), lambda b: M.isomap(b, X3, "id", 2, 8)])
def test_new_rows_land_where_fitted_ones_are(blobs, fit):
    m = fit(blobs)
    cols = [f"c{j}" for j in range(m.values.shape[1])]
    got = np.array([list(r) for r in m.transform(blobs).orderBy("id").select(*cols).collect()])
    assert np.abs(got - m.values).max() < 1e-4


def test_scaling_keeps_distances():
    x = np.random.default_rng(0).normal(size=(30, 3))
    d = M.distances(x)
    assert np.abs(M.distances(M.mds_of_distances(d, 3)) - d).max() < 1e-5


def test_geodesics_by_relaxation():
    x = np.random.default_rng(1).normal(size=(25, 2))
    d, near = M.distances(x), M.nearest(M.distances(x), 4)
    want = np.full((25, 25), np.inf)
    np.fill_diagonal(want, 0)
    for i in range(25):
        for j in near[i]:
            want[i, j] = want[j, i] = d[i, j]
    for k in range(25):
        want = np.minimum(want, want[:, k : k + 1] + want[k : k + 1])
    if np.isfinite(want).all():
        assert np.abs(M.geodesics(d, 4) - want).max() < 1e-9
    far = M.geodesics(M.distances(np.array([[0.0], [1.0], [10.0], [11.0]])), 1)
    assert far[0, 3] == pytest.approx(11.0)


@pytest.mark.parametrize(
    "embed",
    [
        lambda b: M.locally_linear(b, X3, "id", 3, 8),
        lambda b: M.spectral_embedding(b, X3, "id", 3),
        lambda b: M.tsne(b, X3, "id", perplexity=10, rounds=250),
        lambda b: M.umap(b, X3, "id", neighbours=10, epochs=100),
    ],
)
def test_embeddings_keep_groups_together(blobs, embed):
    rows = embed(blobs).join(blobs.select("id", "label"), "id").collect()
    y = np.array([[r[f"c{j}"] for j in range(len(rows[0]) - 2)] for r in rows])
    lab = np.array([r.label for r in rows])
    d = M.distances(y)
    np.fill_diagonal(d, np.inf)
    assert (lab[d.argmin(1)] == lab).mean() > 0.95


def test_perplexity():
    d2 = M.distances(np.random.default_rng(0).normal(size=(40, 2))) ** 2
    p = M._perplexity(d2, 10.0)
    h = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
    assert np.abs(np.exp(h) - 10).max() < 1e-3


@pytest.mark.parametrize("f", [lambda b: M.spectral_clustering(b, X3, "id", 4), lambda b: M.affinity_propagation(b, X3, "id", 0.9, preference=-200.0), lambda b: M.hdbscan(b, X3, "id")])
def test_clusterings_find_the_groups(blobs, f):
    got = f(blobs).withColumnRenamed("label", "found").join(blobs, "id")
    assert same_groups(got, "label", "found")


def test_hdbscan_noise_and_small_input(spark, blobs):
    far = blobs.select("id", *X3).union(spark.createDataFrame([(9999, 500.0, 500.0, 500.0)], "id long, x0 double, x1 double, x2 double"))
    assert M.hdbscan(far, X3, "id").where("id = 9999").first().label == -1
    assert [r.label for r in M.hdbscan(blobs.limit(3), X3, "id").collect()] == [-1] * 3


def test_tree_is_minimal():
    d = M.distances(np.random.default_rng(2).normal(size=(20, 2)))
    edges = sorted((d[i, j], i, j) for i in range(20) for j in range(i))
    root, want = list(range(20)), 0.0
    for w, i, j in edges:
        if root[i] != root[j]:
            want += w
            root = [root[i] if r == root[j] else r for r in root]
    assert sum(w for w, _, _ in M._tree(d)) == pytest.approx(want)


def test_reachability_by_hand(blobs):
    order, reach, core, _ = M.reachability(M.distances(np.array([[0.0], [1.0], [2.0], [50.0]])), 2)
    assert list(order) == [0, 1, 2, 3] and list(core) == [1, 1, 1, 48] and math.isinf(reach[0]) and list(reach[1:]) == [1, 1, 48]
    got = M.optics(blobs, X3, "id", 10).withColumnRenamed("label", "found").join(blobs, "id").where("found >= 0")
    assert same_groups(got, "label", "found") and got.count() > 80


def test_networks(moons):
    m = N.mlp_classifier(moons.repartition(2), X2, "label", (16, 8), "tanh", rate=0.02, rounds=60, batch=20)
    assert accuracy(m.transform(moons)) > 0.95 and m.losses[-1] < m.losses[0]
    curve = moons.withColumn("y", F.col("x0") * 2 - 1)
    m = N.mlp_regressor(curve, ["x0"], "y", (8,), rate=0.02, rounds=40, batch=20, validation=0.2)
    assert m.transform(curve).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] < 0.05


@pytest.mark.parametrize("activation", sorted(N.ACTIVATIONS))
@pytest.mark.parametrize("classes", [None, [0, 1, 2]])
def test_gradients_by_differences(activation, classes):
    rng = np.random.default_rng(0)
    m = N.Network(["a", "b"], [2, 4, 3, 3 if classes else 1], rng.normal(size=2 * 4 + 4 + 4 * 3 + 3 + (12 if classes else 4)), activation, classes, [], np.zeros(2), np.ones(2))
    x, y = rng.normal(size=(7, 2)), rng.integers(0, 3, 7).astype(float)
    g, _ = m.gradient(x, y, m.weights, 0.0)
    for j in range(len(m.weights)):
        e = np.zeros(len(m.weights))
        e[j] = 1e-6
        want = (m.gradient(x, y, m.weights + e, 0.0)[1] - m.gradient(x, y, m.weights - e, 0.0)[1]) / 2e-6
        assert g[j] == pytest.approx(want, abs=1e-5)


def test_boltzmann_machine_learns_two_patterns(spark):
    cols = [f"v{j}" for j in range(6)]
    df = spark.range(1000).select(*[(F.col("id") % 2 == j % 2).cast("double").alias(c) for j, c in enumerate(cols)])
    m = N.bernoulli_rbm(df, cols, 2, rounds=10)
    p = m.down(m.up(np.array([[1.0, 0.0] * 3, [0.0, 1.0] * 3])))
    assert p[0, 0] > 0.7 > 0.4 > p[0, 1] and p[1, 1] > 0.7 > 0.4 > p[1, 0]
    assert set(np.unique(m.gibbs(np.ones((5, 6))))) <= {0.0, 1.0}


def test_codes():
    rng = np.random.default_rng(0)
    atoms = np.linalg.qr(rng.normal(size=(6, 6)))[0][:3]
    x = rng.normal(size=(5, 6))
    want = np.sign(x @ atoms.T) * np.maximum(np.abs(x @ atoms.T) - 0.3, 0)
    assert np.abs(N.lasso_codes(x, atoms, 0.3) - want).max() < 1e-9
    c = N.pursuit_codes(x, atoms, 2)
    assert ((c != 0).sum(1) <= 2).all() and np.abs(N.pursuit_codes(x, atoms, 3) - x @ atoms.T).max() < 1e-9


def test_sparse_components_separate_blocks(spark):
    rng = np.random.default_rng(0)
    u, w = rng.normal(size=300) * 3, rng.normal(size=300)
    rows = np.column_stack([u, u + rng.normal(size=300) * 0.1, w, w + rng.normal(size=300) * 0.1])
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double")
    m = N.sparse_pca(df, list("abcd"), 2, 1.0)
    assert np.abs(m.components[0, 2:]).max() < 1e-3 and np.abs(m.components[1, :2]).max() < 1e-3
    assert m.transform(df).columns == ["a", "b", "c", "d", "spc0", "spc1"]


def test_dictionary_finds_directions(spark):
    rng = np.random.default_rng(0)
    atoms = np.linalg.qr(rng.normal(size=(4, 4)))[0][:2]
    c = rng.normal(size=(300, 2)) * np.where(rng.random((300, 1)) < 0.5, [[1.0, 0.0]], [[0.0, 1.0]]) * 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in c @ atoms], "a double, b double, c double, d double")
    m = N.dictionary_learning(df, list("abcd"), 2, 0.1, 40)
    assert np.abs(m.atoms @ atoms.T).max(1).min() > 0.98


def test_summary_of_clusters(blobs):
    m = N.birch(blobs, X3, 1.5, 4)
    assert m.n.sum() == 200 and same_groups(m.transform(blobs, "found"), "label", "found")
    small = N.birch(blobs, X3, 0.0, most=50)
    assert len(small.n) <= 50 and small.n.sum() == 200 and small.threshold > 0


@pytest.mark.parametrize("process", [True, False])
def test_variational_mixture(blobs, process):
    start = [list(map(float, r)) for r in blobs.orderBy("id").select(*X3).limit(4).collect()]
    m = N.bayesian_mixture(blobs, X3, start, process)
    assert same_groups(m.transform(blobs, "found"), "label", "found")
    assert m.weights() == pytest.approx([0.25] * 4, abs=0.02)


def test_pipeline_and_output_codes(spark, blobs):
    p = C.make_pipeline(lambda d: lambda x: x.withColumn("x0", F.col("x0") * 2), lambda d: L.pca(L.gram(d, X3, []), 2))
    m = p.fit(blobs)
    assert len(m.steps) == 2 and m.transform(blobs).count() == 200
    with pytest.raises(ValueError):
        C.Pipeline([("a", None), ("a", None)])
    code = C.output_code(blobs, "label", lambda d, t: D_score(d, t), 3.0)
    assert accuracy(blobs.withColumn("prediction", code)) > 0.9


def D_score(d, t):
    cols = [*X3, *[f"{a}{b}" for i, a in enumerate(X3) for b in X3[i:]]]
    wide = d.withColumns({f"{a}{b}": F.col(a) * F.col(b) for i, a in enumerate(X3) for b in X3[i:]})
    m = L.ols(L.gram(wide, cols, [t]))
    terms = {c: float(w) for c, w in zip(cols, m.coef, strict=True)}
    out = F.lit(float(np.ravel(m.intercept)[0]))
    for i, a in enumerate(X3):
        out = out + F.col(a) * terms[a]
        for b in X3[i:]:
            out = out + F.col(a) * F.col(b) * terms[f"{a}{b}"]
    return out


def test_wild_bootstrap_covers_the_estimate(spark):
    t = spark.range(500).select("id", (F.col("id") / 50).alias("u"), (F.sin(F.col("id") / 50) + F.pmod(F.xxhash64("id"), F.lit(100)) / 200).alias("y"), (F.sin(F.col("id") / 50) + 0.25).alias("f"))
    q = spark.createDataFrame([(0, 2.0), (1, 5.0)], "i long, x double")
    a, b = (C.wild_bootstrap(x, q, 0.3, draws=100).orderBy("i").collect() for x in (t, t.repartition(7)))
    for r, s in zip(a, b, strict=True):
        assert r.lower <= r.prediction + 0.05 and r.upper >= r.prediction - 0.05 and r.lower < r.upper
        assert tuple(r) == pytest.approx(tuple(s), abs=1e-9)


def test_uneven_variance_is_found(spark):
    e = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 - 0.5
    df = spark.range(1000).select((F.col("id") / 100).alias("x"), (F.col("id") / 100 * (1 + e)).alias("y"), (F.col("id") / 100).alias("p"))
    assert C.goldfeld_quandt(df, ["x"], "y", "x")[1] < 1e-6
    assert C.white_test(df, ["x"], "y", "p")[1] < 1e-6


def test_generators(spark):
    assert io.make_s_curve(spark, 100).agg(F.max(F.abs("x0"))).first()[0] <= 1
    assert io.make_friedman1(spark, 100, noise=1.0).columns[-1] == "y" and io.make_friedman3(spark, 100).agg(F.max(F.abs("y"))).first()[0] <= math.pi / 2
    assert set(r.label for r in io.make_hastie_10_2(spark, 500).select("label").distinct().collect()) == {-1, 1}
    rings = {r.label: r["count"] for r in io.make_gaussian_quantiles(spark, 3000).groupBy("label").count().collect()}
    assert all(abs(n - 1000) < 120 for n in rings.values()) and len(rings) == 3
    low = np.array([list(r)[1:] for r in io.make_low_rank_matrix(spark, 200, 20, 3, 0.0).collect()])
    s = np.linalg.svd(low, compute_uv=False)
    assert s[8] < 0.05 * s[0]
    assert np.linalg.eigvalsh(io.make_spd_matrix(6)).min() > 0 and np.linalg.eigvalsh(io.make_sparse_spd_matrix(6)).min() > 0
    ml = io.make_multilabel_classification(spark, 2000, 4, 5, 2)
    assert ml.agg(F.avg(sum(F.col(f"l{c}") for c in range(5)))).first()[0] == pytest.approx(2.0, abs=0.15)
    assert io.make_sparse_uncorrelated(spark, 10).count() == 10


def test_onnx_gives_the_same_predictions(moons):
    ort = pytest.importorskip("onnxruntime")
    m = N.mlp_classifier(moons, X2, "label", (8,), "tanh", rounds=3)
    x = np.array([[r.x0, r.x1] for r in moons.limit(20).collect()])
    s = ort.InferenceSession(io.onnx_layers(m.layers(), "tanh", "softmax", (m.mean, m.scale)))
    got = s.run(None, {"input": x.astype("float32")})[0]
    assert np.abs(got - m.forward(x)[-1]).max() < 1e-5
    linear = io.onnx_layers([(np.array([[2.0], [3.0]]), np.array([1.0]))])
    assert ort.InferenceSession(linear).run(None, {"input": np.ones((1, 2), "float32")})[0][0, 0] == 6


def test_boosted_regression_and_cross_validated_logistic(spark, moons):
    from quarry.operators import selection as S
    from quarry.operators import trees as T

    curve = moons.withColumn("y", F.sin(F.col("x0") * 2))
    for loss in ("linear", "square", "exponential"):
        p = T.adaboost_regressor(curve, ["x0"], "y", 2, loss=loss)
        assert curve.agg(F.avg((p - F.col("y")) ** 2)).first()[0] < 0.05
    m, scores = L.logistic_cv(S.k_fold(moons, "id", 3, seed=1), X2, "label", "fold", (0.01, 1.0, 100.0))
    assert len(scores) == 3 and max(scores) > 0.8 and len(m.coef) == 2


def test_stratified_folds_with_a_class_of_most_rows_and_nulls(spark):
    from quarry.operators import selection as S

    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 == 1, "b").otherwise("a"))
    x = S.numbered(df, "id", by="y").collect()
    assert len(x) == 1000
    for c in (None, "a", "b"):
        assert [r._n for r in sorted((r for r in x if r.y == c), key=lambda r: r.id)] == list(range(sum(r.y == c for r in x)))
    split = S.shuffle_split(df, "id", 1, 0.2, y="y").groupBy("y").agg(F.sum(F.col("test_0").cast("int")).alias("n"))
    assert {r.y: r.n for r in split.collect()} == {None: 20, "b": 20, "a": 160}
    folds = S.repeated_stratified_k_fold(df.dropna(), "id", "y", 4, 2)
    assert {r[1] for r in folds.groupBy("fold_1").agg(F.sum((F.col("y") == "b").cast("int"))).collect()} == {25}


def test_left_out_predictions(spark):
    from quarry.operators import neighbors as NB

    df = spark.range(30).select("id", (F.col("id") / 3).alias("u"), F.sin(F.col("id") / 3).alias("y"))
    hat = NB.hat_matrix(df, "id", "u", "y", 0.5)
    rows = [(r.id, r.u, r.y) for r in df.collect()]
    for r in hat.collect():
        w = [(math.exp(-(((rows[r.id][1] - u) / 0.5) ** 2) / 2), y) for i, u, y in rows if i != r.id]
        assert r.left_out == pytest.approx(sum(a * b for a, b in w) / sum(a for a, _ in w), abs=1e-9)
    assert 1 < NB.effective_df(hat) < 30
    best, errors = NB.cross_validated_bandwidth(df, "id", "u", "y", [0.3, 5.0])
    assert best == 0.3 and errors[0] < errors[1]
    pairs = spark.createDataFrame([(1, 2, 0.5)], "i long, j long, distance double")
    assert tuple(NB.neighbors_graph(pairs, "distance").first()) == (1, 2, 0.5)


def test_local_polynomials_are_exact_on_polynomials(spark):
    from quarry.operators import neighbors as NB

    train = spark.range(50).select((F.col("id") / 10).alias("u"), ((F.col("id") / 10) ** 3 - F.col("id")).alias("y"))
    q = spark.createDataFrame([(0, 1.0), (1, 2.5), (2, 100.0)], "i long, x double")
    got = {r.i: r.prediction for r in NB.local_polynomial(q, train, 0.5, 3, "epanechnikov").collect()}
    assert got[0] == pytest.approx(1 - 10, abs=1e-5) and got[1] == pytest.approx(2.5**3 - 25, abs=1e-5) and got[2] is None


def test_solvers():
    from quarry.functions.special import lanczos, trust_region
    from quarry.operators.preprocess import rfe_cv

    f = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    g = lambda x: np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])
    assert trust_region(f, g, np.array([-1.2, 1.0])) == pytest.approx([1, 1], abs=1e-5)
    a = np.random.default_rng(0).normal(size=(60, 60))
    a = a + a.T
    v, w = lanczos(lambda x: a @ x, 60, 3, steps=60)
    assert v == pytest.approx(np.linalg.eigvalsh(a)[::-1][:3]) and np.abs(a @ w - w * v).max() < 1e-6
    assert lanczos(lambda x: x, 5, 2)[0] == pytest.approx([1, 1])
    best, scores = rfe_cv(["a", "b", "c"], lambda s: [{"a": 3, "b": 1, "c": 2}[c] for c in s], lambda s: 1.0 if "c" in s and "a" in s else 0.0)
    assert best == ["a", "c"] and scores == {3: 1.0, 2: 1.0, 1: 0.0}


def test_sparse_builders(spark):
    d = {(r.row, r.col): r.val for r in io.diags(spark, 3, {0: 2.0, 1: -1.0}).collect()}
    assert d == {(0, 0): 2, (1, 1): 2, (2, 2): 2, (0, 1): -1, (1, 2): -1}
    e = io.eye(spark, 2)
    assert sorted((r.row, r.col) for r in io.hstack(e, e, 2).collect()) == [(0, 0), (0, 2), (1, 1), (1, 3)]
    assert sorted((r.row, r.col) for r in io.vstack(e, e, 2).collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]
