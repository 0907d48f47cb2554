"""Edge cases and invariants that the SQL comparison doesn't reach."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import special as sp
from quarry.functions.stats import running
from quarry.operators import cluster as C
from quarry.operators import linear as L
from quarry.operators import metrics as M
from quarry.operators import neighbors as N
from quarry.operators import preprocess as P
from quarry.operators import selection as S
from quarry.operators import trees as T
from quarry.sources import io


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_scalers_leave_constant_columns_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, 5.0, float("nan")), (3.0, 5.0, 2.0), (5.0, 5.0, 4.0)], "a double, b double, c double")
    for f in (P.standard_scaler, P.min_max_scaler, P.robust_scaler):
        rows = f(df, ["a", "b", "c"]).transform(df).collect()
        assert [r.b for r in rows] == [5.0] * 3
        assert math.isnan(rows[0].c) and not math.isnan(rows[1].c)
    assert [r.a for r in P.min_max_scaler(df, ["a"]).transform(df).collect()] == [0.0, 0.5, 1.0]


def test_imputer_of_a_column_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    for s in ("mean", "median", "most_frequent", "constant"):
        assert [r.x for r in P.simple_imputer(df, ["x"], s, 7.0).collect()] == [0.0, 0.0]


def test_polynomial_order():
    assert P.polynomial_terms(2, 2) == [(), (0,), (1,), (0, 0), (0, 1), (1, 1)]
    assert P.polynomial_terms(3, 2, interaction_only=True, bias=False) == [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2)]


def test_selection_rules():
    assert P.select_k_best([("a", 1.0), ("b", 2.0), ("c", 2.0)], 1) == ["b"]
    assert P.select_fdr([("a", 0.01), ("b", 0.04), ("c", 0.9)], 0.06) == ["a", "b"]
    assert P.select_fwe([("a", 0.01), ("b", 0.04)], 0.05) == ["a"]
    assert P.rfe([("a", 1), ("b", 3), ("c", 2)], 1) == {"a": 3, "b": 1, "c": 2}
    assert P.sequential_selection(["a", "b", "c"], 2, lambda s: sum({"a": 1, "b": 3, "c": 2}[x] for x in s)) == ["b", "c"]


def test_running_totals_equal_one_window(spark):
    rng = random.Random(1)
    rows = [(float(k), rng.randint(0, 9)) for k in rng.sample(range(5000), 800)]
    df = spark.createDataFrame(rows, "k double, v long")
    for down in (False, True):
        got = {r.k: r.cum_v for r in running(df, "k", ["v"], down).collect()}
        total = 0
        for k, v in sorted(rows, reverse=down):
            total += v
            assert got[k] == total


def test_constant_target_has_no_r2(spark):
    r = M.regression_report(spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "y double, p double"), "y", "p").first()
    assert r.r2_score is None and r.mean_absolute_error == 0.5
    assert M.get_scorer("neg_mean_absolute_error")(spark.createDataFrame([(1.0, 1.5)], "y double, p double"), "y", "p") == -0.5
    with pytest.raises(ValueError):
        M.get_scorer("none")


def test_adjusted_mutual_info(spark):
    rng = random.Random(0)
    same = [(k % 3, k % 3) for k in range(60)]
    chance = [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(400)]
    assert M.adjusted_mutual_info(spark.createDataFrame(same, "a int, b int"), "a", "b") == pytest.approx(1)
    assert abs(M.adjusted_mutual_info(spark.createDataFrame(chance, "a int, b int"), "a", "b")) < 0.05


def test_wide_gram_is_that_of_expressions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 14))
    cols = [f"c{k}" for k in range(14)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    want = np.column_stack([np.ones(200), x]).T @ np.column_stack([np.ones(200), x])
    assert np.allclose(L.gram(df, cols, []).m, want)
    assert np.allclose(L.gram(df, cols[:5], []).m, want[:6, :6])


def test_linear_models_recover_known_weights(spark):
    df = io.make_regression(spark, 3000, 3, 0.0, 4)
    g = L.gram(df, ["x0", "x1", "x2"], ["y"])
    w = L.ols(g).coef
    for m in (L.ridge(g, 1e-6), L.lasso(g, 1e-6, tol=1e-9), L.bayesian_ridge(g), L.omp(g, 3), L.lars(g), L.lasso_lars(g, 1e-9), L.huber(df, g.features, "y"), L.quantile_regression(df, g.features, "y", 0.5, 0.0)):
        assert np.allclose(m.coef, w, rtol=1e-2, atol=1e-2)
    assert np.allclose(L.pls(g, 3)[:, 0], w, rtol=1e-6)
    # the optimum of the lasso: gradients within alpha, equal to it where a weight isn't zero
    a, b, _, _ = g.parts()
    m = L.lasso(g, 5.0, tol=1e-10)
    grad = (b[:, 0] - a @ m.coef) / g.n
    assert np.all(np.abs(grad) <= 5 + 1e-6) and np.allclose(grad[m.coef != 0], 5 * np.sign(m.coef[m.coef != 0]))


def test_logistic_gradient_is_zero(spark):
    df = io.make_blobs(spark, 400, 2, 2, 6.0, 3)
    m = L.logistic(df, ["x0", "x1"], "label", 2.0)
    p = L.probability(m)
    r = df.agg(F.avg(p - F.col("label")), *[F.avg((p - F.col("label")) * F.col(c)) for c in m.features]).first()
    assert abs(r[0]) < 1e-6 and np.allclose(np.array(r[1:]) + m.coef / 2.0, 0, atol=1e-6)


def test_kmeans_and_mixture_find_blobs(spark):
    df = io.make_blobs(spark, 600, 3, 2, 0.3, 1).persist()
    start = C.kmeans_parallel(df, ["x0", "x1"], 3, 2)
    m = C.kmeans(df, ["x0", "x1"], start)
    assert M.cluster_agreement(df.withColumn("p", m.predict()), "label", "p").first().adjusted_rand_score > 0.99
    g = C.gaussian_mixture(df, ["x0", "x1"], m.centers, max_iter=20)
    assert M.cluster_agreement(df.withColumn("p", g.predict()), "label", "p").first().adjusted_rand_score > 0.99
    assert len(set(C.agglomerate(np.array(df.select("x0", "x1").limit(60).collect()), 3))) == 3


def test_splits_cover_all_rows_once(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 3).cast("int")).withColumn("g", (F.col("id") % 17).cast("int"))
    sizes = sorted(r["count"] for r in S.k_fold(df, "id", 5, 1).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    per = S.stratified_k_fold(df, "id", "y", 4).groupBy("fold", "y").count().collect()
    assert len(per) == 12 and all(8 <= r["count"] <= 9 for r in per)
    assert S.group_k_fold(df, "g", 4).groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert S.train_test_split(df, "id", 0.2).where("test").count() == 21
    shuffled = S.shuffle_column(df, "y", "id", 3)
    assert sorted(r.y for r in shuffled.collect()) == sorted(r.y for r in df.collect())
    assert list(S.leave_p_out(4, 2)) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (90, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "i long, x array<double>")
    got = {(r.i, r["rank"]): r.j for r in N.knn(df, df.select(F.col("i").alias("j"), F.col("x").alias("y")), 4, exclude_self=True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(90):
        best = [j for j in np.lexsort((np.arange(90), d[i])) if j != i][:4]
        assert [got[i, k] for k in range(1, 5)] == best


def test_tree_separates(spark):
    df = io.make_moons(spark, 400, 0.05).persist()
    m = T.decision_tree_classifier(df, ["x0", "x1"], "label", max_depth=6)
    assert df.where(m.predict() == F.col("label")).count() > 390
    assert abs(sum(m.trees[0].importances()) - 1) < 1e-9


def test_special_functions():
    for x in (0.3, 1.0, 4.7):
        assert sp.digamma(x + 1) == pytest.approx(sp.digamma(x) + 1 / x)
    assert sp.digamma(1) == pytest.approx(-0.5772156649015329)
    for d in (sp.normal(1, 2), sp.chi_squared(3), sp.students_t(5), sp.f_distribution(4, 9), sp.beta_distribution(2, 3), sp.gamma_distribution(2.5, 1.5)):
        low = d.low if d.low > -math.inf else -60.0
        for p in (0.05, 0.5, 0.9):
            x = d.ppf(p)
            assert d.cdf(x) == pytest.approx(p, abs=1e-9)
            assert sp.gauss_legendre(d.pdf, low, x, 20, 200) == pytest.approx(p, abs=1e-3)
    assert sp.t_test_two_tailed(2.0, 10) == pytest.approx(2 * sp.students_t(10).sf(2.0))
    assert sp.gauss_legendre(math.sin, 0, math.pi, 12) == pytest.approx(2) == sp.quad(math.sin, 0, math.pi)
    assert sp.minimize_bounded(lambda x: (x - 0.3) ** 2, -3, 3)[0] == pytest.approx(0.3, abs=1e-6)
    f = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    g = lambda x: np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])
    assert np.allclose(sp.newton_cg(f, g, np.zeros(2)), 1, atol=1e-5)
    x = np.linspace(0, 3, 8)
    assert np.allclose(sp.CubicSpline(x, x**3, "not-a-knot")(np.linspace(0, 3, 31)), np.linspace(0, 3, 31) ** 3)


def test_files_and_models(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0.0, 2.5), (0.0, 3.0, 0.0)], "y double, a double, b double")
    io.write_svmlight(df, "y", ["a", "b"], str(tmp_path / "s"))
    got = sorted((r.label, r.col, r.val) for r in io.read_svmlight(spark, str(tmp_path / "s")).collect() if r.col is not None)
    assert got == [(0.0, 0, 3.0), (1.0, 1, 2.5)]
    m = L.LinearModel(["a", "b"], np.array([1.0, 2.0]), 0.5)
    io.save_model(m, str(tmp_path / "m"), spark)
    again = io.load_model(L.LinearModel, str(tmp_path / "m"), spark)
    assert np.allclose(again.coef, m.coef) and again.intercept == 0.5 and again.features == ["a", "b"]
    with pytest.raises(ValueError):
        io.load_model(P.Affine, str(tmp_path / "m"), spark)
    assert 'coefficient="2.0"' in io.pmml_linear(m.features, m.coef, m.intercept, "y")


def test_knn_imputer_against_plain_loops(spark):
    from quarry.operators import kernel_models as K

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)).round(1)
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    got = {r.id: tuple(r)[1:] for r in K.knn_imputer(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b", "c"], "id", 4).collect()}
    for i in range(60):
        d = np.nansum((x - x[i]) ** 2, axis=1)
        for c in range(3):
            order = [j for j in np.lexsort((np.arange(60), d)) if j != i and not np.isnan(x[j, c])][:4]
            want = x[order, c].mean() if np.isnan(x[i, c]) else x[i, c]
            assert got[i][c] == pytest.approx(want)


def test_adjusted_mutual_info_against_all_cells(spark):
    from math import exp, lgamma, log

    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, 300), rng.integers(0, 3, 300)
    b[:120] = a[:120] % 3
    n, g = 300, lambda v: lgamma(v + 1)
    na, nb = np.bincount(a).tolist(), np.bincount(b).tolist()
    emi = 0.0
    for x in na:
        for z in nb:
            for k in range(max(1, x + z - n), min(x, z) + 1):
                emi += k / n * log(n * k / (x * z)) * exp(g(x) + g(z) + g(n - x) + g(n - z) - g(n) - g(k) - g(x - k) - g(z - k) - g(n - x - z + k))
    mi = sum(c / n * log(c * n / (na[i] * nb[j])) for i in range(4) for j in range(3) if (c := int(((a == i) & (b == j)).sum())))
    h = max(-sum(v / n * log(v / n) for v in m) for m in (na, nb))
    df = spark.createDataFrame([(int(p), int(q)) for p, q in zip(a, b, strict=True)], "a int, b int")
    assert M.adjusted_mutual_info(df, "a", "b") == pytest.approx((mi - emi) / (h - emi))


def test_stratified_groups_go_to_the_least_deviation(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), int(rng.integers(0, 3)), k) for k, g in enumerate(rng.integers(0, 40, 500))]
    counts = {}
    for g, c, _ in rows:
        counts.setdefault(g, [0, 0, 0])[c] += 1
    share = [sum(v[c] for v in counts.values()) / 4 for c in range(3)]
    load, want = [[0] * 3 for _ in range(4)], {}
    for g, v in sorted(counts.items(), key=lambda r: (-sum(r[1]), r[0])):
        score = [sum((a + b - t) ** 2 for a, b, t in zip(one, v, share, strict=True)) for one in load]
        f = score.index(min(score))
        load[f] = [a + b for a, b in zip(load[f], v, strict=True)]
        want[g] = f
    df = spark.createDataFrame(rows, "g long, y int, k long")
    assert {(r.g, r.fold) for r in S.stratified_group_k_fold(df, "g", "y", 4).collect()} == set(want.items())
    load, want = [0] * 4, {}
    for g, v in sorted(counts.items(), key=lambda r: (-sum(r[1]), r[0])):
        f = load.index(min(load))
        load[f] += sum(v)
        want[g] = f
    assert {(r.g, r.fold) for r in S.group_k_fold(df, "g", 4).collect()} == set(want.items())


def test_turns_are_those_of_one_by_one():
    rng = np.random.default_rng(8)
    for _ in range(200):
        k = int(rng.integers(1, 6))
        load = [int(v) for v in rng.integers(0, 60, k)]
        step, n = int(rng.integers(1, 9)), int(rng.integers(0, 60))
        plain, want = list(load), []
        for _ in range(n):
            f = plain.index(min(plain))
            plain[f] += step
            want.append(f)
        parts = S._turns(load, step, n)
        assert [f for a, e, folds in parts for j in range(a, e) for f in [folds[(j - a) % len(folds)]]] == want and load == plain
