"""Files fetched, named data sets, model bytes, grouping sets, the as-of join on odd rows, boosting, gradient steps and paired components."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.special import Dirichlet
from quarry.operators import linear as L
from quarry.operators import relational as R
from quarry.operators import trees as T
from quarry.operators.linear import LinearModel
from quarry.sources import datasets as D
from quarry.sources import io
from quarry.streaming.models import SGD


def test_fetch(tmp_path):
    source = tmp_path / "x.csv"
    source.write_text("a,target\n1,2\n")
    good = hashlib.sha256(source.read_bytes()).hexdigest()
    home = str(tmp_path / "home")
    path = D.fetch_file(source.as_uri(), home, "iris.csv", good)
    source.unlink()
    assert D.fetch_file(source.as_uri(), home, "iris.csv", good) == path  # not fetched again
    with pytest.raises(ValueError):
        D.fetch_file(source.as_uri(), home, "iris.csv", "0" * 64)
    D.clear_data_home(home)
    assert D.dataset_dir("a", home).endswith("home/a")


def test_named_set(spark, tmp_path):
    (tmp_path / "iris.csv").write_text("target,a,b\n0,1.5,2\n1,,3\n")
    df, features, y = D.load_dataset(spark, "iris", f"file://{tmp_path}")
    assert (features, y) == (["a", "b"], "target") and df.count() == 2
    df.withColumn("c", F.lit(1)).write.parquet(f"file://{tmp_path}/own.parquet")
    assert D.load_dataset(spark, "own", f"file://{tmp_path}")[2] == "c"


def test_model_bytes():
    m = LinearModel(["a"], np.array([2.0]), 1.0)
    back = io.model_from_bytes(LinearModel, io.model_bytes(m))
    assert back.coef.tolist() == [2.0] and back.intercept == 1.0
    with pytest.raises(ValueError):
        io.model_from_bytes(Dirichlet, io.model_bytes(m))


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_as_of(spark, span):
    rng = np.random.default_rng(3)
    key = lambda: None if rng.random() < 0.1 else ["a", "b"][int(rng.random() < 0.9)]
    time = lambda: None if rng.random() < 0.1 else int(rng.integers(-30, 60))
    left = [(i, key(), time()) for i in range(150)] + [(1, "a", 5), (1, "a", 5)]
    right = [(key(), time(), int(rng.integers(100))) for _ in range(60)]
    got = R.as_of_join(spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int"), "t", "k", ["v"], span).collect()
    want = []
    for i, k, t in left:
        old = [(u, v) for q, u, v in right if k is not None and t is not None and q == k and u is not None and u <= t]
        want.append((i, k, t, max(old)[1] if old else None))
    assert Counter(map(tuple, got)) == Counter(want)
    none = R.as_of_join(spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame([], "k string, t long, v int"), "t", "k", ["v"], span).collect()
    assert len(none) == len(left) and all(r[3] is None for r in none)


def test_grouping_sets_of_nulls(spark):
    df = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    got = {tuple(r) for r in R.cube(df, ["k"], {"s": F.sum("v")}).collect()}
    assert got == {(None, 0, 1), ("x", 0, 2), (None, 1, 3)}


def test_dirichlet():
    d = Dirichlet((1.0, 1.0, 1.0))
    assert abs(d.pdf((0.2, 0.3, 0.5)) - 2) < 1e-12
    assert np.allclose(d.sample(np.random.default_rng(0), 20_000).mean(0), 1 / 3, atol=0.01)
    for bad in ((0.5, 0.6, 0.1), (1.0, 0.0, 0.0), (0.5, 0.5)):
        with pytest.raises(ValueError):
            d.log_pdf(bad)


def test_boosting_of_two_and_three(spark):
    df = spark.createDataFrame([(float(i), ["x", "y", "z"][i // 20]) for i in range(60)], "a double, c string")
    m = T.gradient_boosting_multiclass(df, ["a"], "c", 5, 0.5, 2)
    assert df.where(m.predict() != F.col("c")).count() == 0
    p = df.select(*[v.alias(f"p{k}") for k, v in enumerate(m.probabilities())]).first()
    assert abs(sum(p) - 1) < 1e-12 and p[0] == max(p)
    with pytest.raises(ValueError):
        T.gradient_boosting_multiclass(df.where("c = 'x'"), ["a"], "c")


def test_sgd_classes(spark):
    df = spark.createDataFrame([(i / 10, "low" if i < 15 else "high") for i in range(30)], "a double, c string")
    m = SGD(["a"], "c", "log_loss", 0.5, 1e-4, "constant", tol=0.0).fit(df, lambda e: F.lit(0), 1, 80, True)
    assert m.classes == ["high", "low"] and df.where(m.predict() != F.col("c")).count() <= 3
    part = SGD(["a"], "c", "hinge").partial_fit(df, True)
    assert part.t == 1 and part.partial_fit(df.where("false")).t == 1
    with pytest.raises(ValueError):
        SGD(["a"], "c", "hinge").partial_fit(df.where("c = 'low'"), True)


def test_pairing_by_rows(spark):
    """Directions from products equal those of the power method on the rows themselves, deflated by both scores."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = np.column_stack([x[:, 0] + rng.normal(size=200), x[:, 1] - x[:, 2], rng.normal(size=200)])
    df = spark.createDataFrame(np.column_stack([x, y]).tolist(), "a double, b double, c double, y double, z double, w double")
    m = L.pairing(L.gram(df, ["a", "b", "c"], ["y", "z", "w"]), 2)
    got = np.array(m.transform(df).select("u0", "u1", "v0", "v1").collect())
    x, y = ((v - v.mean(0)) / v.std(0, ddof=1) for v in (x, y))
    for k in range(2):
        u = y[:, 0]
        for _ in range(2000):
            w = x.T @ u / np.linalg.norm(x.T @ u)
            t = x @ w
            c = y.T @ t / np.linalg.norm(y.T @ t)
            u = y @ c
        turn = np.sign(w[np.abs(w).argmax()])
        assert np.allclose(got[:, k], turn * t, atol=1e-6) and np.allclose(got[:, 2 + k], turn * u, atol=1e-6)
        x, y = x - np.outer(t, x.T @ t / (t @ t)), y - np.outer(u, y.T @ u / (u @ u))
