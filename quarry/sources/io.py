"""Readers, writers, generated datasets and saved models."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """(row, label, col, val): sparse triplets of a text file of `label index:value ...` lines (indices from 1; comments after #)."""
    lines = spark.read.text(path).withColumn("row", F.monotonically_increasing_id())
    x = lines.select("row", F.split(F.trim(F.regexp_replace("value", r"#.*", "")), r"\s+").alias("p")).where("p[0] <> ''")
    x = x.select("row", F.col("p")[0].cast("double").alias("label"), F.explode_outer(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("e"))
    return x.where("e IS NULL OR e NOT LIKE 'qid:%'").select("row", "label", (F.split("e", ":")[0].cast("int") - 1).alias("col"), F.split("e", ":")[1].cast("double").alias("val"))


def write_svmlight(df: DataFrame, label: str, features: list[str], path: str) -> None:
    """One line for each row, zeros left out."""
    parts = [F.when(F.col(c) != 0, F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(features, 1)]
    df.select(F.concat_ws(" ", F.col(label).cast("string"), *parts).alias("value")).write.text(path)


def read_text_folders(spark: SparkSession, path: str) -> DataFrame:
    """(text, category, path) of a folder with a folder of text files for each category."""
    x = spark.read.text(f"{path}/*/*", wholetext=True).withColumn("path", F.input_file_name())
    return x.select(F.col("value").alias("text"), F.element_at(F.split("path", "/"), -2).alias("category"), "path")


def to_triplets(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(row, col, val) of the entries that aren't zero."""
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("val")) for i, c in enumerate(features)]))
    return df.select(F.col(key).alias("row"), e.alias("e")).select("row", "e.col", "e.val").where("val <> 0")


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two triplet matrices."""
    return a.join(b.select(F.col("row").alias("col"), F.col("col").alias("c2"), F.col("val").alias("v2")), "col").groupBy("row", F.col("c2").alias("col")).agg(F.sum(F.col("val") * F.col("v2")).alias("val"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))


def diags(spark: SparkSession, n: int, diagonals: dict[int, float]) -> DataFrame:
    """A square matrix with one value on each diagonal; those above the main one have positive offsets."""
    x = spark.range(n).withColumn("d", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(v)).alias("v")) for k, v in diagonals.items()])))
    x = x.select(F.col("id").alias("row"), (F.col("id") + F.col("d.k")).alias("col"), F.col("d.v").alias("val"))
    return x.where((F.col("col") >= 0) & (F.col("col") < n))


def hstack(a: DataFrame, b: DataFrame, a_columns: int) -> DataFrame:
    """Columns of ``b`` to the right of the ``a_columns`` of ``a``."""
    return a.unionByName(b.withColumn("col", F.col("col") + a_columns))


def vstack(a: DataFrame, b: DataFrame, a_rows: int) -> DataFrame:
    return a.unionByName(b.withColumn("row", F.col("row") + a_rows))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def _normal(seed: int, key: str, k: int) -> Column:
    """A standard normal from hashes of the row and feature: the same value wherever and whenever the row is made."""
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit(s), F.col(key)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))


def make_regression(spark: SparkSession, n: int, d: int = 10, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x0 ..., y): linear target; rows are made where they are needed."""
    w = np.random.default_rng(seed).uniform(0, 100, d)
    x = spark.range(n).select("id", *[_normal(seed, "id", k).alias(f"x{k}") for k in range(d)])
    return x.withColumn("y", reduce(lambda a, b: a + b, [F.col(f"x{k}") * float(w[k]) for k in range(d)]) + noise * _normal(seed, "id", d))


def make_blobs(spark: SparkSession, n: int, centers: int = 3, d: int = 2, std: float = 1.0, seed: int = 0) -> DataFrame:
    c = np.random.default_rng(seed).uniform(-10, 10, (centers, d))
    x = spark.range(n).withColumn("label", (F.col("id") % centers).cast("int"))
    return x.select("id", *[(F.element_at(F.array(*[F.lit(float(v)) for v in c[:, k]]), F.col("label") + 1) + std * _normal(seed, "id", k)).alias(f"x{k}") for k in range(d)], "label")


def make_classification(spark: SparkSession, n: int, d: int = 5, classes: int = 2, sep: float = 2.0, seed: int = 0) -> DataFrame:
    return make_blobs(spark, n, classes, d, 1.0 / max(sep, 1e-9) * 2, seed)


def make_moons(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    x = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int"))
    t = F.floor(F.col("id") / 2) * (np.pi / max(1, n // 2 - 1))
    a = F.when(F.col("label") == 0, F.cos(t)).otherwise(1 - F.cos(t))
    b = F.when(F.col("label") == 0, F.sin(t)).otherwise(0.5 - F.sin(t))
    return x.select("id", (a + noise * _normal(seed, "id", 0)).alias("x0"), (b + noise * _normal(seed, "id", 1)).alias("x1"), "label")


def make_circles(spark: SparkSession, n: int, factor: float = 0.8, noise: float = 0.0, seed: int = 0) -> DataFrame:
    x = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int"))
    t, r = F.floor(F.col("id") / 2) * (2 * np.pi / max(1, n // 2)), F.when(F.col("label") == 0, 1.0).otherwise(factor)
    return x.select("id", (r * F.cos(t) + noise * _normal(seed, "id", 0)).alias("x0"), (r * F.sin(t) + noise * _normal(seed, "id", 1)).alias("x1"), "label")


def _uniform(seed: int, key: str, k: int) -> Column:
    """Uniform within 0 and 1, made like _normal."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit("u"), F.col(key)), F.lit(1 << 40)) / float(1 << 40)


def _noisy(df: DataFrame, target: Column, noise: float, seed: int, name: str = "y") -> DataFrame:
    return df.withColumn(name, target + noise * _normal(seed, "id", 99) if noise else target)


def make_swiss_roll(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x0, x1, x2, t): a plane rolled up; t is the position along it."""
    x = spark.range(n).withColumn("t", 1.5 * np.pi * (1 + 2 * _uniform(seed, "id", 0)))
    e = [noise * _normal(seed, "id", k) for k in range(3)]
    return x.select("id", (F.col("t") * F.cos("t") + e[0]).alias("x0"), (21 * _uniform(seed, "id", 1) + e[1]).alias("x1"), (F.col("t") * F.sin("t") + e[2]).alias("x2"), "t")


def make_s_curve(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x0, x1, x2, t): a plane bent into an S."""
    x = spark.range(n).withColumn("t", 3 * np.pi * (_uniform(seed, "id", 0) - 0.5))
    e = [noise * _normal(seed, "id", k) for k in range(3)]
    return x.select("id", (F.sin("t") + e[0]).alias("x0"), (2 * _uniform(seed, "id", 1) + e[1]).alias("x1"), (F.signum("t") * (F.cos("t") - 1) + e[2]).alias("x2"), "t")


def make_sparse_uncorrelated(spark: SparkSession, n: int, d: int = 10, seed: int = 0) -> DataFrame:
    """(id, x0 ..., y): y is x0 + 2 x1 - 2 x2 - 1.5 x3 with noise 1."""
    x = spark.range(n).select("id", *[_normal(seed, "id", k).alias(f"x{k}") for k in range(d)])
    return _noisy(x, F.col("x0") + 2 * F.col("x1") - 2 * F.col("x2") - 1.5 * F.col("x3"), 1.0, seed)


def make_friedman1(spark: SparkSession, n: int, d: int = 10, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x0 ..., y): y is 10 sin(pi x0 x1) + 20 (x2 - 1/2)^2 + 10 x3 + 5 x4."""
    x = spark.range(n).select("id", *[_uniform(seed, "id", k).alias(f"x{k}") for k in range(d)])
    return _noisy(x, 10 * F.sin(np.pi * F.col("x0") * F.col("x1")) + 20 * (F.col("x2") - 0.5) ** 2 + 10 * F.col("x3") + 5 * F.col("x4"), noise, seed)


def _circuit(spark: SparkSession, n: int, seed: int) -> DataFrame:
    low, high = [0, 40 * np.pi, 0, 1], [100, 560 * np.pi, 1, 11]
    return spark.range(n).select("id", *[(a + (b - a) * _uniform(seed, "id", k)).alias(f"x{k}") for k, (a, b) in enumerate(zip(low, high, strict=True))])


def make_friedman2(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x0 ... x3, y): the impedance sqrt(x0^2 + (x1 x2 - 1 / (x1 x3))^2)."""
    return _noisy(_circuit(spark, n, seed), F.sqrt(F.col("x0") ** 2 + (F.col("x1") * F.col("x2") - 1 / (F.col("x1") * F.col("x3"))) ** 2), noise, seed)


def make_friedman3(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, x0 ... x3, y): the phase atan((x1 x2 - 1 / (x1 x3)) / x0)."""
    return _noisy(_circuit(spark, n, seed), F.atan((F.col("x1") * F.col("x2") - 1 / (F.col("x1") * F.col("x3"))) / F.col("x0")), noise, seed)


def make_low_rank_matrix(spark: SparkSession, n: int, d: int = 100, rank: int = 10, tail: float = 0.5, seed: int = 0) -> DataFrame:
    """(id, x0 ...): random rows through ``d`` directions whose singular values fall as a bell of width ``rank`` with a tail."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    i = np.arange(d) / rank
    s = (1 - tail) * np.exp(-i * i) + tail * np.exp(-0.1 * i)
    keep = int((s > 1e-8).sum())
    z = [_normal(seed, "id", k) * float(s[k] / np.sqrt(max(n, 1))) for k in range(keep)]
    x = spark.range(n).select("id", F.array(*z).alias("z"))
    return x.select("id", *[F.aggregate(F.zip_with("z", F.array(*[F.lit(float(v)) for v in q[j, :keep]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias(f"x{j}") for j in range(d)])


def make_spd_matrix(d: int, seed: int = 0) -> np.ndarray:
    """A random symmetric positive definite matrix."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * (1 + np.random.default_rng(seed + 1).uniform(size=d)) @ q.T


def make_sparse_spd_matrix(d: int, alpha: float = 0.95, low: float = 0.1, high: float = 0.9, seed: int = 0) -> np.ndarray:
    """A positive definite matrix from a triangular root whose entries below the diagonal are 0 with probability ``alpha``."""
    rng = np.random.default_rng(seed)
    m = np.eye(d) + np.tril(np.where(rng.random((d, d)) < alpha, 0, rng.uniform(low, high, (d, d)) * rng.choice([-1, 1], (d, d))), -1)
    return m @ m.T


def make_gaussian_quantiles(spark: SparkSession, n: int, d: int = 2, classes: int = 3, cov: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, x0 ..., label): one Gaussian, classes by rings of equal probability (the chi-squared quantiles of its radius)."""
    from quarry.functions.special import chi_squared

    c = chi_squared(d)
    edges = [c.ppf(k / classes) for k in range(1, classes)]
    x = spark.range(n).select("id", *[(np.sqrt(cov) * _normal(seed, "id", k)).alias(f"x{k}") for k in range(d)])
    r = reduce(lambda a, b: a + b, [F.col(f"x{k}") ** 2 for k in range(d)]) / cov
    return x.withColumn("label", reduce(lambda a, b: a + b, [(r > e).cast("int") for e in edges], F.lit(0)))


def make_hastie_10_2(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, x0 ... x9, label): 1 where the squared radius is above 9.34, else -1."""
    x = spark.range(n).select("id", *[_normal(seed, "id", k).alias(f"x{k}") for k in range(10)])
    return x.withColumn("label", F.when(reduce(lambda a, b: a + b, [F.col(f"x{k}") ** 2 for k in range(10)]) > 9.34, 1).otherwise(-1))


def make_multilabel_classification(spark: SparkSession, n: int, d: int = 20, classes: int = 5, labels: int = 2, seed: int = 0) -> DataFrame:
    """(id, x0 ..., l0 ...): each class holds with probability labels / classes and shifts the features by its own pattern."""
    p = np.random.default_rng(seed).normal(0, 2, (classes, d))
    x = spark.range(n).select("id", *[(_uniform(seed, "id", 1000 + c) < labels / classes).cast("int").alias(f"l{c}") for c in range(classes)])
    return x.select("id", *[(_normal(seed, "id", k) + reduce(lambda a, b: a + b, [F.col(f"l{c}") * float(p[c, k]) for c in range(classes)])).alias(f"x{k}") for k in range(d)], *[f"l{c}" for c in range(classes)])


def _plain(v):
    if is_dataclass(v):
        return {"_type": type(v).__name__} | {k: _plain(x) for k, x in asdict(v).items()}
    if isinstance(v, np.ndarray):
        return {"_array": v.tolist()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v.item() if isinstance(v, np.generic) else v


def model_bytes(model) -> bytes:
    """A model of plain parameters as one JSON line with a version."""
    return json.dumps({"version": 1, "model": _plain(model)}).encode()


def save_model(model, path: str, spark: SparkSession) -> None:
    """What model_bytes gives, written where Spark can write."""
    spark.createDataFrame([(model_bytes(model).decode(),)], "value string").coalesce(1).write.text(path)


def _object(v):
    if isinstance(v, dict):
        if "_array" in v:
            return np.array(v["_array"])
        return {k: _object(x) for k, x in v.items() if k != "_type"}
    return [_object(x) for x in v] if isinstance(v, list) else v


def model_from_bytes(kind, data: bytes):
    """An object of class ``kind`` from what model_bytes gave."""
    saved = json.loads(data)
    if saved["version"] != 1 or saved["model"]["_type"] != kind.__name__:
        raise ValueError("another model or version")
    return kind(**_object(saved["model"]))


def load_model(kind, path: str, spark: SparkSession):
    """An object of class ``kind`` from what save_model wrote."""
    return model_from_bytes(kind, spark.read.text(path).first()[0].encode())


def pmml_linear(features: list[str], coef, intercept: float, target: str) -> str:
    """A linear regression model as PMML 4.4."""
    from xml.sax.saxutils import quoteattr

    fields = "".join(f'<DataField name={quoteattr(c)} optype="continuous" dataType="double"/>' for c in [*features, target])
    used = "".join(f"<MiningField name={quoteattr(c)}/>" for c in features) + f'<MiningField name={quoteattr(target)} usageType="target"/>'
    terms = "".join(f'<NumericPredictor name={quoteattr(c)} coefficient="{float(w)!r}"/>' for c, w in zip(features, coef, strict=True))
    return f'<PMML version="4.4" xmlns="http://www.dmg.org/PMML-4_4"><Header/><DataDictionary>{fields}</DataDictionary><RegressionModel functionName="regression"><MiningSchema>{used}</MiningSchema><RegressionTable intercept="{float(intercept)!r}">{terms}</RegressionTable></RegressionModel></PMML>'


# --- ONNX ---------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | str) -> bytes:
    """A protocol-buffer field: an integer, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _tensor(name: str, a: np.ndarray) -> bytes:
    return b"".join(_field(1, int(v)) for v in a.shape) + _field(2, 1) + _field(8, name) + _field(9, a.astype("<f4").tobytes())


def _node(kind: str, inputs: list[str], output: str) -> bytes:
    return b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, kind)


def _value(name: str, width: int) -> bytes:
    shape = _field(1, _field(2, "n")) + _field(1, _field(1, width))
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))


def onnx_layers(layers: list[tuple[np.ndarray, np.ndarray]], activation: str = "identity", last: str = "identity", scaling: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
    """An ONNX model (opset 13, 32-bit floats) of dense layers (weights, offsets) from ``input`` to ``output``, after (x - mean) / scale if given. One layer is a linear or
    logistic model; a network's layers come from Network.layers()."""
    kinds = {"relu": "Relu", "tanh": "Tanh", "logistic": "Sigmoid", "softmax": "Softmax"}
    nodes, tensors, at = [], [], "input"
    if scaling:
        tensors += [_tensor("mean", np.asarray(scaling[0])), _tensor("scale", np.asarray(scaling[1]))]
        nodes += [_node("Sub", ["input", "mean"], "centred"), _node("Div", ["centred", "scale"], "scaled")]
        at = "scaled"
    for k, (w, b) in enumerate(layers):
        end, f = k == len(layers) - 1, kinds.get(last if k == len(layers) - 1 else activation)
        tensors += [_tensor(f"w{k}", np.asarray(w)), _tensor(f"b{k}", np.asarray(b))]
        nodes += [_node("MatMul", [at, f"w{k}"], f"m{k}"), _node("Add", [f"m{k}", f"b{k}"], f"z{k}" if f or not end else "output")]
        at = f"z{k}"
        if f:
            nodes.append(_node(f, [at], "output" if end else f"h{k}"))
            at = f"h{k}"
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "model") + b"".join(_field(5, t) for t in tensors)
    graph += _field(11, _value("input", np.asarray(layers[0][0]).shape[0])) + _field(12, _value("output", np.asarray(layers[-1][0]).shape[1]))
    return _field(1, 8) + _field(2, "quarry") + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))
