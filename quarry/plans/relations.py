"""Queries of relational operators, readers, writers and containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.functions.tables import scratch
from quarry.operators import linear as L
from quarry.operators import relational as R
from quarry.plans.linear import DATA, XS, data, solved
from quarry.plans.metrics import _t
from quarry.sources import datasets, io

def totals():
    return {"n": F.count("*"), "quantity": F.sum("l_quantity")}


SUMMED = "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus)::BIGINT AS grouping_id, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY "


def written(kind):
    """A table through a file format and back."""

    def q(s, d):
        path = scratch(s)
        x = _t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
        x.write.format(kind).option("header", True).save(path)
        y = s.read.format(kind).schema(x.schema).option("header", True).load(path)
        return rounded(y.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"), F.sum("o_totalprice").alias("price")), 2)

    return q


WRITTEN = "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS customers, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1"


def svmlight(s, d):
    path = scratch(s)
    io.write_svmlight(_t(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"], path)
    return rounded(io.read_svmlight(s, path).select("label", "col", "val"), 4)


def folders(s, d):
    path = scratch(s)
    x = _t(s, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("value"))
    x.write.partitionBy("r").text(path)
    return io.read_text_folders(s, path).select("text", "category")


def kept(through):
    """The terms of a linear model after ``through(session, model)``."""
    return lambda s, d: rounded(through(s, L.ols(L.gram(x := data(s, d), XS, ["y"]))).table(x), 5)


def filed(s, m):
    path = scratch(s)
    io.save_model(m, path, s)
    return io.load_model(L.LinearModel, path, s)


def pmml(s, m):
    from xml.etree import ElementTree

    root = ElementTree.fromstring(io.pmml_linear(m.features, m.coef, m.intercept, "y"))
    table = next(e for e in root.iter() if e.tag.endswith("RegressionTable"))
    return L.LinearModel([e.get("name") for e in table], [float(e.get("coefficient")) for e in table], float(table.get("intercept")))


def onnx(s, d):
    import numpy as np
    import onnxruntime

    x = data(s, d)
    m = L.ols(L.gram(x, ["a"], ["y"]))
    run = onnxruntime.InferenceSession(io.onnx_layers([(np.array([m.coef]), np.array([m.intercept]))]))
    a = sorted(r[0] for r in x.select("a").distinct().collect())
    return rounded(s.createDataFrame([(v, float(p[0])) for v, p in zip(a, run.run(None, {"input": np.array(a, "f4")[:, None]})[0], strict=True)], "a double, p double"), 1)


def named(s, d):
    folder = scratch(s)
    _t(s, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").write.csv(f"{folder}/wine.csv", header=True)
    x, features, y = datasets.load_dataset(s, "wine", folder, "s_nationkey")
    return rounded(x.groupBy(y).agg(F.count("*").alias("n"), F.sum(features[1]).alias("total")).withColumnRenamed(y, "nation").select(F.col("nation").cast("long"), "n", "total"), 2)


def joined(s, d):
    e = _t(s, d, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return R.as_of_join(e.where("event_type <> 'purchase'").select("event_id", "user_id", "t"), e.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("bought")), "t", "user_id", ["bought"], 86_400_000_000)


def triplets(s, d):
    return io.to_triplets(_t(s, d, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"])


CELLS = "SELECT n_nationkey::BIGINT AS row, 0::BIGINT AS col, n_nationkey::DOUBLE AS val FROM nation WHERE n_nationkey <> 0 UNION ALL SELECT n_nationkey, 1, n_regionkey FROM nation WHERE n_regionkey <> 0"


def longs(df):
    return df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "val")


QUERIES = {
    "grouping_sets": (lambda s, d: R.grouping_sets(_t(s, d, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_linestatus"], []], totals()), SUMMED + "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())"),
    "cube": (lambda s, d: R.cube(_t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], totals()), SUMMED + "CUBE (l_returnflag, l_linestatus)"),
    "rollup": (lambda s, d: R.rollup(_t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], totals()), SUMMED + "ROLLUP (l_returnflag, l_linestatus)"),
    "as_of_join": (joined, "WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events), p AS (SELECT user_id, t, max(event_id) AS bought FROM e WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT event_id, e.user_id, e.t, bought AS asof_bought FROM (FROM e WHERE event_type <> 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.t >= p.t"),
    "semi_anti_join": (lambda s, d: (c := _t(s, d, "customer")).join(o := _t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.lit("semi").alias("kind"), "c_custkey").union(c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("anti"), "c_custkey")), "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'semi' ELSE 'anti' END AS kind, c_custkey FROM customer"),
    "distinct_rows": (lambda s, d: _t(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem"),
    "set_operations": (lambda s, d: (a := _t(s, d, "customer").select(F.col("c_custkey").alias("k"))).intersect(b := _t(s, d, "orders").select(F.col("o_custkey").alias("k"))).select(F.lit("both").alias("part"), "k").union(a.subtract(b).select(F.lit("left"), "k")).groupBy("part").agg(F.count("*").alias("n"), F.sum("k").alias("keys")), "WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders), x AS (SELECT 'both' AS part, k FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'left', k FROM (FROM a EXCEPT FROM b)) SELECT part, count(*) AS n, sum(k)::BIGINT AS keys FROM x GROUP BY 1"),
    "parquet_round_trip": (written("parquet"), WRITTEN),
    "csv_round_trip": (written("csv"), WRITTEN),
    "json_round_trip": (written("json"), WRITTEN),
    "orc_round_trip": (written("orc"), WRITTEN),
    "svmlight_round_trip": (svmlight, "SELECT p_partkey::DOUBLE AS label, 0 AS col, round(p_size::DOUBLE, 4) AS val FROM part WHERE p_size <> 0 UNION ALL SELECT p_partkey, 1, round(p_retailprice, 4) FROM part WHERE p_retailprice <> 0"),
    "text_folders": (folders, "SELECT string_agg(n_name, ',' ORDER BY n_name) || chr(10) AS text, 'r=' || n_regionkey AS category FROM nation GROUP BY n_regionkey"),
    "named_dataset": (named, "SELECT s_nationkey::BIGINT AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1"),
    "saved_model": (kept(filed), solved("0")),
    "model_bytes": (kept(lambda s, m: io.model_from_bytes(L.LinearModel, io.model_bytes(m))), solved("0")),
    "pmml_model": (kept(pmml), solved("0")),
    "onnx_model": (onnx, f"WITH {DATA}, m AS (SELECT regr_intercept(y, a) AS i, regr_slope(y, a) AS w FROM t) SELECT DISTINCT round(a, 1) AS a, round(i + w * a, 1) AS p FROM t, m"),
    "sparse_eye": (lambda s, d: longs(io.eye(s, _t(s, d, "nation").count())), "SELECT n_nationkey::BIGINT AS row, n_nationkey::BIGINT AS col, 1.0::DOUBLE AS val FROM nation"),
    "sparse_diagonals": (lambda s, d: longs(io.diags(s, _t(s, d, "nation").count(), {0: 2.0, 1: -1.0})), "SELECT n_nationkey::BIGINT AS row, n_nationkey::BIGINT AS col, 2.0::DOUBLE AS val FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 1, -1.0 FROM nation WHERE n_nationkey + 1 < (SELECT count(*) FROM nation)"),
    "sparse_hstack": (lambda s, d: longs(io.hstack(t := triplets(s, d), t, 2)), f"WITH c AS ({CELLS}) FROM c UNION ALL SELECT row, col + 2, val FROM c"),
    "sparse_vstack": (lambda s, d: longs(io.vstack(t := triplets(s, d), t, 25)), f"WITH c AS ({CELLS}) FROM c UNION ALL SELECT row + 25, col, val FROM c"),
}
