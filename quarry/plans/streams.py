"""Queries of streaming, readers and generators. A streaming query runs over all files that are there and ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import linear as L
from quarry.sources import io
from quarry.streaming import models as S


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a streaming aggregate over all there is, from a memory sink."""
    name = f"drained_{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="quarry-stream-")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stamps(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_timestamp(c) for c in columns})


def sgd(s, d):
    m = S.PartialSGD(["a"], "y", "squared_error", 0.5, 0.0, "constant")
    x = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_quantity") / 25 + 1).alias("y"))
    for _ in range(25):
        m.update(x)
    return rounded(s.createDataFrame([(float(m.w[0]), float(m.w[1]))], "intercept double, slope double"), 1)


QUERIES = {
    "stream_tumbling_window": (lambda s, d: stamps(rounded(drained(S.windowed(stream(s, d, "events"), "ts", "1 hour", "1 day", None, ["event_type"], "value")).drop("mean"), 4), "start", "end"), """
SELECT epoch(date_trunc('day', ts))::BIGINT AS start, epoch(date_trunc('day', ts))::BIGINT + 86400 AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total  FROM events GROUP BY ALL"""),
    "stream_sliding_window": (lambda s, d: stamps(rounded(drained(S.windowed(stream(s, d, "events"), "ts", "1 hour", "2 days", "1 day", [], "value")).drop("mean"), 4), "start", "end"), """
WITH t AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS d, value FROM events), x AS (SELECT d AS start, value FROM t UNION ALL SELECT d - 86400, value FROM t) SELECT start, start + 172800 AS "end", count(*) AS n, round(sum(value), 4) AS total  FROM x GROUP BY start"""),
    "session_window": (lambda s, d: S.sessions(s.read.parquet(f"{d}/events.parquet"), "ts", "1 hour", "30 minutes", "user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events")), """
WITH t AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) SELECT count(*) FILTER (p IS NULL OR ts >= p + INTERVAL 30 MINUTE) AS sessions, count(*) AS events FROM t"""),
    "stream_class_moments": (lambda s, d: rounded(drained(S.class_moments(stream(s, d, "events"), ["value"], "event_type")), 3), "SELECT event_type, count(*) AS n, round(sum(value), 3) AS s_value, round(sum(value * value), 3) AS q_value FROM events GROUP BY 1"),
    "partial_fit_sgd": (sgd, """
WITH RECURSIVE g AS (SELECT avg(l_quantity / 50) AS a, avg(l_quantity / 50 * l_quantity / 50) AS aa, avg(l_quantity / 25 + 1) AS y, avg(l_quantity / 50 * (l_quantity / 25 + 1)) AS ay FROM lineitem),
r AS (SELECT 0 AS it, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS wa UNION ALL SELECT it + 1, w0 - 0.5 * (w0 + wa * a - y), wa - 0.5 * (w0 * a + wa * aa - ay) FROM r, g WHERE it < 25) SELECT round(w0, 1) AS intercept, round(wa, 1) AS slope FROM r WHERE it = 25"""),
    "make_regression": (lambda s, d: rounded(L.ols(L.gram(x := io.make_regression(s, 2000, 2), ["x0", "x1"], ["y"])).table(x).where("term = 'intercept'"), 3), "SELECT 'intercept' AS term, 0.0::DOUBLE AS value"),
    "make_blobs": (lambda s, d: io.make_blobs(s, 900, 3).groupBy("label").agg(F.count("*").alias("n")), "SELECT range::INT AS label, 300::BIGINT AS n FROM range(3)"),
    "sparse_triplets": (lambda s, d: io.spmm(io.transpose(t := io.to_triplets(s.read.parquet(f"{d}/nation.parquet"), "n_nationkey", ["n_nationkey", "n_regionkey"])), t), """
SELECT 0 AS row, 0 AS col, sum(n_nationkey * n_nationkey)::DOUBLE AS val FROM nation UNION ALL SELECT 0, 1, sum(n_nationkey * n_regionkey)::DOUBLE FROM nation UNION ALL SELECT 1, 0, sum(n_nationkey * n_regionkey)::DOUBLE FROM nation UNION ALL SELECT 1, 1, sum(n_regionkey * n_regionkey)::DOUBLE FROM nation"""),
}
