"""Connected components by alternating star contractions on edge tables.

Every round joins each node's edges to the smallest neighbour of the node and is written to the shared folder, so the
lineage stays short and nothing is collected. Hubs are joined by look_up, which splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import look_up, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (u long, v long); root is the smallest node of the component."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = look_up(both, least, ["u"], "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = look_up(large, least, ["u"], "n", large.count())
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        before, state = state, _state(e)
        if state == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
