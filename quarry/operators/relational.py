"""Relational operators that a DataFrame has no single method for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: dict[str, Column]) -> DataFrame:
    """One aggregate for all ``sets`` of keys; keys that a set leaves out are null, and ``grouping_id`` tells these from nulls of the data (a bit for each key left out, the first key highest)."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().alias("grouping_id"), *[e.alias(n) for n, e in aggs.items()])


def rollup(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return grouping_sets(df, [keys[:k] for k in range(len(keys), -1, -1)], aggs)


def cube(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    return grouping_sets(df, [[c for i, c in enumerate(keys) if not m >> i & 1] for m in range(1 << len(keys))], aggs)


def as_of_join(left: DataFrame, right: DataFrame, on: str, by: str, values: list[str], span: int) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of the same ``by`` whose ``on`` (a long) isn't later; null if there is none. Of rows at one time the largest values.

    Both sides go once through windows of (key, ``span`` units of time), so that a hot key is spread over many tasks; what a stretch starts with comes from the last row of the
    stretches before it, of which there is one row each. ``left`` rows with a null key or time stay, with nulls."""
    v = F.struct(*[F.col(c) for c in values])
    a = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.col(by).alias("_k"), F.col(on).alias("_t"), F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType).alias("_v"))
    last = right.where(F.col(on).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(on).alias("_t")).agg(F.max(v).alias("_v"))
    b = last.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), "_k", "_t", "_v")
    cell = F.floor(F.col("_t") / span).alias("_c")
    heads = last.groupBy("_k", cell).agg(F.max_by("_v", "_t").alias("_h"))
    places = a.select("_k", cell).union(last.select("_k", cell)).distinct()
    from pyspark.sql import Window

    before = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = places.join(heads, ["_k", "_c"], "left").select("_k", "_c", F.last("_h", True).over(before).alias("_s"))
    inside = Window.partitionBy("_k", "_c").orderBy("_t", F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    x = a.union(b).withColumn("_c", F.floor(F.col("_t") / span)).withColumn("_in", F.last("_v", True).over(inside)).where("_l IS NOT NULL")
    key = x["_k"].eqNullSafe(starts["_k"]) & x["_c"].eqNullSafe(starts["_c"])
    found = F.when(F.col("_l")[by].isNotNull() & F.col("_l")[on].isNotNull(), F.coalesce("_in", "_s"))
    return x.join(starts, key, "left").withColumn("_f", found).select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_f")[c].alias(f"asof_{c}") for c in values])
