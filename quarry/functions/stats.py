"""Column expressions and one-pass statistics that many operators share."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(x: Column) -> Column:
    """``x`` with NaN as null: missing values are left out of aggregates."""
    return F.when(~F.isnan(x), x)


def safe_div(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def quantiles(x: str | Column, probs: list[float]) -> Column:
    """Exact quantiles with linear interpolation, as an array."""
    return F.percentile(present(F.col(x) if isinstance(x, str) else x), F.array(*map(F.lit, probs)))


def order_statistics(df: DataFrame, x: Column, ranks: list[int], few: int = 50_000) -> list[float]:
    """The values of ``x`` (double, not null) at ``ranks`` from 0, exact, without all distinct values in one place. Counts in 4,096 bins of
    equal width narrow the range of a rank, or counts between approximate quantiles where rows are bunched (slower), until at most ``few`` rows or one value are left, whose counts
    by value come to the driver."""
    v = df.select(x.alias("v")).where("v IS NOT NULL")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    known: list[tuple[float, int, int]] = []  # values with their first rank and the one after their last
    for rank in ranks:
        if any(a <= rank < b for _, a, b in known):
            continue
        lo, hi, below, inside, even = low, high, 0, n, True
        while inside > few and lo != hi:
            part = v.where(F.col("v").between(lo, hi))
            if even and math.isfinite(hi - lo):
                for _, count, a, b in sorted(part.groupBy(F.floor((F.col("v") - lo) / (hi - lo) * 4096).alias("bin")).agg(F.count("*"), F.min("v"), F.max("v")).collect()):
                    if below + count > rank:
                        break
                    below += count
                lo, hi, even, inside = a, b, count * 16 <= inside, count
                continue
            even = True
            p, eps = (rank - below + 1) / inside, 4e-4
            marks = part.agg(F.percentile_approx("v", [max(p - eps, 0.0), p, min(p + eps, 1.0)], 10_000)).first()[0]
            edges = sorted({lo, *marks, hi})
            # rows at each edge, and between it and the next
            cells = [c for a, b in itertools.pairwise(edges) for c in (F.col("v") == a, (F.col("v") > a) & (F.col("v") < b))] + [F.col("v") == hi]
            counts, k = part.agg(*[F.count(F.when(c, 1)) for c in cells]).first(), 0
            while below + counts[k] <= rank:
                below += counts[k]
                k += 1
            inside, at = counts[k], k // 2
            lo, hi = (edges[at], edges[at]) if k % 2 == 0 else (math.nextafter(edges[at], math.inf), math.nextafter(edges[at + 1], -math.inf))
        counted = [(lo, inside)] if lo == hi else sorted(v.where(F.col("v").between(lo, hi)).groupBy("v").count().collect())
        for value, count in counted:
            known.append((value, below, below + count))
            below += count
    return [next(v for v, a, b in known if a <= rank < b) for rank in ranks]


def running(df: DataFrame, key: str, sums: list[str], descending: bool = False, buckets: int = 64) -> DataFrame:
    """``df`` (one row for each ``key``) with running totals cum_<name> of ``sums`` in order of ``key``.

    A window over everything would put all rows into one task. Keys are dealt into buckets by approximate
    quantiles instead: windows run within buckets, and totals of the buckets before (at most ``buckets`` rows) are added.
    """
    marks = df.select(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 10_000).alias("m"))
    bucketed = df.crossJoin(F.broadcast(marks)).withColumn("_b", F.size(F.filter("m", lambda x: x < F.col(key)))).drop("m")
    order = F.desc(key) if descending else F.asc(key)
    totals = bucketed.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    ahead = Window.orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = bucketed.withColumns({f"_c_{c}": F.sum(c).over(inside) for c in sums}).join(F.broadcast(before), "_b")
    return out.select(*df.columns, *[(F.col(f"_c_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, -0.0 as 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
