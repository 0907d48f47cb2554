"""Queries of clustering, graphs, splits and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import cluster as C
from quarry.operators import linear as L
from quarry.operators import selection as S
from quarry.plans.linear import DATA, XS, data
from quarry.plans.metrics import _t

P = ["a", "b"]
PART = "p AS (SELECT p_partkey AS i, p_size / 10 AS a, p_retailprice / 1000 AS b FROM part)"
EDGES = "e AS (SELECT n_nationkey AS u, (n_nationkey * 7 + 3) % 25 AS v, 1 + n_nationkey % 4 AS w FROM nation)"


def part(s, d):
    return _t(s, d, "part").select(F.col("p_partkey").cast("long").alias("i"), (F.col("p_size") / 10).alias("a"), (F.col("p_retailprice") / 1000).alias("b"))


def edges(s, d):
    n = F.col("n_nationkey")
    return _t(s, d, "nation").select(n.cast("long").alias("u"), ((n * 7 + 3) % 25).cast("long").alias("v"), (1 + n % 4).cast("double").alias("w"))


def centers(f):
    def q(s, d):
        m = f(x := part(s, d))
        return rounded(s.createDataFrame([(k, *map(float, c)) for k, c in enumerate(m)], "k int, a double, b double"), 4)

    return q


def seeded(s, d):
    return part(s, d).withColumn("l", F.when(F.col("i") % 10 == 0, (F.col("a") > 2.5).cast("int")))


def orders(s, d):
    return _t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def fold_sql(k, order="o_orderkey", part=""):
    return f"WITH n AS (SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS r, count(*) OVER ({part}) AS n FROM orders) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (CASE WHEN r < (n % {k}) * (n // {k} + 1) THEN r // (n // {k} + 1) ELSE n % {k} + (r - (n % {k}) * (n // {k} + 1)) // (n // {k}) END)::INT AS fold FROM n"


def dependence(s, d):
    x = data(s, d)
    m = L.ols(L.gram(x, XS, ["y"]))
    return rounded(S.partial_dependence(x, lambda put: sum((put.get(c, F.col(c)) * float(w) for c, w in zip(m.features, m.coef, strict=True)), F.lit(m.intercept)), "a", [0.0, 2.5, 5.0]), 4)


#: Lloyd rounds from the three smallest keys; the answer is that of the first round that moves no centre by 1e-4.
LLOYD = f"""WITH RECURSIVE {PART}, r AS (SELECT 0 AS it, k, x, y FROM (SELECT row_number() OVER (ORDER BY i) - 1 AS k, a AS x, b AS y FROM p QUALIFY k < 3)
UNION ALL SELECT it + 1, k, avg(a), avg(b) FROM (SELECT it, a, b, k FROM p, r QUALIFY row_number() OVER (PARTITION BY i ORDER BY (a - x) ** 2 + (b - y) ** 2, k) = 1) WHERE it < 100 GROUP BY it, k),
m AS (SELECT n.it, max(sqrt((n.x - o.x) ** 2 + (n.y - o.y) ** 2)) AS shift FROM r n JOIN r o ON n.it = o.it + 1 AND n.k = o.k GROUP BY 1)
SELECT k::INT AS k, round(x, 4) AS a, round(y, 4) AS b FROM r WHERE it = (SELECT min(it) FROM m WHERE shift < 1e-4)"""


def mixed(rounds: int, tol: str) -> str:
    """SQL of rounds of expectation and maximisation for two components from the two smallest keys; ends once the mean log-likelihood moves by less than ``tol``."""
    density = ", ".join(f"ln(u{j}) - ln(2 * pi()) - ln(p{j} * q{j} - o{j} * o{j}) / 2 - ((a - a{j}) ** 2 * q{j} - 2 * (a - a{j}) * (b - b{j}) * o{j} + (b - b{j}) ** 2 * p{j}) / (p{j} * q{j} - o{j} * o{j}) / 2 AS d{j}" for j in (1, 2))
    sums = ", ".join(f"sum(r{j}) AS n{j}, sum(r{j} * a) / sum(r{j}) AS a{j}, sum(r{j} * b) / sum(r{j}) AS b{j}, sum(r{j} * a * a) / sum(r{j}) AS aa{j}, sum(r{j} * a * b) / sum(r{j}) AS ab{j}, sum(r{j} * b * b) / sum(r{j}) AS bb{j}" for j in (1, 2))
    new = ", ".join(f"n{j} / (n1 + n2), a{j}, b{j}, aa{j} - a{j} * a{j} + 1e-6, ab{j} - a{j} * b{j}, bb{j} - b{j} * b{j} + 1e-6" for j in (1, 2))
    start = ", ".join(f"0.5::DOUBLE AS u{j}, s.a[{j}] AS a{j}, s.b[{j}] AS b{j}, va AS p{j}, 0.0::DOUBLE AS o{j}, vb AS q{j}" for j in (1, 2))
    return f"""WITH RECURSIVE {PART}, s AS (SELECT list(a ORDER BY i) AS a, list(b ORDER BY i) AS b FROM (FROM p ORDER BY i LIMIT 2)), v AS (SELECT var_pop(a) + 1e-6 AS va, var_pop(b) + 1e-6 AS vb FROM p),
r AS (SELECT 0 AS it, -1e300::DOUBLE AS ll, false AS done, {start} FROM s, v
UNION ALL SELECT it + 1, nl, abs(nl - ll) < {tol}, {new} FROM (SELECT it, ll, avg(lse) AS nl, {sums} FROM (SELECT *, exp(d1 - lse) AS r1, exp(d2 - lse) AS r2 FROM (SELECT *, greatest(d1, d2) + ln(exp(d1 - greatest(d1, d2)) + exp(d2 - greatest(d1, d2))) AS lse
FROM (SELECT it, ll, p.a, p.b, {density.replace("(a -", "(p.a -").replace("(b -", "(p.b -")} FROM r, p WHERE NOT done AND it < {rounds}))) GROUP BY it, ll)), l AS (FROM r ORDER BY it DESC LIMIT 1)
SELECT 0 AS k, round(a1, 4) AS a, round(b1, 4) AS b FROM l UNION ALL SELECT 1, round(a2, 4), round(b2, 4) FROM l"""


#: An edge is in the tree when edges before it, by weight and then ends, don't connect its ends.
SPANNING = f"""WITH RECURSIVE {EDGES}, d AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(w)::DOUBLE AS w FROM e WHERE u <> v GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY w, u, v) AS n FROM d), b AS (SELECT u, v, n FROM o UNION ALL SELECT v, u, n FROM o),
r AS (SELECT n, u AS node FROM o UNION SELECT r.n, b.v FROM r JOIN b ON b.u = r.node AND b.n < r.n) SELECT count(*) AS edges, sum(w) AS weight FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.n = o.n AND r.node = o.v)"""

QUERIES = {
    "kmeans_step": (centers(lambda x: C.kmeans(x, P, [[1.0, 1.0], [3.0, 1.5], [5.0, 2.0]], 1).centers), f"WITH {PART}, d AS (SELECT a, b, (a - 1) ** 2 + (b - 1) ** 2 AS x, (a - 3) ** 2 + (b - 1.5) ** 2 AS y, (a - 5) ** 2 + (b - 2) ** 2 AS z FROM p) SELECT CASE WHEN x <= y AND x <= z THEN 0 WHEN y <= z THEN 1 ELSE 2 END AS k, round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM d GROUP BY 1"),
    "kmeans": (centers(lambda x: C.kmeans(x, P, C.first_rows(x, P, "i", 3)).centers), LLOYD),
    "mini_batch_kmeans": (centers(lambda x: C.mini_batch_kmeans(x, P, C.first_rows(x, P, "i", 3)).centers), None),
    "bisecting_kmeans": (centers(lambda x: C.bisecting_kmeans(x, P, 4).centers), None),
    "gaussian_mixture": (centers(lambda x: C.gaussian_mixture(x, P, C.first_rows(x, P, "i", 2), max_iter=10).means), mixed(10, "1e-3")),
    "mean_shift": (centers(lambda x: C.mean_shift(x, P, 1.0, C.first_rows(x, P, "i", 6))), None),
    "dbscan": (lambda s, d: C.dbscan(part(s, d), P, "i", 0.05, 4), f"""WITH RECURSIVE {PART}, q AS (SELECT * FROM p), n AS (SELECT x.i, y.i AS j FROM q x, q y WHERE sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) <= 0.05), c AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 4),
l AS (SELECT n.i, n.j FROM n JOIN c ON n.i = c.i JOIN c c2 ON n.j = c2.i), r AS (SELECT i, i AS k FROM c UNION SELECT l.j, r.k FROM r JOIN l ON r.i = l.i), m AS (SELECT i, min(k) AS root FROM r GROUP BY 1), z AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS label FROM m)
SELECT q.i, coalesce((SELECT label FROM z WHERE z.i = q.i), (SELECT min(label) FROM n JOIN z ON n.j = z.i WHERE n.i = q.i), -1)::INT AS label FROM q"""),
    "connected_components": (lambda s, d: C.connected_components(edges(s, d)), f"WITH RECURSIVE {EDGES}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS k FROM b UNION SELECT b.v, r.k FROM r JOIN b ON r.node = b.u) SELECT node, min(k) AS root FROM r GROUP BY 1"),
    "dijkstra": (lambda s, d: C.shortest_paths(edges(s, d), 0).select("node", "distance"), f"WITH RECURSIVE {EDGES}, r AS (SELECT 0 AS node, 0.0::DOUBLE AS distance, 0 AS hops UNION SELECT e.v, r.distance + e.w, hops + 1 FROM r JOIN e ON r.node = e.u WHERE hops < 30) SELECT node::BIGINT AS node, min(distance) AS distance FROM r GROUP BY 1"),
    "minimum_spanning_tree": (lambda s, d: C.minimum_spanning_tree(edges(s, d)).agg(F.count("*").alias("edges"), F.sum("w").alias("weight")), SPANNING),
    "label_propagation": (lambda s, d: C.label_propagation(seeded(s, d), P, "i", "l", 20.0), None),
    "label_spreading": (lambda s, d: C.label_propagation(seeded(s, d), P, "i", "l", 20.0, alpha=0.2), None),
    "feature_agglomeration": (lambda s, d: rounded(C.feature_agglomeration(data(s, d).select("a", "b", (F.col("a") * 1.01).alias("e")), ["a", "b", "e"], 2).agg(*[F.avg(c).alias(c) for c in ("fa_0", "fa_1")])), f"WITH {DATA} SELECT round(avg(a * 2.01 / 2), 6) AS fa_0, round(avg(b), 6) AS fa_1 FROM t"),
    "k_fold": (lambda s, d: S.k_fold(orders(s, d), "o_orderkey", 7), fold_sql(7)),
    "stratified_k_fold": (lambda s, d: S.stratified_k_fold(orders(s, d), "o_orderkey", "o_orderstatus", 4).groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n")), """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT % 4 AS s FROM c)
SELECT o_orderstatus, fold::INT AS fold, (n // 4 + CASE WHEN (fold - s + 4) % 4 < n % 4 THEN 1 ELSE 0 END)::BIGINT AS n FROM b, range(4) x(fold)"""),
    "group_k_fold": (lambda s, d: S.group_k_fold(orders(s, d), "o_custkey", 3).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"), F.sum("o_custkey").alias("keys")), """WITH RECURSIVE g AS (SELECT o_custkey AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY 1),
f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS z, -1 AS fold UNION ALL SELECT q.r, x + CASE WHEN p = 0 THEN n ELSE 0 END, y + CASE WHEN p = 1 THEN n ELSE 0 END, z + CASE WHEN p = 2 THEN n ELSE 0 END, p FROM (SELECT g.r, g.n, x, y, z, CASE WHEN x <= y AND x <= z THEN 0 WHEN y <= z THEN 1 ELSE 2 END AS p FROM f JOIN g ON g.r = f.r + 1) q)
SELECT fold, sum(n)::BIGINT AS n, count(*) AS groups, sum(k * n)::BIGINT AS keys FROM f JOIN g USING (r) GROUP BY 1"""),
    "stratified_group_k_fold": (lambda s, d: S.stratified_group_k_fold(orders(s, d), "o_custkey", "o_orderstatus", 3).groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys")), """WITH RECURSIVE g AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS b, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS c, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY 1),
f AS (SELECT 0::BIGINT AS r, -1 AS fold, -sum(a) / 3 AS a0, -sum(b) / 3 AS b0, -sum(c) / 3 AS c0, -sum(a) / 3 AS a1, -sum(b) / 3 AS b1, -sum(c) / 3 AS c1, -sum(a) / 3 AS a2, -sum(b) / 3 AS b2, -sum(c) / 3 AS c2 FROM g
UNION ALL SELECT q.r, p, a0 + CASE WHEN p = 0 THEN a ELSE 0 END, b0 + CASE WHEN p = 0 THEN b ELSE 0 END, c0 + CASE WHEN p = 0 THEN c ELSE 0 END, a1 + CASE WHEN p = 1 THEN a ELSE 0 END, b1 + CASE WHEN p = 1 THEN b ELSE 0 END, c1 + CASE WHEN p = 1 THEN c ELSE 0 END, a2 + CASE WHEN p = 2 THEN a ELSE 0 END, b2 + CASE WHEN p = 2 THEN b ELSE 0 END, c2 + CASE WHEN p = 2 THEN c ELSE 0 END
FROM (SELECT *, CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS p FROM (SELECT g.r, a, b, c, a0, b0, c0, a1, b1, c1, a2, b2, c2, (a0 + a) ** 2 + (b0 + b) ** 2 + (c0 + c) ** 2 AS s0, (a1 + a) ** 2 + (b1 + b) ** 2 + (c1 + c) ** 2 AS s1, (a2 + a) ** 2 + (b2 + b) ** 2 + (c2 + c) ** 2 AS s2 FROM f JOIN g ON g.r = f.r + 1)) q)
SELECT fold, sum(n)::BIGINT AS n, sum(k * n)::BIGINT AS keys FROM f JOIN g USING (r) GROUP BY 1"""),
    "time_series_split": (lambda s, d: S.time_series_split(orders(s, d).select("o_orderkey"), "o_orderkey", 2, gap=5), "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, r < n - 2 * (n // 3) - 5 AS train_0, r >= n - 2 * (n // 3) AND r < n - n // 3 AS test_0, r < n - n // 3 - 5 AS train_1, r >= n - n // 3 AS test_1 FROM n"),
    "train_test_split": (lambda s, d: S.train_test_split(orders(s, d), "o_orderkey", 0.2).groupBy("test").agg(F.count("*").alias("n")), "SELECT false AS test, count(*) - round(count(*) * 0.2)::BIGINT AS n FROM orders UNION ALL SELECT true, round(count(*) * 0.2)::BIGINT FROM orders"),
    "shuffle_split": (lambda s, d: S.shuffle_split(orders(s, d), "o_orderkey", 2, 0.1).agg(*[F.sum(F.col(f"test_{k}").cast("long")).alias(f"n{k}") for k in range(2)]), "SELECT round(count(*) * 0.1)::BIGINT AS n0, round(count(*) * 0.1)::BIGINT AS n1 FROM orders"),
    "dummy_classifier": (lambda s, d: (x := data(s, d)).select(S.dummy_classifier(x, "c", "most_frequent").alias("p")).distinct(), f"WITH {DATA} SELECT c AS p FROM t GROUP BY c ORDER BY count(*) DESC, c LIMIT 1"),
    "dummy_regressor": (lambda s, d: rounded((x := data(s, d)).select(S.dummy_regressor(x, "y", "quantile", 0.9).alias("p")).distinct()), f"WITH {DATA} SELECT round(quantile_cont(y, 0.9), 6) AS p FROM t"),
    "partial_dependence": (dependence, f"""WITH {DATA}, g AS (SELECT count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb, avg(a) AS ma, avg(y) AS my FROM t), w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa FROM g)
SELECT v.value, round(my + wa * (v.value - ma), 4) AS mean_prediction FROM w, (VALUES (0.0::DOUBLE), (2.5), (5.0)) v(value)"""),
    "tuned_threshold": (lambda s, d: s.createDataFrame([(S.tuned_threshold(_t(s, d, "lineitem").select((F.col("l_quantity") > 31).cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p")), "y", "p", lambda tp, fp, fn, tn: (tp + tn) / (tp + fp + fn + tn)),)], "threshold double"), "WITH t AS (SELECT l_quantity > 31 AS y, l_quantity / 50 AS p FROM lineitem) SELECT k::DOUBLE / 20 AS threshold FROM t, range(21) r(k) GROUP BY k ORDER BY count(*) FILTER (y = (p >= k::DOUBLE / 20)) DESC, k LIMIT 1"),
    "platt_calibration": (lambda s, d: rounded((x := data(s, d)).withColumn("p", S.platt(x, "s", "a")).select("a", "p").distinct(), 4), f"""WITH RECURSIVE {DATA}, c AS (SELECT a, CASE WHEN s = 1 THEN (q + 1) / (q + 2) ELSE 1 / (r + 2) END AS y, count(*) AS n FROM t, (SELECT sum(s) AS q, sum(1 - s) AS r FROM t) GROUP BY 1, 2),
r AS (SELECT 0 AS it, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT it + 1, w - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
FROM (SELECT it, w, b, sum(n * (p - y) * a) AS g0, sum(n * (p - y)) AS g1, sum(n * p * (1 - p) * a * a) AS h00, sum(n * p * (1 - p) * a) AS h01, sum(n * p * (1 - p)) AS h11 FROM (SELECT *, 1 / (1 + exp(-(w * a + b))) AS p FROM r, c WHERE it < 30) GROUP BY it, w, b))
SELECT DISTINCT round(a, 4) AS a, round(1 / (1 + exp(-(w * a + r.b))), 4) AS p FROM t, r WHERE it = 30"""),
}
