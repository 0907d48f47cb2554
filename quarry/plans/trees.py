"""Queries of trees, forests and boosting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import trees as T
from quarry.plans.linear import DATA, XS
from quarry.plans.linear import data as rows
from quarry.plans.metrics import _t


def data(s, d):
    return rows(s, d).withColumn("id", F.xxhash64("a", "b", "y", "f"))


def classes(fit):
    return lambda s, d: (x := data(s, d)).withColumn("p", fit(x).predict()).groupBy("c", "p").agg(F.count("*").alias("n"))


def error(fit):
    return lambda s, d: rounded((x := data(s, d)).withColumn("p", fit(x).predict()).agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("mse")), 3)


STUMP = f"""WITH {DATA}, h AS (SELECT a, sum(y) AS sy, count(*) AS n FROM t GROUP BY a), w AS (SELECT a, lead(a) OVER (ORDER BY a) AS a2, sum(sy) OVER (ORDER BY a) AS ls, sum(n) OVER (ORDER BY a) AS ln_, sum(sy) OVER () AS s, sum(n) OVER () AS n FROM h),
b AS (SELECT (a + a2) / 2 AS cut, ls / ln_ AS lv, (s - ls) / (n - ln_) AS rv FROM w WHERE a2 IS NOT NULL ORDER BY ls * ls / ln_ + (s - ls) ** 2 / (n - ln_) DESC, a LIMIT 1)
SELECT round(avg((y - CASE WHEN a > cut THEN rv ELSE lv END) ** 2), 3) AS mse FROM t, b"""

def grown(name: str, cells: str, sums: list[str], depth: int, n: str = "n", columns: tuple[str, ...] = ("a", "b")) -> str:
    """CTEs that grow a tree on ``cells`` (values of the features, weight ``n`` and sums of the targets); the CTE ``name`` has the cells with the leaf values {name}_0, {name}_1 ...
    The gain is the fall of the sum of squares, which for sums of class indicators is that of the Gini impurity."""
    every, out = [n, *sums], [f"{name}_c0 AS (SELECT *, 1 AS node FROM {cells})"]
    running = ", ".join(f"sum({s}) OVER (PARTITION BY node, f ORDER BY v) AS l_{s}, sum({s}) OVER (PARTITION BY node, f) AS t_{s}" for s in every)
    square = lambda part: "(" + " + ".join(f"({part.format(s=s)}) ** 2" for s in sums) + ")"
    gain = f"{square('l_{s}')} / l_{n} + {square('t_{s} - l_{s}')} / (t_{n} - l_{n}) - {square('t_{s}')} / t_{n}"
    for d in range(depth):
        hist = " UNION ALL ".join(f"SELECT node, {i} AS f, {c} AS v, {', '.join(f'sum({s})::DOUBLE AS {s}' for s in every)} FROM {name}_c{d} GROUP BY node, {c}" for i, c in enumerate(columns))
        right = " ".join(f"WHEN {i} THEN c.{c} > z.v" for i, c in enumerate(columns))
        out.append(f"{name}_h{d} AS (SELECT *, {running}, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nxt FROM ({hist}))")
        out.append(f"{name}_b{d} AS (SELECT node, f, v FROM (SELECT node, f, v, {gain} AS gain FROM {name}_h{d} WHERE nxt IS NOT NULL) WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, v) = 1)")
        out.append(f"{name}_c{d + 1} AS (SELECT c.* REPLACE (2 * c.node + coalesce(CASE z.f {right} END, false)::INT AS node) FROM {name}_c{d} c LEFT JOIN {name}_b{d} z ON z.node = c.node)")
    values = ", ".join(f"sum({s}) OVER (PARTITION BY node) / sum({n}) OVER (PARTITION BY node) AS {name}_{k}" for k, s in enumerate(sums))
    out.append(f"{name} AS (SELECT * EXCLUDE (node), {values} FROM {name}_c{depth})")
    return ",\n".join(out)


NUMBERS = f"WITH {DATA}, k AS (SELECT a, b, count(*) AS n, sum(y) AS s0, sum(y * y) AS q FROM t GROUP BY a, b)"
LABELS = f"WITH {DATA}, k AS (SELECT a, b, c, count(*) AS n, count(*) FILTER (c = 'A') AS s0, count(*) FILTER (c = 'N') AS s1, count(*) FILTER (c = 'R') AS s2 FROM t GROUP BY a, b, c)"
FLAGS = f"WITH {DATA}, k AS (SELECT a, b, count(*) AS n, sum(s) AS s0 FROM t GROUP BY a, b)"
MSE = "SELECT round(sum(q - 2 * {p} * s0 + {p} * {p} * n) / sum(n), 3) AS mse FROM {of}"
TOP = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN '{3}' WHEN {1} >= {2} THEN '{4}' ELSE '{5}' END AS p, sum(n)::BIGINT AS n"
COUNTS = "SELECT c, " + TOP + " FROM {of} GROUP BY 1, 2"


def last(prefix: str, of: str) -> str:
    """Counts by class of the highest leaf value, of equals the last class."""
    return COUNTS.format(f"{prefix}_2", f"{prefix}_1", f"{prefix}_0", "R", "N", "A", of=of)


def boosted(start: str, cells: str, rounds: int, rate: float, depth: int, p: str, newton: bool = False) -> str:
    """CTEs of boosting one score, which starts at ``start``; ``p`` is the mean of the target by the score {f}. The CTE f{rounds} has the cells with the score f."""
    out = [f"f0 AS (SELECT k.*, {start} AS f FROM {cells} k)"]
    for r in range(rounds):
        m = p.format(f="f")
        out.append(f"g{r} AS (SELECT *, s0 - n * {m} AS r, {f'n * {m} * (1 - {m})' if newton else 'n'} AS h FROM f{r})")
        out.append(grown(f"w{r}", f"g{r}", ["r"], depth, "h"))
        out.append(f"f{r + 1} AS (SELECT * EXCLUDE (r, h, w{r}_0, f), f + {rate} * w{r}_0 AS f FROM w{r})")
    return ",\n".join(out)


def softmax(rounds: int, rate: float, depth: int) -> str:
    """CTEs of boosting a score for each of three classes, z0 to z2."""
    out = ["f0 AS (SELECT k.*, " + ", ".join(f"ln((SELECT sum(s{j}) / sum(n) FROM k)) AS z{j}" for j in range(3)) + " FROM k)"]
    for r in range(rounds):
        out.append(f"g{r} AS (SELECT *, " + ", ".join(f"s{j} - n * exp(z{j}) / (exp(z0) + exp(z1) + exp(z2)) AS r{j}" for j in range(3)) + f" FROM f{r})")
        at = f"g{r}"
        for j in range(3):
            out.append(grown(f"w{r}{j}", at, [f"r{j}"], depth))
            at = f"w{r}{j}"
        out.append(f"f{r + 1} AS (SELECT * EXCLUDE (r0, r1, r2) REPLACE (" + ", ".join(f"z{j} + {rate} * w{r}{j}_0 AS z{j}" for j in range(3)) + f") FROM {at})")
    return ",\n".join(out)


def reweighed(rounds: int) -> str:
    """CTEs of stumps on weights that grow where they err; the CTE f{rounds} has the votes v_0 to v_2."""
    one = lambda p: " + ".join(f"CASE WHEN {p} = {j} THEN s{j} ELSE 0 END" for j in range(3))
    out = ["f0 AS (SELECT k.*, n::DOUBLE AS w, 0.0::DOUBLE AS v_0, 0.0::DOUBLE AS v_1, 0.0::DOUBLE AS v_2 FROM k)"]
    for r in range(rounds):
        out.append(f"g{r} AS (SELECT *, " + ", ".join(f"w * (s{j} > 0)::INT AS r{j}" for j in range(3)) + f" FROM f{r})")
        out.append(grown(f"w{r}", f"g{r}", ["r0", "r1", "r2"], 1, "w"))
        out.append(f"p{r} AS (SELECT *, CASE WHEN w{r}_2 >= w{r}_1 AND w{r}_2 >= w{r}_0 THEN 2 WHEN w{r}_1 >= w{r}_0 THEN 1 ELSE 0 END AS p FROM w{r})")
        out.append(f"e{r} AS (SELECT ln((1 - e) / e) + ln(2) AS alpha FROM (SELECT 1 - sum(CASE WHEN {one('p')} > 0 THEN w ELSE 0 END) / sum(w) AS e FROM p{r}))")
        votes = ", ".join(f"v_{j} + CASE WHEN p = {j} THEN alpha ELSE 0 END AS v_{j}" for j in range(3))
        out.append(f"f{r + 1} AS (SELECT a, b, c, n, s0, s1, s2, w * CASE WHEN {one('p')} > 0 THEN 1 ELSE exp(alpha) END AS w, {votes} FROM p{r}, e{r})")
    return ",\n".join(out)


def chances(newton):
    return lambda s, d: rounded((x := data(s, d)).withColumn("p", T.gradient_boosting_classifier(x, XS, "s", 2, 0.5, 2, newton=newton)[1]).select("a", "b", "p").distinct(), 5)


SIGMOID = "(1 / (1 + exp(-{f})))"
CHANCES = FLAGS + ", " + "{}" + " SELECT round(a, 5) AS a, round(b, 5) AS b, round(1 / (1 + exp(-f)), 5) AS p FROM f2"
ODDS = "(SELECT ln(sum(s0) / (sum(n) - sum(s0))) FROM k)"

QUERIES = {
    "decision_tree_stump": (error(lambda x: T.decision_tree_regressor(x, ["a"], "y", max_depth=1)), STUMP),
    "decision_tree_regressor": (error(lambda x: T.decision_tree_regressor(x, XS, "y", max_depth=3)), f"{NUMBERS}, {grown('w', 'k', ['s0'], 3)} {MSE.format(p='w_0', of='w')}"),
    "decision_tree_classifier": (classes(lambda x: T.decision_tree_classifier(x, XS, "c", max_depth=3)), f"{LABELS}, {grown('w', 'k', ['s0', 's1', 's2'], 3)} {last('w', 'w')}"),
    "voting_regressor": (error(lambda x: T.voting_regressor(x, XS, "y", (1, 3))), f"{NUMBERS}, {grown('u', 'k', ['s0'], 1)}, {grown('w', 'u', ['s0'], 3)} {MSE.format(p='((u_0 + w_0) / 2)', of='w')}"),
    "voting_classifier": (classes(lambda x: T.voting_classifier(x, XS, "c", (1, 2, 3))), f"{LABELS}, {grown('u', 'k', ['s0', 's1', 's2'], 1)}, {grown('v', 'u', ['s0', 's1', 's2'], 2)}, {grown('w', 'v', ['s0', 's1', 's2'], 3)}, "
        + "x AS (SELECT *, " + ", ".join(f"({' + '.join(f'(p_{m} = {j})::INT' for m in 'uvw')}) AS n_{j}" for j in range(3)) + " FROM (SELECT *, " + ", ".join(f"CASE WHEN {m}_2 >= {m}_1 AND {m}_2 >= {m}_0 THEN 2 WHEN {m}_1 >= {m}_0 THEN 1 ELSE 0 END AS p_{m}" for m in "uvw") + " FROM w)) " + last("n", "x")),
    "random_forest_regressor": (error(lambda x: T.random_forest_regressor(x, XS, "y", "id", 5, max_depth=3)), None),
    "random_forest_classifier": (classes(lambda x: T.random_forest_classifier(x, XS, "c", "id", 5, max_depth=3)), None),
    "extra_trees_regressor": (error(lambda x: T.extra_trees_regressor(x, XS, "y", 5, max_depth=3)), None),
    "gradient_boosting_regressor": (error(lambda x: T.gradient_boosting_regressor(x, XS, "y", 3, 0.5, 2)), f"{NUMBERS}, {boosted('(SELECT sum(s0) / sum(n) FROM k)', 'k', 3, 0.5, 2, '{f}')} {MSE.format(p='f', of='f3')}"),
    "gradient_boosting_classifier": (chances(False), CHANCES.format(boosted(ODDS, "k", 2, 0.5, 2, SIGMOID))),
    "hist_gradient_boosting_classifier": (chances(True), CHANCES.format(boosted(ODDS, "k", 2, 0.5, 2, SIGMOID, True))),
    "gradient_boosting_multiclass": (classes(lambda x: T.gradient_boosting_multiclass(x, XS, "c", 2, 0.5, 2)), f"{LABELS}, {softmax(2, 0.5, 2)} {COUNTS.format('z0', 'z1', 'z2', 'A', 'N', 'R', of='f2')}"),
    "adaboost_classifier": (classes(lambda x: T.adaboost_classifier(x, XS, "c", 3)), f"{LABELS}, {reweighed(3)} {last('v', 'f3')}"),
    "isolation_forest": (lambda s, d: rounded((x := _t(s, d, "part").select((F.col("p_size") / 10).alias("a"), (F.col("p_retailprice") / 1000).alias("b"))).withColumn("score", T.isolation_forest(x, ["a", "b"], 5, 32)).agg(F.count("*").alias("n"), F.max("score").alias("top")), 3), None),
}
