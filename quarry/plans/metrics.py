"""Queries of the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stats import rounded
from quarry.operators import metrics as M


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reg(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5 + 1).alias("p"))


def clf(spark, d):
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(q < 15, "A").when(q < 40, "N").otherwise("R").alias("p"), F.col("l_linestatus").alias("s"))


def prob(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_quantity") / 51).alias("p"))


REG = "t AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 + 1 AS p FROM lineitem)"
CLF = "t AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 40 THEN 'N' ELSE 'R' END AS p, l_linestatus AS s FROM lineitem)"
CELLS = CLF + """, labels AS (SELECT y AS l FROM t UNION SELECT p FROM t),
c AS (SELECT a.l AS y_true, b.l AS y_pred, (SELECT count(*) FROM t WHERE y = a.l AND p = b.l) AS n FROM labels a, labels b),
k AS (SELECT l AS label, (SELECT sum(n) FROM c WHERE y_true = l)::BIGINT AS support, (SELECT sum(n) FROM c WHERE y_true = l AND y_pred = l)::BIGINT AS tp, (SELECT sum(n) FROM c WHERE y_pred = l AND y_true <> l)::BIGINT AS fp, (SELECT count(*) FROM t) AS total FROM labels),
m AS (SELECT label, support, tp, fp, support - tp AS fn, total - support - fp AS tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + support - tp, 0), 0) AS f1, coalesce(tp / nullif(tp + fp + support - tp, 0), 0) AS jaccard FROM k)"""
PROB = "t AS (SELECT (l_linestatus = 'O')::INT AS y, l_quantity / 51 AS p FROM lineitem)"
CURVE = PROB + """, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY p),
w AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS P_, sum(neg) OVER () AS N_ FROM g)"""
AGREE = CLF + """, c AS (SELECT y AS a, s AS b, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), a AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), b AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1),
z AS (SELECT (SELECT sum(n) FROM c) AS N_, (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(na * (na - 1) / 2) FROM a) AS sa, (SELECT sum(nb * (nb - 1) / 2) FROM b) AS sb,
  (SELECT sum(n / q * ln(n * q / (na * nb))) FROM c JOIN a USING (a) JOIN b USING (b), (SELECT sum(n) AS q FROM c)) AS mi, (SELECT -sum(na / q * ln(na / q)) FROM a, (SELECT sum(n) AS q FROM c)) AS ha, (SELECT -sum(nb / q * ln(nb / q)) FROM b, (SELECT sum(n) AS q FROM c)) AS hb)"""

QUERIES = {
    "regression_report": (lambda s, d: rounded(M.regression_report(reg(s, d), "y", "p", 0.3)), f"""
WITH {REG}, q AS (SELECT avg(y) AS m, quantile_cont(y, 0.5) AS q5, quantile_cont(y, 0.3) AS q3 FROM t),
e AS (SELECT y, p, y - p AS r, m, q5, q3, abs(y - p) AS a, CASE WHEN y >= p THEN 0.3 * (y - p) ELSE 0.7 * (p - y) END AS pin, CASE WHEN y >= q3 THEN 0.3 * (y - q3) ELSE 0.7 * (q3 - y) END AS pin0,
  2 * (y ** 0.5 / -0.25 + y * p ** -0.5 / 0.5 + p ** 0.5 / 0.5) AS tw, 2 * (y ** 0.5 / -0.25 + y * m ** -0.5 / 0.5 + m ** 0.5 / 0.5) AS tw0 FROM t, q)
SELECT round(avg(a), 6) AS mean_absolute_error, round(avg(r * r), 6) AS mean_squared_error, round(sqrt(avg(r * r)), 6) AS root_mean_squared_error, round(quantile_cont(a, 0.5), 6) AS median_absolute_error, round(max(a), 6) AS max_error,
  round(100 * avg(abs(r / y)), 6) AS mean_absolute_percentage_error, round(avg((ln(1 + y) - ln(1 + p)) ** 2), 6) AS mean_squared_log_error, round(sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2)), 6) AS root_mean_squared_log_error, round(avg(pin), 6) AS mean_pinball_loss,
  round(avg(2 * (y * ln(y / p) + p - y)), 6) AS mean_poisson_deviance, round(avg(2 * (ln(p / y) + y / p - 1)), 6) AS mean_gamma_deviance, round(avg(tw), 6) AS mean_tweedie_deviance,
  round(1 - avg(r * r) / var_pop(y), 6) AS r2_score, round(1 - var_pop(r) / var_pop(y), 6) AS explained_variance_score, round(1 - avg(a) / avg(abs(y - q5)), 6) AS d2_absolute_error_score, round(1 - avg(pin) / avg(pin0), 6) AS d2_pinball_score, round(1 - avg(tw) / avg(tw0), 6) AS d2_tweedie_score FROM e"""),
    "confusion_matrix": (lambda s, d: M.confusion(clf(s, d), "y", "p"), f"WITH {CELLS} SELECT * FROM c"),
    "multilabel_confusion_matrix": (lambda s, d: M.multilabel_confusion(clf(s, d), "y", "p"), f"WITH {CELLS} SELECT label, tn, fp, fn, tp FROM m"),
    "precision_recall_f1_per_class": (lambda s, d: rounded(M.per_class(clf(s, d), "y", "p")), f"WITH {CELLS} SELECT label, support, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(jaccard, 6) AS jaccard FROM m"),
    "averaged_scores": (lambda s, d: rounded(M.averaged(clf(s, d), "y", "p", 2.0)), f"""WITH {CELLS}, x AS (SELECT 'macro' AS average, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(jaccard) AS jaccard FROM m
UNION ALL SELECT 'micro', sum(tp) / sum(tp + fp), sum(tp) / sum(tp + fn), 2 * sum(tp) / sum(2 * tp + fp + fn), sum(tp) / sum(tp + fp + fn) FROM m
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(jaccard * support) / sum(support) FROM m)
SELECT average, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(jaccard, 6) AS jaccard, round(5 * precision * recall / (4 * precision + recall), 6) AS fbeta FROM x"""),
    "classification_report": (lambda s, d: rounded(M.classification_report(clf(s, d), "y", "p")), f"""WITH {CELLS}, z AS (SELECT sum(support)::DOUBLE AS n, sum(tp)::DOUBLE AS hit, sum((tp + fp)::DOUBLE * support) AS x, sum((tp + fp)::DOUBLE ** 2) AS pp, sum(support::DOUBLE ** 2) AS tt, avg(recall) FILTER (support > 0) AS b, (count(*) FILTER (support > 0))::DOUBLE AS k FROM m)
SELECT round(hit / n, 6) AS accuracy_score, round(1 - hit / n, 6) AS zero_one_loss, round(1 - hit / n, 6) AS hamming_loss, (n - hit)::BIGINT AS errors, round(b, 6) AS balanced_accuracy_score, round((b - 1 / k) / (1 - 1 / k), 6) AS balanced_accuracy_adjusted,
 round((hit * n - x) / sqrt((n * n - pp) * (n * n - tt)), 6) AS matthews_corrcoef, round((hit / n - x / n / n) / (1 - x / n / n), 6) AS cohen_kappa_score FROM z"""),
    "roc_curve": (lambda s, d: rounded(M.roc_curve(prob(s, d), "y", "p")), f"WITH {CURVE} SELECT round(p, 6) AS threshold, round(cn / N_, 6) AS fpr, round(cp / P_, 6) AS tpr, round(1 - cp / P_, 6) AS fnr FROM w UNION ALL SELECT NULL, 0.0, 0.0, 1.0"),
    "precision_recall_curve": (lambda s, d: rounded(M.precision_recall_curve(prob(s, d), "y", "p")), f"WITH {CURVE} SELECT round(p, 6) AS threshold, round(cp / (cp + cn), 6) AS precision, round(cp / P_, 6) AS recall FROM w UNION ALL SELECT NULL, 1.0, 0.0"),
    "roc_auc_average_precision": (lambda s, d: rounded(M.binary_scores(prob(s, d), "y", "p")), f"WITH {CURVE} SELECT round(sum(neg * (cp - pos / 2)) / (max(P_) * max(N_)), 6) AS roc_auc_score, round(sum(pos / P_ * cp / (cp + cn)), 6) AS average_precision_score FROM w"),
    "auc_trapezoid": (lambda s, d: rounded(M.auc(M.roc_curve(prob(s, d), "y", "p"), "fpr", "tpr", "fpr")), f"WITH {CURVE} SELECT round(sum(neg * (cp - pos / 2)) / (max(P_) * max(N_)), 6) AS auc FROM w"),
    "probability_scores": (lambda s, d: rounded(M.probability_scores(prob(s, d), "y", "p")), f"""WITH {PROB}, b AS (SELECT avg(y) AS s FROM t), x AS (SELECT -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS l, avg((y - p) ** 2) AS b, avg(greatest(0, 1 - (2 * y - 1) * (2 * p - 1))) AS h, -avg(y * ln(s) + (1 - y) * ln(1 - s)) AS l0, avg((y - s) ** 2) AS b0 FROM t, b)
SELECT round(l, 6) AS log_loss, round(b, 6) AS brier_score_loss, round(h, 6) AS hinge_loss, round(1 - b / b0, 6) AS d2_brier_score, round(1 - l / l0, 6) AS d2_log_loss_score FROM x"""),
    "calibration_curve": (lambda s, d: rounded(M.calibration_curve(prob(s, d), "y", "p")), f"WITH {PROB} SELECT least(floor(p * 5), 4)::INT AS bin, count(*) AS n, round(avg(y), 6) AS prob_true, round(avg(p), 6) AS prob_pred FROM t GROUP BY 1"),
    "top_k_accuracy": (lambda s, d: rounded(M.top_k_accuracy(_t(s, d, "lineitem").select((F.col("l_linenumber") % 3).alias("y"), F.col("l_quantity").alias("a"), (F.col("l_tax") * 400).alias("b"), (F.col("l_discount") * 300).alias("c")), "y", ["a", "b", "c"], 2)), """
WITH t AS (SELECT l_linenumber % 3 AS y, l_quantity AS a, l_tax * 400 AS b, l_discount * 300 AS c FROM lineitem), o AS (SELECT *, CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS own FROM t)
SELECT round(avg(((a > own)::INT + (b > own OR b = own AND 1 < y)::INT + (c > own)::INT + (a = own AND 0 < y)::INT < 2)::INT), 6) AS top_k_accuracy_score FROM o"""),
    "dcg_ndcg": (lambda s, d: rounded(M.dcg(_t(s, d, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("double").alias("rel"), F.col("o_totalprice").alias("score")), "o_custkey", "rel", "score", "o_orderkey", 5)), """
WITH t AS (SELECT o_custkey, substr(o_orderpriority, 1, 1)::DOUBLE AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1)::DOUBLE DESC, o_orderkey) AS i FROM orders),
g AS (SELECT o_custkey, sum(CASE WHEN r <= 5 THEN rel / log2(r + 1) ELSE 0 END) AS a, sum(CASE WHEN i <= 5 THEN rel / log2(i + 1) ELSE 0 END) AS b FROM t GROUP BY 1)
SELECT o_custkey, round(a, 6) AS dcg_score, round(CASE WHEN b = 0 THEN 0 ELSE a / b END, 6) AS ndcg_score FROM g"""),
    "label_ranking": (lambda s, d: rounded(M.label_ranking(_t(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("t0"), (F.col("l_linestatus") == "O").cast("int").alias("t1"), F.col("l_quantity").alias("s0"), (F.col("l_discount") * 500).alias("s1")), ["t0", "t1"], ["s0", "s1"])), """
WITH t AS (SELECT (l_returnflag = 'R')::INT AS t0, (l_linestatus = 'O')::INT AS t1, l_quantity AS s0, l_discount * 500 AS s1 FROM lineitem)
SELECT round(avg(CASE WHEN t0 + t1 = 0 THEN 0 WHEN t0 + t1 = 2 THEN 2 WHEN t0 = 1 THEN 1 + (s1 >= s0)::INT ELSE 1 + (s0 >= s1)::INT END), 6) AS coverage_error,
 round(avg(CASE WHEN t0 + t1 <> 1 THEN 1 WHEN t0 = 1 THEN 1 / (1 + (s1 >= s0)::INT) ELSE 1 / (1 + (s0 >= s1)::INT) END), 6) AS label_ranking_average_precision_score,
 round(avg(CASE WHEN t0 + t1 <> 1 THEN NULL WHEN t0 = 1 THEN (s0 <= s1)::INT ELSE (s1 <= s0)::INT END), 6) AS label_ranking_loss FROM t"""),
    "contingency_matrix": (lambda s, d: M.contingency(clf(s, d), "y", "s"), f"WITH {CLF} SELECT y AS a, s AS b, count(*) AS n FROM t GROUP BY 1, 2"),
    "pair_confusion_matrix": (lambda s, d: M.pair_confusion(clf(s, d), "y", "s"), f"WITH {AGREE} SELECT (N_ * N_ - 2 * (sa + sb - s) - N_)::BIGINT AS c00, (2 * (sb - s))::BIGINT AS c01, (2 * (sa - s))::BIGINT AS c10, (2 * s)::BIGINT AS c11 FROM z"),
    "cluster_agreement": (lambda s, d: rounded(M.cluster_agreement(clf(s, d), "y", "s")), f"""WITH {AGREE}, f AS (SELECT *, N_ * (N_ - 1) / 2 AS q, mi / ha AS h, mi / hb AS k FROM z)
SELECT round((q + 2 * s - sa - sb) / q, 6) AS rand_score, round((s - sa * sb / q) / ((sa + sb) / 2 - sa * sb / q), 6) AS adjusted_rand_score, round(mi, 6) AS mutual_info_score, round(mi / sqrt(ha * hb), 6) AS nmi_geometric, round(2 * mi / (ha + hb), 6) AS nmi_arithmetic, round(mi / least(ha, hb), 6) AS nmi_min, round(mi / greatest(ha, hb), 6) AS nmi_max,
 round(h, 6) AS homogeneity_score, round(k, 6) AS completeness_score, round(2 * h * k / (h + k), 6) AS v_measure_score, round(s / sqrt(sa * sb), 6) AS fowlkes_mallows_score FROM f"""),
    "calinski_harabasz": (lambda s, d: rounded(M.calinski_harabasz(_t(s, d, "part").select((F.col("p_size") / 10).alias("a"), (F.col("p_retailprice") / 1000).alias("b"), (F.col("p_size") % 3).alias("l")), ["a", "b"], "l")), """
WITH t AS (SELECT p_size / 10 AS a, p_retailprice / 1000 AS b, p_size % 3 AS l FROM part), g AS (SELECT l, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM t GROUP BY l), m AS (SELECT avg(a) AS A_, avg(b) AS B_, count(*) AS N_ FROM t)
SELECT round((SELECT sum(n * ((ma - A_) ** 2 + (mb - B_) ** 2)) FROM g, m) / 2 / ((SELECT sum((a - ma) ** 2 + (b - mb) ** 2) FROM t JOIN g USING (l)) / ((SELECT N_ FROM m) - 3)), 6) AS calinski_harabasz_score"""),
    "davies_bouldin": (lambda s, d: rounded(M.davies_bouldin(_t(s, d, "part").select((F.col("p_size") / 10).alias("a"), (F.col("p_retailprice") / 1000).alias("b"), F.floor(F.col("p_size") / 18).alias("l")), ["a", "b"], "l")), """
WITH t AS (SELECT p_size / 10 AS a, p_retailprice / 1000 AS b, floor(p_size / 18)::INT AS l FROM part), g AS (SELECT l, avg(a) AS ma, avg(b) AS mb FROM t GROUP BY l),
s AS (SELECT l, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2)) AS s, any_value(ma) AS ma, any_value(mb) AS mb FROM t JOIN g USING (l) GROUP BY l), r AS (SELECT x.l, max((x.s + y.s) / sqrt((x.ma - y.ma) ** 2 + (x.mb - y.mb) ** 2)) AS r FROM s x JOIN s y ON x.l <> y.l GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin_score FROM r"""),
    "silhouette_samples": (lambda s, d: rounded(M.silhouette(_t(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("a"), (F.col("s_nationkey") % 3 - 1).alias("l")), ["a"], "l", "s_suppkey")), """
WITH t AS (SELECT s_suppkey, s_acctbal / 1000 AS a, s_nationkey % 3 - 1 AS l FROM supplier), p AS (SELECT x.s_suppkey, x.l, y.l AS l2, avg(abs(x.a - y.a)) AS d FROM t x JOIN t y ON x.s_suppkey <> y.s_suppkey WHERE x.l <> -1 AND y.l <> -1 GROUP BY ALL),
q AS (SELECT s_suppkey, coalesce(max(CASE WHEN l = l2 THEN d END), 0) AS a, min(CASE WHEN l <> l2 THEN d END) AS b FROM p GROUP BY 1)
SELECT s_suppkey, round(coalesce((q.b - q.a) / greatest(q.a, q.b), 0), 6) AS silhouette FROM t LEFT JOIN q USING (s_suppkey)"""),
}
