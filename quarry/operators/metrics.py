"""Evaluation metrics as aggregates: each takes a DataFrame with target and prediction columns and returns a small DataFrame.

All metrics of a family come from one pass over the data (partial sums, then a final sum). Rows with a null or NaN in a column
used are an error in the data and should be dropped before; a metric that is not defined gives null.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import running, safe_div
from quarry.functions.tables import cut
from quarry.operators.neighbors import in_blocks

# --- regression ---------------------------------------------------------------


def poisson_deviance(y: Column, p: Column) -> Column:
    return 2 * F.when(y > 0, y * F.log(y / p) + p - y).otherwise(p)


def gamma_deviance(y: Column, p: Column) -> Column:
    return 2 * (F.log(p / y) + y / p - 1)


def tweedie_deviance(y: Column, p: Column, power: float) -> Column:
    if power == 0:
        return (y - p) * (y - p)
    if power == 1:
        return poisson_deviance(y, p)
    if power == 2:
        return gamma_deviance(y, p)
    if 0 < power < 1:
        raise ValueError("no distribution has a power between 0 and 1")
    a, b = 1 - power, 2 - power
    first = F.when(y > 0, F.pow(y, F.lit(b))).otherwise(0.0) if power < 2 else F.pow(y, F.lit(b))
    return 2 * (first / (a * b) - y * F.pow(p, F.lit(a)) / a + F.pow(p, F.lit(b)) / b)


def pinball(y: Column, p: Column, alpha: float) -> Column:
    return F.when(y >= p, alpha * (y - p)).otherwise((1 - alpha) * (p - y))


def regression_report(df: DataFrame, y: str, p: str, alpha: float = 0.5, power: float = 1.5) -> DataFrame:
    """One row with all regression metrics. Percentages are times 100 and skip targets of 0; a constant target has null scores."""
    t, q = F.col(y), F.col(p)
    r = t - q
    sums = df.agg(
        F.count("*").alias("n"), F.avg(F.abs(r)).alias("mean_absolute_error"), F.avg(r * r).alias("mean_squared_error"), F.max(F.abs(r)).alias("max_error"),
        F.percentile(F.abs(r), F.lit(0.5)).alias("median_absolute_error"), (100 * F.avg(F.when(t != 0, F.abs(r / t)))).alias("mean_absolute_percentage_error"),
        F.avg(F.pow(F.log1p(t) - F.log1p(q), 2)).alias("mean_squared_log_error"), F.avg(pinball(t, q, alpha)).alias("mean_pinball_loss"),
        F.avg(poisson_deviance(t, q)).alias("mean_poisson_deviance"), F.avg(gamma_deviance(t, q)).alias("mean_gamma_deviance"), F.avg(tweedie_deviance(t, q, power)).alias("mean_tweedie_deviance"),
        F.var_pop(t).alias("_vt"), F.var_pop(r).alias("_vr"), F.avg(t).alias("_mean"), F.percentile(t, F.array(F.lit(0.5), F.lit(alpha))).alias("_q"),
    )
    m = F.broadcast(sums.select("_mean", "_q"))  # one row
    base = df.crossJoin(m).agg(F.avg(F.abs(t - F.col("_q")[0])).alias("_b_abs"), F.avg(pinball(t, F.col("_q")[1], alpha)).alias("_b_pin"), F.avg(tweedie_deviance(t, F.col("_mean"), power)).alias("_b_tw"))
    c = F.col
    return sums.crossJoin(F.broadcast(base)).select(
        "mean_absolute_error", "mean_squared_error", F.sqrt("mean_squared_error").alias("root_mean_squared_error"), "median_absolute_error", "max_error", "mean_absolute_percentage_error",
        "mean_squared_log_error", F.sqrt("mean_squared_log_error").alias("root_mean_squared_log_error"), "mean_pinball_loss", "mean_poisson_deviance", "mean_gamma_deviance", "mean_tweedie_deviance",
        (1 - safe_div(c("mean_squared_error"), c("_vt"), None)).alias("r2_score"), (1 - safe_div(c("_vr"), c("_vt"), None)).alias("explained_variance_score"),
        (1 - safe_div(c("mean_absolute_error"), c("_b_abs"), None)).alias("d2_absolute_error_score"), (1 - safe_div(c("mean_pinball_loss"), c("_b_pin"), None)).alias("d2_pinball_score"), (1 - safe_div(c("mean_tweedie_deviance"), c("_b_tw"), None)).alias("d2_tweedie_score"),
    )


# --- classification -----------------------------------------------------------


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y_true, y_pred, n) over the sorted union of labels, zeros included; its size is that of the labels squared."""
    counts = df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count("*").alias("n"))
    labels = counts.select(F.col("y_true").alias("l")).union(counts.select("y_pred")).distinct()
    grid = labels.select(F.col("l").alias("y_true")).crossJoin(labels.select(F.col("l").alias("y_pred")))
    return grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, fp, fn, tn, support, precision, recall, f1, jaccard) of each label; a ratio of nothing is 0."""
    c = confusion(df, y, p)
    total = c.agg(F.sum("n").alias("total"))
    rows = c.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))).alias("tp"))
    cols = c.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    k = rows.join(cols, "label").crossJoin(total)
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    k = k.select("label", "support", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("total") - F.col("support") - fp).alias("tn"))
    pr, rc = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return k.withColumns({"precision": pr, "recall": rc, "f1": safe_div(2 * pr * rc, pr + rc), "jaccard": safe_div(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))})


def multilabel_confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return per_class(df, y, p).select("label", "tn", "fp", "fn", "tp")


def averaged(df: DataFrame, y: str, p: str, beta: float = 1.0) -> DataFrame:
    """Rows macro, micro and weighted: precision, recall, f1 and jaccard; fbeta is that of the averaged precision and recall."""
    k = per_class(df, y, p)
    names = ("precision", "recall", "f1", "jaccard")
    macro = k.agg(*[F.avg(c).alias(c) for c in names]).withColumn("average", F.lit("macro"))
    weighted = k.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names]).withColumn("average", F.lit("weighted"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    micro = k.agg(safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), safe_div(tp, tp + fp + fn).alias("jaccard")).withColumn("average", F.lit("micro"))
    b, pr, rc = beta * beta, F.col("precision"), F.col("recall")
    return macro.unionByName(micro).unionByName(weighted).withColumn("fbeta", safe_div((1 + b) * pr * rc, b * pr + rc))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: accuracy and the agreement scores that come from the confusion matrix."""
    c = confusion(df, y, p)
    k = per_class(df, y, p)
    n, diag = F.sum("n"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    one = c.agg(n.alias("n"), diag.alias("hit"))
    two = k.agg(F.sum((F.col("tp") + F.col("fp")).cast("double") * F.col("support")).alias("cross"), F.sum(F.pow(F.col("tp") + F.col("fp"), 2)).alias("pp"), F.sum(F.pow("support", 2)).alias("tt"),
                F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced"), F.count(F.when(F.col("support") > 0, 1)).alias("classes"))
    x = one.crossJoin(two)
    n, hit = F.col("n").cast("double"), F.col("hit").cast("double")
    pe = F.col("cross") / (n * n)
    acc = hit / n
    mcc = safe_div(hit * n - F.col("cross"), F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt"))))
    return x.select(acc.alias("accuracy_score"), (1 - acc).alias("zero_one_loss"), (1 - acc).alias("hamming_loss"), (F.col("n") - F.col("hit")).alias("errors"), F.col("balanced").alias("balanced_accuracy_score"),
                    safe_div(F.col("balanced") - 1 / F.col("classes"), 1 - 1 / F.col("classes")).alias("balanced_accuracy_adjusted"), mcc.alias("matthews_corrcoef"), F.when(F.abs(1 - pe) < 1e-15, 1.0).otherwise((acc - pe) / (1 - pe)).alias("cohen_kappa_score"))


# --- scores and probabilities -------------------------------------------------


def thresholds(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, pos, neg, cum_pos, cum_neg) of each distinct score, highest first; ``y`` is 0 or 1."""
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    return running(g, "score", ["pos", "neg"], descending=True)


def _totals(df: DataFrame, y: str) -> DataFrame:
    return F.broadcast(df.agg(F.sum(F.col(y).cast("long")).alias("P"), F.sum(1 - F.col(y).cast("long")).alias("N")))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr, fnr), one row for each distinct score and the start at an infinite threshold, which is null."""
    t = thresholds(df, y, score).crossJoin(_totals(df, y))
    points = t.select(F.col("score").alias("threshold"), safe_div(F.col("cum_neg"), F.col("N")).alias("fpr"), safe_div(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points).withColumn("fnr", 1 - F.col("tpr"))


def precision_recall_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall), and the end (1, 0) with a null threshold."""
    t = thresholds(df, y, score).crossJoin(_totals(df, y))
    points = t.select(F.col("score").alias("threshold"), safe_div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"), safe_div(F.col("cum_pos"), F.col("P")).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def auc(curve: DataFrame, x: str, y: str, order: str, buckets: int = 64) -> DataFrame:
    """Trapezoids below the points in order of ``order`` (numeric): within ranges of it, and between the last point of a range and the first of the next."""
    marks = curve.select(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 10_000).alias("_m"))
    p = curve.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(order).alias("_at")).crossJoin(F.broadcast(marks)).withColumn("_b", F.size(F.filter("_m", lambda v: v < F.col("_at"))))
    area = lambda w: (F.col("_x") - F.lag("_x").over(w)) * (F.col("_y") + F.lag("_y").over(w)) / 2
    # points of one place in the order are taken by x and then y
    place = F.struct("_at", "_x", "_y")
    inside = p.withColumn("_a", area(Window.partitionBy("_b").orderBy("_at", "_x", "_y"))).groupBy("_b").agg(F.sum("_a").alias("_a"), F.min(place).alias("_first"), F.max(place).alias("_last"))
    w = Window.orderBy("_b")  # a row for each range
    between = (F.col("_first._x") - F.lag("_last._x").over(w)) * (F.col("_first._y") + F.lag("_last._y").over(w)) / 2
    return inside.select((F.coalesce("_a", F.lit(0.0)) + F.coalesce(between, F.lit(0.0))).alias("a")).agg(F.sum("a").alias("auc"))


def binary_scores(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: roc_auc_score (ties count half) and average_precision_score, from running counts with no sort of single rows."""
    t = thresholds(df, y, score).crossJoin(_totals(df, y))
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)) / (F.first("P") * F.first("N"))
    step = F.sum(F.col("pos") / F.col("P") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return t.agg(area.alias("roc_auc_score"), step.alias("average_precision_score"))


def probability_scores(df: DataFrame, y: str, prob: str, eps: float = 1e-15) -> DataFrame:
    """One row: log_loss, brier_score_loss, hinge_loss (of 2 p - 1), and their gains over the share of positives."""
    t, p = F.col(y).cast("double"), F.col(prob)
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    base = F.broadcast(df.agg(F.avg(t).alias("_share")))
    s = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("_share")))
    ll = lambda z: -F.avg(t * F.log(z) + (1 - t) * F.log(1 - z))
    x = df.crossJoin(base).agg(ll(q).alias("log_loss"), F.avg((t - p) ** 2).alias("brier_score_loss"), F.avg(F.greatest(F.lit(0.0), 1 - (2 * t - 1) * (2 * p - 1))).alias("hinge_loss"), ll(s).alias("_l0"), F.avg((t - F.col("_share")) ** 2).alias("_b0"))
    return x.select("log_loss", "brier_score_loss", "hinge_loss", (1 - safe_div(F.col("brier_score_loss"), F.col("_b0"), 1.0)).alias("d2_brier_score"), (1 - safe_div(F.col("log_loss"), F.col("_l0"), 1.0)).alias("d2_log_loss_score"))


def multiclass_log_loss(df: DataFrame, y: str, probs: dict, eps: float = 1e-15) -> DataFrame:
    """One row: log_loss of a column of probabilities for each class; each row's are clipped and made to sum to one. A target that is no key counts as probability ``eps``."""
    clip = lambda c: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(c)))
    total = reduce(lambda a, b: a + b, [clip(c) for c in probs.values()])
    own = reduce(lambda a, b: F.coalesce(a, b), [F.when(F.col(y) == k, clip(c) / total) for k, c in probs.items()])
    return df.agg((-F.avg(F.log(F.coalesce(own, F.lit(eps))))).alias("log_loss"))


def multiclass_roc_auc(df: DataFrame, y: str, scores: dict) -> DataFrame:
    """(label, support, roc_auc_score) of each class against all others, from running counts of its column of scores. Macro and weighted means are means of these rows."""
    out = None
    for k, c in scores.items():
        one = df.select((F.col(y) == k).cast("int").alias("_t"), F.col(c).alias("_s"))
        row = binary_scores(one, "_t", "_s").crossJoin(one.agg(F.sum("_t").alias("support"))).select(F.lit(k).alias("label"), "support", "roc_auc_score")
        out = row if out is None else out.unionByName(row)
    return out


def multiclass_roc_auc_pairs(df: DataFrame, y: str, scores: dict) -> DataFrame:
    """(a, b, roc_auc_score) of each pair of classes: the mean of both classes' areas on the rows of the two."""
    out = None
    for a, b in combinations(sorted(scores), 2):
        two = df.where(F.col(y).isin(a, b))
        areas = [binary_scores(two.select((F.col(y) == k).cast("int").alias("_t"), F.col(scores[k]).alias("_s")), "_t", "_s").select(F.col("roc_auc_score").alias(f"_{j}")) for j, k in enumerate((a, b))]
        row = areas[0].crossJoin(areas[1]).select(F.lit(a).alias("a"), F.lit(b).alias("b"), ((F.col("_0") + F.col("_1")) / 2).alias("roc_auc_score"))
        out = row if out is None else out.unionByName(row)
    return out


def calibration_curve(df: DataFrame, y: str, prob: str, n_bins: int = 5) -> DataFrame:
    """(bin, n, prob_true, prob_pred) of the bins that aren't empty; the last one is closed."""
    b = F.least(F.floor(F.col(prob) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("prob_true"), F.avg(prob).alias("prob_pred"))


def top_k_accuracy(df: DataFrame, y: str, scores: list[str], k: int) -> DataFrame:
    """The share of rows whose label ``y`` (a place in ``scores``) has fewer than ``k`` labels ahead; of equal scores, the lower label is ahead."""
    arr = F.array(*scores)
    own = F.element_at(arr, F.col(y).cast("int") + 1)
    ahead = reduce(lambda a, b: a + b, [((F.col(s) > own) | ((F.col(s) == own) & (F.lit(i) < F.col(y)))).cast("int") for i, s in enumerate(scores)])
    return df.agg(F.avg((ahead < k).cast("double")).alias("top_k_accuracy_score"))


# --- ranking ------------------------------------------------------------------


def dcg(df: DataFrame, group: str, relevance: str, score: str, tie: str, k: int | None = None) -> DataFrame:
    """(group, dcg_score, ndcg_score): linear gain, ties by ``tie``; an ideal of 0 gives 0. Groups should be of bounded size."""
    w, best = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie)), Window.partitionBy(group).orderBy(F.desc(relevance), F.asc(tie))
    x = df.withColumns({"_r": F.row_number().over(w), "_i": F.row_number().over(best)})
    gain = lambda r: F.sum(F.when(r <= (k or 2**31 - 1), F.col(relevance) / F.log2(r + 1)).otherwise(0.0))
    out = x.groupBy(group).agg(gain(F.col("_r")).alias("dcg_score"), gain(F.col("_i")).alias("_ideal"))
    return out.select(group, "dcg_score", safe_div(F.col("dcg_score"), F.col("_ideal")).alias("ndcg_score"))


def label_ranking(df: DataFrame, truth: list[str], scores: list[str]) -> DataFrame:
    """One row: coverage_error, label_ranking_average_precision_score and label_ranking_loss of 0/1 columns and their scores."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    pairs = list(zip(truth, scores, strict=True))
    npos = add([F.col(t) for t in truth]).cast("double")
    low = reduce(F.least, [F.when(F.col(t) == 1, F.col(s)).otherwise(float("inf")) for t, s in pairs]) if len(pairs) < 2 else F.least(*[F.when(F.col(t) == 1, F.col(s)).otherwise(F.lit(float("inf"))) for t, s in pairs])
    cover = add([F.when(F.col(s) >= low, 1.0).otherwise(0.0) for s in scores])
    prec = add([F.when(F.col(t) == 1, add([F.when(F.col(s2) >= F.col(s), F.col(t2)).otherwise(0) for t2, s2 in pairs]) / add([(F.col(s2) >= F.col(s)).cast("double") for s2 in scores])).otherwise(0.0) for t, s in pairs])
    bad = add([F.when((F.col(t) == 1) & (F.col(t2) == 0) & (F.col(s) <= F.col(s2)), 1.0).otherwise(0.0) for t, s in pairs for t2, s2 in pairs])
    k = float(len(pairs))
    both = (npos > 0) & (npos < k)
    return df.agg(F.avg(cover).alias("coverage_error"), F.avg(F.when(both, prec / npos).otherwise(1.0)).alias("label_ranking_average_precision_score"), F.avg(F.when(both, bad / (npos * (k - npos)))).alias("label_ranking_loss"))


# --- scorers ------------------------------------------------------------------

#: Names of scorers: column of regression_report and whether more is better.
SCORERS = {"r2": ("r2_score", True), "explained_variance": ("explained_variance_score", True), "max_error": ("max_error", False)} | {
    f"neg_{n}": (n, False) for n in ("mean_absolute_error", "mean_squared_error", "root_mean_squared_error", "mean_squared_log_error", "median_absolute_error", "mean_absolute_percentage_error", "mean_poisson_deviance", "mean_gamma_deviance")
} | {"d2_absolute_error_score": ("d2_absolute_error_score", True)}


class Scorer:
    """A metric with a sign, so that more is always better."""

    def __init__(self, name: str, column: str, greater_is_better: bool):
        self.name, self.column, self.greater_is_better = name, column, greater_is_better

    def __call__(self, df: DataFrame, y: str, p: str) -> float:
        v = regression_report(df, y, p).select(self.column).first()[0]
        return v if self.greater_is_better else -v


def get_scorer_names() -> list[str]:
    return sorted(SCORERS)


def get_scorer(name: str) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"no scorer {name!r}; there are {', '.join(get_scorer_names())}")
    return Scorer(name, *SCORERS[name])


def make_scorer(column: str, greater_is_better: bool = True, name: str = "custom") -> Scorer:
    return Scorer(name, column, greater_is_better)


def check_scoring(scoring: str | Scorer) -> Scorer:
    return scoring if isinstance(scoring, Scorer) else get_scorer(scoring)


# --- agreement of clusterings -------------------------------------------------


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pair-counting and entropy scores of two labellings (``a`` the truth), from their contingency table alone."""
    c = contingency(df, a, b)
    ra, rb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    total = c.agg(F.sum("n").cast("double").alias("all_"))
    cells = c.join(ra, "a").join(rb, "b").crossJoin(total)
    n, na, nb, N = (F.col(x).cast("double") for x in ("n", "na", "nb", "all_"))
    two = lambda x: x * (x - 1) / 2
    x = cells.agg(F.sum(two(n)).alias("s"), F.first("all_").alias("all_"), F.sum(n / N * F.log(n * N / (na * nb))).alias("mi"), F.sum(n * n).alias("sq"))
    x = x.crossJoin(ra.crossJoin(total).agg(F.sum(two(na)).alias("sa"), F.sum(-na / N * F.log(na / N)).alias("ha"), F.sum(na * na).alias("qa")))
    x = x.crossJoin(rb.crossJoin(total).agg(F.sum(two(nb)).alias("sb"), F.sum(-nb / N * F.log(nb / N)).alias("hb"), F.sum(nb * nb).alias("qb")))
    s, sa, sb, ha, hb, mi, N = (F.col(v) for v in ("s", "sa", "sb", "ha", "hb", "mi", "all_"))
    pairs = two(N)
    expected = sa * sb / pairs
    h, k = F.when(ha == 0, 1.0).otherwise(mi / ha), F.when(hb == 0, 1.0).otherwise(mi / hb)
    norm = lambda d: F.when(d == 0, 1.0).otherwise(mi / d)
    return x.select(
        ((pairs + 2 * s - sa - sb) / pairs).alias("rand_score"), F.when((sa + sb) / 2 == expected, 1.0).otherwise((s - expected) / ((sa + sb) / 2 - expected)).alias("adjusted_rand_score"),
        mi.alias("mutual_info_score"), norm(F.sqrt(ha * hb)).alias("nmi_geometric"), norm((ha + hb) / 2).alias("nmi_arithmetic"), norm(F.least(ha, hb)).alias("nmi_min"), norm(F.greatest(ha, hb)).alias("nmi_max"),
        h.alias("homogeneity_score"), k.alias("completeness_score"), safe_div(2 * h * k, h + k).alias("v_measure_score"), safe_div(s, F.sqrt(sa * sb)).alias("fowlkes_mallows_score"),
    )


def pair_confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """(c00, c01, c10, c11): ordered pairs that are apart in both, together in one, together in both."""
    c = contingency(df, a, b)
    sq = lambda d, k: d.agg(F.sum(F.col(k).cast("double") * F.col(k)).alias("q_" + k))
    x = c.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("q"), F.sum("n").cast("double").alias("all_"))
    x = x.crossJoin(sq(c.groupBy("a").agg(F.sum("n").alias("na")), "na")).crossJoin(sq(c.groupBy("b").agg(F.sum("n").alias("nb")), "nb"))
    q, qa, qb, N = F.col("q"), F.col("q_na"), F.col("q_nb"), F.col("all_")
    return x.select((N * N - qa - qb + q).cast("long").alias("c00"), (qb - q).cast("long").alias("c01"), (qa - q).cast("long").alias("c10"), (q - N).cast("long").alias("c11"))


def adjusted_mutual_info(df: DataFrame, a: str, b: str) -> float:
    """Mutual information less its exact expectation, over the larger entropy less the same. The table of label counts is all that the driver gets."""
    from math import lgamma, log

    import numpy as np

    rows = contingency(df, a, b).collect()  # bounded by the number of labels squared
    na: dict = {}
    nb: dict = {}
    for r in rows:
        na[r.a], nb[r.b] = na.get(r.a, 0) + r.n, nb.get(r.b, 0) + r.n
    n = sum(na.values())
    mi = sum(r.n / n * log(r.n * n / (na[r.a] * nb[r.b])) for r in rows)
    h = max(-sum(v / n * log(v / n) for v in d.values()) for d in (na, nb))
    g = lambda v: lgamma(v + 1)
    emi = 0.0
    for x in na.values():
        for z in nb.values():
            # cell counts are hypergeometric: all within 40 deviations of the mode, from the ratios of neighbours
            low, high, mode = max(1, x + z - n), min(x, z), (x + 1) * (z + 1) // (n + 2)
            reach = 40 * (1 + int((x * z / n * (1 - x / n) * (1 - z / n)) ** 0.5))
            low, high = max(low, mode - reach), min(high, mode + reach)
            if low > high:
                continue
            k = np.arange(low, high + 1, dtype=float)
            ratio = np.log((x - k[:-1]) * (z - k[:-1]) / ((k[:-1] + 1) * (n - x - z + k[:-1] + 1)))
            start = g(x) + g(z) + g(n - x) + g(n - z) - g(n) - g(low) - g(x - low) - g(z - low) - g(n - x - z + low)
            emi += float((k / n * np.log(n * k / (x * z)) * np.exp(start + np.concatenate([[0.0], np.cumsum(ratio)]))).sum())
    return 1.0 if abs(h - emi) < 1e-15 else (mi - emi) / (h - emi)


# --- scores of clusterings on features ----------------------------------------


def calinski_harabasz(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: (between / (k - 1)) / (within / (n - k)), noise (-1) left out; from one pass of sums for each cluster."""
    x = df.where(F.col(label) != -1)
    g = x.groupBy(label).agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(features)], F.sum(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in features])).alias("q"))
    d = range(len(features))
    t = g.agg(F.sum("n").alias("N"), F.count("*").alias("k"), F.sum("q").alias("Q"), *[F.sum(f"s{i}").alias(f"S{i}") for i in d], F.sum(reduce(lambda a, b: a + b, [F.col(f"s{i}") ** 2 for i in d]) / F.col("n")).alias("B"))
    between = F.col("B") - reduce(lambda a, b: a + b, [F.col(f"S{i}") ** 2 for i in d]) / F.col("N")
    within = F.col("Q") - F.col("B")
    return t.select((between / (F.col("k") - 1) / (within / (F.col("N") - F.col("k")))).alias("calinski_harabasz_score"))


def davies_bouldin(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: the mean over clusters of the largest (s_i + s_j) / distance of centroids; noise left out. Only centroids are paired."""
    x = df.where(F.col(label) != -1)
    c = x.groupBy(label).agg(F.array(*[F.avg(f) for f in features]).alias("c"))
    dist = lambda u, v: F.sqrt(F.aggregate(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    s = x.join(F.broadcast(c), label).groupBy(label).agg(F.avg(dist(F.array(*features), F.col("c"))).alias("s"), F.first("c").alias("c"))
    i, j = s.select(F.col(label).alias("i"), F.col("s").alias("si"), F.col("c").alias("ci")), s.select(F.col(label).alias("j"), F.col("s").alias("sj"), F.col("c").alias("cj"))
    r = i.join(j, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / dist(F.col("ci"), F.col("cj"))).alias("r"))
    return r.agg(F.avg("r").alias("davies_bouldin_score"))


def silhouette(df: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """(key, silhouette): exact, by distances to the points of every cluster; noise gets 0, as a row with a missing feature, which counts for no other; a cluster of one has a = 0.
    All pairs are compared, in packed blocks that give each row its sum of distances by cluster, so the work is quadratic, but nothing else is."""
    spark = df.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    x = df.select(F.col(key).alias("k"), F.col(label).alias("l"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    whole = x.where((F.col("l") != -1) & ~F.exists("x", lambda v: v.isNull()))
    sizes = [r for r in whole.groupBy("l").count().collect()]  # a row for each cluster
    number = spark.createDataFrame([(r[0], float(c)) for c, r in enumerate(sizes)], T.StructType([T.StructField("l", whole.schema["l"].dataType), T.StructField("c", T.DoubleType())]))
    count = spark.createDataFrame([(c, r[1]) for c, r in enumerate(sizes)], "c2 int, n long")
    pts = cut(whole.join(number, "l").select("k", F.col("c").cast("int").alias("c"), F.concat(F.array("c"), "x").alias("x"), F.monotonically_increasing_id().alias("i")))

    def sums(i, x, j, y):
        y = y[np.argsort(y[:, 0], kind="stable")]
        found, start = np.unique(y[:, 0], return_index=True)
        out = np.empty((len(i), len(found)))
        for at in range(0, len(i), 256):
            q = x[at : at + 256]
            out[at : at + 256] = np.add.reduceat(np.sqrt(sum((q[:, f, None] - y[:, f]) ** 2 for f in range(1, x.shape[1]))), start, axis=1)
        return [np.repeat(i, len(found)), np.tile(found.astype(np.int32), len(i)), out.ravel()]

    s = in_blocks(pts.select("i", "x").repartition(parts), pts.select(F.col("i").alias("j"), F.col("x").alias("y")).repartitionByRange(parts, "y"), sums, "i long, c2 int, d double")
    s = s.groupBy("i", "c2").agg(F.sum("d").alias("d")).join(pts.select("i", "k", "c"), "i").join(F.broadcast(count), "c2")
    own = F.col("c") == F.col("c2")
    p = s.select("i", "k", own.alias("own"), F.when(~own, F.col("d") / F.col("n")).when(F.col("n") > 1, F.col("d") / (F.col("n") - 1)).alias("d"))
    s = p.groupBy("i", "k").agg(F.coalesce(F.max(F.when(F.col("own"), F.col("d"))), F.lit(0.0)).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    s = s.select("k", safe_div(F.col("b") - F.col("a"), F.greatest("a", "b")).alias("silhouette"))
    return x.select("k").join(s, "k", "left").select(F.col("k").alias(key), F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"))
