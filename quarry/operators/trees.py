"""Decision trees, forests and boosting grown level by level on histograms.

Features are binned once by quantiles (exact distinct values where there are few). For each level, one aggregate counts rows and sums targets by
(node, feature, bin) in partial sums; the driver gets these histograms (nodes x features x bins) and picks the splits. Trees are nested column expressions, so scoring
stays in the plan. Forests grow all their trees at once: a row's weight in a tree is a hash-based Poisson count, so nothing is resampled or copied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BINS = 255


@dataclass
class Node:
    """A leaf while ``feature`` is -1; rows with x <= threshold (and nulls) go left."""

    value: list[float]
    n: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    gain: float = 0.0


@dataclass
class Tree:
    features: list[str]
    root: Node

    def apply(self, leaf) -> Column:
        def walk(n: Node) -> Column:
            if n.feature < 0:
                return leaf(n)
            return F.when(F.col(self.features[n.feature]) > n.threshold, walk(n.right)).otherwise(walk(n.left))

        return walk(self.root)

    def value(self, k: int = 0) -> Column:
        return self.apply(lambda n: F.lit(float(n.value[k])))

    def leaves(self) -> Column:
        number: dict[int, int] = {}
        return self.apply(lambda n: F.lit(number.setdefault(id(n), len(number))))

    def importances(self) -> list[float]:
        out = [0.0] * len(self.features)

        def walk(n: Node) -> None:
            if n.feature >= 0:
                out[n.feature] += n.gain
                walk(n.left)
                walk(n.right)

        walk(self.root)
        total = sum(out)
        return [v / total for v in out] if total else out


def thresholds(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Split points: midpoints of the distinct values where these are few, else quantiles. At most ``max_bins`` for each feature reach the driver."""
    few = df.agg(*[F.approx_count_distinct(c) for c in features]).first()
    out = []
    for c, n in zip(features, few, strict=True):
        if n <= max_bins * 0.9:
            v = sorted(float(r[0]) for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
            out.append([(a + b) / 2 for a, b in zip(v[:-1], v[1:], strict=True)])
        else:
            q = df.agg(F.percentile_approx(c, [k / max_bins for k in range(1, max_bins)], 10_000)).first()[0]
            out.append(sorted(set(map(float, q))))
    return out


def impurity(kind: str, w: float, s: np.ndarray, q: float) -> float:
    """Of a node with weight ``w``, target sums ``s`` and sum of squares ``q``, times its weight."""
    if w <= 0:
        return 0.0
    if kind == "mse":
        return q - float(s[0] ** 2) / w
    p = s / w
    if kind == "gini":
        return w * (1 - float(np.sum(p * p)))
    return -w * float(np.sum(p[p > 0] * np.log(p[p > 0])))


def grow(df: DataFrame, features: list[str], targets: list[Column], weight: list[Column] | None = None, kind: str = "mse", max_depth: int = 5, min_split: int = 2, min_leaf: int = 1, cuts: list[list[float]] | None = None, max_features: int | None = None, seed: int = 0, random_cut: bool = False) -> list[Tree]:
    """One tree for each of ``weight`` (a single tree of all rows by default). ``targets``: the target, or an indicator for each class."""
    cuts = cuts or thresholds(df, features)
    weight = weight or [F.lit(1.0)]
    rng = np.random.default_rng(seed)
    below = lambda f: lambda v: v < F.col(f)
    bins = [F.size(F.filter(F.array(*map(F.lit, c)) if c else F.array().cast("array<double>"), below(f))) for f, c in zip(features, cuts, strict=True)]
    k = len(targets)
    data = df.select(*features, F.array(*bins).alias("_bins"), *[t.cast("double").alias(f"_t{i}") for i, t in enumerate(targets)], *[w.cast("double").alias(f"_w{i}") for i, w in enumerate(weight)])
    trees = [Tree(features, Node([0.0] * k, 0)) for _ in weight]
    open_: list[list[Node]] = [[t.root] for t in trees]
    for depth in range(max_depth + 1):
        rows = []
        for i, t in enumerate(trees):
            place = {id(n): j for j, n in enumerate(open_[i])}
            if place:
                rows.append(F.struct(F.lit(i).alias("tree"), t.apply(lambda n, place=place: F.lit(place.get(id(n)))).alias("node"), F.col(f"_w{i}").alias("w")))
        if not rows:
            break
        x = data.select("_bins", *[f"_t{j}" for j in range(k)], F.explode(F.array(*rows)).alias("r")).where("r.node IS NOT NULL AND r.w > 0")
        x = x.select("r.tree", "r.node", "r.w", *[f"_t{j}" for j in range(k)], F.posexplode("_bins").alias("f", "b"))
        h = x.groupBy("tree", "node", "f", "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("_t0") * F.col("_t0")).alias("q"), *[F.sum(F.col("w") * F.col(f"_t{j}")).alias(f"s{j}") for j in range(k)]).collect()
        hist: dict = {}
        for r in h:
            a = hist.setdefault((r["tree"], r["node"]), {}).setdefault(r["f"], np.zeros((len(cuts[r["f"]]) + 1, k + 2)))
            a[r["b"]] = [r["w"], r["q"], *[r[f"s{j}"] for j in range(k)]]
        nxt: list[list[Node]] = [[] for _ in trees]
        for (i, j), fs in sorted(hist.items()):
            node = open_[i][j]
            total = fs[0].sum(0)
            node.n, node.value = float(total[0]), list(total[2:] / total[0])
            whole = impurity(kind, total[0], total[2:], total[1])
            if depth == max_depth or total[0] < min_split or whole <= 1e-12:
                continue
            best = (1e-12, -1, -1)
            names = range(len(features)) if not max_features else rng.choice(len(features), min(max_features, len(features)), replace=False)
            for f in sorted(names):
                left = np.cumsum(fs[f], 0)[:-1]
                ok = [b for b in range(len(left)) if left[b, 0] >= min_leaf and total[0] - left[b, 0] >= min_leaf]
                if random_cut and ok:
                    ok = [ok[rng.integers(len(ok))]]
                for b in ok:
                    right = total - left[b]
                    gain = whole - impurity(kind, left[b, 0], left[b, 2:], left[b, 1]) - impurity(kind, right[0], right[2:], right[1])
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, f, b)
            if best[1] >= 0:
                node.gain, node.feature, node.threshold = best[0], int(best[1]), cuts[best[1]][best[2]]
                node.left, node.right = Node(node.value, 0), Node(node.value, 0)
                nxt[i] += [node.left, node.right]
        open_ = nxt
    return trees


def _classes(df: DataFrame, y: str) -> list:
    return sorted(r[0] for r in df.select(y).distinct().collect())


@dataclass
class TreeClassifier:
    classes: list
    trees: list[Tree]
    weights: list[float] = field(default_factory=list)
    hard: bool = True

    def probabilities(self) -> list[Column]:
        return [reduce(lambda a, b: a + b, [t.value(k) for t in self.trees]) / len(self.trees) for k in range(len(self.classes))]

    def predict(self) -> Column:
        """Votes (each tree's highest class among equals, weighted), or the largest mean probability; of equals the highest class."""
        w = self.weights or [1.0] * len(self.trees)
        if self.hard:
            top = [t.apply(lambda n: F.lit(max(range(len(n.value)), key=lambda k: (n.value[k], k)))) for t in self.trees]
            score = [reduce(lambda a, b: a + b, [F.when(v == k, float(x)).otherwise(0.0) for v, x in zip(top, w, strict=True)]) for k in range(len(self.classes))]
        else:
            score = self.probabilities()
        best = F.greatest(*[F.struct(s.alias("s"), F.lit(k).alias("k")) for k, s in enumerate(score)]) if len(score) > 1 else F.struct(score[0].alias("s"), F.lit(0).alias("k"))
        return F.element_at(F.array(*map(F.lit, self.classes)), best["k"] + 1)


@dataclass
class TreeRegressor:
    trees: list[Tree]
    scale: list[float] = field(default_factory=list)
    start: float = 0.0

    def predict(self) -> Column:
        s = self.scale or [1 / max(1, len(self.trees))] * len(self.trees)
        return reduce(lambda a, b: a + b, [t.value() * float(w) for t, w in zip(self.trees, s, strict=True)], F.lit(float(self.start)))


def poisson_weight(key: str, tree: int, seed: int) -> Column:
    """A Poisson(1) count from a hash: a bootstrap without resampling."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(tree), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    edge, out, p = 0.0, F.lit(6.0), math.exp(-1)
    cut = []
    for k in range(6):
        edge += p
        p /= k + 1
        cut.append((edge, float(k)))
    for e, k in reversed(cut):
        out = F.when(u < e, k).otherwise(out)
    return out


def decision_tree_classifier(df, features, y, criterion="gini", **options) -> TreeClassifier:
    c = _classes(df, y)
    return TreeClassifier(c, grow(df, features, [(F.col(y) == k).cast("double") for k in c], kind=criterion, **options))


def decision_tree_regressor(df, features, y, **options) -> TreeRegressor:
    return TreeRegressor(grow(df, features, [F.col(y)], **options))


def _sqrt(features: list[str]) -> int:
    return max(1, int(math.sqrt(len(features))))


def random_forest_classifier(df, features, y, key, n_trees=20, seed=0, max_features=None, **options) -> TreeClassifier:
    c = _classes(df, y)
    w = [poisson_weight(key, i, seed) for i in range(n_trees)]
    return TreeClassifier(c, grow(df, features, [(F.col(y) == k).cast("double") for k in c], w, "gini", max_features=max_features or _sqrt(features), seed=seed, **options))


def random_forest_regressor(df, features, y, key, n_trees=20, seed=0, **options) -> TreeRegressor:
    return TreeRegressor(grow(df, features, [F.col(y)], [poisson_weight(key, i, seed) for i in range(n_trees)], seed=seed, **options))


def extra_trees_classifier(df, features, y, n_trees=20, seed=0, **options) -> TreeClassifier:
    c = _classes(df, y)
    return TreeClassifier(c, grow(df, features, [(F.col(y) == k).cast("double") for k in c], [F.lit(1.0)] * n_trees, "gini", max_features=_sqrt(features), seed=seed, random_cut=True, **options))


def extra_trees_regressor(df, features, y, n_trees=20, seed=0, **options) -> TreeRegressor:
    return TreeRegressor(grow(df, features, [F.col(y)], [F.lit(1.0)] * n_trees, seed=seed, random_cut=True, **options))


def bagging_classifier(df, features, y, key, n_trees=10, seed=0, **options) -> TreeClassifier:
    return random_forest_classifier(df, features, y, key, n_trees, seed, max_features=len(features), **options)


def bagging_regressor(df, features, y, key, n_trees=10, seed=0, **options) -> TreeRegressor:
    return random_forest_regressor(df, features, y, key, n_trees, seed, **options)


def voting_classifier(df, features, y, max_depths=(2, 4), **options) -> TreeClassifier:
    parts = [decision_tree_classifier(df, features, y, max_depth=d, **options) for d in max_depths]
    return TreeClassifier(parts[0].classes, [p.trees[0] for p in parts])


def voting_regressor(df, features, y, max_depths=(2, 4), **options) -> TreeRegressor:
    return TreeRegressor([decision_tree_regressor(df, features, y, max_depth=d, **options).trees[0] for d in max_depths])


def gradient_boosting_regressor(df, features, y, n_trees=20, rate=0.1, max_depth=3, loss="squared", huber_alpha=0.9, max_bins=MAX_BINS, **options) -> TreeRegressor:
    """Trees of the pseudo-residuals; leaves are means of these also for the absolute and Huber losses."""
    cuts = thresholds(df, features, max_bins)
    start = df.agg(F.avg(y) if loss == "squared" else F.percentile_approx(y, 0.5)).first()[0]
    m = TreeRegressor([], [], float(start))
    for _ in range(n_trees):
        r = F.col(y) - m.predict()
        if loss == "lad":
            r = F.signum(r)
        elif loss == "huber":
            d = df.agg(F.percentile_approx(F.abs(r), huber_alpha)).first()[0]
            r = F.when(F.abs(r) <= d, r).otherwise(F.signum(r) * d)
        m.trees.append(grow(df, features, [r], kind="mse", max_depth=max_depth, cuts=cuts, **options)[0])
        m.scale.append(rate)
    return m


def _residuals(df, features, y, p, max_depth, cuts, newton, options) -> Tree:
    """A tree of y - p; leaves are means, or Newton steps (sums of residuals over sums of p (1 - p)) with ``newton``."""
    if not newton:
        return grow(df, features, [y - p], kind="mse", max_depth=max_depth, cuts=cuts, **options)[0]
    h = F.greatest(p * (1 - p), F.lit(1e-9))
    return grow(df, features, [(y - p) / h], [h], "mse", max_depth=max_depth, cuts=cuts, **(options | {"min_leaf": 0}))[0]


def gradient_boosting_classifier(df, features, y, n_trees=20, rate=0.1, max_depth=3, max_bins=MAX_BINS, newton=False, **options) -> tuple[TreeRegressor, Column]:
    """Log-loss of a 0/1 target: (score model, probability). Leaves are means of residuals, or Newton steps with ``newton`` (as in histogram boosting)."""
    cuts = thresholds(df, features, max_bins)
    p0 = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    m = TreeRegressor([], [], math.log(p0 / (1 - p0)))
    for _ in range(n_trees):
        m.trees.append(_residuals(df, features, F.col(y), 1 / (1 + F.exp(-m.predict())), max_depth, cuts, newton, options))
        m.scale.append(rate)
    return m, 1 / (1 + F.exp(-m.predict()))


@dataclass
class BoostedClassifier:
    """A score model for each class; probabilities are their softmax."""

    classes: list
    scores: list[TreeRegressor]

    def probabilities(self) -> list[Column]:
        z = [m.predict() for m in self.scores]
        return [1 / reduce(lambda a, b: a + b, [F.exp(other - own) for other in z]) for own in z]

    def predict(self) -> Column:
        """The class of the highest score, the first of equals."""
        best = F.greatest(*[F.struct(m.predict().alias("s"), F.lit(-k).alias("k")) for k, m in enumerate(self.scores)])
        return F.element_at(F.array(*map(F.lit, self.classes)), 1 - best["k"])


def gradient_boosting_multiclass(df, features, y, n_trees=20, rate=0.1, max_depth=3, max_bins=MAX_BINS, newton=False, **options) -> BoostedClassifier:
    """Log-loss of two or more classes: a tree for each class and round, all of a round on the probabilities before it; scores start at the logs of the classes' shares."""
    cuts, counts = thresholds(df, features, max_bins), sorted((r[0], r[1]) for r in df.where(F.col(y).isNotNull()).groupBy(y).count().collect())
    if len(counts) < 2:
        raise ValueError("boosting needs two classes or more")
    n = sum(c for _, c in counts)
    m = BoostedClassifier([k for k, _ in counts], [TreeRegressor([], [], math.log(c / n)) for _, c in counts])
    for _ in range(n_trees):
        p = m.probabilities()
        trees = [_residuals(df, features, (F.col(y) == k).cast("double"), p[i], max_depth, cuts, newton, options) for i, k in enumerate(m.classes)]
        for score, t in zip(m.scores, trees, strict=True):
            score.trees.append(t)
            score.scale.append(rate)
    return m


def adaboost_classifier(df, features, y, n_trees=10, rate=1.0, **options) -> TreeClassifier:
    """Stumps on weights: a factor for each row, kept as an expression of the stumps before; stops when a stump is no better than chance."""
    c, cuts = _classes(df, y), thresholds(df, features)
    out, w = TreeClassifier(c, [], []), F.lit(1.0)
    for _ in range(n_trees):
        t = grow(df, features, [(F.col(y) == k).cast("double") for k in c], [w], "gini", max_depth=1, cuts=cuts, **options)[0]
        wrong = TreeClassifier(c, [t]).predict() != F.col(y)
        e = df.agg(F.sum(F.when(wrong, w).otherwise(0.0)) / F.sum(w)).first()[0]
        if e >= 1 - 1 / len(c):
            break
        a = rate * (math.log((1 - e) / max(e, 1e-10)) + math.log(len(c) - 1))
        out.trees.append(t)
        out.weights.append(a)
        if e <= 1e-10:
            break
        w = w * F.when(wrong, math.exp(a)).otherwise(1.0)
    return out


def adaboost_regressor(df, features, y, n_trees=10, rate=1.0, max_depth=3, loss="linear", **options) -> Column:
    """Weights grow where errors, as shares of the largest, are large (linear, square or exponential loss); predicts the median of the trees by their weights."""
    cuts, trees, weights, w = thresholds(df, features), [], [], F.lit(1.0)
    for _ in range(n_trees):
        t = grow(df, features, [F.col(y).cast("double")], [w], "mse", max_depth=max_depth, cuts=cuts, **options)[0]
        e = F.abs(F.col(y) - t.value())
        top = df.agg(F.max(e)).first()[0]
        if not top:
            trees, weights = [*trees, t], [*weights, 1.0]
            break
        e = {"linear": e / top, "square": (e / top) ** 2, "exponential": 1 - F.exp(-e / top)}[loss]
        mean = df.agg(F.sum(w * e) / F.sum(w)).first()[0]
        if mean >= 0.5 and trees:
            break
        beta = max(mean, 1e-10) / max(1 - mean, 1e-10)
        trees, weights = [*trees, t], [*weights, rate * math.log(1 / beta) if beta < 1 else 1e-10]
        if beta >= 1:
            break
        w = w * F.pow(F.lit(beta), (1 - e) * rate)
    half = sum(weights) / 2
    pairs = F.array_sort(F.array(*[F.struct(t.value().alias("v"), F.lit(float(a)).alias("w")) for t, a in zip(trees, weights, strict=True)]))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    return F.aggregate(pairs, zero, lambda a, x: F.struct((a["sum"] + x["w"]).alias("sum"), F.coalesce(a["at"], F.when(a["sum"] + x["w"] >= half * (1 - 1e-12), x["v"])).alias("at")))["at"]


def isolation_forest(df: DataFrame, features: list[str], n_trees: int = 100, max_samples: int = 256, seed: int = 0) -> Column:
    """The anomaly score 2^(-mean depth / c) as an expression. Each tree isolates ``max_samples`` rows, which the method itself fixes; scoring covers all rows."""
    rng = np.random.default_rng(seed)
    n = df.count()
    rows = np.array([list(map(float, r)) for r in df.select(*features).sample(min(1.0, 2.0 * max_samples * min(n_trees, 20) / max(n, 1)), seed).limit(max_samples * 40).collect()])
    c = lambda m: 0.0 if m <= 1 else 2 * (math.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m
    size = min(max_samples, len(rows))
    depth = math.ceil(math.log2(max(size, 2)))

    def build(x: np.ndarray, d: int) -> Node:
        node = Node([d + c(len(x))], len(x))
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if d < depth and len(spread):
            f = int(rng.choice(spread))
            t = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            go = x[:, f] <= t
            node.feature, node.threshold, node.left, node.right = f, t, build(x[go], d + 1), build(x[~go], d + 1)
        return node

    trees = [Tree(features, build(rows[rng.choice(len(rows), size, replace=False)], 0)) for _ in range(n_trees)]
    mean = reduce(lambda a, b: a + b, [t.value() for t in trees]) / n_trees
    return F.pow(F.lit(2.0), -mean / max(c(size), 1e-12))


def random_trees_embedding(df, features, n_trees=5, max_depth=3, seed=0) -> list[Column]:
    """A leaf number for each tree of random splits; one-hot encode these for the embedding."""
    w = [F.lit(1.0)] * n_trees
    return [t.leaves() for t in grow(df, features, [F.rand(seed)], w, "mse", max_depth=max_depth, max_features=1, seed=seed, random_cut=True)]
