"""Boosted trees against plain Python, contributions against all orders of features, squared hinge against its conditions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from agoralytics.operators import contributions, hinge
from agoralytics.operators.boosting import Booster, Boosted

DRAW = np.random.default_rng(5)
X = np.round(DRAW.normal(size=(180, 4)), 1)
X[:, 3] = 1.0
Y = ((X[:, 0] + X[:, 1] * X[:, 2] + DRAW.normal(size=180) * 0.4) > 0).astype(float)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(Vectors.dense(x), float(y)) for x, y in zip(X, Y, strict=True)], ["features", "target"]).repartition(3).cache()


def brute_tree(x, g, h, depth, l1, l2, least, rate):
    """Grows a tree by trying every value of every feature; returns a function of a row."""
    soft = lambda v: math.copysign(max(abs(v) - l1, 0), v)
    score = lambda a, b: soft(a) ** 2 / (b + l2)
    weight = -rate * soft(g.sum()) / (h.sum() + l2)
    best = (1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f]):
                left = x[:, f] <= cut
                if h[left].sum() >= least and h[~left].sum() >= least:
                    value = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                    if value > best[0] + 1e-9:
                        best = (value, (f, cut))
    if best[1] is None:
        return lambda row: weight
    f, cut = best[1]
    left = x[:, f] <= cut
    a, b = (brute_tree(x[s], g[s], h[s], depth - 1, l1, l2, least, rate) for s in (left, ~left))
    return lambda row: a(row) if row[f] <= cut else b(row)


@pytest.mark.parametrize("l1, l2", [(1.0, 2.0), (0.0, 0.5), (6.0, 0.0)])
def test_boosting_equals_brute_force(rows, l1, l2):
    model = Booster(rounds=4, depth=3, rate=0.3, rows=1.0, columns=1.0, l1=l1, l2=l2, least=2.0).fit(rows)
    margin = np.zeros(len(X))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        tree = brute_tree(X, p - Y, p * (1 - p), 3, l1, l2, 2.0, 0.3)
        margin += np.array([tree(r) for r in X])
    assert np.allclose(model.margins(X), margin, atol=1e-6)


def test_boosting_learns_and_repeats(rows, spark, monkeypatch):
    monkeypatch.setattr("agoralytics.operators.boosting.WRITE", 4)
    booster = Booster(rounds=10, rate=0.3, least=1.0)
    model, again = booster.fit(rows), booster.fit(rows.repartition(7))
    assert np.array_equal(model.margins(X), again.margins(X))
    scored = model.transform(rows)
    assert scored.agg(F.avg((F.col("prediction") == F.col("target")).cast("int"))).head()[0] > 0.8
    assert scored.where("abs(probability - 1 / (1 + exp(-margin))) > 1e-12").count() == 0
    assert booster.fit(rows.limit(0)).trees == []
    assert booster.fit(rows.where("target = 1")).margins(X).min() >= 0


def brute_shares(x, score_of_known, n):
    """Mean over all orders of what a feature adds when it becomes known."""
    out = np.zeros(n)
    for order in itertools.permutations(range(n)):
        known = set()
        before = score_of_known(x, known)
        for f in order:
            known.add(f)
            now = score_of_known(x, known)
            out[f] += now - before
            before = now
    return out / math.factorial(n)


def by_leaves(leaves):
    def score(x, known):
        total = 0.0
        for leaf in leaves:
            part = leaf.value
            for f, low, high, share in leaf.way:
                part *= float(low < x[f] <= high) if f in known else share
            total += part
        return total

    return score


def test_contributions(rows):
    boosted = Booster(rounds=6, rate=0.3, least=1.0).fit(rows)
    forest = RandomForestClassifier(labelCol="target", numTrees=5, maxDepth=4, seed=1).fit(rows)
    x = np.array([r.features.toArray() for r in rows.collect()])
    probability = np.array([r.probability[1] for r in forest.transform(rows).collect()])
    for leaves, score in (
        (contributions.boosted_leaves(boosted), boosted.margins(x)),
        (contributions.forest_leaves(forest, rows), probability),
    ):
        want = np.array([brute_shares(row, by_leaves(leaves), 4) for row in x[:5]])
        assert np.allclose(contributions.shares(x[:5], leaves), want)
        split = contributions.with_contributions(rows, leaves).select(F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)).collect()
        assert np.allclose(np.array(split).ravel() + contributions.base_value(leaves), score)
        means = {r.feature: r.mean_contribution for r in contributions.mean_contributions(rows, leaves, list("abcd")).collect()}
        assert means["d"] == 0 and min(means[f] for f in "abc") > 0
    for tree in boosted.trees:  # a row of which nothing is known is spread over all leaves
        leaves = contributions.boosted_leaves(Boosted([tree]))
        assert abs(sum(np.prod([s for *_, s in leaf.way]) for leaf in leaves) - 1) < 1e-9


def test_squared_hinge(rows, spark):
    weighted = rows.withColumn("weight", F.when(F.col("target") == 1, 0.7).otherwise(1.4))
    model = hinge.SquaredHinge(c=0.5).fit(weighted)
    z = np.column_stack([(X - X.mean(axis=0)) / np.where(X.std(axis=0) > 0, X.std(axis=0), 1), np.ones(len(X))])
    y, weight = 2 * Y - 1, np.where(Y == 1, 0.7, 1.4)

    def slope(w):
        short = np.maximum(0, 1 - y * (z @ w))
        return w - 2 * 0.5 * (weight * short * y) @ z

    assert np.abs(slope(model.weights)).max() < 1e-5  # the loss is convex: where its slope is zero is its minimum
    scored = model.transform(weighted).collect()
    assert np.allclose(sorted(r.margin for r in scored), sorted(z @ model.weights))
    assert np.mean([r.prediction == r.target for r in scored]) > 0.6
    assert hinge.SquaredHinge().fit(weighted.limit(0)).weights.tolist() == [0.0]
