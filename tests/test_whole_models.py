"""The registered model queries do all that they name, over rows of their own."""

import random
import threading

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from agoralytics.catalog import modelled
from agoralytics.operators import balance, boosting, contributions, models
from agoralytics.operators.features import feature_columns, feature_table
from agoralytics.operators.lexicon import lexicon_scores
from agoralytics.operators.split import user_split
from agoralytics.plans import flows


def posts(spark, n=240, seed=5):
    rng = random.Random(seed)
    rows = [
        (i, f"u{i % 40}", f"tekst {rng.randrange(9)}", rng.gauss(1.5 * (i % 3 == 0), 1), rng.gauss(0, 1),
         "successful" if i % 3 == 0 else "unsuccessful", ["train", "train", "val", "test"][(i // 4) % 4])
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "topic_id long, poster_id string, text_normalized string, feat_a double, feat_b double, thread_label string, split string"
    )


@pytest.fixture
def prepared(spark, monkeypatch):
    data = models.prepare(posts(spark), ["feat_a", "feat_b"])
    monkeypatch.setattr(modelled, "_prepared", lambda spark, folder, *a: data)
    return data


def test_cv_scores_compares_both_ways_of_filling_up(spark, prepared):
    found = {r["oversample"]: (r["cv_f1_macro_mean"], r["cv_f1_macro_std"]) for r in modelled.cv_scores(spark, "").collect()}
    before = modelled.cv_scores_filled_before(spark, "").head()
    inside = models.cv_summary(models.cross_validate(prepared.train, models.LOGISTIC, "topic_id")).head()
    assert found == {
        "inside": (inside["cv_f1_macro_mean"], inside["cv_f1_macro_std"]),
        "before": (before["cv_f1_macro_mean"], before["cv_f1_macro_std"]),
    }


ENTRIES = (("tekst", False, [1]), ("te", True, [2]), ("samen", False, [1, 2]))


@pytest.mark.parametrize("ids", [[1, 2, 3, 4], [1, 1, 2, None, None]])
def test_labelled_features_in_one_pass(spark, ids):
    """The same as features and scores joined by key, also where keys repeat or are missing; texts are written only if wanted."""
    texts = ["Tekst? samen... te", None, "tekst tekst!", "niets", "te samen"]
    rows = [(k, f"u{i}", t, "successful") for i, (k, t) in enumerate(zip(ids, texts))]
    table = spark.createDataFrame(rows, "topic_id long, poster_id string, text_normalized string, thread_label string")
    entries = spark.createDataFrame(ENTRIES, "term string, is_prefix boolean, cat_ids array<int>")
    categories = {1: "affect", 2: "social", 3: "unlisted"}
    joined = user_split(feature_table(table, lexicon_scores(table, entries, categories)))
    whole = flows.labelled_features(table, entries, categories)
    narrow = flows.labelled_features(table, entries, categories, text=False)
    assert feature_columns(whole) == feature_columns(joined) == feature_columns(narrow)
    assert "text_normalized" not in narrow.columns and whole.count() == joined.count()
    for found in (whole, narrow):
        assert sorted(map(str, found.select(narrow.columns).collect())) == sorted(map(str, joined.select(narrow.columns).collect()))


def test_texts_are_shuffled_once_for_the_feature_table(spark):
    """Labels are joined to threads before the texts are fetched."""
    from agoralytics.catalog.base import Stages

    plan = Stages(spark, "/root/testdata/sf0.001").labelled._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Join", 1)[1].split("\n", 1)[0]
    assert "doc_id" in top


def test_neighbours_compare_few_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = np.column_stack([rng.lognormal(6, 1, 4000), rng.lognormal(4, 1, 4000), rng.random((4000, 2))])
    compared, squared = [], balance._squared
    monkeypatch.setattr(balance, "_squared", lambda a, b: compared.append(len(a) * len(b)) or squared(a, b))
    ids = rng.permutation(4000)
    row, column, d2 = balance._nearest(points, ids, points, ids, 5)
    assert sum(compared) < 4000 * 4000 / 4 and (np.bincount(row) == 5).all()
    every = squared(points, points)
    np.fill_diagonal(every, np.inf)
    assert np.array_equal(d2.reshape(4000, 5), np.sort(every, axis=1)[:, :5])


def test_only_wanted_vectors_are_searched(spark):
    rows = spark.createDataFrame([([float(i), float(i % 7)],) for i in range(300)], "x array<double>")
    for leaf in (20, 1000):
        every = {tuple(r.x): r.neighbours for r in balance.neighbour_lists(rows, "x", 4, leaf).collect()}
        some = {tuple(r.x): r.neighbours for r in balance.neighbour_lists(rows, "x", 4, leaf, F.col("x")[0] < 30).collect()}
        assert len(every) == 300 and some == {x: n for x, n in every.items() if x[0] < 30}


def test_ways_through_a_tree_over_bins():
    rng = np.random.default_rng(2)
    for feature in ([0, 1, 2, -1, 0, 1, -1], [1, -1, 0, -1, -1, 2, 1], [-1] * 7, [2, 1, -1, -1, -1, -1, -1]):
        feature = np.array(feature + [-1] * 8)
        tree = boosting.Tree(feature, np.where(feature < 0, -1.0, rng.integers(20, 200, 15)), rng.random(15), np.ones(15))
        bins = rng.integers(0, 256, (3, 500)).astype(np.uint8)
        binned = boosting._Binned.of(tree)
        assert np.array_equal(binned.ends[binned.way(bins)], tree.leaf(bins.T.astype(np.int64)))


def test_contributions_of_a_long_way():
    """Patterns are listed, or found in the rows where there would be too many: the same."""
    rng = np.random.default_rng(6)
    leaf = contributions.Leaf(0.7, tuple((f, -0.5, np.inf, 0.4 + 0.03 * f) for f in range(9)))
    x = rng.normal(size=(200, 9))
    listed = contributions.by_pattern(leaf, np.arange(1 << 9))
    direct = contributions._added(x, [(leaf, listed)])
    assert np.allclose(contributions.shares(x, [leaf]), direct)
    scored = 0.7 * (x > -0.5).all(axis=1)
    assert np.allclose(direct.sum(axis=1), scored - contributions.base_value([leaf]))


def test_grid_search_makes_the_folds_once(spark, prepared, monkeypatch):
    made, folds = [], models.cv_folds
    monkeypatch.setattr(models, "cv_folds", lambda *a, **b: made.append(1) or folds(*a, **b))
    found = {r["c"]: r["cv_f1_macro_mean"] for r in modelled.grid_search(spark, "").collect()}
    assert len(made) == 1 and set(found) == {0.1, 1.0, 10.0}
    alone = models.cv_summary(models.cross_validate(prepared.train, models.LOGISTIC, "topic_id", 3, "none", 10.0)).head()
    assert found[10.0] == alone["cv_f1_macro_mean"]


def test_models_are_fitted_at_the_same_time(spark, prepared, monkeypatch):
    barrier = threading.Barrier(3, timeout=60)
    monkeypatch.setattr(models, "fit", lambda name, *a, **b: (barrier.wait(), name)[1])
    names = [models.LOGISTIC, models.SVM, models.BOOSTED]
    assert models.train_models(prepared, names) == {n: n for n in names}


def test_sums_of_few_and_of_many_tasks_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3))
    rows = spark.createDataFrame([(Vectors.dense(v), float(v[0] + v[1] > 0)) for v in x], ["features", "target"]).repartition(5)
    monkeypatch.setattr(boosting, "BLOCK", 200)
    fitted = []
    for few in (64, 0):
        monkeypatch.setattr(boosting, "FEW", few)
        fitted.append(boosting.Booster(rounds=3).fit(rows))
    for a, b in zip(*(m.trees for m in fitted), strict=True):
        assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "threshold", "weight", "cover"))
    assert (fitted[0].trees[0].feature >= 0).any()
