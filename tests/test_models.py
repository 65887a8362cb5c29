import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agoralytics.operators import balance, features, labels, metrics, models, reports


def points(spark, rows, label=lambda i: i % 7 == 0, size=3, copies=False, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        x = [float(rng.randrange(6)) if copies else rng.gauss(0, 1 + 5 * (i % 3)) for _ in range(size)]
        data.append((str(i), int(label(i)), x))
    return spark.createDataFrame(data, "id string, label int, x array<double>")


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("leaf", [10, 1000])
def test_neighbours_against_brute_force(spark, leaf, copies):
    rows = points(spark, 150, copies=copies)
    xs = np.array([r["x"] for r in rows.collect()])
    for r in balance.neighbour_lists(rows, "x", 5, leaf).collect():
        x = np.array(r["x"])
        expected = np.sort(np.sqrt(((xs - x) ** 2).sum(axis=1)))[1:6]
        found = np.sqrt(((np.array(r["neighbours"]) - x) ** 2).sum(axis=1))
        assert np.allclose(found, expected)


@pytest.mark.parametrize("leaf", [8, 1000])
def test_smote(spark, leaf):
    rows = points(spark, 200)
    out = balance.smote(rows, "id", "label", "x", leaf=leaf)
    again = balance.smote(rows.repartition(7), "id", "label", "x", leaf=leaf)
    key = lambda df: sorted((r["id"], r["label"], tuple(r["x"])) for r in df.collect())
    assert key(out) == key(again)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 171, 1: 171}
    minority = {r["id"]: np.array(r["x"]) for r in rows.filter("label = 1").collect()}
    for r in out.filter("synthetic").collect():
        base = minority[r["id"].split("#")[0]]
        x = np.array(r["x"])
        between = [
            other for other in minority.values()
            if np.all(x >= np.minimum(base, other) - 1e-9)
            and np.all(x <= np.maximum(base, other) + 1e-9)
        ]
        assert between


def test_smote_needs_neighbours(spark):
    with pytest.raises(ValueError):
        balance.smote(points(spark, 30), "id", "label", "x")


def test_anova(spark):
    rows = points(spark, 90).select(
        "label", *[F.col("x")[i].alias(f"feat_{i}") for i in range(3)], F.lit(1).alias("feat_c")
    )
    names = ["feat_0", "feat_1", "feat_2", "feat_c"]
    found = {r["feature"]: r for r in features.anova_scores(rows, names, "label", 2).collect()}
    data = rows.toPandas()
    for name in names[:3]:
        groups = [g[name].to_numpy() for _, g in data.groupby("label")]
        grand = data[name].mean()
        between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert found[name]["f_score"] == pytest.approx(between / (within / (len(data) - 2)))
    assert found["feat_c"]["f_score"] is None and found["feat_c"]["rank"] == 4
    assert sum(r["selected"] for r in found.values()) == 2


def test_macro_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] * 2 + [(2, 0)], "y_true int, y_pred int")
    row = metrics.macro_metrics(rows, digits=6).head()
    assert row["precision_macro"] == pytest.approx(round((3 / 5) / 3, 6))
    assert row["recall_macro"] == pytest.approx(round(1 / 3, 6))
    assert row["f1_macro"] == pytest.approx(round((6 / 8) / 3, 6))
    matrix = [tuple(r) for r in metrics.confusion_matrix(rows, [0, 1, 2]).collect()]
    assert matrix == [(0, 0, 2, 0), (1, 0, 3, 0), (2, 1, 0, 0)]


def test_describe_matches_pandas(spark):
    values = [1, 2, 2, 3, 10, 10, 11]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    row = reports.describe(df, "v", digits=6).head().asDict()
    import pandas as pd

    expected = pd.Series(values).describe()
    assert [row[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == [
        pytest.approx(v, abs=1e-6) for v in expected
    ]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3,), (3,)], "v long")
    assert [tuple(r) for r in reports.histogram_table(df, "v", 10, 4).collect()] == [(2, 3.0, 2)]


def test_kappa(spark):
    a = spark.createDataFrame([(1, "SS"), (2, "SS"), (3, "NSS"), (4, "NSS")], "message_id long, label string")
    b = spark.createDataFrame([(1, "SS"), (2, "NSS"), (3, "NSS"), (4, "NSS")], "message_id long, label string")
    assert labels.cohens_kappa(a, b).head()["kappa"] == 0.5


def test_models_learn(spark):
    rng = random.Random(5)
    data = []
    for i in range(240):
        y = int(i % 4 == 0)
        word = "steun samen" if y else "niets alleen"
        data.append((i, f"u{i % 40}", f"{word} tekst {rng.randrange(9)}", rng.gauss(2.5 * y, 1), rng.gauss(0, 1),
                     "successful" if y else "unsuccessful", ["train", "train", "val", "test"][(i // 4) % 4]))
    table = spark.createDataFrame(
        data, "topic_id long, poster_id string, text_normalized string, feat_a double, feat_b double,"
              " thread_label string, split string",
    )
    prepared = models.prepare(table, ["feat_a", "feat_b"])
    assert prepared.rows == 180
    trained = models.train_models(
        prepared, [models.MAJORITY, models.TFIDF_LR, models.LOGISTIC, models.SVM, models.FOREST]
    )
    validation = models.evaluate(trained, prepared.val, "val")
    scores = {r["model"]: r["val_f1_macro"] for r in validation.collect()}
    assert scores[models.TFIDF_LR] == 1.0 and models.best_model(validation) == models.TFIDF_LR
    assert scores[models.MAJORITY] < 0.5
    assert all(scores[m] > 0.7 for m in (models.LOGISTIC, models.SVM, models.FOREST))
    shares = models.linear_importance(trained[models.LOGISTIC], prepared.test, prepared.features)
    assert shares.head()["feature"] == "feat_a"
    cv = models.cv_summary(models.cross_validate(prepared.train, models.LOGISTIC, "topic_id", 3))
    assert cv.head()["cv_f1_macro_mean"] > 0.7

    names = [models.MAJORITY, models.TFIDF_LR, models.LOGISTIC, models.SVM]
    folds = models.cross_validate_models(prepared, names, folds=3)
    found = {r["model"]: r for r in folds.collect()}
    assert set(found) == set(names[1:]) and found[models.TFIDF_LR]["cv_f1_macro_mean"] == 1.0
    # the same folds as one model at a time
    assert found[models.LOGISTIC] == cv.head()
    test = models.evaluate(trained, prepared.test, "test")
    summary = {r["model"]: r for r in models.results_summary(validation, test, folds).collect()}
    assert set(summary) == set(trained) and summary[models.MAJORITY]["cv_f1_macro_mean"] is None
    assert summary[models.SVM]["cv_f1_macro_std"] == found[models.SVM]["cv_f1_macro_std"]
    searched = models.search(prepared, models.LOGISTIC, folds=3, grid=[{"c": 1e-6}, {"c": 1.0}]).collect()
    assert [r["place"] for r in searched] == [1, 2]
    assert {r["settings"]: r["cv_f1_macro_mean"] for r in searched}['{"c": 1.0}'] == found[models.LOGISTIC]["cv_f1_macro_mean"]
    forest = models.search(prepared, models.FOREST, folds=2, grid=[{"maxDepth": 2, "numTrees": 5}]).head()
    assert forest["model"] == models.FOREST and forest["cv_f1_macro_mean"] > 0.7
