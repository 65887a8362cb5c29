"""Classifiers on Spark ML, their comparison and their explanation."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    CountVectorizer,
    ElementwiseProduct,
    IDF,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agoralytics.config import SEED, SELECTED_FEATURES
from agoralytics.functions.text import WORD
from agoralytics.operators import contributions
from agoralytics.operators.balance import smote
from agoralytics.operators.boosting import Boosted, Booster
from agoralytics.operators.features import anova_scores
from agoralytics.operators.hinge import HingeModel, SquaredHinge
from agoralytics.operators.metrics import macro_metrics
from agoralytics.operators.split import cv_folds, with_weights
from agoralytics.session import cut_lineage, written

MAJORITY = "majority"
TFIDF_LR = "tfidf_logistic"
LOGISTIC = "logistic"
SVM = "linear_svm"
FOREST = "forest"
BOOSTED = "boosted_trees"
MODELS = (MAJORITY, TFIDF_LR, LOGISTIC, SVM, FOREST, BOOSTED)

#: Settings of each model that a search tries.
GRIDS: dict[str, list[dict]] = {
    TFIDF_LR: [{"vocabulary": n} for n in (1_000, 5_000, 20_000)],
    LOGISTIC: [{"c": c} for c in (0.1, 1.0, 10.0)],
    SVM: [{"c": c} for c in (0.1, 1.0, 10.0)],
    FOREST: [{"maxDepth": d, "minInstancesPerNode": n} for d in (3, 5, 8) for n in (1, 5)],
    BOOSTED: [{"depth": d, "rate": r} for d in (2, 3) for r in (0.05, 0.2)],
}


# data ------------------------------------------------------------------------


def with_target(df: DataFrame, label: str = "thread_label", positive: str = "successful") -> DataFrame:
    return df.withColumn("target", (F.col(label) == positive).cast("double"))


def matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds `features`, the vector of the feature columns with missing values as 0."""
    filled = df.select(
        "*",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)],
    )
    parts = [f"_x{i}" for i in range(len(features))]
    assembled = VectorAssembler(inputCols=parts, outputCol="features").transform(filled)
    return assembled.drop(*parts)


def select_features(
    train: DataFrame, features: Sequence[str], keep: int = SELECTED_FEATURES
) -> list[str]:
    """Names of the best features by ANOVA on the training rows."""
    chosen = anova_scores(train, features, "target", keep).filter("selected").collect()
    names = {row["feature"] for row in chosen}
    return [f for f in features if f in names]


# estimators ------------------------------------------------------------------


class _Majority:
    """Predicts the most frequent label of the training rows."""

    def fit(self, train: DataFrame) -> _MajorityModel:
        counts = train.groupBy("target").count()
        best = counts.agg(F.max_by("target", F.struct("count", -F.col("target")))).head()[0]
        return _MajorityModel(best)


@dataclass(frozen=True)
class _MajorityModel:
    label: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.label))


class _TfidfLogistic:
    """Words and word pairs, smoothed idf, unit length, balanced logistic regression."""

    def __init__(self, text: str = "text_normalized", vocabulary: int = 5000):
        self.text, self.vocabulary = text, vocabulary

    def fit(self, train: DataFrame) -> PipelineModel:
        tokens = RegexTokenizer(
            inputCol=self.text, outputCol="_t1", pattern=rf"[{WORD}]{{2,}}", gaps=False
        )
        pairs = NGram(n=2, inputCol="_t1", outputCol="_t2")
        joined = SQLTransformer(statement="SELECT *, concat(_t1, _t2) AS _terms FROM __THIS__")
        counts = CountVectorizer(
            inputCol="_terms", outputCol="_counts", vocabSize=self.vocabulary
        )
        terms = Pipeline(stages=[tokens, pairs, joined, counts]).fit(train)
        # The counts are read once by the idf and often by the regression.
        counted = cut_lineage(terms.transform(train).select("target", "_counts"))
        # Spark's idf has no "+ 1", so the weights are set by hand.
        idf = IDF(inputCol="_counts", outputCol="_idf").fit(counted).idf.toArray() + 1.0
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_scaled"
        )
        unit = Normalizer(inputCol="_scaled", outputCol="_unit")
        rows = with_weights(unit.transform(scale.transform(counted)), "target")
        model = _logistic(counted.count(), "_unit", 1000, standardize=False).fit(rows)
        return PipelineModel(stages=[*terms.stages, scale, unit, model])


def _logistic(
    rows: int, features: str, iterations: int, standardize: bool, c: float = 1.0
) -> LogisticRegression:
    """`c` is the inverse penalty over the summed loss; Spark averages the loss."""
    return LogisticRegression(
        featuresCol=features,
        labelCol="target",
        weightCol="weight",
        maxIter=iterations,
        tol=1e-5,
        regParam=1.0 / (c * max(rows, 1)),
        elasticNetParam=0.0,
        standardization=standardize,
    )


def estimator(name: str, rows: int, text: str = "text_normalized", c: float = 1.0, **settings):
    """Untrained model by name. `rows` are the training rows, for the penalty; settings as in GRIDS."""
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    if name == MAJORITY:
        return _Majority()
    if name == TFIDF_LR:
        return _TfidfLogistic(text, **settings)
    if name == LOGISTIC:
        return Pipeline(stages=[scaled, _logistic(rows, "scaled", 5000, False, c)])
    if name == SVM:
        return SquaredHinge(c)
    if name == FOREST:
        usual = {"numTrees": 200, "maxDepth": 5, "minInstancesPerNode": 5}
        return RandomForestClassifier(
            labelCol="target", weightCol="weight", seed=SEED, **{**usual, **settings}
        )
    if name == BOOSTED:
        return Booster(**settings)
    raise ValueError(f"unknown model {name!r}")


def fit(name: str, train: DataFrame, rows: int | None = None, c: float = 1.0, **settings):
    """Trains a model on rows with target, and features or text."""
    if name == MAJORITY or name == TFIDF_LR:
        return estimator(name, 0, **settings).fit(train)
    weighted = with_weights(train, "target")
    return estimator(name, rows or train.count(), c=c, **settings).fit(weighted)


# training and comparison -----------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """Rows of each part with target, text and feature vector; the training rows
    also with the minority class filled up."""

    train: DataFrame
    balanced: DataFrame
    val: DataFrame
    test: DataFrame
    features: list[str]
    rows: int


def prepare(
    table: DataFrame, features: Sequence[str], keep: int = SELECTED_FEATURES, key: str = "topic_id"
) -> Prepared:
    """From a feature table with split and thread_label to what the models need.

    Features are selected on the original training rows; the minority class is
    filled up afterwards. The table is written once, if it isn't, and read by every model;
    readers take only the columns they need.
    """
    rows = with_target(written(table))
    chosen = select_features(rows.filter("split = 'train'"), features, keep)
    columns = [c for c in (key, "poster_id", "text_normalized", "split", "target") if c in rows.columns]
    ready = matrix(rows, chosen).select(*columns, "features")
    train = ready.filter("split = 'train'")
    balanced = cut_lineage(
        smote(
            train.select(F.col(key).cast("string").alias("id"), "target",
                         vector_to_array("features").alias("x")),
            "id", "target", "x",
        ).select("target", array_to_features("x"))
    )
    return Prepared(
        train, balanced, ready.filter("split = 'val'"), ready.filter("split = 'test'"),
        chosen, balanced.count(),
    )


def array_to_features(column: str):
    return array_to_vector(column).alias("features")


def train_models(
    data: Prepared, names: Sequence[str] = MODELS
) -> dict[str, object]:
    """Text models learn from the original rows, the others from the balanced ones.

    They are fitted at the same time: the many short jobs of boosted trees leave most cores idle.
    """

    def trained(name: str):
        return fit(name, data.train if name == TFIDF_LR else data.balanced, None if name == TFIDF_LR else data.rows)

    return dict(zip(names, _side_by_side(trained, names), strict=True))


def evaluate(models: Mapping[str, object], rows: DataFrame, prefix: str) -> DataFrame:
    """(model, <prefix>_f1_macro, <prefix>_precision_macro, <prefix>_recall_macro)."""
    tables = [
        macro_metrics(model.transform(rows), "target", "prediction").select(
            F.lit(name).alias("model"),
            *[F.col(f"{m}_macro").alias(f"{prefix}_{m}_macro") for m in ("f1", "precision", "recall")],
        )
        for name, model in models.items()
    ]
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def best_model(validation: DataFrame) -> str:
    """Model with the best validation F1, the majority baseline left out."""
    ranked = validation.filter(F.col("model") != MAJORITY).orderBy(
        F.col("val_f1_macro").desc(), "model"
    )
    return ranked.head()["model"]


def results_summary(validation: DataFrame, test: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Validation and test results of each model side by side, with the folds' mean and deviation if given."""
    both = validation.join(test, "model", "full_outer")
    if folds is not None:
        both = both.join(folds, "model", "left")
    return both.select(
        "model", *[F.round(F.col(c), 3).alias(c) for c in both.columns if c != "model"]
    )


@dataclass(frozen=True)
class Fold:
    """Training rows, the same with the minority class filled up, and held-out rows."""

    train: DataFrame
    balanced: DataFrame
    held: DataFrame


def _side_by_side(work, items: Sequence) -> list:
    """Results of short Spark jobs that run at the same time, in the order of the items."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(work, items))


def folds_of(rows: DataFrame, key: str, folds: int = 5, oversample: str = "inside") -> list[Fold]:
    """The folds of a cross-validation, over one written table that every model reads.

    oversample='inside' fills up the minority class of each training part only;
    'none' leaves rows as they are (use it on rows already filled up, which is
    what a leaking comparison does, or for text models).
    """
    folded = cut_lineage(cv_folds(rows, "target", key, folds))

    def part(fold: int) -> Fold:
        train = folded.filter(F.col("fold") != fold)
        balanced = train
        if oversample == "inside":
            balanced = cut_lineage(
                smote(
                    train.select(F.col(key).cast("string").alias("id"), "target",
                                 vector_to_array("features").alias("x")),
                    "id", "target", "x",
                ).select("target", array_to_features("x"))
            )
        return Fold(train, balanced, folded.filter(F.col("fold") == fold))

    return _side_by_side(part, range(folds))


def fold_scores(name: str, parts: Sequence[Fold], c: float = 1.0, **settings) -> DataFrame:
    """Macro F1 of a model per fold as (model, fold, f1_macro); text models learn from the rows as they are."""

    def score(numbered: tuple[int, Fold]) -> DataFrame:
        number, part = numbered
        model = fit(name, part.train if name == TFIDF_LR else part.balanced, c=c, **settings)
        return macro_metrics(model.transform(part.held), "target", "prediction", digits=6).select(
            F.lit(name).alias("model"), F.lit(number).alias("fold"), "f1_macro"
        )

    return reduce(DataFrame.unionByName, _side_by_side(score, list(enumerate(parts))))


def cross_validate(
    rows: DataFrame,
    name: str,
    key: str,
    folds: int = 5,
    oversample: str = "inside",
    c: float = 1.0,
    **settings,
) -> DataFrame:
    """Macro F1 per fold as (model, fold, f1_macro); see folds_of."""
    return fold_scores(name, folds_of(rows, key, folds, oversample), c, **settings)


def cross_validate_models(
    data: Prepared, names: Sequence[str] = MODELS, key: str = "topic_id", folds: int = 5
) -> DataFrame:
    """(model, cv_f1_macro_mean, cv_f1_macro_std) on the training rows, the majority baseline left out.

    All models see the same folds, and none of them rows made from its held-out ones.
    """
    parts = folds_of(data.train, key, folds)
    scores = [fold_scores(name, parts) for name in names if name != MAJORITY]
    return cv_summary(reduce(DataFrame.unionByName, scores))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and (population) standard deviation over the folds."""
    return scores.groupBy("model").agg(
        F.round(F.avg("f1_macro"), 3).alias("cv_f1_macro_mean"),
        F.round(F.stddev_pop("f1_macro"), 3).alias("cv_f1_macro_std"),
    )


def search(
    data: Prepared, name: str, key: str = "topic_id", folds: int = 5, grid: Sequence[Mapping] | None = None
) -> DataFrame:
    """Cross-validated F1 of a model for each of its settings, best first, of equals in the order of the grid.

    (place, settings as JSON, model, cv_f1_macro_mean, cv_f1_macro_std). Folds are filled up
    once and read by all settings.
    """
    grid = GRIDS[name] if grid is None else list(grid)
    parts = folds_of(data.train, key, folds)
    tried = [
        cv_summary(fold_scores(name, parts, **settings)).select(
            F.lit(i).alias("i"), F.lit(json.dumps(settings)).alias("settings"), "*"
        )
        for i, settings in enumerate(grid)
    ]
    # one row per setting
    order = Window.orderBy(F.col("cv_f1_macro_mean").desc(), "i")
    ranked = reduce(DataFrame.unionByName, tried).withColumn("place", F.row_number().over(order))
    return ranked.select("place", "settings", "model", "cv_f1_macro_mean", "cv_f1_macro_std").orderBy("place")


def grid_search(
    rows: DataFrame, name: str, key: str, penalties: Sequence[float] = (0.1, 1.0, 10.0), folds: int = 5
) -> DataFrame:
    """Cross-validated F1 of a linear model for each inverse penalty, over the same folds."""
    parts = folds_of(rows, key, folds, "none")
    tried = [cv_summary(fold_scores(name, parts, c)).select(F.lit(float(c)).alias("c"), "*") for c in penalties]
    return reduce(DataFrame.unionByName, tried)


# explanation -----------------------------------------------------------------


def linear_importance(model: PipelineModel | HingeModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution |w * (x - mean x)| per feature over the scored rows."""
    own = isinstance(model, HingeModel)
    scaled = model.transform(rows).select((F.col("scaled") if own else vector_to_array("scaled")).alias("x"))
    weights = [float(w) for w in (model if own else model.stages[-1]).coefficients]
    means = scaled.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(weights))]).head()
    values = scaled.agg(
        *[
            F.avg(F.abs(F.lit(w) * (F.col("x")[i] - F.lit(means[i])))).alias(features[i])
            for i, w in enumerate(weights)
        ]
    )
    return values.unpivot([], list(features), "feature", "mean_contribution").orderBy(
        F.col("mean_contribution").desc(), "feature"
    )


def tree_importance(
    spark: SparkSession, model, features: Sequence[str]
) -> DataFrame:
    """Impurity importance per feature of a forest or of boosted trees."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    ).orderBy(F.col("importance").desc(), "feature")


def tree_contributions(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature of a forest or of boosted trees over the scored rows."""
    leaves = contributions.boosted_leaves(model) if isinstance(model, Boosted) else contributions.forest_leaves(model, rows)
    return contributions.mean_contributions(rows, leaves, features)


# informational and emotional support -----------------------------------------


def typed_support(annotated: DataFrame) -> DataFrame:
    """Supportive replies whose type is informational or emotional."""
    kind = F.regexp_replace(F.lower("support_type"), r"^\s+|\s+\z", "")
    return (
        annotated.filter(F.col("label") == "SS")
        .withColumn("support_type", kind)
        .filter(F.col("support_type").isin("informational", "emotional"))
    )
