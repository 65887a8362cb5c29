"""Classification metrics from one small table of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(
    df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., y_true, y_pred, n): all the other metrics start from this table."""
    return df.groupBy(
        *by, F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(
    df: DataFrame, labels: Sequence, truth: str = "y_true", predicted: str = "y_pred"
) -> DataFrame:
    """One row per true label and one column per predicted label, zeros included."""
    cells = [
        F.struct(
            F.lit(t).alias("y_true"),
            *[
                F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"pred_{p}")
                for p in labels
            ],
        )
        for t in labels
    ]
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def class_report(
    df: DataFrame,
    truth: str = "y_true",
    predicted: str = "y_pred",
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and support per label in truth or prediction.

    A division by zero gives 0.
    """
    counts = confusion_counts(df, truth, predicted, by)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = counts.select(
        *by, F.col("y_true").alias("class"), hit.alias("tp"), F.col("n").alias("support"),
        zero.alias("predicted"),
    ).unionByName(
        counts.select(
            *by, F.col("y_pred").alias("class"), zero.alias("tp"), zero.alias("support"),
            F.col("n").alias("predicted"),
        )
    )
    per_class = sides.groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, support, predicted_n = F.col("tp"), F.col("support"), F.col("predicted")
    return per_class.select(
        *by,
        "class",
        ratio(tp, predicted_n).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + predicted_n).alias("f1"),
        "support",
    )


def macro_metrics(
    df: DataFrame,
    truth: str = "y_true",
    predicted: str = "y_pred",
    by: Sequence[str] = (),
    digits: int = 3,
) -> DataFrame:
    """Plain means over the labels of precision, recall and F1."""
    report = class_report(df, truth, predicted, by)
    means = [
        F.round(F.avg(m), digits).alias(f"{m}_macro") for m in ("f1", "precision", "recall")
    ]
    return report.groupBy(*by).agg(*means, F.sum("support").alias("n"))


def subgroup_f1(
    predictions: DataFrame,
    user_activity: DataFrame,
    truth: str = "y_true",
    predicted: str = "y_pred",
    smallest: int = 5,
) -> DataFrame:
    """Macro F1 per activity level of the poster; groups below `smallest` left out."""
    levels = user_activity.select("poster_id", "activity_level")
    enriched = predictions.join(levels, "poster_id")
    return (
        macro_metrics(enriched, truth, predicted, ["activity_level"])
        .filter(F.col("n") >= smallest)
        .select("activity_level", "f1_macro", "n")
    )
