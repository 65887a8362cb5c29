"""Labels of replies, threads and raters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.operators.metrics import confusion_counts
from agoralytics.operators.threads import initial_posts


def thread_labels(
    annotated: DataFrame, structured: DataFrame, unlabelled: str = "negative"
) -> DataFrame:
    """successful if any reply is SS.

    Threads without a labelled reply are 'unsuccessful' (unlabelled='negative')
    or left out (unlabelled='exclude').
    """
    rolled = (
        annotated.filter(F.col("label").isin("SS", "NSS"))
        .groupBy("topic_id")
        .agg(
            F.when(F.bool_or(F.col("label") == "SS"), "successful")
            .otherwise("unsuccessful")
            .alias("thread_label")
        )
    )
    threads = initial_posts(structured).select("topic_id")
    if unlabelled == "exclude":
        return threads.join(rolled, "topic_id")
    return threads.join(rolled, "topic_id", "left").withColumn(
        "thread_label", F.coalesce("thread_label", F.lit("unsuccessful"))
    )


def labelled_threads(structured: DataFrame, labels: DataFrame) -> DataFrame:
    """First posts of the labelled threads, with the label."""
    known = (
        labels.filter(F.col("thread_label").isNotNull())
        .groupBy("topic_id")
        .agg(F.min("thread_label").alias("thread_label"))
    )
    return initial_posts(structured).join(known, "topic_id")


def class_imbalance(df: DataFrame, label: str = "label", warn_above: float = 3.0) -> DataFrame:
    """Ratio of the larger to the smaller class; no row unless there are two."""
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .count()
        .agg(
            F.count("*").alias("classes"),
            F.max("count").alias("majority"),
            F.min("count").alias("minority"),
        )
        .filter("classes = 2")
        .select(
            "majority",
            "minority",
            F.round(F.col("majority") / F.col("minority"), 2).alias("ratio"),
            (F.col("majority") / F.col("minority") > warn_above).alias("imbalanced"),
        )
    )


def cohens_kappa(
    first: DataFrame, second: DataFrame, key: str = "message_id", label: str = "label"
) -> DataFrame:
    """Agreement of two raters over the items both labelled."""
    pairs = first.select(key, F.col(label).alias("y_true")).join(
        second.select(key, F.col(label).alias("y_pred")), key
    )
    cells = confusion_counts(pairs)
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.expr("if(y_true = y_pred, n, 0)")).alias("same"))
    chance = (
        cells.select(F.col("y_true").alias("c"), F.col("n").alias("a"), F.lit(0).alias("b"))
        .unionByName(
            cells.select(F.col("y_pred").alias("c"), F.lit(0).alias("a"), F.col("n").alias("b"))
        )
        .groupBy("c")
        .agg((F.sum("a") * F.sum("b")).cast("double").alias("product"))
        .agg(F.sum("product").alias("products"))
    )
    n = total.select("n").scalar()
    expected = chance.scalar() / (n * n)
    observed = F.col("same") / F.col("n")
    return total.select(
        "n",
        F.round(observed, 6).alias("observed"),
        F.round(expected, 6).alias("expected"),
        F.round((observed - expected) / (1 - expected), 6).alias("kappa"),
    )
