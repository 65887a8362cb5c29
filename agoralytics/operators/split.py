"""Split by user, class weights and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.config import HOT_ROWS, SEED
from agoralytics.functions.values import seeded_hash, seeded_unit
from agoralytics.operators.ordering import number_rows
from agoralytics.session import cut_lineage


def user_split(
    df: DataFrame,
    user: str = "poster_id",
    seed: int = SEED,
    train: float = 0.70,
    val: float = 0.15,
) -> DataFrame:
    """Adds split: all rows of a user land in the same part. Nothing is shuffled.

    Rows without a user belong to no part (NULL): nobody can tell that they don't
    share their user with another part.
    """
    at = seeded_unit(user, seed)
    return df.withColumn(
        "split",
        F.when(at < train, "train").when(at < train + val, "val").when(at.isNotNull(), "test"),
    )


def split_overlap(
    df: DataFrame, user: str = "poster_id", split: str = "split"
) -> DataFrame:
    """Users that two parts share, for each pair of parts."""
    in_part = df.groupBy(user).agg(
        *[
            F.bool_or(F.col(split) == part).alias(part)
            for part in ("train", "val", "test")
        ]
    )
    return in_part.agg(
        F.count_if(F.col("train") & F.col("val")).alias("train_val"),
        F.count_if(F.col("train") & F.col("test")).alias("train_test"),
        F.count_if(F.col("val") & F.col("test")).alias("val_test"),
    )


def class_weights(df: DataFrame, label: str = "thread_label") -> DataFrame:
    """Balanced weight n / (classes * n of the class), one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds the weight of the row's class, from the counts of the few classes."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn(name, weight)


def cv_folds(
    df: DataFrame,
    label: str = "thread_label",
    key: str = "topic_id",
    folds: int = 5,
    seed: int = SEED,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds fold (0 .. folds-1), with each label spread evenly over the folds.

    A label may hold most of the rows: the numbering spreads hot labels over many
    tasks.
    """
    order = [seeded_hash(key, seed), F.col(key).asc()]
    # Read twice: to look for hot labels, and to be numbered.
    numbered = number_rows(cut_lineage(df), [label], order, "_number", hot_rows)
    return numbered.withColumn("fold", (F.col("_number") % folds).cast("int")).drop("_number")
