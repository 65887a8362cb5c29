"""Numbering of rows inside a key that may hold a third of the table.

A window sorts all rows of one key in one task. That is right for ordinary keys.
Rows of hot keys are range-partitioned by the order columns, so that one key
spreads over many tasks; the position inside the whole order, less that of the
key's first row, is the number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.config import HOT_ROWS
from agoralytics.session import cut_lineage


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows: at most rows / hot_rows of them."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(*keys)
    )


def join_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Joins a table of one row per hot key; missing keys equal each other.

    Hot keys are few by their definition, so their table is broadcast.
    """
    renamed = hot.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_hot_{key}"))
    return df.join(F.broadcast(renamed), condition, how).drop(*[f"_hot_{k}" for k in keys])


def position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based position of each row in the order of the whole table.

    The range-partitioned rows are cut from their lineage, so partition numbers
    stay what they were when an executor is lost. The table of partition sizes
    has one row per partition and is what gets broadcast.
    """
    rows = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    part = F.shiftright("_row", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_start", "_row")
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based number of each row inside its key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    number = (F.row_number().over(window) - 1).cast("long")
    hot = hot_keys(df, keys, hot_rows)
    if hot.isEmpty():
        return df.withColumn(name, number)

    hot = cut_lineage(hot)
    columns = df.columns
    cold_rows = join_hot(df, hot, keys, "left_anti").withColumn(name, number)
    placed = position(
        join_hot(df, hot, keys, "left_semi"),
        [F.col(k).asc() for k in keys] + list(order),
        "_position",
    )
    firsts = placed.groupBy(*keys).agg(F.min("_position").alias("_first"))
    numbered = join_hot(placed, firsts, keys, "inner").select(
        *columns, (F.col("_position") - F.col("_first")).alias(name)
    )
    return cold_rows.unionByName(numbered)
