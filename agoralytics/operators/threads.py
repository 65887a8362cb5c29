"""Thread structure: who opened a thread, in which order the replies came."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.config import HOT_ROWS
from agoralytics.functions import text as tx
from agoralytics.functions.values import by_date, date_rank
from agoralytics.operators.ordering import hot_keys, join_hot, number_rows
from agoralytics.session import cut_lineage


def thread_structure(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds reply_index (0 for the first post), is_initial_post, reply_count,
    thread_has_replies and first_poster_id.

    Ordinary threads take one shuffle for all five columns. Hot threads are
    numbered over range partitions, and their totals come from a pre-aggregated
    table of one row per hot thread.
    """
    thread = Window.partitionBy("topic_id")
    in_order = thread.orderBy(*by_date())
    from_start = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def by_window(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("reply_index", (F.row_number().over(in_order) - 1).cast("long"))
            .withColumn("first_poster_id", F.first("poster_id").over(from_start))
            .withColumn("reply_count", F.count("*").over(thread) - 1)
        )

    hot = hot_keys(messages, ["topic_id"], hot_rows)
    if hot.isEmpty():
        rows = by_window(messages)
    else:
        hot = cut_lineage(hot)
        hot_messages = join_hot(messages, hot, ["topic_id"], "left_semi")
        totals = hot_messages.groupBy("topic_id").agg(
            F.min_by("poster_id", date_rank()).alias("first_poster_id"),
            (F.count("*") - 1).alias("reply_count"),
        )
        numbered = number_rows(
            hot_messages, ["topic_id"], by_date(), "reply_index", hot_rows
        )
        rows = by_window(join_hot(messages, hot, ["topic_id"], "left_anti")).unionByName(
            join_hot(numbered, totals, ["topic_id"], "inner")
        )
    return rows.withColumn("is_initial_post", F.col("reply_index") == 0).withColumn(
        "thread_has_replies", F.col("reply_count") > 0
    )


def self_reply_flag(structured: DataFrame) -> DataFrame:
    """is_self_reply: a reply by the poster who opened the thread."""
    return structured.withColumn(
        "is_self_reply",
        ~F.col("is_initial_post")
        & F.coalesce(F.col("poster_id") == F.col("first_poster_id"), F.lit(False)),
    )


def normalize_messages(
    messages: DataFrame, column: str = "message_text", name: str = "text_normalized"
) -> DataFrame:
    return messages.withColumn(name, tx.normalize(column))


def initial_posts(structured: DataFrame) -> DataFrame:
    return structured.filter("is_initial_post")


def replies(structured: DataFrame) -> DataFrame:
    return structured.filter("not is_initial_post")
