"""Repeatable random samples: rows are ordered by a seeded hash of their id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.config import SAMPLE_SIZE, SEED, USER_CAP
from agoralytics.functions.values import seeded_hash
from agoralytics.operators.threads import initial_posts, self_reply_flag
from agoralytics.session import broadcast_if_small

# Ids of a sample up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def _random_order(seed: int) -> list:
    return [seeded_hash("message_id", seed), F.col("message_id")]


def eligible_replies(structured: DataFrame) -> DataFrame:
    """Replies by somebody else than the thread's opener, with a known poster."""
    return (
        self_reply_flag(structured)
        .filter(~F.col("is_initial_post") & ~F.col("is_self_reply"))
        .filter(F.col("poster_id").isNotNull())
        .drop("is_self_reply")
    )


def cap_per_user(replies: DataFrame, cap: int = USER_CAP, seed: int = SEED) -> DataFrame:
    """At most `cap` random replies per user.

    The rank limit is applied before the shuffle as well as after it, so a user
    with a third of the table sends at most `cap` rows per input task.
    """
    window = Window.partitionBy("poster_id").orderBy(*_random_order(seed))
    return (
        replies.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= cap)
        .drop("_rank")
    )


def one_per_thread(replies: DataFrame, seed: int = SEED) -> DataFrame:
    window = Window.partitionBy("topic_id").orderBy(*_random_order(seed))
    return (
        replies.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def annotation_sample(
    structured: DataFrame,
    size: int = SAMPLE_SIZE,
    cap: int = USER_CAP,
    seed: int = SEED,
) -> DataFrame:
    """Replies to label by hand, with blank label columns.

    Self-replies out, at most `cap` per user, one per thread, then `size` of them
    (all of them if there are fewer). Only ids go through the shuffles; the texts
    are fetched for the drawn ids, of which there are at most `size`.
    """
    ids = structured.select(
        "message_id", "topic_id", "poster_id", "first_poster_id", "is_initial_post"
    )
    pool = one_per_thread(cap_per_user(eligible_replies(ids), cap, seed), seed)
    drawn = pool.orderBy(*_random_order(seed)).limit(size).select("message_id")
    return (
        structured.join(broadcast_if_small(drawn, BROADCAST_IDS), "message_id", "left_semi")
        .select("message_id", "topic_id", "text_normalized", "post_date", "reply_index")
        .withColumn("label", F.lit(""))
        .withColumn("support_type", F.lit(""))
    )


def with_context(sample: DataFrame, structured: DataFrame) -> DataFrame:
    """The sample with the text of each thread's first post."""
    first = initial_posts(structured).select(
        "topic_id", F.col("message_text").alias("initial_post_text")
    )
    return sample.join(first, "topic_id", "left")
