"""Topic, group and account maps, and the joins that use them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.config import COMMUNITY_ACCOUNTS, SUPERUSER_ACCOUNTS


def topic_account_map(topics: DataFrame, groups: DataFrame) -> DataFrame:
    """One account per topic, from the lowest group id that has an account."""
    accounts = (
        groups.filter(F.col("account_id").isNotNull())
        .groupBy("group_id")
        .agg(F.min("account_id").alias("account_id"))
    )
    return (
        topics.select("topic_id", "group_id")
        .join(accounts, "group_id")
        .groupBy("topic_id")
        .agg(F.min_by("account_id", "group_id").alias("account_id"))
    )


def topic_group_map(topics: DataFrame, groups: DataFrame) -> DataFrame:
    """One group name per topic ('' if unknown), from the lowest group id."""
    names = groups.groupBy("group_id").agg(F.min("group_name").alias("group_name"))
    return (
        topics.filter(F.col("topic_id").isNotNull())
        .select("topic_id", "group_id")
        .join(names, "group_id", "left")
        .groupBy("topic_id")
        .agg(
            F.min_by(
                F.coalesce("group_name", F.lit("")),
                F.struct(F.col("group_id").isNull(), "group_id"),
            ).alias("group_name")
        )
    )


def attach_group(messages: DataFrame, group_map: DataFrame) -> DataFrame:
    return messages.join(group_map, "topic_id", "left").withColumn(
        "group_name", F.coalesce("group_name", F.lit(""))
    )


def community_filter(
    messages: DataFrame,
    account_map: DataFrame,
    accounts: Sequence[int] = COMMUNITY_ACCOUNTS,
) -> DataFrame:
    """Messages of topics that belong to the community accounts."""
    topics = account_map.filter(F.col("account_id").isin(*accounts)).select("topic_id")
    return messages.join(topics, "topic_id", "left_semi")


def superuser_ids(
    messages: DataFrame,
    account_map: DataFrame,
    accounts: Sequence[int] = SUPERUSER_ACCOUNTS,
) -> DataFrame:
    """Posters who ever wrote in a test or demo account."""
    topics = account_map.filter(F.col("account_id").isin(*accounts)).select("topic_id")
    return (
        messages.select("topic_id", "poster_id")
        .filter(F.col("poster_id").isNotNull())
        .join(topics, "topic_id", "left_semi")
        .select("poster_id")
        .distinct()
    )


def remove_posters(messages: DataFrame, posters: DataFrame) -> DataFrame:
    """Messages of all other posters; those without a poster stay."""
    return messages.join(posters.select("poster_id"), "poster_id", "left_anti")
