"""Report tables on the corpus, its users and its texts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.config import CAPS, MODERATOR_TERMS, SHORT_MESSAGE_WORDS
from agoralytics.functions import text as tx
from agoralytics.functions.values import date_rank
from agoralytics.operators.threads import self_reply_flag
from agoralytics.session import cut_lineage


def _metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One aggregation, shown as rows (metric, value)."""
    row = df.agg(*[c.cast("long").alias(name) for name, c in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def corpus_summary(structured: DataFrame) -> DataFrame:
    """Totals from one row per poster; each thread has one first post."""
    first = F.col("is_initial_post")
    answered = F.col("thread_has_replies")
    posters = structured.groupBy("poster_id").agg(
        F.count("*").alias("n"),
        F.count_if(first).alias("firsts"),
        F.count_if(~first).alias("replies"),
        F.count_if(first & F.col("topic_id").isNotNull()).alias("threads"),
        F.count_if(first & answered).alias("answered"),
        F.count_if(first & ~answered).alias("unanswered"),
    )
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return _metric_rows(
        posters,
        {
            "Total messages": total("n"),
            "Initial posts": total("firsts"),
            "Replies": total("replies"),
            "Unique users": F.count("poster_id"),
            "Unique threads": total("threads"),
            "Threads with replies": total("answered"),
            "Threads without replies": total("unanswered"),
        },
    )


def thread_reply_split(structured: DataFrame) -> DataFrame:
    return (
        structured.groupBy("topic_id")
        .agg(F.bool_or(~F.col("is_initial_post")).alias("answered"))
        .agg(
            F.count_if("answered").alias("threads_with_replies"),
            F.count_if(~F.col("answered")).alias("threads_without_replies"),
        )
    )


def stage_audit(stages: dict[str, DataFrame]) -> DataFrame:
    """Messages, threads and users of several stages of a flow."""
    audits = [
        df.agg(
            F.count("*").alias("messages"),
            F.count_distinct("topic_id").alias("threads"),
            F.count_distinct("poster_id").alias("users"),
        ).select(F.lit(name).alias("stage"), "messages", "threads", "users")
        for name, df in stages.items()
    ]
    out = audits[0]
    for audit in audits[1:]:
        out = out.unionByName(audit)
    return out


def messages_per_month(messages: DataFrame, date: str = "post_date") -> DataFrame:
    """Messages per month from the first to the last, months without any included."""
    counts = (
        messages.filter(F.col(date).isNotNull())
        .groupBy(F.date_trunc("month", date).cast("date").alias("month"))
        .agg(F.count("*").alias("messages"))
    )
    calendar = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")
    )
    return calendar.join(counts, "month", "left").select(
        "month", F.coalesce("messages", F.lit(0)).alias("messages")
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value; the window runs over the counts only."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("messages"))
    )
    total = F.sum("messages").over(Window.partitionBy())
    return counts.select(
        column, "messages", F.round(100 * F.col("messages") / total, 1).alias("percent")
    )


# distributions ---------------------------------------------------------------


def describe(df: DataFrame, value: str, by: Sequence[str] = (), digits: int = 1) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum.

    Values are counted first, so the exact quartiles work on distinct values.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    v, n = F.col(value), F.col("_n")
    total = F.sum(n)
    mean = F.sum(v * n) / total
    spread = F.sum(v.cast("double") * v * n) - F.sum(v * n).cast("double") * mean
    quartiles = F.percentile(value, [0.25, 0.5, 0.75], F.col("_n"))
    table = counts.groupBy(*by).agg(
        total.alias("count"),
        mean.alias("mean"),
        F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1))).alias("std"),
        F.min(value).cast("double").alias("min"),
        quartiles.alias("_q"),
        F.max(value).cast("double").alias("max"),
    )
    r = lambda c, name: F.round(c, digits).alias(name)
    return table.select(
        *by, "count", r(F.col("mean"), "mean"), r(F.col("std"), "std"), r(F.col("min"), "min"),
        r(F.col("_q")[0], "p25"), r(F.col("_q")[1], "p50"), r(F.col("_q")[2], "p75"),
        r(F.col("max"), "max"),
    )


def length_quantiles(
    structured: DataFrame,
    column: str = "text_normalized",
    short: int = SHORT_MESSAGE_WORDS,
) -> DataFrame:
    """Word-count percentiles of first posts and replies, and how many are short."""
    role = F.when(F.col("is_initial_post"), "initial").otherwise("reply")
    counts = (
        structured.select(role.alias("role"), tx.word_count(column).alias("wc"))
        .groupBy("role", "wc")
        .agg(F.count("*").alias("_n"))
    )
    q = counts.groupBy("role").agg(
        F.percentile("wc", [0.05, 0.25, 0.5, 0.75, 0.95], F.col("_n")).alias("_q"),
        F.coalesce(F.sum(F.when(F.col("wc") < short, F.col("_n"))), F.lit(0)).alias("short_messages"),
    )
    names = ("p05", "p25", "p50", "p75", "p95")
    return q.select(
        "role",
        *[F.round(F.col("_q")[i], 4).alias(name) for i, name in enumerate(names)],
        "short_messages",
    )


def histogram_table(
    df: DataFrame, value: str, cap: int, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width bins of min(value, cap) between the smallest and largest value.

    The last bin includes its upper edge; a single value falls in the middle bin
    of a range one wide, as plotting libraries do.
    """
    clipped = df.select(*by, F.least(F.col(value), F.lit(cap)).alias("v")).filter("v is not null")
    counts = clipped.groupBy(*by, "v").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    low, high = F.min("v").over(group), F.max("v").over(group)
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low.cast("double"))
    width = F.when(flat, 1.0 / bins).otherwise((high - low) / F.lit(float(bins)))
    binned = counts.withColumn("_start", start).withColumn("_width", width).withColumn(
        "bin",
        F.least(
            F.floor((F.col("v") - F.col("_start")) / F.col("_width")), F.lit(bins - 1)
        ).cast("long"),
    )
    return (
        binned.groupBy(*by, "bin")
        .agg(
            F.min(F.round(F.col("_start") + F.col("bin") * F.col("_width"), 4)).alias("bin_start"),
            F.sum("_n").alias("frequency"),
        )
    )


def wordcount_by(df: DataFrame, by: str, column: str = "text_normalized") -> DataFrame:
    return describe(
        df.select(by, tx.word_count(column).alias("word_count")), "word_count", [by]
    )


# users -----------------------------------------------------------------------


def user_activity(messages: DataFrame, user: str = "poster_id") -> DataFrame:
    """Messages per user and the activity level they stand for; in no order, `by_activity` gives one for a listing."""
    n = F.col("message_count")
    return (
        messages.filter(F.col(user).isNotNull())
        .groupBy(user)
        .agg(F.count("*").alias("message_count"))
        .select(
            user,
            F.when(n == 1, "one-time")
            .when(n <= 5, "low")
            .when(n <= 20, "medium")
            .otherwise("high")
            .alias("activity_level"),
            "message_count",
        )
    )


def by_activity(activity: DataFrame, user: str = "poster_id") -> DataFrame:
    """The most active users first; ties by id."""
    return activity.orderBy(F.col("message_count").desc(), user)


def activity_levels(activity: DataFrame) -> DataFrame:
    """Users and messages per activity level."""
    return activity.groupBy("activity_level").agg(
        F.count("*").alias("users"), F.sum("message_count").alias("messages")
    )


def reply_count_stats(structured: DataFrame) -> DataFrame:
    """Threads with replies, and median, mean and maximum of their replies."""
    return (
        structured.filter("not is_initial_post")
        .groupBy("topic_id")
        .agg(F.count("*").alias("replies"))
        .agg(
            F.count("*").alias("threads_with_replies"),
            F.median("replies").alias("median_replies"),
            F.round(F.avg("replies"), 1).alias("mean_replies"),
            F.max("replies").alias("max_replies"),
        )
    )


def eligible_counts(structured: DataFrame, include_initial: bool = True) -> DataFrame:
    """Messages per user without self-replies, as (poster_id, n)."""
    kept = self_reply_flag(structured).filter("not is_self_reply")
    if not include_initial:
        kept = kept.filter("not is_initial_post")
    return (
        kept.filter(F.col("poster_id").isNotNull())
        .groupBy("poster_id")
        .agg(F.count("*").alias("n"))
    )


def user_concentration(counts: DataFrame, limits: Sequence[int] = (5, 10)) -> DataFrame:
    """Users above each limit and their share of all messages."""
    rows = [
        F.struct(
            F.lit(limit).cast("long").alias("more_than"),
            F.count_if(F.col("n") > limit).alias("users"),
            F.round(
                F.coalesce(F.sum(F.when(F.col("n") > limit, F.col("n"))), F.lit(0))
                * 100 / F.sum("n"),
                1,
            ).alias("percent_of_messages"),
        )
        for limit in limits
    ]
    return counts.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def cap_sensitivity(counts: DataFrame, caps: Sequence[int] = CAPS) -> DataFrame:
    """Pool size, users affected and users kept under each per-user cap."""
    rows = [
        F.struct(
            F.lit(cap).cast("long").alias("cap"),
            F.sum(F.least(F.col("n"), F.lit(cap))).alias("pool"),
            F.count_if(F.col("n") > cap).alias("users_affected"),
            F.count("*").alias("unique_users"),
        )
        for cap in caps
    ]
    return counts.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def top_users(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "poster_id").limit(k)


def user_role_table(structured: DataFrame) -> DataFrame:
    """Threads started and replies given per user, and the role that follows."""
    started, given = F.col("threads_started"), F.col("replies_given")
    return (
        structured.filter(F.col("poster_id").isNotNull())
        .groupBy("poster_id")
        .agg(
            F.count_if("is_initial_post").alias("threads_started"),
            F.count_if(~F.col("is_initial_post")).alias("replies_given"),
        )
        .withColumn(
            "role",
            F.when(given == 0, "poster_only").when(started == 0, "replier_only").otherwise("both"),
        )
    )


def top_starters(roles: DataFrame, k: int = 15) -> DataFrame:
    return roles.orderBy(F.col("threads_started").desc(), "poster_id").limit(k)


def user_roles(structured: DataFrame) -> DataFrame:
    """Summary of starters and repliers, as (metric, value)."""
    roles = user_role_table(structured)
    totals = _metric_rows(
        structured,
        {"Total messages": F.count("*"), "Total threads": F.count_distinct("topic_id")},
    )
    role = F.col("role")
    return totals.unionByName(
        _metric_rows(
            roles,
            {
                "Total unique users": F.count("*"),
                "Unique initial posters": F.count_if(role != "replier_only"),
                "Unique repliers": F.count_if(role != "poster_only"),
                "Only posted": F.count_if(role == "poster_only"),
                "Only replied": F.count_if(role == "replier_only"),
                "Both": F.count_if(role == "both"),
            },
        )
    )


# moderators and groups -------------------------------------------------------


def moderator_candidates(
    messages: DataFrame,
    terms: Iterable[str] = MODERATOR_TERMS,
    groups: int = 5,
    sample_chars: int = 300,
) -> DataFrame:
    """Posters who use a moderator term: counts, first groups, first such text.

    Needs group_name. The first groups are those the poster wrote in first.
    """
    hit = F.coalesce(F.col("message_text").rlike(tx.whole_term_pattern(terms)), F.lit(False))
    known = messages.filter(F.col("poster_id").isNotNull())
    totals = (
        known.withColumn("_hit", hit)
        .groupBy("poster_id")
        .agg(
            F.count("*").alias("total_posts"),
            F.count_if("_hit").alias("mod_term_mentions"),
            F.min_by(
                F.when(F.col("_hit"), F.substring("message_text", 1, sample_chars)),
                F.when(F.col("_hit"), date_rank()),
            ).alias("sample_mod_message"),
        )
        .filter("mod_term_mentions > 0")
    )
    # Few posters use such a term; the texts are searched once.
    totals = cut_lineage(totals)
    writers = totals.select("poster_id")
    in_order = Window.partitionBy("poster_id").orderBy("_first", "group_name")
    first_groups = (
        known.join(writers, "poster_id", "left_semi")
        .groupBy("poster_id", "group_name")
        .agg(F.min(date_rank()).alias("_first"))
        .withColumn("_rank", F.row_number().over(in_order))
        .filter(F.col("_rank") <= groups)
        .groupBy("poster_id")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_rank", "group_name"))),
                    lambda g: g["group_name"],
                ),
                ", ",
            ).alias("groups_posted_in")
        )
    )
    return totals.join(first_groups, "poster_id").select(
        "poster_id",
        "total_posts",
        "mod_term_mentions",
        "groups_posted_in",
        "sample_mod_message",
        F.lit("").alias("is_moderator"),
    ).orderBy(F.desc("mod_term_mentions"), "poster_id")


def low_word_groups(messages: DataFrame, most: float = 4.0) -> DataFrame:
    """Groups whose median message has at most `most` words."""
    counts = (
        messages.select("group_name", tx.word_count("message_text").alias("wc"))
        .groupBy("group_name", "wc")
        .agg(F.count("*").alias("_n"))
    )
    return (
        counts.groupBy("group_name")
        .agg(F.percentile("wc", 0.5, F.col("_n")).alias("median_word_count"))
        .filter(F.col("median_word_count") <= most)
        .orderBy("median_word_count", "group_name")
    )
