"""Filters on messages and threads."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.config import (
    INTRO_GROUP_KEYWORDS,
    MIN_WORDS,
    MIN_WORDS_INITIAL,
    MODERATOR_TERMS,
    SHORT_MESSAGE_WORDS,
)
from agoralytics.functions import text as tx
from agoralytics.functions.values import date_rank
from agoralytics.operators.mapping import remove_posters


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Blank text becomes NULL; rows without any value go."""
    kinds = dict(df.dtypes)
    blanked = df.select(
        *[
            tx.blank_to_null(c).alias(c) if kinds[c] == "string" else F.col(c)
            for c in df.columns
        ]
    )
    return blanked.dropna(how="all")


def min_word_filter(
    df: DataFrame, column: str = "message_text", min_words: int = MIN_WORDS
) -> DataFrame:
    return df.filter(tx.word_count(column) >= min_words)


def detect_language(
    df: DataFrame,
    column: str,
    stop_words: Mapping[str, Sequence[str]],
    name: str = "language",
) -> DataFrame:
    """Language with most stop words in the text; 'unknown' without any.

    One expression per language over the row's own words: nothing is shuffled.
    Of languages with equal votes the first in alphabetical order wins.
    """
    tokens = F.regexp_extract_all(
        F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(rf"[{tx.WORD}]+"), F.lit(0)
    )
    def votes(lang: str) -> Column:
        known = sorted(stop_words[lang])
        return F.size(F.filter("_tokens", lambda t: t.isin(*known)))

    ballots = [
        F.struct(
            votes(lang).alias("votes"), F.lit(-rank).alias("rank"), F.lit(lang).alias("language")
        )
        for rank, lang in enumerate(sorted(stop_words))
    ]
    return (
        df.withColumn("_tokens", tokens)
        .withColumn("_best", F.array_max(F.array(*ballots)))
        .withColumn(
            name,
            F.when(F.col("_best.votes") > 0, F.col("_best.language")).otherwise("unknown"),
        )
        .drop("_tokens", "_best")
    )


def language_filter(
    df: DataFrame,
    column: str,
    stop_words: Mapping[str, Sequence[str]],
    target: str,
) -> DataFrame:
    return (
        detect_language(df, column, stop_words, "_language")
        .filter(F.col("_language") == target)
        .drop("_language")
    )


def term_search(
    messages: DataFrame,
    terms: Iterable[str] = MODERATOR_TERMS,
    column: str = "message_text",
) -> DataFrame:
    """Messages with any of the terms as a whole word, in any case."""
    return messages.filter(F.col(column).rlike(tx.whole_term_pattern(terms)))


def first_posters(messages: DataFrame) -> DataFrame:
    """Poster of each thread's first message; pre-aggregated before the shuffle."""
    return messages.groupBy("topic_id").agg(
        F.min_by("poster_id", date_rank()).alias("first_poster_id")
    )


def remove_moderators(messages: DataFrame, moderators: DataFrame) -> DataFrame:
    """Without threads opened by a moderator and without moderators' messages."""
    ids = moderators.select(F.col("poster_id").alias("first_poster_id")).distinct()
    threads = first_posters(messages).join(ids, "first_poster_id", "left_semi")
    kept = messages.join(threads.select("topic_id"), "topic_id", "left_anti")
    return remove_posters(kept, moderators)


def filter_intro_groups(
    messages: DataFrame, keywords: Iterable[str] = INTRO_GROUP_KEYWORDS
) -> DataFrame:
    """Drop a thread if the group name of any of its rows has a keyword."""
    name = F.lower(F.coalesce("group_name", F.lit("")))
    found = F.lit(False)
    for word in keywords:
        found = found | name.contains(word)
    threads = messages.filter(found).select("topic_id").distinct()
    return messages.join(threads, "topic_id", "left_anti")


def short_threads(
    structured: DataFrame,
    column: str = "text_normalized",
    min_words: int = MIN_WORDS_INITIAL,
) -> DataFrame:
    """(topic_id) of the threads whose first post has fewer than `min_words` words."""
    return structured.filter(
        F.col("is_initial_post") & (tx.word_count(column) < min_words)
    ).select("topic_id")


def filter_short_threads(
    structured: DataFrame,
    column: str = "text_normalized",
    min_words: int = MIN_WORDS_INITIAL,
) -> DataFrame:
    """Drop whole threads whose first post has fewer than `min_words` words."""
    return structured.join(short_threads(structured, column, min_words), "topic_id", "left_anti")


def short_messages(
    structured: DataFrame,
    initial: bool,
    column: str = "message_text",
    limit: int | None = None,
    max_words: int = SHORT_MESSAGE_WORDS,
) -> DataFrame:
    """Listing of messages with fewer than `max_words` words, shortest first."""
    listing = (
        structured.filter(F.col("is_initial_post") == initial)
        .withColumn("word_count", tx.word_count(column))
        .filter(F.col("word_count") < max_words)
        .select("topic_id", "message_id", column, "word_count")
        .orderBy("word_count", "message_id")
    )
    return listing if limit is None else listing.limit(limit)
