"""Registered queries: report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoralytics.catalog.base import Stages, oracle, words_sql
from agoralytics.catalog.relational import TERMS, _EDGE
from agoralytics.functions import text as tx
from agoralytics.operators import labels, reports, threads
from agoralytics.operators.models import typed_support


def corpus_summary(spark, folder):
    return reports.corpus_summary(Stages(spark, folder).structured)


def thread_reply_split(spark, folder):
    return reports.thread_reply_split(Stages(spark, folder).structured)


def stage_audit(spark, folder):
    s = Stages(spark, folder)
    return reports.stage_audit(
        {"loaded": s.forum.messages, "without superusers": s.kept,
         "without moderators": s.unmoderated, "without off-topic groups": s.themed}
    )


def messages_per_month(spark, folder):
    return reports.messages_per_month(Stages(spark, folder).table("orders"), "o_orderdate")


def label_distribution(spark, folder):
    return reports.value_shares(Stages(spark, folder).annotated, "label")


def support_type_distribution(spark, folder):
    a = Stages(spark, folder).annotated
    return reports.value_shares(a.filter(F.col("label") == "SS"), "support_type")


def thread_label_distribution(spark, folder):
    return reports.value_shares(Stages(spark, folder).thread_labels, "thread_label")


def class_imbalance(spark, folder):
    return labels.class_imbalance(Stages(spark, folder).annotated)


def cohens_kappa(spark, folder):
    first = Stages(spark, folder).annotated
    flipped = F.when(F.col("label") == "SS", "NSS").otherwise("SS")
    second = first.withColumn(
        "label", F.when(F.col("message_id") % 7 == 0, flipped).otherwise(F.col("label"))
    )
    return labels.cohens_kappa(first, second)


def reply_count_stats(spark, folder):
    return reports.reply_count_stats(Stages(spark, folder).structured)


def user_activity(spark, folder):
    return reports.user_activity(Stages(spark, folder).table("orders"), "o_custkey")


def activity_levels(spark, folder):
    return reports.activity_levels(user_activity(spark, folder))


def messages_per_user(spark, folder):
    return reports.describe(reports.eligible_counts(Stages(spark, folder).structured), "n", digits=4)


def wordcount_by_label(spark, folder):
    return reports.wordcount_by(Stages(spark, folder).annotated_text, "label")


def subtype_wordcount(spark, folder):
    typed = typed_support(Stages(spark, folder).annotated_text)
    return reports.wordcount_by(typed, "support_type")


def moderator_candidates(spark, folder):
    s = Stages(spark, folder)
    return reports.moderator_candidates(s.with_text(s.grouped), TERMS)


def low_word_groups(spark, folder):
    s = Stages(spark, folder)
    return reports.low_word_groups(s.with_text(s.grouped), 200)


def length_quantiles(spark, folder):
    return reports.length_quantiles(Stages(spark, folder).normalized, short=20)


def user_concentration(spark, folder):
    counts = reports.eligible_counts(Stages(spark, folder).structured)
    return reports.user_concentration(counts, (5, 10, 60))


def cap_sensitivity(spark, folder):
    return reports.cap_sensitivity(reports.eligible_counts(Stages(spark, folder).structured))


def histogram_table(spark, folder):
    words = Stages(spark, folder).structured_text.select(
        "is_initial_post", tx.word_count("message_text").alias("word_count")
    )
    return reports.histogram_table(words, "word_count", 500, 40, ["is_initial_post"])


def reply_length_by_label(spark, folder):
    words = Stages(spark, folder).annotated_text.select(
        "label", tx.word_count("text_normalized").alias("word_count")
    )
    return reports.histogram_table(words, "word_count", 300, 30, ["label"])


def subtype_histogram(spark, folder):
    """Words of supportive replies by type of support."""
    typed = typed_support(Stages(spark, folder).annotated_text)
    words = typed.select("support_type", tx.word_count("text_normalized").alias("word_count"))
    return reports.histogram_table(words, "word_count", 300, 25, ["support_type"])


def user_activity_histogram(spark, folder):
    return reports.histogram_table(user_activity(spark, folder), "message_count", 100, 40)


def reply_count_histogram(spark, folder):
    counts = (
        threads.replies(Stages(spark, folder).structured)
        .groupBy("topic_id")
        .agg(F.count("*").alias("replies"))
    )
    return reports.histogram_table(counts, "replies", 30, 30)


def _shares(column: str, source: str) -> str:
    return (
        f"SELECT {column}, count(*) AS messages, "
        f"round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent "
        f"FROM {source} GROUP BY {column}"
    )


def _describe(value: str, source: str, by: str = "", digits: int = 1) -> str:
    stats = {
        "mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})::DOUBLE",
        "p25": f"quantile_cont({value}, 0.25)", "p50": f"quantile_cont({value}, 0.5)",
        "p75": f"quantile_cont({value}, 0.75)", "max": f"max({value})::DOUBLE",
    }
    columns = ", ".join(f"round({v}, {digits}) AS {k}" for k, v in stats.items())
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {by + ', ' if by else ''}count(*) AS count, {columns} FROM {source}{group}"


def _histogram(value: str, source: str, cap: int, bins: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
        SELECT {key}bin, round(any_value(a + bin * w), 4) AS bin_start, count(*) AS frequency
        FROM (SELECT {key}a, w, least(floor((v - a) / w), {bins - 1})::BIGINT AS bin
              FROM (SELECT {key}v, lo::DOUBLE AS a, (hi - lo) / {bins}::DOUBLE AS w
                    FROM (SELECT {key}v, min(v) OVER ({part}) AS lo, max(v) OVER ({part}) AS hi
                          FROM (SELECT {key}least({value}, {cap}) AS v FROM {source}))))
        GROUP BY {key}bin"""


_LEVELS = """
    SELECT o_custkey, CASE WHEN message_count = 1 THEN 'one-time' WHEN message_count <= 5 THEN 'low'
                           WHEN message_count <= 20 THEN 'medium' ELSE 'high' END AS activity_level,
           message_count
    FROM (SELECT o_custkey, count(*) AS message_count FROM orders GROUP BY o_custkey)"""
_WORDS = f"SELECT *, {words_sql('message_text')} AS word_count FROM structured"
_REPLY_WORDS = f"SELECT *, {words_sql('text_normalized')} AS word_count FROM annotated_text"
_REPLIES = """
    SELECT topic_id, count(*) AS replies FROM structured
    WHERE NOT is_initial_post GROUP BY topic_id"""

QUERIES = {
    f.__name__: f
    for f in (
        corpus_summary, thread_reply_split, stage_audit, messages_per_month,
        label_distribution, support_type_distribution, thread_label_distribution,
        class_imbalance, cohens_kappa, reply_count_stats, user_activity, activity_levels,
        messages_per_user, wordcount_by_label, subtype_wordcount, moderator_candidates,
        low_word_groups, length_quantiles, user_concentration, cap_sensitivity,
        histogram_table, reply_length_by_label, subtype_histogram, user_activity_histogram,
        reply_count_histogram,
    )
}

ORACLES = {
    "corpus_summary": oracle("""
        SELECT 'Total messages' AS metric, count(*) AS value FROM structured
        UNION ALL SELECT 'Initial posts', count(*) FROM structured WHERE is_initial_post
        UNION ALL SELECT 'Replies', count(*) FROM structured WHERE NOT is_initial_post
        UNION ALL SELECT 'Unique users', count(DISTINCT poster_id) FROM structured
        UNION ALL SELECT 'Unique threads', count(DISTINCT topic_id) FROM structured
        UNION ALL SELECT 'Threads with replies', count(*) FROM structured
                  WHERE is_initial_post AND thread_has_replies
        UNION ALL SELECT 'Threads without replies', count(*) FROM structured
                  WHERE is_initial_post AND NOT thread_has_replies"""),
    "thread_reply_split": oracle("""
        SELECT count(*) FILTER (n > 1) AS threads_with_replies,
               count(*) FILTER (n = 1) AS threads_without_replies
        FROM (SELECT topic_id, count(*) AS n FROM structured GROUP BY topic_id)"""),
    "stage_audit": oracle(
        " UNION ALL ".join(
            f"SELECT '{name}' AS stage, count(*) AS messages, count(DISTINCT topic_id) AS threads, "
            f"count(DISTINCT poster_id) AS users FROM {table}"
            for name, table in (
                ("loaded", "posts"), ("without superusers", "kept"),
                ("without moderators", "unmoderated"), ("without off-topic groups", "themed"),
            )
        )
    ),
    "messages_per_month": """
        WITH counts AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n
                        FROM orders GROUP BY 1),
        calendar AS (SELECT unnest(range(min(month)::TIMESTAMP, max(month)::TIMESTAMP + INTERVAL 1 MONTH,
                                         INTERVAL 1 MONTH))::DATE AS month FROM counts)
        SELECT month, coalesce(n, 0) AS messages FROM calendar LEFT JOIN counts USING (month)""",
    "label_distribution": oracle(_shares("label", "annotated")),
    "support_type_distribution": oracle(
        _shares("support_type", "(SELECT * FROM annotated WHERE label = 'SS')")
    ),
    "thread_label_distribution": oracle(_shares("thread_label", "thread_labels")),
    "class_imbalance": oracle("""
        SELECT majority, minority, round(majority / minority, 2) AS ratio,
               majority / minority > 3 AS imbalanced
        FROM (SELECT max(n) AS majority, min(n) AS minority, count(*) AS c
              FROM (SELECT count(*) AS n FROM annotated GROUP BY label)) WHERE c = 2"""),
    "cohens_kappa": oracle(
        """
        SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected,
               round((po - pe) / (1 - pe), 6) AS kappa
        FROM (SELECT n, same / n AS po, (a1 * b1 + a0 * b0) / (n * n) AS pe
              FROM (SELECT count(*) AS n, count(*) FILTER (a = b) AS same,
                           count(*) FILTER (a = 'SS')::DOUBLE AS a1,
                           count(*) FILTER (b = 'SS')::DOUBLE AS b1,
                           count(*) FILTER (a <> 'SS')::DOUBLE AS a0,
                           count(*) FILTER (b <> 'SS')::DOUBLE AS b0 FROM raters))""",
        raters="""
            SELECT label AS a, CASE WHEN message_id % 7 <> 0 THEN label
                                    WHEN label = 'SS' THEN 'NSS' ELSE 'SS' END AS b
            FROM annotated""",
    ),
    "reply_count_stats": oracle(
        """SELECT count(*) AS threads_with_replies, median(replies) AS median_replies,
                  round(avg(replies), 1) AS mean_replies, max(replies) AS max_replies
           FROM thread_replies""",
        thread_replies=_REPLIES,
    ),
    "user_activity": _LEVELS,
    "activity_levels": f"""
        SELECT activity_level, count(*) AS users, sum(message_count)::BIGINT AS messages
        FROM ({_LEVELS}) GROUP BY activity_level""",
    "messages_per_user": oracle(_describe("n", "per_user", digits=4)),
    "wordcount_by_label": oracle(
        _describe("word_count", "reply_words", "label"), reply_words=_REPLY_WORDS
    ),
    "subtype_wordcount": oracle(
        _describe(
            "word_count",
            "(SELECT * FROM reply_words WHERE support_type IN ('informational', 'emotional'))",
            "support_type",
        ),
        reply_words=_REPLY_WORDS,
    ),
    "moderator_candidates": oracle(
        """
        SELECT poster_id, total_posts, mod_term_mentions, groups_posted_in,
               sample_mod_message, '' AS is_moderator
        FROM (SELECT poster_id, count(*) AS total_posts, count(*) FILTER (hit) AS mod_term_mentions,
                     first(substr(message_text, 1, 300) ORDER BY post_date, message_id)
                         FILTER (hit) AS sample_mod_message
              FROM flagged GROUP BY poster_id)
        JOIN (SELECT poster_id, string_agg(group_name, ', ' ORDER BY rn) AS groups_posted_in
              FROM (SELECT poster_id, group_name, row_number() OVER (
                        PARTITION BY poster_id ORDER BY first_at, first_id) AS rn
                    FROM (SELECT poster_id, group_name, min(post_date) AS first_at,
                                 arg_min(message_id, (post_date, message_id)) AS first_id
                          FROM flagged GROUP BY poster_id, group_name))
              WHERE rn <= 5 GROUP BY poster_id) USING (poster_id)
        WHERE mod_term_mentions > 0""",
        flagged=f"""
            SELECT *, regexp_matches(lower(message_text),
                '(^|{_EDGE})({'|'.join(TERMS)})($|{_EDGE})') AS hit FROM grouped""",
    ),
    "low_word_groups": oracle(f"""
        SELECT group_name, median({words_sql('message_text')})::DOUBLE AS median_word_count
        FROM grouped GROUP BY group_name
        HAVING median({words_sql('message_text')}) <= 200"""),
    "length_quantiles": oracle(
        "SELECT CASE WHEN is_initial_post THEN 'initial' ELSE 'reply' END AS role, "
        + ", ".join(
            f"round(quantile_cont(w, {q}), 4) AS p{int(q * 100):02d}"
            for q in (0.05, 0.25, 0.5, 0.75, 0.95)
        )
        + ", count(*) FILTER (w < 20) AS short_messages FROM (SELECT is_initial_post, "
        + words_sql("text_normalized")
        + " AS w FROM normalized) GROUP BY 1"
    ),
    "user_concentration": oracle(
        " UNION ALL ".join(
            f"SELECT {k}::BIGINT AS more_than, count(*) FILTER (n > {k}) AS users, "
            f"round(coalesce(sum(n) FILTER (n > {k}), 0) * 100 / sum(n), 1) AS percent_of_messages "
            "FROM per_user"
            for k in (5, 10, 60)
        )
    ),
    "cap_sensitivity": oracle(
        " UNION ALL ".join(
            f"SELECT {k}::BIGINT AS cap, sum(least(n, {k}))::BIGINT AS pool, "
            f"count(*) FILTER (n > {k}) AS users_affected, count(*) AS unique_users FROM per_user"
            for k in (1, 2, 3, 5, 10)
        )
    ),
    "histogram_table": oracle(
        _histogram("word_count", "worded", 500, 40, "is_initial_post"), worded=_WORDS
    ),
    "reply_length_by_label": oracle(
        _histogram("word_count", "reply_words", 300, 30, "label"), reply_words=_REPLY_WORDS
    ),
    "subtype_histogram": oracle(
        _histogram(
            "word_count",
            "(SELECT * FROM reply_words WHERE support_type IN ('informational', 'emotional'))",
            300,
            25,
            "support_type",
        ),
        reply_words=_REPLY_WORDS,
    ),
    "user_activity_histogram": _histogram("message_count", f"({_LEVELS})", 100, 40),
    "reply_count_histogram": oracle(
        _histogram("replies", "thread_replies", 30, 30), thread_replies=_REPLIES
    ),
}
