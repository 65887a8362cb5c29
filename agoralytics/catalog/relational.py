"""Registered queries: filters, joins, thread structure, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoralytics.catalog.base import SAMPLE, Stages, oracle, tokens_sql, words_sql
from agoralytics.functions import text as tx
from agoralytics.functions.values import id_number, parse_date
from agoralytics.operators import filters, labels, languages, mapping, reports, sampling, threads

# Stop words of the test documents' languages.
STOP_WORDS = {
    "de": ("der", "die", "und", "den", "das", "zu", "von", "nicht"),
    "en": ("the", "of", "and", "to", "is", "that", "with", "was"),
    "es": ("el", "los", "que", "y", "del", "las", "por", "con"),
    "fr": ("le", "les", "des", "et", "une", "avec", "dans", "qui"),
}
TERMS = ("with", "nicht", "avec")


def parse_dates(spark, folder):
    e = Stages(spark, folder).table("events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = (
        F.when(F.col("event_id") % 4 == 0, stamp)
        .when(F.col("event_id") % 4 == 1, F.substring(stamp, 1, 10))
        .when(F.col("event_id") % 4 == 2, F.lit("nonsense"))
    )
    return e.select("event_id", parse_date(raw).alias("post_date"))


def id_numbers(spark, folder):
    e = Stages(spark, folder).table("events")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".0")))
        .when(F.col("event_id") % 4 == 1, F.col("user_id").cast("string"))
        .when(F.col("event_id") % 4 == 2, F.lit("nan"))
        .otherwise("x")
    )
    return e.select("event_id", id_number(raw).alias("id"))


def drop_empty_rows(spark, folder):
    c = Stages(spark, folder).table("conversations")
    return filters.drop_empty_rows(
        c.select(
            F.when(F.col("turn") % 2 == 0, F.lit(" \t")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
        )
    )


def min_word_filter(spark, folder):
    s = Stages(spark, folder)
    rows = filters.min_word_filter(s.with_text(s.kept), "message_text", 60)
    return rows.select("message_id", tx.word_count("message_text").alias("words"))


def language_filter(spark, folder):
    d = Stages(spark, folder).table("documents")
    return filters.language_filter(d, "text", STOP_WORDS, "fr").select("doc_id", "lang")


def detect_language(spark, folder):
    d = Stages(spark, folder).table("documents")
    return filters.detect_language(d, "text", STOP_WORDS).select("doc_id", "language")


def language_profiles(spark, folder):
    return languages.language_profiles(Stages(spark, folder).table("documents"), "text", "lang")


def detect_language_by_profiles(spark, folder):
    d = Stages(spark, folder).table("documents")
    profiles = languages.language_profiles(d, "text", "lang")
    return languages.detect_by_profiles(d, "text", profiles).select("doc_id", "language")


def language_filter_by_profiles(spark, folder):
    d = Stages(spark, folder).table("documents")
    profiles = languages.language_profiles(d, "text", "lang")
    return languages.language_filter(d, "text", profiles, "fr").select("doc_id", "lang")


def community_filter(spark, folder):
    s = Stages(spark, folder)
    return mapping.community_filter(s.forum.messages, s.account_map).select("message_id", "topic_id")


def term_search(spark, folder):
    s = Stages(spark, folder)
    return filters.term_search(s.with_text(s.kept), TERMS).select("message_id", "poster_id")


def short_initial_posts(spark, folder):
    s = Stages(spark, folder).structured_text
    return filters.short_messages(s, True, max_words=20).select("message_id", "topic_id", "word_count")


def short_messages(spark, folder):
    s = Stages(spark, folder).structured_text
    return filters.short_messages(s, False, limit=30, max_words=20).select(
        "message_id", "topic_id", "word_count"
    )


def topic_account_map(spark, folder):
    return Stages(spark, folder).account_map


def topic_group_map(spark, folder):
    return Stages(spark, folder).group_map


def remove_superusers(spark, folder):
    return Stages(spark, folder).kept.select("message_id", "topic_id", "poster_id")


def remove_moderators(spark, folder):
    return Stages(spark, folder).unmoderated.select("message_id", "topic_id", "poster_id")


def attach_group(spark, folder):
    return Stages(spark, folder).grouped.select("message_id", "topic_id", "group_name")


def filter_intro_groups(spark, folder):
    return Stages(spark, folder).themed.select("message_id", "topic_id", "group_name")


def thread_structure(spark, folder):
    return Stages(spark, folder).structured.select(
        "message_id", "topic_id", "post_date", "reply_index", "is_initial_post"
    )


def thread_success(spark, folder):
    return Stages(spark, folder).structured.select(
        "message_id", "topic_id", "reply_count", "thread_has_replies"
    )


def filter_short_threads(spark, folder):
    return filters.filter_short_threads(Stages(spark, folder).normalized, min_words=40).select(
        "message_id", "topic_id"
    )


def self_reply_flag(spark, folder):
    return threads.self_reply_flag(Stages(spark, folder).structured).select(
        "message_id", "topic_id", "is_self_reply"
    )


def user_cap_sample(spark, folder):
    rows = sampling.eligible_replies(Stages(spark, folder).structured)
    return sampling.cap_per_user(rows).select("message_id", "poster_id")


def one_per_thread(spark, folder):
    rows = sampling.eligible_replies(Stages(spark, folder).structured)
    return sampling.one_per_thread(sampling.cap_per_user(rows)).select("message_id", "topic_id")


def annotation_sample(spark, folder):
    return sampling.annotation_sample(Stages(spark, folder).normalized, SAMPLE)


def sample_with_context(spark, folder):
    s = Stages(spark, folder).normalized
    return sampling.with_context(sampling.annotation_sample(s, SAMPLE), s)


def thread_labels(spark, folder):
    return Stages(spark, folder).thread_labels


def thread_labels_annotated_only(spark, folder):
    s = Stages(spark, folder)
    return labels.thread_labels(s.annotated, s.structured, "exclude")


def labelled_threads(spark, folder):
    return Stages(spark, folder).labelled.select("topic_id", "poster_id", "thread_label")


def user_role_table(spark, folder):
    return reports.user_role_table(Stages(spark, folder).structured)


def user_roles(spark, folder):
    return reports.user_roles(Stages(spark, folder).structured)


def top_users(spark, folder):
    return reports.top_users(reports.eligible_counts(Stages(spark, folder).structured))


def top_starters(spark, folder):
    return reports.top_starters(reports.user_role_table(Stages(spark, folder).structured))


_LANGUAGE = {
    "stop_words": " UNION ALL ".join(
        f"SELECT '{lang}' AS language, '{word}' AS word"
        for lang, group in STOP_WORDS.items()
        for word in group
    ),
    "votes": f"""
        SELECT doc_id, language, count(*) AS n
        FROM (SELECT doc_id, unnest({tokens_sql("lower(text)")}) AS word FROM documents)
        JOIN stop_words USING (word) GROUP BY doc_id, language""",
    "detected": """
        SELECT d.doc_id, d.lang, coalesce(v.language, 'unknown') AS language
        FROM documents d LEFT JOIN (
            SELECT * FROM votes QUALIFY row_number() OVER (
                PARTITION BY doc_id ORDER BY n DESC, language) = 1) v USING (doc_id)""",
}
_PROFILES = {
    "own_words": r"""
        SELECT doc_id, lang, word, count(*) AS n
        FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)
        GROUP BY doc_id, lang, word""",
    "own_grams": """
        SELECT doc_id, lang, gram, sum(n) AS n
        FROM (SELECT doc_id, lang, n, unnest([substr(' ' || word || ' ', i, 3) FOR i IN range(1, length(word) + 1)]) AS gram
              FROM own_words)
        GROUP BY doc_id, lang, gram""",
    "best_grams": f"""
        SELECT gram FROM own_grams WHERE lang IS NOT NULL GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {languages.KEPT}""",
    "gram_counts": """
        SELECT lang AS language, gram, sum(n) AS n FROM own_grams JOIN best_grams USING (gram)
        WHERE lang IS NOT NULL GROUP BY lang, gram""",
    "profiles": f"""
        SELECT t.language, b.gram, floor(1000 * ln((coalesce(c.n, 0) + 1)::DOUBLE / (t.total + {languages.KEPT})::DOUBLE))::BIGINT AS weight
        FROM best_grams b CROSS JOIN (SELECT language, sum(n) AS total FROM gram_counts GROUP BY language) t
        LEFT JOIN gram_counts c ON c.language = t.language AND c.gram = b.gram""",
    "guesses": """
        SELECT doc_id, p.language FROM own_grams g JOIN profiles p USING (gram) GROUP BY doc_id, p.language
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sum(g.n * p.weight) DESC, p.language) = 1""",
}
_EDGE = r"[^\p{L}\p{N}_]"
_ROLES = """
    SELECT *, CASE WHEN replies_given = 0 THEN 'poster_only'
                   WHEN threads_started = 0 THEN 'replier_only' ELSE 'both' END AS role
    FROM (SELECT poster_id,
                 count(*) FILTER (is_initial_post) AS threads_started,
                 count(*) FILTER (NOT is_initial_post) AS replies_given
          FROM structured WHERE poster_id IS NOT NULL GROUP BY poster_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        parse_dates, id_numbers, drop_empty_rows, min_word_filter, language_filter,
        detect_language, language_profiles, detect_language_by_profiles, language_filter_by_profiles, community_filter, term_search, short_initial_posts,
        short_messages, topic_account_map, topic_group_map, remove_superusers,
        remove_moderators, attach_group, filter_intro_groups, thread_structure,
        thread_success, filter_short_threads, self_reply_flag, user_cap_sample,
        one_per_thread, annotation_sample, sample_with_context, thread_labels,
        thread_labels_annotated_only, labelled_threads, user_role_table, user_roles,
        top_users, top_starters,
    )
}

ORACLES = {
    "parse_dates": """
        SELECT event_id, try_cast(CASE event_id % 4
            WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'nonsense' END AS TIMESTAMP)
            AS post_date FROM events""",
    "id_numbers": """
        SELECT event_id, CASE WHEN event_id % 4 < 2 THEN user_id END AS id FROM events""",
    "drop_empty_rows": """
        SELECT * FROM (
            SELECT CASE WHEN turn % 2 <> 0 THEN role END AS role,
                   CASE WHEN turn % 4 <> 0 AND trim(text) <> '' THEN text END AS text
            FROM conversations) WHERE role IS NOT NULL OR text IS NOT NULL""",
    "min_word_filter": oracle(
        f"SELECT message_id, {words_sql('message_text')} AS words FROM kept "
        f"WHERE {words_sql('message_text')} >= 60"
    ),
    "language_filter": oracle(
        "SELECT doc_id, lang FROM detected WHERE language = 'fr'", **_LANGUAGE
    ),
    "language_profiles": oracle("SELECT language, gram, weight FROM profiles", **_PROFILES),
    "detect_language_by_profiles": oracle(
        "SELECT doc_id, coalesce(g.language, 'unknown') AS language FROM documents LEFT JOIN guesses g USING (doc_id)", **_PROFILES
    ),
    "language_filter_by_profiles": oracle(
        "SELECT doc_id, lang FROM documents JOIN guesses g USING (doc_id) WHERE g.language = 'fr'", **_PROFILES
    ),
    "detect_language": oracle("SELECT doc_id, language FROM detected", **_LANGUAGE),
    "community_filter": oracle(
        "SELECT message_id, topic_id FROM posts JOIN account_map USING (topic_id) "
        "WHERE account_id IN (2, 3)"
    ),
    "term_search": oracle(
        "SELECT message_id, poster_id FROM kept WHERE regexp_matches(lower(message_text), "
        f"'(^|{_EDGE})({'|'.join(TERMS)})($|{_EDGE})')"
    ),
    "short_initial_posts": oracle(
        f"SELECT message_id, topic_id, {words_sql('message_text')} AS word_count "
        f"FROM structured WHERE is_initial_post AND {words_sql('message_text')} < 20"
    ),
    "short_messages": oracle(
        f"SELECT message_id, topic_id, {words_sql('message_text')} AS word_count "
        f"FROM structured WHERE NOT is_initial_post AND {words_sql('message_text')} < 20 "
        "ORDER BY word_count, message_id LIMIT 30"
    ),
    "topic_account_map": oracle("SELECT topic_id, account_id FROM account_map"),
    "topic_group_map": oracle("SELECT topic_id, group_name FROM group_map"),
    "remove_superusers": oracle("SELECT message_id, topic_id, poster_id FROM kept"),
    "remove_moderators": oracle("SELECT message_id, topic_id, poster_id FROM unmoderated"),
    "attach_group": oracle("SELECT message_id, topic_id, group_name FROM grouped"),
    "filter_intro_groups": oracle("SELECT message_id, topic_id, group_name FROM themed"),
    "thread_structure": oracle(
        "SELECT message_id, topic_id, post_date, reply_index, is_initial_post FROM structured"
    ),
    "thread_success": oracle(
        "SELECT message_id, topic_id, reply_count, thread_has_replies FROM structured"
    ),
    "filter_short_threads": oracle(
        "SELECT message_id, topic_id FROM normalized WHERE topic_id NOT IN (SELECT topic_id "
        f"FROM normalized WHERE is_initial_post AND {words_sql('text_normalized')} < 40)"
    ),
    "self_reply_flag": oracle(
        "SELECT message_id, topic_id, NOT is_initial_post AND "
        "coalesce(poster_id = first_poster_id, FALSE) AS is_self_reply FROM structured"
    ),
    "user_cap_sample": oracle("SELECT message_id, poster_id FROM capped"),
    "one_per_thread": oracle("SELECT message_id, topic_id FROM single"),
    "annotation_sample": oracle(
        "SELECT message_id, topic_id, text_normalized, post_date, reply_index, "
        "'' AS label, '' AS support_type FROM sample"
    ),
    "sample_with_context": oracle(
        "SELECT s.message_id, s.topic_id, s.text_normalized, s.post_date, s.reply_index, "
        "'' AS label, '' AS support_type, i.message_text AS initial_post_text "
        "FROM sample s LEFT JOIN structured i ON i.topic_id = s.topic_id AND i.is_initial_post"
    ),
    "thread_labels": oracle("SELECT topic_id, thread_label FROM thread_labels"),
    "thread_labels_annotated_only": oracle(
        "SELECT topic_id, thread_label FROM thread_labels "
        "WHERE topic_id IN (SELECT topic_id FROM annotated)"
    ),
    "labelled_threads": oracle(
        "SELECT s.topic_id, s.poster_id, l.thread_label FROM structured s "
        "JOIN thread_labels l USING (topic_id) WHERE s.is_initial_post"
    ),
    "user_role_table": oracle("SELECT * FROM role_table", role_table=_ROLES),
    "user_roles": oracle(
        """
        SELECT 'Total messages' AS metric, count(*) AS value FROM structured
        UNION ALL SELECT 'Total threads', count(DISTINCT topic_id) FROM structured
        UNION ALL SELECT 'Total unique users', count(*) FROM role_table
        UNION ALL SELECT 'Unique initial posters', count(*) FROM role_table WHERE threads_started > 0
        UNION ALL SELECT 'Unique repliers', count(*) FROM role_table WHERE replies_given > 0
        UNION ALL SELECT 'Only posted', count(*) FROM role_table WHERE replies_given = 0
        UNION ALL SELECT 'Only replied', count(*) FROM role_table WHERE threads_started = 0
        UNION ALL SELECT 'Both', count(*) FROM role_table
                  WHERE threads_started > 0 AND replies_given > 0""",
        role_table=_ROLES,
    ),
    "top_users": oracle("SELECT poster_id, n FROM per_user ORDER BY n DESC, poster_id LIMIT 10"),
    "top_starters": oracle(
        "SELECT * FROM role_table ORDER BY threads_started DESC, poster_id LIMIT 15",
        role_table=_ROLES,
    ),
}
