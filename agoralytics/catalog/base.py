"""Stages shared by the registered queries, in Spark and as SQL for the oracle."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from agoralytics.functions.text import WORD
from agoralytics.operators import filters, labels, mapping, threads
from agoralytics.operators import reports as rp
from agoralytics.session import cut_lineage
from agoralytics.sources import views
from agoralytics.sources.forum import ForumTables

# Off-topic group names and sample size that fit the test tables.
KEYWORDS = ("nation_3", "nation_17")
SAMPLE = 200


class Stages:
    """The forum views over one table folder, stage by stage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.folder, name)

    @cached_property
    def forum(self) -> ForumTables:
        return views.forum_tables(self.spark, self.folder)

    @cached_property
    def account_map(self) -> DataFrame:
        return mapping.topic_account_map(self.forum.topics, self.forum.groups)

    @cached_property
    def group_map(self) -> DataFrame:
        return mapping.topic_group_map(self.forum.topics, self.forum.groups)

    @cached_property
    def kept(self) -> DataFrame:
        messages = self.forum.messages
        return mapping.remove_posters(
            messages, mapping.superuser_ids(messages, self.account_map)
        )

    @cached_property
    def unmoderated(self) -> DataFrame:
        return filters.remove_moderators(self.kept, views.moderators(self.kept))

    @cached_property
    def grouped(self) -> DataFrame:
        return mapping.attach_group(self.unmoderated, self.group_map)

    @cached_property
    def themed(self) -> DataFrame:
        return filters.filter_intro_groups(self.grouped, KEYWORDS)

    @cached_property
    def structured(self) -> DataFrame:
        """Thread structure over the narrow columns, written before it is looked at twice
        and again after the window, where it branches."""
        narrow = self.themed.select(
            "message_id", "topic_id", "poster_id", "post_date", "doc_id", "group_name"
        )
        return cut_lineage(threads.thread_structure(cut_lineage(narrow)))

    def with_text(self, messages: DataFrame) -> DataFrame:
        """Texts are fetched for the rows that are left."""
        return views.with_text(messages, self.table("documents"))

    @cached_property
    def structured_text(self) -> DataFrame:
        return self.with_text(self.structured)

    @cached_property
    def normalized(self) -> DataFrame:
        return threads.normalize_messages(self.structured_text)

    @cached_property
    def annotated(self) -> DataFrame:
        return views.annotated(self.structured, self.table("labels"))

    @cached_property
    def annotated_text(self) -> DataFrame:
        return threads.normalize_messages(self.with_text(self.annotated))

    @cached_property
    def thread_labels(self) -> DataFrame:
        return labels.thread_labels(self.annotated, self.structured)

    @cached_property
    def labelled(self) -> DataFrame:
        """Labels are joined before the texts are fetched, which are shuffled no further."""
        first = labels.labelled_threads(self.structured, self.thread_labels)
        rows = threads.normalize_messages(self.with_text(first))
        return rows.select(*self.normalized.columns, "thread_label")

    @cached_property
    def activity(self) -> DataFrame:
        return rp.user_activity(self.structured)


# The white-space class for the regular expressions of the SQL side.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def words_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{SPACE}]+'))"


def strip_sql(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace({text}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"
    )


def tokens_sql(text: str, smallest: int = 1) -> str:
    return f"regexp_extract_all({text}, '[{WORD}]{{{smallest},}}')"


def hash_sql(key: str, seed: str = "42") -> str:
    return f"md5('{seed}|' || {key})"


def unit_sql(key: str, seed: str = "42") -> str:
    return f"(('0x' || substr({hash_sql(key, seed)}, 1, 8))::BIGINT / 4294967296.0)"


_TOPIC = (
    "CASE WHEN (event_id // 8) % 10 = 0 THEN 1000000000 + event_id ELSE event_id // 8 END"
)

# Common table expressions in the order they build on each other.
_STAGES = {
    "posts": f"""
        SELECT e.event_id AS message_id, {_TOPIC} AS topic_id, e.user_id AS poster_id,
               e.ts AS post_date, d.text AS message_text, d.doc_id
        FROM events e JOIN documents d
          ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "topics": f"""
        SELECT topic_id, CASE WHEN topic_id % 400 = 7 THEN 100
                              WHEN topic_id % 397 = 5 THEN 101
                              ELSE topic_id % 25 END AS group_id
        FROM (SELECT DISTINCT {_TOPIC} AS topic_id FROM events)""",
    "forum_groups": """
        SELECT n_nationkey::BIGINT AS group_id, (2 + n_regionkey % 2)::BIGINT AS account_id,
               n_name AS group_name FROM nation
        UNION ALL SELECT 100, 1, 'TEST' UNION ALL SELECT 101, 4, 'DEMO'""",
    "account_map": """
        SELECT t.topic_id, arg_min(g.account_id, g.group_id) AS account_id
        FROM topics t JOIN forum_groups g USING (group_id)
        WHERE g.account_id IS NOT NULL GROUP BY t.topic_id""",
    "group_map": """
        SELECT t.topic_id, coalesce(arg_min(g.group_name, t.group_id), '') AS group_name
        FROM topics t LEFT JOIN forum_groups g USING (group_id) GROUP BY t.topic_id""",
    "superusers": """
        SELECT DISTINCT poster_id FROM posts JOIN account_map USING (topic_id)
        WHERE account_id IN (1, 4)""",
    "kept": """
        SELECT * FROM posts p
        WHERE NOT EXISTS (SELECT 1 FROM superusers s WHERE s.poster_id = p.poster_id)""",
    "moderator_ids": "SELECT DISTINCT poster_id FROM kept WHERE poster_id % 29 = 3",
    "moderator_threads": """
        SELECT topic_id FROM (
            SELECT topic_id, poster_id, row_number() OVER (
                PARTITION BY topic_id ORDER BY post_date NULLS LAST, message_id) AS rn
            FROM kept)
        WHERE rn = 1 AND poster_id IN (SELECT poster_id FROM moderator_ids)""",
    "unmoderated": """
        SELECT * FROM kept
        WHERE topic_id NOT IN (SELECT topic_id FROM moderator_threads)
          AND poster_id NOT IN (SELECT poster_id FROM moderator_ids)""",
    "grouped": """
        SELECT u.*, coalesce(g.group_name, '') AS group_name
        FROM unmoderated u LEFT JOIN group_map g USING (topic_id)""",
    "themed": """
        SELECT * FROM grouped WHERE topic_id NOT IN (
            SELECT topic_id FROM grouped
            WHERE contains(lower(group_name), 'nation_3')
               OR contains(lower(group_name), 'nation_17'))""",
    "structured": """
        SELECT *, reply_index = 0 AS is_initial_post, reply_count > 0 AS thread_has_replies
        FROM (
            SELECT *,
                   row_number() OVER w - 1 AS reply_index,
                   first_value(poster_id) OVER w AS first_poster_id,
                   count(*) OVER (PARTITION BY topic_id) - 1 AS reply_count
            FROM themed
            WINDOW w AS (PARTITION BY topic_id ORDER BY post_date NULLS LAST, message_id))""",
    "doc_runs": """
        SELECT doc_id, c, min(i) AS pos, count(*) AS n
        FROM (
            SELECT doc_id, c, i,
                   i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run
            FROM (SELECT doc_id, unnest(chars) AS c, unnest(range(len(chars))) AS i
                  FROM (SELECT doc_id, regexp_extract_all(lower(text), '(?s).') AS chars
                        FROM documents)))
        GROUP BY doc_id, c, run""",
    "doc_normalized": f"""
        SELECT doc_id, {strip_sql("regexp_replace(regexp_replace(squeezed, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text_normalized
        FROM (
            SELECT doc_id, string_agg(
                CASE WHEN n >= 4 AND c <> chr(10) THEN repeat(c, 2) ELSE repeat(c, n) END,
                '' ORDER BY pos) AS squeezed
            FROM doc_runs GROUP BY doc_id)""",
    "normalized": """
        SELECT s.*, coalesce(d.text_normalized, '') AS text_normalized
        FROM structured s LEFT JOIN doc_normalized d USING (doc_id)""",
    "annotated": """
        SELECT r.*, CASE WHEN quality = 1 THEN 'SS' ELSE 'NSS' END AS label,
               CASE WHEN quality <> 1 THEN 'N/A' WHEN doc_id % 3 = 0 THEN 'informational'
                    WHEN doc_id % 3 = 1 THEN 'emotional' ELSE 'other' END AS support_type
        FROM structured r JOIN labels USING (doc_id) WHERE NOT is_initial_post""",
    "annotated_text": """
        SELECT a.*, coalesce(d.text_normalized, '') AS text_normalized
        FROM annotated a LEFT JOIN doc_normalized d USING (doc_id)""",
    "thread_labels": """
        SELECT s.topic_id,
               CASE WHEN coalesce(l.any_ss, FALSE) THEN 'successful' ELSE 'unsuccessful' END
                   AS thread_label
        FROM structured s
        LEFT JOIN (SELECT topic_id, bool_or(label = 'SS') AS any_ss
                   FROM annotated GROUP BY topic_id) l USING (topic_id)
        WHERE is_initial_post""",
    "labelled": """
        SELECT n.*, l.thread_label FROM normalized n JOIN thread_labels l USING (topic_id)
        WHERE is_initial_post""",
    "activity": """
        SELECT poster_id, CASE WHEN message_count = 1 THEN 'one-time'
                               WHEN message_count <= 5 THEN 'low'
                               WHEN message_count <= 20 THEN 'medium' ELSE 'high' END
                   AS activity_level, message_count
        FROM (SELECT poster_id, count(*) AS message_count FROM structured
              WHERE poster_id IS NOT NULL GROUP BY poster_id)""",
    "eligible": """
        SELECT * FROM normalized WHERE NOT is_initial_post AND poster_id <> first_poster_id""",
    "capped": f"""
        SELECT * FROM eligible QUALIFY row_number() OVER (
            PARTITION BY poster_id ORDER BY {hash_sql("message_id")}, message_id) <= 4""",
    "single": f"""
        SELECT * FROM capped QUALIFY row_number() OVER (
            PARTITION BY topic_id ORDER BY {hash_sql("message_id")}, message_id) = 1""",
    "sample": f"""
        SELECT * FROM single ORDER BY {hash_sql("message_id")}, message_id LIMIT {SAMPLE}""",
    "per_user": """
        SELECT poster_id, count(*) AS n FROM structured
        WHERE is_initial_post OR poster_id <> first_poster_id GROUP BY poster_id""",
}


def oracle(final: str, **extra: str) -> str:
    """The final query with the stages it needs, and extra ones of its own."""
    stages = {**_STAGES, **extra}
    needed: set[str] = set()

    def need(body: str) -> None:
        for name in stages:
            if name not in needed and re.search(rf"\b{name}\b", body):
                needed.add(name)
                need(stages[name])

    need(final)
    parts = [f"{name} AS ({body})" for name, body in stages.items() if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final
