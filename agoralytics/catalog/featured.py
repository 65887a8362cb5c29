"""Registered queries: features, split, folds and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoralytics.catalog.base import Stages, hash_sql, oracle, tokens_sql, unit_sql, words_sql
from agoralytics.catalog.lexicons import _TABLES, CATEGORIES, _entries
from agoralytics.functions import text as tx
from agoralytics.operators import features, lexicon, metrics, reports, split, threads
from agoralytics.session import cut_lineage

VOCABULARY = 5_000


def structural_features(spark, folder):
    posts = features.structural_features(Stages(spark, folder).labelled)
    return posts.select("topic_id", *features.STRUCTURAL)


def feature_table(spark, folder):
    posts = cut_lineage(
        Stages(spark, folder).labelled.select("topic_id", "thread_label", "text_normalized")
    )
    scores = lexicon.lexicon_scores(posts, _entries(spark), CATEGORIES)
    table = features.feature_table(posts, scores)
    return table.select("topic_id", *features.feature_columns(table))


def tfidf_terms(spark, folder):
    posts = Stages(spark, folder).table("documents")
    terms = features.tfidf_terms(posts, "doc_id", "text", VOCABULARY)
    return terms.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def anova_scores(spark, folder):
    """All features of the feature table, against the label of the thread."""
    posts = cut_lineage(Stages(spark, folder).labelled.select("topic_id", "poster_id", "text_normalized", "thread_label"))
    table = cut_lineage(features.feature_table(posts, lexicon.lexicon_scores(posts, _entries(spark), CATEGORIES)))
    scores = features.anova_scores(table, features.feature_columns(table))
    return scores.withColumn("f_score", F.round("f_score", 4)).withColumn("p_value", F.round("p_value", 6))


def user_split(spark, folder):
    return split.user_split(Stages(spark, folder).labelled).select("topic_id", "poster_id", "split")


def split_overlap(spark, folder):
    return split.split_overlap(split.user_split(Stages(spark, folder).labelled))


def class_weights(spark, folder):
    weights = split.class_weights(Stages(spark, folder).thread_labels)
    return weights.withColumn("weight", F.round("weight", 6))


def cv_folds(spark, folder):
    folded = split.cv_folds(Stages(spark, folder).thread_labels)
    return folded.select("topic_id", "thread_label", "fold")


def _judged(spark, folder):
    """Documents with a rule's guess of their quality."""
    s = Stages(spark, folder)
    documents = s.table("documents").select("doc_id", "text", "lang")
    return s.table("labels").join(documents, "doc_id").select(
        "doc_id",
        "lang",
        F.col("quality").alias("y_true"),
        (tx.word_count("text") > 80).cast("int").alias("y_pred"),
    )


def macro_metrics(spark, folder):
    return metrics.macro_metrics(_judged(spark, folder))


def macro_metrics_by_language(spark, folder):
    return metrics.macro_metrics(_judged(spark, folder), by=["lang"])


def class_report(spark, folder):
    report = metrics.class_report(_judged(spark, folder))
    return report.select(
        "class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_judged(spark, folder), [0, 1])


def subgroup_f1(spark, folder):
    """Levels come from the threads a poster opened."""
    s = Stages(spark, folder)
    guesses = s.labelled.select(
        "poster_id",
        (F.col("thread_label") == "successful").cast("int").alias("y_true"),
        (tx.word_count("message_text") > 80).cast("int").alias("y_pred"),
    )
    activity = reports.user_activity(threads.initial_posts(s.structured))
    return metrics.subgroup_f1(guesses, activity)


_FEATURES = """
    SELECT topic_id, thread_label, w AS feat_word_count, length(t) AS feat_char_count,
           length(t) - length(replace(t, '?', '')) AS feat_question_marks,
           length(t) - length(replace(t, '!', '')) AS feat_exclamation,
           s AS feat_sentence_count, w / s AS feat_avg_sentence_len,
           len(regexp_extract_all(t, '\\.\\.\\.')) AS feat_ellipsis
    FROM (SELECT topic_id, thread_label, text_normalized AS t, {words} AS w,
                 greatest(1, length(text_normalized)
                     - length(regexp_replace(text_normalized, '[.!?]', '', 'g'))) AS s
          FROM labelled)""".format(words=words_sql("text_normalized"))
_NAMES = ", ".join(features.STRUCTURAL)
_NORMAL_TABLES = {
    **_TABLES,
    "doc_words": _TABLES["doc_words"]
    .replace("lower(text)", "text_normalized")
    .replace("FROM documents", "FROM doc_normalized"),
}
_TERMS = {
    "unigrams": f"""
        SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
        FROM (SELECT doc_id, {tokens_sql("lower(text)", 2)} AS ws FROM documents)""",
    "counts": """
        SELECT doc_id, term, count(*) AS n FROM (
            SELECT doc_id, w AS term FROM unigrams
            UNION ALL
            SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) FROM unigrams)
        WHERE term IS NOT NULL GROUP BY doc_id, term""",
    "top": f"""
        SELECT term, count(*) AS df FROM counts GROUP BY term
        ORDER BY sum(n) DESC, term LIMIT {VOCABULARY}""",
    "weighted": """
        SELECT doc_id, term,
               n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
        FROM counts JOIN top USING (term)""",
}
_JUDGED = f"""
    SELECT l.doc_id, d.lang, l.quality AS y_true, ({words_sql('d.text')} > 80)::INTEGER AS y_pred
    FROM labels l JOIN documents d USING (doc_id)"""


def _report_sql(source: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    join = f" USING ({key}class)"
    return f"""
        SELECT {key}class, coalesce(tp / nullif(pn, 0), 0) AS precision,
               coalesce(tp / nullif(sn, 0), 0) AS recall,
               coalesce(2 * tp / nullif(pn + sn, 0), 0) AS f1, coalesce(sn, 0) AS support
        FROM (SELECT {key}class, coalesce(tp, 0) AS tp, coalesce(pn, 0) AS pn, coalesce(sn, 0) AS sn
              FROM (SELECT {key}y_true AS class, count(*) AS sn,
                           count(*) FILTER (y_true = y_pred) AS tp
                    FROM {source} GROUP BY ALL)
              FULL JOIN (SELECT {key}y_pred AS class, count(*) AS pn FROM {source} GROUP BY ALL)
                  {join})"""


def _macro_sql(source: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {key}round(avg(f1), 3) AS f1_macro, round(avg(precision), 3) AS precision_macro, "
        f"round(avg(recall), 3) AS recall_macro, sum(support)::BIGINT AS n FROM {source}{group}"
    )


def _anova(feature: str) -> str:
    return f"""
        SELECT '{feature}' AS feature, sum(n) - count(*) AS free,
               CASE WHEN sum(n * v) > 0 THEN
                   (sum(n * (m - g) * (m - g)) / (count(*) - 1))
                   / (sum(n * v) / (sum(n) - count(*))) END AS f_score
        FROM (SELECT count(*) AS n, avg("{feature}") AS m, var_pop("{feature}") AS v,
                     (SELECT avg("{feature}") FROM table_rows) AS g
              FROM table_rows GROUP BY thread_label)"""


# There are two labels: the F value is the square of a t value, whose tail is an integral of powers of a cosine.
_TAIL_STEPS = 20_000
_P_VALUE = f"""
    SELECT feature, any_value(f_score) AS f_score,
           sum(CASE WHEN k % 2 = 1 THEN 4 WHEN k IN (0, {_TAIL_STEPS}) THEN 1 ELSE 2 END
               * cos(a + (pi() / 2 - a) * k / {_TAIL_STEPS}) ** (free - 1)) * (pi() / 2 - a)
           / sum(CASE WHEN k % 2 = 1 THEN 4 WHEN k IN (0, {_TAIL_STEPS}) THEN 1 ELSE 2 END
               * cos(pi() / 2 * k / {_TAIL_STEPS}) ** (free - 1)) / (pi() / 2) AS p_value
    FROM (SELECT *, atan(sqrt(f_score / free)) AS a FROM scored), range({_TAIL_STEPS} + 1) AS r(k)
    GROUP BY feature, a"""


QUERIES = {
    f.__name__: f
    for f in (
        structural_features, feature_table, tfidf_terms, anova_scores, user_split,
        split_overlap, class_weights, cv_folds, macro_metrics, macro_metrics_by_language,
        class_report, confusion_matrix, subgroup_f1,
    )
}

ORACLES = {
    "structural_features": oracle(f"SELECT topic_id, {_NAMES} FROM features", features=_FEATURES),
    "feature_table": oracle(
        f"SELECT f.topic_id, {_NAMES}, s.WC AS feat_liwc_WC, "
        + ", ".join(f's."{c}" AS "feat_liwc_{c}"' for c in CATEGORIES.values())
        + " FROM features f JOIN labelled l USING (topic_id) JOIN doc_scores s USING (doc_id)",
        features=_FEATURES,
        **_NORMAL_TABLES,
    ),
    "tfidf_terms": oracle(
        "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight "
        "FROM weighted",
        **_TERMS,
    ),
    "anova_scores": oracle(
        """SELECT feature, round(f_score, 4) AS f_score, round(p_value, 6) AS p_value, rank, rank <= 25 AS selected
           FROM (SELECT *, row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS rank
                 FROM tested)""",
        features=_FEATURES,
        **_NORMAL_TABLES,
        table_rows='SELECT f.*, s.WC AS "feat_liwc_WC", '
        + ", ".join(f's."{c}" AS "feat_liwc_{c}"' for c in CATEGORIES.values())
        + " FROM features f JOIN labelled l USING (topic_id) JOIN doc_scores s USING (doc_id)",
        scored=" UNION ALL ".join(_anova(f) for f in (*features.STRUCTURAL, "feat_liwc_WC", *(f"feat_liwc_{c}" for c in CATEGORIES.values()))),
        tested=_P_VALUE,
    ),
    "user_split": oracle(
        f"SELECT topic_id, poster_id, CASE WHEN {unit_sql('poster_id')} < 0.70 THEN 'train' "
        f"WHEN {unit_sql('poster_id')} < 0.85 THEN 'val' ELSE 'test' END AS split "
        "FROM structured WHERE is_initial_post"
    ),
    "split_overlap": oracle(
        "SELECT count(*) FILTER (k > 1) AS train_val, count(*) FILTER (k > 1) AS train_test, "
        "count(*) FILTER (k > 1) AS val_test FROM (SELECT poster_id, count(DISTINCT CASE "
        f"WHEN {unit_sql('poster_id')} < 0.70 THEN 1 WHEN {unit_sql('poster_id')} < 0.85 THEN 2 "
        "ELSE 3 END) AS k FROM structured WHERE is_initial_post GROUP BY poster_id)"
    ),
    "class_weights": oracle("""
        SELECT thread_label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
        FROM (SELECT thread_label, count(*) AS n FROM thread_labels GROUP BY thread_label)"""),
    "cv_folds": oracle(
        "SELECT topic_id, thread_label, ((row_number() OVER (PARTITION BY thread_label ORDER BY "
        f"{hash_sql('topic_id')}, topic_id) - 1) % 5)::INTEGER AS fold FROM thread_labels"
    ),
    "macro_metrics": oracle(
        _macro_sql("report"), judged=_JUDGED, report=_report_sql("judged")
    ),
    "macro_metrics_by_language": oracle(
        _macro_sql("report", "lang"), judged=_JUDGED, report=_report_sql("judged", "lang")
    ),
    "class_report": oracle(
        "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, "
        "round(f1, 6) AS f1, support FROM report",
        judged=_JUDGED,
        report=_report_sql("judged"),
    ),
    "confusion_matrix": oracle(
        " UNION ALL ".join(
            f"SELECT {t} AS y_true, count(*) FILTER (y_true = {t} AND y_pred = 0) AS pred_0, "
            f"count(*) FILTER (y_true = {t} AND y_pred = 1) AS pred_1 FROM judged"
            for t in (0, 1)
        ),
        judged=_JUDGED,
    ),
    "subgroup_f1": oracle(
        f"SELECT activity_level, f1_macro, n FROM ({_macro_sql('report', 'activity_level')}) "
        "WHERE n >= 5",
        guesses=f"""
            SELECT a.activity_level, (l.thread_label = 'successful')::INTEGER AS y_true,
                   ({words_sql('s.message_text')} > 80)::INTEGER AS y_pred
            FROM structured s JOIN thread_labels l USING (topic_id)
            JOIN (SELECT poster_id, CASE WHEN count(*) = 1 THEN 'one-time' WHEN count(*) <= 5
                         THEN 'low' WHEN count(*) <= 20 THEN 'medium' ELSE 'high' END
                         AS activity_level
                  FROM structured WHERE is_initial_post GROUP BY poster_id) a USING (poster_id)
            WHERE s.is_initial_post""",
        report=_report_sql("guesses", "activity_level"),
    ),
}
