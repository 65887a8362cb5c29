"""Registered queries: oversampling, models and their comparison.

Training is iterative, so these have no SQL except where a count or a rule can be
checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agoralytics.catalog.base import KEYWORDS, Stages, oracle, unit_sql, words_sql
from agoralytics.catalog.lexicons import CATEGORIES, _entries
from agoralytics.catalog.private import _gazetteer
from agoralytics.operators import balance, features, models
from agoralytics.operators.features import feature_columns
from agoralytics.operators.metrics import subgroup_f1
from agoralytics.plans import flows
from agoralytics.session import cut_lineage
from agoralytics.sources.views import moderators


def _table(spark, folder, text=False, stages=None):
    """Feature table of the labelled threads with split, written once; the texts are kept for the models that read them."""
    s = stages or Stages(spark, folder)
    posts = s.labelled.select("topic_id", "poster_id", "text_normalized", "thread_label")
    return flows.labelled_features(posts, _entries(spark), CATEGORIES, text=text)


def _prepared(spark, folder, text=False, stages=None):
    table = _table(spark, folder, text, stages)
    return models.prepare(table, feature_columns(table))


def _results(name):
    def query(spark, folder):
        data = _prepared(spark, folder, name == models.TFIDF_LR)
        trained = models.train_models(data, [name])
        return models.results_summary(
            models.evaluate(trained, data.val, "val"), models.evaluate(trained, data.test, "test")
        )

    return query


def model_majority(spark, folder):
    data = models.with_target(_table(spark, folder))
    train = data.filter("split = 'train'")
    model = models.fit(models.MAJORITY, train)
    return model.transform(data.filter("split = 'test'")).select("topic_id", "target", "prediction")


def _vectors(spark, folder):
    """Labelled documents with their structural features as the points."""
    s = Stages(spark, folder)
    documents = s.table("labels").join(s.table("documents").select("doc_id", "text"), "doc_id")
    table = features.structural_features(documents, "text")
    return table.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("toxic").alias("label"),
        F.array(*[F.col(f).cast("double") for f in features.STRUCTURAL]).alias("x"),
    )


def smote(spark, folder):
    rows = balance.smote(_vectors(spark, folder), "doc_id", "label", "x")
    return rows.select(
        "doc_id", "label", "synthetic",
        *[F.round(F.col("x")[i], 6).alias(f) for i, f in enumerate(features.STRUCTURAL)],
    )


def smote_counts(spark, folder):
    rows = balance.smote(_vectors(spark, folder), "doc_id", "label", "x")
    return rows.groupBy("label").agg(
        F.count("*").alias("rows"), F.count_if("synthetic").alias("synthetic")
    )


def nearest_neighbours(spark, folder):
    """Distances to the three nearest rows of each distinct point."""
    points = _vectors(spark, folder).filter("label = 1")
    lists = balance.neighbour_lists(points, "x", 3, leaf=200)

    def squares(v):
        pairs = F.zip_with("x", v, lambda a, b: (a - b) * (a - b))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, d: acc + d)

    return lists.select(
        F.col("x")[1].cast("long").alias("chars"),
        F.col("x")[0].cast("long").alias("words"),
        *[F.round(F.sqrt(squares(F.col("neighbours")[i])), 4).alias(f"d{i + 1}") for i in range(3)],
    )


def model_comparison(spark, folder):
    stages = Stages(spark, folder)
    report = flows.model_threads(_table(spark, folder, True, stages), stages.activity)
    return report.summary.withColumn("best", F.col("model") == report.best)


def results_summary(spark, folder):
    """Validation and test results of the linear models side by side."""
    data = _prepared(spark, folder)
    trained = models.train_models(data, [models.MAJORITY, models.LOGISTIC, models.SVM])
    return models.results_summary(
        models.evaluate(trained, data.val, "val"), models.evaluate(trained, data.test, "test")
    )


def _filled_before(data):
    filled = data.balanced.select("target", "features", F.xxhash64("features").alias("key"))
    return models.cv_summary(models.cross_validate(filled, models.LOGISTIC, "key", oversample="none"))


def cv_scores(spark, folder):
    """Cross-validated F1 with oversampling inside the folds and, for comparison,
    on rows filled up beforehand."""
    data = _prepared(spark, folder)
    inside = models.cv_summary(models.cross_validate(data.train, models.LOGISTIC, "topic_id"))
    return inside.withColumn("oversample", F.lit("inside")).unionByName(
        _filled_before(data).withColumn("oversample", F.lit("before"))
    )


def cv_scores_filled_before(spark, folder):
    return _filled_before(_prepared(spark, folder))


def subtype_cv(spark, folder):
    typed = models.typed_support(Stages(spark, folder).annotated_text)
    table = features.structural_features(typed)
    rows = models.with_target(table, "support_type", "informational")
    ready = cut_lineage(
        models.matrix(rows, features.STRUCTURAL).select("message_id", "target", "features")
    )
    if ready.count() < 20:
        return spark.createDataFrame([], "model string, cv_f1_macro_mean double, cv_f1_macro_std double")
    return models.cv_summary(
        models.cross_validate(ready, models.LOGISTIC, "message_id", oversample="none")
    )


def grid_search(spark, folder):
    data = _prepared(spark, folder)
    return models.grid_search(data.train, models.LOGISTIC, "topic_id", folds=3)


#: Models whose folds a registered query fits; the others take hundreds of jobs a fold.
QUICK_MODELS = (models.MAJORITY, models.LOGISTIC, models.SVM)


def cv_comparison(spark, folder):
    """Cross-validated, validation and test results of the models side by side."""
    stages = Stages(spark, folder)
    report = flows.model_threads(
        _table(spark, folder, stages=stages), stages.activity, QUICK_MODELS, folds=5
    )
    return report.summary.withColumn("best", F.col("model") == report.best)


def search_best(spark, folder):
    """The settings of the model that is best on the validation rows, by cross-validation."""
    data = _prepared(spark, folder)
    trained = models.train_models(data, QUICK_MODELS)
    best = models.best_model(models.evaluate(trained, data.val, "val"))
    return models.search(data, best, folds=3)


def linear_importance(spark, folder):
    data = _prepared(spark, folder)
    model = models.fit(models.LOGISTIC, data.balanced, data.rows)
    return models.linear_importance(model, data.test, data.features)


def tree_importance(spark, folder):
    data = _prepared(spark, folder)
    model = models.fit(models.FOREST, data.balanced, data.rows)
    return models.tree_importance(spark, model, data.features)


def tree_contributions(spark, folder):
    """Mean absolute contributions per feature of both kinds of trees."""
    data = _prepared(spark, folder)
    out = None
    for name in (models.FOREST, models.BOOSTED):
        model = models.fit(name, data.balanced, data.rows)
        found = models.tree_contributions(model, data.test, data.features).withColumn("model", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def subgroup_f1_of_model(spark, folder):
    stages = Stages(spark, folder)
    data = _prepared(spark, folder, stages=stages)
    model = models.fit(models.LOGISTIC, data.balanced, data.rows)
    scored = model.transform(data.test)
    return subgroup_f1(scored, stages.activity, "target", "prediction")


def community_messages(spark, folder):
    """The whole first flow: filters, cleaning, masks, pseudonyms, group names."""
    s = Stages(spark, folder)
    texts = s.table("documents").select("doc_id", F.col("text").alias("message_text"))
    return flows.preprocess(s.forum, moderators(s.kept), _gazetteer(spark), texts=texts).community


def messages_structured(spark, folder):
    """The whole second flow on the community messages."""
    s = Stages(spark, folder)
    texts = s.table("documents").select("doc_id", F.col("text").alias("message_text"))
    return flows.postprocess(s.grouped, KEYWORDS, texts=texts)["messages_structured"]


QUERIES = {
    "model_majority": model_majority,
    "model_lr": _results(models.LOGISTIC),
    "model_tfidf_lr": _results(models.TFIDF_LR),
    "model_svm": _results(models.SVM),
    "model_rf": _results(models.FOREST),
    "model_gbt": _results(models.BOOSTED),
    **{
        f.__name__: f
        for f in (
            smote, smote_counts, nearest_neighbours, model_comparison, results_summary,
            cv_scores, cv_scores_filled_before, cv_comparison, subtype_cv, grid_search, search_best, linear_importance,
            tree_importance, tree_contributions, subgroup_f1_of_model, community_messages, messages_structured,
        )
    },
}

ORACLES = {
    "model_majority": oracle(
        """SELECT topic_id, (thread_label = 'successful')::INTEGER::DOUBLE AS target,
                  (SELECT arg_max(t, (n, -t)) FROM (
                      SELECT (thread_label = 'successful')::INTEGER::DOUBLE AS t, count(*) AS n
                      FROM parted WHERE u < 0.70 GROUP BY 1)) AS prediction
           FROM parted WHERE u >= 0.85""",
        parted=f"""
            SELECT topic_id, thread_label, {unit_sql('poster_id')} AS u
            FROM structured JOIN thread_labels USING (topic_id) WHERE is_initial_post""",
    ),
    "nearest_neighbours": f"""
        WITH points AS (
            SELECT {words_sql('text')} AS w, length(text) AS c,
                   length(text) - length(replace(text, '?', '')) AS q,
                   length(text) - length(replace(text, '!', '')) AS e,
                   greatest(1, length(text) - length(regexp_replace(text, '[.!?]', '', 'g'))) AS s,
                   len(regexp_extract_all(text, '\\.\\.\\.')) AS el
            FROM labels JOIN documents USING (doc_id) WHERE toxic = 1),
        distances AS (
            SELECT a.*, row_number() OVER (PARTITION BY a.w, a.c, a.q, a.e, a.s, a.el ORDER BY d)
                       AS rn, d
            FROM (SELECT a.*, sqrt((a.w - b.w) ** 2 + (a.c - b.c) ** 2 + (a.q - b.q) ** 2
                        + (a.e - b.e) ** 2 + (a.s - b.s) ** 2 + (a.el - b.el) ** 2
                        + (a.w / a.s - b.w / b.s) ** 2) AS d
                  FROM (SELECT DISTINCT * FROM points) a, points b) a)
        SELECT c AS chars, w AS words,
               round(any_value(d) FILTER (rn = 2), 4) AS d1,
               round(any_value(d) FILTER (rn = 3), 4) AS d2,
               round(any_value(d) FILTER (rn = 4), 4) AS d3
        FROM distances GROUP BY w, c, q, e, s, el""",
    "smote_counts": """
        SELECT toxic AS label, max(count(*)) OVER () AS rows,
               max(count(*)) OVER () - count(*) AS synthetic
        FROM labels GROUP BY toxic""",
    "messages_structured": oracle("""
        SELECT message_id, topic_id, poster_id, post_date, message_text, doc_id, reply_index,
               reply_count, is_initial_post, thread_has_replies, text_normalized
        FROM normalized WHERE topic_id NOT IN (
            SELECT topic_id FROM normalized WHERE is_initial_post
            AND len(regexp_extract_all(text_normalized, '[^\\s]+')) < 5)"""),
}
