"""The end-to-end flows: raw dump -> community messages -> structured threads ->
labels and lexicon scores -> models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.config import (
    COMMUNITY_ACCOUNTS,
    INTRO_GROUP_KEYWORDS,
    MIN_LABELLED_THREADS,
    MIN_WORDS,
    MIN_WORDS_INITIAL,
    SAMPLE_SIZE,
    SEED,
    TOP_LEVEL_CATEGORIES,
    USER_CAP,
)
from agoralytics.functions import text as tx
from agoralytics.functions.values import parse_date
from agoralytics.operators import filters, labels, languages, mapping, models, privacy, reports, sampling, threads
from agoralytics.operators.features import feature_columns, feature_table, structural_features, with_lexicon
from agoralytics.operators.lexicon import hit_counts, lexicon_scores, scores_of_counts, small_dictionary, unique_names, with_scores
from agoralytics.operators.metrics import confusion_matrix, subgroup_f1
from agoralytics.operators.split import user_split
from agoralytics.operators.tagger import Tagger
from agoralytics.session import as_written, cut_lineage, written
from agoralytics.sources.forum import ForumTables


def clean_table(df: DataFrame, text: str = "message_text") -> DataFrame:
    """Blank rows out, markup out of every text column, quotes out of the message."""
    kept = filters.drop_empty_rows(df)
    kinds = dict(kept.dtypes)
    columns = []
    for name in kept.columns:
        column = F.col(name)
        if kinds[name] == "string" and name != "poster_id":
            column = tx.html_to_text(name)
        if name == text:
            column = tx.strip_quotes(column)
        if name in ("post_date", "start_date"):
            column = parse_date(name)
        columns.append(column.alias(name))
    return kept.select(*columns)


@dataclass(frozen=True)
class Preprocessed:
    """Cleaned tables, the community messages with group names, the id map.

    For reviewers: the entities of each message (message_id, type, start, end, text),
    its text before and after masking, and the map back from each placeholder. `found` has
    them per text; if `ids`, the ids of the messages, are kept apart from the texts, it is
    written when the first of these tables is asked for.
    """

    messages: DataFrame
    topics: DataFrame
    groups: DataFrame
    accounts: DataFrame | None
    community: DataFrame
    pseudonyms: DataFrame
    found: DataFrame
    ids: DataFrame | None = None

    @cached_property
    def masked(self) -> DataFrame:
        return self.found if self.ids is None else _with_text(self.ids, cut_lineage(self.found))

    @property
    def entities(self) -> DataFrame:
        return self.masked.select("message_id", F.inline("entities"))

    @property
    def review(self) -> DataFrame:
        return self.masked.select(
            "message_id",
            F.col("message_text").alias("original_text"),
            F.col("message_text_anon").alias("anonymized_text"),
        )

    @property
    def mask_map(self) -> DataFrame:
        return self.masked.select("message_id", F.explode("mask_map").alias("placeholder", "original"))


def _with_text(messages: DataFrame, texts: DataFrame) -> DataFrame:
    """Messages with their texts; as in clean_table, rows without any value go."""
    own = [F.col(c).isNotNull() for c in messages.columns if c != "doc_id"]
    kept = messages.withColumn("_any", F.greatest(*own, F.lit(False))).join(texts, "doc_id")
    return kept.where(F.col("_any") | F.col("message_text").isNotNull()).drop("doc_id", "_any")


def preprocess(
    forum: ForumTables,
    moderators: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    min_words: int = MIN_WORDS,
    stop_words: Mapping[str, Sequence[str]] | None = None,
    language: str | None = None,
    language_profiles: DataFrame | None = None,
    tagger: Tagger | None = None,
    accounts: Sequence[int] = COMMUNITY_ACCOUNTS,
    texts: DataFrame | None = None,
) -> Preprocessed:
    """Superusers and moderators out, texts cleaned and masked, ids replaced.

    Integrated messages were filtered upstream and skip the row filters by account
    and moderator. The cleaned messages are written once, because the filters and
    several branches read them and cleaning is the costly part. Names come from the
    gazetteer, the tagger or both; the language from profiles, or else from stop words.

    With `texts` (doc_id, message_text), the messages carry doc_id and no text: rows are filtered,
    renamed and given their groups without texts. Each text is cleaned, masked and written once, and
    fetched last, for the messages that are left; no message's text is shuffled or written.
    """
    account_map = mapping.topic_account_map(forum.topics, forum.groups)
    group_map = mapping.topic_group_map(forum.topics, forum.groups)
    messages = forum.messages
    if texts is not None:
        texts = texts.select("doc_id", "message_text").where("doc_id is not null")
        messages = messages.join(texts.select("doc_id"), "doc_id", "left_semi")
    if not forum.integrated:
        superusers = mapping.superuser_ids(messages, account_map)
        messages = mapping.remove_posters(messages, superusers)
        if moderators is not None:
            messages = filters.remove_moderators(messages, moderators)

    # Links and addresses are masked while they are there; standardising deletes links
    # and collapses ellipses.
    key = "message_id" if texts is None else "doc_id"
    found = privacy.mask_with_review(
        clean_table(messages if texts is None else texts), key, "message_text", gazetteer, tagger=tagger
    )
    if texts is None:
        found = cut_lineage(found)
    standard = found.withColumns(
        {
            "ellipsis_count": F.regexp_count("message_text", F.lit(r"\.\.\.")),
            "message_text": tx.standardize("message_text_anon"),
        }
    ).drop("entities", "mask_map", "message_text_anon")
    standard = cut_lineage(standard)
    standard = filters.min_word_filter(standard, "message_text", min_words)
    if language is not None:
        if language_profiles is not None:
            standard = languages.language_filter(standard, "message_text", language_profiles, language)
        else:
            standard = filters.language_filter(standard, "message_text", stop_words or {}, language)

    ids = None if texts is None else cut_lineage(clean_table(messages))
    left = standard if ids is None else ids.join(standard.select("doc_id"), "doc_id", "left_semi")
    pseudonyms = cut_lineage(privacy.pseudonym_map([left]))
    rows = privacy.pseudonymize(standard if ids is None else ids, pseudonyms)

    def fetched(part: DataFrame) -> DataFrame:
        whole = part if ids is None else _with_text(part, standard)
        return whole.withColumn("message_text_normalized", F.lower("message_text"))

    topics = privacy.mask_columns(clean_table(forum.topics), "topic_id", ["name"], gazetteer, tagger=tagger)

    community = rows
    if not forum.integrated:
        community = mapping.community_filter(rows, account_map, accounts)
    community = fetched(mapping.attach_group(community, group_map))
    return Preprocessed(
        messages=fetched(rows),
        topics=topics,
        groups=clean_table(forum.groups),
        accounts=None if forum.accounts is None else clean_table(forum.accounts),
        community=community.select(*[c for c in community.columns if c != "group_name"], "group_name"),
        pseudonyms=pseudonyms,
        found=found,
        ids=ids,
    )


def structure(
    community: DataFrame,
    keywords: Sequence[str] = INTRO_GROUP_KEYWORDS,
    min_words_initial: int = MIN_WORDS_INITIAL,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Off-topic groups out, thread structure and normalised text added, threads
    with a short first post out. Written once before the last step, which reads it
    twice, as do all the tables made from it.

    With `texts` (doc_id, message_text), the messages carry doc_id and no text: threads are
    structured without texts, which are fetched for the first posts, to find the short ones, and
    for the rows that are left. No text of a message is shuffled or written."""
    if texts is not None:
        return _structure_first(community, texts, keywords, min_words_initial)
    if "group_name" in community.columns:
        community = filters.filter_intro_groups(community, keywords)
    rows = cut_lineage(threads.normalize_messages(threads.thread_structure(community)))
    return filters.filter_short_threads(rows, min_words=min_words_initial)


def _structure_first(
    community: DataFrame, texts: DataFrame, keywords: Sequence[str], min_words_initial: int
) -> DataFrame:
    """structure() with the texts fetched last; a text is known by a number, because ids may repeat."""
    texts = cut_lineage(
        texts.select("doc_id", "message_text").withColumn("_text", F.monotonically_increasing_id())
    )
    narrow = cut_lineage(community.join(texts.select("doc_id", "_text"), "doc_id"))
    if "group_name" in narrow.columns:
        narrow = cut_lineage(filters.filter_intro_groups(narrow, keywords))
    rows = cut_lineage(threads.thread_structure(narrow))

    def with_text(part: DataFrame) -> DataFrame:
        return threads.normalize_messages(part.join(texts.drop("doc_id"), "_text"))

    short = cut_lineage(filters.short_threads(with_text(threads.initial_posts(rows)), min_words=min_words_initial))
    added = [c for c in rows.columns if c not in narrow.columns]
    return with_text(rows.join(short, "topic_id", "left_anti")).select(
        *[c for c in narrow.columns if c != "_text"], "message_text", *added, "text_normalized"
    )


def postprocess(
    community: DataFrame,
    keywords: Sequence[str] = INTRO_GROUP_KEYWORDS,
    min_words_initial: int = MIN_WORDS_INITIAL,
    size: int = SAMPLE_SIZE,
    cap: int = USER_CAP,
    seed: int = SEED,
    texts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Structured messages, the annotation sample and the sample with context."""
    structured = structure(community, keywords, min_words_initial, texts)
    sample = sampling.annotation_sample(structured, size, cap, seed)
    return {
        "messages_structured": structured.drop("group_name", "first_poster_id"),
        "annotation_sample": sample,
        "annotation_sample_with_context": sampling.with_context(sample, structured),
        "length_check": reports.length_quantiles(structured),
    }


def explore(structured: DataFrame, annotated: DataFrame) -> dict[str, DataFrame]:
    """The report tables on corpus, labels, lengths, users and replies."""
    thread_labels = labels.thread_labels(annotated, structured)
    activity = reports.user_activity(structured)
    words = structured.select("is_initial_post", tx.word_count("text_normalized").alias("word_count"))
    reply_words = annotated.select("label", tx.word_count("text_normalized").alias("word_count"))
    thread_replies = (
        threads.replies(structured).groupBy("topic_id").agg(F.count("*").alias("replies"))
    )
    supportive = annotated.filter(F.col("label") == "SS")
    return {
        "corpus_summary": reports.corpus_summary(structured),
        "messages_per_month": reports.messages_per_month(structured),
        "label_distribution": reports.value_shares(annotated, "label"),
        "support_type_distribution": reports.value_shares(supportive, "support_type"),
        "class_imbalance": labels.class_imbalance(annotated),
        "thread_labels": thread_labels,
        "thread_label_distribution": reports.value_shares(thread_labels, "thread_label"),
        "message_length_histogram": reports.histogram_table(
            words, "word_count", 500, 40, ["is_initial_post"]
        ),
        "reply_length_by_label": reports.histogram_table(reply_words, "word_count", 300, 30, ["label"]),
        "wordcount_by_label": reports.wordcount_by(annotated, "label"),
        "user_activity": reports.by_activity(activity),
        "activity_levels": reports.activity_levels(activity),
        "user_activity_histogram": reports.histogram_table(activity, "message_count", 100, 40),
        "reply_count_stats": reports.reply_count_stats(structured),
        "reply_count_histogram": reports.histogram_table(thread_replies, "replies", 30, 30),
    }


@dataclass(frozen=True)
class ModelReport:
    validation: DataFrame
    test: DataFrame
    summary: DataFrame
    best: str
    confusion: DataFrame
    importance: DataFrame | None
    by_activity: DataFrame
    predictions: DataFrame


def labelled_features(
    posts: DataFrame,
    entries: DataFrame | None = None,
    categories: Mapping[int, str] | None = None,
    seed: int = SEED,
    text: bool = True,
) -> DataFrame:
    """Feature table of labelled first posts with their part of the split.

    Without a dictionary there are structural features only. Texts are read once, for
    features and lexicon scores together, and the table is written once, with the texts if they
    are wanted; no text is shuffled. A dictionary that is too large to go to every task is joined.
    """
    key, column, categories = "topic_id", "text_normalized", categories or {}
    if entries is not None:
        unique_names(categories)
    some = () if entries is None else small_dictionary(entries)
    if some is None:
        posts = cut_lineage(posts)
        table = user_split(feature_table(posts, lexicon_scores(posts, entries, categories)), seed=seed)
        return cut_lineage(table if text else table.drop(column))
    numbers = {} if entries is None else {"_n": hit_counts(posts.sparkSession, some, list(categories), column)}
    counted = user_split(structural_features(posts, column, numbers), seed=seed)
    counted = cut_lineage(counted if text else counted.drop(column))
    if entries is None:
        return counted
    if counted.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty():
        table = with_scores(counted, categories, key, "feat_liwc_")
        return as_written(table.drop(*[f"feat_liwc_{name}" for name in categories.values() if name not in TOP_LEVEL_CATEGORIES]))
    scores = scores_of_counts(counted.select(key, "_n"), categories, key)
    return cut_lineage(with_lexicon(counted.drop("_n"), scores, key=key))


def model_threads(
    table: DataFrame,
    user_activity: DataFrame,
    names: Sequence[str] = models.MODELS,
    smallest: int = MIN_LABELLED_THREADS,
    folds: int | None = None,
) -> ModelReport:
    """Trains the models, compares them on validation rows, and reports the best
    on the test rows. With `folds`, the summary has cross-validated scores too."""
    table = written(table)
    if table.count() < smallest:
        raise ValueError(f"fewer than {smallest} labelled threads")
    data = models.prepare(table, feature_columns(table))
    trained = models.train_models(data, names)
    validation = cut_lineage(models.evaluate(trained, data.val, "val"))
    test = models.evaluate(trained, data.test, "test")
    best = models.best_model(validation)
    predictions = trained[best].transform(data.test).select(
        "topic_id", "poster_id", F.col("target").alias("y_true"), F.col("prediction").alias("y_pred")
    )
    if best in (models.LOGISTIC, models.SVM):
        importance = models.linear_importance(trained[best], data.test, data.features)
    elif best in (models.FOREST, models.BOOSTED):
        importance = models.tree_contributions(trained[best], data.test, data.features)
    else:
        importance = None
    return ModelReport(
        validation=validation,
        test=test,
        summary=models.results_summary(
            validation, test, models.cross_validate_models(data, names, folds=folds) if folds else None
        ),
        best=best,
        confusion=confusion_matrix(predictions, [0.0, 1.0], "y_true", "y_pred"),
        importance=importance,
        by_activity=subgroup_f1(predictions, user_activity),
        predictions=predictions,
    )
