"""Feature tables of first posts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.config import SELECTED_FEATURES, TOP_LEVEL_CATEGORIES
from agoralytics.functions import text as tx
from agoralytics.functions.values import f_test

# Names of the structural features.
STRUCTURAL = (
    "feat_word_count",
    "feat_char_count",
    "feat_question_marks",
    "feat_exclamation",
    "feat_sentence_count",
    "feat_avg_sentence_len",
    "feat_ellipsis",
)


def _marks(texts: pa.Array) -> pa.Array:
    """Per text the numbers of words, `?`, `!`, `.`, and `...`; a missing text has none."""
    texts = pc.fill_null(texts, "")
    words = np.fromiter((len(t.as_py().split()) for t in texts), np.int64, len(texts))
    counts = [pc.count_substring(texts, mark).to_numpy(zero_copy_only=False) for mark in ("?", "!", ".", "...")]
    out = np.stack([words, *counts], axis=1).astype(np.int64)
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * out.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))


def structural_features(
    df: DataFrame, column: str = "text_normalized", also: Mapping[str, Column] | None = None
) -> DataFrame:
    """Adds length, punctuation and sentence features of a text, which is read once in Arrow batches.

    `also` are columns of other Arrow functions of the text, run in the same pass.

    Standardised texts have no ellipses left: the column `ellipsis_count`, if there
    is one, holds those from before.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    # Called anything but deterministic, it isn't run again for each of its numbers.
    marks = F.arrow_udf(_marks, "array<long>").asNondeterministic()(F.col(column))
    m = F.col("_marks")
    return (
        df.withColumns({"_marks": marks, **(also or {})})
        .withColumns(
            {
                "feat_word_count": m[0],
                "feat_char_count": F.length(text).cast("long"),
                "feat_question_marks": m[1],
                "feat_exclamation": m[2],
                "feat_sentence_count": F.greatest(F.lit(1).cast("long"), m[1] + m[2] + m[3]),
                "feat_ellipsis": F.coalesce("ellipsis_count", F.lit(0)).cast("long")
                if "ellipsis_count" in df.columns
                else m[4],
            }
        )
        .withColumn("feat_avg_sentence_len", F.col("feat_word_count") / F.col("feat_sentence_count"))
        .drop("_marks")
    )


def feature_table(
    posts: DataFrame,
    scores: DataFrame | None = None,
    categories: Iterable[str] = TOP_LEVEL_CATEGORIES,
    column: str = "text_normalized",
    key: str = "topic_id",
) -> DataFrame:
    """Structural features, and the top-level lexicon scores as feat_liwc_<name>."""
    features = structural_features(posts, column)
    return features if scores is None else with_lexicon(features, scores, categories, key)


def with_lexicon(
    features: DataFrame, scores: DataFrame, categories: Iterable[str] = TOP_LEVEL_CATEGORIES, key: str = "topic_id"
) -> DataFrame:
    """Adds the top-level lexicon scores as feat_liwc_<name>."""
    if key not in scores.columns:
        raise ValueError(f"lexicon scores need a column {key}")
    wanted = set(categories)
    kept = [c for c in scores.columns if c in wanted and c != key]
    renamed = scores.select(key, *[F.col(c).alias(f"feat_liwc_{c}") for c in kept])
    return features.join(renamed, key, "left")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("feat_")]


def anova_scores(
    df: DataFrame,
    features: Sequence[str],
    label: str = "thread_label",
    keep: int = SELECTED_FEATURES,
) -> DataFrame:
    """ANOVA F value per feature, its p-value, and whether it is among the best `keep`.

    One aggregation gives size, mean and variance per class and feature; the rest
    is arithmetic on that small table. A constant feature has no F value and
    ranks last; missing values count as 0.
    """
    long = (
        df.select(label, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
        .groupBy(label)
        .agg(
            F.count("*").alias("_n"),
            *[F.avg(f).alias(f"_m_{f}") for f in features],
            *[F.var_pop(f).alias(f"_v_{f}") for f in features],
        )
        .select(
            F.col("_n").alias("n"),
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(f).alias("feature"),
                            F.col(f"_m_{f}").alias("mean"),
                            F.col(f"_v_{f}").alias("var"),
                        )
                        for f in features
                    ]
                )
            ),
        )
    )
    n, mean = F.col("n"), F.col("mean")
    sums = long.groupBy("feature").agg(
        F.sum(n).alias("total"),
        F.count("*").alias("classes"),
        (F.sum(n * mean) / F.sum(n)).alias("grand"),
        F.sum(n * F.col("var")).alias("within"),
        F.collect_list(F.struct("n", "mean")).alias("groups"),
    )
    between = F.aggregate(
        "groups",
        F.lit(0.0),
        lambda acc, g: acc + g["n"] * (g["mean"] - F.col("grand")) * (g["mean"] - F.col("grand")),
    )
    free_between = F.col("classes") - 1
    free_within = F.col("total") - F.col("classes")
    scored = sums.select(
        "feature",
        F.when(
            (F.col("within") > 0) & (free_between > 0) & (free_within > 0),
            (between / free_between) / (F.col("within") / free_within),
        ).alias("f_score"),
        free_between.alias("free_between"),
        free_within.alias("free_within"),
    ).withColumn("p_value", f_test(F.col("f_score"), F.col("free_between"), F.col("free_within")))
    best_first = Window.orderBy(F.col("f_score").desc_nulls_last(), "feature")
    return scored.withColumn("rank", F.row_number().over(best_first).cast("long")).select(
        "feature", "f_score", "p_value", "rank", (F.col("rank") <= keep).alias("selected")
    )


def terms(column: str) -> Column:
    """Array of the words of two or more characters and of pairs of neighbours."""
    tokens = F.regexp_extract_all(
        F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(rf"[{tx.WORD}]{{2,}}"), F.lit(0)
    )
    return F.transform(
        F.array(tokens),
        lambda t: F.concat(
            t,
            F.filter(
                F.zip_with(
                    t,
                    F.slice(t, 2, F.greatest(F.size(t), F.lit(1))),
                    lambda a, b: F.concat(a, F.lit(" "), b),
                ),
                lambda pair: pair.isNotNull(),
            ),
        ),
    )[0]


def vocabulary(texts: DataFrame, column: str, size: int) -> DataFrame:
    """(term, total, texts) of the `size` most frequent terms.

    Equally frequent terms are taken in alphabetical order. What is shuffled are
    counts per term, added up before; never the terms of single texts.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    in_text = F.concat(
        F.transform("_terms", lambda t: F.struct(t.alias("term"), one.alias("n"), none.alias("d"))),
        F.transform(
            F.array_distinct("_terms"),
            lambda t: F.struct(t.alias("term"), none.alias("n"), one.alias("d")),
        ),
    )
    return (
        texts.select(terms(column).alias("_terms"))
        .select(F.inline(in_text))
        .groupBy("term")
        .agg(F.sum("n").alias("total"), F.sum("d").alias("texts"))
        .orderBy(F.col("total").desc(), "term")
        .limit(size)
    )


def tfidf_terms(
    texts: DataFrame,
    key: str,
    column: str = "text_normalized",
    size: int = 5000,
) -> DataFrame:
    """(key, term, weight) over the most frequent words and word pairs.

    weight = n * (ln((1 + texts) / (1 + texts with the term)) + 1), scaled to
    length 1 per text. The vocabulary has at most `size` rows and is broadcast;
    other terms are dropped before anything is shuffled. A text has at most
    `size` terms, so the window is small.
    """
    known = vocabulary(texts, column, size)
    all_texts = texts.agg(F.count("*")).scalar()
    idf = F.log((1 + all_texts) / (1 + F.col("texts"))) + 1
    weighted = (
        texts.select(key, F.explode(terms(column)).alias("term"))
        .join(F.broadcast(known.select("term", idf.alias("_idf"))), "term")
        .groupBy(key, "term")
        .agg((F.count("*") * F.first("_idf")).alias("_w"))
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("_w") / norm).alias("weight"))
