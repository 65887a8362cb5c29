"""Language detection by character n-grams.

Profiles are counted from texts whose language is known: how often each run of letters
occurs in a language, word edges included. A text goes to the language that makes its
runs likeliest (naive Bayes with equal priors). Weights are whole numbers, so that sums do
not depend on their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters per run (three at most), and the most frequent runs over all languages that profiles keep.
WIDTH, KEPT = 3, 5_000

UNKNOWN = "unknown"


def letters(text: Column | str) -> Column:
    """The words of a text in lower case, one space around each."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), F.lit(" "))


def language_profiles(texts: DataFrame, column: str, language: str, width: int = WIDTH, kept: int = KEPT) -> DataFrame:
    """(language, gram, weight): for the `kept` most frequent runs, 1000 times the log of their share in each language.

    Runs lie inside one word with its edges. Words are counted before they are cut, so what is shuffled are
    distinct words and then distinct runs. Every kept run has a row for every language; texts without a
    language or without letters don't count.
    """
    words = (
        texts.where(F.col(language).isNotNull())
        .select(F.col(language).alias("language"), F.explode(F.split(F.trim(letters(column)), " ")).alias("word"))
        .where("word != ''").groupBy("language", "word").agg(F.count("*").alias("n"))
    )
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    runs = F.transform(F.sequence(F.lit(1), F.length(padded) - (width - 1)), lambda i: F.substring(padded, i, F.lit(width)))
    counted = (
        words.where(F.length(padded) >= width).select("language", F.explode(runs).alias("gram"), "n")
        .groupBy("language", "gram").agg(F.sum("n").alias("n"))
    )
    best = counted.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.col("all").desc(), "gram").limit(kept).select("gram")
    some = counted.join(F.broadcast(best), "gram")  # `kept` rows
    totals = some.groupBy("language").agg(F.sum("n").alias("total"))
    # Languages are few: every run gets the list of them.
    every = totals.agg(F.collect_list(F.struct("language", "total")).alias("every"), F.lit(1).alias("one"))
    grid = best.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").select("gram", F.inline("every"))
    share = (F.coalesce("n", F.lit(0)) + 1).cast("double") / (F.col("total") + kept).cast("double")
    return grid.join(some, ["language", "gram"], "left").select(
        "language", "gram", F.floor(1000 * F.log(share)).alias("weight")
    )


def detect_by_profiles(df: DataFrame, column: str, profiles: DataFrame, name: str = "language") -> DataFrame:
    """Adds the likeliest language of each text; 'unknown' for one that is missing or has no run that a profile knows.

    Equal languages go to the first in alphabetical order. The profiles are collected: KEPT runs per language.
    """
    rows = profiles.collect()
    names = sorted({r.language for r in rows})
    grams = sorted({r.gram for r in rows})
    width = len(grams[0]) if grams else WIDTH
    codes = np.array([_code(np.array(list(map(ord, g)), np.int64)[None, :])[0] for g in grams], np.int64)
    order = np.argsort(codes)
    place = {g: i for i, g in enumerate(grams)}
    weights = np.zeros((len(grams), len(names)), np.int64)
    for r in rows:
        weights[place[r.gram], names.index(r.language)] = r.weight
    shared = df.sparkSession.sparkContext.broadcast((codes[order], weights[order]))

    def best(texts: pa.Array) -> pa.Array:
        known, weight = shared.value
        out = []
        for text in texts.to_pylist():
            points = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64)
            if not len(known) or len(points) < width:
                out.append(UNKNOWN)
                continue
            runs = np.lib.stride_tricks.sliding_window_view(points, width)
            runs = _code(runs[(runs[:, 1:-1] != 32).all(axis=1)])  # a space in the middle: two words
            at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            at = at[known[at] == runs]
            out.append(names[int(weight[at].sum(axis=0).argmax())] if len(at) else UNKNOWN)
        return pa.array(out, pa.string())

    return df.withColumn(name, F.arrow_udf(best, "string")(letters(column)))


def _code(runs: np.ndarray) -> np.ndarray:
    """One number per run of characters; a character takes 21 bits, so runs of three are told apart exactly."""
    out = np.zeros(len(runs), np.int64)
    for column in runs.T:
        out = (out << 21) | column
    return out


def language_filter(df: DataFrame, column: str, profiles: DataFrame, target: str) -> DataFrame:
    """The rows whose text is likeliest in the target language."""
    return detect_by_profiles(df, column, profiles, "_language").where(F.col("_language") == target).drop("_language")
