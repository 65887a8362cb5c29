"""Scores of texts against a word-category dictionary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from agoralytics.config import KEY_CATEGORIES
from agoralytics.functions import text as tx

# Dictionary entries up to which each lookup table is broadcast.
BROADCAST_ENTRIES = 200_000
# Words whose hits a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 100_000, 40

_PUNCTUATION = re.compile(r"[^\w\s]+")


def split_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact terms and prefixes."""
    return (
        entries.filter("not is_prefix").select("term", "cat_ids"),
        entries.filter("is_prefix").select("term", "cat_ids"),
    )


def tokens(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, token): lower-case words without punctuation, empty ones left out."""
    bare = F.regexp_replace(F.lower(F.col(column)), rf"(?U)[^{tx.WORD}{tx.SPACE}]+", "")
    return texts.select(key, F.explode(tx.words(bare)).alias("token"))


def match_tokens(
    found: DataFrame, entries: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES
) -> DataFrame:
    """Adds cat_ids: of the exact term, else of the longest prefix; NULL if none.

    A dictionary of checked size is broadcast, once for the exact terms and once
    per prefix length that occurs, and each token is looked up in place: no
    shuffle, so frequent words cannot skew it. A larger dictionary is joined to
    the distinct tokens, and the result joined back.
    """
    entries = entries.select("term", "is_prefix", "cat_ids")
    sizes = entries.groupBy(
        "is_prefix", F.when(F.col("is_prefix"), F.length("term")).alias("length")
    ).count()
    rows = sizes.collect()
    lengths = sorted((r["length"] for r in rows if r["is_prefix"]), reverse=True)
    if sum(r["count"] for r in rows) <= broadcast_entries:
        return _look_up(found, entries, lengths, F.broadcast)
    vocabulary = found.select("token").distinct()
    matched = _look_up(vocabulary, entries, lengths, lambda df: df)
    return found.join(matched, "token", "left")


def _look_up(
    found: DataFrame, entries: DataFrame, lengths: Sequence[int], send
) -> DataFrame:
    exact, prefixes = split_entries(entries)
    columns = found.columns
    out = found.join(
        send(exact.select(F.col("term").alias("token"), F.col("cat_ids").alias("_exact"))),
        "token",
        "left",
    )
    hits: list[Column] = [F.col("_exact")]
    for n in lengths:
        head = F.when(F.length("token") >= n, F.substring("token", 1, n))
        table = prefixes.filter(F.length("term") == n).select(
            F.col("term").alias(f"_term{n}"), F.col("cat_ids").alias(f"_cats{n}")
        )
        out = out.join(send(table), head == F.col(f"_term{n}"), "left")
        hits.append(F.col(f"_cats{n}"))
    return out.select(*columns, F.coalesce(*hits).alias("cat_ids"))


class WordHits:
    """How often the word of a text hits each category: by the exact term, else by the longest prefix.

    The same as `match_tokens`, entries that come twice included, but a word is looked up once.
    """

    def __init__(self, entries: Iterable[Row], categories: Sequence[int]):
        self.categories = list(categories)
        self.tables: dict[int | None, dict[str, list]] = {}
        for row in entries:
            if row.term is not None and row.is_prefix is not None:
                length = len(row.term) if row.is_prefix else None
                self.tables.setdefault(length, {}).setdefault(row.term, []).append(row.cat_ids)
        self.lengths = sorted((n for n in self.tables if n is not None), reverse=True)
        self.exact = self.tables.get(None, {})
        self.shortest = min(self.lengths, default=0)
        self.starts = {term[: self.shortest] for n in self.lengths for term in self.tables[n]}
        self.held: dict[str, list[tuple[int, int]]] = {}

    def _look_up(self, token: str) -> list[tuple[int, int]]:
        found: list = [None]
        heads = [(self.exact, token)]
        heads += [(self.tables[n], token[:n]) for n in self.lengths if len(token) >= n]
        for table, head in heads:
            if listed := table.get(head):
                found = [f if f is not None else cats for f in found for cats in listed]
        sums = [sum(list(f).count(c) for f in found if f is not None) for c in self.categories]
        return [(i, n) for i, n in enumerate(sums) if n]

    def of(self, word: str) -> list[tuple[int, int]]:
        """(place of the category, hits) of a word in lower case; most words hit none and aren't remembered."""
        token = word if word.isalnum() else _PUNCTUATION.sub("", word)
        if not token or (token not in self.exact and token[: self.shortest] not in self.starts):
            return []
        if token in self.held:
            return self.held[token]
        hits = self._look_up(token)
        if len(token) <= LONGEST:
            if len(self.held) >= REMEMBERED:
                self.held.clear()
            self.held[token] = hits
        return hits

    def count(self, texts: pa.Array) -> pa.Array:
        """Per text the number of its words and the hits of each category."""
        out: list[int] = []
        for text in texts:
            words = (text.as_py() or "").lower().split()
            own = [0] * len(self.categories)
            for word, n in Counter(words).items():
                for i, hits in self.of(word):
                    own[i] += n * hits
            out += [len(words), *own]
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (1 + len(self.categories)))
        return pa.ListArray.from_arrays(offsets, pa.array(out, pa.int64()))


def small_dictionary(entries: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> list[Row] | None:
    """The entries, if there are few enough to go to every task."""
    some = entries.select("term", "is_prefix", "cat_ids").limit(broadcast_entries + 1).collect()
    return some if len(some) <= broadcast_entries else None


def hit_counts(spark: SparkSession, entries: Sequence[Row], categories: Sequence[int], column: str) -> Column:
    """Array of the number of words of a text and the hits of each category; each text is read once, in its task."""
    shared = spark.sparkContext.broadcast(entries)
    held: list[WordHits] = []

    def count(values: pa.Array) -> pa.Array:
        if not held:
            held.append(WordHits(shared.value, categories))
        return held[0].count(values)

    # Called anything but deterministic, it isn't run again for each of its numbers.
    return F.arrow_udf(count, "array<long>").asNondeterministic()(F.col(column))


def with_scores(counted: DataFrame, categories: Mapping[int, str], key: str, prefix: str = "") -> DataFrame:
    """Adds WC and the scores, from hit_counts in `_n`, of rows none of which shares its key; rows without a key have none."""
    known = F.col(key).isNotNull()
    numbers = counted.withColumns(
        {"WC": F.when(known, F.col("_n")[0]), **{f"_hits{c}": F.when(known, F.col("_n")[i + 1]) for i, c in enumerate(categories)}}
    )
    scores = {name: F.when(known, score) for name, score in zip(categories.values(), _scores(categories), strict=True)}
    return numbers.withColumns({f"{prefix}{name}": value for name, value in {"WC": F.col("WC"), **scores}.items()}).drop(
        "_n", *[f"_hits{c}" for c in categories], *(["WC"] if prefix else [])
    )


def scores_of_counts(counted: DataFrame, categories: Mapping[int, str], key: str) -> DataFrame:
    """(key, WC, scores) from hit_counts in `_n`; rows of one key add up their hits."""
    same_key = Window.partitionBy(key)
    numbers = counted.select(
        key,
        F.col("_n")[0].alias("WC"),
        *[
            F.when(F.col(key).isNotNull(), F.sum(F.col("_n")[i + 1]).over(same_key)).alias(f"_hits{c}")
            for i, c in enumerate(categories)
        ],
    )
    return _scored(numbers, categories, key)


def _scores(categories: Mapping[int, str]) -> list[Column]:
    return [
        F.when(
            F.col("WC") > 0,
            F.round(100 * F.coalesce(f"_hits{cat_id}", F.lit(0)) / F.col("WC"), 4),
        ).otherwise(0.0)
        for cat_id in categories
    ]


def _scored(numbers: DataFrame, categories: Mapping[int, str], key: str) -> DataFrame:
    named = zip(_scores(categories), categories.values(), strict=True)
    return numbers.select(key, "WC", *[score.alias(name) for score, name in named])


def unique_names(categories: Mapping[int, str]) -> None:
    if len(set(categories.values())) < len(categories):
        raise ValueError("category names must be unique")


def lexicon_scores(
    texts: DataFrame,
    entries: DataFrame,
    categories: Mapping[int, str],
    key: str = "topic_id",
    column: str = "text_normalized",
    broadcast_entries: int = BROADCAST_ENTRIES,
    in_place: bool = False,
) -> DataFrame:
    """Per text the word count WC and the percentage of words per category.

    Words count with their punctuation; a category listed twice for a word counts
    twice. Texts without words have zeros. `key` must be unique. With `in_place`, a
    dictionary of up to `broadcast_entries` entries goes to every task, which looks up a
    text's words in Arrow batches; otherwise each word is a row that is joined.
    """
    unique_names(categories)
    some = small_dictionary(entries, broadcast_entries) if in_place else None
    if some is not None:
        numbers = hit_counts(texts.sparkSession, some, list(categories), column)
        return scores_of_counts(texts.select(key, numbers.alias("_n")), categories, key)
    matched = match_tokens(tokens(texts, key, column), entries, broadcast_entries)

    def hits(cat_id: int) -> Column:
        listed = F.size(F.filter("cat_ids", lambda c: c == cat_id))
        return F.sum(listed).alias(f"_hits{cat_id}")

    counts = (
        matched.filter("cat_ids is not null")
        .groupBy(key)
        .agg(*[hits(cat_id) for cat_id in categories])
    )
    counted = texts.select(key, tx.word_count(column).alias("WC")).join(counts, key, "left")
    return _scored(counted, categories, key)


def lexicon_means(
    scores: DataFrame, categories: Sequence[str] = KEY_CATEGORIES
) -> DataFrame:
    """Mean score per key category the dictionary has, as (category, mean_score)."""
    known = [c for c in categories if c in scores.columns]
    means = scores.agg(*[F.round(F.avg(c), 3).cast("double").alias(c) for c in known])
    return means.unpivot([], known, "category", "mean_score")
