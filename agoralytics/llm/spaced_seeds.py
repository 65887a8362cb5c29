"""Benchmark decontamination by spaced seeds over word hashes.

A fixed mask looks at some words of a span and ignores the others, so a seed still hits
where ignored words were substituted. Test and training seeds are joined on their
hashes, and around each hit the words are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.llm import bit_filter
from agoralytics.llm.common import SMALL, chunks, cut_lineage, mix, texts_of, word_hashes

#: 1 looks at a word, 0 ignores it. Wherever a fifth of 8 to 20 words in a row is
#: substituted at most, one of them looks at equal words only (the tests try every placement).
MASKS = ("111111", "1111011", "11001111", "110101011", "110110011")
#: Words of the shortest and of the longest mask, and of the shortest item that masks can find.
LEAST, MOST, SHORT = 6, 9, 8


def _seeds(words: np.ndarray, begins: np.ndarray, lengths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, first words) per mask, then per plain run of each of the lengths below SHORT."""
    counts = np.diff(begins)
    text = np.repeat(np.arange(len(counts)), counts)
    factors = mix(np.arange(1, MOST + 1, dtype=np.uint64)) | np.uint64(1)
    out = []
    for kind, mask in enumerate([*MASKS, *("1" * n for n in lengths)]):
        n = max(0, len(words) - len(mask) + 1)
        at = np.flatnonzero(text[:n] == text[len(mask) - 1 :][:n])
        value = np.full(n, len(mask) * 10 + min(kind, len(MASKS)), np.uint64)
        for j, used in enumerate(mask):
            if used == "1":
                value += words[j : j + n] * factors[j]
        out.append((mix(value[at]), at))
    return out


def _around(words: np.ndarray, begins: np.ndarray, at: np.ndarray, before: int, width: int) -> pa.Array:
    """Lists of `width` words, beginning `before` words before each place; null outside its text."""
    text = np.searchsorted(begins, at, side="right") - 1
    places = at[:, None] - before + np.arange(width)[None, :]
    known = (places >= begins[text][:, None]) & (places < begins[text + 1][:, None])
    values = words[np.clip(places, 0, max(0, len(words) - 1))].view(np.int64) if len(words) else np.zeros((0, width), np.int64)
    flat = pa.array(values.ravel(), mask=~known.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), flat)


def test_seeds(benchmark: DataFrame, window: int) -> DataFrame:
    """seed, item_id, item_at, item_words, context of every item, long items by all masks, short ones whole."""
    before, width = window - LEAST, 2 * window - LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, most=SMALL)):
            words, begins = word_hashes(batch.column("text"))
            counts = np.diff(begins)
            item = np.repeat(np.arange(len(counts)), counts)
            short = [n for n in range(1, SHORT) if (counts == n).any()]
            for k, (seeds, at) in enumerate(_seeds(words, begins, short)):
                words_of = counts[item[at]]
                meant = words_of == short[k - len(MASKS)] if k >= len(MASKS) else words_of >= SHORT
                seeds, at = seeds[meant], at[meant]
                own = item[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds.view(np.int64)), batch.column("item_id").take(pa.array(own)), pa.array(at - begins[own]),
                     pa.array(counts[own]), _around(words, begins, at, before, width)],
                    ["seed", "item_id", "item_at", "item_words", "item_context"],
                )

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(run, "seed long, item_id long, item_at long, item_words long, item_context array<long>")


def training_seeds(docs: DataFrame, held: bytes, window: int, short: list[int]) -> DataFrame:
    """seed, doc_id, doc_at, doc_context of the places in whole texts whose seed passes the filter."""
    before, width = window - LEAST, 2 * window - LEAST
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in (part for whole in batches for part in chunks(whole, most=SMALL)):
            words, begins = word_hashes(batch.column("text"))
            for seeds, at in _seeds(words, begins, short):
                held_ones = bit_filter.hit(bits, seeds)
                seeds, at = seeds[held_ones], at[held_ones]
                if not len(at):
                    continue
                own = np.searchsorted(begins, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds.view(np.int64)), batch.column("doc_id").take(pa.array(own)), pa.array(at - begins[own]), _around(words, begins, at, before, width)],
                    ["seed", "doc_id", "doc_at", "doc_context"],
                )

    return texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        run, "seed long, doc_id long, doc_at long, doc_context array<long>"
    )


def _best_run(same: Column, window: int) -> Column:
    """The most equal words in any `window` neighbouring places of a list of 0 and 1."""
    starts = F.sequence(F.lit(1), F.lit(window - LEAST + 1))
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(same, s, window), F.lit(0), lambda a, x: a + x)))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 20, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, matched, compared, doc_at): test items that a document overlaps with.

    A document(doc_id, text) overlaps with an item(item_id, text) if of `window` words in a
    row, aligned one to one, at least the share `similarity` is equal; of an item with
    fewer words, of all its words (with fewer than eight, all are equal). A spaced seed
    finds each such place at 20 words and 0.8, or closer; with other settings a place
    without any seed is not found. `matched` is the largest number of equal words, doc_at the first word
    of the aligned item in the document (negative if the document begins inside it).
    Words are lower case; punctuation doesn't count. Missing and empty texts, and rows
    without an id, overlap with nothing. Repeated rows count once; empty tables give no
    rows; other columns don't matter.
    """
    tests = cut_lineage(test_seeds(benchmark.where("item_id is not null"), window))
    short = sorted(r[0] for r in tests.where(F.col("item_words") < SHORT).select("item_words").distinct().collect())
    hits = training_seeds(docs.where("doc_id is not null"), bit_filter.build(tests, "seed"), window, short).join(tests, "seed")
    same = F.zip_with("doc_context", "item_context", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    compared = F.least("item_words", F.lit(window))
    return (
        hits.select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("doc_at"), compared.alias("compared"), _best_run(same, window).cast("long").alias("matched"))
        .where(F.col("matched") >= F.ceil(similarity * F.col("compared") - 1e-9))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("matched", (-F.col("doc_at")).alias("at"), "compared")).alias("best"))
        .select("doc_id", "item_id", "best.matched", "best.compared", (-F.col("best.at")).alias("doc_at"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of documents that overlap with no test item; rows without an id stay."""
    return bit_filter.drop_ids(docs, cut_lineage(leaks(docs, benchmark, **settings).select("doc_id").distinct()))
