"""Importance resampling towards a target: documents whose n-grams look like the target's are drawn more often.

Texts are cut into words and words are coded by Arrow kernels; an n-gram is a pair of
codes, an (n-1)-gram and the word after it, coded again. Only the distinct n-grams of a
batch are hashed. Bucket counts are added up in each task and then over all tasks, so what
is gathered has the size of the buckets; gains per bucket go back to every task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.common import chunks, cut_lineage, texts_of
from agoralytics.operators.ordering import position

#: Everything that is not in a word: ASCII but for digits and lower-case letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(texts: pa.Array, width: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram up to width: the bucket of each n-gram, and how many each text has.

    Words keep their order and n-grams stay inside their text; repeats are counted.
    """
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAK)
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(words), 0)  # a text that begins or ends with a break has empty pieces there
    coded = words.filter(full).dictionary_encode()
    owner = owner.filter(full).to_numpy().astype(np.int64)
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    word = coded.indices.to_numpy().astype(np.int64)
    sums = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    tails = [b" " + name for name in names]
    gram = word
    for n in range(1, width + 1):
        if n > 1:
            inside = owner[: len(gram) - 1] == owner[n - 1 :] if len(gram) else np.zeros(0, bool)
            pairs = pa.array(gram[:-1] * len(names) + word[n - 1 :]).dictionary_encode() if len(gram) else pa.array([], pa.int64()).dictionary_encode()
            before, last = np.divmod(pairs.dictionary.to_numpy(), max(1, len(names)))
            sums = np.fromiter(map(zlib.crc32, map(tails.__getitem__, last.tolist()), sums[before].tolist()), np.uint32, len(last))
            gram = pairs.indices.to_numpy().astype(np.int64)
        else:
            inside = np.ones(len(gram), bool)
        bucket = (sums % np.uint32(buckets)).astype(np.int64)
        yield np.where(inside, bucket[gram], -1), np.bincount(owner[: len(gram)][inside], minlength=len(texts))


def bucket_counts(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; a task adds up what it reads before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch):
                for held, _ in features(part.column("text"), width, buckets):
                    total += np.bincount(held[held >= 0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts_of(docs).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, width: int, buckets: int) -> np.ndarray:
    """For every bucket 1000 times the log of how much likelier it is in the target, rounded down."""
    counts = []
    for rows in (docs, target):
        held = [0] * buckets
        for row in bucket_counts(rows, width, buckets).collect():  # a row per bucket at most
            held[row.bucket] = row.n
        counts.append(held)
    all_s, all_t = map(sum, counts)
    ratios = (float((t + 1) * (all_s + buckets)) / float((s + 1) * (all_t + buckets)) for s, t in zip(*counts, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, target: DataFrame, width: int = 2, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of documents(doc_id, text).

    weight: the mean gain of a document's features, rounded down; 0 without features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains(docs, target, width, buckets))  # one number per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.append(shared.value, 0)  # the last entry is that of pairs across two texts
        for batch in batches:
            for part in chunks(batch):
                sums, sizes, n_words = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), None
                begins = None
                for bucket, each in features(part.column("text"), width, buckets):
                    if begins is None:
                        n_words, begins = each, np.concatenate([[0], np.cumsum(each)])
                    running = np.concatenate([[0], np.cumsum(gain[bucket])])
                    at = np.minimum(begins, len(bucket))
                    sums += running[at[1:]] - running[at[:-1]]
                    sizes += each
                mean = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
                columns = [part.column("doc_id"), *map(pa.array, (n_words.astype(np.int64), sizes, mean))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    narrow = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return narrow.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, width: int = 2, buckets: int = 10_000
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of documents(doc_id, text).

    A document's score is its weight and a Gumbel draw from its id, so the highest scores are
    a draw without replacement in proportion to exp(weight / 1000). Of the N documents with at
    least `least_words` words, the floor(percent * N / 100) with the highest scores get ranks 1, 2, 3...,
    ties to the smaller doc_id; rank is null for all others. A missing text has no words, weight 0 and no
    rank; a missing id is drawn like an id without digits and comes after its ties. Rows may repeat and
    are ranked one by one. An empty target makes all words equally welcome but for their rarity; no
    documents give no rows. Other columns don't matter.
    """
    digits = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(digits, 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut_lineage(weights(docs, target, width, buckets).withColumn("score", F.col("weight") + draw))
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = position(scored.where(fit), order)
    most = placed.count() * percent // 100
    rank = F.when(F.col("position") < most, F.col("position") + 1)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).select(out).unionByName(rest.select(out))
