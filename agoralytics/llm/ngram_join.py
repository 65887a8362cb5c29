"""Similarity join on sets of word n-grams: MinHash banding, then the full sets.

Texts with equal sets form one copy class and are compared once, as their smallest
doc_id. Band keys link each class to the smallest class in the same bucket, so a bucket
of any size gives a linear number of links; the components of these links hold every
candidate pair. Each component is compared on the full n-gram sets, in blocks of bounded
size: counts leave a block, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.llm import bit_filter
from agoralytics.llm.common import SMALL, chunks, cut_lineage, mix, shingles, texts_of, word_hashes
from agoralytics.llm.components import components

#: Classes and n-grams in one block of a large component.
BLOCK_CLASSES, BLOCK_GRAMS = 1_500, 1_500_000


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which enough bands reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, hashes + 1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - share))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """doc_id, digest of the n-gram set (low, high, grams) and one key per band.

    Texts without words have no grams and no keys.
    """
    pick = np.random.default_rng(20_011)
    factors = pick.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    shifts = pick.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, first = shingles(*word_hashes(batch.column("text")), width)
        n = batch.num_rows
        low, high, sizes = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for i in range(n):
            own = np.unique(grams[first[i] : first[i + 1]])
            low[i], high[i] = own.sum(dtype=np.uint64), mix(own + np.uint64(7)).sum(dtype=np.uint64)
            sizes[i] = len(own)
        full = np.flatnonzero(np.diff(first))
        keys = np.zeros((len(full), bands), np.uint64)
        if len(full):
            short, at = (grams >> np.uint64(32)).astype(np.uint32), first[full]
            for band in range(bands):
                key = np.full(len(full), band, np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    key = mix(key * np.uint64(31) + np.minimum.reduceat(short * factors[k] + shifts[k], at))
                keys[:, band] = key
        ends = np.zeros(n + 1, np.int32)
        ends[1:] = np.cumsum(np.diff(first) > 0) * bands
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
        columns = [batch.column("doc_id"), low.view(np.int64), high.view(np.int64), sizes, lists]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "low", "high", "grams", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=SMALL):
                yield sign(part)

    return texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        run, "doc_id long, low long, high long, grams long, bands array<long>"
    )


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets of `left` (rows) and of `right` (columns) have enough of their union in common."""
    sizes = np.array([len(s) for s in sets], np.int64)
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.flatnonzero(np.bincount(column, minlength=len(grams)) > 1)
    place = np.full(len(grams), -1, np.int64)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, (begin, begin + 4096))
        has = np.zeros((len(sets), min(4096, len(shared) - begin)), np.float32)
        has[owner[a:b], column[a:b] - begin] = 1
        common += has[left] @ has[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= threshold * union - 1e-6


def _roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row it is connected with."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, width: int):
    """Compares the classes of one unit: each of its components, or one pair of blocks."""

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in unit.groupby("label", sort=False):
            part = part.drop_duplicates("id").sort_values("id", ignore_index=True)  # rows may repeat
            sets = []
            for batch in chunks(pa.RecordBatch.from_arrays([pa.array(part["text"], pa.string())], ["text"]), most=SMALL):
                grams, first = shingles(*word_hashes(batch.column("text")), width)
                sets += [np.unique(grams[first[i] : first[i + 1]]) for i in range(batch.num_rows)]
            block, one = part["block"].to_numpy(), part["low_block"].iloc[0] == part["high_block"].iloc[0]
            everyone = np.arange(len(part))
            left = everyone if one else np.flatnonzero(block == part["low_block"].iloc[0])
            right = everyone if one else np.flatnonzero(block != part["low_block"].iloc[0])
            if not len(left) or not len(right):
                continue
            found = _similar(sets, left, right, threshold)
            near = np.zeros((len(part), len(part)), bool)
            near[np.ix_(left, right)] = found
            near |= near.T
            np.fill_diagonal(near, False)
            ids, copies = part["id"].to_numpy(), part["copies"].to_numpy()
            out.append(pd.DataFrame({"id": ids, "root": ids[_roots(near)], "classes": near.sum(axis=1), "documents": near @ copies}))
        empty = pd.DataFrame({"id": [], "root": [], "classes": [], "documents": []})
        return (pd.concat(out) if out else empty).astype("int64")

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, hashes: int = 128
) -> DataFrame:
    """One row per row of documents(doc_id, text): its copy class, its near-duplicate class, its links.

    copy_id: smallest doc_id with the same set of n-grams; copies: rows with that set.
    class_id: smallest doc_id that a chain of similar texts (Jaccard >= threshold) leads to.
    n_links: other rows whose set is similar, copies included; n_class_links: other copy
    classes that are similar. A missing text is an empty one; a text without words is a
    class and a copy class of its own, without links. Rows with equal id and text count
    as copies; an id that is null never names a class unless no copy has one. Other columns of the
    input don't matter. No rows give no rows.
    """
    bands, rows = choose_bands(threshold, recall, hashes)
    signed = cut_lineage(signatures(docs, bands, rows, width))
    digest = ["low", "high", "grams"]
    full = signed.where("grams > 0")
    classes = full.groupBy(*digest).agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"))
    members = cut_lineage(full.select("doc_id", *digest).join(classes, digest).select("doc_id", "copy_id", "copies", "grams"))
    heads = members.where("doc_id = copy_id").select(F.col("doc_id").alias("id"), "copies", "grams").distinct()
    keys = cut_lineage(
        full.join(heads.select(F.col("id").alias("doc_id")), "doc_id").select("doc_id", F.explode("bands").alias("key")).distinct()
    )
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = keys.join(hubs, "key").where("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct()
    found = cut_lineage(components(links).join(heads, "id"))
    counted = _count(found, docs, threshold, width)
    groups = components(counted.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    totals = counted.groupBy("id").agg(F.sum("classes").alias("classes"), F.sum("documents").alias("documents"))
    joined = totals.join(groups, "id", "left").withColumnRenamed("id", "copy_id")
    result = members.join(joined, "copy_id", "left").select(
        "doc_id",
        F.coalesce("label", "copy_id").alias("class_id"),
        "copy_id",
        "copies",
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("classes", F.lit(0)).alias("n_class_links"),
        F.col("grams").alias("n_grams"),
    )
    zero = F.lit(0).cast("long")
    alone = signed.where("grams = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"),
        F.lit(1).cast("long").alias("copies"), zero.alias("n_links"), zero.alias("n_class_links"), "grams",
    )
    return result.union(alone)


def _count(found: DataFrame, docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """(id, root, classes, documents) per id and block; found: (id, label, copies, grams)."""
    sizes = found.groupBy("label").agg(F.count("*").alias("n"), F.sum("grams").alias("total"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_GRAMS))
    placed = found.join(sizes.select("label", parts.alias("parts")), "label")
    total = found.agg(F.sum("grams")).head()[0] or 0
    bins = max(found.sparkSession.sparkContext.defaultParallelism, math.ceil(total / BLOCK_GRAMS))
    placed = placed.select(
        "id", "label", "copies", "parts", F.expr("pmod(xxhash64(id, 3), parts)").alias("block"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.col("label")).alias("unit"),
    )
    placed = cut_lineage(placed)
    texts = texts_of(docs, F.col("doc_id").cast("long").alias("id")).where(bit_filter.may_hold(placed, "id")).join(placed, "id")
    spread = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "id", "label", "copies", "text", "unit", "parts", "block",
        F.least("block", "other").alias("low_block"), F.greatest("block", "other").alias("high_block"),
    )
    by = ["parts", "unit", "low_block", "high_block"]
    one = F.when(F.col("parts") == 1, F.lit(1)).otherwise(F.col("parts"))
    units = spread.withColumn("parts", one).groupBy(*by)
    return cut_lineage(units.applyInPandas(_compare(threshold, width), "id long, root long, classes long, documents long"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of documents that stay: of each near-duplicate class the one with the smallest doc_id.

    Rows with a null id stay. Repeats of one row stay together; exact dedup removes them.
    """
    dropped = near_duplicates(docs, **settings).where("doc_id != class_id").select("doc_id").distinct()
    return bit_filter.drop_ids(docs, cut_lineage(dropped))
