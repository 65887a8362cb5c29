"""Exact dedup by an exchange of Golomb-coded fingerprints.

Senders (slices of the scan) send each owner of a fingerprint range its sorted distinct
fingerprints as Golomb-coded gaps. Owners answer each message with a bitmap of the
fingerprints that another message holds too. Only the texts of suspects are shuffled
then, and compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.llm import bit_filter
from agoralytics.llm.common import cut_lineage

#: Rows that one sender answers for (a power of two), and fingerprints that one owner looks after.
SLICE_BITS, OWNED = 20, 1_000_000

#: What counts as white space.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def golomb_encode(values: np.ndarray, span: int) -> tuple[bytes, int]:
    """Sorted distinct values below `span` as Golomb-Rice coded gaps; also the bits of a remainder.

    All quotients in unary (ones ended by a zero) come first, then all remainders.
    """
    gaps = np.diff(values, prepend=np.uint64(0))
    bits = max(0, int(math.log2(max(1.0, 0.69 * span / max(1, len(values))))))
    high = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(high + 1)
    unary = np.ones(ends[-1] if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    low = (gaps[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)
    return np.packbits(np.concatenate([unary, low.astype(np.uint8).ravel()])).tobytes(), bits


def golomb_decode(payload: bytes, count: int, bits: int) -> np.ndarray:
    """The values back; `count` and `bits` as they were coded."""
    stream = np.unpackbits(np.frombuffer(payload, np.uint8))
    ends = np.flatnonzero(stream == 0)[:count]
    high = np.diff(ends, prepend=-1) - 1
    start = ends[-1] + 1 if count else 0
    low = stream[start : start + count * bits].reshape(count, bits).astype(np.uint64)
    gaps = (high.astype(np.uint64) << np.uint64(bits)) + (low << np.arange(bits, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sha (32 bytes of the normalised text), mark (64 bits of it), row and sender; written once."""
    sha = F.sha2(normalised(F.col("text")), 256)
    return cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(sha).alias("sha"), F.monotonically_increasing_id().alias("row"))
        .select("doc_id", "sha", "row", F.xxhash64("sha").alias("mark"), F.shiftright("row", SLICE_BITS).alias("sender"))
    )


def _message_of(marks: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct marks, where each owner's begin, and which marks occur more than once."""
    values, counts = np.unique(marks.view(np.uint64), return_counts=True)
    step = (1 << 64) // owners + 1
    edges = np.array([min(i * step, (1 << 64) - 1) for i in range(1, owners)], np.uint64)
    return values, np.concatenate([[0], np.searchsorted(values, edges), [len(values)]]), counts > 1


def exchange(marks: DataFrame, owners: int) -> DataFrame:
    """(doc_id, suspect) rows of marks(doc_id, mark, sender) whose mark another row has too; the rest is left out."""
    step = (1 << 64) // owners + 1

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        values, begins, _ = _message_of(rows["mark"].to_numpy(), owners)
        out = []
        for owner in np.flatnonzero(np.diff(begins)):
            own = values[begins[owner] : begins[owner + 1]] - np.uint64(int(owner) * step)
            payload, bits = golomb_encode(own, step)
            out.append((int(owner), rows["sender"].iloc[0], len(own), bits, payload))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "bits", "payload"])

    def answer(messages: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(m.payload, m.n, m.bits) for m in messages.itertuples()]
        values, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = (counts > 1)[place]
        ends = np.cumsum([len(x) for x in lists])
        return pd.DataFrame({
            "owner": messages["owner"], "sender": messages["sender"],
            "bitmap": [np.packbits(x).tobytes() for x in np.split(twice, ends[:-1])],
        })

    def receive(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        values, begins, suspect = _message_of(rows["mark"].to_numpy(), owners)
        for a in answers.itertuples():
            n = begins[a.owner + 1] - begins[a.owner]
            suspect[begins[a.owner] : begins[a.owner + 1]] |= np.unpackbits(np.frombuffer(a.bitmap, np.uint8))[:n].astype(bool)
        found = suspect[np.searchsorted(values, rows["mark"].to_numpy().view(np.uint64))]
        return rows.loc[found, ["row"]]

    messages = marks.select("mark", "sender").groupBy("sender").applyInPandas(send, "owner int, sender long, n long, bits int, payload binary")
    answers = messages.groupBy("owner").applyInPandas(answer, "owner int, sender long, bitmap binary")
    return marks.select("row", "mark", "sender").groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(receive, "row long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, first.

    Texts are equal when they are the same bytes after each run of white space became one
    space; a missing text is an empty one. keep_id is the smallest doc_id of equal texts
    (null only if all are), kept marks the rows that carry it. Of rows that repeat with
    one id, or whose ids are all null, `first` is true for one only. Other columns don't
    matter; no rows give no rows.
    """
    marks = fingerprints(docs)
    owners = max(8, math.ceil(marks.count() / OWNED))
    suspects = cut_lineage(exchange(marks, owners).join(marks, "row").select("doc_id", "sha", "row"))
    ids = suspects.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    verified = (
        bit_filter.keep_ids(texts, ids)
        .groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    heads = suspects.groupBy("sha").agg(F.min(order)["row"].alias("head"))
    classes = verified.where("group_size > 1").join(heads, "sha")
    group = F.coalesce("group_size", F.lit(1).cast("long"))
    return marks.join(classes, "sha", "left").select(
        "doc_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        group.alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("head").isNull() | (F.col("row") == F.col("head"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        (F.col("head").isNull() | (F.col("row") == F.col("head"))).alias("first"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of documents that stay: of equal texts one row, that with the smallest doc_id.

    Rows with a null id stay unless an equal text with an id, or an earlier such row, does.
    """
    found = cut_lineage(exact_duplicates(docs))
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    left = bit_filter.drop_ids(docs, gone)
    if found.where("not first and (kept or doc_id is null)").isEmpty():
        return left
    # Only here rows repeat with one id or have none: one row of each text stays.
    return (
        left.withColumn("_sha", F.sha2(normalised(F.col("text")), 256))
        .withColumn("_held", F.row_number().over(_by_text()))
        .where("_held = 1").drop("_sha", "_held")
    )


def _by_text():
    from pyspark.sql import Window

    return Window.partitionBy("_sha").orderBy(F.col("doc_id").asc_nulls_last())
