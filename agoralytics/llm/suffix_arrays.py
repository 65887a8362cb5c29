"""Repeated substrings of a corpus by suffix arrays over shards that hold all their partners.

Every string of LENGTH bytes has an anchor: the place of its smallest GRAM-byte hash.
Equal strings have equal anchors, so all text around places with one anchor goes to one
shard. Stretches that are equal as a whole are counted first and sent once. Each shard
sorts the suffixes of its text by induction, and permuted common prefixes tell which
strings of LENGTH bytes start more than once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.llm import bit_filter
from agoralytics.llm.common import _power, byte_view, chunks, cut_lineage, mix, texts_of
from agoralytics.llm.induced import permuted_prefixes, suffix_array

#: Bytes of a string that counts as repeated, and of the hashed grams.
LENGTH, GRAM = 400, 128

#: Bytes of text in a shard, and stretches with one anchor that a shard takes; more are compared by hashes of their strings.
SHARD, CROWD = 2_000_000, 20_000

#: Cores of LENGTH - STEP bytes are compared before suffixes are sorted.
STEP = 64


class _Sums:
    """Prefix sums of a byte string that give the hash of any part."""

    def __init__(self, data: np.ndarray, salt: int = 1):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = data.astype(np.uint64) + np.uint64(salt)
        np.cumsum((values if salt == 1 else mix(values)) * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def anchors(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of LENGTH bytes inside the texts: (hash, first string, last string, place, turns).

    Consecutive strings with one anchor are one row; of equal hashes the first place counts.
    Text that repeats itself has its anchor at every turn, and such turns are one row too.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    n, window = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    if n <= 0:
        return none
    sums = _Sums(data)
    grams = sums.of(np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1))
    low = np.uint64((1 << len(data).bit_length()) - 1)
    packed = np.full(-(-len(grams) // window) * window, np.uint64(2**64 - 1))
    packed[: len(grams)] = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    rows = packed.reshape(-1, window)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[:n]
    starts = np.flatnonzero(np.arange(n) + LENGTH <= begins[1:][text])
    if not len(starts):
        return none
    place = (np.minimum(after[starts], before[starts + window - 1]) & low).astype(np.int64)
    change = (np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-1) != 1)
    cut = np.flatnonzero(change)
    first, last, place = starts[cut], starts[np.append(cut[1:], len(starts)) - 1], place[cut]
    own = grams[place]
    fresh = np.flatnonzero((np.diff(own, prepend=own[:1] ^ np.uint64(1)) != 0) | (text[first] != np.append([-1], text[first][:-1])) | (np.diff(first, prepend=-LENGTH) > LENGTH))
    after = np.append(fresh[1:], len(first))
    return own[fresh], first[fresh], last[after - 1], place[fresh], after - fresh


def stretches(docs: DataFrame) -> DataFrame:
    """(a, b) of the text, and each stretch: anchor, digest, begin, size, turns (places of its anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole)):
            data, begins = byte_view(batch.column("text"))
            anchor, first, last, place, turns = anchors(data, begins)
            own = np.searchsorted(begins, first, side="right") - 1
            digest = _Sums(data).of(first, last + LENGTH) + mix((place - first).astype(np.uint64))
            columns = [
                batch.column("a").take(pa.array(own)), batch.column("b").take(pa.array(own)), pa.array(anchor.view(np.int64)),
                pa.array(digest.view(np.int64)), pa.array(first - begins[own]), pa.array(last - first + LENGTH),
                pa.array(turns),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "anchor", "digest", "begin", "size", "turns"])

    return docs.select("a", "b", "text").mapInArrow(run, "a long, b long, anchor long, digest long, begin long, size long, turns long")


def _pieces(part: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """The distinct text of a shard in one string, stretches of one text that overlap as one piece."""
    part = part.sort_values(["a", "b", "begin"], ignore_index=True)
    part["end"] = part["begin"] + part["size"]
    rows: list[list] = []
    for a, b, begin, end, text in zip(part["a"], part["b"], part["begin"], part["end"], part["bytes"], strict=True):
        last = rows[-1] if rows else None
        if last and last[0] == a and last[1] == b and begin <= last[3]:
            if end > last[3]:
                last[4].append(text[last[3] - begin :])
                last[3] = end
        else:
            rows.append([a, b, begin, end, [text]])
    data = b"\x00".join(b"".join(r[4]) for r in rows)
    pieces = pd.DataFrame([r[:4] for r in rows], columns=["a", "b", "begin", "end"])
    size = (pieces["end"] - pieces["begin"]).to_numpy()
    pieces["at"] = np.cumsum(size + 1) - size - 1
    return np.frombuffer(data, np.uint8), pieces


def _worth_sorting(data: np.ndarray, pieces: pd.DataFrame) -> list[tuple[int, int]]:
    """Parts of the string in which a string of LENGTH bytes may start twice.

    A repeated string covers cores of LENGTH - STEP bytes that are repeated too. With the
    cores at every STEP-th place of a piece on one side and those at all places on the
    other, a string without such a partner is ruled out.
    """
    core = LENGTH - STEP + 1
    at, size = pieces["at"].to_numpy(), (pieces["end"] - pieces["begin"]).to_numpy()
    sums = _Sums(data)
    count = np.maximum(0, size - core + 1)
    starts = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(count.sum())
    hashes = sums.of(starts, starts + core)
    values, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = np.zeros(len(data) + 1, np.int64)
    twice[starts[times[place] > 1]] = 1
    # A string that is repeated has only repeated cores: STEP of them in a row.
    run = np.cumsum(np.append([0], twice))
    begin = np.flatnonzero(run[STEP:] - run[:-STEP] == STEP)
    if not len(begin):
        return []
    cut = np.flatnonzero(np.diff(begin, prepend=-LENGTH - 1) > LENGTH)
    stop = begin[np.append(cut[1:], len(begin)) - 1] + LENGTH
    return list(zip(begin[cut].tolist(), stop.tolist(), strict=True))


def _sort_shard(part: pd.DataFrame) -> pd.DataFrame:
    """(a, b, begin, end): runs of bytes of the shard's texts that are covered by repeated strings."""
    data, pieces = _pieces(part)
    parts = _worth_sorting(data, pieces)
    none = pd.DataFrame({c: [] for c in ("a", "b", "begin", "end")}).astype("int64")
    if not parts:
        return none
    # Texts keep their bytes apart from the separators: 0 ends all, 1 ends a part, byte b is b + 2.
    size = np.array([e - s for s, e in parts])
    begin = np.cumsum(size + 1) - size - 1
    text = np.ones(int(size.sum()) + len(parts) + 1, np.int64)
    for (s, e), to in zip(parts, begin, strict=True):
        text[to : to + e - s] = data[s:e].astype(np.int64) + 2
    text[-1] = 0
    before, common = permuted_prefixes_wide(text, suffix_array(text))
    rest = np.zeros(len(text), np.int64)
    for to, n in zip(begin, size, strict=True):
        rest[to : to + n] = np.arange(n, 0, -1)
    first = np.flatnonzero((common >= LENGTH) & (rest >= LENGTH))
    found = np.unique(np.concatenate([first, before[first]]))
    # Back to the places in the pieces and in their texts.
    which = np.searchsorted(begin, found, side="right") - 1
    at = np.array([s for s, _ in parts])[which] + found - begin[which]
    own = np.searchsorted(pieces["at"].to_numpy(), at, side="right") - 1
    start = at - pieces["at"].to_numpy()[own] + pieces["begin"].to_numpy()[own]
    cut = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(start, prepend=-LENGTH - 1) > LENGTH))
    end = start[np.append(cut[1:], len(start)) - 1] + LENGTH if len(start) else start
    rows = pieces.iloc[own[cut]]
    return pd.DataFrame({"a": rows["a"].to_numpy(), "b": rows["b"].to_numpy(), "begin": start[cut], "end": end}).astype("int64")


def permuted_prefixes_wide(text: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """permuted_prefixes for symbols up to 257: UTF-8 has no bytes above 244, so they fit into bytes."""
    return permuted_prefixes(np.minimum(text, 255), array)


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(x, y, a, b, start): two hashes of every string of LENGTH bytes of the stretches."""
    for batch in batches:
        for a, b, begin, text in zip(batch["a"], batch["b"], batch["begin"], batch["bytes"], strict=True):
            data = np.frombuffer(text, np.uint8)
            start = np.arange(max(0, len(data) - LENGTH + 1))
            x, y = (_Sums(data, salt).of(start, start + LENGTH).view(np.int64) for salt in (1, 3))
            yield pd.DataFrame({"x": x, "y": y, "a": a, "b": b, "start": start + begin})


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each stretch that is wanted of a text, with its bytes."""
    for batch in batches:
        for a, b, text, wanted in zip(batch["a"], batch["b"], batch["text"], batch["wanted"], strict=True):
            data = text.encode()
            rows = [(w["shard"], a, b, w["begin"], w["size"], data[w["begin"] : w["begin"] + w["size"]]) for w in wanted]
            yield pd.DataFrame(rows, columns=["shard", "a", "b", "begin", "size", "bytes"])


def repeated(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b, begin, end): byte ranges of distinct texts that repeated strings cover, possibly overlapping.

    docs: (doc_id, a, b, text); heads: (a, b, head) names one document of each text.
    """
    found = cut_lineage(stretches(docs).dropDuplicates(["a", "b", "begin"]))
    same = found.groupBy("anchor", "digest", "size").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("a", "b", "begin", "turns")))
    classes = cut_lineage(same)
    # Only where an anchor has several kinds of stretches, or one that repeats itself, is anything left to sort.
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("least"), F.max("turns").alias("turns"))
    mixed = mixed.where("least = 1 and (kinds > 1 or turns > 1)").drop("turns")
    total = classes.join(mixed, "anchor").agg(F.sum("size")).head()[0] or 0
    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // SHARD))
    shard = F.when(F.col("kinds") > CROWD, F.lit(-1)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    wanted = (
        classes.join(mixed, "anchor")
        .groupBy("a", "b").agg(F.collect_set(F.struct(shard.alias("shard"), "begin", "size")).alias("wanted"))
        .join(heads, ["a", "b"])
    )
    wanted = cut_lineage(wanted.withColumnRenamed("head", "doc_id"))
    texts = docs.where(bit_filter.may_hold(wanted, "a")).join(
        wanted.select(F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("doc_id").alias("wd"), "wanted"),
        (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")) & F.col("doc_id").eqNullSafe(F.col("wd")),
    )
    parts = cut_lineage(
        texts.select("a", "b", "text", "wanted").mapInPandas(_cut_out, "shard long, a long, b long, begin long, size long, bytes binary")
    )
    ranges = "a long, b long, begin long, end long"
    sorted_ = parts.where("shard >= 0").groupBy("shard").applyInPandas(_sort_shard, ranges)
    strings = parts.where("shard < 0").mapInPandas(_strings, "x long, y long, a long, b long, start long").distinct()
    twice = strings.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = strings.join(twice, ["x", "y"]).select("a", "b", F.col("start").alias("begin"), (F.col("start") + LENGTH).alias("end"))
    whole = found.join(classes.where("times > 1").select("anchor", "digest", "size"), ["anchor", "digest", "size"])
    return whole.select("a", "b", "begin", (F.col("begin") + F.col("size")).alias("end")).union(sorted_).union(crowded)


def _merged(ranges: DataFrame) -> DataFrame:
    """(a, b, spans): the ranges of each text in order, those that touch as one."""
    own = Window.partitionBy("a", "b").orderBy("begin", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.distinct().withColumn("new", F.coalesce(F.col("begin") > reach, F.lit(True)).cast("int"))
    numbered = opened.withColumn("span", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("a", "b", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return spans.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def coded(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and the text."""
    return texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).select(
        "doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("b"), "text").alias("b"), "text"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row of documents(doc_id, text).

    A byte goes if a string of LENGTH bytes covers it that starts at another place too,
    in the same text or another; spans are the runs of such bytes as (begin, end).
    Missing and empty texts have no bytes; a text under LENGTH bytes loses none. Each row
    is a place of its own, so rows that repeat lose all they have. Ids may be missing,
    other columns don't matter; no rows give no rows.
    """
    rows = coded(docs)
    known = cut_lineage(rows.select("doc_id", "a", "b", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    long = known.where(F.col("n_bytes") >= LENGTH)
    heads = cut_lineage(long.groupBy("a", "b").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")))
    spans = cut_lineage(_merged(repeated(rows.where(F.octet_length("text") >= LENGTH), heads.select("a", "b", "head"))))
    spans = heads.select("a", "b", "copies").join(spans, ["a", "b"], "left")
    told = cut_lineage(known.join(spans, ["a", "b"], "left"))
    all_ = F.col("copies") > 1
    partly = F.col("spans").isNotNull() & ~F.coalesce(all_, F.lit(False))
    hashed = _kept(rows, told.where(partly).select("a", "b", "spans"))
    told = told.join(hashed, ["a", "b"], "left")
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return (
        told.withColumn("spans", F.when(all_, whole).otherwise(F.coalesce("spans", empty)))
        .select(
            "doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
            F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), "spans",
        )
    )


def _kept(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(a, b, kept_sha256) of texts without their spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                data, at, left = text.encode(), 0, hashlib.sha256()
                for s in spans:
                    left.update(data[at : s["begin"]])
                    at = s["end"]
                left.update(data[at:])
                out.append(left.hexdigest())
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "kept_sha256": out})

    texts = rows.where(bit_filter.may_hold(spans, "a")).join(spans, ["a", "b"])
    return cut_lineage(texts.select("a", "b", "text", "spans").mapInPandas(run, "a long, b long, kept_sha256 string"))
