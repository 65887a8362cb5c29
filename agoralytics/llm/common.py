"""Helpers that several operators share: tables, byte views of Arrow columns, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoralytics.session import cut_lineage

__all__ = ["SMALL", "cut_lineage", "table", "texts_of", "chunks", "byte_view", "mix", "word_hashes", "shingles"]

#: Bytes of text that the numpy code takes at once; one longer text is taken alone.
CHUNK = 1 << 21
#: The same for code that holds many 64-bit arrays with an entry per byte.
SMALL = 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the whole text; a missing text is an empty one."""
    return docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that a piece holds about `most` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each row begins; one more entry ends the last."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xA0761D6478BD642F)
    return values ^ (values >> np.uint64(32))


#: An odd number, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the 0..n-1, and the same of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(SMALL + (SMALL >> 1), n + (n >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


#: Bytes inside words: ASCII letters and digits, and all bytes of other characters.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts, and where each text's words begin.

    A word is a maximal run of ASCII letters and digits and of characters beyond ASCII.
    """
    ended = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(texts, "")), "", "\n")
    data, begins = byte_view(ended)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = _INSIDE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, begins)


def shingles(words: np.ndarray, begins: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words inside each text, and where each text's runs begin.

    A text with fewer words, but at least one, has one run: all of it.
    """
    counts = np.diff(begins)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - width + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(width):
        runs += words[j : j + n] * factors[j]
    at = np.repeat(begins[:-1], np.where(counts >= width, counts - width + 1, 0))
    each = np.where(counts >= width, counts - width + 1, np.where(counts > 0, 1, 0))
    first = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros(first[-1], np.uint64)
    long = np.repeat(counts >= width, each)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(np.where(counts >= width, each, 0)) - np.where(counts >= width, each, 0), np.where(counts >= width, each, 0))
    out[long] = runs[at + inner]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[begins[i] : begins[i + 1]]
        out[first[i]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), first
