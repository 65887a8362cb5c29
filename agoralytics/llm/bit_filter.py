"""A bitmap of fixed size that tells which hashes a table surely lacks.

It has the same size however many rows there are: with more rows it only rules out less,
and a join after it decides. So it can be broadcast at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter (8 MB), and the parts it is built in.
BITS, PARTS = 1 << 26, 1 << 7
_PART = BITS // PARTS
SHIFT = 64 - BITS.bit_length() + 1


def build(rows: DataFrame, column: str) -> bytes:
    """One bit per range of hashes; set if a row has a 64-bit hash in that range."""
    place = F.shiftrightunsigned(column, SHIFT)
    parts = (
        rows.select((place / _PART).cast("int").alias("part"), (place % _PART).cast("int").alias("bit"))
        .groupBy("part").agg(F.collect_set("bit").alias("bits"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bits in batch.column("bits"):
                held = np.zeros(_PART, np.uint8)
                held[bits.values.to_numpy()] = 1
                out.append(np.packbits(held, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, pa.binary())], ["part", "held"])

    held = np.zeros((PARTS, _PART // 8), np.uint8)
    for row in parts.mapInArrow(pack, "part int, held binary").collect():  # PARTS rows of 64 KB at most
        held[row.part] = np.frombuffer(row.held, np.uint8)
    return held.tobytes()


def hit(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in the table; held: the bytes of the filter."""
    place = (hashes >> np.uint64(SHIFT)).astype(np.int64)
    return (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def may_hold(ids: DataFrame, column: str) -> Column:
    """A condition on another table's column of that name: false where `ids` surely lacks the value.

    Only the hash of the column goes through Python, so wide rows stay where they are.
    """
    shared = ids.sparkSession.sparkContext.broadcast(build(ids.select(F.xxhash64(column).alias("hash")), "hash"))

    @F.pandas_udf("boolean")
    def check(hashes: pd.Series) -> pd.Series:
        return pd.Series(hit(np.frombuffer(shared.value, np.uint8), hashes.to_numpy(np.int64).view(np.uint64)))

    return check(F.xxhash64(column))


def keep_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is in the table of distinct ids; nulls equal each other."""
    some = rows.where(may_hold(ids, column))
    return some.join(ids, some[column].eqNullSafe(ids[column]), "left_semi")


def drop_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is not in the table of distinct ids; rows without an id stay.

    Rows that the filter rules out are not shuffled.
    """
    held = may_hold(ids, column)
    return rows.where(~held).unionByName(rows.where(held).join(ids, column, "left_anti").select(rows.columns))
