"""SimHash near-dedup by a hierarchical index over fingerprints in Gray order.

Neighbours in Gray order share most of their bits. Upper nodes hold the bits that all
fingerprints below them share, as a mask and a pattern; a search adds up a query's
differences from node to node and leaves a whole group as soon as they exceed the radius.

The topmost nodes fix one of (radius + 1) blocks of bits: two fingerprints within the
radius agree in a block, so they meet below at least one of these nodes, and each node can
be searched in a task of its own. A node with too many fingerprints is cut again, by the
blocks of the bits that are left, until every group is small; no group is ever searched
in parts or dropped. Below that the index is built in Gray order inside the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.common import cut_lineage, texts_of
from agoralytics.llm.components import components

BITS = 64
#: Fingerprints below one topmost node; larger nodes are cut by further bits.
GROUP = 20_000
#: Children of an inner node, and (query, node) pairs looked at together.
FAN, FRONTIER = 8, 1 << 18
#: Shingles hashed together, rows that go through numpy together.
SHINGLES, ROWS = 1 << 15, 1 << 16


def fingerprint(text: str, width: int, seed: int) -> int:
    """A bit is 1 if it is set in more than half of the hashes of all shingles; 0 without words."""
    words = text.encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    body = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), SHINGLES):
        hashes = [xxhash.xxh64_intdigest(body[a:b], seed) for a, b in zip(starts[k : k + SHINGLES], ends[k : k + SHINGLES], strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (a signed long) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "mark"])

    return texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(sign, "doc_id long, mark long")


def _ones(bits: int) -> int:
    """A signed long whose lowest bits are set."""
    return -1 if bits == BITS else (1 << bits) - 1


def _shift_right(of: Column | str, by: int) -> Column:
    return F.shiftrightunsigned(of, by) if by < BITS else F.lit(0).cast("long")


def cut(rows: DataFrame, left: int, radius: int) -> tuple[DataFrame, int]:
    """Puts each row(mark, node, rest) below a node per block of the `left` bits of rest, and how many bits are left then.

    Blocks differ by a bit in width; the smallest decides how many bits a step fixes, the
    rest of a larger block stays with the others.
    """
    size = max(1, left // (radius + 1))
    rest = F.col("rest")
    turned = []
    for k in range(min(radius + 1, left)):
        by = k * size
        moved = rest if by == 0 else (F.shiftleft(rest, by).bitwiseAND(_ones(left))).bitwiseOR(_shift_right(rest, left - by))
        turned.append(F.struct(F.lit(k).alias("k"), moved.alias("moved")))
    spread = rows.select("mark", "node", F.explode(F.array(*turned)).alias("turn"))
    head = _shift_right("turn.moved", left - size)
    return spread.select(
        "mark", F.xxhash64("node", "turn.k", head).alias("node"), F.col("turn.moved").bitwiseAND(_ones(left - size)).alias("rest")
    ), left - size


def gray_rank(code: Column) -> Column:
    """Place of a code of fewer than 64 bits in the reflected Gray order."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code


class Index:
    """The nodes over one array of fingerprints; groups are runs of it, each with a root of its own.

    Level 0 are the fingerprints; a node of the next level covers up to FAN neighbours of
    the one below, never across two groups. shared[l] are masks of equal bits, value[l] the bits.
    """

    def __init__(self, marks: np.ndarray, group: np.ndarray):
        n = len(marks)
        self.shared, self.value = [np.full(n, ~np.uint64(0))], [marks]
        self.first, self.size, self.last = [np.arange(n)], [np.ones(n, np.int64)], [np.arange(n)]
        some, every, owner = marks, marks, group
        while True:
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(begins) == len(owner):
                break
            inner = np.arange(len(owner)) - np.repeat(begins, np.diff(np.r_[begins, len(owner)]))
            starts = np.flatnonzero(inner % FAN == 0)
            some, every = np.bitwise_or.reduceat(some, starts), np.bitwise_and.reduceat(every, starts)
            self.shared.append(~(some ^ every))
            self.value.append(every)
            self.first.append(starts)
            self.size.append(np.diff(np.r_[starts, len(owner)]))
            self.last.append(self.last[-1][np.r_[starts[1:], len(owner)] - 1])
            owner = owner[starts]
        self.root = np.searchsorted(owner, group)  # groups are numbered in ascending order

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (earlier, later) of one group whose fingerprints differ in at most radius bits."""
        marks, top, n = self.value[0], len(self.shared) - 1, len(self.value[0])
        todo = [(top, np.arange(k, min(n, k + FRONTIER)), self.root[k : k + FRONTIER], None) for k in range(0, n, FRONTIER)]
        while todo:
            level, query, node, apart = todo.pop()
            if apart is None:  # a member agrees with all that its root fixes
                apart = np.zeros(len(query), np.int64)
            if level == 0:
                yield query, node
                continue
            if len(query) > FRONTIER // FAN and len(query) > 1:
                half = len(query) // 2
                todo += [(level, query[:half], node[:half], apart[:half]), (level, query[half:], node[half:], apart[half:])]
                continue
            each = self.size[level][node]
            ends = np.cumsum(each)
            child = np.repeat(self.first[level][node] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
            fixed = np.repeat(self.shared[level][node], each)
            query, apart = np.repeat(query, each), np.repeat(apart, each)
            below = level - 1
            new = (marks[query] ^ self.value[below][child]) & self.shared[below][child] & ~fixed
            apart = apart + np.bitwise_count(new)
            stay = (apart <= radius) & (self.last[below][child] > query)
            if stay.any():
                todo.append((below, query[stay], child[stay], apart[stay]))


def forest(marks: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected: each fingerprint with the first one of its part of the group."""
    label = np.arange(len(marks))
    for a, b in Index(marks, group).near(radius):
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(marks)))
    return marks[linked], marks[label[linked]]


def _search(radius: int):
    """Searches rows(node, mark) that come sorted by node; groups are taken whole."""

    def links(node: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[True, node[1:] != node[:-1]]) - 1
        pair = np.bincount(group)[group] > 1
        group = np.unique(group[pair], return_inverse=True)[1]
        a, b = forest(mark[pair].view(np.uint64), group, radius) if pair.any() else (np.zeros(0, np.uint64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, mark = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            node = np.concatenate([node, batch.column("node").to_numpy()])
            mark = np.concatenate([mark, batch.column("mark").to_numpy()])
            if len(node) >= ROWS:
                whole = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
                if whole:
                    yield links(node[:whole], mark[:whole])
                    node, mark = node[whole:], mark[whole:]
        if len(node):
            yield links(node, mark)

    return run


def link(marks: DataFrame, radius: int = 3, group: int = GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints(mark) that connect all those within the radius, directly or by others.

    Links may repeat. A node that holds more than `group` fingerprints is cut by further bits; with
    so few bits left that no more fingerprints can differ in them, it is small enough.
    """
    rows, left = cut(marks.select("mark", F.lit(0).cast("long").alias("node"), F.col("mark").alias("rest")), BITS, radius)
    found = None
    while True:
        large = cut_lineage(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > group).select("node"))
        more = left > max(radius, math.floor(math.log2(group))) and not large.isEmpty()
        small = rows.join(large, "node", "left_anti") if more else rows
        sorted_rows = (
            small.withColumn("rank", gray_rank(F.col("rest"))).repartition("node").sortWithinPartitions("node", "rank").select("node", "mark")
        )
        links = cut_lineage(sorted_rows.mapInArrow(_search(radius), "a long, b long"))
        found = links if found is None else found.union(links)
        if not more:
            return found
        rows, left = cut(cut_lineage(rows.join(large, "node", "left_semi")), left, radius)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of documents(doc_id, text).

    fingerprint: 16 hexadecimal digits. component_id: the smallest doc_id that a chain of
    fingerprints leads to, each at most `radius` bits from the next, the row itself
    included. A missing text is an empty one; texts without words have fingerprint zero and are
    linked like any other. Rows may repeat and get equal results; a row without an id is
    linked, but names a component never: without any id in it, the component_id is null. Other columns of
    the input don't matter; no rows give no rows.
    """
    signed = cut_lineage(fingerprints(docs, width, seed))
    classes = cut_lineage(signed.groupBy("mark").agg(F.min("doc_id").alias("first")))
    labels = components(link(classes.select("mark"), radius, group))
    firsts = labels.join(classes.withColumnRenamed("mark", "id"), "id").groupBy("label").agg(F.min("first").alias("component_id"))
    parts = labels.join(firsts, "label").select(F.col("id").alias("mark"), "component_id")
    # Written, so that both sides of the last join are plain shuffles and a mark that many rows have is split.
    named = cut_lineage(classes.join(parts, "mark", "left").select("mark", F.coalesce("component_id", "first").alias("component_id")))
    hexed = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    return signed.join(named, "mark").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """Of each component the rows with its smallest doc_id; rows without an id stay."""
    classed = near_duplicates(docs, **settings).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(classed, "doc_id", "left_anti")
