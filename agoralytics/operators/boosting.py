"""Boosted trees of second order, with L1 and L2 penalties on the leaf weights.

Rows are cut into blocks of bin numbers once. For every level of a tree each block adds up
gradients and curvatures per node, feature and bin; they are summed over the blocks, and the
driver gets small tables of histograms, from which it picks the splits. Gradients are
fixed-point numbers: their sums are exact, and so the trees are the same on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.config import SEED
from agoralytics.session import cut_lineage

#: Bins per feature; rows in a block; trees after which the scores of the rows are written.
BINS, BLOCK, WRITE = 256, 65_536, 25
#: Tasks up to which their sums go to the driver as they are; those of more are added up in Spark.
FEW = 64
#: Gradients are multiples of 1 / UNIT.
UNIT = 1 << 24


@dataclass(frozen=True)
class Tree:
    """A full binary tree in an array: the children of i are 2i + 1 (value <= threshold) and 2i + 2.

    A node that isn't split has feature -1; weight is what a row gets there, cover the sum of curvatures.
    """

    feature: np.ndarray
    threshold: np.ndarray
    weight: np.ndarray
    cover: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            split = self.feature[at]
            if (split < 0).all():
                return at
            right = x[rows, np.maximum(split, 0)] > self.threshold[at]
            at = np.where(split >= 0, 2 * at + 1 + right, at)


@dataclass(frozen=True)
class _Binned:
    """A tree over bins, for rows that come as one array of bin numbers per feature: the ways through it and the node at the end of each."""

    levels: tuple[tuple[tuple[int, int], ...], ...]
    ends: np.ndarray

    @staticmethod
    def of(tree: Tree) -> _Binned:
        feature, cut = tree.feature.tolist(), tree.threshold.tolist()
        levels, begin = [], 0
        while begin < len(feature) // 2:
            nodes = range(begin, 2 * begin + 1)
            if all(feature[i] < 0 for i in nodes):
                break
            levels.append(tuple((feature[i], int(cut[i]) if feature[i] >= 0 else 0) for i in nodes))
            begin = 2 * begin + 1
        ends = []
        for way in range(1 << len(levels)):
            at = 0
            for k in range(len(levels)):
                if feature[at] >= 0:
                    at = 2 * at + 1 + (way >> (len(levels) - 1 - k) & 1)
            ends.append(at)
        return _Binned(tuple(levels), np.array(ends, np.int64))

    def way(self, bins: np.ndarray) -> np.ndarray:
        """The way that each row takes, from bins[feature, row]; of a node that isn't split it takes the left one."""
        kind = np.uint8 if len(self.levels) < 9 else np.int64
        out, taken = np.zeros(bins.shape[1], kind), [np.ones(bins.shape[1], bool)]
        for level in self.levels:
            right = [there & (bins[f] > cut) if f >= 0 else np.zeros_like(there) for there, (f, cut) in zip(taken, level, strict=True)]
            out = (out << 1) | np.bitwise_or.reduce(right).astype(kind)
            taken = [side for there, r in zip(taken, right, strict=True) for side in (there & ~r, r)]
        return out


def _soft(g: float, alpha: float) -> float:
    return np.sign(g) * max(abs(g) - alpha, 0.0)


def leaf_weight(g: float, h: float, alpha: float, lam: float) -> float:
    return -_soft(g, alpha) / (h + lam) if h + lam > 0 else 0.0


def gain(g: np.ndarray, h: np.ndarray, alpha: float, lam: float) -> np.ndarray:
    """How much a node with these sums lowers the penalised loss, times two."""
    part = np.maximum(np.abs(g) - alpha, 0.0)
    return np.where(h + lam > 0, part * part / np.maximum(h + lam, 1e-300), 0.0)


@dataclass(frozen=True)
class Boosted:
    """The trees; a row's margin is the sum of its leaves' weights."""

    trees: list[Tree] = field(default_factory=list)
    column: str = "features"

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            out += tree.weight[tree.leaf(x)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds margin, probability (of class 1) and prediction."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def score(vectors: pa.Array) -> pa.Array:
            return pa.array(shared.value.margins(_matrix(vectors)))

        scored = df.withColumn("margin", F.arrow_udf(score, "double")(vector_to_array(self.column)))
        return scored.withColumn("probability", 1 / (1 + F.exp(-F.col("margin")))).withColumn(
            "prediction", (F.col("margin") > 0).cast("double")
        )


def _matrix(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) per key, the same wherever the row is."""
    x = keys.view(np.uint64) + np.array([seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


@dataclass(frozen=True)
class Booster:
    """Trains on rows with `features` and `target` (0 or 1).

    l1 and l2 are the penalties of the leaf weights, least the smallest sum of curvatures of a leaf, rows and
    columns the shares that a tree sees (equal rows are seen together). Missing labels are left out; no rows, or one class, give a model
    whose trees say nothing or little.
    """

    rounds: int = 200
    depth: int = 3
    rate: float = 0.05
    rows: float = 0.7
    columns: float = 0.7
    l1: float = 1.0
    l2: float = 2.0
    least: float = 5.0
    bins: int = BINS
    seed: int = SEED

    def fit(self, train: DataFrame) -> Boosted:
        narrow = cut_lineage(
            train.where(F.col("target").isNotNull()).select(vector_to_array("features").alias("x"), F.col("target").cast("double").alias("y"))
        )
        first = narrow.select(F.size("x").alias("n")).head()
        if first is None:
            return Boosted()
        cuts = self._cuts(narrow, first.n)
        # As many partitions as the rows fill blocks, up to two per core: a task adds up all of its blocks.
        parts = max(1, min(math.ceil(narrow.count() / BLOCK), 2 * train.sparkSession.sparkContext.defaultParallelism))
        blocks = cut_lineage(_blocks(narrow.coalesce(parts), cuts)).coalesce(parts)
        trees: list[Tree] = []
        for k in range(self.rounds):
            if k and k % WRITE == 0:
                blocks = cut_lineage(_rescored(blocks, trees[-WRITE:], cuts)).coalesce(parts)
            trees.append(self._grow(blocks, trees[k // WRITE * WRITE :], cuts, k, parts > FEW))
        return Boosted([Tree(t.feature, _values(t, cuts), t.weight, t.cover) for t in trees])

    def _cuts(self, rows: DataFrame, n: int) -> list[np.ndarray]:
        """Per feature the values at which it may be split: quantiles, all values where there are few."""
        shares = F.array(*[F.lit((i + 1) / self.bins) for i in range(self.bins)])
        found = rows.agg(*[F.percentile_approx(F.col("x")[i], shares, 100 * self.bins).alias(f"q{i}") for i in range(n)]).head()
        return [np.unique(np.array(found[i], np.float64))[: self.bins - 1] for i in range(n)]

    def _grow(self, blocks: DataFrame, since: list[Tree], cuts: list[np.ndarray], number: int, many: bool) -> Tree:
        n = len(cuts)
        draw = np.random.default_rng(self.seed * 100_003 + number)
        used = np.sort(draw.permutation(n)[: max(1, round(self.columns * n))])
        size = (1 << (self.depth + 1)) - 1
        feature, place = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        weight, cover = np.zeros(size), np.zeros(size)
        for level in range(self.depth):
            begin, end = (1 << level) - 1, (1 << (level + 1)) - 1
            so_far = Tree(feature.copy(), place.astype(np.float64), weight, cover)
            sums = self._histograms(blocks, since, so_far, cuts, used, begin, end, number, many)
            for node in range(begin, end):
                if node and feature[(node - 1) // 2] < 0:
                    continue
                g, h = sums[node - begin, 0].sum(axis=0)
                if not node:
                    weight[0], cover[0] = self.rate * leaf_weight(g, h, self.l1, self.l2), h
                best = self._split(sums[node - begin], g, h)
                if best is None:
                    continue
                feature[node], place[node] = used[best[0]], best[1]
                left = sums[node - begin, best[0], : best[1] + 1].sum(axis=0)  # the children's sums need no pass of their own
                for child, (cg, ch) in ((2 * node + 1, left), (2 * node + 2, (g - left[0], h - left[1]))):
                    weight[child], cover[child] = self.rate * leaf_weight(cg, ch, self.l1, self.l2), ch
            if (feature[begin:end] < 0).all():
                break
        return Tree(feature, place.astype(np.float64), weight, cover)

    def _split(self, sums: np.ndarray, g: float, h: float) -> tuple[int, int] | None:
        """(feature, bin) of the best split of a node with sums[feature, bin, (g, h)]; ties to the first."""
        left = sums.cumsum(axis=1)
        lg, lh = left[:, :, 0], left[:, :, 1]
        value = gain(lg, lh, self.l1, self.l2) + gain(g - lg, h - lh, self.l1, self.l2) - gain(np.array(g), np.array(h), self.l1, self.l2)
        value[(lh < self.least) | (h - lh < self.least)] = -np.inf
        best = int(value.argmax())
        return divmod(best, value.shape[1]) if value.flat[best] > 1e-6 else None

    def _histograms(
        self, blocks: DataFrame, since: list[Tree], tree: Tree, cuts: list[np.ndarray], used: np.ndarray, begin: int, end: int, number: int, many: bool
    ) -> np.ndarray:
        """sums[node, feature, bin, (g, h)] of the nodes of one level, over all blocks."""
        width = max(len(c) for c in cuts) + 1
        shared = blocks.sparkSession.sparkContext.broadcast(([(_Binned.of(t), t.weight) for t in since], _Binned.of(tree), used))
        share, seed, n = self.rows, self.seed * 1_009 + number, len(cuts)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            since, tree, used = shared.value
            level = tree.ends - begin
            level = np.where((level >= 0) & (level < end - begin), level, end - begin)  # rows that ended before go to a node of their own
            total = np.zeros((2, len(used), end - begin, width), np.int64)
            for batch in batches:
                for x, y, key, margin in _unpacked(batch, n):
                    seen = np.flatnonzero(_uniform(key, seed) < share)
                    way = tree.way(x)[seen]
                    margin = margin[seen]
                    for old, weight in since:
                        margin += weight[old.ends][old.way(x)[seen]]
                    p = 1 / (1 + np.exp(-margin))
                    # Sums of whole numbers below 2^53: exact.
                    g, h = np.round((p - y[seen]) * UNIT), np.round(p * (1 - p) * UNIT)
                    start = (level * width)[way]
                    for k, f in enumerate(used):
                        slot = start + x[f][seen]
                        for sums, values in zip(total, (g, h), strict=True):
                            found = np.bincount(slot, values, (end - begin + 1) * width)
                            sums[k] += found[: (end - begin) * width].reshape(-1, width).astype(np.int64)
            total = total.transpose(2, 1, 3, 0).reshape(-1, 2)
            some = np.flatnonzero(total.any(axis=1))
            columns = [some.astype(np.int64), total[some, 0], total[some, 1]]
            yield pa.RecordBatch.from_arrays([pa.array([c.tolist()], pa.list_(pa.int64())) if many else pa.array([c.tobytes()], pa.binary()) for c in columns], ["slot", "g", "h"])

        out = np.zeros(((end - begin) * len(used) * width, 2), np.int64)
        if many:
            each = blocks.mapInArrow(add, "slot array<long>, g array<long>, h array<long>").select(F.inline(F.arrays_zip("slot", "g", "h")))
            for row in each.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes of a level times features times bins
                out[row.slot] = row.g, row.h
        else:
            for row in blocks.mapInArrow(add, "slot binary, g binary, h binary").collect():  # that many numbers from each of FEW tasks at most
                slot, g, h = (np.frombuffer(cell, np.int64) for cell in row)
                out[slot] += np.stack([g, h], axis=1)
        shared.unpersist()
        return (out / UNIT).reshape(end - begin, len(used), width, 2)


def _values(tree: Tree, cuts: list[np.ndarray]) -> np.ndarray:
    """The thresholds of a tree over bins as values of the features."""
    return np.array([cuts[f][int(b)] if f >= 0 else np.inf for f, b in zip(tree.feature, tree.threshold, strict=True)])


_FIELDS = "x binary, y binary, key binary, margin binary"


def _packed(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a in c], pa.binary()) for c in columns], ["x", "y", "key", "margin"])


def _unpacked(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks (bins[feature, row], y, key, margin)."""
    for x, y, key, margin in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
        yield np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(y), np.frombuffer(key, np.int64), np.frombuffer(margin)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task, put together until they fill a block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= BLOCK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Rows(x, y) as blocks of bin numbers, labels, keys and margins of 0; bin b holds what is at most cut b."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _filled(batches):
            for k in range(0, table.num_rows, BLOCK):
                part = table.slice(k, BLOCK).combine_chunks()
                x = _matrix(part.column("x").chunk(0))
                bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(shared.value)]).astype(np.uint8)
                y, key = part.column("y").to_numpy(), part.column("key").to_numpy()
                yield _packed([(bins, y, key, np.zeros(len(y)))])

    return rows.select("x", "y", F.xxhash64("x", "y").alias("key")).mapInArrow(pack, _FIELDS)


def _rescored(blocks: DataFrame, trees: list[Tree], cuts: list[np.ndarray]) -> DataFrame:
    """The blocks with the weights of these trees added to the margins."""
    shared = blocks.sparkSession.sparkContext.broadcast([(_Binned.of(t), t.weight) for t in trees])
    n = len(cuts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, key, margin in _unpacked(batch, n):
                for tree, weight in shared.value:
                    margin = margin + weight[tree.ends][tree.way(x)]
                yield _packed([(x, y, key, margin)])

    return blocks.mapInArrow(score, _FIELDS)
