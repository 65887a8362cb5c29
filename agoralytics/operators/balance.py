"""Minority oversampling with exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.config import SEED
from agoralytics.functions.values import seeded_hash, seeded_unit
from agoralytics.operators.ordering import position
from agoralytics.session import cut_lineage

# Vectors in a cell, the most cells a set of vectors is cut into, and vectors seen per cell to place them.
LEAF = 5_000
MOST_CELLS = 1_000
SEEN = 16
# Vectors of a bucket inside a task.
BUCKET = 64
# Bounds are compared with this much room for rounding.
ROOM = 1 + 1e-9

_POINT = "vid long, copies long, wanted boolean, x array<double>"
_NEAR = "distance array<double>, other array<long>, other_copies array<long>, other_x array<array<double>>"


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of a to each row of b."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        out += (a[:, f, None] - b[None, :, f]) ** 2
    return out


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances between a box and each of some others."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0.0)
    return (gap * gap).sum(axis=-1)


def _buckets(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows cut in halves along their widest feature until no part has more than `size`."""
    done, open_ = [], [np.arange(len(x))] if len(x) else []
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        own = x[rows]
        values = own[:, (own.max(axis=0) - own.min(axis=0)).argmax()]
        half = np.argpartition(values, len(rows) // 2)
        open_ += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return done


def _nearest(
    x: np.ndarray, vids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, bounds: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of points, squared distance) of the k nearest points of each row, itself left out, row by row.

    With `bounds`, squared distances, only points that are no farther. Boxes of points that cannot
    have one of the k nearest aren't looked at.
    """
    parts = _buckets(points, BUCKET)
    none = np.zeros(0, np.int64)
    if not parts or not len(x):
        return none, none, np.zeros(0)
    lows, highs = (np.array([f(points[p], axis=0) for p in parts]) for f in (np.min, np.max))
    sizes = np.array([len(p) for p in parts])
    found = []
    for group in _buckets(x, BUCKET):
        own = x[group]
        gaps = _gaps(own.min(axis=0), own.max(axis=0), lows, highs)
        if bounds is not None:
            limit = bounds[group].max()
        else:
            first = np.argsort(gaps, kind="stable")
            enough = int(np.searchsorted(sizes[first].cumsum(), k + 1)) + 1
            near = np.concatenate([parts[i] for i in first[:enough]])
            d2 = _squared(own, points[near])
            d2[vids[group][:, None] == ids[near][None, :]] = np.inf
            limit = np.partition(d2, k - 1, axis=1)[:, k - 1].max() if len(near) >= k else np.inf
        chosen = np.flatnonzero(gaps <= limit * ROOM)
        if not len(chosen):
            continue
        near = np.concatenate([parts[i] for i in chosen])
        d2 = _squared(own, points[near])
        d2[vids[group][:, None] == ids[near][None, :]] = np.inf
        last = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(near) >= k else np.full(len(own), np.inf)
        if bounds is not None:
            last = np.minimum(last, bounds[group] * ROOM)
        row, column = np.nonzero((d2 <= last[:, None]) & np.isfinite(d2))
        order = np.lexsort((ids[near[column]], d2[row, column], row))
        row, column = row[order], column[order]
        # Of equally far points the first ids count.
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[rank < k], column[rank < k]
        found.append((group[row], near[column], d2[row, column]))
    if not found:
        return none, none, np.zeros(0)
    row, column, d2 = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], column[order], d2[order]


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], counts.cumsum()]).astype(np.int32)), values)


def _as_lists(x: np.ndarray) -> pa.Array:
    return _lists(pa.array(np.ascontiguousarray(x, np.float64).ravel()), np.full(len(x), x.shape[1] if x.ndim > 1 else 0))


def _near_columns(row, column, d2, members: pa.Table, points: np.ndarray, ids: np.ndarray, n: int) -> dict[str, pa.Array]:
    """The neighbours of each of n rows as lists."""
    counts = np.bincount(row, minlength=n)
    copies = members["copies"].to_numpy()
    return {
        "distance": _lists(pa.array(np.sqrt(d2)), counts), "other": _lists(pa.array(ids[column]), counts),
        "other_copies": _lists(pa.array(copies[column]), counts), "other_x": _lists(_as_lists(points[column]), counts),
    }


def _splits(seen: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree of (feature, cut, left, right) over some vectors; a child below 0 is cell -child - 1."""
    tree: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(rows: np.ndarray, share: int) -> int:
        nonlocal made
        spread = rows.max(axis=0) - rows.min(axis=0)
        f = int(spread.argmax())
        if share < 2 or not spread[f] > 0:
            made += 1
            return -made
        values = np.sort(rows[:, f])
        cut = values[(len(values) - 1) // 2]
        cut = cut if cut < values[-1] else values[values < values[-1]][-1]
        at = len(tree)
        tree.append((f, float(cut), 0, 0))
        left = rows[:, f] <= cut
        tree[at] = (f, float(cut), grow(rows[left], share // 2), grow(rows[~left], share - share // 2))
        return at

    grow(seen, cells)
    return tree


def _cell_of(x: np.ndarray, tree: Sequence[tuple[int, float, int, int]]) -> np.ndarray:
    if not tree:
        return np.zeros(len(x), np.int64)
    feature, cut, left, right = (np.array(c) for c in zip(*tree, strict=True))
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (inner := at >= 0).any():
        i = np.maximum(at, 0)
        at = np.where(inner, np.where(x[rows, feature[i]] <= cut[i], left[i], right[i]), at)
    return -at - 1


def _cells(points: DataFrame, count: int, leaf: int) -> DataFrame:
    """Points with their cell. The cuts between cells are taken from vectors that are spread over all points."""
    cells = min(MOST_CELLS, -(-count // leaf))
    step = max(1, count // (SEEN * cells))
    seen = points.filter(F.col("vid") % step == 0).orderBy("vid").select("x").collect()  # 2 * SEEN per cell at most
    tree = _splits(np.array([row["x"] for row in seen]), cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = pa.array(_cell_of(_vectors(batch.column("x")), tree))
                yield pa.RecordBatch.from_arrays([*batch.columns, cell], [*batch.schema.names, "cell"])

    return cut_lineage(points.mapInArrow(assign, f"{_POINT}, cell long"))


def _as_structs(name: str = "near") -> Column:
    return F.transform(
        F.arrays_zip("distance", "other", "other_copies", "other_x"),
        lambda n: F.struct(n["distance"].alias("distance"), n["other"].alias("other"), n["other_copies"].alias("copies"), n["other_x"].alias("x")),
    ).alias(name)


def nearest_vectors(points: DataFrame, count: int, k: int, leaf: int = LEAF) -> DataFrame:
    """(vid, copies, x, near) of the wanted points: near has their k nearest other points as (distance, other, copies, x).

    Exact at any size. Points are cut into cells. The k nearest of the own cell bound the distance of the
    k-th neighbour; then only the cells whose box is no farther are visited. The visitors of a cell are cut
    into lots of about `leaf` points, and a visit returns at most k points.
    """
    columns = "vid long, copies long, x array<double>"
    if count <= leaf:
        placed, cells, boxes = points.withColumn("cell", F.lit(0).cast("long")), 1, None
    else:
        placed = _cells(points, count, leaf)
        width = placed.select(F.size("x").alias("n")).head().n
        ends = [f(F.col("x")[i]) for f in (F.min, F.max) for i in range(width)]
        stats = placed.groupBy("cell").agg(*ends).collect()  # a row per cell
        cells = len(stats)
        ranges = np.array([r[1:] for r in stats], np.float64)
        boxes = (np.array([r[0] for r in stats]), ranges[:, :width], ranges[:, width:])

    def look(members: pa.Table) -> pa.Table:
        own = members["cell"][0].as_py()
        members = members.sort_by("vid")
        points, ids = _vectors(members["x"]), members["vid"].to_numpy()
        asking = np.flatnonzero(members["wanted"].to_numpy())
        x, vids = points[asking], ids[asking]
        row, column, d2 = _nearest(x, vids, points, ids, k)
        number = np.bincount(row, minlength=len(x))
        bound = np.full(len(x), np.inf)
        full = number >= k
        bound[full] = d2[number.cumsum()[full] - 1]
        reached: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
        if boxes is not None:
            names, lows, highs = boxes
            for group in _buckets(x, BUCKET):
                part = x[group]
                close = np.flatnonzero((_gaps(part.min(axis=0), part.max(axis=0), lows, highs) <= bound[group].max() * ROOM) & (names != own))
                if len(close):
                    hit = _gaps(part[:, None], part[:, None], lows[None, close], highs[None, close]) <= bound[group][:, None] * ROOM
                    for i in np.flatnonzero(hit.any(axis=1)):
                        reached[group[i]] = names[close[hit[i]]]
        seen = _lists(pa.array(np.concatenate([*reached, np.zeros(0, np.int64)]), pa.int64()), np.array([len(r) for r in reached], np.int64))
        return pa.table(
            {
                "vid": vids, "copies": members["copies"].to_numpy()[asking], "x": _as_lists(x), "bound": bound, "cells": seen,
                **_near_columns(row, column, d2, members, points, ids, len(x)),
            }
        )

    first = placed.repartition(cells, "cell").groupBy("cell").applyInArrow(look, f"{columns}, bound double, cells array<long>, {_NEAR}")
    if boxes is None:
        return first.select("vid", "copies", "x", _as_structs())
    first = cut_lineage(first)
    visits = first.select("vid", "x", "bound", F.explode("cells").alias("cell"))
    lots = F.broadcast(
        points.sparkSession.createDataFrame(
            [(row["cell"], -(-row["count"] // leaf)) for row in visits.groupBy("cell").count().collect()], "cell long, lots long"
        )
    )
    asking = visits.join(lots, "cell").withColumn("lot", F.col("vid") % F.col("lots")).select("cell", "lot", "vid", "x", "bound")
    answering = (
        placed.join(lots, "cell")
        .withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        .select("cell", "lot", "vid", "copies", "x")
    )

    def visit(asking: pa.Table, members: pa.Table) -> pa.Table:
        points, ids = _vectors(members["x"]), members["vid"].to_numpy()
        vids = asking["vid"].to_numpy()
        found = _nearest(_vectors(asking["x"]), vids, points, ids, k, asking["bound"].to_numpy())
        return pa.table({"vid": vids, **_near_columns(*found, members, points, ids, len(vids))})

    keys = ["cell", "lot"]
    more = (
        asking.repartition(cells, *keys).groupBy(*keys)
        .cogroup(answering.repartition(cells, *keys).groupBy(*keys))
        .applyInArrow(visit, f"vid long, {_NEAR}")
        .where("size(other) > 0")
        .groupBy("vid").agg(F.flatten(F.collect_list(_as_structs())).alias("more"))
    )
    both = F.concat("near", F.coalesce("more", F.array().cast("array<struct<distance:double,other:long,copies:long,x:array<double>>>")))
    own = first.select("vid", "copies", "x", _as_structs())
    return own.join(more, "vid", "left").select("vid", "copies", "x", F.slice(F.array_sort(both), 1, k).alias("near"))


def neighbour_lists(rows: DataFrame, x: str, k: int, leaf: int = LEAF, wanted: Column | None = None) -> DataFrame:
    """(x, neighbours): the k nearest rows of each distinct vector, or of those of which a row is wanted.

    Equal rows are one vector with a number of copies, so a crowd of copies is
    searched once; its copies come first in the list.
    """
    asked = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    distinct = rows.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("copies"), F.bool_or(asked).alias("wanted"))
    points = cut_lineage(position(distinct, [F.col("x").asc()], "vid").select("vid", "copies", "wanted", "x"))
    repeated = lambda v, n: F.array_repeat(v, F.least(n, F.lit(k)).cast("int"))
    near = F.flatten(F.transform("near", lambda c: repeated(c["x"], c["copies"])))
    return nearest_vectors(points, points.count(), k, leaf).select(
        F.col("x").alias(x),
        F.slice(
            F.concat(repeated(F.col("x"), F.col("copies") - 1), near), 1, k
        ).alias("neighbours"),
    )


def smote(
    df: DataFrame,
    key: str,
    label: str,
    x: str,
    k: int = 5,
    seed: int = SEED,
    leaf: int = LEAF,
) -> DataFrame:
    """(key, label, x, synthetic): the rows, and new ones until classes are equal.

    A new row lies between a row and one of its k nearest rows of the same class.
    Rows take turns as the base; neighbour and place come from a seeded hash.
    """
    rows = df.select(key, label, x)
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    largest = max(sizes.values(), default=0)
    out = rows.withColumn("synthetic", F.lit(False))
    for value, size in sorted(sizes.items(), key=str):
        missing = largest - size
        if not missing:
            continue
        if size <= k:
            raise ValueError(f"class {value!r} has {size} rows, {k} neighbours need {k + 1}")
        minority = rows.filter(F.col(label) == value)
        ranked = position(minority, [seeded_hash(key, seed), F.col(key).asc()], "_rank")
        copies = (F.lit(missing // size) + (F.col("_rank") < missing % size).cast("int")).cast("int")
        ranked = cut_lineage(ranked.withColumn("_copies", copies))
        bases = ranked.filter("_copies > 0")
        lists = neighbour_lists(ranked, x, k, leaf, F.col("_copies") > 0)
        drawn = bases.join(lists, x).withColumn(
            "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))
        )
        name = F.concat_ws("#", F.col(key).cast("string"), F.col("_copy").cast("string"))
        pick = (seeded_unit(name, f"{seed}|neighbour") * k).cast("int")
        place = seeded_unit(name, f"{seed}|place")
        made = drawn.select(
            name.alias(key),
            F.lit(value).alias(label),
            F.zip_with(x, F.col("neighbours")[pick], lambda a, b: a + place * (b - a)).alias(x),
            F.lit(True).alias("synthetic"),
        )
        out = out.unionByName(made)
    return out
