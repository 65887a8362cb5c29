"""What each feature adds to the score of a row, for models made of trees.

A score less the mean score is split fairly over the features (Shapley values), where a
feature that is left out sends a row down both ways in proportion to the training rows that
went there. A leaf is reached through a few features only, so its share has a closed form;
the shares of all leaves of all trees are added up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.operators.boosting import Boosted, Tree, _matrix
from agoralytics.session import run_folder

# Rows whose contributions are added up at once.
ROWS = 16_384
# Features on a way up to which all patterns are listed.
LISTED = 8


@dataclass(frozen=True)
class Leaf:
    """A leaf's value, and per feature on the way to it (feature, low, high, share): it takes rows with
    low < x <= high, and a row without the feature goes on with that share."""

    value: float
    way: tuple[tuple[int, float, float, float], ...]


def _leaves(nodes: dict[int, dict], at: int, way: dict[int, tuple[float, float, float]]) -> Iterator[Leaf]:
    node = nodes[at]
    if node["left"] is None:
        yield Leaf(node["value"], tuple((f, *rest) for f, rest in way.items()))
        return
    f, cut = node["feature"], node["threshold"]
    low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
    for child, bounds in ((node["left"], (low, min(high, cut))), (node["right"], (max(low, cut), high))):
        part = nodes[child]["cover"] / node["cover"] if node["cover"] else 0.5
        yield from _leaves(nodes, child, way | {f: (*bounds, share * part)})


def boosted_leaves(model: Boosted) -> list[Leaf]:
    def nodes(tree: Tree) -> dict[int, dict]:
        inner = tree.feature >= 0
        return {
            i: {
                "value": float(tree.weight[i]), "cover": float(tree.cover[i]), "feature": int(tree.feature[i]), "threshold": float(tree.threshold[i]),
                "left": 2 * i + 1 if inner[i] else None, "right": 2 * i + 2 if inner[i] else None,
            }
            for i in range(len(inner))
        }

    return [leaf for tree in model.trees for leaf in _leaves(nodes(tree), 0, {})]


def forest_leaves(model, df: DataFrame) -> list[Leaf]:
    """Leaves of a fitted forest for two classes; their values add up to the probability of class 1.

    The nodes are read from the model as Spark saves it; there are as many as the model has.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    model.write().save(path)
    rows = df.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        stats = r.impurityStats
        inner = r.leftChild >= 0
        trees.setdefault(r.treeID, {})[r.id] = {
            "value": stats[1] / sum(stats) / model.getNumTrees if sum(stats) else 0.0, "cover": sum(stats),
            "feature": r.split.featureIndex, "threshold": r.split.leftCategoriesOrThreshold[0] if inner else None,
            "left": r.leftChild if inner else None, "right": r.rightChild if inner else None,
        }
    return [leaf for _, nodes in sorted(trees.items()) for leaf in _leaves(nodes, 0, {})]


def base_value(leaves: Sequence[Leaf]) -> float:
    """The mean score: that of a row of which nothing is known."""
    return float(sum(leaf.value * np.prod([share for *_, share in leaf.way]) for leaf in leaves))


def shares(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Contributions [row, feature]; a row's add up to its score less the base value."""
    return _added(x, _tables(leaves))


def _tables(leaves: Sequence[Leaf]) -> list[tuple[Leaf, np.ndarray | None]]:
    return [(leaf, by_pattern(leaf, np.arange(1 << len(leaf.way))) if len(leaf.way) <= LISTED else None) for leaf in leaves if leaf.way]


def _added(x: np.ndarray, tables: Sequence[tuple[Leaf, np.ndarray | None]]) -> np.ndarray:
    out = np.zeros((x.shape[1], len(x)))
    columns = np.ascontiguousarray(x.T)
    for start in range(0, len(x), ROWS):  # so few rows that what is added up stays in the cache
        part, sums = columns[:, start : start + ROWS], out[:, start : start + ROWS]
        for leaf, table in tables:
            code = np.zeros(part.shape[1], np.uint8 if len(leaf.way) <= 8 else np.int64)
            for f, low, high, _ in leaf.way:
                taken = part[f] <= high
                if low > -np.inf:
                    taken &= part[f] > low
                code = (code << 1) | taken
            if table is None:
                patterns, code = np.unique(code, return_inverse=True)
            for row, (f, *_) in zip(by_pattern(leaf, patterns) if table is None else table, leaf.way, strict=True):
                sums[f] += row[code]
    return np.ascontiguousarray(out.T)


def by_pattern(leaf: Leaf, patterns: np.ndarray) -> np.ndarray:
    """What each feature on the way adds, for some patterns of which of them let a row through (the first in the highest bit).

    On a way of n features only 2^n patterns can occur: they are worked out once and looked up for the rows.
    """
    n = len(leaf.way)
    takes = [(patterns >> (n - 1 - i) & 1).astype(np.float64) for i in range(n)]
    weight = [factorial(k) * factorial(n - 1 - k) / factorial(n) for k in range(n)]
    table = np.zeros((n, len(patterns)))
    for i, (_, _, _, share) in enumerate(leaf.way):
        # Coefficient k: the sum over all sets of k other features that are known, of what they let through.
        known = [np.ones(len(patterns))]
        for j, (*_, other) in enumerate(leaf.way):
            if j != i:
                with_it = [k * takes[j] for k in known]
                known = [a * other + b for a, b in zip([*known, 0.0], [0.0, *with_it], strict=True)]
        fair = sum(w * k for w, k in zip(weight, known, strict=True))
        table[i] = leaf.value * (takes[i] - share) * fair
    return table


def with_contributions(df: DataFrame, leaves: Sequence[Leaf], column: str = "features", name: str = "contributions") -> DataFrame:
    """Adds an array with what each feature adds to the score of the row."""
    shared = df.sparkSession.sparkContext.broadcast(_tables(leaves))

    def split(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors)
        out = _added(x, shared.value) if len(x) else x
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return df.withColumn(name, F.arrow_udf(split, "array<double>")(vector_to_array(column)))


def mean_contributions(df: DataFrame, leaves: Sequence[Leaf], features: Sequence[str]) -> DataFrame:
    """(feature, mean_contribution): mean absolute contribution over the rows, largest first."""
    split = with_contributions(df, leaves)
    means = split.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f) for i, f in enumerate(features)])
    return means.unpivot([], list(features), "feature", "mean_contribution").orderBy(F.col("mean_contribution").desc(), "feature")
