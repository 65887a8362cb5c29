"""Linear classifier with squared hinge loss, fitted by Newton steps.

Each pass adds up loss, gradient and curvature of all rows: numbers whose count depends on
the features alone, first in each task, then in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.operators.boosting import _matrix
from agoralytics.session import cut_lineage


@dataclass(frozen=True)
class HingeModel:
    """Weights of the standardised features; the last is that of the constant."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @property
    def coefficients(self) -> list[float]:
        return self.weights[:-1].tolist()

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds scaled, margin and prediction."""
        x = vector_to_array("features")
        unit = F.array(*[(x[i] - float(m)) / float(s) for i, (m, s) in enumerate(zip(self.mean, self.scale, strict=True))])
        scaled = df.withColumn("scaled", unit)
        margin = F.lit(float(self.weights[-1]))
        for i, w in enumerate(self.coefficients):
            margin = margin + F.col("scaled")[i] * float(w)
        return scaled.withColumn("margin", margin).withColumn("prediction", (F.col("margin") > 0).cast("double"))


@dataclass(frozen=True)
class SquaredHinge:
    """Minimises |w|^2 / 2 + c * sum(weight * max(0, 1 - y * margin)^2); the constant is penalised like any weight.

    Rows have features, target (0 or 1) and weight. Features of one value get scale 1. No rows give a model that says 0.
    """

    c: float = 1.0
    most: int = 50
    tolerance: float = 1e-8

    def fit(self, rows: DataFrame) -> HingeModel:
        narrow = cut_lineage(
            rows.where(F.col("target").isNotNull()).select(
                vector_to_array("features").alias("x"), F.when(F.col("target") > 0, 1.0).otherwise(-1.0).alias("y"), F.col("weight").cast("double").alias("weight")
            )
        )
        first = narrow.select(F.size("x").alias("n")).head()
        n = first.n if first else 0
        if not n:
            return HingeModel(np.zeros(1), np.zeros(0), np.ones(0))
        moments = narrow.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(n)]).head()
        mean, scale = np.array(moments[:n]), np.array(moments[n:])
        scale = np.where(scale > 0, scale, 1.0)
        w, step = np.zeros(n + 1), np.zeros(n + 1)
        best = None
        for _ in range(self.most):
            loss, slope, curve = self._sums(narrow, mean, scale, w)
            if best is not None and loss > best[0] + 1e-12 * abs(best[0]):
                step = step / 2  # it went too far
                w = best[1] + step
                continue
            best = (loss, w)
            if np.abs(slope).max() <= self.tolerance * max(1.0, abs(loss)):
                break
            step = -np.linalg.solve(curve, slope)
            w = w + step
        return HingeModel(best[1], mean, scale)

    def _sums(self, rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, c = len(w), self.c

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + n + n * n)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([(_matrix(batch.column("x")) - mean) / scale, np.ones(batch.num_rows)])
                y, weight = batch.column("y").to_numpy(), batch.column("weight").to_numpy()
                short = 1 - y * (x @ w)
                x, y, weight, short = (a[short > 0] for a in (x, y, weight, short))
                total[0] += c * (weight * short * short).sum()
                total[1 : 1 + n] += -2 * c * (weight * short * y) @ x
                total[1 + n :] += (2 * c * (x * weight[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

        parts = rows.mapInArrow(add, "part array<double>").select(F.posexplode("part"))
        sums = np.zeros(1 + n + n * n)
        for row in parts.groupBy("pos").agg(F.sum("col").alias("s")).collect():  # a number per pair of features
            sums[row.pos] = row.s
        curve = sums[1 + n :].reshape(n, n) + np.eye(n)
        return sums[0] + (w @ w) / 2, sums[1 : 1 + n] + w, curve
