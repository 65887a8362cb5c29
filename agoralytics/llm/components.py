"""Connected components by smallest labels and pointer jumping, a few joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id of the edges (a, b); the label is the smallest id reached.

    Edges may repeat, run either way and join an id to itself; those with a null are
    left out. No edges give no rows. Each round takes the smallest label among the
    neighbours, then the label's own label, so stars end after two rounds and a chain
    of n ids after about log n. Rounds are written to the shared folder.
    """
    known = edges.where("a is not null and b is not null")
    both = cut_lineage(
        known.select("a", "b").union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
        .select("id", F.least("id", "label").alias("label"), F.lit(True).alias("changed"))
    )
    while not labels.where("changed").isEmpty():
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        step = cut_lineage(
            labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = cut_lineage(
            step.join(jump, "label")
            .select("id", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("changed"))
        )
    return labels.select("id", "label")
