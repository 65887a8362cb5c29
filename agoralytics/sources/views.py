"""Forum tables over the generic test tables (events, documents, nation, labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoralytics.operators.threads import replies
from agoralytics.sources.forum import ForumTables


# Tables with long texts and their keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}
# Parts that one split of a file becomes when such a table is spread.
PARTS_PER_SPLIT = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table. Texts that come in fewer files than there are cores are spread
    once, or all work on them would run in one task. The number of parts grows with the
    files, so that a task's share of the texts does not; a table of many files is left alone."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and len(rows.inputFiles()) < cores:
        parts = max(cores, PARTS_PER_SPLIT * rows.rdd.getNumPartitions())
        rows = rows.repartition(parts, TEXT_TABLES[name])
    return rows


def with_text(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """Fetches the texts of messages that carry the document's id."""
    texts = documents.select("doc_id", F.col("text").alias("message_text"))
    return messages.join(texts, "doc_id")


def forum_tables(spark: SparkSession, folder: str) -> ForumTables:
    """Each event is a message, each user a poster; the texts are the documents.

    Messages come without text, as a scan of a columnar table would read them;
    `with_text` adds it where it is needed.
    """
    events = table(spark, folder, "events")
    block = F.expr("event_id div 8")
    size = spark.read.parquet(f"{folder}/documents.parquet").agg(F.count("*")).scalar()
    messages = events.select(
        F.col("event_id").alias("message_id"),
        F.when(block % 10 == 0, F.lit(1_000_000_000) + F.col("event_id"))
        .otherwise(block)
        .alias("topic_id"),
        F.col("user_id").alias("poster_id"),
        F.col("ts").alias("post_date"),
        (F.col("event_id") % size).alias("doc_id"),
    )
    topic_ids = events.select(
        F.when(block % 10 == 0, F.lit(1_000_000_000) + F.col("event_id"))
        .otherwise(block)
        .alias("topic_id")
    ).distinct()
    topics = topic_ids.select(
        "topic_id",
        F.when(F.col("topic_id") % 400 == 7, 100)
        .when(F.col("topic_id") % 397 == 5, 101)
        .otherwise(F.col("topic_id") % 25)
        .cast("long")
        .alias("group_id"),
    )
    nation = table(spark, folder, "nation")
    groups = nation.select(
        F.col("n_nationkey").cast("long").alias("group_id"),
        (F.lit(2) + F.col("n_regionkey") % 2).cast("long").alias("account_id"),
        F.col("n_name").alias("group_name"),
    ).unionByName(
        spark.sql(
            "SELECT * FROM VALUES (100L, 1L, 'TEST'), (101L, 4L, 'DEMO') "
            "AS g(group_id, account_id, group_name)"
        )
    )
    return ForumTables(messages, topics, groups)


def moderators(messages: DataFrame) -> DataFrame:
    """Posters that play the moderators in these views."""
    return messages.filter(F.col("poster_id") % 29 == 3).select("poster_id").distinct()


def annotated(structured: DataFrame, labels: DataFrame) -> DataFrame:
    """Hand labels of the replies whose document has a quality label."""
    label = F.when(F.col("quality") == 1, "SS").otherwise("NSS")
    kind = (
        F.when(F.col("doc_id") % 3 == 0, "informational")
        .when(F.col("doc_id") % 3 == 1, "emotional")
        .otherwise("other")
    )
    return (
        replies(structured)
        .join(labels.select("doc_id", "quality"), "doc_id")
        .withColumn("label", label)
        .withColumn("support_type", F.when(F.col("label") == "SS", kind).otherwise("N/A"))
        .drop("quality")
    )
