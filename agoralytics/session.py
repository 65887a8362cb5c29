"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("agoralytics")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where none is configured and the session runs in one local JVM (tests)
    is one made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _local_folder:
            _local_folder.append(tempfile.TemporaryDirectory(prefix="agoralytics-"))
        folder = _local_folder[0].name
    return folder


_local_folder: list[tempfile.TemporaryDirectory] = []


def run_folder(spark: SparkSession) -> str:
    """The folder of this application inside the shared one; all it writes lies in it."""
    return f"{scratch_folder(spark)}/agoralytics-{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> None:
    """Deletes what this application wrote; results that are still to be read need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def clean_run(spark: SparkSession) -> Iterator[SparkSession]:
    """with clean_run(spark): ... deletes the intermediate tables at its end, also after an error."""
    try:
        yield spark
    finally:
        clear_run(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and goes on from there.

    A lost executor then costs no recomputation of what came before, numbers that
    depend on the partitioning stay as they are, and readers take only the
    columns they need.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return as_written(spark.read.schema(df.schema).parquet(path))


def as_written(df: DataFrame) -> DataFrame:
    """Notes that the rows are read from a written table, with nothing costly added."""
    df._is_written = True
    return df


def written(df: DataFrame) -> DataFrame:
    """The rows, written unless they are known to be."""
    return df if getattr(df, "_is_written", False) else cut_lineage(df)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only if the table has at most `rows` rows; the count stops there.

    Beyond that the join is left to Spark, which splits skewed partitions.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df
