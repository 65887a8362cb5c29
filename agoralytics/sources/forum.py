"""Reading and writing the forum tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoralytics.config import COLUMN_NAMES
from agoralytics.functions.values import id_number, parse_date

EXTRA_FIELD = "_extra_field"

# Ids and dates are read as text and cast afterwards, because `12.0` is a valid id
# and a bad date must become NULL.
_IDS = ("message_id", "topic_id", "group_id", "account_id")
_DATES = ("post_date", "start_date")


@dataclass(frozen=True)
class ForumTables:
    """The tables of one forum; `integrated` marks messages filtered upstream."""

    messages: DataFrame
    topics: DataFrame
    groups: DataFrame
    accounts: DataFrame | None = None
    integrated: bool = False

    def with_messages(self, messages: DataFrame) -> ForumTables:
        return replace(self, messages=messages)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns of a CSV file, or of a folder of them, as text.

    A line with more fields than the header has a value in `_extra_field`; a
    shorter line is fine. With line breaks inside quotes a file is read by one
    task, so a large dump should come as many files; without any, set multi_line
    to False and files are split.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "encoding": "UTF-8"}
    header = spark.read.options(**options, inferSchema=False).csv(path).columns
    fields = [T.StructField(name, T.StringType()) for name in [*header, EXTRA_FIELD]]
    return spark.read.options(**options).schema(T.StructType(fields)).csv(path)


def bad_lines(raw: DataFrame) -> DataFrame:
    """The lines with too many fields, for a warning report."""
    return raw.filter(F.col(EXTRA_FIELD).isNotNull())


def typed(raw: DataFrame) -> DataFrame:
    """Our column names and types for a table read from the dump, bad lines left out."""
    columns = []
    for column in raw.columns:
        name = COLUMN_NAMES.get(column, column)
        if column == EXTRA_FIELD:
            continue
        if name in _IDS:
            columns.append(id_number(column).alias(name))
        elif name in _DATES:
            columns.append(parse_date(column).alias(name))
        else:
            columns.append(F.col(column).alias(name))
    return raw.filter(F.col(EXTRA_FIELD).isNull()).select(*columns)


def read_forum(
    spark: SparkSession,
    folder: str,
    integrated_messages: str | None = None,
    multi_line: bool = True,
) -> ForumTables:
    """Tables of a dump folder.

    Given integrated messages take the place of the raw ones, and the filters
    that made them are not run again. For multi_line see read_csv; it is for the
    messages, the one large table.
    """
    names = ["topics", "groups", "accounts"]
    tables = {name: typed(read_csv(spark, f"{folder}/{name}.csv")) for name in names}
    messages = typed(read_csv(spark, integrated_messages or f"{folder}/messages.csv", multi_line))
    return ForumTables(
        messages=messages,
        topics=tables["topics"],
        groups=tables["groups"].withColumnRenamed("name", "group_name"),
        accounts=tables["accounts"],
        integrated=integrated_messages is not None,
    )


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.options(header=True, escape='"', quoteAll=False).csv(path)
    else:
        writer.format(kind).save(path)


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One output per table."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", kind)
