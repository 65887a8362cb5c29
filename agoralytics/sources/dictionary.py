"""Word-category dictionaries in the `%`-delimited text format.

    %
    1<TAB>function
    %
    the<TAB>1
    enti*<TAB>1<TAB>4

A word that ends in `*` stands for all words that start with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agoralytics.functions.text import strip


@dataclass(frozen=True)
class Dictionary:
    """categories(dictionary_id, cat_id, name) and
    entries(dictionary_id, term, is_prefix, cat_ids)."""

    categories: DataFrame
    entries: DataFrame


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """Dictionary of one file, or of each file the path matches."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("dictionary_id"), F.col("value").alias("content")
    )
    return parse_dictionary(files)


def _lines(section: Column) -> Column:
    """Lines with their number, stripped, blank ones left out."""
    lines = F.split(section, r"\r\n|\r|\n")
    numbered = F.transform(
        lines, lambda line, i: F.struct(i.alias("line"), strip(line).alias("text"))
    )
    return F.filter(numbered, lambda x: x["text"] != "")


def parse_dictionary(texts: DataFrame) -> Dictionary:
    """Parses rows (dictionary_id, content), one whole dictionary each.

    Of a word listed twice the last line counts. Lines without a tab, category
    lines without a number and words without category are left out. Less than
    three sections is an error.
    """
    content = strip(F.regexp_replace("content", r"^\x{feff}", ""))
    sections = F.split(content, "%")
    checked = F.when(F.size(sections) >= 3, sections).otherwise(
        F.raise_error(F.lit("a dictionary needs sections separated by '%'")).cast(
            "array<string>"
        )
    )
    parts = texts.select("dictionary_id", checked.alias("sections"))

    def fields(number: int) -> DataFrame:
        return (
            parts.select(
                "dictionary_id", F.explode(_lines(F.col("sections")[number])).alias("row")
            )
            .select(
                "dictionary_id",
                F.col("row.line").alias("line"),
                F.transform(F.split("row.text", "\t"), strip).alias("fields"),
            )
            .filter(F.size("fields") >= 2)
        )

    categories = (
        fields(1)
        .select(
            "dictionary_id",
            "line",
            F.col("fields")[0].try_cast("int").alias("cat_id"),
            F.col("fields")[1].alias("name"),
        )
        .filter(F.col("cat_id").isNotNull())
        .groupBy("dictionary_id", "cat_id")
        .agg(F.max_by("name", "line").alias("name"))
    )
    numbers = F.filter(
        "fields", lambda t, i: (i > 0) & t.rlike(r"^[0-9]+\z")
    ).cast("array<int>")
    entries = (
        fields(2)
        .select(
            "dictionary_id",
            "line",
            F.lower(F.col("fields")[0]).alias("word"),
            numbers.alias("cat_ids"),
        )
        .filter(F.size("cat_ids") > 0)
        .groupBy("dictionary_id", "word")
        .agg(F.max_by("cat_ids", "line").alias("cat_ids"))
        .select(
            "dictionary_id",
            F.regexp_replace("word", r"\*\z", "").alias("term"),
            F.col("word").endswith("*").alias("is_prefix"),
            "cat_ids",
        )
    )
    return Dictionary(categories, entries)


def duplicate_names(categories: DataFrame) -> DataFrame:
    """Category names with more than one id: scores need names to be unique."""
    return categories.groupBy("dictionary_id", "name").count().filter("count > 1")
