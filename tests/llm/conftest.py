import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def odd(spark):
    """Documents with nulls everywhere, ties, repeats, empty and very long texts, clashing columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t ", "en", "s", 3), (4, "one two", "en", "s", 7),
        (5, "one two", "en", "s", 7), (5, "one two", "en", "s", 7), (None, "one two", "en", "s", 7), (6, long, "en", "s", len(long)),
        (7, long + " end", "en", None, None), (8, "日本語 テキスト 😀 <|endoftext|> \x00", None, "s", 1), (None, None, None, None, None),
        (9, "a" * 5000, "de", "s", 5000), (10, "!!! ???", "de", "s", 7),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("label", "id", "item_id", "row", "page_id"):
        frame = frame.withColumn(name, frame.text)
    return frame


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
