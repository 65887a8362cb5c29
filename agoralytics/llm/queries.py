"""Registered queries of this subpackage, each next to the SQL that checks it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from agoralytics.llm import (
    cotrain, fill_middle, golomb_dedup, gray_index, html_paths, line_winnow, ngram_join, piece_codec, resample,
    sequence_files, spaced_seeds, suffix_arrays, surrogates,
)
from agoralytics.llm.common import table


def op1_html_paths(spark: SparkSession, folder: str) -> DataFrame:
    return html_paths.main_text(table(spark, folder, "pages"))


def op2_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_arrays.remove_repeats(table(spark, folder, "documents")).drop("spans")


def op3_line_winnow(spark: SparkSession, folder: str) -> DataFrame:
    return line_winnow.drop_repeats(table(spark, folder, "documents"))


def op4_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace_private(table(spark, folder, "documents"), key="key of the check")


def op5_cotrain(spark: SparkSession, folder: str) -> DataFrame:
    return cotrain.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.digests(piece_codec.encode_and_decode(table(spark, folder, "documents"), path))


def op7_sequence_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return sequence_files.round_trip(table(spark, folder, "documents"), path, end_id=2)


def op8_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return spaced_seeds.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_golomb_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return golomb_dedup.exact_duplicates(table(spark, folder, "documents")).drop("first")


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(table(spark, folder, "documents")))


def op12_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_gray_index(spark: SparkSession, folder: str) -> DataFrame:
    return gray_index.near_duplicates(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_paths, op2_suffix_arrays, op3_line_winnow, op4_surrogates, op5_cotrain,
        op6_piece_codec, op7_sequence_files, op8_spaced_seeds, op9_golomb_dedup, op10_ngram_join, op11_fill_middle, op12_resample, op13_gray_index,
    )
}

ORACLES = {
    "op3_line_winnow": line_winnow.ORACLE,
    "op9_golomb_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY body)
    """,
    "op11_fill_middle": fill_middle.ORACLE,
}
