"""Pseudonyms for ids and placeholders for personal data in texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.functions import text as tx
from agoralytics.operators.names import ENTITIES, chunked, find_names
from agoralytics.operators.ordering import position
from agoralytics.operators.tagger import Tagger
from agoralytics.session import cut_lineage

# Fixed value: the pattern of mail addresses; only its word edges are spelled out,
# because `\b` of Java knows ASCII only.
# The first one is tested after its character, and what stands before `@` is never given back.
EMAIL_CHARACTER = "[A-Za-z0-9._%+-]"
EMAIL_START = rf"(?:[A-Za-z0-9_](?<![{tx.WORD}].)|[.%+-](?<=[{tx.WORD}].))"
EMAIL = rf"{EMAIL_START}{EMAIL_CHARACTER}*+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{tx.WORD_EDGE}"

# The characters that a link may hold, as one class: repeated alternatives overflow
# the stack of Java's matcher on a link of 20,000 characters.
URL = r"https?://[!$-_a-z]+"

# What looks like a placeholder already is masked too, or restoring would change it.
PLACEHOLDER = r"\[ENTITY_[A-Za-z]+_[0-9]+\]"

PATTERNS = {"URL": URL, "EMAIL": EMAIL, "LITERAL": PLACEHOLDER}

# What every hit of a pattern holds; texts without it are not searched for the pattern.
HOLDS = {URL: "://", EMAIL: "@", PLACEHOLDER: "[ENTITY_"}

# ids -------------------------------------------------------------------------


def pseudonym_map(
    tables: Sequence[DataFrame], column: str = "poster_id", prefix: str = "user_"
) -> DataFrame:
    """(original_id, pseudonym): user_1, user_2, ... in the order of all ids."""
    ids = reduce(
        DataFrame.unionByName,
        [
            t.select(F.col(column).alias("original_id")).filter(F.col(column).isNotNull())
            for t in tables
            if column in t.columns
        ],
    ).distinct()
    ranked = position(ids, [F.col("original_id").asc()], "_rank")
    return ranked.select(
        "original_id",
        F.concat(F.lit(prefix), (F.col("_rank") + 1).cast("string")).alias("pseudonym"),
    )


def pseudonymize(df: DataFrame, names: DataFrame, column: str = "poster_id") -> DataFrame:
    """Replaces the ids; a missing id stays missing."""
    renamed = names.select(F.col("original_id").alias(column), "pseudonym")
    return df.join(renamed, column, "left").select(
        *[F.col("pseudonym").alias(c) if c == column else F.col(c) for c in df.columns]
    )


# entities --------------------------------------------------------------------


def _by_form(texts: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """Adds `entities` and `_gaps`, the text between them, for what patterns can tell.

    The search for mail addresses takes most of the time, so a text is searched for all patterns if it holds an `@`,
    else for the others if it holds what they need; it is cut at the hits only if there are any.
    """
    every = "|".join(f"(?:{p})" for p in patterns.values())
    plain = [p for p in patterns.values() if p != EMAIL]
    text = F.col(column)
    searches = [(EMAIL, every)] if EMAIL in patterns.values() and plain else []
    searches += [(p, "|".join(f"(?:{q})" for q in plain) if plain else every) for p in plain or [EMAIL]]
    hits = None
    for needed, pattern in searches:
        holds = text.contains(HOLDS[needed]) if needed in HOLDS else F.lit(True)
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        hits = F.when(holds, found) if hits is None else hits.when(holds, found)
    found = texts.withColumn("_hits", hits.otherwise(F.array().cast("array<string>"))).withColumn(
        "_gaps", F.when(F.size("_hits") > 0, F.split(text, F.lit(every), -1)).otherwise(F.array(text))
    )
    kind = lambda hit: F.coalesce(
        *[F.when(hit.rlike(rf"^(?:{p})\z"), F.lit(name)) for name, p in _whole_patterns(patterns).items()]
    )
    zipped = F.arrays_zip(F.col("_gaps").alias("gap"), F.col("_hits").alias("hit"))
    entities = F.aggregate(
        F.filter(zipped, lambda z: z["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(ENTITIES).alias("out")),
        lambda acc, z: F.struct(
            (acc["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    kind(z["hit"]).alias("type"),
                    (acc["at"] + F.length(z["gap"])).alias("start"),
                    (acc["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("end"),
                    z["hit"].alias("text"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return found.withColumn("entities", F.coalesce(entities, F.array().cast(ENTITIES))).drop("_hits")


def _found(
    texts: DataFrame, key: str, column: str, gazetteer: DataFrame | None, patterns: Mapping[str, str], tagger: Tagger | None = None
) -> DataFrame:
    """Adds `entities`, `_gaps` (the text around them) and `_numbers` (how often each one's type still comes from there on)."""
    if patterns:
        found = _by_form(texts, column, patterns)
    else:
        found = texts.withColumn("entities", F.array().cast(ENTITIES)).withColumn("_gaps", F.array(F.col(column)))
    if gazetteer is not None:
        found = find_names(found, gazetteer, key, column, "entities", "_named")
    if tagger is not None:
        given = found if gazetteer is None else found.withColumn("entities", F.col("_named.entities"))
        found = tagger.add_entities(given, column, "entities", "_named")
    if gazetteer is None and tagger is None:
        rest = F.transform(
            "entities",
            lambda e, i: F.size(F.filter(F.slice("entities", i + 1, F.size("entities")), lambda x: x["type"] == e["type"])),
        )
        return found.withColumn("_numbers", rest)
    return found.withColumns(
        {
            "entities": F.coalesce("_named.entities", F.array().cast(ENTITIES)),
            "_gaps": F.col("_named.gaps"),
            "_numbers": F.coalesce("_named.numbers", F.array().cast("array<int>")),
        }
    ).drop("_named")


def with_entities(
    texts: DataFrame,
    key: str,
    column: str,
    gazetteer: DataFrame | None = None,
    patterns: Mapping[str, str] = PATTERNS,
    tagger: Tagger | None = None,
) -> DataFrame:
    """Adds `entities`, an array of (type, start, end, text) without overlaps.

    Positions count characters from 0. Of overlapping entities the one that
    starts first wins; at one place what a pattern found, then the longest name. Names come
    from the gazetteer (term, type), one type per term, in any case and with any
    white space between their words, and then from a trained tagger.
    """
    return _found(texts, key, column, gazetteer, patterns, tagger).drop("_gaps", "_numbers")


def _whole_patterns(patterns: Mapping[str, str]) -> dict[str, str]:
    """The patterns for testing a found text, whose surroundings are gone."""
    return {name: p.replace(EMAIL_START, EMAIL_CHARACTER).replace(tx.WORD_EDGE, "") for name, p in patterns.items()}


def extract_entities(
    texts: DataFrame,
    key: str,
    column: str,
    gazetteer: DataFrame | None = None,
    patterns: Mapping[str, str] = PATTERNS,
    tagger: Tagger | None = None,
) -> DataFrame:
    """One row per entity: (key, type, start, end, text)."""
    return (
        with_entities(texts, key, column, gazetteer, patterns, tagger)
        .select(key, F.explode("entities").alias("e"))
        .select(key, "e.type", "e.start", "e.end", "e.text")
    )


# masks -----------------------------------------------------------------------


def mask_text(
    texts: DataFrame,
    key: str,
    column: str,
    gazetteer: DataFrame | None = None,
    patterns: Mapping[str, str] = PATTERNS,
    tagger: Tagger | None = None,
) -> DataFrame:
    """Adds `masked` and `mask_map`, and keeps `entities`.

    Each entity becomes [ENTITY_<type>_<n>], where n counts the entities of the
    type from the end of the text; the map leads back from placeholder to text.
    """
    found = _found(texts, key, column, gazetteer, patterns, tagger)
    no_text = F.array().cast("array<string>")
    marks = F.transform(
        F.arrays_zip("entities", "_numbers"),
        lambda z: F.concat(F.lit("[ENTITY_"), z["entities"]["type"], F.lit("_"), z["_numbers"].cast("string"), F.lit("]")),
    )
    # There is one gap more than there are marks.
    joined = F.array_join(F.zip_with("_gaps", "_marks", lambda gap, mark: F.concat(gap, F.coalesce(mark, F.lit("")))), "")
    return (
        found.withColumn("_marks", marks)
        .withColumn("masked", F.when(F.size("entities") > 0, joined).otherwise(F.col(column)))
        .withColumn(
            "mask_map",
            F.map_from_arrays(F.coalesce("_marks", no_text), F.coalesce(F.transform("entities", lambda e: e["text"]), no_text)),
        )
        .drop("_marks", "_gaps", "_numbers")
    )


_PLACEHOLDER = re.compile(PLACEHOLDER)


def _restored(texts: pa.Array, maps: pa.Array) -> pa.Array:
    out = []
    for text, held in zip(texts.to_pylist(), maps.to_pylist(), strict=True):
        back = {mark: entity for mark, entity in held or () if entity is not None}
        out.append(_PLACEHOLDER.sub(lambda m: back.get(m[0], m[0]), text) if text and back else text)  # noqa: B023
    return pa.array(out, pa.string())


def unmask(masked: Column | str, mask_map: Column | str) -> Column:
    """The text before masking: each placeholder is looked up once, from left to right.

    A text's map is read once, whatever the number of its placeholders.
    """

    def restore(texts: pa.Array, maps: pa.Array) -> pa.Array:
        return chunked(_restored, texts, maps)

    columns = [F.col(c) if isinstance(c, str) else c for c in (masked, mask_map)]
    return F.arrow_udf(restore, "string")(*columns)


def entity_review(masked: DataFrame, key: str, column: str) -> DataFrame:
    """Per text its entities, for a reviewer."""
    return masked.select(key, F.lit(column).alias("column"), "entities")


def text_review(masked: DataFrame, key: str, column: str) -> DataFrame:
    """Texts before and after masking."""
    return masked.select(
        key, F.col(column).alias("original_text"), F.col("masked").alias("anonymized_text")
    )


def mask_with_review(
    df: DataFrame,
    key: str,
    column: str,
    gazetteer: DataFrame | None = None,
    patterns: Mapping[str, str] = PATTERNS,
    tagger: Tagger | None = None,
) -> DataFrame:
    """Adds <column>_anon, and `entities` and `mask_map` of both passes.

    Links and mail addresses are masked first; then mentions lose their `@`, so
    that the names in them are found by the gazetteer or the tagger. Positions of names
    count in the text that the first pass left.
    """
    anon = f"{column}_anon"
    out = mask_text(df, key, column, None, patterns).withColumn(anon, tx.plain_mentions("masked"))
    if gazetteer is None and tagger is None:
        return out.drop("masked")
    out = out.withColumnsRenamed({"entities": "_by_form", "mask_map": "_form_map"}).drop("masked")
    named = mask_text(out, key, anon, gazetteer, {}, tagger)
    return (
        named.withColumn(anon, F.col("masked"))
        .withColumn("entities", F.concat("_by_form", "entities"))
        .withColumn("mask_map", F.map_concat("_form_map", "mask_map"))
        .drop("masked", "_by_form", "_form_map")
    )


def mask_columns(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    gazetteer: DataFrame | None = None,
    replace_original: bool = True,
    patterns: Mapping[str, str] = PATTERNS,
    tagger: Tagger | None = None,
) -> DataFrame:
    """Masks several columns, in place or as `<column>_anon`; absent ones are skipped."""
    out = df
    for column in columns:
        if column not in df.columns:
            continue
        out = mask_with_review(out, key, column, gazetteer, patterns, tagger).drop("entities", "mask_map")
        if replace_original:
            out = out.withColumn(column, F.col(f"{column}_anon")).drop(f"{column}_anon")
    return out
