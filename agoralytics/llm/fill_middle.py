"""Fill-in-the-middle: one match of a pattern with counted units cuts a text in three.

The number of units is counted first; the two cuts follow from the document's id. A
pattern made for the row, `(unit{a})(unit{b-a})(rest)`, then captures prefix, middle and
suffix at once, and the replacement puts them in the order that the form asks for. Units
and counts are possessive: there is one way to match, no step back, and no recursion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.common import texts_of

#: A word with the white space before it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


@dataclass(frozen=True)
class Plan:
    """How texts are cut; rates are per cent. The markers have to differ and must not overlap each other."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _draws(plan: Plan) -> list[Column]:
    """Four unsigned 32-bit numbers from the id; a missing id has no digits."""
    digits = F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    code = F.sha2(digits, 256)
    return [F.conv(F.substring(code, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _quoted(marker: str) -> str:
    """The marker as a replacement that stands for itself."""
    return marker.replace("\\", "\\\\").replace("$", "\\$")


def transform(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, text, n, form and output of every row of documents(doc_id, text).

    n: units of the text. form: plain (output is the text), psm (prefix, suffix, middle) or
    spm (suffix, prefix, middle). Empty and missing texts, those that hold a marker and the
    share that the rate leaves are plain. Parts may be empty. Rows may repeat (ids decide, so
    equal rows get equal outputs); a missing id is drawn like an id without digits. Other
    columns of the input don't matter; no rows give no rows.
    """
    h1, h2, h3, h4 = _draws(plan)
    text = F.col("text")
    marked = F.lit(False)
    for marker in plan.markers:
        marked = marked | F.contains(text, F.lit(marker))
    form = (
        F.when((text == "") | marked | (h3 % 100 >= plan.rate), "plain")
        .when(h4 % 100 < plan.suffix_first, "spm").otherwise("psm")
    )
    counted = texts_of(docs, "doc_id").select(
        "doc_id", "text", F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), form.alias("form"),
        h1.alias("h1"), h2.alias("h2"),
    )
    first, second = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    cuts = counted.select("doc_id", "text", "n", "form", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    units = "((?:" + UNIT + "){%d}+)"
    pattern = F.format_string(r"(?s)\A" + units + units + r"(.*+)\z", F.col("a"), F.col("b") - F.col("a"))
    p, s, m = map(_quoted, plan.markers)
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    output = F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order))
    return cuts.select("doc_id", "text", "n", "form", output.alias("output"))


def parts(frame: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """frame(form, output, ...) and `parts`: prefix, middle and suffix; null if the form is plain.

    Markers don't overlap, so the first of each in an output is the one that was put there.
    """
    inner = "|".join(map(re.escape, plan.markers))
    split = frame.withColumn("cut", F.when(F.col("form") != "plain", F.split("output", inner, -1)))
    prefix = F.when(F.col("form") == "psm", F.col("cut")[1]).otherwise(F.col("cut")[2])
    suffix = F.when(F.col("form") == "psm", F.col("cut")[2]).otherwise(F.col("cut")[1])
    struct = F.struct(prefix.alias("prefix"), F.col("cut")[3].alias("middle"), suffix.alias("suffix"))
    return split.withColumn("parts", F.when(F.col("form") != "plain", struct)).drop("cut")


def restored(frame: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """frame(form, output, ...) with `parts` and `restored`: the text, from form and output alone."""
    whole = F.concat("parts.prefix", "parts.middle", "parts.suffix")
    return parts(frame, plan).withColumn("restored", F.coalesce(whole, "output"))


def digests(transformed: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, and digests of output and restored text."""
    return restored(transformed.drop("text"), plan).select(
        "doc_id", "n", "form",
        F.length("parts.prefix").cast("long").alias("prefix_chars"),
        F.length("parts.middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


#: The same from lists of units.
ORACLE = r"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS code,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
        FROM documents
    ), h AS (
        SELECT doc_id, body, units, CAST(len(units) AS BIGINT) AS n,
            CAST('0x' || code[1:8] AS BIGINT) AS h1, CAST('0x' || code[9:16] AS BIGINT) AS h2,
            CAST('0x' || code[17:24] AS BIGINT) AS h3, CAST('0x' || code[25:32] AS BIGINT) AS h4
        FROM t
    ), c AS (
        SELECT doc_id, body, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM h
    ), p AS (
        SELECT doc_id, body, n, form, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
            array_to_string(units[b + 1:n], '') AS suf
        FROM c
    )
    SELECT doc_id, n, form,
        CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(body) AS restored_sha256
    FROM p
"""
