"""Registered queries: text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoralytics.catalog.base import SPACE, Stages, oracle, strip_sql, words_sql
from agoralytics.functions import text as tx


def _documents(spark, folder):
    return Stages(spark, folder).table("documents")


def _spliced(cases: dict[int, tuple[str, str]], step: int):
    """Text with literals before and after it, by doc_id."""
    text = F.col("text")
    for rest, (before, after) in cases.items():
        text = F.when(
            F.col("doc_id") % step == rest, F.concat(F.lit(before), F.col("text"), F.lit(after))
        ).otherwise(text)
    return text


def _sql_text(value: str) -> str:
    for char, code in (("\n", 10), ("\t", 9), ("\r", 13)):
        value = value.replace(char, f"' || chr({code}) || '")
    return f"'{value}'"


def _spliced_sql(cases: dict[int, tuple[str, str]], step: int) -> str:
    whens = " ".join(
        f"WHEN {rest} THEN {_sql_text(before)} || text || {_sql_text(after)}"
        for rest, (before, after) in cases.items()
    )
    return f"(CASE doc_id % {step} {whens} ELSE text END)"


_QUOTES = {
    0: ("", " [QUOTE=a]b\nc[/quote] y"),
    1: ("> q\n", "\n> z\n\n\n\nend \n"),
}
_LINKS = {0: ("", " https://x.example/a b www.q.r"), 1: ("www.q.r/1\t", " wat?!?! ok... a!!\r\n ")}
_MENTIONS = {0: ("", " @jan_de_boer hoi @x_1"), 1: ("@", " @")}


def html_to_text(spark, folder):
    pages = Stages(spark, folder).table("pages")
    return pages.select("page_id", tx.html_to_text("html").alias("text"))


def strip_quotes(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", tx.strip_quotes(_spliced(_QUOTES, 3)).alias("text")
    )


def strip_urls(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", tx.strip_urls(_spliced(_LINKS, 3)).alias("text")
    )


def collapse_punct(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", tx.collapse_punctuation(_spliced(_LINKS, 3)).alias("text")
    )


def standardize_text(spark, folder):
    clean = _documents(spark, folder).select(
        "doc_id", tx.standardize(_spliced(_LINKS, 3)).alias("message_text")
    )
    return clean.withColumn("message_text_normalized", F.lower("message_text"))


def normalize_text(spark, folder):
    return _documents(spark, folder).select("doc_id", tx.normalize("text").alias("text_normalized"))


def at_mentions(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", tx.plain_mentions(_spliced(_MENTIONS, 3)).alias("text")
    )


def word_counts(spark, folder):
    return _documents(spark, folder).select("doc_id", tx.word_count("text").alias("words"))


_TAG = r"""<[!?/a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[!?/a-zA-Z][^>]*>"""


def _html_sql() -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', chr(1), 'g')"
    for name in ("script", "style", "template"):
        out = f"regexp_replace({out}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', chr(1), 'g')"
    out = f"regexp_replace({out}, '{_TAG}', chr(1), 'g')"
    out = f"regexp_replace({out}, '\\x01+', ' ', 'g')"
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")):
        # The semicolon may be missing, as in a title that was cut short.
        out = f"regexp_replace({out}, '&{name}(?:;|$|([^a-zA-Z0-9;]))', '{char}\\1', 'g')"
    return strip_sql(out)


_NO_LINKS = (
    f"regexp_replace({_spliced_sql(_LINKS, 3)}, 'https?://[^{SPACE}]+|www\\.[^{SPACE}]+', '', 'g')"
)
_ONE_MARK = r"regexp_replace({0}, '([!?.]){{2,}}', '\1', 'g')"
_ONE_LINE = (
    "regexp_replace(regexp_replace("
    + _ONE_MARK.format(_NO_LINKS)
    + r", '[\r\n\t]+', ' ', 'g'), ' {2,}', ' ', 'g')"
)
_MENTION_SQL = (
    "CASE doc_id % 3 WHEN 0 THEN plain || ' jan de boer hoi x 1' "
    "WHEN 1 THEN regexp_replace('@' || plain, '^@([\\p{L}\\p{N}_])', '\\1') || ' @' ELSE plain END"
)

QUERIES = {
    f.__name__: f
    for f in (
        html_to_text, strip_quotes, strip_urls, collapse_punct, standardize_text,
        normalize_text, at_mentions, word_counts,
    )
}

ORACLES = {
    "html_to_text": f"SELECT page_id, {_html_sql()} AS text FROM pages",
    "strip_quotes": "SELECT doc_id, "
    + strip_sql(
        "regexp_replace(regexp_replace(regexp_replace("
        + _spliced_sql(_QUOTES, 3)
        + r", '(?is)\[quote[^\]]*\].*?\[/quote\]', '', 'g'), '(?m)^>.*$', '', 'g'), "
        r"'\n{3,}', chr(10) || chr(10), 'g')"
    )
    + " AS text FROM documents",
    "strip_urls": f"SELECT doc_id, {_NO_LINKS} AS text FROM documents",
    "collapse_punct": f"SELECT doc_id, {_ONE_MARK.format(_spliced_sql(_LINKS, 3))} AS text FROM documents",
    "standardize_text": f"""
        SELECT doc_id, message_text, lower(message_text) AS message_text_normalized
        FROM (SELECT doc_id, {strip_sql(_ONE_LINE)} AS message_text FROM documents)""",
    "normalize_text": oracle("SELECT doc_id, text_normalized FROM doc_normalized"),
    "at_mentions": f"""
        SELECT doc_id, {_MENTION_SQL} AS text
        FROM (SELECT doc_id, regexp_replace(text, '@([\\p{{L}}\\p{{N}}_]+)', '\\1', 'g') AS plain
              FROM documents)""",
    "word_counts": f"SELECT doc_id, {words_sql('text')} AS words FROM documents",
}
