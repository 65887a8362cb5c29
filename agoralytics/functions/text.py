"""Text functions as column expressions: no Python runs per row.

Character classes are spelled out because the regular-expression shorthands of
Java only know ASCII, while forum text is Unicode.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space and as word characters.
# The first pattern needs the flag (?U), and is much faster than a class that
# lists all of them.
SPACE = r"\s\x1c-\x1f"
SPACE_CHARACTERS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
WORD = r"\p{L}\p{N}_"
WORD_EDGE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"

# Patterns of the cleaning steps.
URL = rf"(?U)https?://[^{SPACE}]+|www\.[^{SPACE}]+"
QUOTE_BLOCK = r"(?is)\[quote[^\]]*\].*?\[/quote\]"
QUOTE_LINE = r"(?dm)^>.*$"
PUNCTUATION = r"([!?.]){2,}"

# A mark that cannot occur in parsed markup, put in place of each tag.
_TAG_MARK = "\u0000"
_SKIPPED_ELEMENT = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"<[!?/a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?/a-zA-Z][^>]*>"
_ENTITY_PIECES = (
    r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"
)


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def strip(text: Column | str) -> Column:
    return F.trim(_col(text), F.lit(SPACE_CHARACTERS))


def word_count(text: Column | str) -> Column:
    """Words between white space; a missing text has none."""
    return F.coalesce(
        F.regexp_count(_col(text), F.lit(rf"(?U)[^{SPACE}]+")), F.lit(0)
    ).cast("long")


def blank_to_null(text: Column | str) -> Column:
    text = _col(text)
    return F.when(text.rlike(rf"(?U)[^{SPACE}]"), text)


def _code_point(number: Column) -> Column:
    """The character of a numeric reference; 128-159 mean the Windows characters."""
    windows = F.create_map(
        *[
            F.lit(part)
            for code in range(128, 160)
            if (char := bytes([code]).decode("cp1252", errors="ignore"))
            for part in (code, char)
        ]
    )
    plain = F.when(
        (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF),
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"),
    )
    return F.coalesce(F.try_element_at(windows, number), plain, F.lit("\ufffd"))


def decode_entities(text: Column | str) -> Column:
    """Named and numeric character references of any length; unknown names stay as `&name`.

    Numbers beyond the last character, and 0, become U+FFFD; leading zeros don't count.
    """
    text = _col(text)
    known = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
    names = F.map_from_arrays(
        F.split(F.lit(" ".join(known)), " "), F.split(F.lit("\u0001".join(known.values())), "\u0001")
    )

    def decoded(piece: Column) -> Column:
        body = F.regexp_replace(piece, "^&|;$", "")
        digits = F.regexp_replace(body, "^#[xX]?0*", "")
        hexadecimal = F.lower(F.substring(body, 2, 1)) == "x"
        fits = F.length(digits) <= F.when(hexadecimal, 6).otherwise(7)
        number = F.when(fits, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits))
        return (
            F.when(piece.startswith("&#"), _code_point(F.coalesce(number.try_cast("int"), F.lit(0))))
            .when(
                piece.startswith("&") & (F.length(piece) > 1),
                F.coalesce(F.try_element_at(names, body), F.concat(F.lit("&"), body)),
            )
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(text, F.lit(_ENTITY_PIECES), F.lit(0))
    return F.when(
        text.contains("&"), F.array_join(F.transform(pieces, decoded), "")
    ).otherwise(text)


def html_to_text(text: Column | str) -> Column:
    """Text nodes joined by one space; scripts, styles and comments left out."""
    marked = _col(text)
    for pattern in (_COMMENT, _SKIPPED_ELEMENT, _TAG):
        marked = F.regexp_replace(marked, pattern, _TAG_MARK)
    joined = F.regexp_replace(marked, f"{_TAG_MARK}+", " ")
    return strip(decode_entities(joined))


def strip_quotes(text: Column | str) -> Column:
    """Without quoted blocks and `>` lines; at most one empty line in a row."""
    out = F.regexp_replace(_col(text), QUOTE_BLOCK, "")
    out = F.regexp_replace(out, QUOTE_LINE, "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def strip_urls(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), URL, "")


def collapse_punctuation(text: Column | str) -> Column:
    """A run of `!`, `?` and `.` becomes its last mark."""
    return F.regexp_replace(_col(text), PUNCTUATION, "$1")


def standardize(text: Column | str) -> Column:
    """One line of text without links and repeated punctuation."""
    out = collapse_punctuation(strip_urls(text))
    out = F.regexp_replace(out, r"[\r\n\t]+", " ")
    return strip(F.regexp_replace(out, " {2,}", " "))


def normalize(text: Column | str) -> Column:
    """Lower case; 4+ equal characters become 2; spaces and empty lines capped."""
    out = F.lower(F.coalesce(_col(text), F.lit("")))
    out = F.regexp_replace(out, r"(?d)(.)\1{3,}", "$1$1")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def plain_mentions(text: Column | str) -> Column:
    """`@jan_de_boer` becomes `jan de boer`."""
    text = _col(text)
    pieces = F.regexp_extract_all(text, F.lit(rf"@[{WORD}]+|[^@]+|@"), F.lit(0))
    named = F.transform(
        pieces,
        lambda p: F.when(
            p.startswith("@") & (F.length(p) > 1),
            F.translate(F.ltrim(p, F.lit("@")), "_", " "),
        ).otherwise(p),
    )
    return F.when(text.contains("@"), F.array_join(named, "")).otherwise(text)


def words(text: Column | str) -> Column:
    """Array of the white-space separated words."""
    return F.regexp_extract_all(_col(text), F.lit(rf"(?U)[^{SPACE}]+"), F.lit(0))


def whole_term_pattern(terms) -> str:
    """Pattern that finds any of the terms as whole words, in any case."""
    joined = "|".join(terms)
    return rf"(?iu)(?<![{WORD}])(?:{joined})(?![{WORD}])"
