from datetime import datetime

import pytest
from pyspark.sql import functions as F

from agoralytics.functions import text as tx
from agoralytics.functions.values import id_number, parse_date, seeded_unit


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Haaaai!!! ok...", "haai!!! ok..."),
        ("a \t b", "a b"),
        ("a\n\n\n\n\nb ", "a\n\nb"),
        ("ok....", "ok.."),
        (None, ""),
    ],
)
def test_normalize(one, text, expected):
    assert one(tx.normalize, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("wat?!?! ok... a!!", "wat! ok. a!"), ("a.b! c", "a.b! c")],
)
def test_collapse_punctuation(one, text, expected):
    assert one(tx.collapse_punctuation, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("x [QUOTE=a]b\nc[/quote] y", "x  y"),
        ("a\n> q\nb\r\n>z", "a\n\nb"),
        ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_strip_quotes(one, text, expected):
    assert one(tx.strip_quotes, text) == expected


def test_links_and_spaces(one):
    assert one(tx.strip_urls, "a https://x.y/z b www.q.r") == "a  b "
    assert one(tx.standardize, " a\r\n\tb  c http://x.y/é d!! ") == "a b c  d!"


@pytest.mark.parametrize(
    "text, expected",
    [("", 0), (None, 0), (" \n", 0), ("a b", 2), ("a b c\x1cd", 4), ("café!", 1)],
)
def test_word_count(one, text, expected):
    assert one(tx.word_count, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<p>a</p><p>b</p>", "a b"),
        ("a<!-- > c -->b", "a b"),
        ("<p><b>x</b></p>\n<i>y</i>", "x \n y"),
        ("<script>var t='</p>';</script>x<style>p{}</style>", "x"),
        ('<a title="a>b" href=x>t</a>', "t"),
        ("a &lt;b&gt; &amp;amp; &eacute; &#233;&#x20AC;&#128;", "a <b> &amp; é é€€"),
        ("AT&T &unknown; 1 < 2 & 3", "AT&T &unknown 1 < 2 & 3"),
        ("plain", "plain"),
    ],
)
def test_html_to_text(one, text, expected):
    assert one(tx.html_to_text, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("@jan_de_boer hoi", "jan de boer hoi"),
        ("@@x_y @", "@x y @"),
        ("a@b_c.nl", "ab c.nl"),
        ("no mention_here", "no mention_here"),
    ],
)
def test_plain_mentions(one, text, expected):
    assert one(tx.plain_mentions, text) == expected


def test_blank_to_null(one):
    assert one(tx.blank_to_null, "  \t") is None
    assert one(tx.blank_to_null, " a ") == " a "


def test_whole_terms(one):
    pattern = tx.whole_term_pattern(["moderator"])
    found = lambda t: one(lambda c: c.rlike(pattern), t)
    assert found("De Moderator!") and not found("moderatoren") and not found("émoderator")


def test_ids_and_dates(one):
    assert one(id_number, "12.0") == 12
    assert one(id_number, "nan") is None and one(id_number, "x") is None
    assert one(parse_date, "nonsense") is None
    assert str(one(parse_date, "2020-01-02 03:04:05")) == "2020-01-02 03:04:05"


def test_seeded_unit(one):
    assert one(lambda c: seeded_unit(c, 42), "7") == 0.46435326454229653


def test_length_counts_characters(one):
    assert one(F.length, "a😀") == 2


def test_references_of_any_length(one):
    name = "a" * 150
    assert one(tx.decode_entities, f"&{name} x") == f"&{name} x"
    assert one(tx.decode_entities, "&#00000000065;&#x000000042;&#0000000000000067") == "ABC"
    assert one(tx.decode_entities, "&#99999999999999999999;&#x110000;&#0;") == "�" * 3


def test_marks_collapse_to_the_last(one):
    assert one(tx.collapse_punctuation, "a!?. b... c.") == "a. b. c."


def test_ids_are_exact(one):
    assert one(id_number, "9007199254740993") == 9007199254740993
    assert one(id_number, "12.0") == 12 and one(id_number, "nan") is None and one(id_number, "x") is None


def test_offsets_are_turned_to_utc(one):
    assert one(parse_date, "2024-05-01 10:00:00+02:00") == datetime(2024, 5, 1, 8)
    assert one(parse_date, "2024-05-01T10:00:00Z") == datetime(2024, 5, 1, 10)
    assert one(parse_date, "2024-05-01 10:00:00") == datetime(2024, 5, 1, 10)
    assert one(parse_date, "2024-05-01") == datetime(2024, 5, 1)


def test_offsets_when_summer_time_ends(spark):
    """Two instants an hour apart stay an hour apart, whatever zone the session has."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
        texts = ["2022-10-30 00:30:00Z", "2022-10-30 01:30:00Z", "2022-10-30T03:30:00+02:00", "1969-12-31 23:59:59.25Z", "2022-10-30 02:30:00"]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_date("t").alias("d")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [str(r.d) for r in rows] == [
        "2022-10-30 00:30:00", "2022-10-30 01:30:00", "2022-10-30 01:30:00", "1969-12-31 23:59:59.250000", "2022-10-30 02:30:00",
    ]


def test_f_test(spark):
    """Critical values as printed in tables of the F distribution, and closed forms."""
    from pyspark.sql import functions as F

    from agoralytics.functions.values import f_test

    rows = [(4.9646, 1, 10, 0.05), (3.3158, 2, 30, 0.05), (6.6349, 1, 100_000_000, 0.01), (0.0, 1, 10, 1.0), (1.0, 7, 7, 0.5), (161.4476, 1, 1, 0.05)]
    rows += [(f, 2, n, (1 + 2 * f / n) ** (-n / 2)) for f in (0.1, 1.0, 5.0, 80.0) for n in (2, 10, 400)]  # two degrees: a power
    frame = spark.createDataFrame(rows, "f double, a int, b int, want double")
    for r in frame.withColumn("p", f_test(F.col("f"), F.col("a"), F.col("b"))).collect():
        assert abs(r.p - r.want) < (1e-6 if r.a == 2 and r.b != 30 else 2e-6), r
