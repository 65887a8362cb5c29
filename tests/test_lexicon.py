import pytest

from agoralytics.operators import lexicon
from agoralytics.sources.dictionary import (
    duplicate_names,
    parse_dictionary,
    read_dictionary,
)

DICTIONARY = (
    "%\n1\tfunction\n2\taffect\nx\tbad\n\n3\tsad\n%\n"
    "de\t1\nhui*\t2\nhuil*\t2\t3\r\nis\t1\t1\nDe\t1\t2\nalone\nnot\tx\nmoe'*\t2\n"
)


@pytest.fixture
def parsed(spark, tmp_path):
    path = tmp_path / "words.dic"
    path.write_text(DICTIONARY, encoding="utf-8-sig")
    return read_dictionary(spark, str(path))


def test_parse(parsed):
    assert {r["cat_id"]: r["name"] for r in parsed.categories.collect()} == {
        1: "function", 2: "affect", 3: "sad",
    }
    found = {(r["term"], r["is_prefix"]): r["cat_ids"] for r in parsed.entries.collect()}
    assert found == {
        ("de", False): [1, 2], ("hui", True): [2], ("huil", True): [2, 3],
        ("is", False): [1, 1], ("moe'", True): [2],
    }
    assert duplicate_names(parsed.categories).isEmpty()


def test_too_few_sections(spark):
    texts = spark.createDataFrame([("d", "1\ta\n%\nx\t1")], "dictionary_id string, content string")
    with pytest.raises(Exception, match="sections"):
        parse_dictionary(texts).entries.collect()


@pytest.mark.parametrize("broadcast_entries", [100, 0])
def test_scores(spark, parsed, broadcast_entries):
    texts = spark.createDataFrame(
        [(1, "De huilen, huis is ..."), (2, ""), (3, None), (4, "moe'd x")], "id long, t string"
    )
    names = {1: "function", 2: "affect", 3: "sad"}
    rows = lexicon.lexicon_scores(texts, parsed.entries, names, "id", "t", broadcast_entries)
    assert {r["id"]: tuple(r[1:]) for r in rows.collect()} == {
        1: (5, 60.0, 60.0, 20.0), 2: (0, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0),
        4: (2, 0.0, 0.0, 0.0),
    }


def test_names_must_be_unique(spark, parsed):
    texts = spark.createDataFrame([(1, "a")], "id long, t string")
    with pytest.raises(ValueError):
        lexicon.lexicon_scores(texts, parsed.entries, {1: "a", 2: "a"}, "id", "t")
