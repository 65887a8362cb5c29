import pytest

from agoralytics.operators import privacy


def masked(spark, text, names=None):
    texts = spark.createDataFrame([(1, text)], "id long, t string")
    gazetteer = spark.createDataFrame(names, "term string, type string") if names else None
    return privacy.mask_text(texts, "id", "t", gazetteer).withColumn(
        "back", privacy.unmask("masked", "mask_map")
    ).head()


def test_numbers_run_from_the_end(spark):
    row = masked(spark, "a a@b.nl http://x.y/z? b c.d@e.org")
    assert row["masked"] == "a [ENTITY_EMAIL_2] [ENTITY_URL_1] b [ENTITY_EMAIL_1]"
    assert row["mask_map"]["[ENTITY_URL_1]"] == "http://x.y/z?"


@pytest.mark.parametrize(
    "text, names, expected",
    [
        ("Jan de Boer en Jan", [("Jan", "PERSON"), ("Jan de Boer", "PERSON")],
         "[ENTITY_PERSON_2] en [ENTITY_PERSON_1]"),
        ("Jan's a+b (Jan) Janus", [("Jan", "PERSON")],
         "[ENTITY_PERSON_2]'s a+b ([ENTITY_PERSON_1]) Janus"),
        ("Jan@x.nl in Den Haag", [("Jan", "PERSON"), ("Den Haag", "GPE"), ("Haag", "GPE")],
         "[ENTITY_EMAIL_1] in [ENTITY_GPE_1]"),
        ("niets hier", [("Jan", "PERSON")], "niets hier"),
        ("", [("Jan", "PERSON")], ""),
    ],
)
def test_names(spark, text, names, expected):
    row = masked(spark, text, names)
    assert row["masked"] == expected
    assert row["back"] == text


def test_positions_count_characters(spark):
    texts = spark.createDataFrame([(1, "😀 a@b.nl é www http://q.r")], "id long, t string")
    rows = privacy.extract_entities(texts, "id", "t").orderBy("start").collect()
    assert [(r["type"], r["start"], r["end"]) for r in rows] == [("EMAIL", 2, 8), ("URL", 15, 25)]


def test_columns_mask_before_mentions(spark):
    texts = spark.createDataFrame(
        [(1, "@jan_de_boer mail a@b.nl", None)], "id long, t string, name string"
    )
    names = spark.createDataFrame([("jan de boer", "PERSON")], "term string, type string")
    row = privacy.mask_columns(texts, "id", ["t", "name", "absent"], names).head()
    assert row["t"] == "[ENTITY_PERSON_1] mail [ENTITY_EMAIL_1]"
    assert row["name"] is None
    kept = privacy.mask_columns(texts, "id", ["t"], names, replace_original=False).head()
    assert kept["t"].startswith("@jan") and kept["t_anon"] == row["t"]


def test_pseudonyms(spark):
    a = spark.createDataFrame([("c",), ("a",), (None,)], "poster_id string")
    b = spark.createDataFrame([("b",), ("a",)], "poster_id string")
    names = privacy.pseudonym_map([a, b])
    assert {r["original_id"]: r["pseudonym"] for r in names.collect()} == {
        "a": "user_1", "b": "user_2", "c": "user_3",
    }
    assert sorted(str(r[0]) for r in privacy.pseudonymize(a, names).collect()) == [
        "None", "user_1", "user_3",
    ]


def test_restore_keeps_literal_placeholders(spark):
    text = "see [ENTITY_EMAIL_1] and a@b.nl"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    masked = privacy.mask_text(df, "id", "t")
    row = masked.select("masked", privacy.unmask("masked", "mask_map").alias("back")).head()
    assert "a@b.nl" not in row["masked"] and row["back"] == text


def test_a_name_under_two_types(spark):
    df = spark.createDataFrame([(1, "hi jan here")], "id long, t string")
    names = spark.createDataFrame([("jan", "PERSON"), ("jan", "GPE")], "term string, type string")
    found = privacy.extract_entities(df, "id", "t", names).collect()
    assert [(r.type, r.text) for r in found] == [("GPE", "jan")]


def test_rows_without_a_poster_have_no_part(spark):
    from agoralytics.operators.split import user_split

    rows = user_split(spark.createDataFrame([(1,), (None,)], "poster_id long")).collect()
    assert {r.poster_id: r.split is None for r in rows} == {1: False, None: True}


@pytest.mark.parametrize(
    "text, found",
    [
        ("JAN belt jan  de\n boer op", ["JAN", "jan  de\n boer"]),
        ("Jan de Boer de Wit", ["Jan de Boer", "de Wit"]),  # names that overlap: the first start, then the longest
        ("jan de wit", ["jan", "de wit"]),
        ("O'BRIEN o' brien O’Brien", ["O'BRIEN"]),
        ("İJan Janus jan_ _jan x-jan-y", ["jan"]),
        ("http://x.nl/jan jan", ["http://x.nl/jan", "jan"]),
        ("Jan@x.nl", ["Jan@x.nl"]),
        ("", []), (None, []), (" \n", []),
    ],
)
@pytest.mark.parametrize("limit", [None, 0])
def test_folded_names(spark, monkeypatch, text, found, limit):
    """The list sent to every task and the list that is joined find the same."""
    if limit is not None:
        monkeypatch.setattr("agoralytics.operators.names.BROADCAST_NAMES", limit)
    names = [("Jan", "PERSON"), ("jan de  Boer", "PERSON"), ("De Wit", "PERSON"), ("Boer", "ORG"), (" O'Brien ", "PERSON"), ("!", "ORG"), (None, "ORG"), ("x", None)]
    texts = spark.createDataFrame([(1, text), (2, text)], "id long, t string")
    gazetteer = spark.createDataFrame(names, "term string, type string")
    rows = privacy.mask_text(texts, "id", "t", gazetteer).withColumn("back", privacy.unmask("masked", "mask_map")).collect()
    assert len(rows) == 2
    for row in rows:
        assert [e.text for e in row.entities] == found and row.back == text
        assert all(text[e.start : e.end] == e.text for e in row.entities)


def test_names_are_scanned_once(spark):
    """A filter on what is found does not run the scan a second time below it."""
    texts = spark.createDataFrame([(1, "jan")], "id long, t string")
    gazetteer = spark.createDataFrame([("jan", "PERSON")], "term string, type string")
    plan = privacy.extract_entities(texts, "id", "t", gazetteer, {})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


OLD_EMAIL = rf"{privacy.tx.WORD_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{privacy.tx.WORD_EDGE}"
ODD = [
    "x.y@z.nl", ".b@c.nl", "a.b@c.nl", "é.b@c.nl", "éa@b.nl a@b.nl", "-a@b.nl", "é-a@b.nl", "a@b@c.nl", "a@b.nlé", "a@b.n|x", "a@b.nl|", "_a@b.nl", "²a@b.nl",
    "a@b", "a@b.c", "%%a@b.nl", "a%+@b.nl", "😀a@b.nl", "😀.a@b.nl", "𝒜.a@b.nl", "http://x.y/a@b.nl", "mailto:a@b.nl,c@d.org", "a..@b.nl", "x\n.a@b.nl", "@b.nl", "a @b.nl",
    "[ENTITY_EMAIL_1] a@b.nl", "a[ENTITY_URL_2]", "see http://é", "http:/x http://x", "", None, " ", "no hits here", "a@b.nl" * 300, "a." * 2000 + "@b.nl",
]


def test_mail_addresses_are_found_as_before(spark):
    texts = spark.createDataFrame(list(enumerate(ODD)), "id long, t string")
    new = {**privacy.PATTERNS}
    old = {"URL": privacy.URL, "EMAIL": OLD_EMAIL, "LITERAL": privacy.PLACEHOLDER}
    rows = lambda patterns: sorted(map(str, privacy.mask_text(texts, "id", "t", None, patterns).collect()))
    for names in (["URL", "EMAIL", "LITERAL"], ["EMAIL"], ["URL", "LITERAL"], ["LITERAL", "EMAIL"]):
        assert rows({n: new[n] for n in names}) == rows({n: old[n] for n in names})
    assert rows({}) == rows({}) and rows({**new, "TAG": r"#\w+"}) == rows({**old, "TAG": r"#\w+"})


def test_texts_without_an_at_sign_are_not_searched_for_addresses(spark):
    texts = spark.createDataFrame([("x",)], "t string")
    plan = privacy.extract_entities(texts, "t", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(t" in plan and "size(_hits" in plan


def test_a_map_is_read_once_per_text(spark):
    """Its making was put into the look-up of every piece of the text."""
    texts = spark.createDataFrame([(1, "a@b.nl [ENTITY_EMAIL_1] c"), (2, None), (3, "")], "id long, t string")
    back = privacy.mask_text(texts, "id", "t").select("id", privacy.unmask("masked", "mask_map").alias("back"))
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "try_element_at" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(map(tuple, back.collect())) == [(1, "a@b.nl [ENTITY_EMAIL_1] c"), (2, None), (3, "")]
    odd = spark.sql("SELECT '[ENTITY_A_1][ENTITY_A_2]x[[ENTITY_A_3]' AS m, map('[ENTITY_A_1]', 'one', '[ENTITY_A_2]', NULL, '[ENTITY_A_3]', '[ENTITY_A_1]') AS k")
    rows = odd.select(privacy.unmask("m", "k"), privacy.unmask("m", privacy.F.lit(None).cast("map<string,string>"))).head()
    assert tuple(rows) == ("one[ENTITY_A_2]x[[ENTITY_A_1]", "[ENTITY_A_1][ENTITY_A_2]x[[ENTITY_A_3]")


def test_few_first_words_are_searched_by_one_pattern():
    from agoralytics.operators import names

    listed = [("de la", "A"), ("la", "B"), ("la  la", "C"), ("İx", "D"), ("_", "E"), ("o'brien", "F"), ("²", "G"), ("!", "H")]
    spans = [{"type": "Z", "start": 3, "end": 5}, {"type": "Z", "start": 20, "end": 21}]
    read, searched = names.NameTrie(listed), names.NameTrie(listed, many_texts=True)
    assert read.first is None and searched.first is not None
    assert names.NameTrie([], True).first is None and names.NameTrie([(f"n{i}", "A") for i in range(65)], True).first is None
    texts = ["de la la", "DE\n la la  LA lala la_", "İx ix x_ _ ² 2", "O'Brien o brien o'brienx la", "de", "la" + " !" * 9000, "", "xde la-la\x1cla de\u200bla"]
    for text in texts:
        for given in ((), spans):
            assert searched.scan(text, given) == read.scan(text, given)
    assert searched.scan("DE\n la la", ()) == [("A", 0, 6), ("B", 7, 9)]
