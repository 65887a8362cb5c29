"""Surrogates: kinds, formats, distinctness, coreference."""

import re

from agoralytics.llm import surrogates

TEXTS = [
    "Write to und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, not to a@b.nl.",
    "call +1 (017) 555-7713 or (017) 555-7713, 017-555-7713!",
    "ip 97.51.17.173 card 9807915762804490 and 4111 1111 1111 1111.",
    'x token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"!! TOKEN = "9B0B3C6A43EB78AA99CBD7049C572391524F37A8"',
    "Mr. John Smith met Mrs. Smith and Anna Schmidt; Dr. Иван Петров, Мария Петрова",
    "no entity at 2020-01-02, v1.2.3, 12345, 3.14 or The And",
]


def run(spark, texts, key="k"):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_entities, r.text) for r in surrogates.replace_private(frame, key).collect()}


def luhn(digits):
    numbers = [int(d) for d in re.sub(r"\D", "", digits)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(numbers)) % 10 == 0


def test_kinds(spark):
    got = run(spark, TEXTS)
    assert [got[i][0] for i in range(6)] == [3, 3, 3, 2, 5, 0] and got[5][1] == TEXTS[5]
    for value in ("und.34", "mail7", "a@b", "555-7713", "97.51.17.173", "9807915762804490", "4111 1111 1111 1111", "9b0b3c6a43", "9B0B3C6A43", "John", "Smith", "Schmidt", "Петров"):
        assert all(value not in text for _, text in got.values())
    mails = re.findall(r"\S+@[\w.]+", got[0][1])
    assert mails[0].upper() == mails[1] and mails[0].endswith(".example") and mails[2] != mails[0]
    phones = re.findall(r"[\d()+][\d() +-]+\d", got[1][1])
    assert len({re.sub(r"\D", "", p)[-10:] for p in phones}) == 1 and [re.sub(r"\d", "9", p) for p in phones] == ["+9 (999) 999-9999", "(999) 999-9999", "999-999-9999"]
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", got[2][1])
    assert luhn(cards[1]) and len(cards) == 2 and all(0 < int(x) < 255 for x in re.search(r"ip (\S+)", got[2][1])[1].split("."))
    hexes = re.findall(r'"(\w+)"', got[3][1])
    assert re.fullmatch("[0-9a-f]{40}", hexes[0]) and re.fullmatch("[0-9A-F]{40}", hexes[1])
    his, hers = re.match(r"Mr\. \S+ (\S+) met Mrs\. (\S+) and", got[4][1]).groups()
    assert his == hers
    assert re.search(r"Dr\. [А-я-]+ [А-я]+, [А-я-]+ [А-я]+$", got[4][1])


def test_key_and_repeat(spark):
    one, same, other = run(spark, TEXTS), run(spark, TEXTS), run(spark, TEXTS, "other")
    assert one == same and one[0] != other[0]


def test_distinct(spark):
    """Many surnames, fewer syllables than names: no two share a surrogate, none is a real one."""
    names = [f"Mr. {a}{b}{c}" for a in ("Bar", "Ben", "Cor", "Dal") for b in ("bar", "fen", "gar", "hol", "kel") for c in ("lan", "mor", "nor", "pel", "ras", "sol")]
    got = run(spark, names)
    new = [got[i][1] for i in range(len(names))]
    assert len(set(new)) == len(names) and not set(new) & set(names)
    address = [f"10.0.{i}.{j}" for i in range(12) for j in range(12)]
    new = [x[1] for x in run(spark, address).values()]
    assert len(set(new)) == len(address) and not set(new) & set(address)


def test_odd(odd, none):
    got = surrogates.replace_private(odd, "k").collect()
    assert sorted(str(r.text) for r in got) == sorted(str(r.text) for r in odd.collect())
    assert surrogates.replace_private(none, "k").count() == 0
    rows = [(1, "a@b.nl"), (1, "a@b.nl"), (None, "a@b.nl " * 3000)]
    frame = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    new = surrogates.replace_private(frame, "k").collect()
    assert len(new) == 3 and len({w for r in new for w in r.text.split()}) == 1 and sum(r.n_entities for r in new) == 3002


def test_ends_on_signs_and_small_spaces(spark):
    """Entities of signs only, and more entities than there are surrogates of their length."""
    texts = ["password: ********", "token = ------", "to _-@-.com and _-@-.org", "pwd=!!!!!!!! pwd=????????"]
    texts += [f"{a}@{b}.{t}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for t in ("nl", "de")]
    got = run(spark, texts)
    new = [got[i][1] for i in range(len(texts))]
    assert not set(new) & set(texts) and len(set(new)) == len(texts)
    one, two = re.findall(r"\S+@\S+", new[2])
    assert one != two and new[0].startswith("password: ") and "***" not in new[0]


def test_country_codes(spark):
    got = run(spark, ["+1 415 555 2671 or +44 415 555 2671", "415 555 2671", "+31 20 794 60958, (207) 946-0958", "call 207-946-0958"])
    one, two = re.findall(r"\+[\d ]+\d", got[0][1])
    assert re.sub(r"\D", "", one)[-10:] != re.sub(r"\D", "", two)[-10:]
    tails = [re.sub(r"\D", "", x)[-10:] for x in (*re.split(", ", got[2][1]), got[3][1])]
    assert len(set(tails)) == 1  # one country is written, so the national forms are of it
