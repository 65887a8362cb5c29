"""Fill-in-the-middle against lists of units, and back."""

import hashlib
import re

import pytest

from agoralytics.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SIGNS = ["a", "b", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", "é", "日", "😀", "$1", "\\", "<", ">", "P", "S", "M", "\x00"]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    code = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(code[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", text, None, None)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid))
    return (doc_id, n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid))


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = [brute(r.doc_id, r.text) for r in rows]
    done = fill_middle.transform(docs)
    got = [(r.doc_id, r.n, r.form, r.output) for r in done.collect()]
    assert sorted(map(str, got)) == sorted(map(str, (w[:4] for w in want)))
    back = [(r.doc_id, r.restored) for r in fill_middle.restored(done.drop("text")).collect()]
    assert sorted(map(str, back)) == sorted(map(str, ((r.doc_id, r.text or "") for r in rows)))
    sums = [tuple(r) for r in fill_middle.digests(done).collect()]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = [(*w[:3], *w[4:], sha(w[3]), sha(r.text)) for w, r in zip(want, rows, strict=True)]
    assert sorted(map(str, sums)) == sorted(map(str, expected))
    return {w[2] for w in want}


def test_table(documents):
    assert check(documents) == {"plain", "spm", "psm"}


def test_odd(odd, none):
    check(odd)
    assert fill_middle.transform(none).count() == 0


def test_strange(spark, rng):
    rows = [(i, "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(1000 + i, t) for i, t in enumerate(["a <P> b", "<S>", "<M", "x<", "<P", " ", "\n \n", "a"] * 8)]
    assert check(spark.createDataFrame(rows, "doc_id long, text string")) == {"plain", "spm", "psm"}


def test_very_long_text(spark):
    """More units than any stack could hold a frame for, and one unit of a million characters."""
    rows = [(i, "ab \n" * 700_000 + "end" * (i % 2)) for i in range(4)] + [(10 + i, "x" * 1_000_000) for i in range(4)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("rate, first, form", [(100, 100, "spm"), (100, 0, "psm"), (0, 50, "plain")])
def test_rates_and_markers(spark, rate, first, form):
    plan = fill_middle.Plan(seed=1, rate=rate, suffix_first=first, prefix="<|fim$1|>", suffix="[S]", middle="\\E(M)")
    docs = spark.createDataFrame([(i, f"one two {i} three\n") for i in range(20)], "doc_id long, text string")
    done = fill_middle.transform(docs, plan)
    rows = fill_middle.restored(done, plan).collect()
    assert all(r.form == form and r.restored == r.text for r in rows)
    assert form == "plain" or all(m in r.output for r in rows for m in plan.markers)
