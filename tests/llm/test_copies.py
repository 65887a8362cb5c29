"""Exact dedup and the n-gram join against brute force."""

import brute
import numpy as np
import pytest

from agoralytics.llm import golomb_dedup, ngram_join
from agoralytics.llm.components import components


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_exact_on_table(documents):
    want = brute.exact(rows_of(documents))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in golomb_dedup.exact_duplicates(documents).collect()}
    assert got == want
    assert all((r.doc_id == r.keep_id) == r.kept for r in golomb_dedup.exact_duplicates(documents).collect())


def test_exact_odd(odd, none):
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in golomb_dedup.exact_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    assert sorted(r for r in rows if r[0] in (4, 5)) == [(4, 4, 4, True), (5, 4, 4, False), (5, 4, 4, False)]
    assert {r for r in rows if r[0] in (1, 2, 3)} == {(1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True)}
    assert {(4, False), (1, False)} <= {(r[1], r[3]) for r in rows if r[0] is None}
    kept = golomb_dedup.drop_duplicates(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9, 10] and kept.columns == odd.columns
    assert golomb_dedup.exact_duplicates(none).count() == 0 and golomb_dedup.drop_duplicates(none).count() == 0


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a  b"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted(r.text.split()[0] for r in golomb_dedup.drop_duplicates(docs).collect()) == ["a", "c"]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 61, n, dtype=np.uint64))
    payload, bits = golomb_dedup.golomb_encode(values, 1 << 61)
    assert (golomb_dedup.golomb_decode(payload, len(values), bits) == values).all()
    assert n < 1000 or len(payload) * 8 / n < 61 - 10 + 3  # close to log2(span / n) + 2 bits each


def as_dict(frame):
    return {r.doc_id: (r.class_id, r.copy_id, r.copies, r.n_links, r.n_class_links) for r in frame.collect()}


def test_near_on_table(documents):
    assert as_dict(ngram_join.near_duplicates(documents)) == brute.near(rows_of(documents))


def test_near_blocks(spark, rng, monkeypatch):
    """One large group of near copies, cut into many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(rng.choices(base, k=80))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = as_dict(ngram_join.near_duplicates(docs)), brute.near(rows)
    assert got == want
    kept = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert kept == {i for i, x in want.items() if x[0] == i}


def test_near_odd(odd, none):
    got = ngram_join.near_duplicates(odd)
    rows = [(r.doc_id, r.class_id, r.copies, r.n_links) for r in got.collect()]
    assert len(rows) == odd.count()
    assert (4, 4, 4, 3) in rows and rows.count((5, 4, 4, 3)) == 2 and (None, 4, 4, 3) in rows
    assert (7, 6, 1, 1) in rows and (10, 10, 1, 0) in rows and (1, 1, 1, 0) in rows
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.keep_one(odd).columns == odd.columns


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (300, 200), (200, 300), (None, 5)]
    got = {r.id: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
