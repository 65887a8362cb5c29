"""Suffix arrays against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from agoralytics.llm import suffix_arrays
from agoralytics.llm.induced import permuted_prefixes, suffix_array


def plain(rows, length=400):
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(d[p : p + length] for d in data.values() for p in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + length, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        gone = gone[: len(d)]
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def result(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


@pytest.fixture
def mixed(rng):
    base = "".join(rng.choice("ab é\n") for _ in range(3000))
    rows = []
    for i in range(50):
        a = rng.randrange(2000)
        ends = ["".join(rng.choice("xyz ") for _ in range(rng.randrange(300))) for _ in range(2)]
        rows.append((i, ends[0] + base[a : a + rng.randrange(350, 900)] + ends[1]))
    return rows + [
        (100, "a" * 450), (101, "ab" * 700 + "c" * 401), (102, "abcdefg" * 400), (103, rows[0][1]), (104, None), (105, ""),
        (106, "x" * 400), (107, "é" * 300), (108, "".join(map(str, range(1000))) * 2), (109, "q" * 399),
    ]


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_mixed(spark, mixed, monkeypatch, crowd):
    monkeypatch.setattr(suffix_arrays, "CROWD", crowd)
    docs = spark.createDataFrame(mixed, "doc_id long, text string")
    assert result(suffix_arrays.remove_repeats(docs)) == plain(mixed)


def test_on_table(documents):
    assert result(suffix_arrays.remove_repeats(documents)) == plain([(r.doc_id, r.text) for r in documents.collect()])


def test_odd(odd, none):
    got = suffix_arrays.remove_repeats(odd).collect()
    assert len(got) == odd.count() and {(r.doc_id, r.n_removed) for r in got if r.doc_id in (6, 9, 4)} == {(6, len(odd.where("doc_id = 6").head().text)), (9, 5000), (4, 0)}
    assert suffix_arrays.remove_repeats(none).count() == 0
    long = "".join(map(str, range(300)))
    frame = odd.sparkSession.createDataFrame([(None, long), (None, long), (1, long[:-1])], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_arrays.remove_repeats(frame).collect()) == [len(long) - 1, len(long), len(long)]


@pytest.mark.parametrize("symbols", [2, 5, 600])
def test_induced_sorting(symbols):
    pick = np.random.default_rng(symbols)
    for n in range(1, 80):
        text = np.append(np.tile(pick.integers(1, symbols + 1, n), 1 + n % 3), 0)
        order = suffix_array(text)
        values = text.tolist()
        assert order.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
        if symbols < 200:
            before, common = permuted_prefixes(text, order)
            for a, b in zip(order[1:], order[:-1], strict=True):
                k = 0
                while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                    k += 1
                assert (before[a], common[a]) == (b, k)
