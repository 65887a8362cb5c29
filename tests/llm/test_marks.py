"""SimHash components against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from agoralytics.llm import gray_index

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def mark(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    found = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(marks, radius=3):
    """The smallest place reached from each place."""
    marks = np.array(marks, np.uint64)
    label = np.arange(len(marks))
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= radius
    while True:
        new = np.where(near, label[None, :], len(marks)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def brute(rows):
    marks = [mark(t) for _, t in rows]
    label = parts(marks)
    best = {}
    for (i, _), part in zip(rows, label.tolist(), strict=True):
        best[part] = min((x for x in (best.get(part), i) if x is not None), default=None)
    return [(i, f"{m:016x}", best[p]) for (i, _), m, p in zip(rows, marks, label.tolist(), strict=True)]


def check(docs, **settings):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in gray_index.near_duplicates(docs, **settings).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_table(documents):
    check(documents)


def test_odd(odd, none):
    check(odd)
    assert gray_index.near_duplicates(none).count() == 0
    kept = gray_index.keep_one(odd)
    assert kept.columns == odd.columns


def scattered(rng, n):
    """Random centres, chains and dense balls around them, numbers at the ends of the range."""
    out = {0, (1 << 64) - 1, 1, 7, 15, 1 << 63}
    while len(out) < n:
        at = rng.getrandbits(64) if rng.random() < 0.8 else rng.getrandbits(20) << rng.choice((0, 22, 44))
        for _ in range(rng.randint(1, 12)):
            out.add(at)
            for _ in range(rng.randint(0, 5)):
                at ^= 1 << rng.randrange(64)
    return sorted(out)


def reached(spark, marks, **settings):
    """Label of each mark by the links found, as by all pairs."""
    frame = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "mark long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in gray_index.link(frame, **settings).collect()]
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() >= 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(m) for m in marks]


@pytest.mark.parametrize("settings", [{}, {"group": 16}, {"group": 2}, {"radius": 1}, {"radius": 0}])
def test_links(spark, rng, settings):
    """Groups that are cut again and again lose no link."""
    marks = scattered(rng, 700)
    label = parts(marks, settings.get("radius", 3))
    assert reached(spark, marks, **settings) == [marks[p] for p in label]


def test_one_dense_group(rng):
    """All of a dense ball under one node, with a frontier far larger than one step takes."""
    centre = rng.getrandbits(64)
    marks = np.unique(np.array([centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)], np.uint64))
    a, b = gray_index.forest(marks, np.zeros(len(marks), np.int64), 3)
    assert len(a) == len(marks) - 1


def test_rank_orders_by_gray_code(spark):
    frame = spark.createDataFrame([(i ^ (i >> 1), i) for i in range(300)], "code long, place long")
    assert all(r.place == r["rank"] for r in frame.withColumn("rank", gray_index.gray_rank(frame.code)).collect())


def test_long_texts_in_pieces(monkeypatch, rng):
    text = " ".join(f"W{rng.randrange(500)}" for _ in range(4000))
    monkeypatch.setattr(gray_index, "SHINGLES", 37)
    assert gray_index.fingerprint(text, 3, 42) == mark(text)
