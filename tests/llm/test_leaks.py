"""Spaced seeds against a comparison of all alignments."""

import math
from itertools import combinations

import brute
import pytest

from agoralytics.llm import spaced_seeds


def pairs(frame):
    return {(r.doc_id, r.item_id) for r in frame.select("doc_id", "item_id").collect()}


def test_on_table(spark, documents, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.where("n_chars < 4000").limit(60).collect()]
    some = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.leaks(docs, [(r.item_id, r.text) for r in items.collect()])
    assert pairs(spaced_seeds.leaks(some, items)) == want


def test_substitutions(spark, rng):
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 6, 7, 9, 15, 20, 40])))) for i in range(25)]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=60)
        item = rng.choice(items)[1].split()
        at = rng.randrange(0, 60)
        w[at:at] = [x if rng.random() > 0.1 else "other" for x in item]
        docs.append((i, " ".join(w)))
    docs += [(100, items[5][1].upper().replace(" ", ", ")), (101, " ".join(items[-1][1].split()[:5]))]
    got = pairs(spaced_seeds.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute.leaks(docs, items)


@pytest.mark.parametrize("words", range(8, 21))
def test_masks_lose_no_placement(words):
    """Every choice of as many substitutions as four fifths allow leaves a seed whole."""
    looks = [{j for j, c in enumerate(mask) if c == "1"} for mask in spaced_seeds.MASKS]
    seeds = [frozenset(s + j for j in look) for look, mask in zip(looks, spaced_seeds.MASKS, strict=True) for s in range(words - len(mask) + 1)]
    for changed in combinations(range(words), words - math.ceil(0.8 * words - 1e-9)):
        assert any(seed.isdisjoint(changed) for seed in seeds), changed


@pytest.mark.parametrize("words", [8, 10, 12, 15, 20, 33])
def test_exactly_four_fifths(spark, rng, words):
    """Documents with the fewest equal words that still count are all found, those with one less aren't."""
    item = [f"v{i}" for i in range(words)]
    size = min(words, 20)
    docs, want = [], set()
    for i in range(60):
        start, off = rng.randint(0, words - size), size - math.ceil(0.8 * size - 1e-9) + i % 2
        text = item[start : start + size]
        for j in rng.sample(range(size), off):
            text[j] = f"other{i}x{j}"
        docs.append((i, " ".join([f"a{i}", *text, f"b{i}"])))
        if i % 2 == 0:
            want.add((i, 1))
    items = [(1, " ".join(item))]
    assert want == brute.leaks(docs, items)
    assert pairs(spaced_seeds.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == want


def test_odd(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "one two"), (4, "w0x0 W1X1 w2x2 w3x3, w4x4 w5x5 w6x6 w7x7 w8x8")], "item_id long, text string")
    assert pairs(spaced_seeds.leaks(odd, items)) == {(4, 3), (5, 3), (6, 4), (7, 4)}
    assert spaced_seeds.leaks(none, items).count() == 0
    assert spaced_seeds.leaks(odd, items.limit(0)).count() == 0
    left = spaced_seeds.decontaminate(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 5
