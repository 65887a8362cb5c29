"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from agoralytics.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def brute(docs, target, percent=25, least=20, seed=7, width=2, buckets=10_000):
    s = Counter(bucket(g, buckets) for _, t in docs for g in grams(t, width)[1])
    t = Counter(bucket(g, buckets) for x in target for g in grams(x, width)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n_words, found = grams(text, width)
        weight = sum(gain[bucket(g, buckets)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    out = [(*r[:4], k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return out + [(*r[:4], None) for r in rows if r[4] < least]


def check(docs, target, **settings):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    texts = [r.text for r in target.collect()]
    names = {"percent": "percent", "least_words": "least", "seed": "seed", "width": "width", "buckets": "buckets"}
    want = brute(rows, texts, **{names[k]: v for k, v in settings.items()})
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(docs, target, **settings).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


@pytest.fixture
def target(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def test_table(documents, target):
    got = check(documents, target)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10


@pytest.mark.parametrize("settings", [{"width": 1}, {"width": 3, "buckets": 97}, {"percent": 100, "least_words": 0, "seed": 1}, {"percent": 0}])
def test_settings(documents, target, settings):
    check(documents, target, **settings)


def test_odd(spark, odd, none, target):
    check(odd, target, least_words=2, percent=60)
    check(odd, target.limit(0), least_words=1, percent=100)
    check(odd, spark.createDataFrame([(None,), ("",)], "text string"))
    assert resample.resample(none, target).count() == 0


def test_ties_go_to_the_smaller_id(spark, target, monkeypatch):
    """Equal rows have equal scores; each is ranked."""
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text)] * 4 + [(i, text) for i in range(100, 140)] + [(None, text)], "doc_id long, text string")
    check(docs, target, percent=50)


def test_features_over_batches():
    texts = ["A b  a", None, "", "É é ß\x00ß", "...", "one", "a b"]
    plain = pa.array(texts, pa.string())
    (words, n_words), (pairs, n_pairs) = resample.features(plain, 2, 1000)
    assert n_words.tolist() == [3, 0, 0, 4, 0, 1, 2] and n_pairs.tolist() == [2, 0, 0, 3, 0, 0, 1]
    assert words.tolist() == [bucket(g, 1000) for g in ["a", "b", "a", "É", "é", "ß", "ß", "one", "a", "b"]]
    assert pairs[pairs >= 0].tolist() == [bucket(g, 1000) for g in ["a b", "b a", "É é", "é ß", "ß ß", "a b"]]
    assert [len(x) for x, _ in resample.features(pa.array(["", None], pa.string()), 3, 10)][0] == 0


def test_slices_of_a_batch(documents):
    """Batches are cut in pieces; a piece counts what a batch of its own would."""
    whole = pa.array([r.text for r in documents.select("text").collect()], pa.string())
    for k in range(0, len(whole), 23):
        piece, alone = whole.slice(k, 23), pa.array(whole.slice(k, 23).to_pylist(), pa.string())
        for a, b in zip(resample.features(piece, 2, 997), resample.features(alone, 2, 997), strict=True):
            assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
