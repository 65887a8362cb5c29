"""The trained tagger: decoding against all paths, learning, names that no list has, odd rows."""

import itertools

import numpy as np
import pytest

from agoralytics.operators import privacy, tagger

FIRST = ("Anna", "Bert", "Carla", "Dirk", "Emma", "Frits", "Greet", "Hugo", "Ilse", "Joost", "Kees", "Lotte")
PLACE = ("Utrecht", "Zwolle", "Delft", "Gouda", "Breda", "Venlo", "Assen", "Hoorn")


def texts_of(spark, rng, first, places, n=120):
    rows, truth = [], []
    for i in range(n):
        a, b, p = rng.choice(first), rng.choice(first), rng.choice(places)
        head, mid = f"gisteren sprak {rng.choice(('mevrouw', 'meneer'))} ", " in "
        text = f"{head}{a} {b}{mid}{p} over het weer. Het was een lange dag, en de trein was laat."
        rows.append((i, text))
        truth += [(i, "PERSON", len(head), len(head) + len(a) + 1 + len(b))]
        start = len(head) + len(a) + 1 + len(b) + len(mid)
        truth += [(i, "GPE", start, start + len(p))]
    return spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(truth, "id long, type string, start int, end int")


def test_finds_names_that_no_list_has(spark, rng):
    known, truth = texts_of(spark, rng, FIRST[:8], PLACE[:5])
    listed = [(f"{a} {b}", "PERSON") for a in FIRST[:8] for b in FIRST[:8]] + [(p, "GPE") for p in PLACE[:5]]
    model = tagger.train(known, spark.createDataFrame(listed, "term string, type string"), "id", "t", parts=2)
    assert model.types == ("GPE", "PERSON")
    unseen, truth = texts_of(spark, rng, FIRST[8:], PLACE[5:], 60)
    found = privacy.extract_entities(unseen, "id", "t", None, {}, model)
    rows = {r.type: r for r in tagger.scores(found, truth, "id").collect()}
    assert rows["all"].f1 > 0.95 and rows["PERSON"].n_true == 60
    again = tagger.train(known, spark.createDataFrame(listed, "term string, type string"), "id", "t", parts=2)
    assert np.array_equal(again.weights, model.weights)
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, " \n\t"), (4, "..."), (5, "mail a@b.nl aan mevrouw Tine Vos in Ede."), (5, "x " * 5000), (None, "日本語 😀 é")],
        "id long, t string",
    )
    masked = privacy.mask_text(odd, "id", "t", tagger=model).withColumn("back", privacy.unmask("masked", "mask_map")).collect()
    assert len(masked) == 7 and all(r.back == r.t for r in masked)
    full = next(r for r in masked if r.t and "a@b" in r.t)
    assert [(e.type, e.text) for e in full.entities] == [("EMAIL", "a@b.nl"), ("PERSON", "Tine Vos"), ("GPE", "Ede")]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "id long, t string")
    names = spark.createDataFrame([("Jan", "PERSON")], "term string, type string")
    texts = spark.createDataFrame([(1, "Jan en Piet"), (2, None)], "id long, t string")
    for model in (tagger.train(none, names, "id", "t"), tagger.train(texts, names.limit(0), "id", "t")):
        assert [list(r.entities) for r in privacy.with_entities(texts, "id", "t", None, {}, model).collect()] == [[], []]


def test_decoding_takes_the_best_path(rng):
    kinds = 5
    draw = np.random.default_rng(3)
    for _ in range(20):
        lengths = draw.integers(1, 5, 4)
        scores = draw.normal(size=(lengths.sum(), kinds)).astype(np.float32)
        steps = draw.normal(size=(kinds + 1, kinds)).astype(np.float32)
        got, at = tagger.decode(scores, lengths, steps), 0
        rule = steps + tagger._allowed(kinds)
        for n in lengths:
            best = max(
                itertools.product(range(kinds), repeat=int(n)),
                key=lambda p: sum(scores[at + i, x] + rule[kinds if i == 0 else p[i - 1], x] for i, x in enumerate(p)),
            )
            assert tuple(got[at : at + n]) == best
            at += n


@pytest.fixture
def rng():
    import random

    return random.Random(7)


def test_scores(spark):
    found = spark.createDataFrame([(1, "A", 0, 2), (1, "A", 0, 2), (2, "B", 0, 1)], "id long, type string, start int, end int")
    truth = spark.createDataFrame([(1, "A", 0, 2), (2, "A", 0, 1)], "id long, type string, start int, end int")
    rows = {r.type: tuple(r)[1:4] for r in tagger.scores(found, truth, "id").collect()}
    assert rows == {"A": (1, 2, 1), "B": (1, 0, 0), "all": (2, 2, 1)}


def test_a_list_of_any_size_stays_out_of_the_driver(spark, rng, monkeypatch):
    from pyspark.sql import functions as F

    known, _ = texts_of(spark, rng, FIRST[:4], PLACE[:3], 40)
    listed = [(f"{a} {b}", "PERSON") for a in FIRST[:4] for b in FIRST[:4]] + [(p, "GPE") for p in PLACE[:3]]
    small = spark.createDataFrame(listed, "term string, type string")
    others = spark.range(5000).select(F.concat(F.lit("zz"), F.col("id").cast("string")).alias("term"), F.lit("GPE").alias("type"))
    collect, seen = type(small).collect, []
    monkeypatch.setattr(type(small), "collect", lambda self: seen.append(rows := collect(self)) or rows)
    model = tagger.train(known, small.unionByName(others), "id", "t", parts=2, rounds=2)
    assert max(map(len, seen)) < 100
    monkeypatch.undo()
    assert np.array_equal(model.weights, tagger.train(known, small, "id", "t", parts=2, rounds=2).weights)
    assert model.weights.any()


def test_python_holds_a_few_texts_at_a_time():
    import pyarrow as pa

    from agoralytics.operators import names

    sizes, text = [], "gisteren sprak Anna met Bert. " * 100
    trie = names.NameTrie([("Anna", "PERSON")])

    def scan(texts, spans):
        sizes.append(len(texts))
        return names._scanner(lambda: trie)(texts, spans)

    texts = pa.array([text] * 300 + [None, ""] + [text * 200])
    spans = pa.array([[]] * len(texts), pa.list_(pa.struct([])))
    found = names.chunked(scan, texts, spans)
    assert max(sizes) * len(text) <= names.CHUNK and len(found) == len(texts)
    assert found.to_pylist() == names._scanner(lambda: trie)(texts, spans).to_pylist()


def test_it_learns_from_all_texts_in_small_parts(spark, monkeypatch):
    """More texts than were once drawn; the number of parts grows with them."""
    texts = [(i, f"toen zei oom {FIRST[i % len(FIRST)]} iets.") for i in range(4_300)]
    known = spark.createDataFrame(texts, "id long, t string").repartition(3)
    names = spark.createDataFrame([(f, "PERSON") for f in FIRST], "term string, type string")
    sizes, frame = [], type(known)
    learn = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: sizes.append([r.n for r in self.select("n").collect()]) or learn(self, *a, **b))
    for chars, parts in ((10**9, range(1, 3)), (10_000, range(8, 99))):
        monkeypatch.setattr(tagger, "PART_CHARS", chars)
        assert tagger.train(known, names, "id", "t", parts=2, rounds=1).weights.any()
        assert sum(sizes[-1]) == len(texts) and len(sizes[-1]) in parts
