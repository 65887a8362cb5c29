"""Co-training: accuracy on rows held out, and the pipeline as a whole."""

import brute
import pytest

from agoralytics.llm import cotrain

FINE = "the sea was calm and people walked along the old harbour talking about plans for a warm summer".split()


@pytest.fixture
def made(spark, rng):
    """Good, bad (signs and repeats) and toxic texts; labels for two of three, 3 % of them wrong."""
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(FINE, k=rng.randint(20, 80)) + [f"r{rng.randrange(3000)}" for _ in range(20)]
        rng.shuffle(w)
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "idiot", "trash"]))
        rows.append((i, "%%% ".join(w) + "$$$" if bad else " ".join(w), "en", f"src{i % 5}", 0))
        if i % 3:
            wrong = rng.random() < 0.03
            labels.append((i, int(bad == wrong), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(made):
    docs, labels = made
    got = {r.doc_id: r.kept for r in cotrain.classify(docs, labels).collect()}
    free = [i for i in range(900) if i % 3 == 0]
    right = sum(got[i] == (i % 5 != 0 and i % 7 != 0) for i in free)
    assert len(got) == 900 and right / len(free) > 0.95
    left = cotrain.keep_good(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, k in got.items() if k}


def test_surest_of_all(spark, monkeypatch, made):
    """Each word is a feature, and the surest rows are taken from all unlabelled ones."""
    docs, labels = made
    words = {f"rare{i}" for i in range(300)}
    some = spark.createDataFrame([(1, " ".join(words), "en", "s")], "doc_id long, text string, lang string, source string")
    got = cotrain.views(cotrain.tokenised(some, "doc_id"), "doc_id").first()
    assert got.words.size == 1 << 18 and got.words.numNonzeros() > 290
    asked = []
    inner = cotrain.surest
    monkeypatch.setattr(cotrain, "surest", lambda frame, free, models, most: asked.append((free.count(), most)) or inner(frame, free, models, most))
    monkeypatch.setattr(cotrain, "MOST_GIVEN", 5)
    more = docs.union(docs.where("doc_id % 3 = 0").selectExpr("doc_id + 10000", "text", "lang", "source", "n_chars"))
    toxic = labels.selectExpr("doc_id", "cast(null as int) AS quality", "toxic")
    assert cotrain.classify(more, toxic).count() == 1200
    assert asked[0] == (600, 5) and 0 <= asked[0][0] - asked[1][0] <= 20


def test_rare_class(spark, monkeypatch):
    """A class with few labels is drawn whole from a large table, and both parts have some of it."""
    monkeypatch.setattr(cotrain, "LABELLED", 200)
    there = spark.range(20_000).selectExpr("id", "cast(id % 2 AS double) AS quality", "cast(id < 12 AS double) AS toxic")
    rows = [r for r in cotrain._drawn(there).collect() if r.share_toxic is not None]
    rare, other = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(rare) == 12 and {r.share_toxic for r in rare} == {1.0} and {r.held_toxic for r in rare} == {True, False}
    assert 140 < len(other) < 260 and {round(r.share_toxic, 6) for r in other} == {19_988 / 200}
    assert 0.15 < sum(r.held_toxic for r in other) / len(other) < 0.25


def test_odd(odd, none, spark):
    labels = spark.createDataFrame([(4, 1, None), (5, None, 0), (None, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(r.kept and r.p_quality is None for r in got)
    assert cotrain.classify(none, labels).count() == 0 and cotrain.keep_good(odd, labels.limit(0)).count() == odd.count()


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = corpus_pipeline.cut_lineage(stage(spark, kept, folder))
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert kept.columns == docs.columns and after <= before.keys()
        rows = sorted(before.items())
        if stage is corpus_pipeline.exact_dedup:
            assert after == {i for i, x in brute.exact(rows).items() if x[0] == i}
        if stage is corpus_pipeline.near_dedup:
            assert after == {i for i, x in brute.near(rows).items() if x[0] == i}
        if stage is corpus_pipeline.decontaminate:
            gone = set(before) - after
            some = [(i, t) for i, t in rows if i in gone or len(t) < 600]
            assert gone & {i for i, _ in some} == {i for i, _ in brute.leaks(some, items)}
    out = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}
    assert all(r.decoded == r.text for r in out.join(kept.select("doc_id", "text"), "doc_id").collect())
