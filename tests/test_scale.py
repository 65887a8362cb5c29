"""What must not grow with the input: texts that are written, parts of text tables, words that are shuffled."""

from pyspark.sql import functions as F

from agoralytics.operators import features, lexicon
from agoralytics.plans import flows
from agoralytics.sources import views


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_fetched_last_give_the_same_threads(spark, monkeypatch):
    # a document that comes twice, one that is missing, a short first post, equal message ids, missing ids
    docs = spark.createDataFrame(
        [(1, "een twee drie vier vijf ZES"), (2, "kort"), (3, None), (4, "a  b c d e f"), (4, "andere tekst van vier en meer")],
        "doc_id long, message_text string",
    )
    messages = spark.createDataFrame(
        [(i, i // 4, i % 3 if i % 7 else None, f"2020-01-{1 + i % 9:02d}", i % 6 if i % 11 else None, "g1" if i // 4 == 3 else "g") for i in range(40)]
        + [(5, 1, 2, None, 1, "g"), (None, None, 1, "2020-01-01", 4, "g")],
        "message_id long, topic_id long, poster_id long, post_date string, doc_id long, group_name string",
    ).withColumn("post_date", F.to_timestamp("post_date"))
    early = flows.structure(messages.join(docs, "doc_id"), ("g1",), 5)
    written = []
    cut = flows.cut_lineage
    monkeypatch.setattr(flows, "cut_lineage", lambda df: written.append(df) or cut(df))
    late = flows.structure(messages, ("g1",), 5, docs)
    # rows that are equal in date and message id may be numbered either way
    key = lambda df: sorted(map(str, df.drop("reply_index", "is_initial_post", "first_poster_id", "text_normalized").collect()))
    unique = lambda df: sorted(map(str, df.where("doc_id <> 4 and message_id <> 5").collect()))
    assert late.columns == early.columns and key(late) == key(early) and unique(late) == unique(early)
    assert all("message_text" not in df.columns for df in written[1:])


def test_first_flow_masks_each_text_once(spark, monkeypatch):
    # a document that comes twice, a blank one, one that is missing; a row without any value; a superuser, a moderator
    docs = spark.createDataFrame(
        [(1, "wow... mail a@b.nl of <b>Jan</b>"), (2, " "), (3, None), (4, "een twee"), (4, "see http://x.y/z jan"), (None, "x")],
        "doc_id long, message_text string",
    )
    messages = spark.createDataFrame(
        [(i, i // 5 % 4, i % 7 if i % 6 else None, f"2020-01-{1 + i % 9:02d}", i % 7 if i % 11 else None) for i in range(60)]
        + [(None, None, None, None, 2), (None, None, None, None, 4)],
        "message_id long, topic_id long, poster_id long, post_date string, doc_id long",
    )
    topics = spark.createDataFrame([(0, 1, "t"), (1, 1, "t"), (2, 2, "Jan"), (3, 1, "t")], "topic_id long, group_id long, name string")
    groups = spark.createDataFrame([(1, 2, "g"), (2, 3, "h")], "group_id long, account_id long, group_name string")
    names = spark.createDataFrame([("jan", "PERSON")], "term string, type string")
    given = (spark.createDataFrame([(3,)], "poster_id long"), names)
    early = flows.preprocess(flows.ForumTables(messages.join(docs, "doc_id").drop("doc_id"), topics, groups), *given, min_words=0, accounts=(2,))
    written = []
    cut = flows.cut_lineage
    monkeypatch.setattr(flows, "cut_lineage", lambda df: written.append(df) or cut(df))
    late = flows.preprocess(flows.ForumTables(messages, topics, groups), *given, min_words=0, accounts=(2,), texts=docs)
    assert [df.columns for df in written if "message_text" in df.columns] == [["doc_id", "message_text", "ellipsis_count"]]
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert early.community.columns == late.community.columns and early.community.count() > 10
    for name in ("messages", "community", "pseudonyms", "entities", "review", "mask_map"):
        assert rows(getattr(early, name)) == rows(getattr(late, name)), name


def test_parts_of_a_text_table_grow_with_its_files(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text"))
    rows.coalesce(1).write.option("parquet.block.size", 65536).option("compression", "none").parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        read = views.table(spark, str(tmp_path), "documents")
        assert read.rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism
        assert read.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


ODD = ["Blij, blij! (blijheid) http://x.y", None, "", " \x1c\x85  ", "ÉÉN één_2 ...", "de-de de", " blij x'blij", "... !?. ....", "Blijblij ΣΑΣ İx"]


def test_words_are_looked_up_in_place(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(0, "blij"), (None, "blij de")], "id long, t string")
    entries = spark.createDataFrame(
        [("blij", False, [1, 1]), ("blij", False, [2]), ("bl", True, [3]), ("blijh", True, [1]), ("blijh", True, None), ("de", False, [2]),
         ("dede", False, [3]), ("één_2", False, [1]), ("x", True, [2]), ("σας", False, [1]), (None, False, [1]), ("q", None, [1])],
        "term string, is_prefix boolean, cat_ids array<int>",
    )
    names = {1: "a", 2: "b", 3: "c"}
    here = lexicon.lexicon_scores(texts, entries, names, "id", "t", in_place=True)
    joined = lexicon.lexicon_scores(texts, entries, names, "id", "t", 0, True)
    assert "Generate" not in plan_of(here) and "Generate" in plan_of(joined)
    assert sorted(map(str, here.collect())) == sorted(map(str, joined.collect()))


def test_marks_are_counted_in_one_pass(spark):
    texts = spark.createDataFrame([(t,) for t in ODD], "t string")
    found = features.structural_features(texts, "t")
    assert "regexp_count" not in plan_of(found) and "RegExpCount" not in plan_of(found)
    count = lambda p: F.regexp_count(F.coalesce("t", F.lit("")), F.lit(p)).cast("long")
    rows = found.select(
        "feat_word_count", "feat_question_marks", "feat_exclamation", "feat_sentence_count", "feat_ellipsis",
        F.array(count(r"(?U)[^\s\x1c-\x1f]+"), count(r"\?"), count("!"), F.greatest(F.lit(1), count("[.!?]")), count(r"\.\.\.")).alias("old"),
    ).collect()
    assert len(rows) == len(ODD) and all(list(r[:5]) == r.old for r in rows)
