import random

import pytest
from pyspark.sql import functions as F

from agoralytics.operators import filters, mapping, ordering, sampling, split, threads
from agoralytics.operators.reports import cap_sensitivity, eligible_counts


def forum(spark, rows=400, seed=1):
    """Messages where one thread and one user hold a third of all rows."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        topic = 7 if rng.random() < 0.34 else rng.randrange(60)
        poster = "hot" if rng.random() < 0.34 else rng.choice([None, "a", "b", "c", "d", "e"])
        date = None if rng.random() < 0.1 else f"2020-01-{rng.randrange(1, 9):02d}"
        data.append((i, topic, poster, date, f"text {i}"))
    return spark.createDataFrame(
        data, "message_id long, topic_id long, poster_id string, d string, message_text string"
    ).select(
        "message_id", "topic_id", "poster_id",
        F.col("d").cast("timestamp_ntz").alias("post_date"), "message_text",
    )


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


COLUMNS = ("message_id", "reply_index", "reply_count", "first_poster_id", "is_initial_post")


def test_structure_against_python(spark):
    messages = forum(spark)
    by_topic = {}
    for r in messages.collect():
        by_topic.setdefault(r["topic_id"], []).append(r)
    expected = []
    for group in by_topic.values():
        group.sort(key=lambda r: (r["post_date"] is None, str(r["post_date"]), r["message_id"]))
        expected += [
            (r["message_id"], i, len(group) - 1, group[0]["poster_id"], i == 0)
            for i, r in enumerate(group)
        ]
    found = rows_of(threads.thread_structure(messages), *COLUMNS)
    assert found == sorted(expected, key=str)


def test_hot_threads_get_the_same_numbers(spark):
    messages = forum(spark)
    plain = rows_of(threads.thread_structure(messages), *COLUMNS)
    hot = rows_of(threads.thread_structure(messages, hot_rows=20), *COLUMNS)
    assert hot == plain


def test_hot_keys_number_rows(spark):
    messages = forum(spark)
    order = [F.col("post_date").asc_nulls_last(), F.col("message_id").asc()]
    plain = ordering.number_rows(messages, ["poster_id"], order, "n")
    hot = ordering.number_rows(messages, ["poster_id"], order, "n", hot_rows=5)
    assert rows_of(plain, "message_id", "n") == rows_of(hot, "message_id", "n")


def test_position_is_dense_and_ordered(spark):
    placed = ordering.position(forum(spark), [F.col("message_id").desc()], "p")
    found = [tuple(r) for r in placed.select("message_id", "p").orderBy("p").collect()]
    assert found == [(399 - i, i) for i in range(400)]


def test_folds_of_hot_labels(spark):
    rows = forum(spark).withColumn("label", F.col("topic_id") == 7)
    plain = split.cv_folds(rows, "label", "message_id")
    hot = split.cv_folds(rows, "label", "message_id", hot_rows=10)
    assert rows_of(plain, "message_id", "fold") == rows_of(hot, "message_id", "fold")
    sizes = [r["count"] for r in plain.groupBy("label", "fold").count().collect()]
    assert len(sizes) == 10


def test_superusers_and_missing_posters(spark):
    messages = spark.createDataFrame(
        [(1, 1, "a"), (2, 2, "a"), (3, 2, "b"), (4, 1, None), (5, 9, "c")],
        "message_id long, topic_id long, poster_id string",
    )
    topics = spark.createDataFrame([(1, 10), (2, 20), (9, None)], "topic_id long, group_id long")
    groups = spark.createDataFrame(
        [(10, 1, "Test"), (20, 2, "Real"), (20, 2, "Real")],
        "group_id long, account_id long, group_name string",
    )
    accounts = mapping.topic_account_map(topics, groups)
    kept = mapping.remove_posters(messages, mapping.superuser_ids(messages, accounts))
    assert rows_of(kept, "message_id") == [(3,), (4,), (5,)]
    assert rows_of(mapping.community_filter(kept, accounts), "message_id") == [(3,)]
    named = mapping.attach_group(kept, mapping.topic_group_map(topics, groups))
    assert rows_of(named, "message_id", "group_name") == [(3, "Real"), (4, "Test"), (5, "")]


def test_moderators(spark):
    messages = forum(spark)
    moderators = spark.createDataFrame([("hot",)], "poster_id string")
    kept = filters.remove_moderators(messages, moderators)
    first = {r["topic_id"]: r["first_poster_id"] for r in filters.first_posters(messages).collect()}
    expected = [
        (r["message_id"],)
        for r in messages.collect()
        if first[r["topic_id"]] != "hot" and r["poster_id"] != "hot"
    ]
    assert rows_of(kept, "message_id") == sorted(expected, key=str)


def test_intro_groups_drop_whole_threads(spark):
    rows = spark.createDataFrame(
        [(1, 1, "Welkom hier"), (2, 1, "Anders"), (3, 2, None), (4, 3, "OFF-TOPIC")],
        "message_id long, topic_id long, group_name string",
    )
    assert rows_of(filters.filter_intro_groups(rows), "message_id") == [(3,)]


@pytest.mark.parametrize("partitions", [1, 16])
def test_sample_invariants(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        structured = threads.normalize_messages(threads.thread_structure(forum(spark)))
        sample = sampling.annotation_sample(structured, 12, 4)
        rows = rows_of(sample, "message_id", "topic_id")
        assert rows == rows_of(sampling.annotation_sample(structured.repartition(3), 12, 4),
                               "message_id", "topic_id")
        assert len(rows) == 12 and len({t for _, t in rows}) == 12
        capped = sampling.cap_per_user(sampling.eligible_replies(structured), 4)
        assert capped.groupBy("poster_id").count().agg(F.max("count")).head()[0] == 4
        context = sampling.with_context(sample, structured)
        assert context.filter("initial_post_text is null").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_caps_match_heads(spark):
    structured = threads.thread_structure(forum(spark))
    counts = eligible_counts(structured)
    per_user = [r["n"] for r in counts.collect()]
    for row in cap_sensitivity(counts).collect():
        assert row["pool"] == sum(min(n, row["cap"]) for n in per_user)
        assert row["users_affected"] == sum(n > row["cap"] for n in per_user)
