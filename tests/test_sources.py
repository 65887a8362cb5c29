from agoralytics.operators.filters import drop_empty_rows
from agoralytics.plans.flows import preprocess
from agoralytics.sources import forum

MESSAGES = (
    "ForumMessageID,ForumTopicID,PosterID,PostDate,MessageText\n"
    '1,10.0,u2,2020-01-01 10:00:00,"hallo ""jij""\nnieuwe <b>regel</b> mail x@y.nl"\n'
    "2,10,u1,nonsense,tekst hier\n"
    "3,10,u1,2020-01-02 10:00:00,te,veel,velden\n"
    "4,11,u9,2020-01-02 10:00:00,in de test\n"
    "5,12,u9,2020-01-02 10:00:00,superuser elders\n"
    "6,12,u8\n"
    ",,,,\n"
)


def dump(folder):
    (folder / "messages.csv").write_text(MESSAGES)
    (folder / "topics.csv").write_text(
        "ForumTopicID,ForumGroupID,Name\n10,1,Hallo http://a.b\n11,2,Test\n12,1,Meer\n"
    )
    (folder / "groups.csv").write_text("ForumGroupID,AccountID,Name\n1,2,Welkom\n2,1,Proef\n")
    (folder / "accounts.csv").write_text("AccountID\n1\n2\n")
    return str(folder)


def test_csv(spark, tmp_path):
    raw = forum.read_csv(spark, dump(tmp_path) + "/messages.csv")
    assert raw.count() == 7
    assert [r["ForumMessageID"] for r in forum.bad_lines(raw).collect()] == ["3"]
    rows = {r["message_id"]: r for r in forum.typed(raw).collect()}
    assert set(rows) == {1, 2, 4, 5, 6, None}
    assert rows[1]["topic_id"] == 10 and '"jij"\nnieuwe' in rows[1]["message_text"]
    assert rows[2]["post_date"] is None
    assert rows[6]["message_text"] is None


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([(" ", None), ("\t", "x"), ("", "")], "a string, b string")
    assert [tuple(r) for r in drop_empty_rows(df).collect()] == [(None, "x")]


def test_preprocess_and_precedence(spark, tmp_path):
    folder = dump(tmp_path)
    done = preprocess(forum.read_forum(spark, folder))
    rows = {r["message_id"]: r for r in done.community.collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["message_text"] == 'hallo "jij" nieuwe regel mail [ENTITY_EMAIL_1]'
    assert rows[1]["message_text_normalized"] == rows[1]["message_text"].lower()
    assert (rows[1]["poster_id"], rows[2]["poster_id"]) == ("user_2", "user_1")
    assert rows[1]["group_name"] == "Welkom"
    names = {r["topic_id"]: r["name"] for r in done.topics.collect()}
    assert names[10] == "Hallo [ENTITY_URL_1]"

    integrated = preprocess(
        forum.read_forum(spark, folder, integrated_messages=folder + "/messages.csv")
    )
    assert {r["message_id"] for r in integrated.community.collect()} == {1, 2, 4, 5}


def test_write_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc')], "id long, t string")
    forum.write_tables({"x": df}, str(tmp_path / "out"), "csv")
    back = forum.read_csv(spark, str(tmp_path / "out" / "x")).head()
    assert back["t"] == 'a "b"\nc'
    forum.write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_first_flow_masks_links_and_counts_ellipses(spark):
    from agoralytics.operators.features import structural_features
    from agoralytics.sources.forum import ForumTables

    messages = spark.createDataFrame(
        [(1, 10, 7, "2024-01-01", "wow... see http://x.y/z and a@b.nl of @jan_smit")],
        "message_id long, topic_id long, poster_id long, post_date string, message_text string",
    )
    topics = spark.createDataFrame([(10, 1, "t")], "topic_id long, group_id long, name string")
    groups = spark.createDataFrame([(1, 2, "g")], "group_id long, account_id long, group_name string")
    names = spark.createDataFrame([("jan smit", "PERSON")], "term string, type string")
    done = preprocess(ForumTables(messages, topics, groups), gazetteer=names, accounts=(2,))
    row = structural_features(done.community, "message_text").head()
    assert row["message_text"] == "wow. see [ENTITY_URL_1] and [ENTITY_EMAIL_1] of [ENTITY_PERSON_1]"
    assert row["feat_ellipsis"] == 1
    assert {(r.type, r.text) for r in done.entities.collect()} == {
        ("URL", "http://x.y/z"), ("EMAIL", "a@b.nl"), ("PERSON", "jan smit"),
    }
    assert done.review.head()["original_text"].startswith("wow... see http")
    assert {r.placeholder for r in done.mask_map.collect()} == {
        "[ENTITY_URL_1]", "[ENTITY_EMAIL_1]", "[ENTITY_PERSON_1]",
    }


def test_nothing_stays_after_a_run(spark):
    from pathlib import Path

    from agoralytics.session import cut_lineage, run_folder, scratch_folder

    kept = Path(scratch_folder(spark).removeprefix("file:")) / "kept"
    with_folder = Path(run_folder(spark).removeprefix("file:"))
    assert cut_lineage(spark.range(3)).count() == 3 and with_folder.exists()
    assert not kept.exists()
