"""Language detection by profiles."""

from pyspark.sql import functions as F

from agoralytics.operators import languages

FOLDER = "/root/testdata/sf0.01"


def test_twenty_words_are_enough(spark):
    """Profiles of half of the documents tell the languages of the first 20 words of the others."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    profiles = languages.language_profiles(docs.where("doc_id % 2 = 0"), "text", "lang")
    words = F.regexp_extract_all("text", F.lit(r"\S*\p{L}\S*"), F.lit(0))
    short = docs.where("doc_id % 2 = 1").withColumn("words", words).where("size(words) >= 20")
    short = short.select("lang", F.array_join(F.slice("words", 1, 20), " ").alias("text"))
    got = languages.detect_by_profiles(short, "text", profiles).agg(F.avg((F.col("lang") == F.col("language")).cast("int")), F.count("*")).head()
    assert got[0] >= 0.97 and got[1] > 400


def test_small(spark):
    rows = [("a", "dit is een huis"), ("a", "HET huis"), ("b", "this is the house"), ("b", None), (None, "zzz"), ("b", "")]
    profiles = languages.language_profiles(spark.createDataFrame(rows, "lang string, t string"), "t", "lang")
    weights = {(r.language, r.gram): r.weight for r in profiles.collect()}
    assert {g for _, g in weights} >= {" hu", "hui", "is ", " th"} and not any("zz" in g for _, g in weights)
    assert weights["a", "hui"] > weights["b", "hui"] and len(weights) % 2 == 0
    texts = ["Het HUIS!", "the-house", "", None, "123", "qqq", "日本"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r.language for r in languages.detect_by_profiles(frame, "t", profiles).orderBy("i").collect()]
    assert got == ["a", "b", "unknown", "unknown", "unknown", "unknown", "unknown"]
    none = languages.language_profiles(spark.createDataFrame([], "lang string, t string"), "t", "lang")
    assert {r.language for r in languages.detect_by_profiles(frame, "t", none).collect()} == {"unknown"}
    assert [r.i for r in languages.language_filter(frame, "t", profiles, "a").collect()] == [0]
