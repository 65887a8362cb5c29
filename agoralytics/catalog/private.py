"""Registered queries: pseudonyms, entities and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoralytics.catalog.base import Stages, oracle
from agoralytics.functions.values import seeded_hash
from agoralytics.operators import names, privacy, tagger
from agoralytics.session import cut_lineage

# Names that occur among the invented words of the test documents.
GAZETTEER = (
    ("De la", "PERSON"), ("de la", "PERSON"), ("The", "PERSON"), ("Le", "PERSON"),
    ("Der", "PERSON"), ("Queque", "PERSON"), ("la", "GPE"), ("And", "GPE"), ("Of", "GPE"),
    ("Und", "GPE"), ("that", "ORG"), ("nicht", "ORG"), ("avec", "ORG"), ("QUE \t LA", "ORG"),
)
_TAIL = " ask a@b.nl or http://x.example/a,b then c_1@d.org."


def _gazetteer(spark):
    rows = ", ".join(f"('{term}', '{kind}')" for term, kind in GAZETTEER)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, type)")


def _texts(spark, folder):
    tail = F.when(F.col("doc_id") % 3 == 0, _TAIL).otherwise("")
    return (
        Stages(spark, folder)
        .table("documents")
        .select("doc_id", F.concat("text", tail).alias("text"))
    )


def pseudonymize_ids(spark, folder):
    kept = Stages(spark, folder).kept.select("message_id", "poster_id")
    return privacy.pseudonymize(kept, privacy.pseudonym_map([kept]))


def pseudonym_map(spark, folder):
    s = Stages(spark, folder)
    orders = s.table("orders").select(F.col("o_custkey").alias("poster_id"))
    events = s.table("events").select(F.col("user_id").alias("poster_id"))
    return privacy.pseudonym_map([orders, events])


def extract_entities(spark, folder):
    return privacy.extract_entities(_texts(spark, folder), "doc_id", "text")


def gazetteer_entities(spark, folder):
    texts = Stages(spark, folder).table("documents").select("doc_id", "text")
    return privacy.extract_entities(texts, "doc_id", "text", _gazetteer(spark), {})


def gazetteer_entities_by_join(spark, folder):
    """The same by the way for lists that are too large to send to every task."""
    texts = Stages(spark, folder).table("documents").select("doc_id", "text")
    found = names.find_names(
        texts.withColumn("none", F.array().cast(names.ENTITIES)), _gazetteer(spark), "doc_id", "text", "none", "found", limit=0
    )
    return found.select("doc_id", F.inline("found.entities"))


# Words that announce a name: every document that names somebody has one, and so the tagger can learn them.
_LEADS = ("met", "avec", "von", "por", "dear", "Herr", "Mme", "Mr", "dit", "says")
_PLACE_LEADS = ("in", "near", "aus", "chez")


def _named_texts(spark, folder):
    """Documents with a sentence on a person and a place put in front, whose names are words of the document read backwards.

    listed: whether the names are on the list; nobody told of the others. The true spans come with them.
    """
    docs = Stages(spark, folder).table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{6,12}"), F.lit(0))
    own = docs.withColumn("words", F.array_distinct(words)).where("size(words) >= 20")
    h = lambda k: F.conv(F.substring(seeded_hash("doc_id", f"name{k}"), 1, 8), 16, 10).cast("long")
    word = lambda k: F.initcap(F.reverse(F.get("words", (h(k) % F.size("words")).cast("int"))))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (h(k) % len(values) + 1).cast("int"))
    person = F.when(h(1) % 3 == 0, word(2)).otherwise(F.concat(word(2), F.lit(" "), word(3)))
    parts = own.select(
        "doc_id", "text", person.alias("person"), word(4).alias("place"), pick(_LEADS, 5).alias("a"), pick(_PLACE_LEADS, 6).alias("b"),
        word(7).alias("other"), (h(8) % 2 == 0).alias("listed"),
    )
    head = F.concat(F.col("other"), F.lit(" "), F.col("a"), F.lit(" "))
    middle = F.concat(head, F.col("person"), F.lit(" "), F.col("b"), F.lit(" "))
    span = lambda kind, before, name: F.struct(
        F.lit(kind).alias("type"), F.length(before).alias("start"), (F.length(before) + F.length(name)).alias("end"),
        F.col(name).alias("name"),
    )
    return parts.select(
        "doc_id", "listed", F.concat(middle, F.col("place"), F.lit(".\n"), F.col("text")).alias("text"),
        F.array(span("PERSON", head, "person"), span("GPE", middle, "place")).alias("spans"),
    )


def _trained(spark, folder):
    """A tagger that learned from the texts whose names are on the list, and the texts it never saw."""
    texts = cut_lineage(_named_texts(spark, folder))
    known = texts.where("listed")
    listed = known.select(F.explode("spans").alias("s")).select(F.col("s.name").alias("term"), F.col("s.type").alias("type"))
    return tagger.train(known, listed.distinct(), "doc_id", "text"), texts


def tagged_names(spark, folder):
    """Names found by the tagger in every document."""
    model, _ = _trained(spark, folder)
    texts = Stages(spark, folder).table("documents").select("doc_id", "text")
    return privacy.extract_entities(texts, "doc_id", "text", None, {}, model)


def tagger_scores(spark, folder):
    """How well it finds names that no list had, in texts it did not learn from; what it finds elsewhere in them counts as wrong."""
    model, texts = _trained(spark, folder)
    unseen = texts.where("not listed")
    found = privacy.extract_entities(unseen, "doc_id", "text", None, {}, model)
    return tagger.scores(found, unseen.select("doc_id", F.inline("spans")), "doc_id")


def mask_text(spark, folder):
    return privacy.mask_text(_texts(spark, folder), "doc_id", "text").select("doc_id", "masked")


def mask_names(spark, folder):
    """Names, links and addresses in one pass; the text left between is what counts."""
    masked = privacy.mask_text(_texts(spark, folder), "doc_id", "text", _gazetteer(spark))
    return masked.select("doc_id", "masked", F.size("entities").alias("entities"))


def mask_columns(spark, folder):
    texts = _texts(spark, folder).withColumn("name", F.lower("text"))
    return privacy.mask_columns(texts, "doc_id", ["text", "name", "absent"], _gazetteer(spark))


def mask_review(spark, folder):
    masked = privacy.mask_text(_texts(spark, folder), "doc_id", "text")
    entities = privacy.entity_review(masked, "doc_id", "text")
    texts = privacy.text_review(masked, "doc_id", "text")
    return entities.select("doc_id", "column", F.to_json("entities").alias("entities")).join(
        texts, "doc_id"
    )


def unmask_roundtrip(spark, folder):
    masked = privacy.mask_text(_texts(spark, folder), "doc_id", "text", _gazetteer(spark))
    return masked.select("doc_id", privacy.unmask("masked", "mask_map").alias("text"))


_TEXTS = f"""
    SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '{_TAIL}' ELSE '' END AS text
    FROM documents"""
_PATTERN = r"https?://[!$-_a-z]+|\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b"
_PATTERN_TABLES = {
    "texts": _TEXTS,
    "pieces": f"""
        SELECT doc_id, unnest(hits) AS hit, unnest(range(len(hits))) AS i,
               unnest(gaps[:len(hits)]) AS gap
        FROM (SELECT doc_id, regexp_extract_all(text, '{_PATTERN}') AS hits,
                     string_split_regex(text, '{_PATTERN}') AS gaps FROM texts)""",
    "typed": """
        SELECT *, CASE WHEN starts_with(hit, 'http') AND contains(hit, '://') THEN 'URL'
                       ELSE 'EMAIL' END AS type,
               sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)
                   - length(hit) AS start
        FROM pieces""",
    "marked": """
        SELECT *, '[ENTITY_' || type || '_' || row_number() OVER (
            PARTITION BY doc_id, type ORDER BY i DESC) || ']' AS mark FROM typed""",
    "masked": """
        SELECT t.doc_id, coalesce(m.head, '') || substr(t.text, coalesce(m.done, 0)::BIGINT + 1)
            AS masked
        FROM texts t LEFT JOIN (
            SELECT doc_id, string_agg(gap || mark, '' ORDER BY i) AS head,
                   max(start + length(hit)) AS done FROM marked GROUP BY doc_id) m USING (doc_id)""",
}
_NAME_TABLES = {
    "names": "SELECT regexp_replace(lower(term), '\\s+', ' ', 'g') AS term, min(type) AS type FROM ("
    + " UNION ALL ".join(f"SELECT '{term}' AS term, '{kind}' AS type" for term, kind in GAZETTEER)
    + ") GROUP BY 1",
    "parts": """
        SELECT doc_id, p, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS start
        FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i
              FROM (SELECT doc_id, regexp_extract_all(text,
                        '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS ps FROM named_texts))""",
    "runs": """
        SELECT doc_id, i, start, p, p || lead(p, 1) OVER w || lead(p, 2) OVER w AS pair
        FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY i)""",
    # A pair that begins inside another one, `que la la`, does not occur: no name's last word is another's first.
    "pairs": "SELECT r.*, n.type FROM runs r JOIN names n ON n.term = regexp_replace(lower(r.pair), '\\s+', ' ', 'g')",
    "singles": """
        SELECT r.*, n.type FROM runs r JOIN names n ON n.term = lower(r.p)
        WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.doc_id = r.doc_id AND q.i IN (r.i, r.i - 2))""",
    "found_names": """
        SELECT doc_id, type, start::INTEGER AS start, pair AS hit FROM pairs
        UNION ALL SELECT doc_id, type, start::INTEGER, p FROM singles""",
}
_NAMED = "SELECT doc_id, type, start, (start + length(hit))::INTEGER AS \"end\", hit AS text FROM found_names"
# Names and what patterns find, in one text.
_ALL_TABLES = {
    **_PATTERN_TABLES,
    "named_texts": "SELECT doc_id, text FROM texts",
    **_NAME_TABLES,
    "every": """
        SELECT doc_id, type, start::INTEGER AS start, hit FROM typed
        UNION ALL SELECT f.* FROM found_names f WHERE NOT EXISTS (
            SELECT 1 FROM typed t WHERE t.doc_id = f.doc_id AND t.start < f.start + length(f.hit)
                AND f.start < t.start + length(t.hit))""",
    "numbered": """
        SELECT *, '[ENTITY_' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY start DESC) || ']' AS mark,
               coalesce(lag(start + length(hit)) OVER (PARTITION BY doc_id ORDER BY start), 0) AS done
        FROM every""",
    "all_masked": """
        SELECT t.doc_id, coalesce(m.head, '') || substr(t.text, coalesce(m.done, 0)::BIGINT + 1) AS masked,
               coalesce(m.n, 0)::INTEGER AS entities
        FROM texts t LEFT JOIN (
            SELECT n.doc_id, string_agg(substr(x.text, n.done::BIGINT + 1, (n.start - n.done)::BIGINT) || mark, '' ORDER BY start) AS head,
                   max(start + length(hit)) AS done, count(*) AS n
            FROM numbered n JOIN texts x USING (doc_id) GROUP BY n.doc_id) m USING (doc_id)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        pseudonymize_ids, pseudonym_map, extract_entities, gazetteer_entities, mask_text,
        gazetteer_entities_by_join, tagged_names, tagger_scores, mask_names, mask_columns, mask_review, unmask_roundtrip,
    )
}

ORACLES = {
    "pseudonymize_ids": oracle("""
        SELECT message_id, 'user_' || dense_rank() OVER (ORDER BY poster_id) AS poster_id
        FROM kept"""),
    "pseudonym_map": """
        SELECT id AS original_id, 'user_' || row_number() OVER (ORDER BY id) AS pseudonym
        FROM (SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events)""",
    "extract_entities": oracle(
        'SELECT doc_id, type, start::INTEGER AS start, (start + length(hit))::INTEGER AS "end", '
        "hit AS text FROM typed",
        **_PATTERN_TABLES,
    ),
    "gazetteer_entities": oracle(_NAMED, named_texts="SELECT doc_id, text FROM documents", **_NAME_TABLES),
    "gazetteer_entities_by_join": oracle(_NAMED, named_texts="SELECT doc_id, text FROM documents", **_NAME_TABLES),
    "mask_names": oracle("SELECT doc_id, masked, entities FROM all_masked", **_ALL_TABLES),
    "mask_review": oracle(
        """
        SELECT t.doc_id, 'text' AS "column", t.text AS original_text, m.masked AS anonymized_text,
               coalesce(e.entities, '[]') AS entities
        FROM texts t JOIN masked m USING (doc_id) LEFT JOIN (
            SELECT doc_id, '[' || string_agg('{"type":"' || type || '","start":' || start::INTEGER || ',"end":'
                || (start + length(hit))::INTEGER || ',"text":"' || hit || '"}', ',' ORDER BY start) || ']' AS entities
            FROM typed GROUP BY doc_id) e USING (doc_id)""",
        **_PATTERN_TABLES,
    ),
    "mask_text": oracle("SELECT doc_id, masked FROM masked", **_PATTERN_TABLES),
    "unmask_roundtrip": f"SELECT doc_id, text FROM ({_TEXTS})",
}
