"""Registered queries: dictionaries and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoralytics.catalog.base import SPACE, Stages, oracle, words_sql
from agoralytics.operators import lexicon, threads
from agoralytics.sources.dictionary import parse_dictionary

# A small dictionary that fits the words of the test documents.
CATEGORIES = {1: "function", 2: "affect", 3: "social", 4: "cogproc", 5: "negate", 6: "drives"}
LEXICON = (
    ("the", False, (1,)), ("of", False, (1,)), ("de", False, (1,)), ("and", False, (1,)),
    ("la", False, (1,)), ("der", False, (1,)), ("und", False, (1,)), ("que", False, (1, 4)),
    ("le", False, (1,)), ("was", False, (1, 4)), ("is", False, (1, 1)), ("no", False, (5,)),
    ("non", False, (5,)), ("nicht", False, (5, 1)), ("with", False, (1, 3, 6)),
    ("don't", False, (5,)), ("that", False, (1, 4)), ("er", False, (1,)), ("the", True, (3,)),
    ("th", True, (4,)), ("that", True, (4, 6)), ("ent", True, (6,)), ("enti", True, (6, 2)),
    ("un", True, (5,)), ("re", True, (6,)), ("ha", True, (2,)), ("on", True, (3,)),
    ("er", True, (2,)), ("éau", True, (2, 3)), ("ge", True, (1, 6)),
)


def _entries(spark):
    rows = ", ".join(
        "('{}', {}, array({}))".format(
            term.replace("'", "\\'"), str(prefix).lower(), ", ".join(map(str, cats))
        )
        for term, prefix, cats in LEXICON
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, is_prefix, cat_ids)")


def _dictionaries(spark, folder):
    """One dictionary text per benchmark item, made of the item's words."""
    items = Stages(spark, folder).table("benchmark")
    words = F.split(F.translate("text", "%\t\n", ""), " ")
    line = F.transform(
        words,
        lambda w, i: F.concat(
            w,
            F.when(F.length(w) > 6, "*").otherwise(""),
            F.lit("\t"),
            (1 + F.length(w) % 3).cast("string"),
            F.when(i % 2 == 0, "\t4\tx").otherwise(""),
        ),
    )
    head = "%\n1\tfunction\n2\taffect\nbad\tline\n3\tsocial\n4\tcogproc\n%\n"
    return items.select(
        F.col("item_id").alias("dictionary_id"),
        F.concat(F.lit(head), F.array_join(line, "\n"), F.lit("\nlonely\n")).alias("content"),
    )


def lexicon_parse(spark, folder):
    entries = parse_dictionary(_dictionaries(spark, folder)).entries
    return entries.select(
        "dictionary_id", "term", "is_prefix",
        F.array_join(F.col("cat_ids").cast("array<string>"), ",").alias("cats"),
    )


def lexicon_categories(spark, folder):
    return parse_dictionary(_dictionaries(spark, folder)).categories


def lexicon_match(spark, folder):
    documents = Stages(spark, folder).table("documents")
    found = lexicon.tokens(documents, "doc_id", "text").select("token").distinct()
    return (
        lexicon.match_tokens(found, _entries(spark))
        .filter("cat_ids is not null")
        .select("token", F.array_join(F.col("cat_ids").cast("array<string>"), ",").alias("cats"))
    )


def lexicon_match_by_vocabulary(spark, folder):
    """The way for dictionaries too large to broadcast, per document."""
    documents = Stages(spark, folder).table("documents")
    found = lexicon.tokens(documents, "doc_id", "text")
    return (
        lexicon.match_tokens(found, _entries(spark), broadcast_entries=0)
        .groupBy("doc_id")
        .agg(F.count("*").alias("tokens"), F.count("cat_ids").alias("matched"))
    )


def lexicon_scores(spark, folder):
    first = threads.initial_posts(Stages(spark, folder).normalized)
    return lexicon.lexicon_scores(first, _entries(spark), CATEGORIES)


def lexicon_scores_all(spark, folder):
    documents = Stages(spark, folder).table("documents")
    return lexicon.lexicon_scores(documents, _entries(spark), CATEGORIES, "doc_id", "text")


def lexicon_means(spark, folder):
    return lexicon.lexicon_means(lexicon_scores_all(spark, folder))


_TABLES = {
    "entries": " UNION ALL ".join(
        "SELECT '{}' AS term, {} AS is_prefix, [{}] AS cats".format(
            term.replace("'", "''"), prefix, ", ".join(map(str, cats))
        )
        for term, prefix, cats in LEXICON
    ),
    "doc_words": f"""
        SELECT doc_id, regexp_replace(word, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS token
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^{SPACE}]+')) AS word
              FROM documents)""",
    "vocabulary": "SELECT DISTINCT token FROM doc_words WHERE token <> ''",
    "matches": """
        SELECT token, cats FROM (
            SELECT v.token, e.cats FROM vocabulary v JOIN entries e
              ON e.term = v.token AND NOT e.is_prefix
            UNION ALL
            SELECT v.token, arg_max(p.cats, length(p.term)) AS cats
            FROM vocabulary v JOIN entries p ON p.is_prefix AND starts_with(v.token, p.term)
            WHERE v.token NOT IN (SELECT term FROM entries WHERE NOT is_prefix)
            GROUP BY v.token)""",
    "doc_hits": """
        SELECT doc_id, cat, count(*) AS n FROM (
            SELECT doc_id, unnest(cats) AS cat FROM doc_words JOIN matches USING (token))
        GROUP BY doc_id, cat""",
    "doc_scores": "SELECT doc_id, WC, "
    + ", ".join(
        f"CASE WHEN WC > 0 THEN round(100 * coalesce(c{i}, 0) / WC, 4) ELSE 0 END AS \"{name}\""
        for i, name in CATEGORIES.items()
    )
    + f" FROM (SELECT d.doc_id, {words_sql('any_value(d.text)')} AS WC, "
    + ", ".join(f"sum(h.n) FILTER (h.cat = {i}) AS c{i}" for i in CATEGORIES)
    + " FROM documents d LEFT JOIN doc_hits h USING (doc_id) GROUP BY d.doc_id)",
}
_SCORE_NAMES = ", ".join(f'"{name}"' for name in CATEGORIES.values())

QUERIES = {
    f.__name__: f
    for f in (
        lexicon_parse, lexicon_categories, lexicon_match, lexicon_match_by_vocabulary,
        lexicon_scores, lexicon_scores_all, lexicon_means,
    )
}

ORACLES = {
    "lexicon_parse": """
        WITH listed AS (
            SELECT item_id, unnest(words) AS w, unnest(range(len(words))) AS i
            FROM (SELECT item_id, string_split(translate(text, '%' || chr(9) || chr(10), ''), ' ')
                             AS words FROM benchmark)),
        lines AS (
            SELECT item_id, i, lower(w) AS word, length(w) > 6 AS is_prefix,
                   (1 + length(w) % 3)::VARCHAR || CASE WHEN i % 2 = 0 THEN ',4' ELSE '' END AS cats
            FROM listed WHERE w <> '')
        SELECT item_id AS dictionary_id, word AS term, is_prefix, arg_max(cats, i) AS cats
        FROM lines GROUP BY item_id, word, is_prefix""",
    "lexicon_categories": """
        SELECT item_id AS dictionary_id, c.id::INTEGER AS cat_id, c.name FROM benchmark,
            (VALUES (1, 'function'), (2, 'affect'), (3, 'social'), (4, 'cogproc')) AS c(id, name)""",
    "lexicon_match": oracle(
        "SELECT token, array_to_string(cats, ',') AS cats FROM matches", **_TABLES
    ),
    "lexicon_match_by_vocabulary": oracle(
        "SELECT doc_id, count(*) AS tokens, count(m.token) AS matched FROM doc_words w "
        "LEFT JOIN matches m USING (token) WHERE w.token <> '' GROUP BY doc_id",
        **_TABLES,
    ),
    "lexicon_scores": oracle(
        f"SELECT topic_id, WC, {_SCORE_NAMES} FROM structured JOIN doc_scores USING (doc_id) "
        "WHERE is_initial_post",
        **{
            **_TABLES,
            "doc_words": _TABLES["doc_words"]
            .replace("lower(text)", "text_normalized")
            .replace("FROM documents", "FROM doc_normalized"),
        },
    ),
    "lexicon_scores_all": oracle(f"SELECT doc_id, WC, {_SCORE_NAMES} FROM doc_scores", **_TABLES),
    "lexicon_means": oracle(
        " UNION ALL ".join(
            f"SELECT '{name}' AS category, round(avg(\"{name}\"), 3) AS mean_score FROM doc_scores"
            for name in ("affect", "social", "cogproc", "WC")
        ),
        **_TABLES,
    ),
}
