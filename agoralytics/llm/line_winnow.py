"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A window is the shortest run of lines that is long enough to count. Its smallest line
hash is stored as a fingerprint: equal windows have equal minima at one place, so a
repeated run that holds a window shares a fingerprint. Places of fingerprints that occur
twice are joined. Where the window around a place equals the first one in the corpus
with that fingerprint, the match is extended line by line both ways; matches that
overlap form runs, and runs are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.llm.common import cut_lineage

#: A window ends at this many lines, or sooner when its lines hold this many characters or words.
LINES, CHARACTERS, WORDS = 3, 300, 40


def _windows(text: Column, lines: int, characters: int, words: int) -> Column:
    """Array of (mark, key, place, first, last, before, after) of a text: the smallest line hash, the hash
    of all lines, the place of the smallest, the first and last line, and the lines around, nearest first.

    Blank lines don't count. No match goes on for `lines` lines beyond its windows, so fewer are kept.
    """
    each = F.transform(
        F.split(text, "\n", -1), lambda s, i: F.struct(i.alias("i"), F.trim(s).alias("s"))
    )
    solid = F.transform(
        F.filter(each, lambda x: F.length(x["s"]) > 0),
        lambda x: F.struct(
            x["i"].alias("i"), F.xxhash64(x["s"]).alias("h"), F.length(x["s"]).alias("n"),
            (F.length(x["s"]) - F.length(F.replace(x["s"], F.lit(" "))) + 1).alias("w"),
        ),
    )

    def around(solid: Column, places: list[Column]) -> Column:
        some = [F.get(solid, p) for p in places]
        return F.array(*(F.struct(x["i"].alias("i"), x["h"].alias("h")) for x in some))

    def window(solid: Column, s: Column) -> Column:
        size, total, spoken = F.lit(lines), F.lit(0), F.lit(0)
        steps = []
        for k in range(lines - 1):
            total = total + F.coalesce(F.get(solid, s + k)["n"], F.lit(0))
            spoken = spoken + F.coalesce(F.get(solid, s + k)["w"], F.lit(0))
            steps.append((k + 1, (total >= characters) | (spoken >= words)))
        for k, enough in reversed(steps):
            size = F.when(enough, k).otherwise(size)
        part = F.slice(solid, s + 1, size)
        hashes = F.transform(part, lambda x: x["h"])
        return F.struct(
            size.alias("size"), F.size(part).alias("have"), hashes.alias("hashes"),
            F.element_at(part, 1)["i"].alias("first"), F.element_at(part, -1)["i"].alias("last"), s.alias("s"),
        )

    def all_windows(solid: Column) -> Column:
        starts = F.when(F.size(solid) > 0, F.sequence(F.lit(0), F.size(solid) - 1)).otherwise(F.array().cast("array<int>"))
        whole = F.filter(F.transform(starts, lambda s: window(solid, s)), lambda w: w["size"] == w["have"])
        return F.transform(whole, lambda w: F.struct(
            F.array_min(w["hashes"]).alias("mark"),
            F.xxhash64(w["hashes"]).alias("key"),
            (w["s"] + F.array_position(w["hashes"], F.array_min(w["hashes"]))).alias("place"),
            w["first"], w["last"],
            around(solid, [w["s"] - k for k in range(1, max(lines, 2))]).alias("before"),
            around(solid, [w["s"] + w["size"] + k for k in range(max(lines, 2) - 1)]).alias("after"),
        ))

    # the lambda's argument holds the lines once, however often a window looks at them
    return F.element_at(F.transform(F.array(solid), all_windows), 1)


def _extended(own: Column, other: Column, edge: Column, steps: int, k: int = 0) -> Column:
    """The line that a match reaches from its edge, while the next line of both sides is equal."""
    if k == steps:
        return edge
    same = F.get(own, k)["h"] == F.get(other, k)["h"]
    return F.when(same, _extended(own, other, F.get(own, k)["i"], steps, k + 1)).otherwise(edge)


def repeats(docs: DataFrame, lines: int = LINES, characters: int = CHARACTERS, words: int = WORDS) -> DataFrame:
    """(doc_id, code, first, last): runs of lines of a document that go; code is a hash of its text."""
    text = F.coalesce("text", F.lit(""))
    windows = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("code"), F.explode(_windows(text, lines, characters, words)).alias("w"))
        .select("doc_id", "code", "w.*")
    )
    place = F.xxhash64("doc_id", "code", "place")
    marks = windows.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("mark")
    joined = windows.join(marks, "mark").drop("place")
    # A missing id comes last in the order of the corpus.
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("code").alias("text"), F.col("first").alias("line"))
    heads = (
        joined.groupBy("mark", "key")
        .agg(F.min(at).alias("head"), F.min_by(F.struct("before", "after"), at).alias("other"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    matched = joined.join(heads, ["mark", "key"]).where(~at.eqNullSafe(F.col("head")))
    steps = max(lines, 2) - 1
    later = matched.select(
        "doc_id", "code",
        _extended(F.col("before"), F.col("other.before"), F.col("first"), steps).alias("first"),
        _extended(F.col("after"), F.col("other.after"), F.col("last"), steps).alias("last"),
    ).distinct()
    own = Window.partitionBy("doc_id", "code").orderBy("first", "last")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    numbered = opened.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "code", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def drop_repeats(docs: DataFrame, lines: int = LINES, characters: int = CHARACTERS, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and the text that is left, of every row of documents(doc_id, text).

    A line goes if a window of lines that covers it equals an earlier one, by doc_id and
    place, in the same document or another, or if it follows such a window, before or
    behind, as it does at the first one; lines are equal without spaces at their ends.
    A window is `lines` lines, or fewer if they hold `characters` characters or `words`
    words between single spaces. Blank lines don't count, and go with the run around them. A missing text is an empty one, of one
    empty line. Rows without an id come last; rows with equal id and text lose the same
    lines. Other columns don't matter; no rows give no rows.
    """
    gone = repeats(docs, lines, characters, words).groupBy("doc_id", "code").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("code"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("code").alias("c"), "runs")
    held = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("code") == F.col("c")), "left")
    split = F.split("text", "\n", -1)
    n = F.size("lines")
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("runs", k - 1)["last"] + 1)
    end = lambda k: F.when(k == F.size("runs"), n).otherwise(F.get("runs", k)["first"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda k: F.slice("lines", begin(k) + 1, end(k) - begin(k))))
    removed = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    some = F.col("runs").isNotNull()
    return held.withColumn("lines", split).select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.when(some, removed).otherwise(0).cast("long").alias("n_removed"),
        F.when(some, F.size("runs")).otherwise(0).cast("long").alias("n_runs"),
        F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
    )


#: With values of its own, so that a change of the settings shows.
ORACLE = """
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), line AS (
        SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS i FROM cut
    ), solid AS (
        SELECT doc_id, i, trim(raw) AS s,
            length(trim(raw)) >= 300 OR length(trim(raw)) - length(replace(trim(raw), ' ', '')) >= 39 AS single,
            length(trim(raw)) AS n, length(trim(raw)) - length(replace(trim(raw), ' ', '')) + 1 AS w
        FROM line WHERE length(trim(raw)) > 0
    ), near AS (
        SELECT *, lag(s, 1) OVER o AS b1, lag(s, 2) OVER o AS b2, lag(i, 1) OVER o AS j1, lag(i, 2) OVER o AS j2,
            lead(s, 1) OVER o AS s1, lead(s, 2) OVER o AS s2, lead(s, 3) OVER o AS s3, lead(s, 4) OVER o AS s4,
            lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2, lead(i, 3) OVER o AS i3, lead(i, 4) OVER o AS i4,
            n + lead(n, 1) OVER o >= 300 OR w + lead(w, 1) OVER o >= 40 AS paired
        FROM solid WINDOW o AS (PARTITION BY doc_id ORDER BY i)
    ), win AS (
        SELECT doc_id, i AS first, CASE WHEN single THEN i WHEN paired THEN i1 ELSE i2 END AS last,
            CASE WHEN single THEN s WHEN paired THEN s || chr(10) || s1 ELSE s || chr(10) || s1 || chr(10) || s2 END AS key,
            b1, b2, j1, j2,
            CASE WHEN single THEN s1 WHEN paired THEN s2 ELSE s3 END AS a1, CASE WHEN single THEN s2 WHEN paired THEN s3 ELSE s4 END AS a2,
            CASE WHEN single THEN i1 WHEN paired THEN i2 ELSE i3 END AS k1, CASE WHEN single THEN i2 WHEN paired THEN i3 ELSE i4 END AS k2
        FROM near
    ), ranked AS (
        SELECT *, row_number() OVER o AS k, first_value(b1) OVER o AS hb1, first_value(b2) OVER o AS hb2,
            first_value(a1) OVER o AS ha1, first_value(a2) OVER o AS ha2
        FROM win WHERE last IS NOT NULL AND key IS NOT NULL WINDOW o AS (PARTITION BY key ORDER BY doc_id, first)
    ), later AS (
        SELECT doc_id, CASE WHEN b1 = hb1 AND b2 = hb2 THEN j2 WHEN b1 = hb1 THEN j1 ELSE first END AS first,
            CASE WHEN a1 = ha1 AND a2 = ha2 THEN k2 WHEN a1 = ha1 THEN k1 ELSE last END AS last
        FROM ranked WHERE k > 1
    ), reached AS (
        SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM later
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later
    ), runs AS (
        SELECT doc_id, count(*) AS n_runs FROM reached WHERE reach IS NULL OR first > reach + 1 GROUP BY doc_id
    ), left_over AS (
        SELECT line.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
            coalesce(string_agg(raw, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '') AS text
        FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.i = line.i GROUP BY line.doc_id
    )
    SELECT l.doc_id, n_lines, n_removed, coalesce(n_runs, 0) AS n_runs, text FROM left_over l LEFT JOIN runs r ON r.doc_id = l.doc_id
"""
