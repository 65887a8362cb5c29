"""Finding listed names in texts with a trie of folded words.

A name and a text are read the same way: words and what stands between them, in lower
case, white space as one space. So `JAN  de Boer` is found by `jan de boer`. Each text is
scanned once; a list that is too large to send to every task is joined to the runs of
words of the texts first, and each text is scanned with its own names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.functions import text as tx

#: Names up to which the list is sent to every task, as it is.
BROADCAST_NAMES = 200_000
#: Bytes of text that are scanned at once; one longer text is taken alone.
CHUNK = 1 << 18

ENTITIES = "array<struct<type:string,start:int,end:int,text:string>>"
FOUND = f"struct<entities:{ENTITIES},gaps:array<string>,numbers:array<int>>"

_PIECE = re.compile(r"\w+|\W+")
_SPACE = re.compile(r"\s+")
_NEXT = re.compile(r"(\W++)(\w+)")
#: First words of names up to which texts are searched for them by one pattern, instead of being read word by word.
FEW = 64


def _lower(text: str) -> str:
    """Lower case of the same length, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def pieces(text: str) -> list[str]:
    """Words in lower case, and between them what separates them."""
    return _PIECE.findall(_lower(text))


class NameTrie:
    """Names as paths: the first word, then each word with what stands before it.

    What stands before the first and after the last word of a name is no part of it; of
    equal names the first type in alphabetical order counts. A trie for many texts is worth a
    pattern of its first words, if they are few.
    """

    def __init__(self, names: Iterable[tuple[str, str]], many_texts: bool = False):
        self.root: dict = {}
        for name, kind in names:
            read = pieces(name)
            words = [i for i, p in enumerate(read) if p[0].isalnum() or p[0] == "_"]
            if not words:
                continue
            node = self.root.setdefault(read[words[0]], {})
            for i in words[1:]:
                node = node.setdefault(_SPACE.sub(" ", read[i - 1]) + read[i], {})
            node[""] = min(kind, node.get("", kind))
        few = many_texts and 0 < len(self.root) <= FEW
        self.first = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(self.root)))})\b") if few else None

    def longest(self, read: list[str], at: int) -> tuple[int, str] | None:
        """The piece after the longest name that starts at a piece, and the name's type."""
        node, found = self.root[read[at]], None
        while True:
            if "" in node:
                found = (at + 1, node[""])
            at += 2
            if at >= len(read):
                return found
            node = node.get(_SPACE.sub(" ", read[at - 1]) + read[at])
            if node is None:
                return found

    def longest_in(self, low: str, start: int, end: int) -> tuple[int, str] | None:
        """The same in a lower-case text, for a name whose first word is given: its end and type."""
        node, found = self.root[low[start:end]], None
        while True:
            if "" in node:
                found = (end, node[""])
            after = _NEXT.match(low, end) if len(node) > ("" in node) else None
            node = node.get(_SPACE.sub(" ", after[1]) + after[2]) if after else None
            if node is None:
                return found
            end = after.end()

    def starts(self, text: str) -> Iterator[tuple[int, Callable[[], tuple[int, str] | None]]]:
        """Places of first words of names, each with a function that gives the longest name's end and type."""
        if self.first is not None:
            low = _lower(text)
            for m in self.first.finditer(low):
                yield m.start(), lambda m=m: self.longest_in(low, m.start(), m.end())
            return
        read = pieces(text)
        root = self.root
        hits = [i for i, piece in enumerate(read) if piece in root]
        ends = list(accumulate(map(len, read))) if hits else []

        def longest(i: int) -> tuple[int, str] | None:
            found = self.longest(read, i)
            return found and (ends[found[0] - 1], found[1])

        for i in hits:
            yield ends[i] - len(read[i]), lambda i=i: longest(i)

    def scan(self, text: str, spans: Sequence[dict]) -> list[tuple[str, int, int]]:
        """(type, start, end) of names and of the given spans, without overlaps.

        What starts first wins; at one place a span, then the longest name. Spans come in order.
        """
        out, done, k = [], 0, 0
        for start, longest in self.starts(text):
            while k < len(spans) and spans[k]["start"] <= start:
                if spans[k]["start"] >= done:
                    out.append((spans[k]["type"], spans[k]["start"], spans[k]["end"]))
                    done = spans[k]["end"]
                k += 1
            found = longest() if start >= done else None
            if found:
                done = found[0]
                out.append((found[1], start, done))
        return out + [(s["type"], s["start"], s["end"]) for s in spans[k:] if s["start"] >= done]


def merged(spans: Sequence[dict], found: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans and found entities, both in order, without overlaps: what starts first wins, at one place the span."""
    given = [(s["type"], s["start"], s["end"]) for s in spans]
    out, done = [], 0
    for kind, start, end in sorted([*given, *found], key=lambda x: x[1]):
        if start >= done:
            out.append((kind, start, end))
            done = end
    return out


def _arrays(texts: pa.Array, found: Iterable[list[tuple[str, int, int]] | None]) -> pa.Array:
    """Entities, the text between them, and how often each one's type still comes from there on; null for a missing text."""
    kinds, starts, ends, words, numbers, gaps = [], [], [], [], [], []
    entity_ends, gap_ends, missing = [0], [0], []
    for text, entities in zip(texts.to_pylist(), found, strict=True):
        missing.append(entities is None)
        done, left = 0, {}
        own = []
        for kind, start, end in entities or ():
            gaps.append(text[done:start])
            kinds.append(kind)
            starts.append(start)
            ends.append(end)
            words.append(text[start:end])
            done = end
        for kind, _, _ in reversed(entities or ()):
            left[kind] = left.get(kind, 0) + 1
            own.append(left[kind])
        numbers += reversed(own)
        if entities is not None:
            gaps.append(text[done:])
        entity_ends.append(len(kinds))
        gap_ends.append(len(gaps))
    entity = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.string())],
        ["type", "start", "end", "text"],
    )
    offsets = pa.array(entity_ends, pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(offsets, entity),
            pa.ListArray.from_arrays(pa.array(gap_ends, pa.int32()), pa.array(gaps, pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())),
        ],
        ["entities", "gaps", "numbers"],
        mask=pa.array(missing, pa.bool_()),
    )


def chunked(scan: Callable[..., pa.Array], texts: pa.Array, *others: pa.Array) -> pa.Array:
    """The scan of a batch, a few texts at a time: what Python holds does not grow with the batch."""

    def parts() -> Iterator[pa.Array]:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
            yield scan(*(a.slice(start, stop - start) for a in (texts, *others)))
            start = stop

    return pa.concat_arrays(list(parts())) if len(texts) else scan(texts, *others)


def once(scan: Callable[..., pa.Array], *columns: str) -> Column:
    """The scan of some columns; called anything but deterministic, a filter on what it finds doesn't run it a second time."""

    def scan_batch(*arrays: pa.Array) -> pa.Array:
        return chunked(scan, *arrays)

    return F.arrow_udf(scan_batch, FOUND).asNondeterministic()(*map(F.col, columns))


def _scanner(trie: Callable[[], NameTrie]):
    def scan(texts: pa.Array, spans: pa.Array) -> pa.Array:
        names = trie()
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return _arrays(texts, (None if text is None else names.scan(text, given or ()) for text, given in rows))

    return scan


def _scan_with_own(texts: pa.Array, spans: pa.Array, names: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), spans.to_pylist(), names.to_pylist(), strict=True)
    return _arrays(
        texts,
        (
            None if text is None else NameTrie((n["term"], n["type"]) for n in own or ()).scan(text, given or ())
            for text, given, own in rows
        ),
    )


def folded(term: Column) -> Column:
    """A term from its first to its last word, in lower case, white space as one space; without words it is empty."""
    core = F.regexp_extract(F.lower(term), rf"(?s)^[^{tx.WORD}]*+(.*[{tx.WORD}])", 1)
    return F.regexp_replace(core, r"(?U)[\s\x1c-\x1f]+", " ")


def own_names(texts: DataFrame, gazetteer: DataFrame, key: str, column: str) -> DataFrame:
    """(key, names): per text the listed names that occur in it, by a join of its runs of words with the list.

    Only runs as long as some listed name are made. The join is left to Spark.
    """
    listed = (
        gazetteer.select(folded(F.col("term")).alias("term"), "type").where("term != ''")
        .groupBy("term").agg(F.min("type").alias("type"))
        .withColumn("words", F.regexp_count("term", F.lit(rf"[{tx.WORD}]+")))
    )
    lengths = [r.words for r in listed.select("words").distinct().orderBy("words").collect()]  # one per length of a name
    read = F.regexp_extract_all(folded(F.col(column)), F.lit(rf"[{tx.WORD}]+|[^{tx.WORD}]+"), F.lit(0))

    def runs(n: int) -> Column:
        pieces = 2 * n - 1
        joined = F.transform(
            F.sequence(F.lit(1), F.size("_read") - (pieces - 1), F.lit(2)), lambda i: F.array_join(F.slice("_read", i, pieces), "")
        )
        return F.when(F.size("_read") >= pieces, joined).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[runs(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    return (
        texts.select(key, read.alias("_read")).select(key, F.explode(every).alias("term"))
        .join(listed.select("term", "type"), "term")
        .groupBy(key).agg(F.collect_set(F.struct("term", "type")).alias("_own"))
    )


def find_names(texts: DataFrame, gazetteer: DataFrame, key: str, column: str, spans: str, name: str, limit: int | None = None) -> DataFrame:
    """Adds the struct `name`: entities, gaps and numbers, from the names of the list and from `spans`, entities found already.

    Missing texts get null. Up to `limit` names the list goes to every task; beyond, names
    are joined to texts by `key`.
    """
    limit = BROADCAST_NAMES if limit is None else limit
    terms = gazetteer.where("term is not null and type is not null").select("term", "type")
    some = terms.limit(limit + 1).collect()
    if len(some) > limit:
        searched = texts.join(own_names(texts, terms, key, column), key, "left")
        return searched.withColumn(name, once(_scan_with_own, column, spans, "_own")).drop("_own")
    shared = texts.sparkSession.sparkContext.broadcast([(r.term, r.type) for r in some])
    held: list[NameTrie] = []

    def trie() -> NameTrie:
        if not held:
            held.append(NameTrie(shared.value, many_texts=True))
        return held[0]

    return texts.withColumn(name, once(_scanner(trie), column, spans))
