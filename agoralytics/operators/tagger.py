"""A trained tagger for names: it knows words by their form and their neighbours, so it also finds names that no list has.

It is an averaged perceptron over label sequences. All rows it learns from are labelled by
a list of names, cut into parts whose number grows with the texts, and each part is gone through
in a task of its own; after every round the weights of all parts are averaged, slice by slice, and
sent out again. Decoding takes a batch of sentences at once, one step per place in a sentence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.functions.values import seeded_hash
from agoralytics.operators.names import NameTrie, _arrays, merged, once, own_names
from agoralytics.session import cut_lineage

#: Parts that the texts are cut into at least, rounds over them, and characters of a part beyond which there are more parts.
PARTS, ROUNDS, PART_CHARS = 8, 8, 4_000_000
#: Slices that the weights are averaged in; sentences whose features are made at once.
SLICES, SENTENCES = 64, 2_048
#: Features, COLUMNS of them per token, are hashed to so many weights per label; sentences longer than LONGEST tokens are cut.
FEATURES, COLUMNS, LONGEST, BATCH = 1 << 16, 11, 60, 64

_TOKEN = re.compile(r"\w+|[^\w\s]")
_END = frozenset(".!?")


def _shape(word: str) -> str:
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)


def sentences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Places of the tokens, sentence by sentence; line breaks end one too."""
    out: list[tuple[int, int]] = []
    for found in _TOKEN.finditer(text):
        start, end = found.span()
        if out and (len(out) >= LONGEST or "\n" in text[out[-1][1] : start]):
            yield out
            out = []
        out.append((start, end))
        if text[start] in _END:
            yield out
            out = []
    if out:
        yield out


def features(rows: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each token (one row per token, sentence after sentence), and the lengths of the sentences."""
    lengths = np.array([len(r) for r in rows], np.int64)
    words = [w for r in rows for w in r]
    known: dict[str, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    facts = [(w.lower(), w[:3].lower(), w[-3:].lower(), _shape(w)) for w in known]
    parts = np.array([[zlib.crc32(f.encode()) for f in fact] for fact in facts], np.uint64).reshape(len(known), 4)
    own = parts[code]
    first = np.zeros(len(words), bool)
    first[np.cumsum(lengths) - lengths] = True
    last = np.roll(first, -1)
    none = np.uint64(1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = none, none
    second = np.roll(before, 1, axis=0)
    second[first] = none
    start = first.astype(np.uint64)
    columns = [
        own[:, 0], own[:, 1], own[:, 2], own[:, 3] + start * np.uint64(97), before[:, 0], after[:, 0], second[:, 0],
        before[:, 3] * np.uint64(31) + own[:, 3], own[:, 3] * np.uint64(37) + after[:, 0], own[:, 3] * np.uint64(41) + before[:, 0],
        np.full(len(words), 5, np.uint64),
    ]
    slots = np.arange(1, len(columns) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread = [(c + slot) * np.uint64(0xD6E8FEB86659FD93) for slot, c in zip(slots, columns, strict=True)]
    return np.stack([(s >> np.uint64(40)) % np.uint64(FEATURES) for s in spread], axis=1).astype(np.int64), lengths


def labels_of(types: Sequence[str]) -> list[str]:
    return ["O", *(f"{p}-{t}" for t in types for p in "BI")]


def _allowed(n: int) -> np.ndarray:
    """0 where label b may follow label a, minus infinity where not; the last row is that of a sentence's start."""
    out = np.zeros((n + 1, n), np.float32)
    for inside in range(2, n, 2):
        out[:, inside] = -np.inf
        out[[inside - 1, inside], inside] = 0
    return out


def decode(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best label of each token, for all sentences at once; steps are the weights of label pairs."""
    n, longest, kinds = len(lengths), int(lengths.max(initial=0)), scores.shape[1]
    rule = steps + _allowed(kinds)
    begins = np.cumsum(lengths) - lengths
    padded = np.zeros((n, longest, kinds), np.float32)
    row, place = np.repeat(np.arange(n), lengths), np.arange(len(scores)) - np.repeat(begins, lengths)
    padded[row, place] = scores
    best = padded[:, 0] + rule[-1] if longest else np.zeros((n, kinds), np.float32)
    came = np.zeros((n, longest, kinds), np.int8)
    for t in range(1, longest):
        ways = best[:, :, None] + rule[None, :-1]
        came[:, t] = ways.argmax(axis=1)
        best = np.where((t < lengths)[:, None], ways.max(axis=1) + padded[:, t], best)
    out = np.zeros((n, longest), np.int64)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        now = np.where(t == lengths - 1, best.argmax(axis=1), now)
        out[:, t] = now
        now = np.where(t < lengths, came[np.arange(n), t, now], now)
    return out[row, place]


def _learn(weights: np.ndarray, steps: np.ndarray, rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """One round over a part: weights at its end, and their mean over the round."""
    mean_w, mean_s, count = np.zeros_like(weights), np.zeros_like(steps), 0
    for idx, lengths, gold in rows:
        count += 1
        guess = decode(weights[idx].sum(axis=1), lengths, steps)
        first = np.cumsum(lengths) - lengths
        wrong = np.flatnonzero(guess != gold)
        for labels, sign in ((gold, 1), (guess, -1)):
            np.add.at(weights, (idx[wrong], labels[wrong][:, None]), np.float32(sign))
            before = np.roll(labels, 1)
            before[first] = steps.shape[1]
            np.add.at(steps, (before, labels), np.float32(sign))
        mean_w += weights
        mean_s += steps
    return weights, steps, mean_w / max(1, count), mean_s / max(1, count)


def _batches(rows: Sequence, size: int = BATCH) -> Iterator[Sequence]:
    for k in range(0, len(rows), size):
        yield rows[k : k + size]


@dataclass(frozen=True)
class Tagger:
    """Weights per feature and label, and per pair of labels; `types` are the types of names."""

    types: tuple[str, ...]
    weights: np.ndarray
    steps: np.ndarray

    def find(self, texts: Iterable[str | None]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of the names of each text."""
        out: list[list[tuple[str, int, int]]] = []
        held = []
        for text in texts:
            out.append([])
            held += [(len(out) - 1, text, places) for places in sentences(text or "")]
        held.sort(key=lambda x: len(x[2]))  # sentences of a batch should be equally long
        for part in _batches(held):
            idx, lengths = features([[text[a:b] for a, b in places] for _, text, places in part])
            labels = decode(self.weights[idx].sum(axis=1), lengths, self.steps).tolist()
            at = 0
            for owner, _, places in part:
                own = labels[at : at + len(places)]
                at += len(places)
                for (start, end), label in zip(places, own, strict=True):
                    if label % 2:
                        out[owner].append((self.types[label // 2], start, end))
                    elif label:
                        kind, begun, _ = out[owner].pop()
                        out[owner].append((kind, begun, end))
        return [sorted(found, key=lambda x: x[1]) for found in out]

    def add_entities(self, texts: DataFrame, column: str, spans: str, name: str) -> DataFrame:
        """Adds the struct `name`: entities, gaps and numbers, from the tagged names and from `spans`, entities found already."""
        shared = texts.sparkSession.sparkContext.broadcast(self)  # of a fixed size: FEATURES numbers per label

        def scan(values: pa.Array, given: pa.Array) -> pa.Array:
            tagger = shared.value
            rows = values.to_pylist()
            both = zip(rows, given.to_pylist(), tagger.find(rows), strict=True)
            return _arrays(values, (None if text is None else merged(own or (), found) for text, own, found in both))

        return texts.withColumn(name, once(scan, column, spans))


def _examples(texts: Sequence[tuple[str, Sequence[tuple[str, str]]]], types: Sequence[str]):
    """Feature numbers and labels of all tokens, sentence after sentence, and the lengths of the sentences of texts, each labelled by its own names."""
    number = {t: i for i, t in enumerate(types)}
    done: list[tuple[np.ndarray, ...]] = []
    rows: list[list[str]] = []
    gold: list[int] = []

    def close() -> None:
        idx, lengths = features(rows)
        done.append((idx.astype(np.uint16), np.array(gold, np.uint8 if len(types) < 128 else np.int64), lengths.astype(np.uint8)))
        rows.clear()
        gold.clear()

    for text, names in texts:
        found = NameTrie(names).scan(text, ())
        k = 0
        for places in sentences(text):
            labels: list[int] = []
            for start, end in places:
                while k < len(found) and found[k][2] <= start:
                    k += 1
                kind, begun, _ = found[k] if k < len(found) and found[k][1] <= start and end <= found[k][2] else (None, 0, 0)
                inside = kind is not None and begun != start and bool(labels) and labels[-1] in (2 * number[kind] + 1, 2 * number[kind] + 2)
                labels.append(0 if kind is None else 2 * number[kind] + (2 if inside else 1))
            rows.append([text[a:b] for a, b in places])
            gold += labels
            if len(rows) >= SENTENCES:
                close()
    if rows or not done:
        close()
    return tuple(np.concatenate(a) for a in zip(*done, strict=True))


def _mixed(idx: np.ndarray, gold: np.ndarray, lengths: np.ndarray):
    """Batches (feature numbers, lengths, labels) in mixed order: sentences that are alike in length are alike in names."""
    lengths = lengths.astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    order = np.random.default_rng(len(lengths)).permutation(len(lengths))
    for part in _batches(order):
        own = lengths[part]
        at = np.repeat(begins[part] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        yield idx[at], own, gold[at].astype(np.int64)


def train(
    texts: DataFrame, gazetteer: DataFrame, key: str, column: str, seed: int = 42,
    parts: int = PARTS, rounds: int = ROUNDS,
) -> Tagger:
    """Learns from all texts with a word in them, labelled by the list (term, type).

    There are `parts` parts, more of them when the texts have over PART_CHARS characters a part: what a task holds does
    not grow with the table. The list should be that of the names in these texts: what it misses counts as no name. It
    may be of any size: it is joined to the runs of words of the texts, and a task gets the names of its own texts.
    No texts, or no names, give a tagger that finds nothing.
    """
    listed = gazetteer.where("term is not null and type is not null").select("term", "type")
    types = tuple(sorted(r.type for r in listed.select("type").distinct().collect())) or ("NAME",)  # one per label
    kinds = len(labels_of(types))
    read = texts.select(key, column).where(F.col(column).rlike(r"\S"))
    # Keys may repeat; the numbers of the rows don't.
    rows = cut_lineage(read.select(F.monotonically_increasing_id().alias("_id"), seeded_hash(key, seed + 1).alias("_hash"), F.col(column).alias("text")))
    needed = -(-(rows.agg(F.sum(F.length("text").cast("long"))).head()[0] or 0) // PART_CHARS)
    # Rows of one key stay together only where all parts are small.
    by = [F.col("_hash")] if needed <= parts else [F.col("_hash"), F.col("text")]
    parts = max(parts, needed)
    part = F.pmod(F.hash(*by), F.lit(parts)).alias("part")
    named = rows.select("_id", "text", part).join(own_names(rows, listed, "_id", "text"), "_id", "left")

    def read_part(part: pa.Table) -> pa.Table:
        own = sorted((r["text"], sorted((n["term"], n["type"]) for n in r["_own"] or ())) for r in part.to_pylist())  # the same order wherever the rows come from
        arrays = _examples(own, types)
        cells = {f"e{i}": pa.array([x.tobytes()], pa.binary()) for i, x in enumerate(arrays)}
        return pa.table({"part": pa.array([part["part"][0].as_py()], pa.int32()), "n": [len(own)], **cells})

    # One row per part; more partitions than parts, so that few parts share a task. Every round reads them.
    examples = cut_lineage(
        named.select("text", "part", "_own").repartition(4 * parts, "part").groupBy("part")
        .applyInArrow(read_part, "part int, n long, e0 binary, e1 binary, e2 binary")
    )
    total = examples.agg(F.sum("n")).head()[0]
    weights, steps = np.zeros((FEATURES, kinds), np.float32), np.zeros((kinds + 1, kinds), np.float32)
    total_w, total_s = np.zeros((FEATURES, kinds), np.float64), np.zeros((kinds + 1, kinds), np.float64)
    if total is None:
        return Tagger(types, total_w.astype(np.float32), total_s.astype(np.float32))
    spark, kind = texts.sparkSession, np.uint8 if len(types) < 128 else np.int64

    def sliced(done: Sequence[np.ndarray]) -> Iterator[tuple[bytes, ...]]:
        w, s, mean_w, mean_s = (x.astype("<f4") for x in done)
        for k in range(SLICES):
            cut = slice(k * FEATURES // SLICES, (k + 1) * FEATURES // SLICES)
            yield (w[cut].tobytes(), mean_w[cut].tobytes(), s.tobytes() if not k else b"", mean_s.tobytes() if not k else b"")

    def averaged(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        share = rows["n"].to_numpy().astype(np.float64) / total
        cells = {"slice": rows["slice"][:1]}
        for name in ("a0", "a1", "a2", "a3"):
            mean = sum(p * np.frombuffer(x.as_py(), "<f4") for p, x in zip(share, rows[name], strict=True))
            cells[name] = pa.array([mean.tobytes()], pa.binary())
        return pa.table(cells)

    schema = "slice int, a0 binary, a1 binary, a2 binary, a3 binary"
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((weights, steps))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, s = shared.value
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    part, n, *cells = (x.as_py() for x in row)
                    idx, gold, lengths = (np.frombuffer(c, t) for c, t in zip(cells, (np.uint16, kind, np.uint8), strict=True))
                    done = _learn(w.copy(), s.copy(), _mixed(idx.reshape(-1, COLUMNS), gold, lengths))
                    for k, cut in enumerate(sliced(done)):
                        yield pa.RecordBatch.from_pydict({"part": [part], "n": [n], "slice": [k], **{f"a{i}": [x] for i, x in enumerate(cut)}}, _LEARNED)

        each = examples.mapInArrow(learn, "part int, n long, " + schema)
        got = sorted(each.groupBy("slice").applyInArrow(averaged, schema).collect())  # of a fixed size
        weights, mean_w = (np.concatenate([np.frombuffer(r[i]) for r in got]).reshape(weights.shape) for i in (1, 2))
        steps, mean_s = (np.frombuffer(got[0][i]).reshape(steps.shape) for i in (3, 4))
        weights, steps = weights.astype(np.float32), steps.astype(np.float32)
        if turn >= rounds // 2:  # the first rounds swing widely
            total_w, total_s = total_w + mean_w, total_s + mean_s
        shared.unpersist()
    return Tagger(types, total_w.astype(np.float32), total_s.astype(np.float32))


_LEARNED = pa.schema(
    [("part", pa.int32()), ("n", pa.int64()), ("slice", pa.int32()), *((f"a{i}", pa.binary()) for i in range(4))]
)


def scores(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """precision, recall and f1 per type and for all (type `all`) of spans (key, type, start, end) against true ones; rows may repeat."""
    columns = [key, "type", "start", "end"]
    both = (
        found.select(*columns, F.lit(1).alias("f"), F.lit(0).alias("t")).distinct()
        .unionByName(truth.select(*columns, F.lit(0).alias("f"), F.lit(1).alias("t")).distinct())
        .groupBy(*columns).agg(F.sum("f").alias("f"), F.sum("t").alias("t"))
    )
    counted = both.select(F.explode(F.array("type", F.lit("all"))).alias("type"), "f", "t").groupBy("type").agg(
        F.sum("f").alias("n_found"), F.sum("t").alias("n_true"), F.sum(F.col("f") * F.col("t")).alias("n_right")
    )
    right = F.col("n_right").cast("double")
    return counted.select(
        "type", "n_found", "n_true", "n_right",
        F.try_divide(right, "n_found").alias("precision"), F.try_divide(right, "n_true").alias("recall"),
        F.try_divide(2 * right, F.col("n_found") + F.col("n_true")).alias("f1"),
    )
