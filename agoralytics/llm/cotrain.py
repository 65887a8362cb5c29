"""Quality classifier by co-training on two views of a document.

One view is its words, the other its metadata: source, language and counts that describe
its layout. Each view has a classifier per target. In every round each classifier labels
unlabelled documents, and those it is sure of train the other view's next classifier. At
the end each view is calibrated on labelled rows that took no part, and both are combined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import FeatureHasher, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.llm.bit_filter import drop_ids
from agoralytics.llm.common import cut_lineage

#: The classifiers are fitted on this many labelled rows per target and class at most (an expected number, drawn by a hash of the id).
LABELLED = 8_000
#: Rounds of exchange, the share of the unlabelled rows each view may label per class and round, how many
#: that are at most (the surest of all unlabelled rows of the corpus), and how sure it has to be.
ROUNDS, GIVEN, MOST_GIVEN, SURE = 2, 0.1, 800, 0.95
#: Files in which the fitted rows are written.
FIT_TASKS = 2
#: Every word of every text is hashed to one of these; the fitted models stay as small however large the corpus is.
WORD_FEATURES, META_FEATURES = 1 << 18, 1 << 8
#: Characters whose shares describe the layout.
LAYOUT = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÇÑÓÍ", "digits": "0123456789", "marks": ".,;:?'\"-()",
    "signs": "!#$%&*+/<=>@[\\]^_`{|}~", "lines": "\n",
}
NUMBERS = ["log_size", "log_words", "word_size", "distinct_words", *LAYOUT]
#: Penalties (L1 for words, which most rare words don't survive, L2 else), and passes of a fit by Newton steps; short steps take ten times as many.
WORD_PENALTY, META_PENALTY, LINE_PENALTY, PASSES = 5e-3, 1e-4, 1e-3, 30
VIEWS, TARGETS = ("words", "meta"), ("quality", "toxic")


def _share(of: Column, part: Column) -> Column:
    return F.coalesce(part / F.greatest(of, F.lit(1)), F.lit(0.0))


def tokenised(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns, source, lang, text and its lower-case words."""
    narrow = docs.select(
        *keep, F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("lang", F.lit("?")).alias("lang"),
    )
    return RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}]+").transform(narrow)


def views(tokens: DataFrame, *keep: str) -> DataFrame:
    """The two feature vectors, words and meta, of each document; `keep` names columns that stay.

    Any column may be null: a missing text is empty, a missing source or language a value of its own.
    """
    words = F.size("tokens")
    length, few = F.length("text"), F.col("few")
    # What is counted is a small part of a text: one pass finds it, and only that is looked through for each kind.
    others = f"[^{re.escape(''.join(LAYOUT.values()))}]+"
    hashed = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=WORD_FEATURES, binary=True)
    frame = hashed.transform(tokens.withColumn("few", F.regexp_replace("text", others, "")))
    frame = frame.select(
        *keep, "source", "lang", "counts",
        F.log1p(length.cast("double")).alias("log_size"),
        F.log1p(words.cast("double")).alias("log_words"),
        _share(words, length).alias("word_size"),
        _share(words, F.size(F.array_distinct("tokens"))).alias("distinct_words"),
        *(_share(length, F.length(few) - F.length(F.translate(few, some, ""))).alias(n) for n, some in LAYOUT.items()),
    )
    frame = FeatureHasher(inputCols=["source", "lang"], outputCol="names", numFeatures=META_FEATURES).transform(frame)
    frame = VectorAssembler(inputCols=[*NUMBERS, "names"], outputCol="meta").transform(frame)
    return frame.select(*keep, F.col("counts").alias("words"), "meta")


def _sparse(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, columns and values of a column of Spark's vectors; a dense one has no list of columns."""
    dense = pc.equal(vectors.field("type"), 1).to_numpy(zero_copy_only=False)
    index, value = vectors.field("indices"), vectors.field("values")
    sizes = pc.list_value_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    columns = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    given = np.repeat(~dense, sizes)
    columns[given] = index.flatten().to_numpy(zero_copy_only=False)[: given.sum()]
    return starts, columns, value.flatten().to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class View:
    """Linear classifier of one view: log odds are the bias and the weights of the columns."""

    weights: np.ndarray
    bias: float

    def margin(self, frame: DataFrame, view: str) -> Column:
        """Log odds of class 1."""
        shared = frame.sparkSession.sparkContext.broadcast(self)  # as large as the number of features

        def odds(vectors: pa.Array) -> pa.Array:
            own = shared.value
            starts, columns, values = _sparse(vectors)
            running = np.concatenate([[0.0], np.cumsum(own.weights[columns] * values)])
            return pa.array(running[starts[1:]] - running[starts[:-1]] + own.bias)

        return F.arrow_udf(odds, "double")(F.col(view))


@dataclass
class Combined:
    """The models of one target; `weights` are the bias and the factors of both views' calibrated log odds."""

    models: dict[str, View]
    calibration: dict
    weights: tuple[float, float, float]

    def score(self, frame: DataFrame, name: str) -> DataFrame:
        odds = F.lit(self.weights[0])
        for view, weight in zip(VIEWS, self.weights[1:], strict=True):
            a, b = self.calibration[view]
            odds = odds + weight * (a * self.models[view].margin(frame, view) + b)
        return frame.withColumn(name, 1 / (1 + F.exp(-odds)))


def _logistic(y: np.ndarray, margin: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the mean loss by margin, and the curvature."""
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return weight * (p - y) / weight.sum(), weight * p * (1 - p) / weight.sum()


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; the penalty holds for standardised columns, the bias has none."""
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-9
    w = np.zeros(z.shape[1])
    for _ in range(PASSES):
        slope, curve = _logistic(y, z @ w, weight)
        step = np.linalg.solve((z * curve[:, None]).T @ z + np.diag(ridge), z.T @ slope + ridge * w)
        w = w - np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale) @ mean)


def fit_sparse(
    starts: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, size: int
) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; a column that says little gets no weight at all."""
    used, column = np.unique(columns, return_inverse=True)
    n, rows = len(used), np.repeat(np.arange(len(y)), np.diff(starts))

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * w[column], len(y)) + w[n]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, values * r[rows], n), r.sum())

    share = weight / weight.sum()
    top = np.ones(n + 1)
    for _ in range(15):  # the largest curvature decides the length of a step
        top = back(share * times(top))
        norm = np.linalg.norm(top)
        top = top / max(norm, 1e-12)
    length = 3.5 / max(norm, 1e-12)
    w = ahead = np.zeros(n + 1)
    momentum = 1.0
    for _ in range(10 * PASSES):
        slope, _ = _logistic(y, times(ahead), weight)
        new = ahead - length * back(slope)
        new[:n] = np.sign(new[:n]) * np.maximum(np.abs(new[:n]) - length * penalty, 0)
        if (ahead - new) @ (new - w) > 0:  # momentum against the slope
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        moved = np.abs(new - w).max()
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
        if moved < 1e-5:
            break
    out = np.zeros(size)
    out[used] = w[:n]
    return out, float(w[n])


def fit_views(sets: dict[str, DataFrame]) -> dict[str, View]:
    """Fits the classifier of each view on its rows(words, meta, label): one job, one task per view over a bounded number of rows.

    Both classes weigh the same in sum.
    """
    spark = next(iter(sets.values())).sparkSession
    sizes = {"words": WORD_FEATURES, "meta": len(NUMBERS) + META_FEATURES}

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, columns, values = _sparse(batch.column("vector"))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x)) for x in (columns.astype(np.int32), values)]
            yield pa.RecordBatch.from_arrays([batch.column("view"), batch.column("label"), *lists], ["view", "label", "columns", "values"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        view, y = rows["view"].iloc[0], rows["label"].to_numpy(np.float64)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        starts = np.concatenate([[0], np.cumsum([len(c) for c in rows["columns"]])])
        columns, values = (np.concatenate([np.asarray(v) for v in rows[c]]) for c in ("columns", "values"))
        if view == "words":
            weights, bias = fit_sparse(starts, columns.astype(np.int64), values, y, weight, WORD_PENALTY, sizes[view])
        else:
            x = np.zeros((len(y), sizes[view]))
            x[np.repeat(np.arange(len(y)), np.diff(starts)), columns.astype(np.int64)] = values
            weights, bias = fit_dense(x, y, weight, META_PENALTY)
        return pd.DataFrame({"view": [view], "weights": [weights.astype("<f8").tobytes()], "bias": [bias]})

    rows = None
    for view, frame in sets.items():
        some = frame.select(F.lit(view).alias("view"), "label", F.col(view).alias("vector"))
        some = some.mapInArrow(flat, "view string, label double, columns array<int>, values array<double>")
        rows = some if rows is None else rows.unionByName(some)
    # A number of partitions of its own: few small ones would be put into one task.
    tasks = max(len(sets), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.repartition(tasks, "view").groupBy("view").applyInPandas(learn, "view string, weights binary, bias double")
    return {r.view: View(np.frombuffer(r.weights, "<f8"), r.bias) for r in found.collect()}  # a row of fixed size per view


def surest(frame: DataFrame, free: DataFrame, models: dict, most: int) -> dict[str, DataFrame]:
    """Per view the `most` rows(id, words, meta, label) of each class that it is surest of, of all rows whose id and code are in free."""
    scored = frame.select("id", "code", *((1 / (1 + F.exp(-models[view].margin(frame, view)))).alias(f"q_{view}") for view in VIEWS))
    odds = [F.col(f"q_{view}") for view in VIEWS]
    sure = scored.select("id", "code", *odds).where(F.greatest(*odds, *(1 - q for q in odds)) >= SURE)
    # Only ids and probabilities are joined and sorted; the features of the few that win are fetched afterwards.
    sure = cut_lineage(sure.join(free, ["id", "code"], "left_semi").dropDuplicates(["id"]))

    def label(view: str) -> DataFrame:
        q = F.col(f"q_{view}")
        ends = [
            sure.where(q >= SURE).orderBy(q.desc(), "id").limit(most).withColumn("label", F.lit(1.0)),
            sure.where(q <= 1 - SURE).orderBy(q, "id").limit(most).withColumn("label", F.lit(0.0)),
        ]
        return ends[0].union(ends[1]).select("id", "code", "label", F.lit(view).alias("view"))

    won = cut_lineage(label(VIEWS[0]).union(label(VIEWS[1])).coalesce(1))
    rows = frame.join(F.broadcast(won), ["id", "code"]).dropDuplicates(["id", "view"])
    rows = cut_lineage(rows.select("view", "id", *VIEWS, "label").coalesce(FIT_TASKS)).coalesce(1)
    return {view: rows.where(F.col("view") == view).drop("view") for view in VIEWS}


def fit(labelled: DataFrame, frame: DataFrame, free: DataFrame, most: int) -> Combined | None:
    """Co-trains on labelled(id, words, meta, label, held, share) and those rows of frame(id, code, words, meta)
    whose id and code are in free; None if a class is missing.

    The held rows serve calibration and combination; share is how many rows of the table one stands for.
    """
    train, rest = labelled.where("not held"), labelled.where("held")
    classes = [{r[0] for r in part.select("label").distinct().collect()} for part in (train, rest)]
    if any(c != {0.0, 1.0} for c in classes):
        return None
    sets = {view: train.select("id", *VIEWS, "label") for view in VIEWS}
    models = {}
    for turn in range(ROUNDS + 1):
        models = fit_views(sets)
        if turn == ROUNDS:
            break
        given = surest(frame, free, models, most)
        # Each view learns from what the other one is sure of; nobody labels a row again.
        sets = {"words": sets["words"].union(given["meta"]), "meta": sets["meta"].union(given["words"])}
        used = given["words"].select("id").union(given["meta"].select("id")).distinct()
        free = free.join(F.broadcast(used), "id", "left_anti")
    # A fifth of a bounded number of rows.
    held = rest.select("label", "share", *(models[view].margin(rest, view).alias(view) for view in VIEWS)).toPandas().astype(float)
    y, share = held["label"].to_numpy(), held["share"].to_numpy()
    calibration, calibrated = {}, []
    for view in VIEWS:
        margin = held[[view]].to_numpy()
        (a,), b = fit_dense(margin, y, share, LINE_PENALTY)
        calibration[view] = (float(a), b)
        calibrated.append(a * margin[:, 0] + b)
    factors, bias = fit_dense(np.column_stack(calibrated), y, share, LINE_PENALTY)
    return Combined(models, calibration, (bias, *map(float, factors)))


def _drawn(there: DataFrame) -> DataFrame:
    """Of rows(id, quality, toxic) about LABELLED per target and class at most, by a hash of the id.

    share_<target> is how many rows of its class a row stands for, null if it isn't drawn for that
    target; held_<target> marks a fifth of each class, at least one row.
    """
    counts = there.groupBy(*TARGETS).count().collect()
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000))
    for target in TARGETS:
        share = F.lit(None).cast("double")
        for label in (0.0, 1.0):
            part = min(1.0, LABELLED / max(1, sum(r["count"] for r in counts if r[target] == label)))
            share = F.when((F.col(target) == label) & (place < round(1_000_000 * part)), 1 / part).otherwise(share)
        there = there.withColumn(f"share_{target}", share)
    drawn = there.where(F.coalesce(*(f"share_{t}" for t in TARGETS)).isNotNull())
    for target in TARGETS:  # a bounded number of ids
        order = Window.partitionBy(F.when(F.col(f"share_{target}").isNotNull(), F.col(target))).orderBy(F.xxhash64("id", F.lit(5)), "id")
        drawn = drawn.withColumn(f"held_{target}", F.row_number().over(order) % 5 == 1)
    return drawn


def train(frame: DataFrame, labels: DataFrame) -> dict[str, Combined | None]:
    """A model per target from frame(id, code, words, meta) and labels(doc_id, quality, toxic); ids with two labels count with the larger."""
    known = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
        .agg(*(F.max(F.col(t).cast("double")).alias(t) for t in TARGETS))
    )
    # Of several rows with one id one counts.
    narrow = frame.where("id is not null").groupBy("id").agg(F.min("code").alias("code"))
    free = cut_lineage(narrow.join(known, "id", "left_anti"))
    most = max(1, min(MOST_GIVEN, int(GIVEN * free.count())))
    chosen = cut_lineage(_drawn(known.join(narrow, "id")))
    picked = frame.join(F.broadcast(chosen), ["id", "code"]).dropDuplicates(["id"])
    rows = cut_lineage(picked.coalesce(FIT_TASKS))

    def learn(target: str) -> Combined | None:
        labelled = rows.where(F.col(f"share_{target}").isNotNull()).select(
            "id", *VIEWS, F.col(target).alias("label"), F.col(f"held_{target}").alias("held"), F.col(f"share_{target}").alias("share")
        )
        return fit(labelled, frame, free, most)

    return {target: learn(target) for target in TARGETS}


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic and kept of every row of documents(doc_id, text, source, lang).

    kept: the document is more likely of good than of bad quality, and more likely not toxic.
    A target whose labels miss a class (or an empty table of labels) has no model: its
    score is null and rejects nothing. Any column may be null, rows may repeat, other
    columns don't matter; no rows give no rows.
    """
    coded = docs.select(F.col("doc_id").alias("id"), "text", "source", "lang", F.xxhash64("text", "source", "lang").alias("code"))
    # Read once per round and target, and once for the scores.
    frame = cut_lineage(views(tokenised(coded, "id", "code"), "id", "code"))
    models = train(frame, labels)
    frame = frame.withColumnRenamed("id", "doc_id")
    for target in TARGETS:
        name = f"p_{target}"
        frame = models[target].score(frame, name) if models[target] else frame.withColumn(name, F.lit(None).cast("double"))
    good, bad = F.coalesce("p_quality", F.lit(1.0)) >= 0.5, F.coalesce("p_toxic", F.lit(0.0)) >= 0.5
    return frame.select("doc_id", "p_quality", "p_toxic", (good & ~bad).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier keeps; rows without an id stay."""
    gone = classify(docs, labels).where("not kept and doc_id is not null").select("doc_id").distinct()
    return drop_ids(docs, cut_lineage(gone))
