"""Token ids in Arrow stream files: batches of equal-length sequences and their masks.

A file is an Arrow IPC stream. Each batch has the columns ids (fixed-size list of
unsigned integers) and mask (fixed-size list of booleans, false for filling), and all
but the last batch have the same number of sequences, so that sequence k is found in a
memory map without copying or decoding. Documents follow each other without gaps; an
index table says where each begins. Files hold consecutive ranges of doc_id.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.llm.common import chunks, cut_lineage, texts_of
from agoralytics.llm.word_table import WordTable, spread
from agoralytics.session import scratch_folder

#: Tokens in a sequence, and sequences in a batch.
LENGTH, ROWS = 2_048, 128

#: Words that go to the tokenizer as one string.
JOINED = 512

_INNER = re.compile(r"(?<=\S) (?=\S)")
_WHITE = re.compile(r"\s")
#: White space other than a space or a line feed.
_RARE = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A text in which a space may have white space or nothing beside it.
_ODD = rf"\A | \z|  |\n | \n|[{_RARE}]"


class ByteTokenizer:
    """Encodes whole texts by a byte-level tokenizer file, each distinct piece once.

    No rule of such a tokenizer joins characters across a space that stands between two
    that are no white space, so texts are cut there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self._tokenizer = tokenizer = Tokenizer.from_file(path)
        self.largest = tokenizer.get_vocab_size(with_added_tokens=True) - 1
        self._spaced = np.zeros(self.largest + 1, bool)
        self._spaced[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token.startswith("\u0120")]] = True
        self.first, self.next = WordTable(self._alone), WordTable(self._behind_space)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.array([len(c) for c in coded], np.int64)
        return np.fromiter(chain.from_iterable(coded), np.int32, int(lengths.sum())), lengths

    def _behind_space(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with a space before it. Many words go as one string: the ids that
        begin with a space begin the words, if there are as many of them as words."""
        out = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            joined = " " + " ".join(some)
            if all(some) and len(_WHITE.findall(joined)) == len(some):
                ids, _ = self._alone([joined])
                heads = np.flatnonzero(self._spaced[ids])
                if len(heads) == len(some) and heads[0] == 0:
                    out.append((ids, np.diff(heads, append=len(ids))))
                    continue
            out.append(self._alone([" " + w for w in some]))
        return np.concatenate([i for i, _ in out]), np.concatenate([n for _, n in out])

    @staticmethod
    def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in a row, and how many each text has."""
        odd = pc.match_substring_regex(texts, _ODD)
        cut = pc.split_pattern(texts, " ")
        if pc.any(odd).as_py():
            by_rule = iter([_INNER.split(t) for t in texts.filter(odd).to_pylist()])
            parts = [next(by_rule) if o else c for o, c in zip(odd.to_pylist(), cut.to_pylist(), strict=True)]
            cut = pa.array(parts, cut.type)
        return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        pieces, counts = self.pieces(texts)
        ends = np.cumsum(counts)
        heads = ends - counts
        distinct = pieces.dictionary_encode()
        held, starts, lengths = self.next.places(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = distinct.indices.to_numpy()
        starts, lengths = starts[codes], lengths[codes]
        first, first_n = self.first.ids(pieces.take(pa.array(heads)).to_pylist())
        starts[heads], lengths[heads] = len(held) + np.cumsum(first_n) - first_n, first_n
        ids = np.concatenate([held, first])[spread(starts, lengths)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends], prepend=0)


_tokenizers: dict[str, ByteTokenizer] = {}


def _tokenizer(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def _store(folder: str):
    """The file system and the path in it of a folder that all executors share."""
    from pyarrow import fs

    if re.match(r"[a-z0-9]+:/", folder):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


class _Writer:
    """Fills sequences and writes a batch as soon as it is full."""

    def __init__(self, stream, width: pa.DataType):
        self.kind = width
        self.schema = pa.schema([("ids", pa.list_(width, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.out = pa.ipc.new_stream(stream, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.size += len(ids)
        if self.size >= LENGTH * ROWS:
            flat = np.concatenate(self.held)
            full = len(flat) // (LENGTH * ROWS) * (LENGTH * ROWS)
            for start in range(0, full, LENGTH * ROWS):
                self._batch(flat[start : start + LENGTH * ROWS], LENGTH * ROWS)
            self.held, self.size = [flat[full:]], len(flat) - full

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(a, LENGTH) for a in (pa.array(ids), mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            self._batch(np.pad(flat, (0, -len(flat) % LENGTH)), len(flat))
        self.out.close()


def write_sequences(docs: DataFrame, path: str, end_id: int, folder: str, parts: int | None = None) -> DataFrame:
    """Writes the files and returns their index: doc_id, part, file, begin, n_tokens; begin counts in the file.

    Documents(doc_id, text) come in ascending doc_id, rows without an id first, rows with
    one id by a hash of the text. Missing and empty texts have the end id only. Only files
    that the index names count: a repeated task writes a new one. No rows give no files.
    """
    wanted = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        kind = pa.uint16() if max(tokenizer.largest, end_id) < 1 << 16 else pa.uint32()
        part = TaskContext.get().partitionId()
        store, base = _store(folder)
        name, writer, stream, begin = f"part-{part:06d}-{uuid.uuid4().hex}.arrows", None, None, 0
        for batch in (piece for whole in batches for piece in chunks(whole)):
            if writer is None:
                store.create_dir(base, recursive=True)
                stream = store.open_output_stream(f"{base}/{name}")
                writer = _Writer(stream, kind)
            ids, lengths = tokenizer.encode(batch.column("text"))
            ends = np.cumsum(lengths)
            writer.add(np.insert(ids, ends, end_id))
            lengths = lengths + 1
            begins = begin + np.cumsum(lengths) - lengths
            begin += int(lengths.sum())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part)), pa.array([name] * n, pa.string()), pa.array(begins), pa.array(lengths)],
                ["doc_id", "part", "file", "begin", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            stream.close()

    rows = texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).repartitionByRange(wanted, "doc_id")
    ordered = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut_lineage(ordered.mapInArrow(run, "doc_id long, part long, file string, begin long, n_tokens long"))


def with_starts(index: DataFrame) -> DataFrame:
    """The index with `start`: the ids of all documents before, in all files."""
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # one row per file
    files = sums.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    return index.join(files, "part").withColumn("start", F.col("before") + F.col("begin")).drop("before")


def _open(store, path: str) -> list[np.ndarray]:
    """The ids of each batch of a file, as views of the memory map where the store is local."""
    from pyarrow import fs

    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    return [batch.column(0).flatten().to_numpy() for batch in pa.ipc.open_stream(source)]


def _slice(batches: list[np.ndarray], begin: int, n: int) -> np.ndarray:
    out = []
    while n:
        k, at = divmod(begin, LENGTH * ROWS)
        out.append(batches[k][at : at + n])
        begin, n = begin + len(out[-1]), n - len(out[-1])
    return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint16)])


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum ids_crc32 of every document, read from the files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        name, batches = None, []
        for frame in frames:
            sums = []
            for file, begin, n in zip(frame["file"], frame["begin"], frame["n_tokens"], strict=True):
                if file != name:
                    name, batches = file, _open(store, f"{base}/{file}")
                sums.append(zlib.crc32(_slice(batches, begin, n).astype("<u4").tobytes()))
            frame["ids_crc32"] = np.array(sums, np.int64)
            yield frame[["doc_id", "start", "n_tokens", "ids_crc32"]].astype({"doc_id": "Int64"})

    placed = with_starts(index).select("file", "begin", "doc_id", "start", "n_tokens")
    by_file = placed.repartition("file").sortWithinPartitions("file", "begin")
    return by_file.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes all documents in a new folder of the shared one and reads them back; see read_documents."""
    folder = f"{scratch_folder(docs.sparkSession)}/sequences-{uuid.uuid4().hex}"
    return read_documents(write_sequences(docs, path, end_id, folder), folder)
