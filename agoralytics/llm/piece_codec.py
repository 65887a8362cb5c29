"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

Words of a batch are flat numpy arrays of symbols. A round looks up the rank of each
neighbouring pair, takes the smallest rank per word, merges its leftmost occurrences in
all words at once and closes the gaps; words without a pair left are done.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.common import SMALL, chunks, texts_of
from agoralytics.llm.word_table import WordTable, spread

#: Fixed value: the sign that stands for a space in a vocabulary.
MARK = "▁"
_WORD = re.compile(r" *[^ ]+| +")
_NONE = np.iinfo(np.int32).max
#: Characters of the words that a worker remembers with their ids: about 100 MB.
HELD = 4_000_000


class PieceModel:
    """Vocabulary and pair ranks of a BPE model with byte fallback and a leading space."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        crossing = [pieces[i] for i in plain if re.search(f"[^{MARK}]{MARK}", pieces[i])]
        if crossing:
            raise ValueError(f"pieces with a space after a letter need whole texts: {crossing[:3]}")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # Symbols: piece ids, then characters that are only parts of pieces, then other characters.
        symbol = {pieces[i]: i for i in plain}
        for c in sorted({c for i in plain for c in pieces[i]} - symbol.keys()):
            symbol[c] = size + len(symbol)
        self.size, self.other = size, 2 * size + len(symbol)
        self.characters = {c: s for c, s in symbol.items() if len(c) == 1}
        self.extra = {s: c for c, s in symbol.items() if s >= size}
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        pairs = sorted(
            (symbol[p[:k]] << 32 | symbol[p[k:]], order[model.get_score(i)], i)
            for i in plain
            for p in [pieces[i]]
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        )
        self.keys = np.array([x[0] for x in pairs] or [-1], np.int64)
        self._index()
        self.ranks = np.array([x[1] for x in pairs] or [_NONE], np.int32)
        self.merged = np.array([x[2] for x in pairs] or [0], np.int32)
        # A piece is settled if no pair with it ranks at or before itself: then all its occurrences may merge at once.
        rank_of = np.full(self.other + 1, -1, np.int64)
        rank_of[self.merged] = self.ranks
        first, second = rank_of[self.keys >> 32], rank_of[self.keys & 0xFFFFFFFF]
        unsettled = {*(self.keys[self.ranks <= first] >> 32).tolist(), *(self.keys[self.ranks <= second] & 0xFFFFFFFF).tolist()}
        self.settled = ~np.isin(self.merged, list(unsettled))
        text = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_length = np.array([len(t) for t in text], np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length
        self.is_byte = np.isin(np.arange(size), self.byte_ids)

    def _index(self) -> None:
        """A table from hashed pairs to places in `keys`, with the next free place where two meet."""
        self.shift = np.uint64(64 - max(4, (8 * len(self.keys)).bit_length()))
        self.slots = np.full((1 << (64 - int(self.shift))) + 64, -1, np.int32)
        left, slot, self.probes = np.arange(len(self.keys)), self._slot(self.keys), 0
        while len(left):
            free = self.slots[slot + self.probes] < 0
            self.slots[(slot + self.probes)[free]] = left[free]
            lost = self.slots[slot + self.probes] != left
            left, slot, self.probes = left[lost], slot[lost], self.probes + 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs in `keys`, and which of them are there."""
        slot = self._slot(pairs)
        at = self.slots[slot]
        known = (self.keys[at] == pairs) & (at >= 0)
        open_ = np.flatnonzero(~known & (at >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            found = self.slots[slot[open_] + probe]
            right = (self.keys[found] == pairs[open_]) & (found >= 0)
            at[open_[right]], known[open_[right]] = found[right], True
            open_ = open_[~right & (found >= 0)]
        return at, known

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after the last round, and the word of each; `word` is sorted."""
        done = []
        while len(symbols):
            pair = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
            at, known = self._find(pair)
            rank = np.append(np.where(known & (word[:-1] == word[1:]), self.ranks[at], _NONE), _NONE)
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.append(begins, len(word)))
            over = np.repeat(least == _NONE, lengths)
            done.append((symbols[over], word[over]))
            chosen = (rank == np.repeat(least, lengths)) & ~over
            # Words in which a merge may bring up an earlier pair take their first one only.
            careful = chosen[:-1] & ~self.settled[at]
            if careful.any():
                own = np.repeat(np.arange(len(begins)), lengths)
                alone = np.zeros(len(begins), bool)
                alone[own[:-1][careful]] = True
                count = np.cumsum(chosen)
                before = (count - chosen)[begins]
                chosen &= ~alone[own] | (count - before[own] == 1)
            place = np.flatnonzero(chosen)
            run = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            offset = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
            place = place[offset % 2 == 0]
            symbols = symbols.copy()
            symbols[place] = self.merged[at[place]]
            keep = ~over
            keep[place + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (a leading space and all other spaces as they are), and how many each has."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        points = np.frombuffer((" " + " ".join(words)).encode("utf-32-le"), np.uint32) if words else np.zeros(0, np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        known = np.array([self.characters.get(MARK if c == 32 else chr(c), self.other + int(c)) for c in distinct], np.int64)
        symbols, word = self.merge(known[inverse], np.repeat(np.arange(len(words)), lengths))
        # What is not a piece is written as bytes.
        odd = np.flatnonzero(symbols >= self.size)
        size = np.ones(len(symbols), np.int64)
        coded = [self.byte_ids[list((self.extra.get(int(s)) or chr(int(s) - self.other)).encode())] for s in symbols[odd]]
        size[odd] = [len(c) for c in coded]
        ids = np.repeat(symbols, size).astype(np.int32)
        if len(odd):
            ids[spread((np.cumsum(size) - size)[odd], size[odd])] = np.concatenate(coded)
        return ids, np.bincount(word, weights=size, minlength=len(words)).astype(np.int64)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Texts of lists of ids: pieces joined, spaces for marks, less the leading one; bytes that are no UTF-8 become U+FFFD."""
        size = self.text_length[ids]
        data = self.text[spread(self.text_start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])]
        lead = ends[:-1][(np.diff(ends) > 0)]
        lead = lead[data[lead] == 32]
        if len(lead):
            cut = np.zeros(len(data), bool)
            cut[lead] = True
            ends = ends - np.concatenate([[0], np.cumsum(cut)])[ends]
            data = data[~cut]
        if self.is_byte[ids].any():
            whole = data.tobytes()
            return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def split_words(text: str) -> list[str]:
    """Words of a text: each stands for one space and itself; more spaces stay in front."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _WORD.findall(" " + text)]
    return text.split(" ")


_models: dict[str, tuple[PieceModel, WordTable]] = {}


def _loaded(path: str) -> tuple[PieceModel, WordTable]:
    if path not in _models:
        model = PieceModel(path)
        _models[path] = model, WordTable(model.encode_words, HELD)
    return _models[path]


def encode_batch(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and how many each text has."""
    words = [split_words(t) for t in texts]
    ids, lengths = _loaded(path)[1].ids(list(chain.from_iterable(words)))
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, words)])]
    return ids, np.diff(ends)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, for every row of documents(doc_id, text).

    Ids are those of the sentencepiece library, without begin or end ids. Missing and
    empty texts have no ids and decode to an empty text. Rows may repeat or have no id;
    other columns don't matter; no rows give no rows. `path` is that of the model file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = _loaded(path)
        for batch in (part for whole in batches for part in chunks(whole, most=SMALL)):
            ids, lengths = encode_batch(batch.column("text").to_pylist(), path)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, model.decode(ids, lengths)], ["doc_id", "ids", "decoded"])
        words.forget()  # the worker may go on with another operator

    return texts_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the rows of encode_and_decode."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
