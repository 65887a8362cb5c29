"""Codecs against their libraries, and files read back."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agoralytics.llm import piece_codec, sequence_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = "ab  ▁éñ\n\t日本😀\x00.,'aAthe0١́ \x85\x1c"


@pytest.fixture
def strange(rng):
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 70))) for _ in range(400)]
    return [*texts, "", " ", "  ", "a", " a ", "a" * 3000, "don't we'll  I'd\n\n x", "<|endoftext|> <s></s>", "\n \n", "a \nb"]


def test_pieces_match_library(strange):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids, lengths = piece_codec.encode_batch(strange, PIECES)
    want = library.encode(strange)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert piece_codec._loaded(PIECES)[0].decode(ids, lengths).to_pylist() == [library.decode(x) for x in want]


def test_pieces_query(documents, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (documents, odd):
        got = piece_codec.digests(piece_codec.encode_and_decode(docs, PIECES)).collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r.text or "")
            sums = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids) if ids else "")]
            want.append((r.doc_id, len(ids), *sums))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert piece_codec.encode_and_decode(none, PIECES).count() == 0


def test_byte_pieces_match_library(strange):
    tokenizer = Tokenizer.from_file(BYTES)
    ids, lengths = sequence_files.ByteTokenizer(BYTES).encode(pa.array(strange, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in strange]


def check_files(docs, got):
    tokenizer, start, want = Tokenizer.from_file(BYTES), 0, []
    for r in docs:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_files(spark, documents, odd, none):
    check_files(documents.orderBy("doc_id").collect(), sequence_files.round_trip(documents, BYTES, 2).collect())
    ordered = odd.orderBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    check_files(ordered, sequence_files.round_trip(odd, BYTES, 2).collect())
    assert sequence_files.round_trip(none, BYTES, 2).count() == 0


def test_layout(spark, documents, tmp_path):
    index = sequence_files.write_sequences(documents, BYTES, 2, str(tmp_path), parts=3)
    for file in {r.file for r in index.select("file").collect()}:
        table = pa.ipc.open_stream(pa.memory_map(str(tmp_path / file))).read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), sequence_files.LENGTH)
        held = index.where(index.file == file).agg(F.sum("n_tokens")).head()[0]
        mask = table["mask"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        assert mask[:held].all() and not mask[held:].any() and len(mask) - held < sequence_files.LENGTH
