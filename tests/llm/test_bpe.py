import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from edge import clashing, empty
from tokenizers import Tokenizer

from corpusloom.llm import bpe

PIECES = ["a", "b ", "  ", "\n", "é", "<|endoftext|>", "<|endof", "日本", " ", "'s", "12", "..", "\t", "🙂", "Ж", "ll", "\x85", " ", " x", " é", "don't", "\r\n"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.mark.parametrize("chunk_bytes", [8, 64, 1024])
def test_ids_equal_the_librarys(whole, chunk_bytes):
    rnd = random.Random(chunk_bytes)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(300))) for _ in range(500)]
    texts += [t + texts[0] for t in texts[:50]] + ["", "x" * 5000, " " * 5000]
    vocabulary = bpe.load(public_tokenizers.path(bpe.VOCABULARY))
    encoder, decoder = bpe.Encoder(vocabulary, chunk_bytes), bpe.Decoder(vocabulary)
    ids = encoder.encode(pa.array(texts + [None])).to_pylist()
    assert ids == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)] + [[]]
    assert decoder.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == texts + [""]
    assert encoder.reused > 0


def test_a_full_table_changes_nothing(whole):
    vocabulary = bpe.load(public_tokenizers.path(bpe.VOCABULARY))
    texts = [f"some words {i} and then more of the same words " * 40 for i in range(20)]
    small = bpe.Encoder(vocabulary, 32, cache_chunks=3)
    assert small.encode(pa.array(texts)).to_pylist() == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_that_are_no_text_decode_like_the_library(whole):
    decoder = bpe.Decoder(bpe.load(public_tokenizers.path(bpe.VOCABULARY)))
    rnd = random.Random(2)
    ids = [[rnd.randrange(256) for _ in range(20)] for _ in range(200)]
    assert decoder.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [whole.decode(i, skip_special_tokens=False) for i in ids]


def test_digests(spark, sf, whole):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = clashing(spark).select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    expected = []
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id or -1, len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()]
    assert sorted(got) == sorted(expected)
    assert bpe.digests(clashing(spark)).count() == clashing(spark).count() and bpe.digests(empty(spark)).count() == 0
