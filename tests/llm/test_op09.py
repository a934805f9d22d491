"""Byte-level BPE against the tiktoken library, text by text."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T

from shotspark.llm import op09_byte_bpe as B
from tests.conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
PIECES = [" ", "  ", "\n", " \n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "a", "Bc", "'s",
          "'ll", "12", "²", "½", "é", "é", "ß", "漢", "😀", ".", "!?", "<|endoftext|>", "\x00", "\x01"]


@pytest.fixture(scope="module")
def tokenizer():
    return B.public_tokenizer()


@pytest.fixture(scope="module")
def encoding(tokenizer):
    return tiktoken.Encoding("test", pat_str=tokenizer[1], mergeable_ranks=tokenizer[0], special_tokens={})


def texts(n=3000):
    rng = random.Random(1)
    return ([None, "", " ", "  ", "x", "x" * 50_000, "word " * 9000]
            + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(n)]
            + [" ".join(rng.choice(["the", "foo,", "bar.\nBaz", "12", "it's"]) for _ in range(rng.randrange(1, 30))) for _ in range(100)])


def test_words_encode_as_in_the_text(encoding):
    some = texts()
    vocabulary, places, first = B._words_of(pa.array(some))
    words = vocabulary.to_pylist()
    for k, t in enumerate(some):
        own = [words[i] for i in places[first[k]:first[k + 1]]]
        assert "".join(own) == (t or "")
        assert [i for w in own for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(t or "")


@pytest.mark.parametrize("chars", [50, 16_000_000])
def test_round_trip(spark, tokenizer, encoding, chars):
    some = texts(60 if chars == 50 else 600)
    rows = [(k // 2 if k % 7 else None, t) for k, t in enumerate(some)]
    out = B.encode_decode(spark.createDataFrame(rows, SCHEMA), tokenizer, block_chars=chars).collect()
    want = [(i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows]
    got = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_other_columns(spark, tokenizer):
    df = spark.createDataFrame([], "doc_id long, text string, ids string, block int")
    out = B.encode_decode(df, tokenizer)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() == 0
    named = spark.createDataFrame([("k", "a b", 3)], "name string, body string, part int")
    assert B.encode_decode(named, tokenizer, text="body", id="name").first().decoded == b"a b"


def test_query_on_table(spark, encoding):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = B.op9_byte_bpe(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(encoding.encode_ordinary(docs[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())


def test_word_partitions_follow_the_input(spark, tokenizer, encoding, monkeypatch):
    seen, real = [], B._to_blocks
    monkeypatch.setattr(B, "_to_blocks", lambda parts, *a: seen.append(parts) or real(parts, *a))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = list(enumerate(["the cat sat on a mat, ", "12 dogs"] * 200))
    df = spark.createDataFrame(rows, SCHEMA)
    total = sum(len(t) for _, t in rows)
    out = B.encode_decode(df, tokenizer, part_bytes=total // (3 * shuffled)).collect()
    B.encode_decode(df, tokenizer)
    assert seen[0] >= 3 * shuffled and seen[1] == shuffled
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == {i: encoding.encode_ordinary(t) for i, t in rows}
