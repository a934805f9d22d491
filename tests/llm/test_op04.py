"""Binary records: library ids, file round trip, index, damage."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shotspark.llm import op04_records as R
from tests.conftest import SF_SMALL
from tests.llm.test_op09 import texts

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def tokenizer(spec):
    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_encode_as_in_the_text(spec, tokenizer):
    some = texts(2000)
    got = R.encode_texts(spec, pa.array(some, pa.large_string()))
    assert [list(g) + [1] for g in got] == [ids_of(tokenizer, t) for t in some]


def test_round_trip_order_and_index(spark, spec, tokenizer, tmpdir_path):
    some = texts(300)
    rows = [(len(some) - k if k % 9 else None, t) for k, t in enumerate(some)] + [(5, "same row"), (5, "same row")]
    path = R.write_records(spark.createDataFrame(rows, SCHEMA), spec, tmpdir_path, shard_bytes=20_000)
    back = R.read_all(spark, path).collect()
    key = lambda x: (x[0] is not None, x)
    assert sorted(((r.id, tuple(r.ids)) for r in back), key=repr) == sorted(
        ((i, tuple(ids_of(tokenizer, t))) for i, t in rows), key=repr)
    index = sorted(R.index(spark, path).collect(), key=lambda r: (r.shard, r.record))
    assert len({r.shard for r in index}) > 1
    assert [key((r.id or 0,))[1][0] for r in index] == sorted(r.id or 0 for r in index)
    assert [r.start for r in index] == np.cumsum([0] + [r.n_tokens for r in index])[:-1].tolist()
    wanted = spark.createDataFrame([(r.shard, r.record) for r in index[::17]], "shard string, record long")
    whole = {(r.shard, r.record): (r.id, r.ids) for r in back}
    some_back = R.read_at(spark, path, wanted).collect()
    assert {(r.shard, r.record): (r.id, r.ids) for r in some_back} == {
        (r.shard, r.record): whole[r.shard, r.record] for r in index[::17]}


def test_empty_table(spark, spec, tmpdir_path):
    path = R.write_records(spark.createDataFrame([], SCHEMA), spec, tmpdir_path)
    assert R.index(spark, path).count() == 0 and R.read_all(spark, path).count() == 0


def test_damage_is_found():
    good = R.frame(R.payload_of(7, np.array([1, 2, 70_000], np.uint32)))
    payload, end = R.record_at(good, 0)
    assert end == len(good) and R.parse_payload(payload)[0] == 7 and R.parse_payload(payload)[1].tolist() == [1, 2, 70_000]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 0x10
        with pytest.raises(Exception):
            R.record_at(bytes(bad), 0)


def test_query_on_table(spark, tokenizer):
    docs = sorted(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for r in docs:
        ids = ids_of(tokenizer, r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = R.op4_records(spark, SF_SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_special_tokens_in_texts(spark, spec, tmpdir_path):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = ["<|endoftext|>", "a <|startoftext|> b", "ab<|endoftext|>cd<|startoftext|><|endoftext|>.", "<|endoftext|", "x \x01 <|endoftext|>",
            "<|ENDOFTEXT|> \n<|startoftext|>\t12", "plain words"] + [f"word{k}<|endoftext|> word{k}" for k in range(1500)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in some]
    assert 49407 in want[0] and 49406 in want[1]
    got = R.encode_texts(spec, pa.array(some, pa.large_string()), specials=True)
    assert [list(g) for g in got] == want
    spark.createDataFrame(list(enumerate(some[:7])), SCHEMA).write.parquet(f"{tmpdir_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in R.op4_records(spark, tmpdir_path).collect()}
    assert got == {k: (len(w) + 1, zlib.crc32(np.array([*w, 1], "<u4").tobytes())) for k, w in enumerate(want[:7])}
