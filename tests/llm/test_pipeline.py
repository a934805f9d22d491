"""The pipeline against brute-force versions of its stages."""

import hashlib
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline as C
from shotspark.llm.common import documents
from shotspark.llm.op09_byte_bpe import public_tokenizer
from tests.conftest import SF_SMALL
from tests.llm import test_op02, test_op03
from tests.llm.test_op08 import LOWERED


def test_stages_one_by_one(spark, tmpdir_path):
    docs = documents(spark, SF_SMALL)
    table, rows = {}, docs.collect()
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(f"{tmpdir_path}/{k}")
        docs = spark.read.parquet(f"{tmpdir_path}/{k}")
        table[name] = docs.collect()
        if k < 4:
            assert docs.columns == list(documents(spark, SF_SMALL).columns)
    # 1: clean documents stay, rows are unchanged.
    known = table["language ID"]
    assert set(known) <= set(rows) and len(known) >= 0.98 * len(rows)
    # 2: of equal texts the largest id.
    last = {}
    for r in known:
        t = r.text.translate(LOWERED)
        last[t] = max(last.get(t, -1), r.doc_id)
    single = table["exact dedup"]
    assert sorted(r.doc_id for r in single) == sorted(last.values())
    # 3: of each component the smallest id.
    comp = test_op03.brute([(r.doc_id, r.text) for r in single])
    near = table["n-gram Jaccard join"]
    assert sorted(r.doc_id for r in near) == sorted({c for _, c in comp.values()})
    # 4: targets of the sources, whole copies.
    copies = Counter(r.doc_id for r in table["mixing sources"])
    want = test_op02.plain_targets({s: sum(test_op02.words(r.text) for r in near if r.source == s) for s in {r.source for r in near}})
    for s, t in want.items():
        own = [r for r in near if r.source == s]
        taken = sum(copies[r.doc_id] * test_op02.words(r.text) for r in own)
        assert abs(taken - t) <= max(test_op02.words(r.text) for r in own)
    # 5: the library's ids.
    ranks, pattern = public_tokenizer()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in near}
    ids = {i: np.array(enc.encode_ordinary(text[i]), "<u4") for i in copies}
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in table["byte-level BPE"]) == Counter(
        {(i, len(ids[i]), hashlib.sha256(ids[i].tobytes()).hexdigest()): n for i, n in copies.items()})


def test_blocks_of_the_last_stage_are_small(spark, monkeypatch):
    asked, whole = [], C.encode_decode
    monkeypatch.setattr(C, "encode_decode", lambda *a, **k: asked.append(k.get("block_chars", 16_000_000)) or whole(*a, **k))
    docs = spark.createDataFrame([(1, "a b c"), (2, "c b"), (3, None), (1, "a b c")], "doc_id long, text string")
    few = sorted(map(tuple, C.encode(spark, docs, "").collect()), key=str)
    assert asked == [4_000_000]  # Python's memory in a worker follows it
    assert few == sorted(map(tuple, C.digests(whole(docs, public_tokenizer())).collect()), key=str) and len(few) == 4


def test_null_rows_and_extra_columns(spark):
    some = documents(spark, SF_SMALL).limit(30)
    df = some.selectExpr("*", "1 as score", "'x' as kept", "2 as copies").unionByName(spark.createDataFrame(
        [(None, None, None, None, None, 1, "x", 2)], some.selectExpr("*", "1 as score", "'x' as kept", "2 as copies").schema))
    for name, stage in C.STAGES[:4]:
        out = stage(spark, df, SF_SMALL)
        assert out.columns == df.columns, name
        rows = out.collect()
        assert rows and all(r.kept == "x" and r.copies == 2 and r.score == 1 for r in rows)
