"""Exact dedup against a dictionary of whole texts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.op08_exact_dedup import exact_dedup, op8_exact_dedup
from tests.conftest import SF_SMALL

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWERED), []).append(i)
    key = lambda i: (i is not None, i if i is not None else 0)  # noqa: E731  a null id is smaller than any other
    return {t: (max(g, key=key), len(g)) for t, g in groups.items()}


def check(spark, rows, **how):
    out = exact_dedup(spark.createDataFrame(rows, SCHEMA), **how).collect()
    want = expected(rows)
    assert sorted((str(r.doc_id), r.text or "") for r in out) == sorted((str(i), t or "") for i, t in rows)
    kept = {}
    for r in out:
        t = (r.text or "").translate(LOWERED)
        assert (r.keep_id, r.group_size) == want[t], r
        kept.setdefault(t, []).append(r.kept)
    assert all(sum(k) == 1 for k in kept.values())
    return out


def test_cases(spark):
    long = "x" * 70_000
    rows = [(1, "Abc"), (2, "aBC"), (3, "abcd"), (4, None), (5, ""), (6, "ÀB"), (7, "àb"), (8, "Àb"), (9, long + "A"),
            (10, long + "a"), (11, long + "b"), (12, " "), (None, "abc"), (None, "only null ids"),
            (None, "only null ids"), (13, "same row"), (13, "same row"), (13, "another"), (14, long[:64]), (15, long[:64]),
            (16, long[:65]), (17, "é" * 40), (18, "é" * 40), (19, "é" * 39 + "è")]
    check(spark, rows)
    check(spark, rows, first=2, growth=2, longest=4096)


def test_hot_group(spark):
    check(spark, [(k, "hot text " * 20) for k in range(400)] + [(1000 + k, f"text {k % 150}") for k in range(400)], first=4)


def test_empty_table(spark):
    out = exact_dedup(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "text", "keep_id", "group_size", "kept"] and out.count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "x", 5, "r", "d"), (2, "A", "y", 6, None, "e")],
                               "doc_id long, text string, keep_id string, _n int, _rid string, _digit string")
    out = exact_dedup(df)
    assert out.columns == ["doc_id", "text", "_n", "_rid", "_digit", "keep_id", "group_size", "kept"]
    assert [(r.doc_id, r._n, r._rid, r.keep_id, r.kept) for r in out.orderBy("doc_id").collect()] == [
        (1, 5, "r", 2, False), (2, 6, None, 2, True)]


def test_query_on_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = op8_exact_dedup(spark, SF_SMALL)
    assert got.count() == docs.count()
    joined = got.join(docs, "doc_id").select("text", "keep_id", "group_size").collect()
    assert all(want[r.text.translate(LOWERED)] == (r.keep_id, r.group_size) for r in joined)


@pytest.mark.parametrize("n", [63, 64, 65, 1088, 1089])
def test_texts_that_end_at_a_digit(spark, n):
    a = "q" * n
    check(spark, [(1, a), (2, a), (3, a + "z"), (4, a[:-1] + "z"), (5, a.upper())])
    assert F is not None
