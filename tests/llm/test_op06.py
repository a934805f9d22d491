"""Graph search against brute force."""

import numpy as np
import pytest

from shotspark.llm import op06_graph_ann as A
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, asked, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for q in asked:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        keep = ids != q
        order = np.lexsort((ids[keep], -np.round(s[keep], 9)))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores_on_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = by_query(A.op6_graph_ann(spark, SF_SMALL))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for q, v in got.items() for i, s in v)


@pytest.mark.parametrize("shard_rows,block", [(100, 7), (5000, 2048)])
def test_norms_ties_and_copies(spark, shard_rows, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 8)) * rng.uniform(0.2, 3, (400, 1))
    rows = [(k, [float(v) for v in np.float32(base[k])]) for k in range(400)]
    rows += [(1000 + k, rows[0][1]) for k in range(100)] + [(3, [2.0] * 8)]  # one vector very often
    rows = [r for r in rows if r[0] != 3] + [(3, [2.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    from pyspark.sql import functions as F
    got = by_query(A.nearest(df, F.col("vec_id") % 20 == 0, 10, shard_rows=shard_rows, block=block))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 10)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.95
    assert [i for i, _ in got[1000]] == [i for i, _ in want[1000]]


def test_many_shards_of_bounded_bytes(spark):
    """Recall over the whole table with several shards; copies in one answer once each."""
    from pyspark.sql import functions as F
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    dim = len(rows[0][1])
    index, shards = A.build_index(A.valid_vectors(table), 20, shard_bytes=dim * 8 * 40)
    assert shards >= len(rows) // 40 and index.count() <= shards
    got = by_query(A.nearest(table, F.col("vec_id") % 20 == 0, shard_bytes=dim * 8 * 40, block=3))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == len({i for i, _ in v}) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_index_is_sent_once(spark):
    """The plan of the search has no join; a shard's index meets queries in its own partition."""
    from pyspark.sql import functions as F
    out = A.nearest(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_doubles_and_clashing_names(spark):
    """Components beyond float precision keep their scores; input columns of the result's names do no harm."""
    from pyspark.sql import functions as F
    rows = [(k, [1.0 + k * 1e-12, 1.0], "x", 7, 0.5) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, query_id int, score double")
    got = by_query(A.nearest(df, F.col("vec_id") % 20 == 0, 5))
    assert [i for i, _ in got[0]] == [29, 28, 27, 26, 25] and [i for i, _ in got[20]] == [29, 28, 27, 26, 25]


def test_cases(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1),
                                (5, [None, 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [], 1), (None, [1.0, 1.0], 1),
                                (20, [-1.0, 0.0], 1), (40, [1.0, 2.0, 3.0], 1)], SCHEMA)
    got = by_query(A.nearest(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5), (20, -1.0)], 20: [(1, -0.5), (0, -1.0)]}
    assert A.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
