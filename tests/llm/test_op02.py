"""Mixing: targets against plain water filling, and the properties of a draw."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from shotspark.llm import op02_mixing as M
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, cap=3.0):
    """Shares by weight; whoever is above its cap is set to it, the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    out, left, room = {}, set(names), float(sum(sizes.values()))
    while left:
        level = room / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in left}
        for s in full:
            out[s] = cap * sizes[s]
            room -= out[s]
        left -= full
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, out, biggest=True):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = plain_targets(sizes)
    assert len(out) == len(rows)
    largest = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, (s, taken[s], want[s])


def make(n, seed):
    rng = np.random.default_rng(seed)
    src = ["big"] * 6 + ["b", "c", "d", None, "é", "Z"]
    return [(k, " ".join(["w"] * int(rng.integers(0, 60))), src[int(rng.integers(len(src)))]) for k in range(n)]


def test_draw(spark):
    rows = make(900, 1) + [(5000 + k, "w w", "tiny") for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.mix(df, leaf_rows=50, fan=3)
    assert out.columns == ["doc_id", "text", "source", *M.OWN]
    rows_out = out.collect()
    check(rows, rows_out)
    again = M.mix(df.repartition(7, F.rand(3)), leaf_rows=50, fan=3).collect()
    assert sorted((r.doc_id, r.taken) for r in rows_out) == sorted((r.doc_id, r.taken) for r in again)
    other = M.mix(df, leaf_rows=50, fan=3, seed=2).collect()
    assert sorted((r.doc_id, r.taken) for r in rows_out) != sorted((r.doc_id, r.taken) for r in other)


def test_each_document_gets_its_share_on_average(spark):
    """Over seeds, the mean of copies is target / source size."""
    rows = [(k, " ".join(["w"] * (k % 5 + 1)), "a" if k < 30 else "b") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    total = defaultdict(list)
    for seed in range(12):
        for r in M.mix(df, seed=seed).collect():
            total[r.source].append(r.copies)
            ratio = r.target / r.source_size
            assert r.copies in (int(ratio), int(ratio) + 1)
    size = {s: sum(words(t) for _, t, x in rows if x == s) for s in "ab"}
    for s, t in plain_targets(size).items():
        assert abs(np.mean(total[s]) - t / size[s]) < 0.1


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "x y z", "b"), (None, "x y z", "b"), (4, "same", "b"),
            (4, "same", "b"), (4, "same", "b"), (5, "w " * 50_000, "c")]
    check(rows, M.mix(spark.createDataFrame(rows, SCHEMA)).collect())
    empty = M.mix(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    zero = M.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in zero] == [(0, 0.0, 0)] * 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 7, "k")], "doc_id long, text string, source string, size int, _src string")
    out = M.mix(df)
    assert out.columns == ["doc_id", "text", "source", "_src", *M.OWN] and out.first().taken == 2


def test_query_on_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    out = M.op2_mixing(spark, SF_SMALL)
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    check([tuple(r) for r in docs], out.collect())


def test_rows_of_one_unit_share_its_copies(spark):
    """A unit of a third of the rows, over many partitions: copies differ by one at most and add up to the unit's."""
    n = 3000
    rows = [(7, "one two three", "a", k) if k % 3 == 0 else (k, " ".join(["w"] * (k % 7)), "b" if k % 2 else "a", k)
            for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA + ", extra int").repartition(11)
    out = M.mix(df, leaf_rows=100).collect()
    assert sorted(r.extra for r in out) == list(range(n))
    check([r[:3] for r in rows], out)
    unit = [r.copies for r in out if r.extra % 3 == 0]
    assert max(unit) - min(unit) <= 1
    hot = next(r for r in out if r.extra == 0)
    assert abs(sum(unit) - len(unit) * hot.target / hot.source_size) < 1 + 1e-6
