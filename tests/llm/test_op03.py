"""The Jaccard join against all pairs of shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from shotspark.llm import op03_jaccard_join as J
from shotspark.llm.wordsets import shingle_sets, word_hashes
from tests.conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWERED))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """id -> (n_shingles, component_id); ids are unique here."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    pairs = {(i, j) for g in at.values() if len(g) > 1 for i in g for j in g if i < j}
    for i, j in pairs:
        k = len(sets[i] & sets[j])
        if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows):
    out = J.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        p = rng.randrange(len(w))
        w[p] = f"new{rng.random()}"
    return w


def test_near_copies_of_every_size(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for n in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 22, 28, 40, 63, 100, 180, 400, 900]:
        for _ in range(3):
            base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            for k in (0, 0, 1, 1, 2, 3, max(1, n // 60), max(1, n // 45), max(1, n // 30)):
                v = edited(rng, base, k) if k else base
                cut = rng.choice([0, 0, 1, n // 20, n // 8])
                rows.append((i, (" " if k else "\n").join(v[cut:] + [f"t{rng.random()}"] * (k % 2))))
                i += 1
    check(spark, rows)


def test_chain_needs_more_than_the_star(spark):
    rng = random.Random(9)
    rows, w = [], [f"c{k}" for k in range(300)]
    for i in range(60):  # each document links with the next few, not with the first
        rows.append((i, " ".join(w)))
        w = w[8:] + [f"c{rng.random()}" for _ in range(8)]
    rng.shuffle(rows)
    check(spark, rows)


def test_shared_passage_and_hot_group(spark):
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(55)]
    base = [f"h{k}" for k in range(200)]
    rows = [(i, " ".join([f"u{rng.random()}" for _ in range(rng.randrange(5, 60))] + passage)) for i in range(120)]
    rows += [(500 + i, " ".join(edited(rng, base, 1))) for i in range(150)]
    rows += [(900 + i, " ".join(base)) for i in range(100)]
    check(spark, rows)


def test_cases(spark):
    rows = [(5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "ONE"), (10, "one two three four"), (11, "one  two three FOUR"),
            (12, "one two three four five"), (13, "É a"), (14, "é a"), (15, "a " * 3000), (16, "a " * 4000), (17, "x" * 3_000_000)]
    check(spark, rows)
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(1, t, "p"), (1, t, "q"), (None, t, "r"), (None, "z z", "s"), (4, None, "t"), (4, None, "t")],
                               "doc_id long, text string, _fp string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(df).collect())
    assert got == sorted([("1", 4, "1"), ("1", 4, "1"), ("None", 4, "1"), ("None", 1, "None"), ("4", 0, "4"), ("4", 0, "4")])
    kept = J.one_per_component(df)
    assert kept.columns == ["doc_id", "text", "_fp"]
    assert len([r for r in kept.collect() if r.text == t]) <= 1 and kept.where("text is null").count() == 2


@pytest.mark.parametrize("budget", [64, 1 << 22])
def test_sets_do_not_depend_on_chunks(budget):
    rng = random.Random(1)
    texts = [None, "", "Ab  c", "\x0b"] + [" ".join(rng.choice(["A", "b", "cé", "ddd\n"]) for _ in range(rng.randrange(40)))
                                           for _ in range(200)]
    got = list(shingle_sets(pa.array(texts), budget))
    assert [len(h) for h in got] == [len(shingles(t)) for t in texts]
    # Equal sets have equal hashes, different sets differ.
    by = {}
    for t, h in zip(texts, got):
        by.setdefault(frozenset(shingles(t)), set()).add(h.tobytes())
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


def test_word_hashes_across_windows():
    word = b"w" * 700_000
    data = np.frombuffer(b" ".join([word, b"a", word, b"a", b"b" * 2_500_000, b"a"]), np.uint8)
    h, first = word_hashes(data, np.array([0, len(data)]))
    assert len(h) == 6 and h[0] == h[2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3 and list(first) == [0, 6]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for n in (3, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n, dtype=np.uint64)]))
        assert J.sketch_distance(J.sketch(a), J.sketch(b)) <= len(np.setxor1d(a, b))


def test_query_on_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op3_jaccard_join(spark, SF_SMALL).collect()}
    assert got == brute(docs)


def test_open_blocks_in_parts_and_groups(spark, monkeypatch):
    """Near copies around the threshold, so that blocks stay open: many parts, and
    blocks that are compared by pairs of groups."""
    rng = random.Random(8)
    base, rows = [f"w{k}" for k in range(200)], []
    for i in range(70):
        rows.append((i, " ".join(edited(rng, base, rng.choice([3, 4, 5])))))
    for blocks, group in ((40, 4096), (100_000, 6)):
        monkeypatch.setattr(J, "PART_BLOCKS", blocks)
        monkeypatch.setattr(J, "GROUP", group)
        check(spark, rows)
