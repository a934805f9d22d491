"""Centroids: plain k-means on integers, table distances, cases."""

import hashlib
import math

import numpy as np
import pytest

from shotspark.llm import op12_centroids as C


def brute(rows, k=C.K, rounds=C.ROUNDS):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(r[1]) for r in first]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, v in kept:
            own[near(v)[0]].append(v)
        cents = [[sum(col) // len(o) for col in zip(*o)] if o else c for o, c in zip(own, cents)]
    out = [(i, *near(v)) for i, v in kept]
    sums = {c: sum(d for _, b, d in out if b == c) for c in range(len(cents))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, sums[c], sum(sums.values()), text[c]) for i, c, d in out), key=repr)


def made(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = C.op12_centroids(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (7, 64))
    return [(k, [float(x) for x in (middle[k % 7] + rng.normal(0, 0.4, 64)).astype(np.float32)]) for k in range(n)]


def test_against_brute_force(spark, tmp_path):
    rows = vectors(180)
    rows += [(500 + k, rows[0][1]) for k in range(60)] + [rows[5]] * 3  # one vector many times, repeated rows
    rows += [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64),
             (904, [float("inf")] + [0.0] * 63), (905, []), (None, rows[1][1]), (906, [0.0] * 64), (907, [-0.001] * 64)]
    assert made(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], vectors(1), vectors(5), [(k, [0.5] * 64) for k in range(40)],
                                  [(k, [float(k % 2) * 1e6] * 64) for k in range(20)]])
def test_cases(spark, tmp_path, rows):
    assert made(spark, tmp_path, rows) == brute(rows)


def test_a_component_out_of_range_raises(spark, tmp_path):
    with pytest.raises(Exception, match="beyond"):
        made(spark, tmp_path, [(1, [1e30] + [0.0] * 63)])


def test_table_distances():
    rng = np.random.default_rng(0)
    for low, high in ((-40, 40), (-(1 << 27), 1 << 27)):
        v, c = rng.integers(low, high, (500, 5)), rng.integers(low, high, (9, 5))
        want = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (C.distances(v, c) == want).all()
