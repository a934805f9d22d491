"""Positions, running sums and exact order statistics of groups of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotspark.operators import deliverables as dv
from shotspark.operators import dispersion as ds
from shotspark.operators import ordering as od
from shotspark.operators import shapes as sh


def frame(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        group = None if k % 11 == 0 else "hot" if k % 3 else f"g{k % 9}"
        value = None if k % 13 == 0 else float(rng.integers(0, 40)) / 4 if k % 2 else float(rng.normal())
        rows.append((k, group, value))
    return spark.createDataFrame(rows, "k long, g string, v double").repartition(9), rows


def test_positions_are_contiguous(spark):
    df, rows = frame(spark)
    out = od.positions(df, [F.desc("v"), F.asc("k")], within=("g",)).collect()
    for g in {r[1] for r in rows}:
        own = sorted((r for r in out if r.g == g), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        want = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [r.k for r in own] == [r[0] for r in want]
    alone = od.positions(df, [F.asc("k")], name="n", start=1)
    assert sorted((r.k, r.n) for r in alone.collect()) == [(k, k + 1) for k in range(len(rows))]
    assert alone.columns == ["k", "g", "v", "n"]
    assert od.positions(df.limit(0), [F.asc("k")]).count() == 0


def test_no_window_gathers_a_group(spark):
    df, _ = frame(spark, 200)
    text = od.positions(df, [F.asc("k")])._jdf.queryExecution().toString()
    scan = text.split("== Physical Plan ==")[1]
    # The one window without a key runs over the counts of the partitions.
    assert scan.count("Window") >= 1 and all("_sum" in line for line in scan.splitlines() if "Window" in line and "[" in line)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_percentiles_are_those_of_the_aggregate(spark, by):
    df, _ = frame(spark)
    at = [0.0, 0.1, 0.5, 0.9, 0.975, 1.0]
    got = {tuple(r)[:-1]: r._ps for r in od.percentiles(df, "v", at, by).collect()}
    want = {tuple(r)[:-1]: r.p for r in df.groupBy(*by).agg(F.percentile("v", at).alias("p")).collect()}
    assert got == want


def test_operators_with_ranks_equal_those_with_maps(spark):
    df, _ = frame(spark)
    shots = df.select(F.col("g").alias("club_type"), (F.col("k") % 2).alias("user_id"), F.col("v").alias("carry_distance"))
    none = spark.createDataFrame([("empty", 0, None)], shots.schema)
    shots = shots.unionByName(none)
    for by in ((), ("user_id",)):
        key = lambda r: repr(tuple(r)[:len(by) + 1])
        plain, ranked = (sorted(dv.carry_averages(shots, by, ranked=x).collect(), key=key) for x in (False, True))
        assert [r[:len(by) + 2] + r[-3:] for r in plain] == [r[:len(by) + 2] + r[-3:] for r in ranked]
        band, ranked = (sorted(ds.corridor(shots, "carry_distance", by=by, ranked=x).collect()) for x in (False, True))
        assert [r[:-1] for r in band] == [r[:-1] for r in ranked]
    mode, counted = (sorted(sh.mode_of(shots, "carry_distance", ("club_type",), counted=x).collect(), key=repr) for x in (False, True))
    assert mode == counted and any(r.mode_carry_distance is None for r in counted)
    empty = ds.corridor(shots.where("club_type = 'empty'"), "carry_distance", ranked=True).collect()
    assert [tuple(r) for r in empty] == [(None, None, None, None)]
