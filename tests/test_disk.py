"""Disk that the shot queries take beside their results."""

import datetime as dt
import glob
import gzip
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from shotspark import session
from shotspark.operators import ordering as od
from shotspark.schema import METRICS
from shotspark.sources import csv_sessions as csvs
from shotspark.sources import sinks
from shotspark.sources import tables as tb
from shotspark.sources import testdata
from shotspark.sources.landing import Landing

HEAD = "Player,Club Type,Carry Distance\n"


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


def shots(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, user_id string, club_type string, carry_distance double")
    return tb.with_shot_ids(df.select("*", *[F.lit(None).cast("double").alias(m) for m in METRICS if m != "carry_distance"]))


def shuffle_blocks(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {x for x in blocks.split() if x.startswith("shuffle_")}


def test_shuffles_go_with_their_write(spark, tmpdir_path):
    before, was = shuffle_blocks(spark), spark.conf.get(session._CLEANUP)
    df = spark.range(1000).repartition(4, "id")
    with session.shuffles_end_with_jobs(spark):
        df.write.parquet(f"{tmpdir_path}/a")
    for _ in range(50):
        if not (left := shuffle_blocks(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(session._CLEANUP) == was
    with pytest.raises(ValueError), session.shuffles_end_with_jobs(spark):
        raise ValueError
    assert spark.conf.get(session._CLEANUP) == was and df.count() == df.count() == 1000


def test_gzip_session_files(spark, tmpdir_path):
    text = HEAD + 'p,7i,150\n,,[yds]\np,"8i\nx",151\n'
    for name, content in (("a.csv", text.encode()), ("b.csv.gz", gzip.compress(("﻿" + text).encode())), ("c.csv", b"x"),
                          ("d.gz", gzip.compress(HEAD.encode()) + gzip.compress(b"p,D,250\n")), ("e.gz", gzip.compress(b""))):
        write(f"{tmpdir_path}/raw/{name}", content)
    got = csvs.read_sessions(spark, f"{tmpdir_path}/raw").where("club_type IS NOT NULL").collect()
    by = {n: sorted((r.club_type, r.carry_distance) for r in got if r.source_file.endswith(n)) for n in ("a.csv", "b.csv.gz", "d.gz")}
    assert by["a.csv"] == by["b.csv.gz"] == [("7i", 150.0), ("8i\nx", 151.0)] and by["d.gz"] == [("D", 250.0)]
    zone = Landing(spark, f"{tmpdir_path}/zone")
    zone.land(csvs.session_files(spark, f"{tmpdir_path}/raw"), dt.datetime(2025, 1, 1), batch="one")
    stored = {r.storage_path.rsplit("/", 1)[1]: bytes(r.content) for r in zone.latest().collect()}
    assert stored["d.gz"][:2] == b"\x1f\x8b" and stored["c.csv"] == b"x"  # as they were landed
    lines = zone.lines().where("storage_path LIKE '%d.gz'").orderBy("number").collect()
    assert [r.line for r in lines] == [HEAD.strip(), "p,D,250"]


def test_session_files_are_compressed_and_dealt_as_numbers(spark, tmpdir_path, monkeypatch):
    dealt, kind = [], type(spark.range(1))
    repartition = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: dealt.append(dict(self.dtypes)) or repartition(self, *a))
    view = spark.range(1, 41).select(F.col("id").alias("user_id"), (F.col("id") * 3).alias("session_id"), F.lit("7i").alias("club_type"),
                                     *[(F.col("id") / 4).alias(m) for m in METRICS])
    dirs = testdata.write_session_csvs(view, f"{tmpdir_path}/csv", shots_per_file=10)
    assert len(dealt) == 2 and all(d["Carry Distance"] == "double" and d["User Id"] == "bigint" for d in dealt)
    files = [f for d in dirs for f in glob.glob(f"{d}/part-*")]
    assert len(files) == 8 and all(gzip.open(f).read().count(b"[u]") in (20, 21) for f in files)
    back = csvs.read_sessions(spark, dirs, keep=["User Id"])
    assert sorted((int(r["User Id"]), r.carry_distance) for r in back.collect()) == [(k, k / 4) for k in range(1, 41)]


def test_latest_contents_are_not_shuffled_while_few_are_replaced(spark, tmpdir_path, monkeypatch):
    zone = Landing(spark, f"{tmpdir_path}/zone")
    for day, names in ((1, "abc"), (2, "bc"), (3, "c")):
        files = spark.createDataFrame([(n, f"{n}{day}".encode()) for n in names], "source_file string, content binary")
        zone.land(files, dt.datetime(2025, 1, day), batch=str(day))
    for most, shuffled in ((5, False), (0, True)):
        monkeypatch.setattr(session.counted, "__defaults__", (most,))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = zone.latest()
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert sorted(bytes(r.content) for r in out.collect()) == [b"a1", b"b2", b"c3"]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert ("Exchange hashpartitioning" in plan) == shuffled


def test_positions_are_written_compressed_and_rows_not_shuffled_again(spark, tmpdir_path, monkeypatch):
    kind = type(spark.range(1))
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("a b"), F.lit("x").alias("t")).repartition(5)
    with monkeypatch.context() as m:
        m.setattr(kind, "checkpoint", lambda *a, **k: pytest.fail("a checkpoint"))
        m.setattr(kind, "localCheckpoint", lambda *a, **k: pytest.fail("a checkpoint"))
        out = od.positions(df, [F.asc("`a b`")])
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["a b"], r.position) for r in out.collect()) == [(k, k) for k in range(500)]
    void = od.positions(df.withColumn("v", F.lit(None)), [F.asc("`a b`")])
    assert void.count() == 500 and dict(void.dtypes)["v"] == "void"
    path = sinks.write_merged_csv(df, f"{tmpdir_path}/m", [F.col("`a b`")], options=sinks.GZIP)
    assert glob.glob(f"{path}/*.csv.gz") and not glob.glob(f"{path}/*.csv")
    back = sinks.read_csv_table(spark, path)
    assert sorted((r.row_index, r["a b"]) for r in back.collect()) == [(k, k) for k in range(500)]


def test_compaction_rewrites_some_buckets_at_a_time(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(tb, "ROUNDS", 3)
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=8)
    rows = [(f"s{k}", f"u{k % 20}", "7i", float(k)) for k in range(200)]
    t.append_shots(shots(spark, rows[:150]), batch="a")
    t.append_shots(shots(spark, rows[150:]), batch="b")
    t.delete_sessions(spark.createDataFrame([(f"s{k}",) for k in range(0, 200, 2)], "session_id string"))
    seen, replace = [], t._replace

    def noted(table, df, **more):
        if table == "shots":
            seen.append({r[0] for r in df.select("user_bucket").distinct().collect()})
        return replace(table, df, **more)

    monkeypatch.setattr(t, "_replace", noted)
    t.compact()
    assert len(seen) == 3 and sum(map(len, seen)) == len(set().union(*seen)) and max(map(len, seen)) <= 3
    assert sorted(r.session_id for r in t._read("shots").collect()) == sorted(f"s{k}" for k in range(1, 200, 2))
    assert t.tombstones("deleted_sessions").count() == 0


def test_later_generations_compute_some_buckets_at_a_time(spark, tmpdir_path, monkeypatch):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=8)
    t.append_shots(shots(spark, [(f"s{k}", f"u{k % 20}", "7i", float(k)) for k in range(100)]))
    tb.generate(t)
    t.delete_sessions(spark.createDataFrame([("s1",), ("s2",), ("s22",), ("s42",), ("s62",), ("s82",)], "session_id string"))
    frames, summary = [], tb.club_summary
    monkeypatch.setattr(tb, "ROUNDS", 4)
    monkeypatch.setattr(tb, "club_summary", lambda df, by: frames.append(df) or summary(df, by=by))
    made = tb.generate(t, users=tb.users_frame(spark, ["u1", "u2", "u3", "u3"]))
    assert len(frames) == 4 and made.clubs_computed == 2
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*user_bucket#\d+L? IN", plan)
    assert {r.user_id: r.clubs_computed for r in made.counts.collect()} == {"u1": 1, "u3": 1}
    got = {r.user_id: r.shots for r in t.club_summaries().collect()}
    assert got == {f"u{k}": 4 if k == 1 else 5 for k in range(20)}  # u2 has no shots left and keeps its row
