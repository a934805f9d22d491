"""Bounds that keep the shot queries in proportion to their rows."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotspark.llm import op04_records as op4
from shotspark.schema import METRICS, SNAKE_TO_TITLE
from shotspark.sources import csv_sessions as csvs
from shotspark.sources import tables as tb
from shotspark.sources import testdata


@pytest.fixture()
def tiny(spark, tmpdir_path):
    lines = [(o, p, o % 7, n, float(n)) for o in range(1, 9) for n, p in ((1, o), (2, o + 30), (3, 14))]
    lines.append((3, None, 1, 4, 1.0))
    (spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
     .write.parquet(f"{tmpdir_path}/lineitem.parquet"))
    (spark.createDataFrame([(o, o % 3) for o in range(1, 9)], "o_orderkey long, o_custkey long")
     .write.parquet(f"{tmpdir_path}/orders.parquet"))
    return tmpdir_path


def _fused_projects(df):
    """Projections of whole-stage code that compute metrics."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if re.search(r"\*\(\d+\) Project", x) and x.count(" AS ") > 15]


def test_shots_are_compiled_as_small_methods(spark, tiny):
    shots = testdata.shots(spark, tiny)
    assert _fused_projects(shots) == []
    plain = spark.read.parquet(f"{tiny}/lineitem.parquet").join(
        spark.read.parquet(f"{tiny}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*testdata.SHOT_SELECT)
    assert shots.columns == plain.columns and shots.dtypes == plain.dtypes
    assert sorted(map(repr, shots.collect())) == sorted(map(repr, plain.collect()))
    assert {r.club_type for r in shots.collect()} > {None, "3W"}


def test_club_codes_are_looked_up_in_compiled_code(spark, tmpdir_path):
    keys = [None, -16, -1, 0, 1, 13, 14, 15, 29, 2**40 + 7]
    (spark.createDataFrame([(1, p, 1, n, 1.0) for n, p in enumerate(keys)],
                           "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
     .write.parquet(f"{tmpdir_path}/lineitem.parquet"))
    spark.createDataFrame([(1, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmpdir_path}/orders.parquet")
    shots = testdata.shots(spark, tmpdir_path)
    plan = shots._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"aggregate\(\[0\], l_partkey#", plan) and "transform(" not in plan  # only a bare column in the lambda
    plain = spark.read.parquet(f"{tmpdir_path}/lineitem.parquet").selectExpr(testdata._club_sql())
    assert sorted(map(repr, shots.select("club_type").collect())) == sorted(map(repr, plain.collect()))


def test_appended_shots_are_compiled_as_small_methods(spark, tiny, monkeypatch):
    dealt, observe = [], type(spark.range(1)).observe
    monkeypatch.setattr(type(spark.range(1)), "observe", lambda self, *a: dealt.append(self) or observe(self, *a))
    t = tb.Tables(spark, f"{tiny}/t", buckets=2)
    assert t.append_shots(tb.shots_from_view(testdata.shots(spark, tiny)))["rows"] == 25
    rows = dealt[0].collect()  # the plan is final only now
    assert len({r.id for r in rows}) == 25 and {r.session_id for r in rows} == {str(k) for k in range(1, 9)}
    plan = dealt[0]._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    wide = [x for x in final.splitlines() if "Project [" in x and x.count("#") > 20]
    assert len(wide) == 3 and not [x for x in wide if re.search(r"\*\(\d+\) Project", x)]


def test_a_task_writes_several_session_files(spark, tiny):
    shots = testdata.shots(spark, tiny)
    dirs = testdata.write_session_csvs(shots, f"{tiny}/csv", shots_per_file=1)
    files = [r.path for d in dirs for r in spark.read.format("binaryFile").load(d).select("path").collect()]
    assert len(files) == 50  # one of each number and layout
    assert {int(re.search(r"/part-(\d+)-", f).group(1)) for f in files} <= set(range(8))  # the session's shuffle partitions
    assert all(re.search(r"/layout [ab]/file=\d+/part-", f) for f in files)
    back = csvs.read_sessions(spark, dirs, keep=["User Id", "Session Id"])
    plain = shots.withColumn("user_id", F.col("user_id").cast("string")).withColumn("session_id", F.col("session_id").cast("string"))
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, map(tuple, plain.collect())))


def test_short_files_are_parsed_once(monkeypatch):
    parsed, records = [], csvs._records
    monkeypatch.setattr(csvs, "_records", lambda c: parsed.append(1) or records(c))
    monkeypatch.setattr(csvs, "_ROWS_A_BATCH", 3)
    for rows, times, rejected in ((0, 1, False), (2, 1, False), (3, 2, False), (7, 2, False), (2, 1, True), (7, 1, True)):
        lines = ["Player,Club Type"] + ["p,7i"] * rows + (["p,7i,1"] if rejected else [])
        batch = pa.RecordBatch.from_arrays([pa.array(["a.csv"]), pa.array(["\n".join(lines).encode()])], names=["source_file", "content"])
        parsed.clear()
        out = list(csvs._cells(["Club Type"], False)([batch]))
        assert len(parsed) == times, (rows, rejected)
        flags = [x for b in out for x in b.column("rejected").to_pylist()]
        lines = [x for b in out for x in b.column("line").to_pylist()]
        assert (flags, lines) == (([True], [0]) if rejected else ([False] * rows, list(range(rows))))


def test_typed_csv_cells_are_compiled_as_small_methods(spark):
    raw = spark.createDataFrame([("7i", *[str(k)] * len(METRICS)) for k in range(3)], ["Club Type", *[SNAKE_TO_TITLE[m] for m in METRICS]])
    typed = csvs.typed_shots(raw)
    assert _fused_projects(typed) == []
    assert sorted((r.club_type, r.carry_distance) for r in typed.collect()) == [("7i", 0.0), ("7i", 1.0), ("7i", 2.0)]


def _peak(rows: int) -> tuple[int, int]:
    head = "Player,Club Type," + ",".join(SNAKE_TO_TITLE[m] for m in METRICS)
    line = "p,7i," + ",".join(f"{k}.125" for k in range(len(METRICS)))
    content = ("\ufeff" + "\r\n".join([head, *[line] * rows])).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["a.csv"]), pa.array([content])], names=["source_file", "content"])
    tracemalloc.start()
    n = sum(b.num_rows for b in csvs._cells(["Club Type", "Carry Distance"], True)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, peak


def test_memory_of_parsing_does_not_follow_the_file():
    (few, small), (many, large) = _peak(25_000), _peak(100_000)
    assert (few, many) == (25_000, 100_000)
    assert large < 1.2 * small


def test_rejection_at_the_end_of_a_long_file():
    content = ("Club Type,Carry Distance\n" + "7i,1\n" * 25_000 + "7i,1,2\n").encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["a.csv"]), pa.array([content])], names=["source_file", "content"])
    out = list(csvs._cells(["Club Type"], False)([batch]))
    assert [(b.num_rows, b.column("rejected").to_pylist()) for b in out] == [(1, [True])]


def test_ids_are_made_behind_the_shuffle(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/t", buckets=2)
    none = [F.lit(None).cast("double").alias(m) for m in METRICS]
    rows = spark.createDataFrame([(5, "s1", "u1", "7i"), (6, "s1", "u1", None), (7, None, "u2", "D")],
                                 "row_number long, session_id string, user_id string, club_type string").select("*", *none)
    for _ in range(2):  # a replay of the batch adds fillers, which are no shots
        assert t.append_shots(rows, batch="b")["rows"] == 3
    assert t.append_shots(rows.where("row_number = 5"), batch="b")["rows"] == 1
    t.append_shots(rows.where("row_number > 5"), batch="c")
    of = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(r.id for r in t.batch("shots", "b").collect() + t.batch("shots", "c").collect()) == sorted(
        [of("s1|5"), of("s1|6"), of("7")])


def test_known_words_are_kept_up_to_the_bound(monkeypatch):
    asked = []

    def encode(_, words):
        asked.append(words)
        return np.array([ord(c) for w in words for c in w], np.uint32), np.array([len(w) for w in words], np.int64)

    monkeypatch.setattr(op4, "_encode_words", encode)
    known = op4._Known(None, most=3)
    for words in (["ab", "c", "d", "efg"], ["x", "c", "efg", "ab"], ["d"]):
        flat, start, length = known(pa.array(words, pa.large_string()))
        assert ["".join(map(chr, flat[a:a + n])) for a, n in zip(start, length)] == words
    assert asked == [["ab", "c", "d", "efg"], ["x", "efg"], []]
    assert len(known.words) == 3 and len(known.flat) == 4
