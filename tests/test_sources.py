"""CSV fixtures (ingest semantics), registry loader, tables and streaming."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shotspark.operators import clean as cl
from shotspark.plans.ingest import ingest_sessions
from shotspark.sources import csv_sessions as csvs
from shotspark.sources import sinks
from shotspark.sources import tables as tb


def write(path, text, bom=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(("\ufeff" if bom else "") + text)
    return path


HEAD_A = "Player,Club Type,Carry Distance,Ball Speed,Launch Direction\n"
UNITS_A = ",,[yds],[mph],[deg]\n"


def test_reference_loader_case(spark, tmpdir_path):
    p = write(f"{tmpdir_path}/avg_carry_yds.csv", "Club Type,Base Carry\n7i,150\n")
    df = sinks.load(spark, "avg_carry_yds", path=p)
    assert df.columns == ["Club Type", "Base Carry"]
    assert df.first()["Club Type"] == "7i"


def test_registry_missing_path(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        sinks.load(spark, "club_summary", data_dir=f"{tmpdir_path}/nope").count()


def test_units_row_bom_and_headers_union(spark, tmpdir_path):
    write(f"{tmpdir_path}/raw/a.csv", HEAD_A + UNITS_A + "p,7i,150, 100 ,1e0\np,D,NA,n/a,-.5\n", bom=True)
    # different order, padded header, one extra column, one column missing
    write(f"{tmpdir_path}/raw/b.csv",
          "Ball Speed, Club Type ,Player,Carry Distance,Note\n[mph],,,[yds],\n120,PW,q,1,234,x\n")
    write(f"{tmpdir_path}/raw/c.csv", "Club Type,Carry Distance\n7i,12d\nNA,+5\n")
    raw, rejected = csvs.read_raw_sessions(spark, f"{tmpdir_path}/raw", with_rejected=True)
    shots = csvs.typed_shots(raw, keep=[csvs.SOURCE]).withColumn(
        "f", F.element_at(F.split(csvs.SOURCE, "/"), -1)).drop(csvs.SOURCE)
    rows = sorted(((r["f"], r["club_type"], r["carry_distance"], r["ball_speed"], r["launch_direction"])
                   for r in shots.collect()), key=repr)
    # b.csv has a row longer than its header ("1,234" is two fields): rejected
    assert [r[0] for r in rejected.collect()][0].endswith("b.csv")
    assert rows == sorted([
        ("a.csv", "7i", 150.0, 100.0, 1.0), ("a.csv", "D", None, None, -0.5),
        ("c.csv", "7i", None, None, None), ("c.csv", None, 5.0, None, None),
    ], key=repr)


def test_short_rows_get_nulls_and_no_player_keeps_rows(spark, tmpdir_path):
    write(f"{tmpdir_path}/raw/s.csv", "Club Type,Carry Distance,Ball Speed\n7i,150\n")
    rows = csvs.read_sessions(spark, f"{tmpdir_path}/raw", keep=[]).collect()
    assert [(r["club_type"], r["carry_distance"], r["ball_speed"]) for r in rows] == [("7i", 150.0, None)]


def test_script_clean_truncates_and_drops(spark):
    df = spark.createDataFrame([("7i", 150.75, -3.5, 1.2345), ("D", None, 2.0, 1.5), (None, 1.0, 1.0, 1.0),
                                ("PW", 1.0, 1.0, None)],
                               "club_type string, carry_distance double, club_path double, smash_factor double")
    got = sorted(tuple(r) for r in cl.script_clean(df).collect())
    assert got == [("7i", 150, -3, 1.23), ("D", 0, 2, 1.5)]


def test_profile_counts(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b string")
    got = {r["column_name"]: (r["non_null"], r["dtype"]) for r in cl.profile(df).collect()}
    assert got == {"a": (1, "double"), "b": (0, "string")}


def test_drop_all_null(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert dv_drop(df).columns == ["a"]


def dv_drop(df):
    from shotspark.operators.deliverables import drop_all_null
    return drop_all_null(df)


def test_ingest_delete_compact_roundtrip(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    write(f"{tmpdir_path}/up/s1.csv", HEAD_A + UNITS_A + "p,7i,150,100,1\np,7i,152,101,2\n")
    write(f"{tmpdir_path}/up/s2.csv", HEAD_A + UNITS_A + "p,D,250,150,0\n")
    res = ingest_sessions(spark, t, f"{tmpdir_path}/up", "user-1", uploaded_at=dt.datetime(2025, 1, 1))
    assert res["rows_imported"] == 3
    sessions = t.sessions().collect()
    assert len(sessions) == 2 and {s["storage_path"].rsplit("/", 1)[1] for s in sessions} == {"s1.csv", "s2.csv"}
    # per-user read prunes to the user's bucket
    assert tb.fetch_shots(t, "user-1").count() == 3
    # generate the cache, then delete a session: cache stays (stale, as the reference)
    tb.generate(t)
    assert tb.cached_summary(t, "user-1").count() == 2
    s2 = [s["id"] for s in sessions if s["filename"] == "s2.csv"][0]
    with pytest.raises(KeyError):
        t.delete_session(s2, "someone-else")
    t.delete_session(s2, "user-1")
    assert t.shots().count() == 2 and t.sessions().count() == 1
    t.compact()
    assert t.shots().count() == 2
    # erase the user: everything hidden
    t.erase_users(tb.users_frame(spark, ["user-1"]))
    assert t.shots().count() == 0 and t.sessions().count() == 0 and t.club_summaries().count() == 0


def test_generate_for_some_users_keeps_others(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    rows = [("s1", "u1", "7i", 150.0), ("s2", "u2", "D", 250.0)]
    shots = spark.createDataFrame(rows, "session_id string, user_id string, club_type string, carry_distance double")
    from shotspark.schema import METRICS
    shots = shots.select("*", *[F.lit(None).cast("double").alias(m) for m in METRICS if m != "carry_distance"])
    t.append_shots(tb.with_shot_ids(shots))
    tb.generate(t)
    t.append_shots(tb.with_shot_ids(shots.where(F.col("user_id") == "u1")))
    tb.generate(t, users=tb.users_frame(spark, ["u1"]))
    got = {r["user_id"]: r["shots"] for r in t.club_summaries().collect()}
    assert got == {"u1": 2, "u2": 1}


def _shots(spark, rows):
    from shotspark.schema import METRICS
    df = spark.createDataFrame(rows, "session_id string, user_id string, club_type string, carry_distance double")
    return tb.with_shot_ids(df.select("*", *[F.lit(None).cast("double").alias(m) for m in METRICS if m != "carry_distance"]))


def test_bucket_count_is_the_tables(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=16)
    t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0), ("s2", "u2", "7i", 151.0)]))
    with pytest.raises(ValueError):
        tb.Tables(spark, f"{tmpdir_path}/tables", buckets=7)
    again = tb.Tables(spark, f"{tmpdir_path}/tables")
    assert again.buckets == 16 and tb.fetch_shots(again, "u1").count() == 1
    assert "user_bucket" not in tb.fetch_shots(again).columns


def test_a_replay_replaces_its_batch(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    t.append_shots(_shots(spark, [("s9", "u9", "7i", 99.0)]), batch="b0")
    for _ in range(2):
        done = t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0), ("s2", "u2", "7i", 151.0), ("s3", "u3", "7i", 152.0)]), batch="b1")
        assert done["rows"] == 3 and t.shots().count() == 4
    # A replay with fewer rows also clears the buckets it has no rows for.
    assert t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0)]), batch="b1")["rows"] == 1
    assert sorted(r.session_id for r in t.shots().collect()) == ["s1", "s9"]


def test_a_write_that_fails_half_way_changes_nothing(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    good = _shots(spark, [(f"s{k}", f"u{k}", "7i", 150.0) for k in range(20)])
    t.append_shots(good, batch="b1")
    bad = good.withColumn("club_type", F.when(F.col("user_id") == "u7", F.raise_error(F.lit("lost")).cast("string")).otherwise("D"))
    for batch in ("b1", "b2"):
        with pytest.raises(Exception, match="lost"):
            t.append_shots(bad, batch=batch)
        assert t.shots().where("club_type = '7i'").count() == t.shots().count() == 20
    os.makedirs(f"{tmpdir_path}/tables/shots/.spark-staging-x/batch=b3/user_bucket=0")
    with open(f"{tmpdir_path}/tables/shots/.spark-staging-x/batch=b3/user_bucket=0/part-0.parquet", "wb") as f:
        f.write(b"torn")
    assert t.shots().count() == 20


def test_rows_of_another_owner_are_refused(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    with pytest.raises(Exception, match="another user"):
        t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0), ("s2", "u2", "7i", 1.0)]), owner="u1")
    assert t.shots().count() == 0
    assert t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0)]), owner="u1")["rows"] == 1


def test_compact_empties_partitions_and_keeps_new_batches(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0), ("s2", "u1", "7i", 151.0)]), batch="a")
    t.append_shots(_shots(spark, [("s2", "u2", "7i", 151.0)]), batch="b")
    t.delete_sessions(spark.createDataFrame([("s2",)], "session_id string"))
    replace = t._replace

    def slow(table, df, **seen):
        out = replace(table, df, **seen)
        if table == "shots" and not slow.done:
            slow.done = True
            t.append_shots(_shots(spark, [("s3", "u1", "7i", 152.0)]))
        return out

    slow.done, t._replace = False, slow
    t.compact()
    t._replace = replace
    stored = t._files("shots").where("id IS NOT NULL")
    assert sorted(r.session_id for r in stored.collect()) == ["s1", "s3"]  # batch b is empty now
    assert t.tombstones("deleted_sessions").count() == 1
    t.compact()  # nothing came in between: the tombstone goes
    assert t.tombstones("deleted_sessions").count() == 0 and t.shots().count() == 2
    assert not [d for d in os.listdir(f"{tmpdir_path}/tables/shots") if "log" in d]


def test_a_user_who_comes_back_is_seen(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0), ("s2", "u2", "D", 1.0)]), landed_at=dt.datetime(2025, 1, 1))
    t.erase_users(tb.users_frame(spark, ["u1"]), now=dt.datetime(2025, 1, 2))
    assert [r.user_id for r in t.shots().collect()] == ["u2"]
    t.append_shots(_shots(spark, [("s3", "u1", "7i", 150.0)]), landed_at=dt.datetime(2025, 1, 3))
    assert sorted(r.session_id for r in t.shots().collect()) == ["s2", "s3"]
    t.compact()
    assert sorted(r.session_id for r in t.shots().collect()) == ["s2", "s3"]


def test_reads_that_need_a_user(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0), ("s2", "u2", "D", 250.0)]))
    t.append_sessions(tb.session_rows(spark.createDataFrame([("u1", "a.csv")], "user_id string, filename string")))
    tb.generate(t)
    assert t.register_reads("t_") == ["t_shots_of", "t_sessions_of", "t_club_summaries_of"]
    got = spark.sql("SELECT * FROM t_shots_of('u1')")
    assert [(r.user_id, r.session_id) for r in got.collect()] == [("u1", "s1")] and "landed_at" not in got.columns
    assert "PartitionFilters: [" in plan(got) and "user_bucket" in plan(got).split("PartitionFilters")[1].split("]")[0]
    assert spark.sql("SELECT * FROM t_shots_of('nobody')").count() == 0
    assert spark.sql("SELECT * FROM t_shots_of(NULL)").count() == 0
    assert spark.sql("SELECT * FROM t_sessions_of('u2')").count() == 0
    assert [r.club_type for r in spark.sql("SELECT * FROM t_club_summaries_of('u2')").collect()] == ["D"]
    with pytest.raises(Exception):
        spark.sql("SELECT * FROM t_shots_of()").collect()


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_nan_is_null_and_cache_survives_deletes(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    t.append_shots(_shots(spark, [("s1", "u1", "7i", 150.0), ("s1", "u1", "7i", float("nan")), ("s2", "u2", "D", 250.0)]))
    tb.generate(t)
    assert tb.cached_summary(t, "u1").first()["avg_carry_yd"] == 150.0
    t.delete_sessions(spark.createDataFrame([("s1",), ("s2",)], "session_id string"))
    with pytest.raises(tb.NoShotData):
        tb.generate(t, users=tb.users_frame(spark, ["u1"]))
    with pytest.raises(tb.NoShotData):
        tb.generate(t)
    assert tb.cached_summary(t).count() == 2
    with pytest.raises(tb.NoSummary):
        tb.cached_summary(t, "u3")


def test_session_stream_ingest(spark, tmpdir_path):
    from shotspark.streaming.session_stream import start_session_stream
    write(f"{tmpdir_path}/landing/user-9/a.csv", HEAD_A + UNITS_A + "p,7i,150,100,1\n")
    write(f"{tmpdir_path}/landing/user-9/b.csv", HEAD_A + UNITS_A + "p,8i,140,95,1\np,8i,141,96,1\n")
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    q = start_session_stream(spark, t, f"{tmpdir_path}/landing", f"{tmpdir_path}/ckpt")
    q.awaitTermination(120)
    assert t.shots().count() == 3
    assert {r["user_id"] for r in t.sessions().collect()} == {"user-9"}


def test_upload_of_many_users(spark, tmpdir_path):
    from shotspark.plans.ingest import folder_user, upload_sessions
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    note = HEAD_A.replace("Launch Direction", "Launch Direction,Note")
    write(f"{tmpdir_path}/up/u 1/s.csv", note + ',,,,,\np,7i,150,100,1,"said ""hi, there"""\np,8i,140,95,1,"two\nlines"\n')
    write(f"{tmpdir_path}/up/u2/s.csv", HEAD_A + UNITS_A + "p,D,250,150,0\n")
    write(f"{tmpdir_path}/up/u2/long.csv", HEAD_A + "p,D,250,150,0,9\n")
    write(f"{tmpdir_path}/up/u2/empty.csv", "")
    write(f"{tmpdir_path}/up/u2/units.csv", HEAD_A + UNITS_A)
    dirs = [f"{tmpdir_path}/up/u 1", f"{tmpdir_path}/up/u2"]
    for _ in range(2):  # the second run replays the batch
        done = upload_sessions(spark, t, dirs, folder_user(), dt.datetime(2025, 1, 1))
    assert done.rows_imported == 3 and t.shots().count() == 3 and t.sessions().count() == 2
    assert {(r["user_id"], r["filename"]) for r in t.sessions().collect()} == {("u 1", "s.csv"), ("u2", "s.csv")}
    assert [r[0].rsplit("/", 1)[1] for r in done.rejected.collect()] == ["long.csv"]
    assert sorted(r[0].rsplit("/", 1)[1] for r in done.empty.collect()) == ["empty.csv", "units.csv"]
    upload_sessions(spark, t, dirs, folder_user(), dt.datetime(2025, 1, 2))  # a re-upload is new
    assert t.shots().count() == 6 and t.sessions().count() == 4


def test_duplicate_headers():
    assert csvs.column_names("X, X ,X2,\ufeffY") == ["X", "X3", "X2", "Y"]


def test_save_deliverables_roundtrip(spark, tmpdir_path):
    from shotspark.operators import deliverables as dv
    from shotspark.sources import testdata
    from tests.conftest import SF_SMALL
    d = dv.deliverables(testdata.shots(spark, SF_SMALL), by=("user_id",), materialize=True)
    assert "p50_carry_yd" in d.club_carry_averages.columns and "shape_bias" in d.face_variance_by_club.columns
    paths = sinks.save_deliverables(d, f"{tmpdir_path}/out")
    assert set(paths) == {"club_summary", "face_variance_by_club", "club_carry_averages"}
    back = sinks.read_csv_table(spark, paths["club_summary"])
    assert back.count() == d.club_summary.count()
    assert back.columns == d.club_summary.columns


# -- session files --------------------------------------------------------------
def test_one_scan_and_a_limit_on_the_files(spark, tmpdir_path):
    for k in range(6):
        write(f"{tmpdir_path}/raw/f [{k}] {{x}}.csv", HEAD_A + UNITS_A + f"p,7i,{k},100,1\n")
    got = csvs.read_sessions(spark, f"{tmpdir_path}/raw")
    assert got.count() == 6 and plan(got, "simple").count("FileScan") == 1
    some = csvs.session_files(spark, f"{tmpdir_path}/raw", limit=2)
    assert len(some.inputFiles()) == 2 and plan(some, "simple").count("FileScan") == 1
    assert sorted(r.carry_distance for r in csvs.read_sessions(spark, f"{tmpdir_path}/raw", limit=2).collect()) == [0.0, 1.0]
    assert csvs.read_sessions(spark, f"{tmpdir_path}/raw", limit=0).count() == 0
    assert csvs.read_sessions(spark, f"{tmpdir_path}/none", limit=3).count() == csvs.read_sessions(spark, f"{tmpdir_path}/none").count() == 0
    stats = csvs.merge_stats(csvs.read_raw(spark, f"{tmpdir_path}/raw").rows).first()
    assert (stats.files, stats.rows) == (6, 6)


def test_blank_first_lines_and_breaks_in_the_header(spark, tmpdir_path):
    write(f"{tmpdir_path}/raw/a.csv", "\n  \n" + HEAD_A + "\n" + UNITS_A + "p,7i,150,100,1\n\n", bom=True)
    write(f"{tmpdir_path}/raw/b.csv", '"Club Type","Carry Distance","A ""note""\nin two lines"\r\n8i,140,"x, ""y""\nz"\r\n')
    write(f"{tmpdir_path}/raw/c.csv", "club type,carry_distance\n9i,130\n")
    write(f"{tmpdir_path}/raw/d.csv", "\n\n")
    raw = csvs.read_raw(spark, f"{tmpdir_path}/raw")
    assert 'A "note"\nin two lines' in raw.rows.columns and raw.rejected.count() == 0 and raw.files.count() == 3
    assert {r['A "note"\nin two lines'] for r in raw.rows.collect()} == {None, 'x, "y"\nz'}
    got = csvs.read_sessions(spark, f"{tmpdir_path}/raw", keep=[])
    assert sorted((r.club_type, r.carry_distance) for r in got.collect()) == [("7i", 150.0), ("8i", 140.0), ("9i", 130.0)]


def test_a_file_over_the_bound_raises(spark, tmpdir_path):
    write(f"{tmpdir_path}/raw/a.csv", HEAD_A + "p,7i,150,100,1\n" * 100)
    with pytest.raises(Exception, match="not a session file"):
        csvs.session_files(spark, f"{tmpdir_path}/raw", max_bytes=500).collect()


def test_landing_keeps_the_last_version(spark, tmpdir_path):
    from shotspark.plans.ingest import upload_sessions
    from shotspark.sources.landing import Landing
    zone = Landing(spark, f"{tmpdir_path}/zone")
    assert zone.latest().count() == 0
    write(f"{tmpdir_path}/up/a.csv", HEAD_A + "p,7i,1,100,1\n")
    write(f"{tmpdir_path}/up/b.csv", HEAD_A + "p,D,2,100,1\r\np,D,3,100,1\n")
    for _ in range(2):  # the second time replays the batch
        zone.land(csvs.session_files(spark, f"{tmpdir_path}/up"), dt.datetime(2025, 1, 1), batch="one")
    assert zone._rows().count() == 2
    write(f"{tmpdir_path}/up/a.csv", HEAD_A + "p,7i,9,100,1\np,7i,8,100,1\n")
    zone.land(csvs.session_files(spark, f"{tmpdir_path}/up/a.csv"), dt.datetime(2025, 1, 2), batch="two")
    latest = {r.storage_path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in zone.latest().collect()}
    assert latest == {"a.csv": HEAD_A + "p,7i,9,100,1\np,7i,8,100,1\n", "b.csv": HEAD_A + "p,D,2,100,1\r\np,D,3,100,1\n"}
    shots = csvs.shots_of_files(zone.latest().withColumnRenamed("storage_path", csvs.SOURCE))
    assert sorted(r.carry_distance for r in shots.collect()) == [2.0, 3.0, 8.0, 9.0]
    lines = zone.lines().where("storage_path LIKE '%b.csv'").orderBy("number").collect()
    assert [(r.number, r.line) for r in lines] == [(0, HEAD_A.strip()), (1, "p,D,2,100,1"), (2, "p,D,3,100,1")]
    zone.vacuum()
    assert zone._rows().count() == 2 and zone.latest().count() == 2
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    done = upload_sessions(spark, t, f"{tmpdir_path}/up", "u1", dt.datetime(2025, 1, 3), landing=zone)
    assert (done.rows_imported, done.files_imported) == (4, 2) == (t.shots().count(), t.sessions().count())
    assert {r.landed_at for r in zone.latest().collect()} == {dt.datetime(2025, 1, 3)}


def test_counts_while_writing(spark, tmpdir_path):
    t = tb.Tables(spark, f"{tmpdir_path}/tables", buckets=4)
    rows = [(f"s{k}", f"u{k % 7}", ["7i", "D", None][k % 3], float(k)) for k in range(500)]
    seen = t.append_shots(_shots(spark, rows), least=F.min("carry_distance"))
    assert seen == {"rows": 500, "least": 0.0}
    made = tb.generate(t)
    assert made.clubs_computed == t.club_summaries().count() == 21
    assert {r.user_id: r.clubs_computed for r in made.counts.collect()} == {f"u{k}": 3 for k in range(7)}
    some = tb.generate(t, users=tb.users_frame(spark, ["u1", "u2"]))
    assert some.clubs_computed == 6 and t.club_summaries().count() == 21


def test_merged_csv_has_its_index(spark, tmpdir_path):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("a"), F.lit("x,y").alias("b")).repartition(7)
    path = sinks.write_merged_csv(df, f"{tmpdir_path}/m", [F.col("a")])
    back = sinks.read_csv_table(spark, path)
    assert back.columns == ["row_index", "a", "b"]
    assert [(r.row_index, r.a) for r in back.orderBy("row_index").collect()] == [(k, k) for k in range(1000)]


def test_newest_sessions(spark):
    from datetime import datetime as D
    rows = [("a", "u", "f", D(2025, 1, 1)), ("b", "u", "f", D(2025, 1, 2)), ("c", "u", "f", D(2025, 1, 2)), ("d", "u", "g", D(2024, 1, 1)),
            ("e", "v", "f", D(2023, 1, 1)), ("f", "v", None, D(2023, 1, 1)), ("g", "v", None, D(2023, 1, 2)), ("h", "w", "f", None)]
    df = spark.createDataFrame(rows, "id string, user_id string, filename string, uploaded_at timestamp")
    assert {r.id for r in tb.newest_sessions(df).collect()} == {"c", "d", "e", "g", "h"}
    assert {r.id for r in tb.newest_sessions(df, ("user_id",)).collect()} == {"c", "g", "h"}
    assert tb.newest_sessions(df.limit(0)).count() == 0
