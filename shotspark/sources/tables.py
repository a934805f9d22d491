"""The three tables (sessions, shots, club_summaries) as Parquet on shared storage.

Every table and every kind of tombstone is one folder that Spark's writers partition:
shots by (batch, user_bucket), club_summaries by user_bucket, the others by batch.

* All writes are dynamic partition overwrites.  Spark writes new files aside and
  moves them in when the whole job is done, so a job that dies half way changes
  nothing, a replay of a batch replaces just its own partitions, and two writers
  with different batches never meet.
* Dynamic overwrite leaves a partition alone that gets no row.  So every partition
  that a write is to replace also gets one filler row of NULLs, which all reads
  filter out by their key: a partition can become empty.
* Deletes append tombstones and every read anti-joins them.  A user's tombstone
  hides what was landed up to its time, so an id that uploads again later is seen.
  ``compact`` rewrites in place the partitions that hold dead rows and then retires
  the tombstones that it applied, unless a batch came in meanwhile.
* ``user_bucket = pmod(xxhash64(user_id), N)``; N is a stored property (choose it for
  files of some GB at the full size), so a per-user read prunes to one bucket and an
  opener with another N is refused.  Writes use AQE's rebalance, which splits a hot
  bucket.
* Row-level security: ``register_reads`` makes SQL table functions that need a user,
  and a write may name the only owner it accepts.

A read that is under way while a partition is replaced may miss its files and has to
be run again, as with any overwrite of plain Parquet.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce
from typing import Iterable, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.functions.expr import in_small_methods, nan_to_null
from shotspark.operators.deliverables import club_summary
from shotspark.schema import CACHE_RENAMES, CLUB_SUMMARIES_SCHEMA, METRICS, SESSIONS_SCHEMA, SHOTS_SCHEMA
from shotspark.session import checkpoint_dir, counted, shuffles_end_with_jobs

DEFAULT_BUCKETS = 64
#: A table partitioned by user is rewritten in so many rounds, so that each shuffles that part of it.
ROUNDS = 8
_LANDED = T.StructField("landed_at", T.TimestampType())
_SCHEMAS = {
    "sessions": SESSIONS_SCHEMA, "shots": T.StructType([*SHOTS_SCHEMA.fields, _LANDED]),
    "club_summaries": CLUB_SUMMARIES_SCHEMA,
    "deleted_sessions": T.StructType([T.StructField("session_id", T.StringType()), T.StructField("deleted_at", T.TimestampType())]),
    "deleted_users": T.StructType([T.StructField("user_id", T.StringType()), T.StructField("deleted_at", T.TimestampType())]),
}
_PARTITIONS = {"shots": ["batch", "user_bucket"], "club_summaries": ["user_bucket"]}
_KEYS = {"deleted_sessions": "session_id", "deleted_users": "user_id"}
# The column that tells when a row came in, against a user's tombstone.
_WHEN = {"sessions": "uploaded_at", "shots": "landed_at", "club_summaries": "computed_at"}


def bucket_of(user_id_col, n: int) -> "F.Column":
    return F.pmod(F.xxhash64(user_id_col.cast("string")), F.lit(n))


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Tables:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """``buckets`` counts for new tables; for existing ones it must be
        theirs (or None)."""
        self.spark, self.root = spark, root.rstrip("/")
        # ``ignore`` writes only what is not there yet, so that reads find every folder.
        first = spark.createDataFrame([(buckets or DEFAULT_BUCKETS,)], "buckets int")
        first.coalesce(1).write.mode("ignore").parquet(self._path("properties"))
        stored = spark.read.schema("buckets int").parquet(self._path("properties")).agg(F.min("buckets"), F.max("buckets")).first()
        if stored[0] != stored[1] or buckets not in (None, stored[0]):
            raise ValueError(f"the tables have {stored[0]} buckets" + (f" and {stored[1]}" if stored[0] != stored[1] else f", not {buckets}"))
        self.buckets = stored[0]
        for table in _SCHEMAS:
            spark.createDataFrame([], self._schema(table)).write.mode("ignore").partitionBy(*self._parts(table)).parquet(self._path(table))

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # -- raw reads ----------------------------------------------------------
    def _parts(self, table: str) -> list[str]:
        return _PARTITIONS.get(table, ["batch"])

    def _schema(self, table: str) -> T.StructType:
        types = {"batch": T.StringType(), "user_bucket": T.LongType()}
        return T.StructType([T.StructField(f.name, f.dataType) for f in _SCHEMAS[table].fields]
                            + [T.StructField(p, types[p]) for p in self._parts(table)])

    def _files(self, table: str) -> DataFrame:
        """All stored rows, fillers included, with the partition columns."""
        return self.spark.read.schema(self._schema(table)).parquet(self._path(table))

    def _read(self, table: str) -> DataFrame:
        return self._files(table).where(F.col(_KEYS.get(table, "id")).isNotNull())

    def batch(self, table: str, batch: str) -> DataFrame:
        """The rows of one batch."""
        return self._read(table).where(F.col("batch") == batch).drop("batch")

    def tombstones(self, kind: str) -> DataFrame:
        return self._read(kind).drop("batch")

    # -- live reads (tombstones applied) -------------------------------------
    def _dead(self, table: str, df: DataFrame, how: str) -> list[DataFrame]:
        """``df`` joined (``left_anti``: the live rows, ``left_semi``: the dead
        ones) with each kind of tombstone that bears on the table."""
        users = self.tombstones("deleted_users").groupBy("user_id").agg(F.max("deleted_at").alias("deleted_at"))
        users = users.select(F.col("user_id").alias("_u"), "deleted_at")
        gone = (F.col("user_id") == F.col("_u")) & (F.coalesce(F.col(_WHEN[table]), F.lit(dt.datetime(1, 1, 1))) <= F.col("deleted_at"))
        key = {"shots": "session_id", "sessions": "id"}.get(table)
        sessions = self.tombstones("deleted_sessions").select(F.col("session_id").alias("_s"))
        if how == "left_anti":
            df = df.join(sessions, F.col(key) == F.col("_s"), how) if key else df
            return [df.join(users, gone, how)]
        return [df.join(users, gone, how), *([df.join(sessions, F.col(key) == F.col("_s"), how)] if key else [])]

    def _live(self, table: str) -> DataFrame:
        return self._dead(table, self._read(table), "left_anti")[0]

    def sessions(self) -> DataFrame:
        return self._live("sessions").drop("batch")

    def shots(self) -> DataFrame:
        return self._live("shots").drop("batch", "landed_at")

    def club_summaries(self) -> DataFrame:
        return self._live("club_summaries")

    # -- writes --------------------------------------------------------------
    def _fillers(self, table: str, partitions: DataFrame) -> DataFrame:
        """One row of NULLs for each of the partitions."""
        parts = self._parts(table)
        return partitions.select(*parts).distinct().select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in _SCHEMAS[table].fields], *parts)

    def _replace(self, table: str, df: DataFrame, **seen) -> dict:
        """Replace the partitions that ``df`` (with partition columns) has rows
        for; returns the aggregates ``seen`` over the rows as they are written."""
        parts, counted = self._parts(table), Observation()
        if "user_bucket" in parts:
            df = df.hint("rebalance", *parts)
        if "row_number" in df.columns:
            df = df.withColumn("id", F.when(in_small_methods("row_number").isNotNull(), shot_id("row_number"))).drop("row_number")
        # Counted in the writing stage, whose tasks count once each however often they are run.
        df = df.observe(counted, F.count(_KEYS.get(table, "id")).alias("rows"), *[c.alias(n) for n, c in seen.items()])
        with shuffles_end_with_jobs(self.spark):
            (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
             .partitionBy(*parts).parquet(self._path(table)))
        return counted.get

    def _append(self, table: str, df: DataFrame, batch: str | None, owner: str | None = None, **seen) -> dict:
        numbered = table == "shots" and "id" not in df.columns
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _SCHEMAS[table].fields if not (numbered and f.name == "id")],
                         *([F.col("row_number").cast("long")] if numbered else []))
        if owner is not None:
            other = F.raise_error(F.concat(F.lit(f"a row of another user than {owner}: "), F.coalesce("user_id", F.lit("NULL"))))
            rows = rows.withColumn("user_id", F.when(F.col("user_id") == owner, F.col("user_id")).otherwise(other.cast("string")))
        rows = rows.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        if "user_bucket" in self._parts(table):
            rows = rows.withColumn("user_bucket", bucket_of(F.col("user_id"), self.buckets))
        if batch:  # a replay may lack rows for a bucket that the first run wrote
            fillers = self._fillers(table, self._files(table).where(F.col("batch") == batch))
            if numbered:
                fillers = fillers.drop("id").withColumn("row_number", F.lit(None).cast("long"))
            rows = rows.unionByName(fillers)
        return self._replace(table, rows, **seen)

    def append_sessions(self, sessions: DataFrame, batch: str | None = None, owner: str | None = None) -> dict:
        """Returns ``rows``, counted while writing; ``owner`` refuses other users' rows."""
        return self._append("sessions", sessions, batch, owner)

    def append_shots(self, shots: DataFrame, batch: str | None = None, owner: str | None = None,
                     landed_at: dt.datetime | None = None, **seen) -> dict:
        """NaN metrics become NULL, so that averages skip them.  Returns ``rows`` and
        the aggregates ``seen``, counted while writing.  Shots with a ``row_number``
        instead of an ``id`` get their ids behind the shuffle, which 64 letters that
        no codec shortens would otherwise go through."""
        clean = shots.withColumns({m: nan_to_null(F.col(m).cast("double")) for m in METRICS if m in shots.columns}
                                  | {"session_id": in_small_methods("session_id")})
        return self._append("shots", clean.withColumn("landed_at", F.lit(landed_at or _now())), batch, owner, **seen)

    # -- maintenance ----------------------------------------------------------
    def delete_session(self, session_id: str, user_id: str, now: dt.datetime | None = None) -> None:
        """K4: ownership check (one tiny action), then a tombstone."""
        owned = self.sessions().where((F.col("id") == session_id) & (F.col("user_id") == user_id))
        if owned.isEmpty():
            raise KeyError("Session not found")
        self.delete_sessions(owned.select(F.col("id").alias("session_id")), now)

    def delete_sessions(self, session_ids: DataFrame, now: dt.datetime | None = None, batch: str | None = None) -> None:
        """Bulk K4/K6: tombstone every session in ``session_ids`` (column session_id)."""
        self._append("deleted_sessions", session_ids.select("session_id", F.lit(now or _now()).alias("deleted_at")), batch)

    def erase_users(self, user_ids: DataFrame, now: dt.datetime | None = None, batch: str | None = None) -> None:
        """K5: tombstone users (column user_id): shots, summaries and sessions that
        came in up to now are hidden."""
        self._append("deleted_users", user_ids.select("user_id", F.lit(now or _now()).alias("deleted_at")), batch)

    def _batches(self) -> tuple:
        """Number and hash of the batches of shots and sessions."""
        names = self._files("shots").select("batch").unionAll(self._files("sessions").select("batch")).distinct()
        return tuple(names.agg(F.count(F.lit(1)), F.sum(F.xxhash64("batch").cast("decimal(38,0)"))).first())

    def _rounds(self, buckets: Iterable[int]) -> list[Column]:
        """Conditions on ``user_bucket`` that part the buckets into at most ``ROUNDS``."""
        buckets = sorted(buckets)
        size = max(1, -(-len(buckets) // ROUNDS))
        return [F.col("user_bucket").isin(buckets[k:k + size]) for k in range(0, len(buckets), size)]

    def compact(self) -> None:
        """Rewrite, in place, the partitions that hold tombstoned rows, some buckets at a
        time: beside the table there is disk for one round's shuffles and new files.

        Tombstones that were there at the start are retired afterwards if no batch
        came in meanwhile.  A crash leaves each partition old or new; the
        tombstones stay, so reads are right and ``compact`` can be run again."""
        before = self._batches()
        marks = {k: self._files(k).checkpoint(eager=True) for k in ("deleted_sessions", "deleted_users")}
        for table in ("shots", "sessions", "club_summaries"):
            parts = self._parts(table)
            hit = [d.select(*parts) for d in self._dead(table, self._read(table), "left_semi")]
            touched = hit[0] if len(hit) == 1 else hit[0].unionAll(hit[1])
            touched = counted(touched.distinct())  # a row per partition
            # At most as many numbers as there are buckets.
            rounds = (self._rounds(r[0] for r in touched.select("user_bucket").distinct().collect())
                      if "user_bucket" in parts else [F.lit(True)])
            for some in rounds:
                keep = self._dead(table, self._read(table).where(some).join(touched, parts, "left_semi"), "left_anti")[0]
                self._replace(table, keep.unionByName(self._fillers(table, touched.where(some))))
        if self._batches() == before:
            for kind, was in marks.items():
                gone = was.where(F.col(_KEYS[kind]).isNotNull()).select("batch").distinct()
                self._replace(kind, self._fillers(kind, gone))

    # -- reads that cannot forget the user -------------------------------------
    def register_reads(self, prefix: str = "") -> list[str]:
        """SQL table functions ``<prefix>shots_of(u)``, ``sessions_of(u)`` and
        ``club_summaries_of(u)`` over the live rows of one user, in this session.
        There is no form without a user; the bucket filter prunes the scan."""
        made = []
        for table, live in (("shots", self.shots()), ("sessions", self.sessions()), ("club_summaries", self.club_summaries())):
            view = f"{prefix}_{table}_live".lstrip("_")
            live.createOrReplaceTempView(view)
            columns = [f for f in _SCHEMAS[table].fields if f.name != "landed_at"]
            pruned = f" AND user_bucket = pmod(xxhash64(u), {self.buckets})" if "user_bucket" in live.columns else ""
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{table}_of(u STRING) RETURNS TABLE ("
                           + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ") RETURN SELECT "
                           + ", ".join(f.name for f in columns) + f" FROM {view} WHERE user_id = u{pruned}")
            made.append(f"{prefix}{table}_of")
        return made


def for_user(df: DataFrame, user_id: str, buckets: int | None = None) -> DataFrame:
    """The row-level-security filter; with ``buckets`` it also prunes the
    ``user_bucket`` partition."""
    cond = F.col("user_id") == F.lit(user_id)
    if buckets and "user_bucket" in df.columns:
        cond = cond & (F.col("user_bucket") == bucket_of(F.lit(user_id), buckets))
    return df.where(cond)


def newest_sessions(sessions: DataFrame, dedupe_by: Sequence[str] = ("user_id", "filename")) -> DataFrame:
    """The session uploaded last of each group of equal ``dedupe_by`` (ties: the
    largest id; null equals null), every column. One aggregate of fixed-size
    values, so a file uploaded very often is one row a map task."""
    last = sessions.groupBy(*dedupe_by).agg(F.max(F.struct("uploaded_at", "id")).alias("_last"))
    return sessions.join(last.select(F.col("_last.id").alias("id")), "id", "left_semi")


def fetch_shots(tables: Tables, user_id: str | None = None, dedupe_by: Sequence[str] | None = None) -> DataFrame:
    """Shots of one user (None: all users, for batch jobs; ``register_reads``
    has no such form), every column of the table; NaN was replaced by NULL when the
    shots were written. ``dedupe_by`` leaves out the shots of sessions that a later
    one of equal columns replaces (a file uploaded again); by default all stay."""
    df, sessions = tables.shots(), tables.sessions()
    if user_id is not None:
        df, sessions = for_user(df, user_id, tables.buckets), for_user(sessions, user_id)
    if dedupe_by is not None:
        newest = newest_sessions(sessions, dedupe_by).select(F.col("id").alias("session_id"))
        df = df.join(newest, "session_id", "left_semi")
    return df.drop("user_bucket")


def list_sessions(tables: Tables, user_id: str | None = None, dedupe_by: Sequence[str] | None = None) -> DataFrame:
    """Id, filename, uploaded_at newest first (id breaks ties); with
    ``dedupe_by`` the newest session of each group only."""
    s = tables.sessions()
    if user_id is not None:
        s = for_user(s, user_id)
    if dedupe_by is not None:
        s = newest_sessions(s, dedupe_by)
    return s.select("user_id", "id", "filename", "uploaded_at").orderBy(
        "user_id", F.desc("uploaded_at"), "id")


def to_cache_rows(summary: DataFrame, computed_at: dt.datetime | None = None) -> DataFrame:
    """K8: the club summary projected to the cache schema; shape_bias is
    never filled (typed NULL); id is deterministic per (user, club)."""
    ts = computed_at or _now()
    src = {dst: s for s, dst in CACHE_RENAMES}
    cols = []
    for f in CLUB_SUMMARIES_SCHEMA.fields:
        if f.name == "id":
            cols.append(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"),
                                           F.coalesce(F.col("club_type"), F.lit("\u0000")),
                                           F.lit(ts.isoformat())), 256).alias("id"))
        elif f.name == "user_id":
            cols.append(F.col("user_id").cast("string").alias("user_id"))
        elif f.name == "computed_at":
            cols.append(F.lit(ts).cast("timestamp").alias("computed_at"))
        elif f.name in src and src[f.name] in summary.columns:
            cols.append(F.col(src[f.name]).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return summary.select(*cols)


class NoShotData(LookupError):
    """There are no shots to summarise; the cache was left as it is."""


class NoSummary(LookupError):
    """No summary was generated for the user yet."""


class Generation(NamedTuple):
    """What a generation of the cache wrote."""

    counts: DataFrame     # user_id, clubs_computed
    clubs_computed: int   # all users together, counted while writing


def generate(tables: Tables, users: DataFrame | None = None, computed_at: dt.datetime | None = None) -> Generation:
    """K13 (+K7/K8): recompute the cached club summary for ``users`` (a
    frame with a user_id column; None = everyone) in one job.

    The first generation is one write.  Later ones rewrite only buckets that get
    new rows: their other users' rows are carried over, and a user without shots
    keeps the cached rows.  The rows of those are computed some buckets at a time,
    so that there are one round's shuffles on disk, and written together.  Without any
    shots nothing is changed and ``NoShotData`` is raised.
    """
    at = computed_at or _now()
    bucket = bucket_of(F.col("user_id"), tables.buckets)
    if users is not None:
        users = users.select(F.col("user_id").cast("string")).distinct()

    def computed(some: Column) -> DataFrame:
        shots = tables._read("shots").where(some)
        if users is not None:  # before the tombstones: fewer rows meet them
            shots = shots.join(users, "user_id", "left_semi")
        shots = tables._dead("shots", shots, "left_anti")[0]
        return to_cache_rows(club_summary(shots, by=("user_id",)), at).withColumn("user_bucket", bucket)

    old = tables._read("club_summaries")
    if old.isEmpty():
        clubs = tables._replace("club_summaries", computed(F.lit(True)))["rows"]
        if not clubs:
            raise NoShotData("no shot data")
        new = tables._read("club_summaries")
    else:
        checkpoint_dir(tables.spark)
        with shuffles_end_with_jobs(tables.spark):
            new = reduce(DataFrame.unionAll, [computed(some).checkpoint(eager=True) for some in tables._rounds(range(tables.buckets))])
        # At most as many numbers as there are buckets.
        touched = [r[0] for r in new.select("user_bucket").distinct().collect()]
        if not touched:
            raise NoShotData("no shot data")
        carried = (old.where(F.col("user_bucket").isin(touched))
                   .join(new.select("user_id").distinct(), "user_id", "left_anti"))
        clubs = tables._replace("club_summaries", carried.unionByName(new), new=F.count_if(F.col("computed_at") == F.lit(at)))["new"]
    return Generation(new.groupBy("user_id").agg(F.count(F.lit(1)).alias("clubs_computed")), clubs)


def cached_summary(tables: Tables, user_id: str | None = None) -> DataFrame:
    """The cached summary ordered by club (NULL club last).  For one user
    without cached rows ``NoSummary`` is raised."""
    c = tables.club_summaries()
    if user_id is not None:
        c = for_user(c, user_id, tables.buckets)
        if c.isEmpty():
            raise NoSummary(f"no summary for user {user_id}")
    return c.drop("user_bucket").orderBy("user_id", F.asc_nulls_last("club_type"))


def session_rows(files: DataFrame, user_id_col: str = "user_id",
                 uploaded_at: dt.datetime | None = None) -> DataFrame:
    """K1/K2: one sessions row per landed file (columns user_id, filename and,
    where given, storage_path); the id is a hash of (storage_path, upload
    time), so a job that is run again with the same time has the same ids."""
    ts = uploaded_at or _now()
    path = (F.col("storage_path") if "storage_path" in files.columns
            else F.concat_ws("/", F.col(user_id_col).cast("string"), F.col("filename")))
    return files.select(
        F.sha2(F.concat_ws("|", path, F.lit(ts.isoformat())), 256).alias("id"),
        F.col(user_id_col).cast("string").alias("user_id"),
        F.col("filename"), path.alias("storage_path"),
        F.lit(ts).cast("timestamp").alias("uploaded_at"))


def shot_id(number: str) -> Column:
    """A shot's id: a hash of its session and its number."""
    return F.sha2(F.concat_ws("|", "session_id", F.col(number).cast("string")), 256)


def with_shot_ids(shots: DataFrame, key_cols: Sequence[str] = ("session_id",)) -> DataFrame:
    """Shot ids: a hash of the session and the row's place in the scan.  They
    are unique within a batch; a scan that is split otherwise gives others."""
    return shots.withColumn("id", F.sha2(F.concat_ws(
        "|", *[F.col(k).cast("string") for k in key_cols],
        F.monotonically_increasing_id().cast("string")), 256))


def shots_from_view(view: DataFrame) -> DataFrame:
    """Shots-table rows from a frame with user_id, session_id, club_type and
    the metrics (keys cast to string); ``row_number`` is the place in the scan, from
    which ``append_shots`` makes the ids of ``with_shot_ids``."""
    df = view.withColumn("user_id", F.col("user_id").cast("string")) \
             .withColumn("session_id", F.col("session_id").cast("string"))
    return df.withColumn("row_number", F.monotonically_increasing_id())


def users_frame(spark: SparkSession, user_ids: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(str(u),) for u in user_ids], "user_id string")
