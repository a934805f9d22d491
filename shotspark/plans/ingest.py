"""Session upload as a batch job (K1-K3): many CSV files of many users in one job."""

from __future__ import annotations

import datetime as dt
import hashlib
from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.operators.clean import snake
from shotspark.sources.csv_sessions import LINE, SOURCE, _paths, empty_files, session_files, shots_of_files
from shotspark.sources.landing import Landing
from shotspark.sources.tables import Tables, session_rows


class Upload(NamedTuple):
    """What became of the files of one upload."""

    counts: DataFrame      # user_id, session_id, source_file, rows_imported
    rejected: DataFrame    # source_file of files with over-long rows
    empty: DataFrame       # source_file of files without a shot, zero bytes included
    rows_imported: int     # counted while the shots were written
    files_imported: int    # files with a shot, counted likewise


def folder_user() -> Column:
    """The user of a file in ``<landing>/<user_id>/<file>``."""
    return F.url_decode(F.element_at(F.split(F.col(SOURCE), "/"), -2))


def upload_sessions(spark: SparkSession, tables: Tables, paths: str | Sequence[str], user: Column | str,
                    uploaded_at: dt.datetime, batch: str | None = None, keep: Sequence[str] = (),
                    landing: Landing | None = None) -> Upload:
    """Land session files: each becomes one session of its user.

    ``user`` is a column over ``source_file`` and the raw columns ``keep`` (or one
    user's id), ``uploaded_at``
    the time of the batch, given by the caller: the same files uploaded at
    another time are new sessions, the same batch run again replaces itself
    (shots and sessions carry its ``batch`` id).  The session id is a hash of
    the file's full path and that time, a shot's id of the session and the row's
    number in its file.  The files are scanned and parsed once, into the batch's
    partition of shots; with ``landing`` the raw files are kept there first and
    parsed from there.
    """
    name = batch or hashlib.sha256(f"{uploaded_at.isoformat()}|{'|'.join(sorted(_paths(paths)))}".encode()).hexdigest()[:32]
    files = session_files(spark, paths)
    if landing is not None:
        landing.land(files, uploaded_at, batch=name)
        files = landing.batch(name).withColumnRenamed("storage_path", SOURCE)
    owner = (F.lit(user) if isinstance(user, str) else user).cast("string")
    session_id = F.sha2(F.concat_ws("|", F.col(SOURCE), F.lit(uploaded_at.isoformat())), 256)
    parsed = shots_of_files(files, keep).withColumnsRenamed({k: snake(k) for k in keep})
    shots = (parsed.where("NOT rejected").withColumn("user_id", owner).withColumn("session_id", session_id)
             .withColumn("row_number", F.col(LINE)))
    done = tables.append_shots(shots, batch=name, landed_at=uploaded_at)
    landed = (tables.batch("shots", name).groupBy("user_id", "session_id")
              .agg(F.count(F.lit(1)).alias("rows_imported")))
    every = files.select(SOURCE).withColumn("session_id", session_id)
    counts = landed.join(every, "session_id").select("user_id", "session_id", SOURCE, "rows_imported")
    sessions = counts.select("user_id", F.url_decode(F.element_at(F.split(F.col(SOURCE), "/"), -1)).alias("filename"),
                             F.col(SOURCE).alias("storage_path"))
    made = tables.append_sessions(session_rows(sessions, uploaded_at=uploaded_at), batch=name)
    rejected = parsed.where("rejected").select(SOURCE)
    empty = (every.select(SOURCE).join(counts.select(SOURCE), SOURCE, "left_anti").join(rejected, SOURCE, "left_anti")
             .unionAll(empty_files(spark, paths)))
    return Upload(counts, rejected, empty, done["rows"], made["rows"])


def ingest_sessions(spark: SparkSession, tables: Tables, paths: str | Sequence[str], user_id: str,
                    uploaded_at: dt.datetime | None = None) -> dict:
    """``upload_sessions`` for one user; raises if no file has a shot."""
    ts = uploaded_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    done = upload_sessions(spark, tables, paths, user_id, ts)
    rows = done.rows_imported
    if not rows:
        raise ValueError("no shots in the uploaded files")
    return {"rows_imported": rows, "rejected_files": done.rejected, "empty_files": done.empty}


def ingest_frame(tables: Tables, shots: DataFrame, sessions: DataFrame) -> None:
    """Append already-typed shots (with id or row_number, session_id, user_id) and sessions."""
    tables.append_shots(shots)
    tables.append_sessions(sessions)
