"""Continuous session ingest: a file stream over a landing folder.

Layout: ``<landing>/<user_id>/<session file>.csv``.  Each micro-batch hands its
new files (bounded by ``maxFilesPerTrigger``) to the batch upload, all users in
one job.  The file source tracks processed files in the checkpoint.  A
replayed epoch has the same files, time and batch id and replaces itself; a
file that is uploaded anew (another name or time of change) is a new session.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shotspark.plans.ingest import folder_user, upload_sessions
from shotspark.sources.tables import Tables


def ingest_batch(spark: SparkSession, tables: Tables, files: DataFrame, epoch: str) -> int:
    """One micro-batch: ``files`` has path and changed (time of change).
    Returns rows imported."""
    # The files of one micro-batch, bounded by maxFilesPerTrigger.
    rows = files.select(F.url_decode("path").alias("path"), "changed").distinct().orderBy("path").collect()
    if not rows:
        return 0
    # The newest file's time: the same for a replay, another one for a new upload.
    when = max(r["changed"] for r in rows) or dt.datetime(1970, 1, 1)
    return upload_sessions(spark, tables, [r["path"] for r in rows], folder_user(), when, batch=epoch).rows_imported


def start_session_stream(spark: SparkSession, tables: Tables, landing: str, checkpoint: str,
                         max_files: int = 1000, available_now: bool = True) -> StreamingQuery:
    stream = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
              .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).load(landing)
              .select(F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("changed")))

    def run(batch: DataFrame, epoch_id: int) -> None:
        ingest_batch(spark, tables, batch, f"{stream_id(checkpoint)}-{epoch_id}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stream_id(checkpoint: str) -> str:
    """A name for the stream, so that epochs of two streams differ."""
    import hashlib
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
