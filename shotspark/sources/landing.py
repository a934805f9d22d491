"""The landing zone: raw files as they were uploaded, the last write of a path wins (K1).

Rows are (storage_path, landed_at, content), partitioned by batch; content is the
file's bytes, so that what is read back is what was landed.  A batch that is run again
replaces itself (dynamic partition overwrite); an older version of a path stays until
``vacuum``.  Which versions a later one replaced is found from path and time alone; they
are counted, and while they are few (``session.FEW_ROWS``) sent to the contents, which
then are not shuffled.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.session import counted, send_package, shuffles_end_with_jobs
from shotspark.sources.csv_sessions import SOURCE, unpacked

_SCHEMA = "storage_path string, landed_at timestamp, content binary, batch string"


class Landing:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/landing"
        # ``ignore`` writes only where nothing is there yet.
        spark.createDataFrame([], _SCHEMA).write.mode("ignore").partitionBy("batch").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path).where("storage_path IS NOT NULL")

    def _put(self, rows: DataFrame) -> None:
        with shuffles_end_with_jobs(self.spark):
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
             .partitionBy("batch").parquet(self.path))

    def land(self, files: DataFrame, landed_at: dt.datetime, batch: str | None = None) -> None:
        """Keep ``files`` (storage_path or source_file, content) as of ``landed_at``."""
        path = "storage_path" if "storage_path" in files.columns else SOURCE
        self._put(files.select(F.col(path).alias("storage_path"), F.lit(landed_at).cast("timestamp").alias("landed_at"),
                               "content", F.lit(batch or uuid.uuid4().hex).alias("batch")))

    def batch(self, batch: str) -> DataFrame:
        return self._rows().where(F.col("batch") == batch).select("storage_path", "content")

    def _newest(self) -> DataFrame:
        """The place of each path's last version: of equal times the larger batch id."""
        return self._rows().groupBy("storage_path").agg(F.max(F.struct("landed_at", "batch")).alias("last")).select(
            "storage_path", "last.landed_at", "last.batch")

    def latest(self) -> DataFrame:
        """storage_path, landed_at and content of every path's last version."""
        key = ["storage_path", "landed_at", "batch"]
        replaced = self._rows().select(*key).distinct().join(self._newest(), key, "left_anti")
        return self._rows().join(counted(replaced), key, "left_anti").select("storage_path", "landed_at", "content")

    def lines(self) -> DataFrame:
        """storage_path, landed_at, number (from 0) and text of the last versions' lines."""
        text = F.regexp_replace(F.decode("content", "UTF-8"), "\\r\\n?", "\n")
        send_package(self.spark)
        latest = self.latest()
        return latest.mapInArrow(unpacked, latest.schema).select("storage_path", "landed_at", F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n"))
                                    .alias("number", "line"))

    def vacuum(self) -> None:
        """Drop versions that a later one replaced, by rewriting their batches; a batch
        of which nothing is left keeps one row of NULLs, which reads pass over."""
        old = self._rows().join(self._newest(), ["storage_path", "landed_at", "batch"], "left_anti").select("batch").distinct()
        old = old.checkpoint(eager=True)  # a row per batch
        keep = (self._rows().join(self._newest(), ["storage_path", "landed_at", "batch"], "left_semi")
                .join(old, "batch", "left_semi"))
        filler = old.selectExpr("CAST(NULL AS STRING) AS storage_path", "CAST(NULL AS TIMESTAMP) AS landed_at",
                                "CAST(NULL AS BINARY) AS content", "batch")
        self._put(keep.select("storage_path", "landed_at", "content", "batch").unionByName(filler))
