"""CSV sinks (K9-K11) and the named-dataset registry."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shotspark.functions.expr import null_if_na_text, to_double
from shotspark.operators.clean import clean_headers
from shotspark.operators.ordering import positions
from shotspark.session import shuffles_end_with_jobs

# FIXED VALUES: the named CSV datasets and their file names.
DATASETS = {
    "avg_carry_yds": "avg_carry_yds.csv",
    "total_merged_yds": "total_merged_yds.csv",
    "club_summary": "club_summary.csv",
    "face_variance_by_club": "face_variance_by_club.csv",
    "club_carry_averages": "club_carry_averages.csv",
    "club_combined_shots_gained": "club_combined_shots_gained.csv",
}


#: Writer options of compressed CSV: this level takes a fourth of the default one's time and a twentieth more bytes.
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}


@dataclass(frozen=True)
class Registry:
    data_dir: str

    def path(self, name: str) -> str:
        if name not in DATASETS:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
        return f"{self.data_dir.rstrip('/')}/{DATASETS[name]}"


def read_csv_table(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A header CSV (file or directory of part files); headers cleaned.
    Missing-value markers become NULL; with ``infer``, a column whose other
    values are all numbers is a number (one aggregate over the table).  A
    missing path raises FileNotFoundError."""
    try:
        df = (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
              .option("encoding", "UTF-8").csv(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"no CSV table at {path}") from e
        raise
    df = clean_headers(df)
    df = df.select(*[null_if_na_text(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if not infer or not df.columns:
        return df
    bad = df.agg(*[F.count(F.when(to_double(F.col(f"`{c}`")).isNull(), F.col(f"`{c}`"))).alias(f"b{i}")
                   for i, c in enumerate(df.columns)],
                 *[F.count(F.when(~F.col(f"`{c}`").rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.col(f"`{c}`"))).alias(f"w{i}")
                   for i, c in enumerate(df.columns)],
                 *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    typed = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        if bad[f"n{i}"] and not bad[f"w{i}"]:
            x = F.trim(x).cast("int")
        elif bad[f"n{i}"] and not bad[f"b{i}"]:
            x = to_double(x)
        typed.append(x.alias(c))
    return df.select(*typed)


def load(spark: SparkSession, name: str, path: str | None = None, data_dir: str = "data") -> DataFrame:
    """One loader over the registry; ``path`` overrides the default."""
    return read_csv_table(spark, path or Registry(data_dir).path(name))


def write_csv(df: DataFrame, path: str, single_file: bool = False, options: dict | None = None) -> str:
    """Header CSV, no index column, one directory per table.

    ``single_file`` coalesces to one part file; only for small results
    (per-club summaries), never for shot-level tables.  ``options`` are the
    writer's, like ``GZIP``.
    """
    out = df.coalesce(1) if single_file else df
    with shuffles_end_with_jobs(df.sparkSession):
        out.write.mode("overwrite").options(**options or {}).option("header", True).csv(path)
    return path


def write_merged_csv(df: DataFrame, path: str, order: Sequence[Column], index: str = "row_index",
                     options: dict | None = None) -> str:
    """Header CSV with a first column numbering the rows 0..n-1 by ``order``; the rows'
    place in the part files is any."""
    numbered = positions(df, order, name=index)
    return write_csv(numbered.select(index, *[F.col(f"`{c}`") for c in df.columns]), path, options=options)


def save_deliverables(delivs, out_dir: str) -> dict[str, str]:
    """K9: the three deliverables as CSV directories; returns name -> path."""
    out = {}
    for name in ("club_summary", "face_variance_by_club", "club_carry_averages"):
        out[name] = write_csv(getattr(delivs, name), f"{out_dir.rstrip('/')}/{name}.csv")
    return out
