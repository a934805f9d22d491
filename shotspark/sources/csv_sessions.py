"""Raw launch-monitor session CSVs.

A session file is one practice session, so it is small and is read whole: one
``binaryFile`` scan gives a row per file, and an Arrow function parses header and
records of a file in pieces of some thousand rows.  Files may differ in header (order, extra or missing
columns); a cell is found by its file's own header, so there is no plan per layout
and no second scan.  Only ``read_raw``, whose columns are the headers' union, reads
the names first.  Task memory is the files' bytes and a piece of rows; ``max_bytes`` refuses
larger ones with their name (such a table is one for ``read_csv_table``).

Per file: first blank lines are skipped; header names are cleaned (blanks, BOM);
the units row is dropped (rows with an empty ``Player``, only when that column
exists); pandas' missing markers (``NA``, ``n/a``, ...) become NULL.  Quotes are
doubled inside quoted fields, which may hold line breaks, in the header too.  A row
longer than its header rejects the whole file (the reference refuses such a file);
shorter rows get trailing NULLs, blank lines are no rows.  A file may be compressed
with gzip (told by its first bytes, as pandas tells by the name); it is unpacked as
it is parsed.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from typing import Iterable, NamedTuple, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from shotspark.functions.expr import in_small_methods, null_if_na_text, to_double
from shotspark.operators.clean import clean_name, snake
from shotspark.schema import CLUB_TITLE, METRICS, NA_STRINGS, PLAYER_TITLE, SNAKE_TO_TITLE
from shotspark.session import send_package

SOURCE = "source_file"
LINE = "line"
MAX_BYTES = 256 << 20
_FILES = f"{SOURCE} string, content binary"
_ROWS_A_BATCH = 10_000
_MISSING = frozenset(NA_STRINGS)


class RawSessions(NamedTuple):
    rows: DataFrame        # raw strings under cleaned headers, plus source_file
    rejected: DataFrame    # source_file of files with a row longer than the header
    files: DataFrame       # source_file and header of every file with a header


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _missing(e: AnalysisException) -> bool:
    return (e.getCondition() or "") == "PATH_NOT_FOUND"


def _literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def session_files(spark: SparkSession, paths: str | Sequence[str], limit: int | None = None,
                  max_bytes: int = MAX_BYTES) -> DataFrame:
    """(source_file, content) per file; with ``limit`` the first files by path:
    the list of names is cut first, and only those files are opened."""
    try:
        scan = spark.read.format("binaryFile").load(_paths(paths))
        if limit is not None:
            # At most ``limit`` names; without the content column no file is read.
            first = scan.select("path").distinct().orderBy("path").limit(limit).collect()
            if not first:
                return spark.createDataFrame([], _FILES)
            scan = spark.read.format("binaryFile").load([_literal(r.path) for r in first])
    except AnalysisException as e:
        if not _missing(e):
            raise
        # S3: a missing session directory means no sessions, not an error.
        return spark.createDataFrame([], _FILES)
    path = F.col("_metadata.file_path")
    large = F.raise_error(F.concat(path, F.lit(f" has more than {max_bytes} bytes: not a session file")))
    return scan.select(path.alias(SOURCE), F.when(F.col("length") > max_bytes, large.cast("binary"))
                       .otherwise(F.col("content")).alias("content"))


def empty_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """source_file of files of no bytes, which a scan passes over: the files of the
    listing that the scan does not return."""
    try:
        scan = spark.read.format("binaryFile").load(_paths(paths))
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], f"{SOURCE} string")
    listed = spark.createDataFrame([(f,) for f in scan.inputFiles()], f"{SOURCE} string")
    tidy = F.regexp_replace(SOURCE, "^file:/+", "file:///")
    return listed.select(tidy.alias(SOURCE)).join(
        scan.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias(SOURCE)), SOURCE, "left_anti")


def unique_names(cells: Sequence[str]) -> list[str]:
    """Cleaned header names; a name that is taken gets the first free number behind it."""
    cells, out = [clean_name(n) for n in cells], []
    for n in cells:
        name, k = n, 2
        while name in out or (name != n and name in cells):
            name, k = f"{n}{k}", k + 1
        out.append(name)
    return out


def column_names(header: str) -> list[str]:
    """Cleaned names of a header line."""
    return unique_names(next(csv.reader([header]), []))


def _plain(content: pa.Buffer):
    """The file's bytes as a stream, unpacked if it is a gzip file (no text begins so)."""
    raw = pa.BufferReader(content)
    return pa.CompressedInputStream(raw, "gzip") if content.size > 1 and content.slice(0, 2).to_pybytes() == b"\x1f\x8b" else raw


def unpacked(batches):
    """The rows with their column ``content`` unpacked, a file at a time."""
    for batch in batches:
        k = batch.schema.get_field_index("content")
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            content = row.column(k)[0].as_buffer()
            whole = None if content is None else _plain(content).read()
            yield row.set_column(k, batch.schema.field(k), pa.array([whole], batch.schema.field(k).type))


def _records(content: pa.Buffer):
    """Header names of a file (None if it has none) and its rows (number, cells), which
    are decoded and parsed as they are taken."""
    csv.field_size_limit((1 << 31) - 1)
    text = io.TextIOWrapper(_plain(content), "utf-8-sig", "replace", newline="")
    rows = (r for r in csv.reader(text) if len(r) > 1 or (r and r[0].strip(" \t")))
    head = next(rows, None)
    return (None, ()) if head is None else (unique_names(head), enumerate(rows))


def _headers(batches):
    for batch in batches:
        found = [(f, _records(c.as_buffer())[0]) for f, c in zip(batch.column(0).to_pylist(), batch.column(1))]
        found = [(f, h) for f, h in found if h is not None]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()),
                                          pa.array([h for _, h in found], pa.list_(pa.string()))], names=[SOURCE, "header"])


def file_headers(files: DataFrame) -> DataFrame:
    """(source_file, header as a list of names) per file with a header."""
    send_package(files.sparkSession)
    return files.mapInArrow(_headers, f"{SOURCE} string, header array<string>")


def _place(names: list[str], wanted: str, loose: bool) -> int | None:
    """Where a column stands: by its name, or else (``loose``) by its snake_case form."""
    if wanted in names:
        return names.index(wanted)
    return next((k for k, n in enumerate(names) if snake(n) == snake(wanted)), None) if loose else None


def _cells(wanted: list[str], loose: bool):
    """Rows of files: the file, the row's number in it, whether the file is rejected,
    and the wanted columns as text.  A rejected file gives one row."""
    fields = [SOURCE, LINE, "rejected", *[f"c{i}" for i in range(len(wanted))]]

    def batch_of(source, rows, places, rejected=False):
        if rows and min(len(r) for _, r in rows) > max((p for p in places if p is not None), default=0):
            cells = list(zip(*(r for _, r in rows)))  # no short row: transposed at once
            cols = [pa.nulls(len(rows), pa.string()) if p is None else pa.array(cells[p], pa.string()) for p in places]
        else:
            cols = [pa.array([r[p] if p is not None and p < len(r) else None for _, r in rows], pa.string()) for p in places]
        return pa.RecordBatch.from_arrays([pa.array([source] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()),
                                           pa.array([rejected] * len(rows), pa.bool_()), *cols], names=fields)

    def run(batches):
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, rows = _records(content.as_buffer())
                if names is None:
                    continue
                rows = iter(rows)
                some = list(itertools.islice(rows, _ROWS_A_BATCH))
                long = len(some) == _ROWS_A_BATCH
                # Whether a file is rejected is known at its end: one longer than a piece is parsed twice, its rows not kept.
                if any(len(r) > len(names) for _, r in some) or (long and any(len(r) > len(names) for _, r in rows)):
                    yield batch_of(source, [(0, [])], [None] * len(wanted), True)
                    continue
                places = [_place(names, w, loose) for w in wanted]
                rows = iter(_records(content.as_buffer())[1] if long else some)
                if PLAYER_TITLE in names:
                    p = names.index(PLAYER_TITLE)
                    rows = ((n, r) for n, r in rows if p < len(r) and r[p] not in _MISSING)
                while some := list(itertools.islice(rows, _ROWS_A_BATCH)):
                    yield batch_of(source, some, places)

    return run


def parse_files(files: DataFrame, columns: Sequence[str], loose: bool = False) -> DataFrame:
    """source_file, line, rejected and ``columns`` (text, NULL where a file lacks the
    column or holds a missing marker) of all rows of ``files`` (source_file, content).
    ``loose`` also takes a column whose name differs in case or underscores."""
    send_package(files.sparkSession)
    columns = list(columns)
    schema = T.StructType([T.StructField(SOURCE, T.StringType()), T.StructField(LINE, T.LongType()),
                           T.StructField("rejected", T.BooleanType()),
                           *[T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))]])
    out = files.select(SOURCE, "content").mapInArrow(_cells(columns, loose), schema)
    return out.select(SOURCE, LINE, "rejected", *[null_if_na_text(F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)])


def read_raw(spark: SparkSession, paths: str | Sequence[str], limit: int | None = None) -> RawSessions:
    """All session files as one raw frame of strings, with the union of their
    columns in order of first appearance by path.  The headers are read first, since
    they are the schema; of all files only the distinct headers come to the driver."""
    files = session_files(spark, paths, limit)
    heads = file_headers(files)
    layouts = heads.groupBy("header").agg(F.min(SOURCE).alias("first")).orderBy("first").collect()
    names = list(dict.fromkeys(n for r in layouts for n in r["header"]))
    parsed = parse_files(files, names)
    rejected = parsed.where("rejected").select(SOURCE)
    return RawSessions(parsed.where("NOT rejected").drop("rejected", LINE), rejected, heads)


def read_raw_sessions(spark: SparkSession, paths: str | Sequence[str], limit: int | None = None,
                      with_rejected: bool = False):
    """The rows of ``read_raw``; ``with_rejected=True`` also returns the
    rejected files."""
    raw = read_raw(spark, paths, limit)
    return (raw.rows, raw.rejected) if with_rejected else raw.rows


def typed_shots(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """K3 projection: snake_case club_type + 20 metrics as double (absent
    columns typed NULL), bad text -> NULL; ``keep`` extra raw columns."""
    by_snake = {snake(c): c for c in raw.columns}
    cols = [F.col(f"`{by_snake['club_type']}`").alias("club_type") if "club_type" in by_snake
            else F.lit(None).cast("string").alias("club_type")]
    cols[0] = in_small_methods(cols[0]).alias("club_type")
    for m in METRICS:
        cols.append(to_double(F.col(f"`{by_snake[m]}`")).alias(m) if m in by_snake
                    else F.lit(None).cast("double").alias(m))
    extra = [F.col(f"`{by_snake.get(k, k)}`").alias(k) for k in keep]
    return raw.select(*extra, *cols)


def shots_of_files(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed shots of ``files`` (source_file, content) in one scan: source_file,
    line, rejected, the raw columns ``keep``, club type and metrics."""
    titles = [CLUB_TITLE, *[SNAKE_TO_TITLE[m] for m in METRICS]]
    parsed = parse_files(files, [*dict.fromkeys([*keep, *titles])], loose=True)
    return typed_shots(parsed, keep=[SOURCE, LINE, "rejected", *keep])


def read_sessions(spark: SparkSession, paths: str | Sequence[str], limit: int | None = None,
                  keep: Iterable[str] = (SOURCE,)) -> DataFrame:
    """Typed shots straight from session CSVs, one scan of the files."""
    keep = list(keep)
    own = {SOURCE, LINE}
    out = shots_of_files(session_files(spark, paths, limit), [k for k in keep if k not in own])
    return out.where("NOT rejected").select(*[F.col(f"`{k}`") for k in keep], "club_type", *METRICS)


def concat_sessions(spark: SparkSession, frames: Iterable[DataFrame | None]) -> DataFrame:
    """Union by name with outer columns; None frames skipped (no row
    count is taken); no frame at all gives an empty one."""
    out = None
    for f in frames:
        if f is None:
            continue
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return spark.createDataFrame([], T.StructType([])) if out is None else out


def merge_stats(raw: DataFrame) -> DataFrame:
    """Files merged and rows merged, from one aggregate."""
    return raw.agg(F.countDistinct(SOURCE).alias("files"), F.count(F.lit(1)).alias("rows"))
