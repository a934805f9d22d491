"""Helpers shared by the llm operators: shared scratch tables, column picking,
ASCII lowering and word patterns."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.session import checkpoint_dir

# Fixed values of the contracts: ASCII white space and the letters lowered.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: Python tasks import
    it by name, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    name = pathlib.Path(tempfile.mkdtemp()) / "shotspark_package.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(name))
    context._llm_shipped = True


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns renamed by position, so that no input name can clash with an
    operator's own names; the second value restores the names."""
    ship(df.sparkSession)
    names = df.columns
    return df.toDF(*[f"_p{i}" for i in range(len(names))]), names


def position(names: list[str], wanted: str) -> str:
    """The positional name of column ``wanted``: the first exact match, else
    the first match without regard to case."""
    for i, n in enumerate(names):
        if n == wanted:
            return f"_p{i}"
    for i, n in enumerate(names):
        if n.lower() == wanted.lower():
            return f"_p{i}"
    raise ValueError(f"column {wanted!r} is missing; there are {names}")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the keyword's names."""
    p, names = positional(df)
    return p.select(*[F.col(position(names, col)).alias(key) for key, col in wanted.items()])


def restore(df: DataFrame, names: list[str], own: list[str]) -> DataFrame:
    """Input columns under their old names, then the operator's ``own``
    columns; an input column with the name of an own column gives way."""
    taken = {o.lower() for o in own}
    kept = [(f"_p{i}", n) for i, n in enumerate(names) if n.lower() not in taken]
    out = df.select(*[F.col(p) for p, _ in kept], *[F.col(o) for o in own])
    return out.toDF(*[n for _, n in kept], *own)


def lower_ascii(col: Column) -> Column:
    """A-Z lowered and nothing else.  ``lower`` does just that on texts whose
    characters are all single bytes; ``translate`` serves the others."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(id_col: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
