"""Shots and sessions views over the driver's TPC-H-like tables.

One lineitem = one shot, one order = one session, one customer = one user.
Every metric is an integer divided by a power of two, so sums are exact in
any order.  The expressions are portable SQL: Spark evaluates them through
``selectExpr`` and the DuckDB oracle through the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.functions.expr import in_small_methods
from shotspark.session import shuffles_end_with_jobs
from shotspark.sources.sinks import GZIP

_NULL_KEY = "(l_orderkey + 3*l_partkey + l_suppkey) % {m} = 0"

# FIXED VALUES: (metric, null modulus, integer numerator, power-of-two divisor).
_METRIC_FORMULAS = [
    ("club_speed", 53, "8*(110 - 2*(l_partkey % 15)) + (l_orderkey + 5*l_suppkey) % 97 - 48", 8),
    ("attack_angle", 61, "(3*l_orderkey + l_suppkey) % 97 - 48", 8),
    ("club_path", 67, "(5*l_orderkey + l_partkey) % 129 - 64", 16),
    ("club_face", 71, "(7*l_orderkey + l_suppkey) % 129 - 64", 16),
    ("face_to_path", 59, "(3*l_orderkey + l_suppkey + l_linenumber) % 129 - 64 + 4*((l_partkey % 15) - 7)", 16),
    ("ball_speed", 73, "8*(155 - 4*(l_partkey % 15)) + (l_orderkey + 11*l_suppkey) % 113 - 56", 8),
    ("smash_factor", 79, "64 + (l_orderkey + l_partkey) % 33", 64),
    ("launch_angle", 83, "8*(10 + 2*(l_partkey % 15)) + (l_orderkey + 3*l_linenumber) % 65 - 32", 8),
    ("launch_direction", 47, "(7*l_suppkey + l_orderkey) % 161 - 80", 8),
    ("backspin", 89, "2200 + 500*(l_partkey % 15) + (13*l_orderkey + l_suppkey) % 801 - 400", 1),
    ("sidespin", 97, "(17*l_orderkey + l_partkey) % 1601 - 800", 1),
    ("spin_rate", 101, "2400 + 500*(l_partkey % 15) + (19*l_orderkey + l_suppkey) % 801 - 400", 1),
    ("spin_axis", 103, "(11*l_orderkey + 3*l_partkey) % 321 - 160", 8),
    ("apex_height", 107, "4*80 + (l_orderkey + 7*l_partkey) % 201 - 100", 4),
    ("carry_distance", 41, "4*(250 - 12*(l_partkey % 15)) + (7*l_orderkey + 3*l_partkey + CAST(l_quantity AS BIGINT)) % 161 - 80", 4),
    ("carry_deviation_angle", 109, "(l_orderkey + l_suppkey) % 129 - 64", 8),
    ("carry_deviation_distance", 43, "(13*l_orderkey + 3*l_partkey + 17*l_linenumber) % 321 - 160", 4),
    ("total_distance", 113, "4*(265 - 12*(l_partkey % 15)) + (7*l_orderkey + 3*l_partkey + 2*l_suppkey) % 181 - 90", 4),
    ("total_deviation_angle", 127, "(2*l_orderkey + l_suppkey) % 129 - 64", 8),
    ("total_deviation_distance", 131, "(13*l_orderkey + 5*l_partkey + 17*l_linenumber) % 361 - 180", 4),
]

# FIXED VALUES: part key modulo 15 -> club code (14 = no club).
_CLUB_CODES = ["D", "3W", "3H", "3i", "4i", "5i", "6i", "7i", "8i", "9i", "PW", "GW", "SW", "LW"]


def _club_sql() -> str:
    arms = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLUB_CODES))
    return f"CASE l_partkey % 15 {arms} ELSE NULL END AS club_type"


def _club() -> Column:
    """``_club_sql`` as one look-up, NULL outside the list, which also has the
    projection compiled in small methods."""
    return F.get(F.array(*[F.lit(c) for c in _CLUB_CODES]), (in_small_methods("l_partkey") % 15).cast("int"))


def _metric_sql(name: str, m: int, body: str, div: int) -> str:
    return (f"CASE WHEN {_NULL_KEY.format(m=m)} THEN NULL "
            f"ELSE CAST({body} AS DOUBLE) / CAST({div} AS DOUBLE) END AS {name}")


SHOT_SELECT = (["o_custkey AS user_id", "o_orderkey AS session_id", _club_sql()]
               + [_metric_sql(*f) for f in _METRIC_FORMULAS])

SHOTS_SQL = ("SELECT " + ",\n  ".join(SHOT_SELECT)
             + "\nFROM lineitem JOIN orders ON l_orderkey = o_orderkey")

SESSION_SELECT = [
    "o_orderkey AS id",
    "o_custkey AS user_id",
    "concat('session_', o_orderkey, '.csv') AS filename",
    "concat(o_custkey, '/session_', o_orderkey, '.csv') AS storage_path",
    "o_orderdate AS uploaded_at",
]
SESSIONS_SQL = "SELECT " + ", ".join(SESSION_SELECT) + " FROM orders"

#: Session files that one task writes, where there are more than shuffle partitions.
_FILES_A_TASK = 64

_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shots view: 20 metrics per lineitem, keyed by (user_id, session_id).

    The join to orders is an equi-join on the order key; Spark broadcasts
    orders only while its measured size is under the broadcast threshold and
    falls back to a sort-merge join beyond it.
    """
    li = table(spark, sf_dir, "lineitem").select(*_LINEITEM_COLS)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cols = [_club().alias("club_type") if s.endswith(" AS club_type") else F.expr(s) for s in SHOT_SELECT]
    return li.join(orders, li["l_orderkey"] == orders["o_orderkey"]).select(*cols)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*SESSION_SELECT)


def write_session_csvs(shots_df: DataFrame, out_dir: str, shots_per_file: int = 5000) -> list[str]:
    """Export shots as raw launch-monitor CSVs (Title Case header, a units
    row with an empty Player, one row per shot) in two header layouts:

    A: Player, User Id, Session Id, Club Type, metrics in file order.
    B: BOM + padded headers, reversed metric order, an extra Note column,
       NULL written as ``NA``.
    Users are split between the layouts by key parity; returns the two layouts'
    paths, whose names hold a blank.  Notes hold commas, doubled quotes and a line
    break.  The number of files follows the number of shots; a task writes several,
    each below a folder of its number, as a shuffle to one partition a file would
    have blocks by files times tasks.  The files are compressed (gzip).
    """
    spark = shots_df.sparkSession
    with shuffles_end_with_jobs(spark):
        files = max(2, -(-shots_df.count() // shots_per_file))
    parts = max(min(files, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-files // _FILES_A_TASK))
    from shotspark.schema import METRIC_TITLES

    def layout(df, cols, bom, null_value, path):
        data = df.select("_file", *[F.col(src).alias(c) for c, src in cols], F.lit(1).alias("_data"))
        units = spark.range(files).select(F.col("id").alias("_file"), *[F.lit(None).cast(data.schema[c].dataType).alias(c) for c, _ in cols],
                                          F.lit(0).alias("_data"))
        out = units.unionByName(data).repartition(parts, "_file").sortWithinPartitions("_file", "_data")
        # Text is made behind the shuffle, of whose bytes it would take twice as many.
        is_data, text_of = in_small_methods("_data") == 1, dict(zip([c for c, _ in cols], [None] * 3 + [""] + ["[u]"] * len(cols)))
        names = list(text_of)
        out = out.select("_file", *[F.when(is_data, F.col(c).cast("string")).otherwise(F.lit(u)).alias(c) for c, u in text_of.items()])
        if bom:
            names = ["\ufeff" + names[0]] + [f" {n} " if n == "Club Type" else n for n in names[1:]]
        with shuffles_end_with_jobs(spark):
            (out.toDF("file", *names)
                .write.mode("overwrite").partitionBy("file").option("header", True).option("nullValue", null_value)
                .option("escape", '"').options(**GZIP).csv(path))
        return f"{path}/file=*"

    base = shots_df.withColumn("_file", F.pmod(F.xxhash64("session_id"), F.lit(files)))
    keys = [("Player", "user_id"), ("User Id", "user_id"), ("Session Id", "session_id"), ("Club Type", "club_type")]
    metrics = [(t, s) for t, s in METRIC_TITLES]
    a = layout(base.where(F.pmod(F.col("user_id"), F.lit(2)) == 0), keys + metrics, False, "",
               f"{out_dir}/layout a")
    b_df = base.where(F.pmod(F.col("user_id"), F.lit(2)) == 1).withColumn(
        "_note", F.when(F.pmod(F.col("session_id"), F.lit(3)) == 0, F.lit('said "hi, there"\nand left')).otherwise(F.lit('a "b", c')))
    b = layout(b_df, keys + metrics[::-1] + [("Note", "_note")], True, "NA", f"{out_dir}/layout b")
    return [a, b]
