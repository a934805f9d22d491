"""Session construction for local runs, tests and the bench.

On a cluster the session comes from the platform; library code leaves its
configuration as it is, but for one setting while it writes
(``shuffles_end_with_jobs``).  ``get_spark`` is only a convenience for local
runs and only fills in settings that are still unset.
"""

from __future__ import annotations

import contextlib
import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults for local runs.  AQE coalesces the post-shuffle partitions and
# splits skewed join partitions at run time; the shuffle partition count is
# the *upper* bound AQE coalesces from.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide projections under ANSI mode generate methods above HotSpot's
    # 8000-byte JIT limit; without this flag they run interpreted (measured
    # 4.4 s -> 1.0 s on the 20-metric shots projection at sf0.1).  Set the
    # same flag on executors of a real cluster.
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "shotspark", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus) * 2)
    conf["spark.driver.memory"] = os.environ.get("SHOTSPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a session on a ``local`` master gets a scratch folder when it names
    none; on a cluster each executor would write to its own disk, so there a
    missing setting raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="shotspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: Spark's setting that a query's shuffle files go when it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A frame of at most so many narrow rows may be broadcast.
FEW_ROWS = 200_000


@contextlib.contextmanager
def shuffles_end_with_jobs(spark: SparkSession):
    """Inside, the shuffle files of a query that is run are removed as it ends, not
    when the driver happens to collect its garbage: a job of several writes then needs
    disk for one write's shuffles.  Lazy frames made inside are not touched."""
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def counted(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df`` written once (checkpoint) and, if it has at most ``most`` rows, marked to
    be broadcast, so that wide rows joined with it are not shuffled.  With more rows
    Spark joins as it does without the mark."""
    checkpoint_dir(df.sparkSession)
    with shuffles_end_with_jobs(df.sparkSession):
        df = df.checkpoint(eager=True)
    return F.broadcast(df) if df.count() <= most else df


def send_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once a session: Arrow functions
    are found there by name.  Only the driver reads the zip's folder."""
    context = spark.sparkContext
    if getattr(context, "_shotspark_sent", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    name = pathlib.Path(tempfile.mkdtemp()) / "shotspark_core.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(name))
    context._shotspark_sent = True
