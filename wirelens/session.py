"""Session settings shared by jobs, tests and the benchmark."""

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # call-site capture costs a JVM round trip per column expression; wide feature rows have hundreds
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(name="wirelens", master=None, shuffle_partitions=None, **extra) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster ``master`` and ``shuffle_partitions`` are left to spark-submit.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC; pin the session so epoch conversions agree everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Hand this package to the Python workers, for sessions not started with --py-files."""
    context = spark.sparkContext
    if not getattr(context, "_wirelens_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="run-")
        context.addPyFile(shutil.make_archive(
            os.path.join(folder, "wirelens"), "zip", os.path.dirname(here), os.path.basename(here)))
        context._wirelens_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees, as named by the cluster in spark.checkpoint.dir.

    A private folder is made only for local sessions that name none (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder path next to the checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left behind: plans, broadcast tables and shuffle files stay until the driver collects
    its garbage, and a driver that has room for it does not."""
    gc.collect()  # Python's references to the driver's objects
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration step reliably, so a lost executor never replays the whole loop."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
