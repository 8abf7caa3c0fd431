"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kinweave", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only a session whose driver and tasks are one process may do without the setting; it gets a new
    folder. Anywhere else a missing setting is an error, because files on one machine are lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kinweave-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


_working: dict[str, list[str]] = {}


def working_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what a job writes on its way."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _working.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_working(spark: SparkSession) -> None:
    """Remove the working files of this session, once the results of its jobs are stored elsewhere."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in _working.pop(spark.sparkContext.applicationId, []):
        path = hadoop.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, in one pass, and stays columnar, so later steps prune
    columns. The files outlive any executor; ``clear_working`` removes them.
    """
    path = working_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets where a table is dealt out anew.
SPREAD_ROWS = 1 << 14


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` dealt out evenly, ``rows`` a task.

    A file of few bytes or few row groups is read by few tasks, however many rows it has; what is costly to
    make from its rows then waits for those tasks.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > 1 else df


#: Bytes of shuffled rows up to which Spark puts the tasks of a join or an aggregation together.
TOGETHER = 4 << 20


def bounded_tasks(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df``, whose session deals joins and aggregations out to at least one task for ``rows`` rows of it.

    A fixed number of tasks gets more rows each, and needs more memory, the larger the tables are. A
    setting of the session for more or smaller tasks stays. Spark reads it where a job is planned, so it
    is kept on.
    """
    conf = df.sparkSession.conf
    parts = -(-df.count() // rows)
    if parts > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", str(parts))
        conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TOGETHER))
    return df


#: Bytes in memory that a byte of a working table's file may stand for.
UNPACKED = 32
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def unpacked(job: Callable) -> Callable:
    """``job`` of a registry whose joins are planned with files at ``UNPACKED`` times their bytes.

    Working tables repeat names, dates and keys, so a file below Spark's limit for broadcasts may be
    hundreds of MB in the driver's memory. The session's own setting is back when the job returns.
    """
    @wraps(job)
    def run(registry, *args, **kwargs):
        conf = registry.spark.conf
        before = conf.get(_FACTOR)
        conf.set(_FACTOR, str(max(float(before), UNPACKED)))
        try:
            return job(registry, *args, **kwargs)
        finally:
            conf.set(_FACTOR, before)

    return run


def cut(df: DataFrame) -> DataFrame:
    """``stage`` for the working tables of iterative jobs."""
    return stage(df, "cut")
