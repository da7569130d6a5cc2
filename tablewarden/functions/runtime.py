"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own, which goes when the program ends.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    folder = tempfile.mkdtemp(prefix="tablewarden-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder, for inputs that several passes read
    and that would otherwise repeat a shuffle or a model scoring per pass."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


PARALLEL_JOBS = 4


def together(*calls: Callable) -> list:
    """Results of independent calls whose Spark jobs may run side by side."""
    if len(calls) < 2:
        return [c() for c in calls]
    session = SparkSession.getActiveSession()
    carry = inheritable_thread_target if session is None else inheritable_thread_target(session)
    with ThreadPoolExecutor(min(PARALLEL_JOBS, len(calls))) as pool:
        return [f.result() for f in [pool.submit(carry(c)) for c in calls]]


# Rows of a task whose work is heavy per row.
TASK_ROWS = 250_000


def heavy_tasks(spark: SparkSession, rows: int) -> int:
    """Number of tasks for ``rows`` rows of heavy work: it grows with the rows, and no core stays idle."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _tasks_if_uneven(df: DataFrame) -> int | None:
    """Tasks over which to deal rows of which some partition holds far more than its share. What counts is where the rows
    are: files with few row groups give many partitions, most of them empty. The driver receives one count per partition."""
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    tasks = heavy_tasks(df.sparkSession, sum(held))
    return tasks if held and max(held) > 2 * max(1, sum(held) // tasks) else None


def spread_out(stored: DataFrame) -> DataFrame:
    """Deal stored rows evenly over ``heavy_tasks`` partitions, unless none holds far more than its share."""
    tasks = _tasks_if_uneven(stored)
    return stored if tasks is None else materialize(stored.repartition(tasks))


def stored_evenly(df: DataFrame, source: DataFrame) -> DataFrame:
    """Store ``df``, made row by row from ``source``, in even partitions. Rows of a source in few partitions are dealt out
    before they are stored, so that no task writes and rereads them all."""
    tasks = _tasks_if_uneven(source)
    if tasks is None:
        return spread_out(materialize(df))
    return materialize(df.repartition(tasks, F.rand(tasks)))


def task_buckets(spark: SparkSession) -> int:
    """Number of value ranges that an ordered computation is split into."""
    return max(8, min(2000, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
