"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Largest number of driver-built rows (grids, scenarios, cut points) that may be
# put into a plan as literals or broadcast.
MAX_LITERAL_ROWS = 10_000
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "riskframe", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects; on a cluster use your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the checkpoint folder of the session.

    Only in local mode, where every task shares the machine, an unset folder is replaced by
    a temporary one.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="riskframe-")
    return _LOCAL_DIRS[context.applicationId]


def durable(df: DataFrame, name: str = "step", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage (iterative fits, scored tables read many times) and survives the
    loss of executors, which cached blocks do not. With ``partition_by`` (a column of few
    values, such as a fold) readers that filter on it open only the files they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_together(spark: SparkSession, jobs: list[Callable], parallelism: int) -> list:
    """Run independent driver-side fits from a few threads so that their jobs overlap."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    start = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(start, jobs)


def require_small(rows: list, what: str, limit: int = MAX_LITERAL_ROWS) -> list:
    """Check the size of a driver-built list before it goes into a plan."""
    if not rows:
        raise ValueError(f"{what} must not be empty")
    if len(rows) > limit:
        raise ValueError(f"{what} has {len(rows)} rows, more than the limit of {limit}")
    return rows


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Needed only by the operators that run Python in tasks; a job submitted with
    ``--py-files`` has it already and loses nothing.
    """
    sc = spark.sparkContext
    if getattr(sc, "_riskframe_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="riskframe-"), "riskframe")
    sc.addPyFile(shutil.make_archive(target, "zip", root, "riskframe"))
    sc._riskframe_shipped = True
