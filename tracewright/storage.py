"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []
_RUN: ContextVar[list[list[str]]] = ContextVar("tables of the runs around", default=[])
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Java never compiles a method of more bytes than this, and runs it tens of times as slowly; Spark then generates smaller ones.
METHOD, BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def shared_folder(spark: SparkSession) -> str:
    """This application's part of spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a master of one machine (tests); any other
    master is refused, as its executors would not see the driver's disk.
    """
    app = spark.sparkContext.applicationId
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tracewright-"))
    return f"{folder.rstrip('/')}/{app}"


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers look for this package where the driver found it, if they see that folder.

    A cluster whose machines don't gets the package by --py-files or its image instead. Where the cluster says
    nothing else, Arrow batches hold 2,000 rows, as a batch of long texts stands in memory several times, and generated
    methods that Java would only interpret (joins with long conditions) are split.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root
    if spark.sparkContext.getConf().get(BATCH, None) is None:
        spark.conf.set(BATCH, "2000")
    if spark.sparkContext.getConf().get(METHOD, None) is None:
        spark.conf.set(METHOD, BYTES)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that no frame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def gathered(df: DataFrame, rows: int, per_file: int = 100_000, for_core: int = 2) -> DataFrame:
    """df in as many partitions as give files of per_file rows, but no fewer than for_core for each core and no more than it has."""
    return df.coalesce(max(for_core * df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_file)))


def few_files(df: DataFrame, target: int = 64 << 20, for_core: int = 2) -> DataFrame:
    """df in partitions of about target bytes read, where it is a plan without a shuffle and the session deals out smaller ones."""
    spark = df.sparkSession
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if size >= target or "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    parts = df.rdd.getNumPartitions()
    return df.coalesce(max(for_core * spark.sparkContext.defaultParallelism, -(-parts * size // target)))


def _note(path: str) -> None:
    for made in (_MADE, *_RUN.get()):
        made.append(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder where nothing stands yet; drop_tables() deletes it too."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _note(path)
    return path


def cut(df: DataFrame, name: str, codec: str = "zstd", free: bool = True, rows: int | None = None, per_file: int = 250_000, for_core: int = 1) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    free drops the shuffle files behind it at once; loops over small tables leave that to the cleaner.
    rows, where the caller knows how many there are at most, saves small files: tasks are joined until
    each writes per_file of them, though never to fewer than for_core tasks for each core.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if rows is not None:
        df = gathered(df, rows, per_file, for_core)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    _note(path)
    del df
    if free:
        release(spark)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    for made in (_MADE, *_RUN.get()):
        with suppress(ValueError):
            made.remove(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables that cut() has written, once nothing will read them again."""
    for df in frames:
        _delete(df.sparkSession, df.cut_path)


@contextmanager
def tables_of_run() -> Iterator[list[str]]:
    """The paths of the tables that this thread cuts inside the block: those of a run that goes on beside others in threads of their own."""
    own: list[str] = []
    token = _RUN.set([*_RUN.get(), own])
    try:
        yield own
    finally:
        _RUN.reset(token)


def drop_run(spark: SparkSession, own: list[str], *kept: DataFrame) -> None:
    """Delete the tables of a run but those kept: what a finished step leaves behind."""
    keep = {df.cut_path for df in kept}
    for path in [p for p in own if p not in keep]:
        _delete(spark, path)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that this application has cut; results that still read them are lost."""
    _delete(spark, shared_folder(spark))
    _MADE.clear()
