"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group, which a writing task holds in memory.
ROW_GROUP = 16 << 20

_written: dict[str, list[str]] = {}
#: Paths taken since the innermost result() began.
_inside: ContextVar[list[str] | None] = ContextVar("inside", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder, in local mode only: on a cluster no local folder would do."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    try:
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is over and took its gateway along; the folder stays
        return


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs whose results are staged: it acts on what two collections find unused."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is taken by nothing else and deleted when the Python process ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/quire-{app}/{name}-{uuid.uuid4().hex}"
    if app not in _written:
        _written[app] = []
        atexit.register(_delete, spark, _written[app])
    _written[app].append(path)
    if (inside := _inside.get()) is not None:
        inside.append(path)
    return path


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs only a re-read.

    The files stay until the Python process ends, since results may still be read from them. free: what df shuffled is large and goes at once.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    if free:
        del df  # it holds on to its shuffles
        release(spark)
    return spark.read.schema(schema).parquet(path)


def result(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s DataFrame, staged. What else was staged meanwhile is deleted, so nothing but the result may read it later."""
    outer, inside = _inside.get(), []
    token = _inside.set(inside)
    try:
        found = stage(make(), name, free=True)
    finally:
        _inside.reset(token)
    *spent, own = inside  # stage() takes its path after all others
    if outer is not None:
        outer.append(own)
    _delete(found.sparkSession, spent)
    return found


def drop(df: DataFrame) -> None:
    """Deletes the folder of a staged DataFrame that nothing will read again."""
    folders = {x.rsplit("/", 1)[0] for x in df.inputFiles()}
    _delete(df.sparkSession, sorted(folders))


def give_back() -> None:
    """Has this process give back the memory it holds in reserve: workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, for mapInArrow, after which give_back() is called."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def bound_batches(spark: SparkSession) -> None:
    """Has Spark hand Python at most 2,048 rows and about 8 MB at once, which bounds the memory of both sides whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2048)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def partitions_for(spark: SparkSession, nbytes: float, each: int = 16 << 20) -> int:
    """So many partitions that each gets about `each` bytes, and no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(nbytes // each) + 1)
