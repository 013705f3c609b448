"""Watching a folder: new files are sniffed, decoded and handed on as they come.

Spark's file source reads each path once; a file that changes under its name isn't read again, so changed files need new names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.office import parse_files

#: Largest file that is taken (fixed value), and files of a batch.
MOST_BYTES, AT_ONCE = 500 << 20, 3
FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, glob: str = "*", at_once: int = AT_ONCE) -> DataFrame:
    """A stream of decoded files; empty and too large ones are passed over."""
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(folder)
    )
    return parse_files(files.where((F.col("length") > 0) & (F.col("length") <= MOST_BYTES)))


def run(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Hands each batch to handle(rows, number). once: what is there now, then an end."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own, so that a batch that is tried again replaces itself."""

    def handle(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle
