"""A folder as a stream of documents, and as polled batches for changed ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.plans.engine import Engine

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, pattern: str | None = None, once: bool = False):
    """Convert each new file of a folder; the query remembers by path what it has seen."""
    engine = Engine(spark)
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    stream = reader.load(folder).select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")

    def each(batch: DataFrame, number: int) -> None:
        sink(engine.convert(batch), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def changed_since(spark: SparkSession, folder: str, since: str) -> DataFrame:
    """Files that were written after a time, for those that a stream does not read again."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("modifiedAfter", since).load(folder)
    return found.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
