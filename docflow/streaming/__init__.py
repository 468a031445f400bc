"""Arriving files as documents.

Reading and parsing documents are narrow operators, so they run unchanged on a stream of files; documents are
opened batch by batch, since how deep they nest is looked up first.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docflow.operators.leaves import leaves
from docflow.sources.files import LISTED


def stream_raw(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Files below `path` as they arrive: path, value, file_size, modified_at (see `read_raw`)."""
    reader = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", LISTED)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        "value",
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def stream_leaves(documents: DataFrame, write: Callable[[DataFrame, int], None], keep: list[str] | None = None) -> DataStreamWriter:
    """A stream writer that hands the leaves of every micro-batch of documents to `write(leaves, batch)`.

    Each batch is opened as deep as its documents are; `write` has to bear that a batch comes again after
    a failure, as with any batch sink.
    """
    return documents.writeStream.foreachBatch(lambda batch, number: write(leaves(batch, keep), number))
