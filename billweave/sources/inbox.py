"""The inbox folder as a stream of files with their hashes.

Spark's file sources leave out names starting with a dot or underscore; the
rules for those work on an inventory table (see ``operators.ingest``).
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from billweave.operators.ingest import content_hash

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _rows(files: DataFrame) -> DataFrame:
    return files.select(
        F.url_decode(F.regexp_extract("path", r"[^/]*\z", 0)).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
        content_hash(F.col("content")).alias("hash"),
    )


def stream_inbox(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder))
