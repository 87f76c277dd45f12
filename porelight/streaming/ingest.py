"""Files that keep arriving, decoded into the logical tables as they come."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from porelight.sources.reads import load


def stream_table(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 1000):
    """A stream of one logical table from the files of a folder."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return load(found.select(F.xxhash64("path").cast("string").alias("file_id"), "path", "content"), table)


def ingest(spark: SparkSession, folder: str, table: str, out: str, checkpoint: str, files_per_trigger: int = 1000):
    """Appends the table of all new files to a Parquet folder and stops; run it again for the next ones. Each file is taken once."""
    rows = stream_table(spark, folder, table, files_per_trigger)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
