"""New files of a folder as a stream: each batch is inventoried and appended to a table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.sources.inventory import extension, reader


def inventory_stream(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends (path, size_bytes, sha256, extension, reader) of new files below `folder` to the Parquet table.

    Files that have been seen are known from the checkpoint; a batch that runs again replaces its own part.
    """
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), extension(F.col("path")).alias("extension"), reader(F.col("path")).alias("reader"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
