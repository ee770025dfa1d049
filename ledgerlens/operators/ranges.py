"""Orders over more rows than one task should hold: ranges that are computed once, and what lies ahead of each."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint in the folder that the session names in spark.checkpoint.dir.

    Only a session on one machine may do without that setting; its own folder is shared by all it has.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp())
    return df.checkpoint()


def dealt(rows: DataFrame, *order: str, part: str = "part") -> DataFrame:
    """rows dealt into ranges of the order, numbered in `part`.

    The ranges come from a sample, so a plan that computed them twice could cut differently each time; they
    are cut from their lineage, and whatever is derived from them agrees.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
