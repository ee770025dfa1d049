"""Helpers shared by the operators: tables, shared folders, lossless skew handling, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers live on from stage to stage. By default the C library raises the size from which freed blocks go back to the
# system with each larger block, and keeps what has been freed in between; fixed, a worker holds what it uses.
try:
    _C = ctypes.CDLL("libc.so.6")
    _C.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    _C.mallopt(-1, 1 << 18)  # M_TRIM_THRESHOLD
except (OSError, AttributeError):  # another C library
    pass

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: With this setting Spark deletes a query's shuffle files once it ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that one Arrow batch carries to Python; bounds a worker's memory on long texts.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; any other letter keeps its case."""
    return F.translate(text, UPPER, LOWER)


def free(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with so many underscores ahead that no column has it, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a session on one machine may do without that setting; its own folder is shared by all it has.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is derived and computed inside leaves no shuffle files. Only the session's own setting holds for the caller's queries."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame keeps the setting that it was derived under


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*saved_ones: DataFrame) -> None:
    """Deletes the checkpoints of frames from saved(). All that was derived from them must be saved or written already."""
    for df in saved_ones:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


def attach(big: DataFrame, small: DataFrame, key: str, copies: str, heavy: int = 100) -> DataFrame:
    """big left-joined to small, which has one row per key and, in `copies`, the number of rows in big of that key.

    A key with over 1/heavy of all rows counts as hot. There are at most `heavy` hot keys, whatever the
    data, so their rows of `small` are broadcast and big's rows of them stay where they are; the rest is
    an ordinary shuffled join. Null keys match nothing.
    """
    total = small.agg(F.sum(copies)).first()[0] or 0
    hot = small.where(F.col(copies) * heavy > total).drop(copies)
    rest = small.where(~(F.col(copies) * heavy > total)).drop(copies)
    marked = hot.select(F.col(key), F.lit(True).alias("_hot"))
    split = big.join(F.broadcast(marked), key, "left")
    here = split.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key, "left")
    there = split.where(F.col("_hot").isNull()).drop("_hot").join(rest, key, "left")
    return here.unionByName(there)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node, root the smallest node.

    Alternates large-star and small-star steps, each two shuffles of the edges, until the edges stay the
    same. Minima are combined before the shuffle, so a hub costs no more than its edges; each round is
    checkpointed, so a lost executor repeats one round at most.
    """
    now = saved(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    seen = None
    for _ in range(rounds):
        sign = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if sign == seen or not sign[0]:
            break
        seen = sign
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, now = now, saved(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        forget(before)
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
