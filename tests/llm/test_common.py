import time

from pyspark.sql import functions as F

from ledgerlens.llm import common


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def left(spark, before):
    """Shuffle files since `before`, once Spark has had time to delete them."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    return shuffle_files(spark) - before


def test_checkpoints_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    made = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 100).alias("k")).count()
    held = common.saved(made)
    assert not left(spark, before) and held.count() == made.count() == 100
    assert common.saved(made).agg(F.sum("count")).first()[0] == 5000
    assert spark.conf.get(common.FREED, "false") == "false"
