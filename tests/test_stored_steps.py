"""What a stored step leaves behind."""

from pyspark.sql import functions as F

from thermocline.session import SHUFFLE_CLEANUP_CONF, materialize


def shuffle_files(spark):
    """Bytes of shuffle files that the block manager of this process holds."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(blocks.apply(i).length() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_"))


def test_a_stored_step_leaves_no_shuffle_files(spark):
    rows = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    stored = materialize(rows.repartition("k"), "stored-step")
    assert shuffle_files(spark) <= before
    assert stored.count() == 200_000 and spark.conf.get(SHUFFLE_CLEANUP_CONF, None) == setting


def test_a_frame_with_shuffles_is_read_after_it_was_stored(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    first = sorted(counted.collect())
    assert sorted(materialize(counted, "counted").collect()) == first == sorted(counted.collect())
