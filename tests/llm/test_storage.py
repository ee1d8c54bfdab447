from pyspark.sql import functions as F

from responsa.llm import common


def test_stored_rows_are_read_in_partitions_by_size(spark):
    """A few rows that a shuffle dealt out over many partitions cost no task for each of these when they are read again."""
    few = common.cut(spark.range(0, 1000, 1, 50))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert few.agg(F.sum("id")).first()[0] == 499_500
    many = common.cut(spark.range(0, 400_000, 1, 50).withColumn("x", F.sha2(F.col("id").cast("string"), 256)))
    assert spark.sparkContext.defaultParallelism < many.rdd.getNumPartitions() < 50
    assert many.distinct().count() == 400_000
    one = common.cut(spark.range(0, 10, 1, 1))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 10


def test_executors_give_memory_back(spark):
    """pipeline: relieve() collects garbage in the JVMs that run tasks."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans)
    before = count()
    common.relieve(spark)
    assert count() >= before + 2  # one by tasks, one by the driver, here in one JVM
