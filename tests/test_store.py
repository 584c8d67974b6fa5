"""Stored planes follow what their inputs hold."""

import pytest
from pyspark.sql import functions as F

from wayfold import store


def test_fingerprint_is_of_rows_alone(spark):
    df = spark.createDataFrame([(1, "a", None, {"k": 1}), (2, None, 0.5, None), (2, None, 0.5, None)], "i long, s string, d double, m map<string,int>")
    same = store.fingerprint(df)
    assert store.fingerprint(df.repartition(3).orderBy(F.desc("i"))) == same
    other = [df.limit(2), df.withColumn("i", F.col("i") + 1), df.withColumnRenamed("s", "t"), df.limit(0), df.withColumn("s", F.coalesce("s", F.lit(""))), df.select("i", F.col("d").cast("string").alias("s"), F.lit(None).cast("double").alias("d"), "m")]
    assert len({same, *map(store.fingerprint, other)}) == 7


def test_an_overwritten_file_makes_another_plane_and_an_equal_one_does_not(spark, tmp_path):
    path, built = f"{tmp_path}/t.parquet", []
    sums = lambda: spark.read.parquet(path).agg(F.sum("id").alias("s"))
    read = lambda: store.once(spark, "sums", [path], lambda: built.append(1) or sums()).first().s
    spark.range(3).coalesce(1).write.parquet(path)
    assert (read(), read(), len(built)) == (3, 3, 1)
    spark.range(3).repartition(2).write.mode("overwrite").parquet(path)
    assert (read(), len(built)) == (3, 1)
    spark.range(10, 13).coalesce(1).write.mode("overwrite").parquet(path)
    assert (read(), len(built)) == (33, 2)


def test_a_table_of_one_file_is_known_by_its_size_and_time(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = f"{tmp_path}/one.parquet"
    pq.write_table(pa.table({"id": [1, 2]}), path)
    first = store.contents(spark, path)
    assert store.contents(spark, path) == first
    pq.write_table(pa.table({"id": [2, 1]}), path, compression="none")
    assert store.contents(spark, path) == first
    pq.write_table(pa.table({"id": [1, 2, 3]}), path)
    assert store.contents(spark, path) != first


def test_planes_that_were_removed_are_built_again(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(4).write.parquet(path)
    build = lambda: spark.read.parquet(path).agg(F.count("*").alias("n"))
    assert store.once(spark, "n", [path], build).first().n == 4
    (where,) = [v[0] for k, v in store._STORED.items() if k[1] == "n"]
    jvm = spark.sparkContext._jvm
    gone = jvm.org.apache.hadoop.fs.Path(where)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    assert store.once(spark, "n", [path], build).first().n == 4
    kept = store.table(spark.range(2), "x")
    assert kept.count() == 2
    store.clear(spark)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST"):
        kept.count()
    assert store.once(spark, "n", [path], build).first().n == 4


def test_a_busy_day_is_written_by_several_tasks(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(0, 60_000, numPartitions=6).write.parquet(path)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        df = store.once(spark, "days", [path], lambda: spark.read.parquet(path).select("id", F.lit("2024-01-01").alias("day")), ["day"])
        assert df.count() == 60_000 and len({f for f in df.inputFiles() if "day=2024-01-01" in f}) > 1
    finally:
        spark.conf.set(size, before)
