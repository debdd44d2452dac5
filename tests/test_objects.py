import os

import pytest
from pyspark.sql import functions as F

from quarry.sources.objects import Objects, checked


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(Objects)


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def save(df, path, mode="append"):
    df.write.format("objects").mode(mode).save(path)


def test_objects_come_back(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.range(40).repartition(5).select(F.format_string("u%s/%s.html", F.col("id") % 3, F.col("id")).alias("key"), F.expr("cast(repeat('é', cast(id as int)) as binary)").alias("content"))
    save(df, root)
    read = spark.read.format("objects").load(root)
    assert {(r.key, bytes(r.content), r["size"]) for r in read.collect()} == {(f"u{i % 3}/{i}.html", "é".encode() * i, 2 * i) for i in range(40)}
    assert len(files(root)) == 40 and not os.path.exists(f"{root}/_staging")
    only = spark.read.format("objects").option("prefix", "u1/1").load(root)
    assert {r.key for r in only.collect()} == {f"u1/{i}.html" for i in (1, 10, 13, 16, 19)}
    split = spark.read.format("objects").option("partitionBytes", "200").load(root)
    assert split.rdd.getNumPartitions() > 5 and split.count() == 40
    # Append keeps, overwrite replaces.
    save(spark.createDataFrame([("u0/new", b"x")], "key string, content binary"), root)
    assert len(files(root)) == 41
    save(spark.createDataFrame([("only", None)], "key string, content binary"), f"file://{root}", "overwrite")
    assert files(root) == ["only"] and spark.read.format("objects").load(f"file://{root}").first().content == b""


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    save(spark.createDataFrame([("kept", b"1")], "key string, content binary"), root)
    bad = spark.range(100).repartition(8).select(F.when(F.col("id") == 77, F.lit("../out")).otherwise(F.col("id").cast("string")).alias("key"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="no key of an object"):
        save(bad, root)
    assert files(root) == ["kept"] and files(str(tmp_path)) == ["store/kept"]
    with pytest.raises(Exception, match="twice"):
        save(spark.createDataFrame([("a", b"1"), ("a", b"2")], "key string, content binary").repartition(2), root)
    assert files(root) == ["kept"] and not os.path.exists(f"{root}/_staging")
    with pytest.raises(Exception):
        save(spark.createDataFrame([("a", 1)], "key string, other int"), root)


def test_a_store_without_objects(spark, tmp_path):
    assert spark.read.format("objects").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("key", [None, "", "/a", "a/../b", "../a", "_staging/x", "a//b", "a/"])
def test_keys_stay_below_the_root(key):
    with pytest.raises(ValueError):
        checked(key)
