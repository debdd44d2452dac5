import uuid

from quarry.sources import catalog


def test_tables_and_columns(spark):
    name = f"t_{uuid.uuid4().hex}"
    assert not catalog.has_table(spark, name) and not catalog.has_columns(spark, name, "url")
    spark.createDataFrame([("u", "https://a.b/")], "user_id string, url string").write.saveAsTable(name)
    assert catalog.has_columns(spark, name, "URL", "user_id") and not catalog.has_columns(spark, name, "url", "canonical_url")
    rows = catalog.with_columns(spark.table(name), canonical_url="string", url="int").collect()
    assert [r.asDict() for r in rows] == [{"user_id": "u", "url": "https://a.b/", "canonical_url": None}]
    spark.sql(f"DROP TABLE {name}")
