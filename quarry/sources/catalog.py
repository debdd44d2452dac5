"""What the catalogue says about tables and their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def has_columns(spark: SparkSession, table: str, *names: str) -> bool:
    """Whether a table exists and has all the columns, by name whatever the case."""
    return has_table(spark, table) and {n.lower() for n in names} <= {c.name.lower() for c in spark.catalog.listColumns(table)}


def with_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The rows with every column that an older table lacks, as nulls of its type; those that are there stay."""
    present = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(None).cast(kind) for n, kind in kinds.items() if n.lower() not in present})
