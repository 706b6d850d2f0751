"""Other databases, by JDBC. The driver's jar is the session's affair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: object = None, upper: object = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of another database, in parallel slices of ``partition_column`` if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", str(lower)).option("upperBound", str(upper)).option("numPartitions", partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()
