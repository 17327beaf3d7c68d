"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Source rows over all cores, when their files have fewer splits than that.

    For stages that cost far more per row than moving the row does. A table of many splits is left where it lies.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def wide_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return spread(table(spark, folder, name), key)
