"""Driver tables: one parquet file per table under a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Scan parallelism for a table that Spark reads in a single task.

    A small file with one row group scans in one task however many cores there
    are; its rows are then spread over all of them (one shuffle of at most
    ``spark.sql.files.maxPartitionBytes``).  A scan of two or more partitions is
    left as it is, so no larger table is ever reshuffled for this.
    """
    if df.rdd.getNumPartitions() == 1:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
