"""Readers for the benchmark tables (one parquet file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Tables whose rows carry long texts and feed CPU-heavy row operators.
TEXT_TABLES = ("documents", "conversations", "pages")


def spread(df: DataFrame, target: int | None = None) -> DataFrame:
    """Round-robin an input that is scanned in fewer splits than the cluster has cores.

    A file with one row group is read by one task however many splits it has;
    text operators on it would then use one core.  Such inputs are re-spread
    with one shuffle; large inputs, in however few files, arrive in many splits
    and are left alone.
    """
    target = target or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; Catalyst prunes columns and pushes filters
    into it.  Text tables are spread over the cores when small (``spread``)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXT_TABLES else df
