"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of sf_dir, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
