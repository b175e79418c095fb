"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, one file or one directory of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
