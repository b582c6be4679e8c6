"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import prepare


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; columns and filters used later are pushed to the scan."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")
