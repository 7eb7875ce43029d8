"""Parquet corpus and SQL views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Parquet corpus. Column choice and filters reach the files by themselves."""
    return spark.read.parquet(path)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
