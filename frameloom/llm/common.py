"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.session import settle

#: A table of at most so many rows of a few numbers and a short name each is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df`, a written table, marked for broadcast if it has few rows; else left to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranged(df: DataFrame, *order: Column, name: str = "ranged") -> DataFrame:
    """`df` written in ranges of `order`, each with the number of its range in `_range`.

    Rows that are equal in `order` share a range, and ranges follow each other.
    """
    return settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def with_totals(rows: DataFrame, key: str, totals: DataFrame, counted: str, share: int = 1000) -> DataFrame:
    """`rows` with the columns of `totals`, which has one row for each `key`, null included.

    Keys that hold more than one of `share` rows, at most `share` of them, are broadcast;
    their rows do not meet in one place. All others take an ordinary join.
    """
    totals = settle(totals, "totals")
    least = F.lit((totals.agg(F.sum(counted)).first()[0] or 0) // share)
    added = [name for name in totals.columns if name not in (key, counted)]
    hot = totals.filter(F.col(counted) > least).select(
        F.col(key).alias("_hot"), F.lit(True).alias("_is_hot"), *(F.col(name).alias(f"_hot_{name}") for name in added)
    )
    rest = totals.filter(F.col(counted) <= least).select(
        F.col(key).alias("_rest"), *(F.col(name).alias(f"_rest_{name}") for name in added)
    )
    known = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(1024)) + 1
    known = known.withColumns(
        {"_ask": F.when(F.col("_is_hot").isNull(), F.col(key)), "_salt": F.when(F.col("_is_hot"), spread).otherwise(0)}
    )
    rest = rest.withColumn("_no_salt", F.lit(0).cast("bigint"))
    asked = known.join(rest, F.col("_ask").eqNullSafe(F.col("_rest")) & (F.col("_salt") == F.col("_no_salt")), "left")
    return asked.select(*rows.columns, *(F.coalesce(f"_hot_{name}", f"_rest_{name}").alias(name) for name in added))
