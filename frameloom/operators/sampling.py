"""Strata, quotas and repeatable samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.contract import APPLICATION_KEY, STRATUM_COLUMNS
from frameloom.functions.text import seeded_digest
from frameloom.operators.ranking import bucket_counts, first_by_range, lowest_by_digest

#: So many rows may meet in one place to be sorted.
ORDERED_LIMIT = 10_000


def _number_strata(sizes: DataFrame) -> DataFrame:
    # Country, account and domain take 2 x 2 x 3 values: never more than 12 rows.
    everything = Window.partitionBy()
    return sizes.withColumns(
        {
            "stratum_order": F.row_number().over(Window.orderBy(*STRATUM_COLUMNS)).cast("long"),
            "stratum_count": F.count(F.lit(1)).over(everything),
        }
    )


def strata(applications: DataFrame) -> DataFrame:
    sizes = applications.groupBy(*STRATUM_COLUMNS).agg(F.count(F.lit(1)).alias("available"))
    return _number_strata(sizes)


def quotas(strata_table: DataFrame, sample_size: int) -> DataFrame:
    """Even share per stratum; the first strata take the remainder. A stratum that
    has too few rows is not topped up from another."""
    size = F.lit(sample_size)
    share = F.floor(size / F.col("stratum_count"))
    extra = (F.col("stratum_order") <= size % F.col("stratum_count")).cast("long")
    return strata_table.withColumn("requested", (share + extra).cast("long"))


def stratified_sample(applications: DataFrame, sample_size: int, seed: int) -> DataFrame:
    """Sample post-frame applications evenly over country, account and domain."""
    digest = seeded_digest(seed, *[F.col(name) for name in APPLICATION_KEY])
    hashed = applications.withColumn("_digest", digest)
    counts = bucket_counts(hashed, STRATUM_COLUMNS, "_digest")
    sizes = counts.groupBy(*STRATUM_COLUMNS).agg(F.sum("_rows").alias("available"))
    limits = quotas(_number_strata(sizes), sample_size).drop("stratum_order", "stratum_count")
    drawn = lowest_by_digest(
        hashed, limits, STRATUM_COLUMNS, "_digest", APPLICATION_KEY, "sample_rank", counts=counts
    )
    return (
        drawn.drop("_digest")
        .withColumnsRenamed({"available": "stratum_available", "requested": "stratum_requested"})
        .withColumn("sample_seed", F.lit(seed))
        .orderBy(*STRATUM_COLUMNS, "sample_rank")
    )


def require_rows(sample: DataFrame) -> DataFrame:
    """Guard: an empty sample is an error, not an empty file."""
    if sample.isEmpty():
        raise ValueError("No eligible substantive frame applications were found.")
    return sample


def sample_summary(sample: DataFrame) -> DataFrame:
    """Drawn and available rows per stratum."""
    return sample.groupBy(*STRATUM_COLUMNS).agg(
        F.count(F.lit(1)).alias("drawn"), F.max("stratum_available").alias("available")
    )


def sample_totals(sample: DataFrame) -> DataFrame:
    """Rows drawn, and rows available over the distinct strata."""
    return sample_summary(sample).agg(
        F.sum("drawn").alias("drawn"), F.sum("available").alias("available")
    )


def first_n(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """First rows in key order; files have no row order of their own. The key must be unique."""
    if n > ORDERED_LIMIT:
        return first_by_range(df, key, n)
    return df.orderBy(*key).limit(n)


def random_n(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly `n` rows (all, if there are fewer) by seeded digest, in key order."""
    hashed = df.withColumns(
        {"_all": F.lit(0), "_digest": seeded_digest(seed, *[F.col(name) for name in key])}
    )
    wanted = df.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(n).cast("long").alias("requested"))
    drawn = lowest_by_digest(hashed, wanted, ["_all"], "_digest", key, "_rank")
    return drawn.select(*df.columns).orderBy(*key)


def per_stratum_n(
    df: DataFrame, n: int, seed: int, key: Sequence[str] = APPLICATION_KEY, by: Sequence[str] = STRATUM_COLUMNS
) -> DataFrame:
    """Fixed number of rows per stratum, for quick trial runs."""
    hashed = df.withColumn("_digest", seeded_digest(seed, *[F.col(name) for name in key]))
    counts = bucket_counts(hashed, by, "_digest")
    wanted = counts.select(*by).distinct().withColumn("requested", F.lit(n).cast("long"))
    drawn = lowest_by_digest(hashed, wanted, by, "_digest", key, "stratum_rank", counts=counts)
    return drawn.drop("_digest", "requested")


def require_full_strata(sample: DataFrame, n: int, by: Sequence[str] = STRATUM_COLUMNS) -> DataFrame:
    """Guard: every stratum of a fixed-size sample must have its `n` rows."""
    short = sample.groupBy(*by).count().filter(F.col("count") < n)
    if not short.isEmpty():
        raise ValueError(f"Some strata have fewer than {n} rows.")
    return sample
