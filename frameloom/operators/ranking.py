"""Numbering, sampling and lookups that hold up when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.session import settle

HOT_GROUP_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: A key is hot if it makes more than one in so many of all facts.
HOT_SHARE = 1000


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """`row_number` per key that never sorts a whole hot group in one task.

    One aggregate over the key column finds groups above `hot_rows`. There are
    at most rows / hot_rows of them, so their list can be broadcast. All other
    rows take the ordinary window; hot groups are cut into sorted ranges,
    numbered range by range, and shifted by the rows in earlier ranges.
    """
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    total = sizes.agg(F.sum("_rows")).first()[0]
    if total is None:
        return df.withColumn(name, plain)
    hot = F.broadcast(settle(sizes.select(*keys), "hot-keys"))
    ordinary = df.join(hot, list(keys), "left_anti").withColumn(name, plain)
    large = df.join(hot, list(keys), "left_semi")
    return ordinary.unionByName(_number_by_range(large, keys, order, name, 2 + 2 * total // hot_rows))


def _number_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, ranges: int
) -> DataFrame:
    # Rows that tie on every order column may be a large group of their own. The
    # stored position splits them, and storing it keeps a retried task in step.
    placed = settle(df.withColumn("_tie", F.monotonically_increasing_id()), "hot-rows")
    ranged = settle(
        placed.repartitionByRange(ranges, *keys, *order, "_tie").withColumn("_range", F.spark_partition_id()),
        "hot-ranges",
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*order, "_tie")
    return (
        # at most (hot keys + ranges) rows: a range boundary cuts one key
        ranged.join(F.broadcast(before), [*keys, "_range"])
        .withColumn(name, F.row_number().over(within) + F.col("_before"))
        .drop("_tie", "_range", "_before")
    )


def leading_digits(digest: Column, digits: int) -> Column:
    """Bucket of a hex digest; buckets sort the way the digests do."""
    return F.substring(digest, 1, digits)


def number_by_digest(
    df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str], name: str, digits: int = 3
) -> DataFrame:
    """Exact `row_number` per key in digest order, spread over digest buckets.

    `keys` must be few (classes, strata): the table of bucket offsets has at most
    16**digits rows per key value and is broadcast.
    """
    bucketed = df.withColumn("_bucket", leading_digits(F.col(digest), digits))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(digest, *ties)
    return (
        bucketed.join(F.broadcast(before), [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(within) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def bucket_counts(df: DataFrame, keys: Sequence[str], digest: str, digits: int = 4) -> DataFrame:
    """Rows per key and digest bucket: the histogram a cut is read from."""
    return df.groupBy(*keys, leading_digits(F.col(digest), digits).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_rows")
    )


def wanted_buckets(counts: DataFrame, quotas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The buckets that hold wanted rows, with the quota's columns and the rows of the
    key in lower buckets as `_before`. `quotas` has one row per key value."""
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    return before.join(quotas, list(keys)).filter(F.col("_before") < F.col("requested"))


def lowest_by_digest(
    df: DataFrame,
    quotas: DataFrame,
    keys: Sequence[str],
    digest: str,
    ties: Sequence[str],
    name: str,
    digits: int = 4,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Per key, the `requested` rows with the lowest digest, numbered from 1.

    A histogram of digest buckets says which buckets hold wanted rows and how many
    rows of the key come before each. All other rows are dropped before the ranking,
    and every bucket is ranked by itself, so no task sees a whole group, however
    large the group or the quota is. `quotas` has one row per key value.
    """
    counts = bucket_counts(df, keys, digest, digits) if counts is None else counts
    wanted = wanted_buckets(counts, quotas, keys)
    within = Window.partitionBy(*keys, "_bucket").orderBy(digest, *ties)
    return (
        df.withColumn("_bucket", leading_digits(F.col(digest), digits))
        .join(wanted, [*keys, "_bucket"])
        .withColumn(name, (F.row_number().over(within) + F.col("_before")).cast("long"))
        .filter(F.col(name) <= F.col("requested"))
        .drop("_bucket", "_before")
    )


def first_by_range(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows by `order`, whose values tell rows apart, for an `n` of any size.

    Only the order columns are written in ranges; ranges are counted, and the rows of
    the range in which the last wanted row lies are numbered.
    """
    keys = df.select(*order)
    ranged = settle(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(*order)
    first = (
        # one row per partition
        ranged.join(F.broadcast(before.filter(F.col("_before") < n)), "_range")
        .withColumn("_at", F.row_number().over(within) + F.col("_before"))
        .filter(F.col("_at") <= n)
    )
    return df.join(first.select(*order), list(order), "left_semi")


def lookup_join(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    heat: str = "mentions",
) -> DataFrame:
    """Left join to a written table with one row per key, whose `heat` counts the facts.

    Broadcast when the counted size allows it. Otherwise the keys that make more than
    one in `HOT_SHARE` of all facts, at most so many, are broadcast by themselves, and
    all other facts take the ordinary join. `heat` does not come along.
    """
    plain = dimension.drop(heat)
    size = F.lit(0)
    for name, kind in plain.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(0)) + 16
    total, bytes_ = dimension.agg(F.sum(heat), F.sum(size)).first()
    if (bytes_ or 0) <= max_broadcast_bytes:
        return facts.join(F.broadcast(plain), key, "left")
    hot = F.broadcast(dimension.filter(F.col(heat) * HOT_SHARE > total).drop(heat))
    heated = facts.join(hot, key)
    rest = facts.join(hot, key, "left_anti").join(plain, key, "left")
    return heated.unionByName(rest)
