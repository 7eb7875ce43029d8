"""Skew-safe numbering, sampling and lookups against brute force."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from frameloom.operators.ranking import lookup_join, lowest_by_digest, number_by_digest, number_within
from frameloom.operators.sampling import random_n


def skewed(spark, rows=600):
    """One key holds two thirds of the rows."""
    return spark.range(rows).select(
        F.col("id"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("key"),
        (F.col("id") * 7919 % 101).cast("string").alias("order"),
    )


def expected_numbers(rows, order):
    groups = defaultdict(list)
    for row in rows:
        groups[row["key"]].append(row)
    return {
        row["id"]: place
        for group in groups.values()
        for place, row in enumerate(sorted(group, key=order), start=1)
    }


def test_hot_groups_are_numbered_like_small_ones(spark):
    df = skewed(spark)
    order = [F.col("order").asc_nulls_last(), F.col("id")]
    got = {r["id"]: r["n"] for r in number_within(df, ["key"], order, "n", hot_rows=25).collect()}
    assert got == expected_numbers(df.collect(), lambda r: (r["order"], r["id"]))


def test_hot_group_is_spread_over_ranges(spark):
    df = skewed(spark, 3000)
    numbered = number_within(df, ["key"], [F.col("id")], "n", hot_rows=100)
    sizes = numbered.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


def test_fully_tied_hot_rows_get_distinct_numbers(spark):
    df = spark.range(400).select(F.lit("hot").alias("key"), F.lit("same").alias("order"))
    got = sorted(r["n"] for r in number_within(df, ["key"], [F.col("order")], "n", hot_rows=50).collect())
    assert got == list(range(1, 401))


def test_null_order_values_come_last(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("a", "y")], "key string, order string")
    rows = number_within(df, ["key"], [F.col("order").asc_nulls_last()], "n").collect()
    assert {r["order"]: r["n"] for r in rows} == {"x": 1, "y": 2, None: 3}


def with_digest(df):
    return df.withColumn("digest", F.md5(F.col("id").cast("string")))


def digest(row):
    return hashlib.md5(str(row["id"]).encode()).hexdigest()


def test_number_by_digest(spark):
    df = skewed(spark)
    got = {r["id"]: r["n"] for r in number_by_digest(with_digest(df), ["key"], "digest", ["id"], "n", digits=2).collect()}
    assert got == expected_numbers(df.collect(), digest)


def test_lowest_by_digest_keeps_exactly_the_wanted_rows(spark):
    df = skewed(spark)
    wanted = df.select("key").distinct().withColumn("requested", F.lit(7).cast("long"))
    for digits in (1, 2, 4):
        rows = lowest_by_digest(with_digest(df), wanted, ["key"], "digest", ["id"], "n", digits).collect()
        numbers = expected_numbers(df.collect(), digest)
        assert {r["id"]: r["n"] for r in rows} == {i: n for i, n in numbers.items() if n <= 7}


def test_random_n_is_exact_ordered_and_repeatable(spark):
    df = skewed(spark).repartition(5)
    first = [r["id"] for r in random_n(df, ["id"], 50, 1).collect()]
    assert len(first) == 50 and first == sorted(first)
    assert first == [r["id"] for r in random_n(df.repartition(3), ["id"], 50, 1).collect()]
    assert first != [r["id"] for r in random_n(df, ["id"], 50, 2).collect()]
    assert random_n(df, ["id"], 10_000, 1).count() == 600


def test_lookup_join_gives_the_same_rows_either_way(spark, monkeypatch):
    from frameloom.operators import ranking

    facts = skewed(spark)
    names = facts.groupBy("key").agg(F.count("*").alias("mentions")).filter("key <> 'k5'").withColumn("value", F.upper("key"))
    small = lookup_join(facts, names, "key")
    assert set(small.columns) == {*facts.columns, "value"}
    for share in (2, 1000):  # one hot key, and only hot keys
        monkeypatch.setattr(ranking, "HOT_SHARE", share)
        large = lookup_join(facts, names, "key", max_broadcast_bytes=0)
        assert Counter(map(tuple, small.collect())) == Counter(map(tuple, large.select(small.columns).collect()))
        assert large.count() == 600
    assert small.filter("key = 'k5'").filter("value is not null").count() == 0


def test_a_quota_above_the_group_is_ranked_in_many_partitions(spark):
    df = skewed(spark, 5000)
    wanted = df.select("key").distinct().withColumn("requested", F.lit(10_000).cast("long"))
    ranked = lowest_by_digest(with_digest(df), wanted, ["key"], "digest", ["id"], "n", 2)
    numbers = expected_numbers(df.collect(), digest)
    assert {r["id"]: r["n"] for r in ranked.collect()} == numbers
    hot = df.groupBy("key").count().orderBy(F.desc("count")).first()["key"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        places = ranked.filter(F.col("key") == hot).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert places > 4


def test_first_rows_by_range_are_those_of_a_sort(spark):
    from frameloom.operators.ranking import first_by_range

    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 3).alias("o"), F.col("id").alias("v"))
    for n in (1, 1700, 3000, 9000):
        got = {r["v"] for r in first_by_range(df.repartition(7), ["k", "o"], n).collect()}
        assert got == {r["v"] for r in df.orderBy("k", "o").limit(n).collect()}
