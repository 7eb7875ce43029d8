"""Cross-validation folds that keep all rows of a post together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.contract import VALENCE_COLUMN
from frameloom.functions.text import seeded_digest
from frameloom.operators.ranking import number_by_digest


def grouped_folds(
    df: DataFrame, folds: int, seed: int, target: str = VALENCE_COLUMN, group: str = "group_id"
) -> DataFrame:
    """One fold (1..folds) per group, classes spread evenly over the folds.

    A group counts as its most frequent class. Groups of a class are dealt to the
    folds in seeded digest order.
    """
    if folds < 2:
        raise ValueError("folds must be at least 2")
    counts = df.groupBy(F.col(group).alias("group_id"), F.col(target).alias("label")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    classes = counts.groupBy("group_id").agg(
        F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("label")
    )
    hashed = classes.withColumn("_digest", seeded_digest(seed, F.col("group_id")))
    dealt = number_by_digest(hashed, ["label"], "_digest", ["group_id"], "_place")
    return dealt.select(
        "group_id", "label", ((F.col("_place") - 1) % folds + 1).cast("int").alias("fold")
    )


def with_folds(
    df: DataFrame, folds: int, seed: int, target: str = VALENCE_COLUMN, group: str = "group_id"
) -> DataFrame:
    assigned = grouped_folds(df, folds, seed, target, group).select(F.col("group_id").alias(group), "fold")
    return df.join(assigned, group)


def leaking_groups(df: DataFrame, group: str = "group_id", fold: str = "fold") -> DataFrame:
    """Groups whose rows are in more than one fold; must be empty."""
    return (
        df.groupBy(F.col(group).alias("group_id"))
        .agg(F.count_distinct(fold).alias("folds"))
        .filter(F.col("folds") > 1)
    )


def overlapping_groups(train: DataFrame, test: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups on both sides of one split."""
    return train.select(group).intersect(test.select(group))


def require_no_leak(df: DataFrame, group: str = "group_id", fold: str = "fold") -> DataFrame:
    if not leaking_groups(df, group, fold).isEmpty():
        raise ValueError("Some posts occur in more than one fold.")
    return df
