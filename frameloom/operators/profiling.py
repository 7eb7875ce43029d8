"""Coverage, distribution and combinations of label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.contract import BLANK, FOCAL_COLUMN, NO_CATEGORY, NO_COMBINATION, TASK_COLUMNS
from frameloom.functions.labels import display_value, percent, profile_value
from frameloom.session import settle

DEFAULT_COLUMNS = (*TASK_COLUMNS.values(), FOCAL_COLUMN)


def detect_label_columns(df: DataFrame, prefix: str = "", columns: Sequence[str] | None = None) -> list[str]:
    """The asked columns, all of them; else those of the prefixed defaults that exist, at least one."""
    wanted = list(columns or (prefix + name for name in DEFAULT_COLUMNS))
    found, missing = ([name for name in wanted if (name in df.columns) is there] for there in (True, False))
    if found and not (columns and missing):
        return found
    unprefixed = [name for name in DEFAULT_COLUMNS if prefix and name in df.columns]
    hint = f" Columns without the prefix exist: {', '.join(unprefixed)}." if unprefixed and not columns else ""
    raise ValueError(f"Missing columns: {', '.join(missing)}.{hint}")


def profile_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: profile_value(F.col(name)) for name in columns})


def counted_labels(df: DataFrame, columns: Sequence[str], n: str = "label_rows") -> DataFrame:
    """Each combination of cleaned labels with its rows as `n`, written once.

    The tables below give the same from it, and from its `n`, as from all rows.
    """
    values = [profile_value(F.col(name)).alias(name) for name in columns]
    return settle(df.groupBy(*values).agg(F.count(F.lit(1)).alias(n)), "labels")


def _rows(n: str | None, when: Column | None = None) -> Column:
    """How many rows there are, of those that `n` counts if given."""
    one = F.lit(1) if n is None else F.col(n)
    return F.coalesce(F.sum(one if when is None else F.when(when, one)), F.lit(0)).cast("long")


def label_long(df: DataFrame, columns: Sequence[str], n: str | None = None) -> DataFrame:
    """One row per row and label column, values cleaned."""
    kept = [n] if n else []
    values = df.select(*kept, *[profile_value(F.col(name)).alias(name) for name in columns])
    return values.unpivot(kept, list(columns), "column", "value")


def coverage(df: DataFrame, columns: Sequence[str], n: str | None = None) -> DataFrame:
    """Filled, blank, no-category and substantive rows of every column, in one
    pass over the data."""
    counts = []
    for index, name in enumerate(columns):
        value = profile_value(F.col(name))
        counts += [
            _rows(n, value != "").alias(f"filled_{index}"),
            _rows(n, value == NO_CATEGORY).alias(f"none_{index}"),
        ]
    totals = df.agg(_rows(n).alias("rows"), *counts)
    per_column = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    F.col(f"filled_{index}").alias("nonblank_count"),
                    (F.col("rows") - F.col(f"filled_{index}")).alias("blank_count"),
                    F.col(f"none_{index}").alias("no_category_count"),
                    (F.col(f"filled_{index}") - F.col(f"none_{index}")).alias("substantive_count"),
                )
                for index, name in enumerate(columns)
            ]
        )
    ).alias("c")
    measures = ("nonblank", "blank", "no_category", "substantive")
    return totals.select("rows", per_column).select("c.column", "rows", *[f"c.{m}_count" for m in measures]).withColumns(
        {f"{m}_pct": percent(F.col(f"{m}_count"), F.col("rows")) for m in measures}
    )


def label_distribution(df: DataFrame, columns: Sequence[str], n: str | None = None) -> DataFrame:
    """Rows per label of every column, with shares of all and of filled rows."""
    totals = coverage(df, columns, n).select("column", "rows", "nonblank_count")
    counts = label_long(df, columns, n).groupBy("column", "value").agg(_rows(n).alias("count"))
    share = F.when(F.col("value") == "", F.lit(0.0)).otherwise(percent(F.col("count"), F.col("nonblank_count")))
    return (
        # one totals row per label column
        counts.join(F.broadcast(totals), "column")
        .select(
            "column",
            display_value(F.col("value")).alias("label"),
            "count",
            percent(F.col("count"), F.col("rows")).alias("pct_of_rows"),
            share.alias("pct_of_nonblank"),
        )
        .orderBy("column", F.desc("count"), "label")
    )


def label_combinations(
    df: DataFrame, columns: Sequence[str], include_no_category: bool = True, n: str | None = None
) -> DataFrame:
    """Rows per combination of labels."""
    parts = []
    for name in columns:
        value = profile_value(F.col(name))
        shown = F.concat(F.lit(f"{name}="), display_value(value))
        parts.append(shown if include_no_category else F.when(value != NO_CATEGORY, shown))
    combo = F.concat_ws(" | ", *parts)
    total = df.agg(_rows(n)).scalar()
    return (
        df.groupBy(F.when(combo == "", NO_COMBINATION).otherwise(combo).alias("combo"))
        .agg(_rows(n).alias("count"))
        .withColumn("pct_of_rows", percent(F.col("count"), total))
        .orderBy(F.desc("count"), "combo")
    )


def top_combinations(combinations: DataFrame, k: int) -> DataFrame:
    """The `k` most frequent combinations, and how many are not shown."""
    if k <= 0:
        raise ValueError("k must be greater than 0")
    total = combinations.agg(F.count(F.lit(1))).scalar()
    return (
        combinations.orderBy(F.desc("count"), "combo")
        .limit(k)
        .withColumn("hidden", F.greatest(total - F.lit(k), F.lit(0)).cast("long"))
    )


__all__ = [
    "BLANK",
    "counted_labels",
    "coverage",
    "detect_label_columns",
    "label_combinations",
    "label_distribution",
    "label_long",
    "profile_normalize",
    "top_combinations",
]
