"""Posts, their keys, and one row per post and frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.contract import (
    APPLICATION_KEY,
    BASE_COLUMNS,
    FRAME_COLUMNS,
    INVALID_LABEL,
    NO_CATEGORY,
)
from frameloom.functions.posts import account_type, in_years, is_state_account, source_country
from frameloom.functions.text import content_key, has_text
from frameloom.operators.ranking import HOT_GROUP_ROWS, number_within


def with_merge_key(posts: DataFrame) -> DataFrame:
    """Content key, so that tables match on what a post says and not on row order."""
    key = content_key(F.col("source"), F.col("link"), F.col("standardized_date"), F.col("text"))
    return posts.withColumn("merge_key", key)


def with_key_occurrence(
    posts: DataFrame,
    order: Sequence[str] = BASE_COLUMNS,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Number the copies of each content key by the raw columns, nulls last."""
    by = [F.col(f"`{name}`").asc_nulls_last() for name in order]
    return number_within(posts, ["merge_key"], by, "key_occurrence", hot_rows)


def eligible_posts(posts: DataFrame) -> DataFrame:
    return posts.filter(in_years(F.col("post_year")) & has_text(F.col("text")))


def with_account(posts: DataFrame) -> DataFrame:
    return posts.withColumns(
        {
            "source_country": source_country(F.col("category")),
            "account_type": account_type(F.col("category")),
        }
    )


def substantive(frame: Column) -> Column:
    """A real frame; null frames fail the test too."""
    return ~frame.isin(NO_CATEGORY, INVALID_LABEL)


def frame_applications(posts: DataFrame) -> DataFrame:
    """One row per eligible post and substantive frame."""
    pairs = ", ".join(f"'{domain}', {column}" for domain, column in FRAME_COLUMNS.items())
    kept = [f"`{name}`" for name in posts.columns if name not in FRAME_COLUMNS.values()]
    stacked = f"stack({len(FRAME_COLUMNS)}, {pairs}) as (frame_domain, frame_subframe)"
    long = eligible_posts(posts).selectExpr(*kept, stacked)
    return with_account(long.filter(substantive(F.col("frame_subframe"))))


def eligible_applications(posts: DataFrame) -> DataFrame:
    """Applications whose country and account type are both known."""
    # Account rules read the post alone, so they are tested before the unpivot.
    known = is_state_account(F.col("category")) & account_type(F.col("category")).isNotNull()
    return frame_applications(posts.filter(known))


def full_posts(posts: DataFrame, ordered: bool = True) -> DataFrame:
    """Every state-account post with text, one row each, in key order if `ordered`."""
    columns = [
        "merge_key",
        "key_occurrence",
        "source",
        "category",
        "source_country",
        "account_type",
        *[name for name in ("post_date",) if name in posts.columns],
        "post_year",
        "post_month",
        "focal_actor",
        "text",
    ]
    kept = posts.filter(has_text(F.col("text")) & is_state_account(F.col("category")))
    rows = with_account(kept).select(
        *columns, F.lit("").alias("frame_domain"), F.lit("").alias("frame_subframe")
    )
    return rows.orderBy("merge_key", "key_occurrence") if ordered else rows


def corpus_counts(posts: DataFrame) -> DataFrame:
    """Eligible state-account posts, and how many of them have no focal actor."""
    kept = posts.filter(has_text(F.col("text")) & is_state_account(F.col("category")))
    return kept.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(F.col("focal_actor") == "None").alias("none_posts"),
    )


def require_none_posts(posts: DataFrame) -> int:
    """Guard of the whole-corpus run: a corpus without `None` was never rebuilt."""
    counts = corpus_counts(posts).first()
    if not counts["none_posts"]:
        raise ValueError("No post has focal_actor 'None'; rebuild the corpus first.")
    return counts["posts"]


def unlabeled_applications(applications: DataFrame, labeled: DataFrame) -> DataFrame:
    """Applications that are not in the labeled sample."""
    keys = list(APPLICATION_KEY)
    return applications.join(labeled.select(*keys), keys, "left_anti")
