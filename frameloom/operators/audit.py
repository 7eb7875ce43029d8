"""Scoring predictions against audited truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.contract import FOCAL_ALIASES, FOCAL_FLAG, FRAME_ALIASES, FRAME_FLAG
from frameloom.functions.labels import is_yes, scoring_name
from frameloom.functions.text import strip


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((name for name in names if name in df.columns), None)


def _flag(df: DataFrame, name: str):
    """A missing flag column means that no row was approved."""
    return is_yes(F.col(f"`{name}`")) if name in df.columns else F.lit(False)


def audit_rows(df: DataFrame, prefix: str = "TEST_") -> DataFrame:
    """Approved rows as (task, truth, prediction), short label names on both sides.

    A task without a source or prediction column is skipped.
    """
    missing = [name for name in ("sample_from", "label_value") if name not in df.columns]
    if missing:
        raise ValueError(f"Audit table lacks {', '.join(missing)}; it has: {', '.join(df.columns)}")
    scopes = []
    for task, aliases in FRAME_ALIASES.items():
        name = first_present(df, aliases)
        if name and prefix + name in df.columns:
            scope = _flag(df, FRAME_FLAG) & strip(F.col("sample_from")).isin(*aliases)
            scopes.append((task, scope, "label_value", prefix + name))
    focal = first_present(df, FOCAL_ALIASES)
    if focal and prefix + focal in df.columns:
        scopes.append(("focal", _flag(df, FOCAL_FLAG), focal, prefix + focal))
    if not scopes:
        raise ValueError("No task has both a source and a prediction column.")
    # One pass: each row is offered to every task and kept by the tasks it is in.
    offers = F.explode(
        F.array(
            *[
                F.when(
                    scope,
                    F.struct(
                        F.lit(task).alias("task"),
                        scoring_name(F.col(f"`{truth}`")).alias("truth"),
                        scoring_name(F.col(f"`{predicted}`")).alias("predicted"),
                    ),
                )
                for task, scope, truth, predicted in scopes
            ]
        )
    )
    return df.select(offers.alias("o")).filter(F.col("o").isNotNull()).select("o.*")


def _scored(rows: DataFrame) -> DataFrame:
    correct = (F.col("truth") == F.col("predicted")).cast("double")
    return rows.filter(F.col("truth") != "").withColumn("correct", correct)


def accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy per task where the truth is filled; a blank prediction is wrong."""
    return _scored(rows).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("acc"))


def accuracy_by_truth(rows: DataFrame) -> DataFrame:
    return (
        _scored(rows)
        .groupBy("task", "truth")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("acc"))
        .orderBy("task", F.desc("n"), "truth")
    )
