"""Classification metrics and model selection, from confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.contract import VALENCE_COLUMN, VALENCES

RUN = ("target", "model", "fold")
MACRO_METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro")


def confusion(predictions: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Rows per true and predicted class. All metrics start from this table, whose
    size is the number of classes squared and not the number of rows."""
    return predictions.groupBy(*run, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def per_class(table: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Precision, recall, F1 and support of every class seen in truth or prediction."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    sides = table.withColumn(
        "s",
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.col("n").alias("true"), F.lit(0).cast("long").alias("pred"), hit.alias("hit")),
                F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("true"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit")),
            )
        ),
    ).select(*run, "s.*")
    sums = sides.groupBy(*run, "label").agg(
        F.sum("true").alias("support"), F.sum("pred").alias("predicted"), F.sum("hit").alias("hits")
    )
    scored = sums.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
        }
    )
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def class_metrics(table: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Metrics per class that occurs in the truth, long form, from confusion counts."""
    scored = per_class(table, run).filter(F.col("support") > 0)
    return scored.unpivot(
        [*run, "label", "support"], ["precision", "recall", "f1"], "metric", "value"
    )


def macro_metrics(table: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Accuracy and unweighted class means; classes only ever predicted count too."""
    wide = per_class(table, run).groupBy(*run).agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.sum("support").alias("support"),
    )
    return wide.withColumn("label", F.lit("all")).unpivot(
        [*run, "label", "support"], list(MACRO_METRICS), "metric", "value"
    )


def metric_rows(table: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Overall and per-class metrics of every run, one table."""
    return macro_metrics(table, run).unionByName(class_metrics(table, run))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds of the overall metrics."""
    return (
        metrics.filter(F.col("label") == "all")
        .groupBy("target", "model", "metric")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )


def metric_pivot(summary: DataFrame) -> DataFrame:
    """One row per model, one column per overall metric."""
    return summary.groupBy("target", "model").pivot("metric", list(MACRO_METRICS)).agg(
        F.round(F.first("mean"), 4)
    )


def best_model(summary: DataFrame) -> DataFrame:
    """Model with the highest mean macro F1 per target, first by name among equals."""
    rank = F.struct(-F.col("mean"), F.col("model"))
    return (
        summary.filter(F.col("metric") == "f1_macro")
        .groupBy("target")
        .agg(F.min_by("model", rank).alias("model"), F.max("mean").alias("mean"))
    )


def class_counts(df: DataFrame, target: str = VALENCE_COLUMN) -> DataFrame:
    return df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def valence_crosstab(df: DataFrame, target: str = VALENCE_COLUMN) -> DataFrame:
    """Focal actor by valence; actors without a fixed valence show zeros."""
    actor = F.coalesce(F.col("focal_actor"), F.lit("None")).alias("focal_actor")
    table = df.groupBy(actor).pivot(target, list(VALENCES)).count().na.fill(0, list(VALENCES))
    total = sum((F.col(name) for name in VALENCES[1:]), F.col(VALENCES[0]))
    return table.withColumn("Total", total).orderBy("focal_actor")
