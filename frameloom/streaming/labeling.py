"""Labeling files as they arrive. A stopped run continues where it stopped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from frameloom.operators.labeling import Labeler, label_columns, label_posts
from frameloom.sources.csv import stream_posts_csv

#: Under this name a batch reports its counts.
COUNTS = "labels"


def stream_posts(
    spark: SparkSession, folder: str, columns: Sequence[str] | None = None, max_files: int = 100
) -> DataFrame:
    """CSV files of a folder as a stream, `max_files` per batch, read like a batch of them."""
    return stream_posts_csv(spark, folder, columns, max_files)


def stream_corpus(
    spark: SparkSession, folder: str, schema: T.StructType, names: str = "*.parquet", max_files: int | None = 100
) -> DataFrame:
    """Parquet files of a folder as a stream; `names` is a file-name pattern. Without
    `max_files` a batch is all that has arrived."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def label_stream(
    posts: DataFrame,
    out: str,
    checkpoint: str,
    tasks: Sequence[str],
    labeler: Labeler,
    focal: bool = False,
    text: str = "text",
    prefix: str = "",
    on_error: str = "blank",
) -> StreamingQuery:
    """Label everything that has arrived and stop. Files and batches done are kept
    in `checkpoint`; the Parquet sink commits a batch as a whole, so a restart
    neither loses nor repeats a row. Rows and blank labels of each batch are counted
    as they are written; see `batch_counts`."""
    labeled = label_posts(posts, tasks, labeler, focal, text, prefix, on_error)
    blanks = [F.count_if(F.col(c) == "").alias(f"blank_{c}") for c in label_columns(tasks, focal, prefix)]
    return (
        labeled.observe(COUNTS, F.count(F.lit(1)).alias("rows"), *blanks)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def batch_counts(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Batch by batch what a run has written so far: `batch, rows` and a `blank_` column for each label.

    Spark keeps as many batches as `spark.sql.streaming.numRecentProgressUpdates` says.
    """
    found = [(p.batchId, p.observedMetrics[COUNTS].asDict()) for p in query.recentProgress if COUNTS in p.observedMetrics]
    names = list(found[0][1]) if found else ["rows"]
    kinds = ", ".join(f"{name} bigint" for name in ["batch", *names])
    return spark.createDataFrame([(n, *counts.values()) for n, counts in found], kinds)
