"""Writers with the guards the jobs rely on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from frameloom.contract import PILOT_SIZE
from frameloom.sources.csv import MAP_BATCH, csv_columns


def _clean(path: str) -> str:
    """`path` without a slash at its end, so that names beside it can be made from it."""
    return path.rstrip("/") or path


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def _move(spark: SparkSession, source: str, target: str) -> None:
    origin, files = _path(spark, source)
    if not files.rename(origin, _path(spark, target)[0]):
        raise OSError(f"Could not move {source} to {target}")


def _children(spark: SparkSession, path: str) -> list[str]:
    target, files = _path(spark, path)
    return [status.getPath().getName() for status in files.listStatus(target)]


def _has_rows(spark: SparkSession, path: str) -> bool:
    return exists(spark, path) and any(name.endswith(".csv") for name in _children(spark, path))


def _labeled_writer(df: DataFrame):
    options = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": "", "nullValue": ""}
    return df.write.options(**options)


def require_header(df: DataFrame, path: str) -> None:
    """Guard: existing output must have the columns of `df`."""
    if _has_rows(df.sparkSession, path):
        header = csv_columns(df.sparkSession, path)
        if header != df.columns:
            raise ValueError(f"{path} has the columns {header}, not {df.columns}; choose another output.")


def write_labeled_csv(df: DataFrame, path: str) -> None:
    """Append labeled rows, all fields quoted. Refuses output with another header."""
    require_header(df, path)
    _labeled_writer(df).mode("append").csv(path)


def replace_labeled_csv(df: DataFrame, path: str) -> None:
    """Write labeled rows next to the output, then swap; `df` may read the output."""
    require_header(df, path)
    staging = _staging(df.sparkSession, path)
    _labeled_writer(df).csv(staging)
    _swap(df.sparkSession, staging, path)


def _staging(spark: SparkSession, path: str) -> str:
    staging = f"{_clean(path)}.staging"
    if exists(spark, staging):
        raise FileExistsError(f"An unfinished rebuild is in the way: {staging}")
    return staging


def _swap(spark: SparkSession, staging: str, path: str) -> None:
    """Put `staging` in the place of `path`; what was there stays beside it."""
    path = _clean(path)
    if exists(spark, path):
        number = 1
        while exists(spark, f"{path}.old{number}"):
            number += 1
        _move(spark, path, f"{path}.old{number}")
    _move(spark, staging, path)


def rebuild_parquet(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write next to the target, read back, then swap. The old table stays beside
    the new one, so a table that is being read is never overwritten."""
    spark, path = df.sparkSession, _clean(path)
    if exists(spark, path) and not overwrite:
        raise FileExistsError(f"Refusing to replace {path}; pass overwrite=True.")
    staging, watch = _staging(spark, path), Observation("rebuild")
    df.observe(watch, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(staging)
    written = spark.read.parquet(staging)
    if written.schema.names != df.schema.names:
        raise ValueError("The rebuilt table does not have the expected columns.")
    if written.count() != watch.get["rows"]:
        raise ValueError("The rebuilt table does not have the rows that were written.")
    _swap(spark, staging, path)
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction table; existing output is an error."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_summaries(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Report tables, one CSV folder each; a sorted table's parts are in its order."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def append_actor_map(df: DataFrame, path: str) -> None:
    """Add mapping decisions as the next numbered batch; readers let the last one of
    a label win. Of two writers at a time the second fails."""
    spark, path = df.sparkSession, _clean(path)
    names = _children(spark, path) if exists(spark, path) else []
    taken = [int(name.removeprefix(MAP_BATCH)) for name in names if name.startswith(MAP_BATCH)]
    batch = f"{path}/{MAP_BATCH}{max(taken, default=0) + 1:06d}"
    _map_entries(df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(batch)


def _map_entries(df: DataFrame) -> DataFrame:
    return df.select("label", "canonical", "occurrences")


def rewrite_actor_map(df: DataFrame, folder: str) -> str:
    """Write the next version of the map; earlier versions stay as they are."""
    spark = df.sparkSession
    taken = _children(spark, folder) if exists(spark, folder) else []
    numbers = [int(name[1:]) for name in taken if name[:1] == "v" and name[1:].isdigit()]
    path = f"{_clean(folder)}/v{max(numbers, default=0) + 1}"
    _map_entries(df).write.option("header", True).option("escape", '"').csv(path)
    return path


def latest_actor_map(spark: SparkSession, folder: str) -> str:
    numbers = [int(name[1:]) for name in _children(spark, folder) if name[:1] == "v" and name[1:].isdigit()]
    if not numbers:
        raise FileNotFoundError(f"No actor map in {folder}")
    return f"{folder}/v{max(numbers)}"


def write_record(spark: SparkSession, text: str, path: str) -> None:
    """A few lines of text, such as the names of the selected models."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


# --- default names (fixed values) --------------------------------------------------------------------


def labeled_name(tasks: Sequence[str], focal: bool = False) -> str:
    return "_".join(["labeled", *[task.lower() for task in tasks], *(["focal"] if focal else [])]) + ".csv"


def focal_name(prefix: str = "") -> str:
    return f"labeled_{prefix.lower()}focal.csv"


def sample_name(size: int, seed: int) -> str:
    kind = "pilot" if size <= PILOT_SIZE else "sample"
    return f"focal_valence_{kind}_canonical_n{size}_seed{seed}.csv"


def full_name() -> str:
    return "focal_valence_full_canonical.csv"
