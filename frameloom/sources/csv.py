"""CSV readers. Post text holds line breaks inside quotes, so one file is read by
one task; spread a large corpus over many files, or convert it to Parquet once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTE_ORDER_MARK = "﻿"


def _reader(spark: SparkSession, stream: bool = False) -> DataFrameReader:
    return (
        (spark.readStream if stream else spark.read)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
    )


def csv_columns(spark: SparkSession, path: str, nested: bool = False) -> list[str]:
    """Header of a CSV, without reading its rows; `nested` looks into folders too."""
    names = _reader(spark).option("recursiveFileLookup", nested).csv(path).columns
    return [name.lstrip(BYTE_ORDER_MARK).strip('"') for name in names]


def require_columns(df: DataFrame | Sequence[str], wanted: Sequence[str]) -> None:
    available = list(df.columns) if isinstance(df, DataFrame) else list(df)
    missing = [name for name in wanted if name not in available]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}. Available columns: {', '.join(available)}")


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_posts_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as strings, blanks kept as blanks, rows with too many fields
    skipped and rows with too few filled up."""
    names = list(columns) if columns else csv_columns(spark, path)
    return fitting_rows(_reader(spark), names).csv(path).transform(keep_fitting, names)


def stream_posts_csv(spark: SparkSession, folder: str, columns: Sequence[str] | None, max_files: int) -> DataFrame:
    """The files of a folder as a stream, by the rules of `read_posts_csv`."""
    names = list(columns) if columns else csv_columns(spark, folder)
    reader = _reader(spark, stream=True).option("maxFilesPerTrigger", max_files)
    return fitting_rows(reader, names).csv(folder).transform(keep_fitting, names)


def fitting_rows(reader: DataFrameReader, names: Sequence[str]) -> DataFrameReader:
    """A reader that puts the text of every row of another width into `_bad`."""
    return (
        reader.schema(string_schema([*names, "_bad"]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("columnPruning", False)
    )


def keep_fitting(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Skip rows that are too long; the separators outside quotes tell them from short ones."""
    bare = F.regexp_replace("_bad", '"[^"]*"', "")
    separators = F.char_length(F.regexp_replace(bare, "[^,]", ""))
    fits = F.col("_bad").isNull() | (separators < len(names))
    # Spark refuses to read `_bad` alone, as a bare count would.
    fits = fits & (F.char_length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0)
    return rows.filter(fits).select(*_quoted(names)).na.fill("")


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def read_strict_csv(spark: SparkSession, path: str, blank: bool = True, nested: bool = False) -> DataFrame:
    """All columns as strings; a row of another width stops the job."""
    rows = (
        _reader(spark)
        .option("recursiveFileLookup", nested)
        .schema(string_schema(csv_columns(spark, path, nested)))
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .csv(path)
    )
    return rows.na.fill("") if blank else rows


def read_focal_csv(spark: SparkSession, path: str, column: str = "focal") -> DataFrame:
    """Focal labels: strict, unquoted blanks are null."""
    rows = read_strict_csv(spark, path, blank=False)
    require_columns(rows, [column])
    return rows


def read_labels_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Typed labels: an explicit schema, or types inferred by one more pass."""
    reader = _reader(spark)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


#: Where an append to an actor map goes; the number orders the appends.
MAP_BATCH = "batch-"


def read_actor_map(spark: SparkSession, path: str) -> DataFrame:
    """Map entries with their order: the files of the map, then its appends by number."""
    rows = read_strict_csv(spark, path, nested=True)
    require_columns(rows, ["label", "canonical"])
    file = F.input_file_name()
    batch = F.coalesce(F.regexp_extract(file, f"/{MAP_BATCH}(\\d+)/[^/]*$", 1).try_cast("int"), F.lit(0))
    order = F.struct(batch.alias("batch"), file.alias("file"), F.monotonically_increasing_id().alias("line"))
    numbered = rows.withColumn("seq", order)
    return numbered if "occurrences" in rows.columns else numbered.withColumn("occurrences", F.lit("0"))
