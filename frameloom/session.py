"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_folders: dict[str, str] = {}


def build_session(name: str = "frameloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the jobs are tuned for; `conf` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from `spark.checkpoint.dir`.

    A machine-local folder is used only in local mode with the setting absent.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="frameloom-")
    return _local_folders[app]


def settle(df: DataFrame, name: str = "table", schema: StructType | None = None) -> DataFrame:
    """Write `df` once into the work folder and read it back, as `schema` if given.

    Cuts lineage in a way that outlives lost executors, and fixes the rows of
    steps that would not repeat exactly (labeler replies, range boundaries).
    """
    return _written(df, f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", schema)


def _written(df: DataFrame, path: str, schema: StructType | None = None) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


class Scratch:
    """Settled tables of one job, removed with their folder when the job ends.

    Use it as a context; nothing that reads the tables may outlive it.
    """

    def __init__(self, spark: SparkSession, name: str = "job"):
        self.spark, self.path = spark, f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def __call__(self, df: DataFrame, name: str = "table", schema: StructType | None = None) -> DataFrame:
        return _written(df, f"{self.path}/{name}-{uuid.uuid4().hex}", schema)
