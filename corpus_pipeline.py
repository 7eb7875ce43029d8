"""From raw documents to token ids: five stages, each of which reads what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import byte_bpe, gray_simhash, line_crf, mixing, toxicity
from frameloom.llm.training import agreed_labels
from frameloom.session import settle

#: No SQL states the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return agreed_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", label)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good."""
    field = line_crf.fit(docs, _labels(spark, sf_dir, "quality"))
    return docs.filter(line_crf.score(F.col("text"), field) >= line_crf.THRESHOLD)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    model = toxicity.fit(docs, _labels(spark, sf_dir, "toxic"))
    return docs.filter(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return gray_simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids, their number, and whether they decode to the text again."""
    ids = byte_bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return byte_bpe.decode_documents(ids).select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("toxicity", clean),
    ("simhash near-dedup", distinct),
    ("mixing sources to target weights", mixed),
    ("byte-level bpe encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
