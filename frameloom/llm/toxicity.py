"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

A text is lower-cased and padded with a space; its features are the distinct runs of
three to five characters, hashed into a fixed number of buckets. On labelled texts the
log-count ratio of a bucket is how much likelier it is in a text of label 1 than in
one of label 0. Logistic regression learns a weight for each bucket's ratio.

The classifier is fitted on at most `most` labelled texts of either label, those whose
ids have the lowest digests; its intercept is then set to the shares of the labels
among all of them. Every text is scored whole, in blocks, whatever its length.

Null and empty texts have one feature fewer than any other and get a score as well.
Without examples of both labels every score is their smoothed share. Labels that are
not 0 or 1, and ids whose labels disagree, do not count. Columns that have the name of
an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from frameloom.llm.training import minimize, sampled, sampled_texts

ORDERS = (3, 4, 5)
BUCKET_BITS = 18
#: Labelled texts with label 0 and label 1 that the classifier is fitted on at most.
MOST = (3000, 1500)
#: Strength of the penalty on the weights.
PENALTY = 0.1
THRESHOLD = 0.7
#: Characters that are hashed together.
BLOCK = 1 << 18
FACTOR, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Finds the distinct buckets of a text; remembers by a stamp which it has seen."""

    def __init__(self):
        self.stamp = np.zeros(1 << BUCKET_BITS, np.int64)
        self.last = np.zeros(1 << BUCKET_BITS, np.int64)
        self.text = 0

    def blocks(self, text: str | None):
        """The buckets of a text, each once, block by block."""
        codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.text += 1
        for start in range(0, len(codes), BLOCK):
            block = codes[start : start + BLOCK + ORDERS[-1] - 1]
            gram, found = block, []
            for order in range(2, ORDERS[-1] + 1):
                if len(block) < order:
                    break
                gram = gram[: len(block) - order + 1] * FACTOR + block[order - 1 :]
                if order in ORDERS:
                    own = gram[:BLOCK]
                    found.append((((own ^ (own >> np.uint64(29))) + np.uint64(order)) * MIX) >> np.uint64(64 - BUCKET_BITS))
            if not found:
                continue
            buckets = np.concatenate(found).astype(np.int64)
            buckets = buckets[self.stamp[buckets] != self.text]
            order_seen = np.arange(len(buckets))
            self.last[buckets] = order_seen
            buckets = buckets[self.last[buckets] == order_seen]
            self.stamp[buckets] = self.text
            yield buckets


@dataclass
class Model:
    """`weights` per bucket, ratios included, and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, grams: Grams, text: str | None) -> float:
        margin = self.intercept + sum(float(self.weights[b].sum(dtype=np.float64)) for b in grams.blocks(text))
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


@F.arrow_udf(ArrayType(IntegerType()))
def _buckets(column: pa.Array) -> pa.Array:
    grams = Grams()
    rows = [np.concatenate([np.empty(0, np.int64), *grams.blocks(text.as_py())]) for text in column]
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, shares: tuple[int, int]) -> Model:
    """The classifier of texts given by their buckets; `shares` counts all labels."""
    size = 1 << BUCKET_BITS
    weights, none = np.zeros(size), float(np.log((shares[1] + 1) / (shares[0] + 1)))
    found = np.bincount(labels, minlength=2)
    if not found.all():
        return Model(weights.astype(np.float32), none)
    counts = [np.zeros(size), np.zeros(size)]
    for row, label in zip(rows, labels, strict=True):
        counts[label][row] += 1
    ratio = np.log((counts[1] + 1) / (found[1] + 2)) - np.log((counts[0] + 1) / (found[0] + 2))
    step = 256
    groups = [
        (np.concatenate(rows[at : at + step]), np.array([len(r) for r in rows[at : at + step]]))
        for at in range(0, len(rows), step)
    ]
    sign = 2.0 * labels - 1

    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        own, intercept = point[:-1], point[-1]
        scaled = own * ratio
        value, slope = 0.5 * PENALTY * float(own @ own), np.zeros(size + 1)
        for at, (buckets, lengths) in enumerate(groups):
            ends = np.cumsum(lengths)
            sums = np.r_[0.0, np.cumsum(scaled[buckets])][np.r_[0, ends]]
            s = sign[at * step : at * step + len(lengths)]
            margin = s * (np.diff(sums) + intercept)
            value += float(np.logaddexp(0, -margin).sum())
            pull = -s / (1 + np.exp(np.clip(margin, -500, 500)))
            slope[:-1] += np.bincount(buckets, np.repeat(pull, lengths), size)
            slope[-1] += pull.sum()
        slope[:-1] = slope[:-1] * ratio + PENALTY * own
        return value, slope

    point = minimize(loss, np.zeros(size + 1), rounds=60)
    shift = np.log(shares[1] / shares[0]) - np.log(found[1] / found[0])
    return Model((point[:-1] * ratio).astype(np.float32), float(point[-1] + shift))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", most: tuple[int, int] = MOST) -> Model:
    """The classifier; `labels` holds `_id` and `_label`, each id once."""
    sample, shares = sampled(labels, most)
    rows = sampled_texts(docs, sample, text, id).select("_label", _buckets(F.col("_text")).alias("buckets")).toArrow()
    return fit_rows(
        [np.asarray(row.values) for row in rows.column("buckets")],
        rows.column("_label").to_numpy().astype(np.int64),
        shares,
    )


def score(text: Column, model: Model) -> Column:
    """The chance that a text is toxic."""

    @F.arrow_udf(DoubleType())
    def run(column: pa.Array) -> pa.Array:
        grams = Grams()
        return pa.array([model.score(grams, value.as_py()) for value in column], pa.float64())

    return run(text)


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `score` and `predicted`, 1 if the score reaches the threshold."""
    return docs.withColumn("score", score(F.col(text), model)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
