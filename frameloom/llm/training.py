"""What the classifiers share: bounded samples of labelled rows, and a minimizer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.session import settle


def id_remainder(id: Column, by: int) -> Column:
    """crc32 of an id as text, modulo `by`; a null id counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % by


def agreed_labels(labels: DataFrame, id: str, label: str) -> DataFrame:
    """One row per id whose labels that are 0 or 1 agree; other rows do not count."""
    sure = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1))
    each = sure.groupBy(F.col(id).alias("_id")).agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
    return each.filter("_label = _other").select("_id", F.col("_label").cast("int").alias("_label"))


def sampled(labels: DataFrame, most: tuple[int, int]) -> tuple[DataFrame, tuple[int, int]]:
    """At most `most[label]` ids of each label, lowest digests first, and how many there are."""
    labels = settle(labels, "labels")
    counts = dict(map(tuple, labels.groupBy("_label").count().collect()))
    parts = [
        labels.filter(F.col("_label") == value).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(most[value])
        for value in (0, 1)
    ]
    return settle(parts[0].unionByName(parts[1]), "sample"), (counts.get(0, 0), counts.get(1, 0))


def sampled_texts(docs: DataFrame, sample: DataFrame, text: str, id: str) -> DataFrame:
    """`_label` and `_text` of the sampled ids, one row each; of several texts the smallest.

    The sample's size is bounded by its parameter, so it is broadcast.
    """
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    joined = rows.join(F.broadcast(sample), "_id")
    return joined.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def minimize(
    function: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 100, memory: int = 8
) -> np.ndarray:
    """L-BFGS with a backtracking line search; `function` gives value and gradient."""
    x = start
    value, slope = function(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, used = slope.copy(), []
        for s, y, rho in reversed(steps):
            used.append(rho * (s @ way))
            way -= used[-1] * y
        if steps:
            s, y, _ = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(steps, reversed(used), strict=True):
            way += (a - rho * (y @ way)) * s
        fall, size = slope @ way, 1.0 if steps else 1.0 / max(1.0, float(np.abs(slope).sum()))
        if fall <= 1e-12 * max(1.0, abs(value)):
            break
        while True:
            new = x - size * way
            new_value, new_slope = function(new)
            if new_value <= value - 1e-4 * size * fall or size < 1e-10:
                break
            size /= 2
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1.0 / (s @ y))] if len(steps) >= memory else [*steps, (s, y, 1.0 / (s @ y))]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x
