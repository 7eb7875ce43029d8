"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each block of vectors keeps an
inverted file for every pivot: which of its vectors have the pivot among their first
`LENGTH`, and at what position. A query walks the files of its own first pivots and
adds up what each shared pivot takes off the footrule distance of the two orders (a
pivot that one of them lacks counts as standing behind the last). The `SHARE` of each
block that comes nearest by footrule, at least `LEAST` and all that tie with the last of
them, is ranked again by the Euclidean distance of the original vectors.

Pivots are distinct vectors out of the `SAMPLE` rows whose ids have the lowest digests.
Every row is indexed. Queries go through the index in groups of about `GROUP`, which
are broadcast; each pass reads the whole index, and a task keeps the best of its blocks.

Vectors that are null, empty or zero or hold a null or a number that is not finite, and
rows with a null id, take no part. Vectors of different dimensions have no distance: each
dimension has an index of its own, and a query meets the vectors of its dimension. Of the
rows of one id that are queries the one with the smallest vector asks; none of them is a
candidate. Other repeated rows are candidates of their own. Ties go to the smaller id. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.session import settle, work_folder

PIVOTS = 256
#: Rows that pivots are chosen from.
SAMPLE = 2048
#: Pivots of a vector's order that are posted.
LENGTH = 128
#: Vectors of a block.
BLOCK = 4096
#: Part of a block, and number of its vectors at least, that is ranked again.
SHARE, LEAST = 0.08, 200
#: Queries of one pass.
GROUP = 4096
NEAREST = 10

BLOCK_KINDS = "ids binary, vectors binary, cuts binary, members binary, positions binary"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def usable_rows(table: DataFrame, id: str, vector: str) -> DataFrame:
    """`id` and `vector` (doubles) of the rows that take part."""
    kinds = F.col(vector).cast("array<double>")
    rows = table.select(F.col(id).cast("bigint").alias("id"), kinds.alias("vector"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))


def _stacked(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(column.flatten(), np.float64).reshape(rows, -1)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).toArrow()
    vectors = _stacked(sample.column("vector"), sample.num_rows) if sample.num_rows else np.empty((0, 1))
    first = np.sort(np.unique(vectors, axis=0, return_index=True)[1])
    return vectors[first[:pivots]]


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The first pivots of each vector, nearest first; equally near ones by number."""
    squares = (pivots * pivots).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.argsort(squares, axis=1, kind="stable")[:, :LENGTH]


def _files(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverted files of a block: where each pivot's begins, members, and positions."""
    order = orders(vectors, pivots)
    pivot, member = order.ravel(), np.repeat(np.arange(len(vectors)), order.shape[1])
    position = np.tile(np.arange(order.shape[1]), len(vectors))
    by_pivot = np.argsort(pivot, kind="stable")
    cuts = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))
    return cuts.astype(np.int64), member[by_pivot].astype(np.uint16), position[by_pivot].astype(np.uint8)


def build_index(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row per block of at most `BLOCK` vectors, with its inverted files."""

    def block(ids: np.ndarray, vectors: np.ndarray) -> tuple:
        return tuple(part.tobytes() for part in (ids, vectors, *_files(vectors, pivots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = np.empty(0, np.int64), np.empty((0, pivots.shape[1]))
        names = [kind.split()[0] for kind in BLOCK_KINDS.split(", ")]

        def out(n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block(ids[:n], vectors[:n])], names)

        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            vectors = np.concatenate([vectors, _stacked(batch.column(1), batch.num_rows)])
            while len(ids) >= BLOCK:
                yield out(BLOCK)
                ids, vectors = ids[BLOCK:], vectors[BLOCK:]
        if len(ids):
            yield out(len(ids))

    return settle(rows.mapInArrow(run, BLOCK_KINDS), "permutation-index")


def _nearest(scores: np.ndarray, ids: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, scores))[:nearest]
    return scores[best], ids[best]


def search(index: DataFrame, pivots: np.ndarray, ids: np.ndarray, vectors: np.ndarray, nearest: int) -> DataFrame:
    """The nearest vectors that each partition of the index finds for a bounded group of queries."""
    order = orders(vectors, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                kinds = (np.int64, np.float64, np.int64, np.uint16, np.uint8)
                own, points, cuts, members, positions = (np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True))
                points = points.reshape(len(own), -1)
                gains = LENGTH - positions.astype(np.int32)  # what a posting takes off the footrule, by its own position
                wanted = max(LEAST, int(np.ceil(SHARE * len(own))))
                for q, query in enumerate(ids):
                    near = np.zeros(len(own), np.int32)
                    for at, pivot in enumerate(order[q]):
                        posted = slice(cuts[pivot], cuts[pivot + 1])
                        near[members[posted]] += np.minimum(gains[posted], LENGTH - at)
                    if len(own) > wanted:
                        chosen = np.flatnonzero(near >= np.partition(near, -wanted)[-wanted])
                    else:
                        chosen = np.arange(len(own))
                    chosen = chosen[own[chosen] != query]
                    apart = points[chosen] - vectors[q]
                    scores = np.sqrt((apart * apart).sum(axis=1))
                    found = _nearest(scores, own[chosen], nearest)
                    best[q] = _nearest(np.r_[best[q][0], found[0]], np.r_[best[q][1], found[1]], nearest)
        sizes = [len(scores) for scores, _ in best]
        columns = [np.repeat(ids, sizes), *(np.concatenate([b[i] for b in best] or [np.empty(0)]) for i in (1, 0))]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def neighbours(
    table: DataFrame, every: int = 100, nearest: int = NEAREST, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """`query_id`, `rank`, `vec_id` and `score` for every row whose id `every` divides."""
    spark = table.sparkSession
    usable = usable_rows(table, id, vector)
    path = f"{work_folder(spark)}/neighbours-{uuid.uuid4().hex}"
    kinds = "query_id bigint, vec_id bigint, score double"
    spark.createDataFrame([], kinds).write.parquet(path)
    asking = usable.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    asking = settle(asking.withColumn("size", F.size("vector")), "queries")
    for size, queries in sorted(map(tuple, asking.groupBy("size").count().collect())):
        rows = usable.filter(F.size("vector") == size)
        pivots = choose_pivots(rows)
        index = build_index(rows, pivots)
        groups = -(-queries // GROUP)
        of_size = asking.filter(F.col("size") == size).drop("size")
        for group in range(groups):
            some = of_size.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == group).toArrow()
            if some.num_rows:
                ids, vectors = some.column("id").to_numpy(), _stacked(some.column("vector"), some.num_rows)
                search(index, pivots, ids, vectors, nearest).write.mode("append").parquet(path)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = spark.read.schema(kinds).parquet(path).withColumn("rank", F.row_number().over(by))
    return ranked.filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
