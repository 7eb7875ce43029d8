"""Vector codes in whole numbers, assigned with pivot bounds.

Each component x becomes floor(1024 x). Vectors are cut into `PARTS` consecutive parts
(of equal length, or the first ones a component longer), and each part position learns a
codebook: it starts as that part of the `ENTRIES` smallest ids, and each round assigns
every part to the nearest entry (ties to the lower index) and moves each used entry to
the floor of its parts' mean.

Fixed pivots, a few spread parts of the first codebook, are chosen once. The squared
distances of every part to its pivots are computed once and written beside the vectors.
Each round computes the entries' distances to the pivots; the difference of both is a
lower bound of a part's distance to an entry, which orders the entries and rules out all
whose bound exceeds the best exact distance so far. Distances are whole numbers: 64 bits
wide where none can overflow, Python's own else.

Each round reads the written vectors, sums parts by entry within its tasks and brings
`ENTRIES` sums a part to the driver, however many vectors there are.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of
another dimension have codebooks of their own, all learnt in the same rounds. Null ids
come after all others; rows with the same id are ordered by their vectors. With fewer
rows than entries the codebook is as large as the table. Rows of one label, null labels
included, add up; a sum or error beyond 64 bits becomes the largest 64-bit number, and
component sums beyond 38 digits raise an error. An empty table gives an empty
result. Other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import with_totals
from frameloom.session import settle

#: Components are multiplied by so much before they are floored.
SCALE = 1024
PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 8
#: Entries whose exact distances are taken at once, in the order of their bounds.
STEP = 8
#: Up to this size of all components and entries, squared distances fit into 64 bits.
NARROW = 1 << 26
#: Rows that a task assigns at once.
ROWS = 2048
LARGEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) of rows of doubles, exactly."""
    scaled = np.floor(vectors * SCALE)
    if not np.isfinite(scaled).all():  # beyond the range of doubles once multiplied
        return np.vectorize(lambda x: int(x) * SCALE if abs(x) > 2.0**60 else int(np.floor(x * SCALE)), otypes=[object])(vectors)
    return narrow(scaled.astype(np.int64)) if np.abs(scaled).max(initial=0) < NARROW else wide(scaled)


def narrow(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.int64)


def wide(numbers: np.ndarray) -> np.ndarray:
    """Python's whole numbers, which never overflow."""
    return np.array([int(x) for x in numbers.ravel()], dtype=object).reshape(numbers.shape)


def borders(dimension: int, parts: int) -> list[int]:
    """Where the parts begin and end."""
    longer = dimension % parts
    return [dimension // parts * n + min(n, longer) for n in range(parts + 1)]


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows that stand beside each other."""
    apart = parts - entries
    return (apart * apart).sum(axis=-1)


def spread(entries: np.ndarray, pivots: int) -> np.ndarray:
    """The first entry, then always the one farthest from all chosen; ties to the lower index."""
    chosen = [0]
    nearest = squared(entries, entries[:1])
    while len(chosen) < min(pivots, len(entries)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squared(entries, entries[chosen[-1:]]))
    return entries[chosen]


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([squared(parts, pivot[None, :]) for pivot in pivots], axis=1) if len(parts) else np.zeros((0, len(pivots)))


def nearest_entries(
    parts: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part, its squared distance, and how many distances were computed.

    `to_pivots` are the roots of the parts' squared distances to the pivots. A bound is
    lessened by more than rounding can add, so no entry is ruled out that might win.
    """
    own = np.sqrt(pivot_distances(entries, pivots).astype(np.float64))
    bounds = np.zeros((len(parts), len(entries)))
    for k in range(len(pivots)):
        apart = np.abs(to_pivots[:, k, None] - own[None, :, k])
        apart -= 1e-12 * (to_pivots[:, k, None] + own[None, :, k])
        np.maximum(bounds, apart, out=bounds)
    bounds *= bounds
    order = np.argsort(bounds, axis=1)
    best = np.zeros(len(parts), np.int64)
    least = np.zeros(len(parts), parts.dtype)
    open_rows, asked = np.arange(len(parts)), 0
    for start in range(0, len(entries), STEP):
        ids = order[open_rows, start : start + STEP]
        found = squared(parts[open_rows, None, :], entries[ids])
        asked += found.size
        low = found.min(axis=1)
        index = np.where(found == low[:, None], ids, len(entries)).min(axis=1)
        if start:
            old, kept = least[open_rows], best[open_rows]
            better = (low < old) | ((low == old) & (index < kept))
            low, index = np.where(better, low, old), np.where(better, index, kept)
        least[open_rows], best[open_rows] = low, index
        if start + STEP < len(entries):
            ahead = bounds[open_rows, order[open_rows, start + STEP]]
            open_rows = open_rows[ahead <= least[open_rows].astype(np.float64) * (1 + 1e-12)]
        if not len(open_rows):
            break
    return best, least, asked


class Codebooks:
    """The entries of all part positions for vectors of one dimension, and the fixed pivots."""

    def __init__(self, first: np.ndarray, parts: int = PARTS, pivots: int = PIVOTS):
        self.cuts = borders(first.shape[1], parts)
        self.entries = [first[:, a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.pivots = [spread(entries, pivots) for entries in self.entries]

    def digest(self) -> str:
        numbers = (str(int(x)) for entries in self.entries for x in entries.ravel())
        return sha256(",".join(numbers).encode()).hexdigest()

    def measured(self, vectors: np.ndarray) -> np.ndarray:
        """The distances of all parts of some vectors to the pivots, as doubles."""
        rows = whole(vectors)
        found = [
            pivot_distances(*_alike(rows[:, a:b], pivots)).astype(np.float64)
            for a, b, pivots in zip(self.cuts, self.cuts[1:], self.pivots, strict=False)
        ]
        return np.sqrt(np.concatenate(found, axis=1))

    def assign(self, vectors: np.ndarray, measured: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each part position: the rows' parts, entries, squared distances, and how many were computed."""
        rows, at = whole(vectors), 0
        for a, b, entries, pivots in zip(self.cuts, self.cuts[1:], self.entries, self.pivots, strict=False):
            parts, entries = _alike(rows[:, a:b], entries)
            own = measured[:, at : at + len(pivots)]
            at += len(pivots)
            yield parts, *nearest_entries(parts, entries, own, _alike(parts, pivots)[1])


def _alike(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as narrow numbers if they are, else both wide."""
    if left.dtype == right.dtype == np.int64:
        return left, right
    return left.astype(object), right.astype(object)


def first_codebooks(vectors: DataFrame, parts: int, entries: int, pivots: int) -> dict[int, Codebooks]:
    """The codebooks of each dimension from the smallest ids; at most `entries` rows a dimension reach the driver."""
    books = {}
    for (dimension,) in sorted(vectors.select(F.size("vector")).distinct().collect()):
        same = vectors.filter(F.size("vector") == dimension)
        rows = same.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
        first = whole(np.array([row.vector for row in rows], np.float64).reshape(len(rows), dimension))
        books[dimension] = Codebooks(first, parts, pivots)
    return books


def _groups(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """The rows of each dimension: it, their numbers, and their lists as matrices; some rows at a time."""
    sizes = np.asarray(batch.column("vector").value_lengths())
    for dimension in np.unique(sizes):
        all_rows = np.flatnonzero(sizes == dimension)
        for start in range(0, len(all_rows), ROWS):
            rows = all_rows[start : start + ROWS]
            lists = [batch.column(name).take(pa.array(rows)) for name in names]
            yield int(dimension), rows, [_matrix(column, len(rows)) for column in lists]


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def _with_pivots(vectors: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """`vectors` with `pivots`: the distances of all parts to their pivots."""
    schema = vectors.select("*", F.array(F.lit(0.0)).alias("pivots")).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for dimension, rows, (matrix,) in _groups(batch, "vector"):
                for row, found in zip(rows, books[dimension].measured(matrix), strict=True):
                    out[row] = found
            yield batch.append_column("pivots", pa.array(out, pa.list_(pa.float64())))

    return vectors.mapInArrow(measure, schema)


def _sums(vectors: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """How many parts each entry is nearest to, and their component sums: `dimension, part, entry, at, n, total`."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dimension, _, (matrix, measured) in _groups(batch, "vector", "pivots"):
                book = books[dimension]
                for part, (parts, best, _, _) in enumerate(book.assign(matrix, measured)):
                    key, size = (dimension, part), len(book.entries[part])
                    if key not in counts:
                        counts[key] = np.zeros(size, np.int64)
                        totals[key] = np.zeros((size, parts.shape[1]), object)
                    counts[key] += np.bincount(best, minlength=size)
                    added = np.zeros((size, parts.shape[1]), parts.dtype)
                    np.add.at(added, best, parts)
                    totals[key] += added
        for (dimension, part), n in counts.items():
            used, width = np.flatnonzero(n), totals[dimension, part].shape[1]
            yield pa.RecordBatch.from_pydict(
                {
                    "dimension": pa.array(np.full(len(used) * width, dimension, np.int32)),
                    "part": pa.array(np.full(len(used) * width, part, np.int32)),
                    "entry": pa.array(np.repeat(used, width).astype(np.int32)),
                    "at": pa.array(np.tile(np.arange(width), len(used)).astype(np.int32)),
                    "n": pa.array(np.repeat(n[used], width)),
                    "total": pa.array([str(int(x)) for x in totals[dimension, part][used].ravel()], pa.string()),
                }
            )

    kinds = "dimension int, part int, entry int, at int, n bigint, total string"
    found = vectors.mapInArrow(assign, kinds).withColumn("total", F.col("total").cast("decimal(38,0)"))
    return found.groupBy("dimension", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _moved(books: dict[int, Codebooks], sums: DataFrame) -> None:
    """Move each used entry to the floor of its parts' mean."""
    rows = sums.collect()  # a row for each component of the codebooks
    new = {dimension: [entries.astype(object) for entries in book.entries] for dimension, book in books.items()}
    for row in rows:
        new[row.dimension][row.part][row.entry, row.at] = int(row.total) // row.n
    for dimension, parts in new.items():
        books[dimension].entries = [
            narrow(entries) if np.abs(entries).max(initial=0) < NARROW else entries for entries in parts
        ]


def _coded(vectors: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    digests = {dimension: book.digest() for dimension, book in books.items()}
    schema = vectors.select(
        "id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit("").alias("codebooks_sha256"),
        F.lit(0).cast("bigint").alias("computed"),
    ).schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, prints = [""] * batch.num_rows, [""] * batch.num_rows
            errors, computed = [0] * batch.num_rows, [0] * batch.num_rows
            for dimension, rows, (matrix, measured) in _groups(batch, "vector", "pivots"):
                for _, best, least, asked in books[dimension].assign(matrix, measured):
                    for row, index, distance in zip(rows.tolist(), best.tolist(), least.tolist(), strict=True):
                        codes[row] += f"{index:02x}"
                        errors[row] += int(distance)
                        prints[row] = digests[dimension]
                    computed[rows[0]] += asked
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("label"), pa.array(codes, pa.string()),
                    pa.array([min(e, LARGEST) for e in errors], pa.int64()), pa.array(prints, pa.string()),
                    pa.array(computed, pa.int64()),
                ],
                names=["id", "label", "code", "error", "codebooks_sha256", "computed"],
            )

    return vectors.mapInArrow(assign, schema)


def compress(
    table: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """The code of each usable vector, its error, and the error of all rows with its label.

    `computed` of a row counts the exact distances of its group of rows in the last
    assignment (it stands at the group's first row); all pairs would be
    rows x parts x entries.
    """
    kept = table.filter(usable(F.col(vector))).select(
        F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    books = first_codebooks(kept, parts, entries, pivots)
    vectors = settle(_with_pivots(kept, books), "vectors")
    for _ in range(rounds):
        _moved(books, _sums(vectors, books))
    coded = settle(_coded(vectors, books), "codes")
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy("label").agg(F.least(exact, F.lit(LARGEST)).cast("bigint").alias("label_error"), F.count("*").alias("n"))
    out = with_totals(coded, "label", totals, "n")
    return out.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error", "label_error", "codebooks_sha256", "computed")
