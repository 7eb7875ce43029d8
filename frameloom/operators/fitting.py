"""Classifiers fitted by L-BFGS, whose losses and gradients are sums over blocks of rows.

The blocks stay with Spark's tasks. One pass over them, a job, serves everything that is
fitted at once: the classes of a support vector machine and the folds of a cross-validation
share it. What a task sends is as large as the gradients.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wider vectors of a linear model stay sparse and are not scaled.
DENSE_WIDTH = 4096
#: Rows of a block at most, and entries of a sparse one; rows that make a further task.
BLOCK_ROWS, BLOCK_ENTRIES = 512, 1 << 19
ROWS_PER_TASK, MOST_ROWS_PER_TASK = 2000, 20_000
#: Rows that make a further task where vectors are wide and sparse, with some thousand entries.
WIDE_ROWS_PER_TASK = 100
#: Gradients of all tasks together, in bytes, that the driver adds up by itself.
DRIVER_BYTES = 64_000_000
#: Steps that shape a direction, trials along one, and values that must differ.
MEMORY, TRIALS, VALUES = 10, 30, 20


@dataclass
class Block:
    """Some rows of a table: a matrix, or the entries of a sparse one; classes and weights.

    Sparse rows may have entries in common: then the entries are those of parts, and to a
    `row` belongs such a `share` of a `part`."""

    table: int
    width: int
    y: np.ndarray
    weight: np.ndarray
    matrix: np.ndarray | None = None
    at: np.ndarray | None = None
    values: np.ndarray | None = None
    sizes: np.ndarray | None = None
    row: np.ndarray | None = None
    part: np.ndarray | None = None
    share: np.ndarray | None = None

    def times(self, w: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return self.matrix @ w
        # Row by row: its weights, side by side in memory, are at hand when they are multiplied.
        w, out = np.ascontiguousarray(w, self.values.dtype), np.zeros((len(self.sizes), w.shape[1]))
        for n, (end, size) in enumerate(zip(np.cumsum(self.sizes).tolist(), self.sizes.tolist())):
            out[n] = self.values[end - size : end] @ w.take(self.at[end - size : end], axis=0)
        return out if self.row is None else _dealt(self.row, self.share[:, None] * out[self.part], len(self.y))

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transposed rows times `r`."""
        if self.matrix is not None:
            return self.matrix.T @ r
        if self.row is not None:
            r = _dealt(self.part, self.share[:, None] * r[self.row], len(self.sizes))
        at = self.at.astype(np.intp)
        columns = [np.bincount(at, np.repeat(column, self.sizes) * self.values, self.width) for column in r.T]
        return np.stack(columns, axis=1)


def _dealt(to: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by where they go."""
    return np.stack([np.bincount(to, column, size) for column in rows.T], axis=1)


def _block(table: int, width: int, rows: list[tuple], dense: bool) -> Block:
    vectors, y, weight = zip(*rows)
    y, weight = np.array(y), np.array(weight, float)
    if dense:
        return Block(table, width, y, weight, matrix=np.stack([v.toArray() for v in vectors]))
    entries = [(v.indices, v.values) if isinstance(v, SparseVector) else (np.arange(width), v.values) for v in vectors]
    at, values = (np.concatenate(part) for part in zip(*entries))
    sizes = np.array([len(i) for i, _ in entries])
    return Block(table, width, y, weight, at=at.astype(np.int32), values=values, sizes=sizes)


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors by their fields: how many entries each has, and where and what these are."""
    sizes = pc.list_value_length(vectors.field("values")).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.field("values").flatten().to_numpy(zero_copy_only=False)
    at = (np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
    if sparse.any():
        at[np.repeat(sparse, sizes)] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    return sizes, at, values


def arrow_blocks(
    table: int, width: int, vectors: pa.StructArray, y: np.ndarray, weight: np.ndarray, dense: bool, kind: type = np.float64
) -> Iterator[Block]:
    """As `_block`, of vectors by their fields; as many blocks as their entries take."""
    for first in range(0, len(vectors), BLOCK_ROWS):
        sizes, at, values = entries(vectors.slice(first, BLOCK_ROWS))
        until, start = np.cumsum(np.full(len(sizes), width) if dense else sizes), 0
        ends = np.concatenate([[0], np.cumsum(sizes)])
        while start < len(sizes):
            before = until[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(until, before + BLOCK_ENTRIES, "right")))
            own, those, n = slice(ends[start], ends[end]), slice(first + start, first + end), sizes[start:end]
            if dense:
                matrix = np.zeros((end - start, width), kind)
                matrix[np.repeat(np.arange(end - start), n), at[own]] = values[own]
                yield Block(table, width, y[those], weight[those], matrix=matrix)
            else:
                yield Block(table, width, y[those], weight[those], at=at[own], values=values[own].astype(kind), sizes=n)
            start = end


@dataclass(frozen=True)
class Table:
    """Training rows: a vector, a class and a weight; how many there are and how wide."""

    rows: DataFrame
    count: int
    width: int
    classes: tuple[str, ...]
    dense: bool
    #: Of the numbers in a matrix.
    kind: type = np.float64
    #: Makes sparse blocks inside a task: of the rows' batches, their class and weight and the blocks' fields.
    maker: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]] | None = None
    #: Columns by which rows with entries in common become neighbors.
    group: Sequence[str] = ()


def task_counts(rows: Sequence[int], cores: int, least: Sequence[int] | None = None) -> list[int]:
    """Tasks of each table, the larger tasks first: all cores get equally many, each worth a task
    by the `least` rows of one."""
    rounds = max(2, -(-sum(rows) // (MOST_ROWS_PER_TASK * cores)))
    even, more = divmod(rounds * cores, len(rows))
    wanted = [even + (n >= len(rows) - more) for n in range(len(rows))]
    least = least or [ROWS_PER_TASK] * len(rows)
    return [max(1, min(n // few, max(some, n // MOST_ROWS_PER_TASK))) for n, some, few in zip(rows, wanted, least)]


def blocks(tables: Sequence[Table]) -> RDD:
    """The rows in even partitions: enough to use all cores, but each worth a task."""
    context = tables[0].rows.sparkSession.sparkContext

    def cut(table: Table, which: int, tasks: int) -> RDD:
        width, dense, kind, classes, maker = table.width, table.dense, table.kind, list(table.classes), table.maker

        def numbers(label: pa.Array) -> np.ndarray:
            return pc.index_in(label, value_set=pa.array(classes, label.type)).to_numpy(zero_copy_only=False)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, label, weight = batch.columns
                y = numbers(label)
                for block in arrow_blocks(which, width, vectors, y, weight.to_numpy(zero_copy_only=False), dense, kind):
                    yield _pickled(block)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (label, weight), fields in maker(batches):
                fields["values"] = fields["values"].astype(kind)
                yield _pickled(Block(which, width, numbers(label), weight.to_numpy(zero_copy_only=False), **fields))

        if maker is None:
            # As fields, in Arrow: rows of vectors would be pickled entry by entry, with their schema in each batch.
            fields = table.rows.toDF("_x", "_label", "_weight").withColumn("_x", F.unwrap_udt("_x"))
            made = fields.repartition(tasks).mapInArrow(run, "block binary")
        else:
            rows = table.rows.repartition(tasks, *table.group).sortWithinPartitions(*table.group)
            made = rows.mapInArrow(make, "block binary")
        return made.rdd.map(lambda row: pickle.loads(row[0]))

    least = [ROWS_PER_TASK if table.dense else WIDE_ROWS_PER_TASK for table in tables]
    tasks = task_counts([table.count for table in tables], context.defaultParallelism, least)
    return context.union([cut(table, n, tasks[n]) for n, table in enumerate(tables)]).persist(StorageLevel.MEMORY_AND_DISK)


def _pickled(block: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": [pickle.dumps(block, pickle.HIGHEST_PROTOCOL)]})


def summed(rdd: RDD, run: Callable[[Block], np.ndarray], size: int = 0) -> dict[int, np.ndarray]:
    """For each table, the sum of what `run` makes of its blocks: `size` numbers or so."""

    def add(part: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        totals: dict[int, np.ndarray] = {}
        for block in part:
            found = run(block)
            if found is not None:
                totals[block.table] = totals[block.table] + found if block.table in totals else found
        yield from totals.items()

    sums = rdd.mapPartitions(add)
    if 8 * size * rdd.getNumPartitions() > DRIVER_BYTES:
        # Large ones of a table meet in a task first.
        sums = sums.reduceByKey(np.add, rdd.context.defaultParallelism)
    out: dict[int, np.ndarray] = {}
    for table, found in sums.collect():
        out[table] = out[table] + found if table in out else found
    return out


# --- losses: of one block, for the classes `which` if each has its own weights ---------------


def _split(theta: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts."""
    return theta[:width], theta[width]


def softmax_loss(block: Block, which: Sequence[int], thetas: np.ndarray) -> np.ndarray:
    """Multinomial logistic loss; the first class has no column of coefficients, its score is 0."""
    columns = len(thetas) // (block.width + 1)
    w, b = _split(thetas.reshape(block.width + 1, columns), block.width)
    z = block.times(w) + b
    loss, r = _cross_entropy(np.hstack([np.zeros((len(z), 1)), z]), block)
    r = r[:, 1:]
    return np.concatenate([[loss], block.back(r).ravel(), r.sum(0)])


def _cross_entropy(z: np.ndarray, block: Block) -> tuple[float, np.ndarray]:
    """The loss and what it changes by with `z`."""
    rows = np.arange(len(z))
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z)
    total = p.sum(axis=1, keepdims=True)
    loss = float(block.weight @ (np.log(total[:, 0]) - z[rows, block.y]).astype(np.float64))
    p /= total
    p[rows, block.y] -= 1.0
    p *= block.weight[:, None]
    return loss, p


def hinge_loss(block: Block, which: Sequence[int], thetas: np.ndarray) -> np.ndarray:
    """Hinge loss of each class in `which` against the rest."""
    w, b = _split(thetas.reshape(len(which), block.width + 1).T, block.width)
    sign = np.where(block.y[:, None] == np.asarray(which), 1.0, -1.0)
    margin = 1.0 - sign * (block.times(w) + b)
    r = np.where(margin > 0, -sign, 0.0) * block.weight[:, None]
    losses = block.weight @ np.maximum(margin, 0.0)
    return np.concatenate([losses, np.vstack([block.back(r), r.sum(0)]).T.ravel()])


def layer_weights(theta: np.ndarray, layers: Sequence[int]) -> list[np.ndarray]:
    """A matrix between each two layers, its last row the intercepts."""
    sizes = [(a + 1, b) for a, b in zip(layers, layers[1:])]
    ends = np.cumsum([a * b for a, b in sizes])
    return [part.reshape(size) for part, size in zip(np.split(theta, ends[:-1]), sizes)]


def activations(x: np.ndarray, weights: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The inputs of every layer: sigmoids between, the last one plain."""
    out = [x]
    for n, w in enumerate(weights):
        z = out[-1] @ w[:-1]
        z += w[-1]
        if n < len(weights) - 1:
            most = 700.0 if z.dtype == np.float64 else 80.0  # of what has a finite exponential
            np.clip(np.negative(z, z), -most, most, z)
            np.exp(z, z)
            z += 1.0
            np.reciprocal(z, z)
        out.append(z)
    return out


def perceptron_loss(block: Block, which: Sequence[int], thetas: np.ndarray, hidden: Sequence[int]) -> np.ndarray:
    """Logistic loss behind the layers, counted with numbers of the matrix's kind; blocks are added up in doubles."""
    before = sum((a + 1) * b for a, b in zip([block.width, *hidden], hidden))
    layers = [block.width, *hidden, (len(thetas) - before) // (hidden[-1] + 1)]
    weights = layer_weights(thetas.astype(block.matrix.dtype, copy=False), layers)
    seen = activations(block.matrix, weights)
    loss, r = _cross_entropy(seen[-1], block)
    found: list[np.ndarray] = []
    for n in range(len(weights) - 1, -1, -1):
        found.insert(0, np.vstack([seen[n].T @ r, r.sum(0)]))
        if n:
            r = r @ weights[n][:-1].T
            r *= seen[n]
            r *= 1.0 - seen[n]
    return np.concatenate([[loss], *(part.ravel() for part in found)])


# --- the method ---------------------------------------------------------------------


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.einsum("i,i->", a, b))  # no threads beside those of the tasks


def lbfgs(x: np.ndarray, limit: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, int, float]]:
    """Asks for losses and gradients at points; returns the last point, its iterations and loss.

    It ends by a small gradient, or by losses that hardly changed for some iterations.
    """
    value, slope = yield x
    start, values, steps = value, [value], []
    for iteration in range(limit):
        if np.sqrt(_dot(slope, slope)) <= max(tolerance * abs(value), 1e-8):
            return x, iteration, value
        way, shares = -slope, []
        for step, change, scale in reversed(steps):
            shares.append(scale * _dot(step, way))
            way = way - shares[-1] * change
        if steps:
            step, change, _ = steps[-1]
            way *= _dot(step, change) / _dot(change, change)
        for (step, change, scale), share in zip(steps, reversed(shares)):
            way = way + (share - scale * _dot(change, way)) * step
        along = _dot(way, slope)
        if not along < 0:
            steps, way, along = [], -slope, -_dot(slope, slope)
        size, low, high = 1.0 if steps else 1.0 / np.sqrt(_dot(slope, slope)), 0.0, np.inf
        for _ in range(TRIALS):
            there, new = yield x + size * way
            if not there <= value + 1e-4 * size * along:
                high = size
            elif _dot(new, way) < 0.9 * along:
                low = size
            else:
                break
            size = (low + high) / 2 if high < np.inf else 2 * low
        else:
            return x, iteration, value
        step, change = size * way, new - slope
        if _dot(step, change) > 1e-12 * _dot(change, change):
            steps = [*steps, (step, change, 1.0 / _dot(step, change))][-MEMORY:]
        x, value, slope = x + step, there, new
        values.append(value)
        if len(values) > VALUES and max(values[-VALUES:]) - value <= tolerance * abs(start):
            return x, iteration + 1, value
    return x, limit, value


@dataclass(frozen=True)
class Problem:
    """What to solve: the table, the class if each has a problem, the start, how a point becomes
    weights of the rows, and how their mean loss and gradient become those of the point."""

    table: int
    label: int
    start: np.ndarray
    inner: Callable[[np.ndarray], np.ndarray]
    outer: Callable[[np.ndarray, float, np.ndarray], tuple[float, np.ndarray]]


def minimize(
    rdd: RDD,
    loss: Callable[[Block, Sequence[int], np.ndarray], np.ndarray],
    problems: Sequence[Problem],
    totals: dict[int, float],
    limit: int,
    tolerance: float,
) -> list[tuple[np.ndarray, int, float]]:
    """Solve all problems, each pass over the blocks for all that are still open: weights of the
    rows, iterations, loss."""
    runs = [lbfgs(problem.start, limit, tolerance) for problem in problems]
    points, done = {n: next(run) for n, run in enumerate(runs)}, {}
    while points:
        open_ones: dict[int, list[int]] = {}
        for n in sorted(points):
            open_ones.setdefault(problems[n].table, []).append(n)
        weights = {
            table: ([problems[n].label for n in which], np.concatenate([problems[n].inner(points[n]) for n in which]))
            for table, which in open_ones.items()
        }
        sent = rdd.context.broadcast(weights)
        found = summed(rdd, partial(_evaluated, loss, sent), max(len(w) for _, w in weights.values()))
        sent.destroy()
        for table, which in open_ones.items():
            means = found[table] / totals[table]
            for n, value, gradient in zip(which, means, np.split(means[len(which) :], len(which))):
                try:
                    points[n] = runs[n].send(problems[n].outer(points[n], float(value), gradient))
                except StopIteration as end:
                    x, iterations, value = end.value
                    done[n] = problems[n].inner(x), iterations, value
                    del points[n]
    return [done[n] for n in range(len(problems))]


def _evaluated(loss: Callable, sent: Broadcast, block: Block) -> np.ndarray | None:
    weights = sent.value.get(block.table)
    return None if weights is None else loss(block, *weights)


@dataclass(frozen=True)
class Classifier:
    """Weights of a fitted model: a matrix of scores by class, or one between each two layers."""

    weights: tuple[np.ndarray, ...]
    classes: tuple[str, ...]
    iterations: int = 0
    losses: tuple[float, ...] = ()

    def best(self, vectors: pa.StructArray) -> np.ndarray:
        """The number of the highest score's class, of vectors by their fields."""
        found, width = [np.zeros(0, np.int64)], self.width
        nothing = np.zeros(len(vectors))
        for block in arrow_blocks(0, width, vectors, nothing, nothing, len(self.weights) > 1 or width <= DENSE_WIDTH):
            found.append(self.best_of(block))
        return np.concatenate(found)

    @property
    def width(self) -> int:
        return len(self.weights[0]) - 1

    def best_of(self, block: Block) -> np.ndarray:
        """As `best`, of the rows of a block."""
        if block.matrix is None:
            return (block.times(self.weights[0][:-1]) + self.weights[0][-1]).argmax(axis=1)
        return activations(block.matrix, self.weights)[-1].argmax(axis=1)

    def named(self, best: np.ndarray) -> pa.Array:
        return pa.array(self.classes, pa.string()).take(pa.array(best))

    def predicted(self, vector: Column, spark: SparkSession) -> Column:
        shared = spark.sparkContext.broadcast(self)

        def run(vectors: pa.Array) -> pa.Array:
            return shared.value.named(shared.value.best(vectors))

        return F.arrow_udf(run, "string")(F.unwrap_udt(vector))

    def save(self, path: str, spark: SparkSession) -> None:
        """One row for each row of a matrix."""
        rows = [(at, n, row) for at, matrix in enumerate(self.weights) for n, row in enumerate(matrix)]
        names = ["matrix", "row", "weights"]
        table = pa.table([pa.array(column) for column in zip(*rows)], names=names)
        spark.createDataFrame(table).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str, classes: Sequence[str], spark: SparkSession) -> Classifier:
        rows = spark.read.parquet(path).orderBy("matrix", "row").toArrow()
        at = rows["matrix"].to_numpy()
        table = [np.array(row) for row in rows["weights"].to_pylist()]
        matrices = [np.stack([table[i] for i in np.flatnonzero(at == n)]) for n in range(at[-1] + 1)]
        return Classifier(tuple(matrices), tuple(classes))


def _scaled(table: int, label: int, moments: np.ndarray, width: int, columns: int, penalty: float) -> Problem:
    """A linear model with squared coefficients as a penalty. The points are those of centered,
    scaled features where these are dense, which changes the way but not the goal. Of several
    columns, which are of classes, only the differences from the first one reach the rows."""
    mean, scale, (count, _), sums = np.zeros(width), np.ones(width), moments[:2], moments[2:]
    if len(sums):
        mean = sums[:width] / count
        scale = np.sqrt(np.maximum(sums[width:] / count - mean**2, 0.0))
        scale = np.where(scale > 1e-9, scale, 1.0)

    def inner(point: np.ndarray) -> np.ndarray:
        theta = point.reshape(width + 1, columns).copy()
        theta[:width] /= scale[:, None]
        theta[width] -= np.einsum("i,ik->k", mean, theta[:width])
        return (theta[:, 1:] - theta[:, :1] if columns > 1 else theta).ravel()

    def outer(point: np.ndarray, value: float, gradient: np.ndarray) -> tuple[float, np.ndarray]:
        g, w = gradient.reshape(width + 1, -1).copy(), point.reshape(width + 1, columns)[:width] / scale[:, None]
        if columns > 1:
            g = np.hstack([-g.sum(axis=1, keepdims=True), g])
        g[:width] = (g[:width] - mean[:, None] * g[width] + penalty * w) / scale[:, None]
        return value + 0.5 * penalty * float((w * w).sum()), g.ravel()

    return Problem(table, label, np.zeros((width + 1) * columns), inner, outer)


def _moments(block: Block) -> np.ndarray:
    sums = [block.matrix.sum(0), (block.matrix**2).sum(0)] if block.matrix is not None else []
    return np.concatenate([[len(block.y), block.weight.sum()], *sums])


def logistic_regression(rdd: RDD, tables: Sequence[Table], strength: float, limit: int, tolerance: float) -> list[Classifier]:
    """Multinomial, or binomial for two classes; `strength` is the inverse of the penalty."""
    moments, out = summed(rdd, _moments), []
    columns = [len(t.classes) if len(t.classes) > 2 else 1 for t in tables]
    problems = [
        _scaled(n, 0, moments[n], t.width, columns[n], 1.0 / (strength * t.count)) for n, t in enumerate(tables)
    ]
    solved = minimize(rdd, softmax_loss, problems, {n: m[1] for n, m in moments.items()}, limit, tolerance)
    for table, (theta, iterations, value) in zip(tables, solved):
        w = theta.reshape(table.width + 1, -1)
        w = np.hstack([np.zeros((len(w), 1)), w])[:, : len(table.classes)]
        if len(table.classes) > 2:
            w -= w.mean(axis=1, keepdims=True)  # where the penalty is least
        out.append(Classifier((w,), table.classes, iterations, (value,)))
    return out


def support_vectors(rdd: RDD, tables: Sequence[Table], strength: float, limit: int, tolerance: float) -> list[Classifier]:
    """One machine for each class against the rest."""
    moments = summed(rdd, _moments)
    problems = [
        _scaled(n, label, moments[n], t.width, 1, 1.0 / (strength * t.count))
        for n, t in enumerate(tables)
        for label in range(len(t.classes))
    ]
    solved, out = iter(minimize(rdd, hinge_loss, problems, {n: m[1] for n, m in moments.items()}, limit, tolerance)), []
    for table in tables:
        thetas, iterations, values = zip(*(next(solved) for _ in table.classes))
        out.append(Classifier((np.stack(thetas, axis=1),), table.classes, max(iterations), values))
    return out


def perceptron(
    rdd: RDD, tables: Sequence[Table], hidden: Sequence[int], limit: int, tolerance: float, seed: int
) -> list[Classifier]:
    """Sigmoid layers under a softmax, without a penalty."""
    problems, shapes = [], []
    for n, table in enumerate(tables):
        layers = [table.width, *hidden, len(table.classes)]
        some = np.random.default_rng(seed)
        start = np.concatenate([some.uniform(-2.4, 2.4, (a + 1) * b) / a for a, b in zip(layers, layers[1:])])
        problems.append(Problem(n, 0, start, lambda x: x, lambda _, value, gradient: (value, gradient)))
        shapes.append(layers)
    totals = {n: m[1] for n, m in summed(rdd, _moments).items()}
    solved = minimize(rdd, partial(perceptron_loss, hidden=tuple(hidden)), problems, totals, limit, tolerance)
    return [
        Classifier(tuple(layer_weights(theta, layers)), table.classes, iterations, (value,))
        for table, layers, (theta, iterations, value) in zip(tables, shapes, solved)
    ]
