"""Classifiers that are fitted by passes over blocks of rows."""

import dataclasses

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from frameloom.operators import fitting, metrics, models
from frameloom.session import settle


def labeled(spark, classes=3, rows=90):
    """Vectors near a corner of their own class, of different scales, in two folds."""
    some = np.random.default_rng(5)
    data = []
    for n in range(rows):
        x = some.normal(0, 1.0, 4) * [1, 10, 0.1, 1] + 3 * (np.arange(4) == n % classes) * [1, 10, 0.1, 1]
        data.append((n, f"g{n}", f"class {n % classes}", n // classes % 2 + 1, x.tolist()))
    return spark.createDataFrame(data, "vec_id int, group_id string, topic string, fold int, embedding array<double>")


def counted(monkeypatch):
    passes = []
    plain = fitting.summed
    monkeypatch.setattr(fitting, "summed", lambda *given: passes.append(1) or plain(*given))
    return passes


def test_folds_and_classes_share_their_passes(spark, monkeypatch):
    rows, passes = labeled(spark), counted(monkeypatch)
    models.fit_model(rows.filter("fold = 1"), "embedding_linear_svm", "topic", [])
    alone = len(passes)
    scores = settle(models.cross_validate(rows, ["embedding_linear_svm"], 2, "topic", []))
    assert len(passes) - alone < 2 * alone
    assert metrics.metric_summary(scores).filter("metric = 'accuracy'").first()["mean"] > 0.8


def test_a_pass_leaves_no_core_without_a_task(spark):
    cores = spark.sparkContext.defaultParallelism
    assert sum(fitting.task_counts([16_000] * (cores + 1), cores)) == 2 * cores  # two more before
    assert [fitting.task_counts([n] * 5, 12) for n in (82_000, 100)] == [[4, 5, 5, 5, 5], [1] * 5]
    assert fitting.task_counts([4_000_000, 10_000], 4) == [200, 5]


def some_block(width=5, rows=12, classes=3):
    some = np.random.default_rng(1)
    x = some.normal(size=(rows, width)) * (some.random((rows, width)) < 0.5)
    return fitting.Block(0, width, some.integers(0, classes, rows), some.random(rows), matrix=x)


def test_perceptron_gradient_is_that_of_its_loss():
    block, hidden = some_block(), (4, 3)
    theta = np.random.default_rng(2).normal(size=6 * 4 + 5 * 3 + 4 * 3)

    def loss(at):
        return fitting.perceptron_loss(block, [0], at, hidden)

    for n, step in enumerate(np.eye(len(theta)) * 1e-6):
        assert loss(theta)[1 + n] == pytest.approx((loss(theta + step)[0] - loss(theta - step)[0]) / 2e-6, abs=1e-6)


def test_perceptron_counts_with_numbers_as_wide_as_an_embeddings(spark, monkeypatch):
    some, plain = [], fitting.perceptron_loss
    block, hidden = some_block(), (4, 3)
    single = dataclasses.replace(block, matrix=block.matrix.astype(np.float32))
    for size in (1.0, 500.0):  # the second fills the sigmoids
        theta = size * np.random.default_rng(2).normal(size=6 * 4 + 5 * 3 + 4 * 3)
        assert plain(single, [0], theta, hidden) == pytest.approx(plain(block, [0], theta, hidden), rel=1e-4, abs=1e-3)
    monkeypatch.setattr(models, "MLP_ITERATIONS", 2)
    blocks = fitting.blocks
    monkeypatch.setattr(fitting, "blocks", lambda tables: some.append(blocks(tables)) or some[0])
    models.fit_model(labeled(spark), "embedding_mlp", "topic", [])
    assert some[0].map(lambda block: str(block.matrix.dtype)).distinct().collect() == ["float32"]


def test_sparse_rows_count_as_dense_ones():
    block = some_block()
    vectors = [Vectors.sparse(5, [(int(i), float(row[i])) for i in np.flatnonzero(row)]) for row in block.matrix]
    sparse = fitting._block(0, 5, list(zip(vectors, block.y, block.weight)), dense=False)
    theta = np.random.default_rng(3).normal(size=6 * 3)
    for loss in (fitting.softmax_loss, fitting.hinge_loss):
        assert loss(sparse, [0, 1, 2], theta) == pytest.approx(loss(block, [0, 1, 2], theta))


def test_rows_of_shared_parts_count_as_dense_ones():
    parts, some = some_block(rows=7), np.random.default_rng(8)
    row, part, share = np.arange(12).repeat(2), some.integers(0, 7, 24), some.random(24)
    matrix = np.zeros((12, 5))
    np.add.at(matrix, row, share[:, None] * parts.matrix[part])
    dense = dataclasses.replace(some_block(), matrix=matrix)
    n, at = np.nonzero(parts.matrix)
    entries = {"at": at.astype(np.int32), "values": parts.matrix[n, at], "sizes": np.bincount(n, minlength=7)}
    shared = dataclasses.replace(dense, matrix=None, **entries, row=row, part=part, share=share)
    theta = some.normal(size=6 * 3)
    for loss in (fitting.softmax_loss, fitting.hinge_loss):
        assert loss(shared, [0, 1, 2], theta) == pytest.approx(loss(dense, [0, 1, 2], theta))


def test_gradient_of_all_classes_from_those_but_the_first():
    block, columns = some_block(), 3
    moments = fitting._moments(block)
    problem, some = fitting._scaled(0, 0, moments, 5, columns, 0.1), np.random.default_rng(7)

    def loss(point):
        found = fitting.softmax_loss(block, [0], problem.inner(point))
        assert len(found) == 1 + 6 * (columns - 1)  # all three before
        return problem.outer(point, found[0], found[1:])

    point = some.normal(size=6 * columns)
    for n, step in enumerate(np.eye(len(point)) * 1e-6):
        assert loss(point)[1][n] == pytest.approx((loss(point + step)[0] - loss(point - step)[0]) / 2e-6, abs=1e-6)


def test_wide_vectors_reach_the_blocks_without_names_of_their_slots(spark):
    width = 5000
    some = [Vectors.sparse(width, [(n, 1.0), (width - 1, 0.5 * n)]) for n in range(8)] + [Vectors.dense(np.arange(width) * 1.0)]
    rows = spark.createDataFrame([(v, f"class {n % 2}", 1.0 + n) for n, v in enumerate(some)], ["_v", "label", "weight"])
    inputs = models.Pipeline(stages=models.feature_stages([], "_v")).fit(rows).transform(rows).select("_x", "label", "weight")
    assert len(inputs.schema.json()) < 1000  # it went with every batch of rows that was pickled
    for dense in (False, True):
        blocks = fitting.blocks([fitting.Table(inputs, 9, width, ("class 0", "class 1"), dense)]).collect()
        w = np.random.default_rng(4).normal(size=(width, 2))
        found = {float(n): (y, z) for b in blocks for n, y, z in zip(b.weight, b.y, b.times(w))}
        assert {n: y for n, (y, _) in found.items()} == {1.0 + n: n % 2 for n in range(9)}
        for n, v in enumerate(some):
            assert found[1.0 + n][1] == pytest.approx(v.toArray() @ w)


def test_predictions_are_made_batch_by_batch(spark):
    some = np.random.default_rng(6)
    for width, sizes in ((5000, [(5001, 3)]), (4, [(5, 3)]), (4, [(5, 6), (7, 3)])):
        weights = tuple(some.normal(size=size) for size in sizes)
        vectors = [Vectors.sparse(width, [(n, 1.0), (width - 1, -0.5)]) for n in range(3)]
        vectors += [Vectors.dense(some.normal(size=width)), Vectors.sparse(width, [])]
        rows = spark.createDataFrame(list(enumerate(vectors)), ["n", "v"])
        found = rows.select("n", fitting.Classifier(weights, ("a", "b", "c")).predicted(F.col("v"), spark).alias("p"))
        assert "ArrowEvalPython" in found._jdf.queryExecution().toString()  # a row of its own for Python before
        wanted = ["abc"[fitting.activations(v.toArray()[None, :], weights)[-1].argmax()] for v in vectors]
        assert [row.p for row in found.orderBy("n").collect()] == wanted


def test_saved_perceptron_predicts_the_same(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(models, "MLP_ITERATIONS", 5)
    rows, passes = labeled(spark), counted(monkeypatch)
    fitted = models.fit_model(rows, "embedding_mlp", "topic", [])
    assert passes  # one job for each loss
    fitted.save(str(tmp_path / "model"), spark)
    again = models.Predictor.load(str(tmp_path / "model"), spark)
    found = [sorted(map(tuple, m.predict(rows).select("vec_id", F.col("predicted")).collect())) for m in (fitted, again)]
    assert found[0] == found[1] and len(found[0]) == rows.count()
