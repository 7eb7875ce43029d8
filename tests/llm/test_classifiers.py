"""The field's passes against enumeration, gradients, held-out accuracy, and odd inputs."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import line_crf, toxicity
from frameloom.llm.queries import QUERIES
from frameloom.llm.training import agreed_labels, id_remainder, minimize


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    ones = labels.sum()
    return (order[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def test_minimize_finds_the_minimum():
    found = minimize(lambda x: (float(((x - 3) ** 2 * [1, 10]).sum()), 2 * (x - 3) * [1, 10]), np.zeros(2))
    assert np.allclose(found, 3, atol=1e-3)


def test_marginals_equal_those_of_all_labelings():
    random = np.random.default_rng(1)
    texts = [b"a b\nc\n\nD!! E!!", b"", b"x | y\nz", b"one"]
    bins, size, lines = line_crf.measured(texts)
    field = line_crf.Field(random.normal(size=line_crf.FEATURES), random.normal(size=(2, 2)))
    chains = line_crf.Chains(bins, lines)
    good = field.weights[chains.features].sum(axis=1)[chains.place]
    expected, at = [], 0
    for n in lines:
        total, ones = 0.0, np.zeros(n)
        for labels in product((0, 1), repeat=int(n)):
            path = sum(good[at + i] for i in range(n) if labels[i])
            path += sum(field.tie[a, b] for a, b in zip(labels, labels[1:], strict=False))
            total += np.exp(path)
            ones += np.exp(path) * np.array(labels)
        weight = size[at : at + n] + 1
        expected.append(float((ones / total * weight).sum() / weight.sum()))
        at += n
    assert np.allclose(field.quality(texts), expected)


def test_neighbouring_lines_matter():
    bins, _, lines = line_crf.measured([b"Good line.\n%%% $$$\nGood line."])
    chains = line_crf.Chains(bins, lines)
    middle = set(chains.features[1].tolist())
    assert middle != set(line_crf.Chains(*[x for i, x in enumerate(line_crf.measured([b"Good line.\n%%% $$$"])) if i != 1]).features[1].tolist())


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_blocks_of_a_long_text_add_up(monkeypatch, block):
    text = b"Word word, WORD 12 | x\n" * 400 + b"tail " * 900 + b"\n" + b"y" * 5000 + b"\n \t \x0b" + b" " * 90 + b"\nEnd end end."
    whole = line_crf.count_lines(text + b"\n")
    monkeypatch.setattr(line_crf, "BLOCK", block)
    parts = line_crf._long(text)
    assert np.array_equal(parts[0], whole[0]) and np.array_equal(parts[1], whole[1])


def test_a_line_above_a_block_is_measured_as_any_other():
    text = b"again again once " * 200_000 + b"\n" + b"short line\n" * 3
    assert len(text) > 3 << 20
    long, usual = line_crf.measured([text]), line_crf.measured([text, b"x"])
    assert np.array_equal(long[0], usual[0][:-1]) and np.array_equal(long[1], usual[1][:-1])


def test_long_examples_teach_and_lines_are_bounded(spark, documents):
    bad = "BUY!! NOW!! $$$ %%%\n" * 5000
    rows = [(i, f"A quiet line {i}.\nAnd another.") for i in range(20)] + [(100 + i, bad) for i in range(2)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "_id bigint, _label int")
    docs = documents(*rows)
    field = line_crf.fit(docs, labels)  # the only bad examples have 5,001 lines
    assert field.share is None and field.quality([bad[:2000].encode()])[0] < 0.5 < field.quality([b"A quiet line 3.\nAnd another."])[0]
    few = []
    usual = line_crf.fit_bins
    line_crf.fit_bins = lambda bins, *rest: few.append(len(bins)) or usual(bins, *rest)
    try:
        line_crf.fit(docs, labels, most_lines=3)
    finally:
        line_crf.fit_bins = usual
    assert few[0] in (1, 2)


def test_grams_are_distinct_and_whole(monkeypatch):
    grams = toxicity.Grams()
    text = "the quick brown fox " * 50 + "Ünïcode 漢字"
    whole = np.sort(np.concatenate(list(grams.blocks(text))))
    assert len(set(whole.tolist())) == len(whole)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.array_equal(np.sort(np.concatenate(list(grams.blocks(text)))), whole)
    assert len(list(grams.blocks(""))) <= 1 and len(list(grams.blocks(None))) <= 1


def test_one_label_alone_gives_its_share():
    model = toxicity.fit_rows([np.array([1, 2])], np.array([0]), (3, 0))
    assert model.score(toxicity.Grams(), "x") == pytest.approx(1 / 5)
    field = line_crf.fit_bins([np.zeros((1, line_crf.MEASURES), np.uint8)], np.array([1]), (0, 3))
    assert field.quality([b"x", b""]).tolist() == [0.8, 0.8]
    assert toxicity.fit_rows([], np.empty(0, np.int64), (0, 0)).score(toxicity.Grams(), "x") == 0.5


@pytest.mark.parametrize(
    ("query", "label", "least"), [("op5_line_crf", "quality", 0.97), ("op7_toxicity", "toxic", 0.9)]
)
def test_held_out_ranking(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[query](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    found = rows.join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(found["score"].to_numpy(), found[label].to_numpy()) >= least
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.filter("score < 0 or score > 1 or score is null or predicted != int(score >= 0.7)").count() == 0


def test_odd_documents_and_labels(spark, documents):
    good, bad = "This is a quiet line.\nAnd another one.", "BUY!! NOW!! $$$ %%%\nBUY!! BUY!! ###"
    long = "You are a pathetic idiot. " * 20_000
    rows = [(i, good + f" {i}") for i in range(30)] + [(100 + i, bad + f" idiot {i}") for i in range(30)]
    rows += [(200, None), (201, ""), (202, long), (None, good), (0, good)]
    docs = documents(*rows, extra=["score", "predicted"])
    given = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(5, 0), (6, None), (None, 1), (7, 3), (999, 1)]
    labels = agreed_labels(spark.createDataFrame(given, "doc_id bigint, good int"), "doc_id", "good")
    assert labels.filter("_id = 5").count() == 0 and labels.filter("_id = 7").count() == 1
    for module in (line_crf, toxicity):
        out = module.classify(docs, module.fit(docs, labels)).collect()
        assert len(out) == len(rows)
        assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7) for row in out)
        assert all(row.predicted == 1 for row in out if row.doc_id is not None and row.doc_id < 30)
        assert all(row.predicted == 0 for row in out if row.doc_id is not None and 100 <= row.doc_id < 200)
        none = module.classify(docs.limit(0), module.fit(docs.limit(0), labels.limit(0)))
        assert none.count() == 0


def test_held_out_rows_do_not_teach(spark):
    import zlib

    rows = spark.range(200).select(F.col("id"), id_remainder(F.col("id"), 4).alias("r")).collect()
    assert all(row.r == zlib.crc32(str(row.id).encode()) % 4 for row in rows)
    assert spark.range(1).select(id_remainder(F.lit(None).cast("bigint"), 4).alias("r")).first().r == 0
