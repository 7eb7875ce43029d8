"""Recall against brute force, exact scores, ties and odd vectors."""

import numpy as np
import pytest

from frameloom.llm import permutation
from frameloom.llm.queries import QUERIES

KINDS = "vec_id bigint, embedding array<float>"


def brute(ids, vectors, query, nearest=10):
    distance = np.sqrt(((vectors - vectors[list(ids).index(query)]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, distance)) if ids[i] != query][:nearest]
    return [(int(ids[i]), float(distance[i])) for i in order]


def found(rows):
    by_query = {}
    for row in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    return by_query


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64)
    got = found(QUERIES["op4_permutation"](spark, sf_dir).collect())
    assert set(got) == {i for i in ids if i % 100 == 0}
    hits = 0
    for query, rows in got.items():
        exact = brute(ids, vectors, query)
        hits += len({v for v, _ in exact} & {v for _, v, _ in rows})
        assert [r for r, _, _ in rows] == list(range(1, 11))
        scores = dict(brute(ids, vectors, query, len(ids)))
        assert all(scores[v] == s for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
    assert hits >= 0.9 * 10 * len(got)


def test_small_blocks_find_what_one_block_finds(spark, monkeypatch):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(size=8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, KINDS).coalesce(1)
    usual = found(permutation.neighbours(df).collect())
    monkeypatch.setattr(permutation, "BLOCK", 64)
    monkeypatch.setattr(permutation, "GROUP", 2)
    small = found(permutation.neighbours(df).collect())
    vectors = np.array([r[1] for r in rows], np.float32).astype(float)
    ids = np.arange(400)
    for query, best in small.items():  # blocks of 64 are searched whole
        assert [(v, s) for _, v, s in best] == brute(ids, vectors, query)
    assert usual.keys() == small.keys()


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 260)]
    rows += [(300, None), (400, []), (500, [0.0, 0.0]), (600, [1.0, None]), (700, [1.0, float("nan")])]
    rows += [(800, [float("inf"), 1.0]), (900, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1000, [3.0, 4.0]), (1000, [5.0, 5.0])]
    df = spark.createDataFrame(rows, KINDS)
    got = found(permutation.neighbours(df).collect())
    assert set(got) == {0, 100, 200, 1000}
    assert [v for _, v, _ in got[0]] == list(range(1, 11)) and {s for _, _, s in got[0]} == {0.0}
    assert [v for _, v, _ in got[200]] == list(range(10))
    assert [v for _, v, _ in got[1000]] == list(range(10))  # the smaller of its vectors asks
    assert got[1000][0][2] == np.sqrt(20.0)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], KINDS)
    assert found(permutation.neighbours(df).collect()) == {0: [(1, 1, 1.0)]}
    assert permutation.neighbours(df.limit(0)).count() == 0
    assert permutation.neighbours(df.filter("vec_id = 0")).count() == 0


def test_vectors_meet_those_of_their_own_dimension(spark):
    random = np.random.default_rng(4)
    wide = {i: random.normal(size=5).astype(np.float32) for i in range(0, 300)}
    narrow = {i: random.normal(size=3).astype(np.float32) for i in range(1000, 1130)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in [*wide.items(), *narrow.items()]], KINDS)
    got = found(permutation.neighbours(df).collect())
    assert set(got) == {0, 100, 200, 1000, 1100}
    for query, best in got.items():
        own = wide if query in wide else narrow
        assert len(best) == 10 and {v for _, v, _ in best} <= set(own)
    for query in (1000, 1100):  # so few are ranked whole
        exact = brute(np.array(list(narrow)), np.array(list(narrow.values()), np.float64), query)
        assert [(v, s) for _, v, s in got[query]] == exact
