"""Fingerprints and components against brute force, dense groups included."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import gray_simhash as g


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(values):
    """The index of the first value of each one's part, by all pairs."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    array = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= 2) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "A b c d É É É", "x " * 5000 + "y", "tab\tnew\nline\x0bvt"])
def test_fingerprint(text):
    assert g.simhash(text) == brute_fingerprint(text)


def test_gray_rank_walks_the_gray_sequence(spark):
    codes = [(i ^ (i >> 1),) for i in range(300)]
    ranks = spark.createDataFrame(codes, "c bigint").select(g.gray_rank(F.col("c")).alias("r")).collect()
    assert [row.r for row in ranks] == list(range(300))


def clusters(seed, centres, members, most):
    random = np.random.default_rng(seed)
    values = []
    for centre in random.integers(0, 1 << 63, centres, dtype=np.uint64).tolist():
        for _ in range(members):
            value = centre
            for bit in random.integers(0, 64, random.integers(0, most + 1)).tolist():
                value ^= 1 << bit
            values.append(value)
    return values


@pytest.mark.parametrize(("centres", "members", "most"), [(300, 3, 3), (2, 700, 5), (1, 1500, 9)])
def test_components_of_fingerprints(spark, centres, members, most):
    values = sorted(set(clusters(7, centres, members, most)) | {0, 1, 3, (1 << 64) - 1})
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    found = g.components(spark.createDataFrame(signed, "doc_id bigint, fingerprint bigint"))
    got = {row.fingerprint: row.component_id for row in found.collect()}
    assert [got[v] for _, v in signed] == brute_parts(values)


def test_a_dense_node_with_lower_nodes():
    random = np.random.default_rng(3)
    low = np.unique(random.integers(0, 1 << 16, 3000, dtype=np.uint64))
    rank = low.copy()
    for shift in (1, 2, 4, 8):
        rank ^= rank >> np.uint64(shift)
    low = low[np.argsort(rank)]
    label = g.join_nodes(np.zeros(len(low), np.int64), np.zeros(len(low), np.uint64), low)
    expected = brute_parts(low.tolist())
    assert len(set(label.tolist())) == len(set(expected))
    assert len(set(zip(label.tolist(), expected, strict=True))) == len(set(expected))


def test_a_long_chain_is_one_component(spark):
    links = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = g.connected(links)
    assert roots.count() == 3001 and roots.select("root").distinct().count() == 1
    assert g.connected(links.limit(0)).count() == 0


def test_documents_with_odd_rows(spark, documents):
    text = " ".join(f"w{i}" for i in range(400))
    near = text.replace("w200", "v200")
    rows = [(5, text), (3, text), (9, near), (9, near), (None, text), (20, None), (21, ""), (30, "alone here"), (40, "x" * 300_000)]
    docs = documents(*rows, extra=["fingerprint", "component_id", "component"])
    out = [tuple(row) for row in g.near_duplicates(docs).collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    first = brute_parts(prints)
    ids = [min((rows[j][0] for j in range(len(rows)) if first[j] == first[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    expected = [(rows[i][0], format(prints[i], "016x"), ids[i]) for i in range(len(rows))]
    assert sorted(out, key=str) == sorted(expected, key=str)
    kept = g.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(ids))
    assert g.near_duplicates(docs.limit(0)).count() == 0


def test_a_group_without_ids_keeps_one_row(documents):
    docs = documents((None, "same text of no one"), (None, "same text of no one"), (None, "another text entirely, by chance"))
    assert g.one_of_each(docs).count() == 2
