"""Codes against a plain restatement in whole numbers, odd rows, and how much the bounds rule out."""

import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import laesa_codes

KINDS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """(id, label, code, error, digest) of each usable row of (id, vector, label)."""
    out = []
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    for size in {len(r[1]) for r in kept}:
        same = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v], label) for i, v, label in kept if len(v) == size]
        same.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = laesa_codes.borders(size, parts)
        books = [[r[1][a:b] for r in same[:entries]] for a, b in zip(cuts, cuts[1:], strict=False)]

        def find(vector, book, a, b):
            return min((sum((x - y) ** 2 for x, y in zip(vector[a:b], e, strict=True)), n) for n, e in enumerate(book))

        for _ in range(rounds):
            for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                members = {}
                for _, vector, _ in same:
                    members.setdefault(find(vector, books[part], a, b)[1], []).append(vector[a:b])
                for n, found in members.items():
                    books[part][n] = [sum(xs) // len(found) for xs in zip(*found, strict=True)]
        digest = sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, vector, label in same:
            found = [find(vector, books[p], a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            out.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), digest))
    return out


def compared(spark, rows, **how):
    given = spark.createDataFrame(rows, KINDS).withColumns({n: F.lit("mine") for n in ("code", "error", "id", "vector", "pivots", "n")})
    got = [tuple(r) for r in laesa_codes.compress(given, **how).drop("computed").collect()]
    want = brute(rows, **{k: v for k, v in how.items() if k != "pivots"})
    totals = {}
    for _, label, _, error, _ in want:
        totals[label] = totals.get(label, 0) + error
    want = [(i, label, code, min(e, laesa_codes.LARGEST), min(totals[label], laesa_codes.LARGEST), d) for i, label, code, e, d in want]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def vectors(n, size=16, seed=1):
    some = np.random.default_rng(seed)
    return [[float(x) for x in v] for v in some.normal(size=(n, size)).astype(np.float32)]


def test_against_a_restatement(spark):
    rows = [(i * 3, v, i % 3 or None) for i, v in enumerate(vectors(300))]
    rows += [(i, rows[0][1], 7) for i in range(1000, 1200)]  # many copies under one label
    compared(spark, rows, entries=20, pivots=5)


def test_odd_rows(spark):
    good = vectors(30)
    rows = [(i, v, 1) for i, v in enumerate(good)]
    rows += [(5, good[7], 2), (5, good[7], 2), (None, good[8], None), (None, good[9], None)]
    rows += [(40, None, 1), (41, [None] * 16, 1), (42, [math.nan] * 16, 1), (43, [math.inf] + [0.0] * 15, 1)]
    rows += [(44, [0.0] * 16, 1), (45, [], 3), (46, [1.0, 2.0], 3), (47, [1.5, -2.25, 0.0, 1.0, 9.0], 3), (48, [1.0, 2.5], 3)]
    compared(spark, rows, entries=8, pivots=3)


def test_large_components(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(20, 8))]
    rows += [(30, [3e5] * 8, 1), (31, [-2e9] * 8, 1), (32, [1e20] + [0.0] * 7, 2)]
    compared(spark, rows, entries=4, rounds=2)


def test_empty_table(spark):
    assert laesa_codes.compress(spark.createDataFrame([], KINDS)).count() == 0
    assert laesa_codes.compress(spark.createDataFrame([(1, None, 1)], KINDS)).count() == 0


@pytest.mark.parametrize("spread", [0.05, 0.3])
def test_bounds_rule_out_most_entries(spread):
    some = np.random.default_rng(3)
    centers = some.normal(size=(32, 16))
    entries = laesa_codes.whole(centers[some.integers(0, 32, 256)] + spread * some.normal(size=(256, 16)))
    parts = laesa_codes.whole(centers[some.integers(0, 32, 2000)] + spread * some.normal(size=(2000, 16)))
    pivots = laesa_codes.spread(entries, 8)
    own = np.sqrt(laesa_codes.pivot_distances(parts, pivots).astype(float))
    best, least, asked = laesa_codes.nearest_entries(parts, entries, own, pivots)
    apart = ((parts[:, None, :] - entries[None]) ** 2).sum(-1)
    assert (best == apart.argmin(1)).all() and (least == apart.min(1)).all()
    assert asked < 0.5 * len(parts) * len(entries)
