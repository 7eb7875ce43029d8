"""Removal against a table of all strings, marks that move with the text, and sorted ranges."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from frameloom.llm import prefix_doubling
from frameloom.session import Scratch


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, sha256(rest).hexdigest()))
    return out


def compared(documents, rows, length):
    given = documents(*rows, extra=["at", "d1", "rank", "n_bytes", "codes"])
    got = [tuple(r) for r in prefix_doubling.remove_repeats(given, length=length).collect()]
    want = [(doc, *row) for (doc, _), row in zip(rows, brute([r[1] for r in rows], length), strict=True)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return sum(row[2] for row in got)


def prose(some, n):
    words = ["alpha", "beta", "gamma", "delta", "Élan", "漢字", "of", "the", "1234"]
    return " ".join(some.choice(words) + str(some.randrange(10_000) if some.random() < 0.6 else "") for _ in range(n))


def passages(seed):
    """Texts that share passages of many lengths around the limit, with different neighbours."""
    some = random.Random(seed)
    shared = [prose(some, n) for n in (20, 45, 55, 60, 70, 100, 200)]
    texts = []
    for _ in range(60):
        parts = [prose(some, some.randrange(0, 60)) for _ in range(3)]
        for _ in range(some.randrange(0, 3)):
            passage = some.choice(shared)
            a, b = some.randrange(0, 30), some.randrange(0, 30)
            parts.insert(some.randrange(len(parts)), passage[a : len(passage) - b])
        texts.append("".join(parts))
    near = prose(some, 400)
    for _ in range(40):  # near copies, each with an edit of its own
        at = some.randrange(len(near))
        texts.append(near[:at] + str(some.random()) + near[at + 3 :])
    return texts


@pytest.mark.parametrize(("seed", "length"), [(1, 400), (2, 150)])
def test_against_all_strings(documents, seed, length):
    assert compared(documents, list(enumerate(passages(seed))), length) > 0


def test_odd_texts(documents):
    some = random.Random(9)
    one, two = prose(some, 120), prose(some, 120)
    texts = [None, "", "short", "a" * 399, "a" * 400, "a" * 401, "a" * 3000, "ab" * 900, one, one, one, two, two[1:], two[:-1]]
    texts += [one + two, "x" + one, one[:399], one[:400], "b" * 401, "漢" * 500, one + one, "c" * 400 + "d" + "c" * 400]
    rows = list(enumerate(texts)) + [(None, two), (None, None), (3, one), (3, one)]
    assert compared(documents, rows, 400) > 0


def test_one_hot_passage(documents):
    some = random.Random(4)
    hot = prose(some, 90)
    rows = [(i, (hot if i % 3 else "") + prose(some, 20) + (hot[7:] if i % 2 else "")) for i in range(150)]
    assert compared(documents, rows, 400) > 0


def test_empty_table(documents):
    assert prefix_doubling.remove_repeats(documents((1, "x")).limit(0)).count() == 0
    assert [r.n_removed for r in prefix_doubling.remove_repeats(documents((1, "x"))).collect()] == [0]


def test_marks_depend_on_what_is_near():
    some = np.random.default_rng(2)
    data = some.integers(97, 122, 6000).astype(np.uint8)
    whole = prefix_doubling.marks(data)
    assert len(whole) > 60 and (np.diff(whole) > prefix_doubling.REACH).all()
    assert (prefix_doubling.marks(data, stretch=100) == whole).all()
    part = prefix_doubling.marks(data[1000:3000]) + 1000
    inner = whole[(whole >= 1000 + prefix_doubling.REACH) & (whole < 3000 - prefix_doubling.REACH - prefix_doubling.BLOCK + 1)]
    assert (part == inner).all()


@pytest.mark.parametrize("batch", [1, 2, 3, 1000])
def test_ranks_of_cut_ranges(spark, batch):
    some = random.Random(batch)
    keys = sorted(some.choice([1, 2, 3, 3, 3, 3, 4, 50, 51, 52]) for _ in range(60))
    names = ["uid", "at", "span", "most", "a", "b", "c"]
    rows = [(i, i, 0, 0, k, 7, 0) for i, k in enumerate(keys)]
    counts = Counter(keys)
    kept, sizes = {}, Counter()
    for part, (low, high) in enumerate([(0, 13), (13, 14), (14, 40), (40, 60)]):
        kinds = [pa.int64()] + [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32()]
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : min(i + batch, high)], strict=True), kinds, strict=True)], names)
            for i in range(low, high, batch)
        ]
        for out in prefix_doubling._numbered(iter(batches), part):
            for row in out.to_pylist():
                if row["uid"] is None:
                    sizes[row["a"]] += row["n"]
                else:
                    kept[row["uid"]] = row["rank"]
    for i, key in enumerate(keys):
        assert (i in kept) or counts[key] == 1
        assert counts[key] == 1 or sizes[key] in (0, counts[key])
    by_key = spark.createDataFrame(rows, "uid long, at int, span int, most int, a long, b long, c int")
    with Scratch(spark) as keep:
        got = prefix_doubling.ranked(by_key, keep).collect()
    assert {r.uid for r in got} == {i for i, k in enumerate(keys) if counts[k] > 1}
    assert len({r.rank for r in got}) == sum(n > 1 for n in counts.values()) == sum(r["first"] for r in got)
    assert sorted(got, key=lambda r: r.uid) == sorted(got, key=lambda r: (r.rank, r.uid))


def test_strings_leave_a_task_packed_and_one_of_each_digest(spark):
    some = random.Random(7)
    hot = prose(some, 90).encode()
    texts = [prose(some, 60).encode() + hot[n % 5 :] + prose(some, 60).encode() for n in range(40)]
    counted = [len(prefix_doubling.marks(np.frombuffer(text, np.uint8))) for text in texts]
    rows = [(n, bytearray(text), 1, [m * 256 + 9 for m in range(counted[n])]) for n, text in enumerate(texts)]  # all may repeat
    given = spark.createDataFrame(rows, "uid long, text binary, copies long, codes array<long>").coalesce(1)
    packed = prefix_doubling._strings(given, 400, 2)
    found = packed.collect()  # a row for each string before
    assert [(row.part, row.known is None) for row in found] == [(0, True), (1, True), (0, False)]
    asked = np.concatenate([np.frombuffer(bytes(row.asked), prefix_doubling._ASKED) for row in found[:2]])
    assert len(np.unique(asked[["a", "b"]])) == len(asked)
    codes = sorted((row.uid, row.code >> 8) for row in prefix_doubling._repeated(packed, 2).collect())
    places = [(uid, at) for uid, text in enumerate(texts) for at in range(len(text) - 399)]
    counts = Counter(texts[uid][at : at + 400] for uid, at in places)
    assert codes == [(uid, at) for uid, at in places if counts[texts[uid][at : at + 400]] > 1] != []


def test_texts_of_a_batch_are_looked_at_together():
    texts = [text.encode() for text in passages(3)]
    bounds = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
    found = prefix_doubling.Letters(np.frombuffer(b"".join(texts), np.uint8), bounds, 400)
    for n, text in enumerate(texts):
        own = slice(found.firsts[n], found.firsts[n + 1])
        wanted = prefix_doubling.marks(np.frombuffer(text, np.uint8))
        assert (found.starts[own] + prefix_doubling.REACH - bounds[n] == wanted).all() and (found.own[own] == n).all()
