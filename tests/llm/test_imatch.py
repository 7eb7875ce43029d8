"""Fingerprints against a plain restatement, followers, and edited texts."""

import re
from collections import Counter
from hashlib import sha256
from struct import pack

import xxhash

from frameloom.llm import imatch


def hashed(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def long_hash(value, seed=42):
    return hashed(pack("<Q", value % (1 << 64)), seed)


def brute_terms(text):
    words = {w.lower() for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "") if w}
    return {hashed(w.encode()) % (1 << imatch.TERM_BITS) for w in words}


def chained(terms):
    seed = 42
    for term in terms:
        seed = long_hash(term, seed)
    return seed


def brute_fingerprint(terms, band):
    kept = sorted(terms & band) or sorted(terms)
    if not kept:
        return "-"
    parts = [format(chained(kept), "016x")]
    for size in imatch.SIZES:
        for family in range(imatch.FAMILIES):
            drawn = [t for t in kept if long_hash(t) >> 8 * family & 255 < size]
            parts.append(format(chained(drawn), "016x")[:6] if drawn else "-")
    return ".".join(parts)


def brute_band(texts):
    counts = Counter(term for text in texts for term in brute_terms(text))
    return {t for t, n in counts.items() if max(2, imatch.LEAST * len(texts)) <= n <= imatch.MOST * len(texts)}


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if "-" in (a, b):
        return 0.0
    told = [(x, y) for x, y in zip(a.split(".")[1:], b.split(".")[1:], strict=True) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in told) / len(told) if told else 0.0


def test_against_a_restatement(spark, documents):
    texts = [f"common Word{i % 7} rare{i} thing{i % 11} Élan{i % 5} x{i % 23}-y{i % 29}" for i in range(60)]
    texts += ["", None, "only", "word1 " * 30_000, "漢字 😀 a_b"]
    rows = [(1000 - 3 * i, text) for i, text in enumerate(texts)]
    out = {row.doc_id: row for row in imatch.compare_with_next(documents(*rows, extra=["fingerprint", "edited", "_key"])).collect()}
    band = brute_band(texts)
    assert band and len(out) == len(rows)
    prints = [brute_fingerprint(brute_terms(t), band) for t in texts]
    for i, (doc, text) in enumerate(rows):  # rows are in descending order
        after = (i + 1) % len(rows)
        text, half = text or "", len(text or "") // 2
        edited = text[: len(text) - half] + (texts[after] or "")[:half]
        row = out[doc]
        assert (row.n_chars, row.fingerprint) == (len(text), prints[i])
        assert row.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert row.edited_fingerprint == brute_fingerprint(brute_terms(edited), band)
        assert row.near_edited == brute_likeness(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == brute_likeness(row.fingerprint, prints[after])


def test_repeated_and_null_ids_and_equal_texts(spark, documents):
    rows = [(3, "a b c d"), (3, "a b c d"), (3, "zz yy xx ww vv"), (None, "n m"), (1, "a b c d"), (1 << 40, "q r")]
    out = imatch.compare_with_next(documents(*rows)).collect()
    assert sorted((row.doc_id is None, row.doc_id or 0, row.n_chars) for row in out) == sorted((d is None, d or 0, len(t)) for d, t in rows)
    assert len({row.fingerprint for row in out if row.n_chars == 7}) == 1
    # a null id comes last, and the first follows it
    edited = {row.doc_id: row.edited_sha256 for row in out}
    assert edited[1] == sha256(b"a b n m").hexdigest()
    assert edited[1 << 40] == sha256(b"q a").hexdigest()
    assert edited[None] == sha256(b"n q").hexdigest()


def test_one_document_follows_itself_and_none_gives_none(documents):
    (row,) = imatch.compare_with_next(documents((5, "one two"))).collect()
    assert row.edited_sha256 == sha256(b"one one").hexdigest() and row.near_next == 1.0
    assert imatch.compare_with_next(documents((5, "x")).limit(0)).count() == 0


def test_followers_over_many_ranges(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "key")
    got = {row.key: row.next for row in imatch.followers(ids.repartition(13)).collect()}
    keys = sorted(got)
    assert got == dict(zip(keys, [keys[-1], *keys[:-1]], strict=True))


def test_the_band_is_counted_by_term(documents):
    few = 1 << 11  # 2^21 and more terms of one document, which leave the lexicon
    rows = [(i, f"near{i // 4} copy{i // 4} " + " ".join(f"u{n}" for n in range(i * 1100, i * 1100 + 1100))) for i in range(few)]
    out = {row.doc_id: row.fingerprint for row in imatch.compare_with_next(documents(*rows)).collect()}
    assert all(out[i] == out[i // 4 * 4] for i in range(few)) and len(set(out.values())) == few // 4


def test_near_copies_are_more_alike_than_others(documents):
    rows = [(i, " ".join(f"w{(i // 2 * 37 + k * 11) % 997}" for k in range(120 - i % 2))) for i in range(400)]
    out = imatch.compare_with_next(documents(*rows)).collect()
    near = [row.near_next for row in out if row.doc_id % 2]  # the next one is the near copy
    far = [row.near_next for row in out if not row.doc_id % 2]
    assert sum(near) / len(near) > 0.8 and sum(far) / len(far) < 0.2
