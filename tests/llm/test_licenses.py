"""Base phrases against brute force; signatures, suppression and odd texts."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import licenses

WORDS = st.lists(st.sampled_from("gnu GNU general public License apache cc by CC-BY mit éa 2.0 x_y ... under the".split()), max_size=14)


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@given(words=WORDS, joint=st.sampled_from([" ", "\n", ", ", "-"]))
@settings(max_examples=400, deadline=None)
def test_base_phrases(words, joint):
    text = joint.join(words)
    out = licenses.scan(text)
    assert (out["n_words"], out["n_base"], out["first_word"], out["last_word"], out["base_labels"]) == brute(text)
    assert set(filter(None, out["base_labels"].split(","))) <= set(out["labels"].split(","))
    assert 0 <= out["score"] <= 1 and (out["score"] > 0) == (out["labels"] != "")


def contains_rule(found):
    """Suppression by its definition, over all pairs."""
    ranked = sorted(found, key=lambda x: (-licenses.KINDS[x[2].kind][0], x[0] - x[1], x[0]))
    taken = []
    for start, end, rule in ranked:
        if not any(a <= start and end <= b for a, b, _ in taken):
            taken.append((start, end, rule))
    return sorted((a, b) for a, b, _ in taken)


@given(spans=st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9), st.sampled_from(list(licenses.KINDS))), max_size=12))
@settings(max_examples=400, deadline=None)
def test_suppression(spans):
    found = [(a, a + n, licenses.Rule("x", kind, "", re.compile(""))) for a, n, kind in spans]
    taken = []
    for priority in sorted({licenses.KINDS[r.kind][0] for _, _, r in found}, reverse=True):
        own = [x for x in found if licenses.KINDS[x[2].kind][0] == priority]
        taken += licenses._outside(sorted(own, key=lambda x: (x[0], -x[1])), taken)
    assert sorted((a, b) for a, b, _ in taken) == contains_rule(found)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"),
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache,apache-2.0"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
        ("GNU Lesser General Public License", "lgpl"),
        ("Text is CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("wir gehen mit Lizenz und mit Hund", ""),
    ],
)
def test_labels(text, labels):
    assert licenses.scan(text)["labels"] == labels


def test_rules_are_many_and_every_keyword_lets_its_rule_through():
    assert len(licenses.rules()) >= 300
    for rule in licenses.rules():
        if rule.kind in ("name", "version"):
            name = re.sub(r"\(\?<=\[ \]\)|\(\?=\[ \]\)", "", rule.regex.pattern).split("(?:")[0]
            assert rule.keyword.strip().split()[0] in name


def test_odd_documents(documents):
    long = "mit license and " * 40_000
    docs = documents((1, None), (2, ""), (3, long), (3, long), (4, "..."), extra=["labels", "score", "_scan"])
    rows = licenses.scan_documents(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in rows] == [
        (0, 0, None, None, ""),
        (0, 0, None, None, ""),
        *[(120_000, 40_000, 0, 119_997, "mit")] * 2,
        (0, 0, None, None, ""),
    ]
    assert len(rows[2].detections) == 40_000 and rows[2].detections[-1].start == 119_997
    assert licenses.scan_documents(docs.limit(0)).count() == 0


def sample(tree, rng):
    """A text that a parsed pattern matches, without what it looks ahead or back for."""
    text = ""
    for op, value in tree:
        kind = str(op)
        if kind == "LITERAL":
            text += chr(value)
        elif kind == "ANY":
            text += "x"
        elif kind == "IN":
            text += chr(value[0][1] if str(value[0][0]) == "LITERAL" else rng.randint(*value[0][1]))
        elif kind == "BRANCH":
            text += sample(rng.choice(value[1]), rng)
        elif kind == "SUBPATTERN":
            text += sample(value[-1], rng)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            text += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 6))))
        else:
            assert kind in ("ASSERT", "ASSERT_NOT")
    return text


def test_what_a_rule_matches_passes_the_prefilter():
    rng = random.Random(1)
    for number, rule in enumerate(licenses.rules()):
        parsed = re._parser.parse(rule.regex.pattern)
        for _ in range(25):
            words = licenses.normalized(sample(parsed, rng))
            if rule.regex.search(words):
                assert any(number in numbers for _, numbers in licenses._prefilter().iter(words)), (rule, words)
                break
        else:
            raise AssertionError(rule)
        for _ in range(25):
            words = licenses.normalized(sample(parsed, rng))
            assert not rule.regex.search(words) or any(number in n for _, n in licenses._prefilter().iter(words)), (rule, words)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("To the extent possible under law, Ann Example has waived all copyright and related or neighboring rights", "cc0"),
        (f"To the extent possible under law, {'The Very Long Society ' * 9} has waived all copyright and related rights", "cc0"),
        ("Affirmer hereby agrees to waive all copyright and related rights", "cc0"),
        ("This is GPLv3 code", "gpl-3"),
        ("LGPLv2.1+", "lgpl-2.1"),
        ("released under the GNU AGPLv3 or later", "agpl-3"),
        ("licensed under GPLv2", "gpl-2"),
        ("GPLv2 2009 Ann Example", "gpl"),
        ("MPL2.0", "mpl-2.0"),
        ("gplx vgpl3", ""),
    ],
)
def test_waivers_and_joined_versions(text, labels):
    assert licenses.scan(text)["labels"] == labels
