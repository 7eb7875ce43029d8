"""License scans by ordered signature rules.

A text's A-Z are lower-cased; its words are runs of characters that are neither ASCII
white space, control characters nor punctuation, and rules see them with single spaces
between. Each rule is a regular expression with a label, a priority and a keyword. One
automaton finds the keywords of all rules in a text, and only rules whose keyword is
there run. Detections are then taken in the order of priority, longest first: what lies
within a detection already taken is suppressed, so that "GNU General Public License,
version 3" is one detection and not three.

Apart from that, all places of a few base phrases are counted; their labels always stay.

The rules are made from a table of licenses (names, versions) by six patterns, and
from a table of sentences of license texts. `score` is the confidence of the surest
detection kept, at least `BASE_SCORE` if there is a base phrase, else 0.

Null and empty texts have no words, no labels (an empty string) and score 0. Texts of
any length are scanned whole. Columns that have the name of an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

#: Phrases whose places are counted, and their labels (fixed values of the contract).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
BASE_SCORE = 0.5
#: Bytes that end a word become spaces, A-Z become a-z (fixed values of the contract).
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256)
)

#: Label, names with the word that they are looked up by first, and versions. `~` stands
#: for "license", "licence" or "licenses"; names and versions are words with single spaces.
LICENSES = [
    ("gpl", ["gnu general public ~", "gnu gpl", "gnu public ~", "gpl"], ["1 0", "1", "2 0", "2", "3 0", "3"]),
    ("lgpl", ["gnu lesser general public ~", "gnu library general public ~", "gnu lgpl", "lgpl"], ["2 0", "2 1", "2", "3 0", "3"]),
    ("agpl", ["gnu affero general public ~", "affero general public ~", "gnu agpl", "agpl"], ["1 0", "3 0", "3"]),
    ("gfdl", ["gnu free documentation ~", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("apache", ["apache ~", "apache software ~", "asl"], ["1 0", "1 1", "2 0", "2"]),
    ("mit", ["mit ~", "expat ~", "mit x11 ~"], []),
    ("x11", ["x11 ~", "x consortium ~"], []),
    ("bsd-2-clause", ["bsd 2 clause", "simplified bsd ~", "freebsd ~", "2 clause bsd"], []),
    ("bsd-3-clause", ["bsd 3 clause", "new bsd ~", "modified bsd ~", "revised bsd ~", "3 clause bsd"], []),
    ("bsd-4-clause", ["bsd 4 clause", "original bsd ~", "4 clause bsd"], []),
    ("0bsd", ["zero clause bsd", "bsd zero clause", "0bsd"], []),
    ("bsd", ["bsd ~", "bsd style ~", "berkeley software distribution ~"], []),
    ("isc", ["isc ~", "internet systems consortium ~"], []),
    ("mpl", ["mozilla public ~", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public ~"], ["1 0", "2 0"]),
    ("eclipse-distribution", ["eclipse distribution ~"], ["1 0"]),
    ("cpl", ["common public ~"], ["0 5", "1 0"]),
    ("ipl", ["ibm public ~"], ["1 0"]),
    ("cddl", ["common development and distribution ~", "cddl"], ["1 0", "1 1"]),
    ("cpal", ["common public attribution ~"], ["1 0"]),
    ("eupl", ["european union public ~", "eupl"], ["1 0", "1 1", "1 2"]),
    ("osl", ["open software ~"], ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", ["academic free ~"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("artistic", ["artistic ~", "perl artistic ~"], ["1 0", "2 0"]),
    ("ofl", ["sil open font ~", "open font ~"], ["1 0", "1 1"]),
    ("odbl", ["open database ~", "open data commons open database ~"], ["1 0"]),
    ("odc-by", ["open data commons attribution ~"], ["1 0"]),
    ("pddl", ["public domain dedication and ~", "open data commons public domain dedication"], ["1 0"]),
    ("bsl", ["boost software ~"], ["1 0"]),
    ("busl", ["business source ~"], ["1 1"]),
    ("elastic", ["elastic ~"], ["1 0", "2 0"]),
    ("sspl", ["server side public ~"], ["1"]),
    ("zlib", ["zlib ~", "zlib libpng ~"], []),
    ("libpng", ["libpng ~", "png reference library ~"], ["2 0"]),
    ("openssl", ["openssl ~", "original ssleay ~"], []),
    ("psf", ["python software foundation ~", "psf ~"], ["2", "2 0"]),
    ("python", ["python ~", "cnri python ~"], ["2 0"]),
    ("php", ["php ~"], ["3 0", "3 01"]),
    ("ruby", ["ruby ~"], []),
    ("ncsa", ["university of illinois ncsa open source ~", "ncsa open source ~"], []),
    ("postgresql", ["postgresql ~"], []),
    ("w3c", ["w3c software notice and ~", "w3c ~"], []),
    ("ms-pl", ["microsoft public ~"], []),
    ("ms-rl", ["microsoft reciprocal ~"], []),
    ("cecill", ["cecill ~", "cecill free software ~"], ["1 0", "1 1", "2 0", "2 1"]),
    ("lppl", ["latex project public ~", "lppl"], ["1 0", "1 2", "1 3"]),
    ("qpl", ["q public ~"], ["1 0"]),
    ("apsl", ["apple public source ~"], ["1 0", "1 1", "1 2", "2 0"]),
    ("ecl", ["educational community ~"], ["1 0", "2 0"]),
    ("upl", ["universal permissive ~"], ["1 0"]),
    ("zpl", ["zope public ~"], ["1 1", "2 0", "2 1"]),
    ("sleepycat", ["sleepycat ~", "sleepycat public ~"], []),
    ("vim", ["vim ~"], []),
    ("unlicense", ["the unlicense", "unlicense org"], []),
    ("wtfpl", ["do what the fuck you want to public ~", "wtfpl"], ["2"]),
    ("beerware", ["beer ware ~", "beerware ~"], []),
    ("mulan", ["mulan permissive software ~", "mulan psl"], ["1", "2"]),
    ("blueoak", ["blue oak model ~"], ["1 0 0"]),
    ("ntp", ["ntp ~"], []),
    ("ofl-rfn", ["reserved font name"], []),
    ("cc0", ["cc0", "creative commons zero", "creative commons public domain dedication"], ["1 0"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", ["cc by", "creative commons attribution"], ["2 0", "2 5", "3 0", "4 0"]),
    ("creative-commons", ["creative commons ~", "creative commons"], []),
]

#: Short names that are also written as one word with a version ("gplv3", "lgpl2 1").
JOINED = {"gpl", "lgpl", "agpl", "gfdl", "asl", "mpl", "cddl", "eupl", "lppl", "wtfpl"}

#: Sentences of license texts, with words that they are looked up by: every match has them.
SENTENCES = [
    ("mit", "hereby granted free", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "mentioning features", r"all advertising materials mentioning features or use of this software must display"),
    ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "free software foundation", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "free software foundation", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl", "free software foundation", r"redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "except in compliance", r"you may not use this file except in compliance with the license"),
    ("mpl", "code form is subject", r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "person or organization", r"any person or organization obtaining a copy of the software and accompanying documentation"),
    ("cc0", "waived all copyright", r"to the extent possible under law .{1,80}? (?:has|have) waived all copyright"),
    ("cc0", "waived all copyright", r"(?:has|have) waived all copyright and related"),
    ("cc0", "waive all copyright", r"waive all copyright and related"),
    ("public-domain", "public domain", r"(?:placed|released|dedicated|is) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?"),
    ("warranty-disclaimer", "warranties of merchantability", r"(?:implied )?warranties of merchantability"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("wtfpl", "do what the fuck", r"you just do what the fuck you want to"),
]

LICENSE = r"(?:license|licence|licenses)"
VERSION = r"(?: (?:version|v|ver|versions))? v?"
GRANT = r"(?:licensed|released|distributed|available|provided|published|covered|redistributed) (?:under|by|according to|subject to)"
TERMS = r"(?: (?:the|a|an|terms|conditions|and|of)){0,6} "
LATER = r"(?: (?:or|and) (?:any )?(?:later|newer)(?: version)?| only)?"
#: What a rule's kind is worth: its priority, and the confidence of its detections.
KINDS = {"identifier": (5, 1.0), "sentence": (4, 0.95), "grant": (3, 0.9), "version": (2, 0.8), "name": (1, 0.6)}


class Rule(NamedTuple):
    label: str
    kind: str
    keyword: str
    regex: re.Pattern


class Detection(NamedTuple):
    """Of a rule's match: the first word and the one after the last, counted from 0."""

    label: str
    kind: str
    start: int
    end: int


def _whole(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<=[ ]){pattern}(?=[ ])")


def _joined(label: str, name: str, versions: list[str]) -> Iterator[Rule]:
    """The rules of a short name that ends in its version, known or not."""
    for version in versions:
        numbered = f"{label}-{version.replace(' ', '.')}"
        for joint in ("v", ""):
            exact = rf"{name}{joint}{version}(?: {LICENSE})?(?! [0-9])"
            keyword = f" {name}{joint}{version.split()[0]} "
            yield Rule(numbered, "version", keyword, _whole(exact + LATER))
            yield Rule(numbered, "grant", keyword, _whole(GRANT + TERMS + exact + LATER))
    written = rf"{name}v?[0-9]+(?: {LICENSE})?"
    yield Rule(label, "name", f" {name}", _whole(written))
    yield Rule(label, "grant", f" {name}", _whole(GRANT + TERMS + written + LATER))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in the order of priority, then of the tables."""
    found = [Rule(label, "sentence", f" {words} ", _whole(f"(?:{text})")) for label, words, text in SENTENCES]
    for label, names, versions in LICENSES:
        identifier = label.replace("-", " ")
        found.append(Rule(label, "identifier", " spdx ", _whole(rf"spdx (?:license )?identifier {identifier}{LATER}")))
        for version in versions:
            numbered = f"{label}-{version.replace(' ', '.')}"
            found.append(Rule(numbered, "identifier", " spdx ", _whole(rf"spdx (?:license )?identifier {identifier} {version}{LATER}")))
        for name in names:
            keyword = f" {' '.join(name.split(' ~')[0].split()[:3])} " + ("licen" if "~" in name and name.count(" ") == 1 else "")
            written = name.replace("~", LICENSE) + ("" if "~" in name else f"(?: {LICENSE})?")
            found.append(Rule(label, "name", keyword, _whole(written)))
            found.append(Rule(label, "grant", keyword, _whole(rf"{GRANT}{TERMS}{written}{LATER}")))
            for version in versions:
                numbered = f"{label}-{version.replace(' ', '.')}"
                exact = rf"{written}{VERSION}{version}(?! [0-9])"
                found.append(Rule(numbered, "version", keyword, _whole(exact + LATER)))
                found.append(Rule(numbered, "grant", keyword, _whole(GRANT + TERMS + exact + LATER)))
            if name.split()[-1] in JOINED:
                found += _joined(label, name, versions)
    return tuple(sorted(found, key=lambda rule: -KINDS[rule.kind][0]))


@lru_cache(maxsize=1)
def _prefilter():
    """An automaton that yields the numbers of the rules that a keyword lets through."""
    import ahocorasick

    by_keyword: dict[str, list[int]] = {}
    for number, rule in enumerate(rules()):
        by_keyword.setdefault(rule.keyword, []).append(number)
    automaton = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        automaton.add_word(keyword, tuple(numbers))
    automaton.make_automaton()
    return automaton


def normalized(text: str | None) -> str:
    """The words, each between single spaces; one space if there is none."""
    words = (text or "").encode().translate(WORDS).split()
    return f" {b' '.join(words).decode()} " if words else " "


def _places(words: str, phrase: str) -> Iterator[int]:
    at = words.find(f" {phrase} ")
    while at >= 0:
        yield at
        at = words.find(f" {phrase} ", at + 1)


def detections(words: str) -> list[Detection]:
    """What the rules find in normalized words, after suppression, in the order of the text."""
    able = sorted({number for _, numbers in _prefilter().iter(words) for number in numbers})
    if not able:
        return []
    found: dict[int, list[tuple[int, int, Rule]]] = {}
    for number in able:
        rule = rules()[number]
        own = found.setdefault(KINDS[rule.kind][0], [])
        own += [(m.start(), m.end(), rule) for m in rule.regex.finditer(words)]
    taken: list[tuple[int, int, Rule]] = []
    for priority in sorted(found, reverse=True):
        taken += _outside(sorted(found[priority], key=lambda x: (x[0], -x[1])), taken)
    taken.sort(key=lambda x: x[:2])
    starts, ends = _spaces(words, [x[0] for x in taken]), _spaces(words, [x[1] for x in taken])
    return [Detection(r.label, r.kind, a - 1, b) for (_, _, r), a, b in zip(taken, starts, ends, strict=True)]


def _outside(found: list[tuple[int, int, Rule]], taken: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Those of `found`, sorted by start and longest first, that lie in none of `taken` and none before."""
    before = sorted((a, b) for a, b, _ in taken)
    kept, at, reach = [], 0, -1
    for start, end, rule in found:
        while at < len(before) and before[at][0] <= start:
            reach = max(reach, before[at][1])
            at += 1
        if end > reach:
            kept.append((start, end, rule))
            reach = end
    return kept


def _spaces(words: str, places: list[int]) -> list[int]:
    """The number of spaces before each place."""
    found, count, last = {}, 0, 0
    for place in sorted(set(places)):
        count += words.count(" ", last, place)
        found[place] = count
        last = place
    return [found[place] for place in places]


def scan(text: str | None) -> dict:
    """The outputs for one text."""
    words = normalized(text)
    base = {phrase: list(_places(words, phrase)) for phrase in BASE}
    starts = [at for places in base.values() for at in places]
    kept = detections(words)
    base_labels = sorted({BASE[phrase] for phrase, places in base.items() if places})
    return {
        "n_words": words.count(" ") - 1,
        "n_base": len(starts),
        "first_word": words.count(" ", 0, min(starts)) if starts else None,
        "last_word": words.count(" ", 0, max(starts)) if starts else None,
        "base_labels": ",".join(base_labels),
        "labels": ",".join(sorted({*base_labels, *(d.label for d in kept)})),
        "score": max([0.0, *[BASE_SCORE] * bool(starts), *(KINDS[d.kind][1] for d in kept)]),
        "detections": [d._asdict() for d in kept],
    }


def _result(arrow: bool):
    """The type of the outputs, for Arrow or for Spark."""
    text, number, real = (pa.string(), pa.int64(), pa.float64()) if arrow else (StringType(), LongType(), DoubleType())
    fields = {"n_words": number, "n_base": number, "first_word": number, "last_word": number}
    fields |= {"base_labels": text, "labels": text, "score": real}
    inner = {"label": text, "kind": text, "start": number, "end": number}
    if arrow:
        return pa.struct([*fields.items(), ("detections", pa.list_(pa.struct([*inner.items()])))])
    struct, one = StructType(), StructType()
    for name, kind in inner.items():
        one.add(name, kind)
    for name, kind in fields.items():
        struct.add(name, kind)
    return struct.add("detections", ArrayType(one))


@F.arrow_udf(_result(arrow=False))
def _scan(column: pa.Array) -> pa.Array:
    return pa.array([scan(text.as_py()) for text in column], _result(arrow=True))


def scanned(text: Column) -> Column:
    """A struct of the outputs: counts, labels, score and `detections`."""
    return _scan(text)


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the outputs as columns."""
    names = [field.name for field in _result(arrow=False).fields]
    out = docs.withColumn("_scan", scanned(F.col(text)))
    return out.withColumns({name: F.col("_scan").getField(name) for name in names}).drop("_scan")
