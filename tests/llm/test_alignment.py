"""Alignment against a plain restatement with the libraries' own files, and cuts at every place."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameloom.llm import alignment
from frameloom.llm.byte_bpe import byte_characters

TEXTS = [
    "Plain words, and more plain words.", "Plain words again", "", None, "  two  spaces\n\nlines\t", "Ünïcode 漢字 😀👍🏽 ﬁ", "a▁b",
    "<|endoftext|> <s> plain", "Plain words, and more plain words.", "antidisestablishmentarianism 1234567 €€", "x" * 700,
    " ".join(f"word{i} Élan{i % 7}" for i in range(900)),
]


def brute(texts):
    a = Tokenizer.from_file(alignment.default_a())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_b())
    byte = {c: n for n, c in enumerate(byte_characters())}
    out, links = [], []
    for text in texts:
        whole, sides = (" " + (text or "")).encode(), []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            sides.append([(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids])
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
        if not text or any(b"".join(t for _, t in side) != whole for side in sides):
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for side in sides:
            at, found = 0, []
            for i, token in side:
                found.append((i, at, at + len(token)))
                at += len(token)
            spans.append(found)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= end) for side in spans))
            low = end
        links.append([(i, j) for i, s, e in spans[0] for j, s2, e2 in spans[1] if max(s, s2) < min(e, e2)])
        out.append((len(spans[0]), len(spans[1]), len(groups), len(links[-1]), sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(pair for held in links for pair in set(held))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [
        (*row[:4], sum(counts[p] == most[p[0]] for p in held), sum(counts[p] for p in held), row[4])
        for row, held in zip(out, links, strict=True)
    ]


@pytest.mark.parametrize(("piece", "sent"), [(1 << 14, 1 << 22), (50, 1 << 22), (50, 0), (1 << 14, 0), (1, 10)])
def test_against_a_restatement(documents, piece, sent):
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(None, "Plain words"), (3, "Plain words"), (3, "Plain words")]
    given = documents(*rows, extra=["uid", "id", "pairs", "n_a"]).withColumn("n", F.lit(1))
    got = [tuple(r) for r in alignment.align(given, piece=piece, most_sent=sent).collect()]
    want = [(doc, *row) for (doc, _), row in zip(rows, brute([t for _, t in rows]), strict=True)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_table(documents):
    assert alignment.align(documents((1, "x")).limit(0)).count() == 0


def test_diagonals_agree_with_the_merged_order():
    some = random.Random(5)
    for _ in range(50):
        total = some.randrange(1, 60)
        ends = [np.array(sorted({*some.sample(range(1, total + 1), some.randrange(0, total)), total})) for _ in "ab"]
        path = sorted([(e, 0) for e in ends[0]] + [(e, 1) for e in ends[1]])
        for steps in range(len(path) + 1):
            before = [sum(side == s for _, side in path[:steps]) for s in (0, 1)]
            assert alignment.diagonal(*ends, steps) == tuple(before)
