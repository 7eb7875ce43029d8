"""Ids are those of the tiktoken library, spans touch the right characters, decoding is exact."""

from hashlib import sha256

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.llm import byte_bpe

TEXTS = st.text(st.one_of(st.sampled_from("ab re'st  \n\t\x0b\x1f1!é漢😀　​"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.vocabulary(byte_bpe.default_ranks(), byte_bpe.default_pattern())


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@given(text=TEXTS)
@settings(max_examples=400, deadline=None)
def test_same_ids_and_exact_round_trip(bpe, reference, text):
    ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
    assert ids == reference.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()
    spans = np.frombuffer(bpe.spans(text, bpe.encode(text)), "<u4").reshape(-1, 2)
    assert len(spans) == len(ids)
    for (a, b), token in zip(spans.tolist(), ids, strict=True):
        assert bpe.bytes[token] in text[a:b].encode()  # a split character is spanned whole


def test_forgetting_pieces_changes_nothing(bpe, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 3)
    bpe.kept.clear()
    for text in ["a b c d e f g", "a b", "x" * 200 + " a q", "h i j k a b c"]:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
        assert len(bpe.kept) <= 3 and len(bpe.kept.old) <= 3


def test_null_empty_long_and_clashing_columns(spark, documents, reference):
    long = "Überlange Wörter 漢字 " * 20_000
    docs = documents((1, None), (2, ""), (3, long), (3, long), extra=["ids", "decoded", "n_tokens", "spans"])
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, spans=True)).orderBy("doc_id").collect()
    assert [row.n_tokens for row in out] == [0, 0, *[len(reference.encode_ordinary(long))] * 2]
    assert [bytes(row.decoded).decode() for row in out] == ["", "", long, long]
    assert len(out[2].spans) == 2 * len(out[2].ids)
    assert byte_bpe.encode_documents(docs.limit(0)).count() == 0


def test_split_characters_decode_to_their_bytes(spark, bpe):
    ids = bpe.encode("漢😀")
    df = spark.createDataFrame([(bytearray(ids[:4]),), (bytearray(ids),), (None,)], "ids binary")
    rows = df.select(byte_bpe.decode_bytes(F.col("ids")).alias("b"), byte_bpe.decode_text(F.col("ids")).alias("t")).collect()
    assert "漢😀".encode().startswith(bytes(rows[0].b)) and "�" in rows[0].t
    assert rows[1].t == "漢😀" and rows[2].t == ""


def test_a_whole_table_has_the_ids_of_tiktoken(spark, sf, reference):
    docs = byte_bpe.encode_documents(spark.read.parquet(f"{sf}/documents.parquet"), spans=True, digests=True)
    for row in docs.select("text", "ids", "spans", "spans_sha256").collect():
        assert row.spans_sha256 == sha256(row.spans).hexdigest()
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == reference.encode_ordinary(row.text or "")
        assert len(row.spans) == 8 * len(ids)
