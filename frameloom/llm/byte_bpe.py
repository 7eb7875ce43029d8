"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file gives the vocabulary; its merges follow from the ranks. Every byte is
written as one printable character, the library merges those characters, and the
table read backwards turns token strings into bytes again.

Ids travel packed: a binary of little-endian unsigned 32-bit integers, so that a
digest of the column is a digest of the ids. Spans are packed pairs of such numbers,
the code points [start, end) that a token touches; a token that holds a part of a
character spans the whole character.

Pieces between white space and the pattern's matches in them are remembered, so that the
library merges each but once as long as it is asked for. Spans follow from the ids' bytes
and the bytes of the text's characters.

Null texts count as empty, and empty texts have no ids. Texts of any length are
encoded whole. Repeated rows are encoded as often as they are there; an empty table gives
an empty result. Columns that have the name of an output are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cached_property, lru_cache
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Bytes that stand for themselves in token strings (fixed values of the format).
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Unicode white space, which the split pattern never joins to what precedes it (fixed values).
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces between which the split pattern always restarts.
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Marks that never begin a match with letters.
STOPS = frozenset(",.;:!?")
#: A worker remembers so many pieces and matches in a generation, each of at most so many characters.
KEPT_PIECES, KEPT_LENGTH = 1 << 18, 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The character of each byte; bytes without a printable one follow from 256 on."""
    others = iter(range(256, 512))
    own = set(PRINTABLE)
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one: what all earlier merges leave of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:], strict=False)]
        at = joined.index(min(joined))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Kept(dict):
    """Packed ids of short strings: those asked for lately, at most two generations of `KEPT_PIECES`."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask, self.old = ask, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.ask(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


class ByteBpe:
    """One vocabulary with its split pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        lengths = np.array([len(token) for token in self.bytes], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.characters = dict(enumerate(byte_characters()))
        self.match = regex.compile(pattern)
        self.kept = Kept(self._piece)

    @cached_property
    def model(self):
        """The library's merging model; workers that only decode or place spans never make it."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models

        ranks, characters = self.ranks, self.characters

        def written(token: bytes) -> str:
            return "".join(characters[b] for b in token)

        merges = [
            tuple(map(written, halves(token, ranks)))
            for token in sorted(ranks, key=ranks.__getitem__)
            if len(token) > 1
        ]
        vocabulary = {written(token): rank for token, rank in ranks.items()}
        return Tokenizer(models.BPE(vocab=vocabulary, merges=merges, cache_capacity=0)).model

    def _piece(self, piece: str) -> bytes:
        """The packed ids of a piece: those of the pattern's matches, whose bytes, as characters, the library merges."""
        if not piece.removeprefix(" ").isalpha():  # letters alone are one match
            head = piece[:-1]
            if piece[-1] in STOPS and head.removeprefix(" ").isalpha():  # and so is a mark behind them
                return self.kept[head] + self.kept[piece[-1]]
            matches = self.match.findall(piece)
            if len(matches) > 1:
                return b"".join(map(self.kept.__getitem__, matches))  # each match is its own only match
        data = piece.encode()
        rank = self.ranks.get(data)
        if rank is not None:  # merging ends at the whole
            return pack("<I", rank)
        written = data.decode("latin-1").translate(self.characters)
        ids = [token.id for token in self.model.tokenize(written)]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.kept.__getitem__, PIECE.findall(text or "")))

    def spans(self, text: str | None, ids: bytes) -> bytes:
        data = np.frombuffer((text or "").encode(), np.uint8)
        if not len(data):
            return b""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        begins = np.concatenate([[0], ends[:-1]])
        return np.stack([character[begins], character[ends - 1] + 1], axis=1).astype("<u4").tobytes()

    def decode(self, ids: bytes | None) -> bytes:
        numbers = np.frombuffer(ids or b"", "<u4")
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.flat[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _per_row(method: str, path: str | None, pattern: str | None):
    path, pattern = path or default_ranks(), pattern or default_pattern()

    @F.arrow_udf(BinaryType())
    def run(column: pa.Array) -> pa.Array:
        one = getattr(vocabulary(path, pattern), method)
        return pa.array((one(value.as_py()) for value in column), pa.binary())

    return run


def encode(text: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """Packed ids of each text."""
    return _per_row("encode", ranks, pattern)(text)


def token_spans(text: Column, ids: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """Packed pairs of code point offsets, one pair for each of the text's packed ids."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()

    @F.arrow_udf(BinaryType())
    def run(texts: pa.Array, ids: pa.Array) -> pa.Array:
        one = vocabulary(path, pattern).spans
        return pa.array((one(text.as_py(), packed.as_py()) for text, packed in zip(texts, ids, strict=True)), pa.binary())

    return run(text, ids)


def encode_digested(text: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """`ids` (packed) and `spans_sha256`, the digest in lowercase hex of the packed spans, which stay where they are made."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()

    @F.arrow_udf(StructType([StructField("ids", BinaryType()), StructField("spans_sha256", StringType())]))
    def run(column: pa.Array) -> pa.Array:
        one, ids, digests = vocabulary(path, pattern), [], []
        for value in column:
            text = value.as_py()
            ids.append(one.encode(text))
            digests.append(sha256(one.spans(text, ids[-1])).hexdigest())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(digests, pa.string())], ["ids", "spans_sha256"])

    return run(text)


def decode_bytes(ids: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """The bytes of packed ids, exactly; they may begin or end within a character."""
    return _per_row("decode", ranks, pattern)(ids)


def decode_text(ids: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """The text of packed ids; parts of characters become U+FFFD."""
    return _replaced(decode_bytes(ids, ranks, pattern))


@F.arrow_udf(StringType())
def _replaced(column: pa.Array) -> pa.Array:
    return pa.array((value.as_py().decode("utf-8", "replace") for value in column), pa.string())


def encode_documents(
    docs: DataFrame,
    text: str = "text",
    ranks: str | None = None,
    pattern: str | None = None,
    spans: bool = False,
    digests: bool = False,
) -> DataFrame:
    """`docs` with `ids` (packed), `n_tokens` and, if wanted, `spans` (packed) or `spans_sha256`, their digest."""
    if digests:
        found = docs.withColumn("_encoded", encode_digested(F.col(text), ranks, pattern))
        out = found.withColumns({n: F.col("_encoded")[n] for n in ("ids", "spans_sha256")}).drop("_encoded")
    else:
        out = docs.withColumn("ids", encode(F.col(text), ranks, pattern))
    if spans:
        out = out.withColumn("spans", token_spans(F.col(text), F.col("ids"), ranks, pattern))
    return out.withColumn("n_tokens", F.floor(F.length("ids") / 4).cast("bigint"))


def decode_documents(docs: DataFrame, ids: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with `decoded`, the bytes of the packed ids; null ids give none."""
    return docs.withColumn("decoded", decode_bytes(F.col(ids), ranks, pattern))
