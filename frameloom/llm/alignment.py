"""Two tokenizers' tokens of the same texts, aligned by byte offsets.

A text's tokens A (byte-level BPE of space and text) and B (a piece model, which adds the
space itself) each cut the same bytes. Where both end together a group ends; a token of A
and one of B are linked if their bytes overlap.

Merge-path partitioning: the ends of A and B are merged in order, A first where they are
equal. The merged path is cut into pieces of `PIECE` steps; a binary search on each cut's
diagonal finds how many tokens of either side lie before it, so that pieces need nothing
of each other but the last end before them. Each step of a piece emits the link of its two
current tokens, if they overlap. Texts of one piece are finished where they are cut; the
pieces of longer texts are spread over all tasks, and their group ends are stitched
together by text. The last A token before a cut may end where the first B token behind it
does: that group ends in the later piece.

An id pair's count is the number of texts that hold it linked. Tasks count before they
shuffle. Counted pairs go to all tasks as sorted arrays if there are at most `SENT` of
them; else each text's distinct pairs are joined with the counts.

Null and empty texts, and those whose bytes A or B do not give back, have no tokens:
zeros, and '' as digest. Texts of any length are aligned whole. Repeated rows and ids, null
ids included, are texts of their own and count as often as they are there. An empty table
gives an empty result. Other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.byte_bpe import byte_characters, default_pattern
from frameloom.llm.common import with_totals
from frameloom.session import settle

#: Steps of the merged path in a piece: some hundredths of a second, more than it costs to send them.
PIECE = 1 << 17
#: So many counted pairs, of 17 bytes each, are sent to every task at most.
SENT = 1 << 22
#: Texts that a task tokenizes at once.
TEXTS = 256


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """A: ids of space and text, and each id's number of bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        byte = {character: b for b, character in enumerate(byte_characters())}
        added = {token["content"] for token in given["added_tokens"]}
        words = {word: i for word, i in given["model"]["vocab"].items() if word not in added}
        ranks = {bytes(byte[c] for c in word): i for word, i in words.items()}
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in given["model"]["merges"]]
        order = [words[left + right] for left, right in merges]
        if order != sorted(order):  # the library below merges in the order of ids
            raise ValueError(f"{path}: merges do not follow the ids")
        self.library = tiktoken.Encoding("a", pat_str=default_pattern(), mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.size = len(self.bytes)
        self.lengths = np.array([len(token) for token in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode_ordinary(" " + text) for text in texts]


class PieceTokens:
    """B: ids of a text with the space that the model adds, and each id's number of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

        def held(i: int) -> bytes:
            piece = self.library.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode()

        self.size = self.library.get_piece_size()
        self.bytes = [held(i) for i in range(self.size)]
        self.lengths = np.array([len(token) for token in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Tokens:
    """Both tokenizers, and the strings of which a list of groups is made."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        names_a = [f"{i}{mark}" for mark in ",|" for i in range(self.a.size)]
        names_b = [f"{i}{mark}" for mark in ",;" for i in range(self.b.size)]
        self.names = np.array(names_a + names_b, object)
        self.kind = "<u2" if max(self.a.size, self.b.size) <= 1 << 16 else "<u4"

    def both(self, text: str, ids_a: list[int], ids_b: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text, or none if either does not give its bytes back."""
        if not text:
            return None
        whole = b" " + text.encode()
        for ids, side in ((ids_a, self.a), (ids_b, self.b)):
            if b"".join([side.bytes[i] for i in ids]) != whole:
                return None
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> str:
        """The digest of the groups, given how many tokens of each side lie before each group's end."""
        group_a = np.repeat(np.arange(len(cuts_a)), np.diff(cuts_a, prepend=0))
        group_b = np.repeat(np.arange(len(cuts_b)), np.diff(cuts_b, prepend=0))
        names_a, names_b = ids_a.copy(), ids_b + 2 * self.a.size
        names_a[cuts_a - 1] += self.a.size
        names_b[cuts_b - 1] += self.b.size
        order = np.argsort(np.concatenate([group_a, group_b]), kind="stable")
        names = self.names[np.concatenate([names_a, names_b])[order]]
        return sha256("".join(names.tolist())[:-1].encode()).hexdigest()


@lru_cache(maxsize=2)
def tokens(a: str, b: str) -> Tokens:
    return Tokens(a, b)


def diagonal(ends_a: np.ndarray, ends_b: np.ndarray, steps: int) -> tuple[int, int]:
    """How many tokens of either side the first `steps` steps of the merged path take."""
    low, high = max(0, steps - len(ends_b)), min(steps, len(ends_a))
    while low < high:
        middle = (low + high) // 2
        if ends_a[middle] <= ends_b[steps - 1 - middle]:
            low = middle + 1
        else:
            high = middle
    return low, steps - low


def piece_steps(
    ends_a: np.ndarray, ends_b: np.ndarray, take_a: int, take_b: int, before_a: int, before_b: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (positions of both tokens) and group ends (tokens taken of both sides) of a piece.

    A piece takes the first `take` of the given ends. One more of each side may be given:
    the token that the other side's last ones overlap.
    """
    ends = np.concatenate([ends_a[:take_a], ends_b[:take_b]])
    order = np.argsort(ends, kind="stable")
    of_a = order < take_a
    at_a = np.cumsum(of_a) - of_a
    at_b = np.cumsum(~of_a) - ~of_a
    end = ends[order]
    start_a = np.concatenate([[before_a], ends_a])[at_a]
    start_b = np.concatenate([[before_b], ends_b])[at_b]
    linked = np.maximum(start_a, start_b) < end
    closed = ~of_a & (start_a == end)
    return at_a[linked], at_b[linked], at_a[closed], at_b[closed] + 1


class _Rows:
    """Columns of one Arrow batch to be."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, **row: object) -> None:
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, self.schema)


_CUT = pa.schema(
    [
        ("uid", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("piece", pa.int32()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()),
        ("ids_a", pa.binary()), ("ids_b", pa.binary()),
        ("take_a", pa.int32()), ("take_b", pa.int32()), ("before_a", pa.int64()), ("before_b", pa.int64()),
    ]
)
_CUT_KINDS = (
    "uid bigint, id bigint, n_a bigint, n_b bigint, piece int, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs binary, times binary, ids_a binary, ids_b binary, take_a int, take_b int, "
    "before_a bigint, before_b bigint"
)
_ALIGNED = pa.schema(
    [
        ("uid", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("piece", pa.int32()),
        ("n_links", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary()),
        ("ids_a", pa.binary()), ("ids_b", pa.binary()), ("cuts_a", pa.binary()), ("cuts_b", pa.binary()),
    ]
)
_ALIGNED_KINDS = (
    "uid bigint, id bigint, n_a bigint, n_b bigint, piece int, n_links bigint, pairs binary, times binary, "
    "ids_a binary, ids_b binary, cuts_a binary, cuts_b binary"
)


def _packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    return numbers.astype(kind).tobytes()


def _pair_kind(size_a: int, size_b: int) -> str:
    return "<u4" if size_a * size_b < 1 << 32 else "<u8"


def _distinct(ids_a: np.ndarray, ids_b: np.ndarray, at: Tokens) -> tuple[bytes, bytes]:
    """The distinct pairs of some links, in order, and how often each is there."""
    pairs, times = np.unique(ids_a * at.b.size + ids_b, return_counts=True)
    return _packed(pairs, _pair_kind(at.a.size, at.b.size)), _packed(times)


def _cut(docs: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """Aligned texts of one piece; the pieces of all others, still to be aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = tokens(a, b), _Rows(_CUT)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                some = batch.slice(start, TEXTS)
                texts = [text or "" for text in some.column("text").to_pylist()]
                found = zip(texts, at.a.encode(texts), at.b.encode(texts), strict=True)
                for uid, id, (text, ids_a, ids_b) in zip(
                    some.column("uid").to_pylist(), some.column("id").to_pylist(), found, strict=True
                ):
                    both = at.both(text, ids_a, ids_b)
                    if both is None:
                        out.add(uid=uid, id=id, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", pairs=b"", times=b"")
                        continue
                    ids_a, ids_b = both
                    ends_a, ends_b = np.cumsum(at.a.lengths[ids_a]), np.cumsum(at.b.lengths[ids_b])
                    row = {"uid": uid, "id": id, "n_a": len(ids_a), "n_b": len(ids_b)}
                    steps = len(ids_a) + len(ids_b)
                    if steps <= size:
                        link_a, link_b, cuts_a, cuts_b = piece_steps(ends_a, ends_b, len(ids_a), len(ids_b), 0, 0)
                        pairs, times = _distinct(ids_a[link_a], ids_b[link_b], at)
                        groups = at.groups(ids_a, ids_b, cuts_a, cuts_b)
                        out.add(**row, n_groups=len(cuts_a), n_links=len(link_a), groups_sha256=groups, pairs=pairs, times=times)
                        continue
                    marks = [diagonal(ends_a, ends_b, d) for d in (*range(0, steps, size), steps)]
                    for piece, ((a0, b0), (a1, b1)) in enumerate(zip(marks, marks[1:], strict=False)):
                        out.add(
                            **row,
                            piece=piece,
                            ids_a=_packed(ids_a[a0 : a1 + 1], at.kind),
                            ids_b=_packed(ids_b[b0 : b1 + 1], at.kind),
                            take_a=a1 - a0,
                            take_b=b1 - b0,
                            before_a=int(ends_a[a0 - 1]) if a0 else 0,
                            before_b=int(ends_b[b0 - 1]) if b0 else 0,
                        )
                yield out.batch()

    return docs.mapInArrow(run, _CUT_KINDS)


def _aligned(pieces: DataFrame, a: str, b: str) -> DataFrame:
    """Links and group ends of each piece by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = tokens(a, b), _Rows(_ALIGNED)
        for batch in batches:
            for row in batch.to_pylist():
                ids = [np.frombuffer(row[name], at.kind).astype(np.int64) for name in ("ids_a", "ids_b")]
                before, take = (row["before_a"], row["before_b"]), (row["take_a"], row["take_b"])
                ends = [start + np.cumsum(side.lengths[i]) for start, side, i in zip(before, (at.a, at.b), ids, strict=True)]
                link_a, link_b, cuts_a, cuts_b = piece_steps(*ends, *take, *before)
                pairs, times = _distinct(ids[0][link_a], ids[1][link_b], at)
                out.add(
                    **{name: row[name] for name in ("uid", "id", "n_a", "n_b", "piece")},
                    n_links=len(link_a),
                    pairs=pairs,
                    times=times,
                    ids_a=_packed(ids[0][: take[0]], at.kind),
                    ids_b=_packed(ids[1][: take[1]], at.kind),
                    cuts_a=_packed(cuts_a),
                    cuts_b=_packed(cuts_b),
                )
            yield out.batch()

    return pieces.mapInArrow(run, _ALIGNED_KINDS)


def _stitched(a: str, b: str):
    """The groups' number and digest from all pieces of a text, in their order."""

    @F.arrow_udf("struct<n_groups bigint, groups_sha256 string>")
    def run(pieces: pa.Array) -> pa.Array:
        at, out = tokens(a, b), []
        for row in pieces:
            ids, cuts, taken = ([], []), ([], []), [0, 0]
            for piece in row.as_py():
                for side, name in enumerate("ab"):
                    cuts[side].append(np.frombuffer(piece[f"cuts_{name}"], "<u4").astype(np.int64) + taken[side])
                    ids[side].append(np.frombuffer(piece[f"ids_{name}"], at.kind).astype(np.int64))
                    taken[side] += len(ids[side][-1])
            joined = [np.concatenate(x) for x in (*ids, *cuts)]
            out.append({"n_groups": len(joined[2]), "groups_sha256": at.groups(*joined)})
        return pa.array(out, pa.struct([("n_groups", pa.int64()), ("groups_sha256", pa.string())]))

    return run


def _counted(short: DataFrame, long: DataFrame, kind: str) -> DataFrame:
    """How many texts hold each linked pair: `pair, n`."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), kind)
            pairs, n = np.unique(held, return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pairs.astype(np.int64), "n": n.astype(np.int64)})

    counts = short.select("pairs").mapInArrow(once, "pair bigint, n bigint")
    by_text = _exploded(long, kind).select("uid", "pair").distinct()
    counts = counts.unionByName(by_text.groupBy("pair").agg(F.count("*").alias("n")))
    return counts.groupBy("pair").agg(F.sum("n").alias("n"))


def _exploded(rows: DataFrame, kind: str) -> DataFrame:
    """A row for each distinct pair of a text or piece: `uid, pair, times`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, pairs, times in zip(*(batch.column(name).to_pylist() for name in ("uid", "pairs", "times")), strict=True):
                found = np.frombuffer(pairs, kind).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"uid": np.full(len(found), uid), "pair": found, "times": np.frombuffer(times, "<u4").astype(np.int64)}
                )

    return rows.select("uid", "pairs", "times").mapInArrow(run, "uid bigint, pair bigint, times bigint")


def _scored_by_array(rows: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """`n_best` and `count_sum` of each row by a lookup in the sorted pairs, which all tasks hold."""
    table = counts.select("pair", "n", "best").toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    arrays = [table.column(name).to_numpy(zero_copy_only=False)[order] for name in ("pair", "n", "best")]
    sent = rows.sparkSession.sparkContext.broadcast(arrays)
    names = [name for name in rows.columns if name not in ("pairs", "times")]
    schema = rows.select(*names, F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            found = np.searchsorted(pair, np.frombuffer(b"".join(batch.column("pairs").to_pylist()), kind).astype(np.int64))
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            sizes = np.array([len(x) for x in batch.column("times").to_pylist()], np.int64) // 4
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * best[found], times * n[found])]
            columns = [batch.column(name) for name in names] + [pa.array(np.diff(x)) for x in sums]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum"])

    return rows.mapInArrow(run, schema)


def _scored_by_join(rows: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """The same by a join; frequent pairs are broadcast."""
    keyed = settle(rows.withColumn("row", F.monotonically_increasing_id()), "keyed")
    pairs = _exploded(keyed.select(F.col("row").alias("uid"), "pairs", "times"), kind)
    known = with_totals(pairs, "pair", counts.withColumn("_n", F.col("n")), "_n")
    sums = known.groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    joined = keyed.drop("pairs", "times").join(sums.withColumnRenamed("uid", "row"), "row", "left").drop("row")
    return joined.fillna(0, ["n_best", "count_sum"])


def align(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    a: str | None = None,
    b: str | None = None,
    piece: int = PIECE,
    most_sent: int = SENT,
) -> DataFrame:
    """Tokens, groups and links of each text, and how common its links are in all texts."""
    a, b = a or default_a(), b or default_b()
    at = tokens(a, b)
    kind, size_b = _pair_kind(at.a.size, at.b.size), at.b.size
    given = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    cut = settle(_cut(given, a, b, piece), "cut")
    short = cut.filter("piece is null").select("uid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    pieces = cut.filter("piece is not null").drop("n_groups", "n_links", "groups_sha256", "pairs", "times")
    long = settle(_aligned(pieces.repartition("uid", "piece"), a, b), "aligned")
    counts = settle(_counted(short, long, kind), "pairs")
    most = counts.groupBy(F.floor(F.col("pair") / size_b).alias("_a")).agg(F.max("n").alias("_most"))
    own = F.floor(F.col("pair") / size_b)
    counts = counts.join(most, own == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))
    scored = _scored_by_array if counts.limit(most_sent + 1).count() <= most_sent else _scored_by_join
    short, long = scored(short, counts, kind), scored(long, counts, kind)
    parts = F.sort_array(F.collect_list(F.struct("piece", "ids_a", "ids_b", "cuts_a", "cuts_b")))
    sums = [F.sum(name).alias(name) for name in ("n_links", "n_best", "count_sum")]
    long = long.groupBy("uid").agg(*(F.first(name).alias(name) for name in ("id", "n_a", "n_b")), *sums, parts.alias("parts"))
    groups = _stitched(a, b)(F.col("parts"))
    long = long.withColumn("groups", groups).select("*", "groups.n_groups", "groups.groups_sha256")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return short.select("id", *names).unionByName(long.select("id", *names)).withColumnRenamed("id", id)
