"""Removal of byte strings that also start elsewhere, by distributed prefix doubling.

A byte goes if a string of `LENGTH` bytes covers it that starts at any other place of the
table, the same text included. Overlaps count, and strings are judged on the input.

Doubling over every byte would sort many times the corpus, so it runs on marks: places
whose hash of the `BLOCK` bytes from there is not above that of the `REACH` places on either
side. A mark depends on bytes near it only, so equal strings have equal marks inside. The
letters that are doubled are the bytes from one mark to the next, with what decides both:
- Spark sorts all letters in ranges; equal ones share a rank, letters that are there once
  drop out. Then pairs of ranks are sorted, 1, 2, 4, ... letters apart, until what they
  span is unique or past the threshold; the last pair of a mark overlaps so that it ends
  just behind the last string that begins before the next mark. A sort's key ends in the
  place, so that rows of one common letter spread over ranges; a group that crosses ranges
  is known by the ranges' ends, two rows each.
- If the last pair of a mark repeats, so does every string that begins between it and the
  next mark. Only near the ends of repeats are single strings compared: those whose inner
  runs of letters all repeat, and those of the first mark of each group of equal last pairs,
  meet by a 128-bit digest. Tasks pack them in arrays, one of each digest that they have.

Equal texts count once in all this: a text with copies loses all its bytes if it is long
enough. The distinct texts are written in buckets, and what is found moves to them.
Two different strings or letters count as equal if 128 bits of their XXH3 hash are, two
texts if 128 bits of their SHA-256 are.

Null texts count as empty. Texts shorter than the length keep their bytes. Texts of any
length are handled whole, in blocks of memory. Repeated rows and ids, null ids included,
are texts of their own. An empty table gives an empty result. Other columns are dropped,
so their names cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import with_totals
from frameloom.session import Scratch, settle

#: Bytes of a string that must not be elsewhere.
LENGTH = 400
#: Bytes that a place's hash covers, and places on either side that a mark's hash is not above.
BLOCK, REACH = 16, 32
#: Places that are looked at at once; bytes of texts, or one text, that are.
STRETCH, PIECE = 1 << 15, 1 << 22
#: Strings that a task packs at once, and bytes of texts whose strings meet in one part.
MOST_STRINGS, PART_BYTES = 1 << 19, 1 << 24
#: What rows about a text say of a mark: its runs of 2^n letters repeat (n), its last pair
#: repeats and is or is not the first such; or of a place: the string from there repeats.
REPEATED, FIRST, STRING = 64, 65, 66
#: A string, and what is found of it.
_ASKED = np.dtype([("a", "<u8"), ("b", "<u8"), ("uid", "<i8"), ("at", "<i4"), ("sure", "?")])
_KNOWN = np.dtype([("uid", "<i8"), ("code", "<i8")])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the `BLOCK` bytes from each place on."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    n = len(data) - BLOCK + 1
    found = words[:n] * _M1
    found ^= (words[8 : 8 + n] * _M2) >> np.uint64(7)
    found ^= found >> np.uint64(32)
    found *= _M2
    return found.view("<u4")[1::2] ^ (found.view("<u4")[1::2] >> np.uint32(13))


def _least(numbers: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        numbers = np.minimum(numbers[:-size], numbers[size:])
        size *= 2
    return np.minimum(numbers[: len(numbers) - (width - size)], numbers[width - size :]) if width > size else numbers


def marks(data: np.ndarray, reach: int = REACH, stretch: int = STRETCH) -> np.ndarray:
    """The places whose hash is not above any hash within reach."""
    places, found = len(data) - BLOCK + 1, []
    for start in range(reach, places - reach, stretch):
        end = min(start + stretch, places - reach)
        near = _hashes(data[start - reach : end + reach + BLOCK - 1])
        sides = _least(near, reach)  # of the places from each on
        own = near[reach : reach + end - start]
        before, behind = sides[: end - start], sides[reach + 1 : reach + 1 + end - start]
        found.append(np.flatnonzero((own <= before) & (own <= behind)) + start)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Letters:
    """The marks of some texts, one behind the other in `data`, and what lies between them.

    Text `n` is from `bounds[n]` to `bounds[n + 1]`; its marks are from `firsts[n]` to `firsts[n + 1]`.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int, reach: int = REACH):
        self.data, self.bounds, self.length = data, bounds, length
        at = marks(data, reach)
        own = self.text_of(at)  # a mark sees nothing but its own text
        inside = (at - bounds[own] >= reach) & (at + reach + BLOCK <= bounds[own + 1])
        at, self.own = at[inside], own[inside]
        self.starts, self.ends = at - reach, at + reach + BLOCK
        self.firsts = np.searchsorted(self.own, np.arange(len(bounds)))

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """For each mark but a text's last: its number, and how many letters from it on cover all
        strings that begin before the next mark; 0 if too few are left."""
        at = np.flatnonzero(self.own[1:] == self.own[:-1])
        last = np.searchsorted(self.ends, self.starts[at + 1] + self.length - 1)
        return at, np.where(last < self.firsts[self.own[at] + 1], np.maximum(last - at, 1), 0)

    def digests(self, at: np.ndarray) -> list[bytes]:
        view = memoryview(self.data)
        return [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at + 1].tolist(), strict=True)]

    def most(self, at: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """No string of a text, and no last pair, covers more letters than this."""
        behind = np.minimum(np.searchsorted(self.ends, self.starts + self.length, "right"), self.firsts[self.own + 1])
        most = np.zeros(len(self.bounds) - 1, np.int64)
        np.maximum.at(most, self.own, behind - 1 - np.arange(len(behind)))
        np.maximum.at(most, self.own[at], spans)
        return most

    def strings(self, texts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of places whose strings are alike: first place, end and text of each, and of the
        strings from there whether they are known to repeat, whether they may repeat, and whether
        they stand for others that do.

        `codes` say what is known of the marks of `texts`: their number * 256 + what.
        """
        count, starts, ends = len(self.starts), self.starts, self.bounds[1:] - self.length + 1
        runs, last = np.zeros(count + 1, np.int64), np.zeros(count + 1, np.int64)
        what, at = codes & 255, (codes >> 8) + self.firsts[texts]
        np.maximum.at(runs, at[what < REPEATED], what[what < REPEATED])
        last[at[what == REPEATED]] = REPEATED
        last[at[what == FIRST]] = FIRST
        # Nothing below changes but at these places.
        cuts = [self.bounds, np.maximum(ends, 0), starts, starts + 1, np.maximum(self.ends - self.length, 0)]
        cuts = np.sort(np.concatenate(cuts), kind="stable")  # of sorted parts
        own = self.text_of(cuts[:-1])
        there = (cuts[:-1] < ends[own.clip(max=len(ends) - 1)]) & (cuts[:-1] < cuts[1:])
        own, places, until = own[there], cuts[:-1][there], cuts[1:][there]
        before = np.searchsorted(starts, places, "right") - 1
        known = np.where(before >= self.firsts[own], last[before], 0)
        first = np.searchsorted(starts, places, "left")
        inside = np.searchsorted(self.ends, places + self.length, "right") - 1 - first
        level = np.where(inside >= 2, np.frexp(np.maximum(inside, 1))[1] - 1, 0)
        behind = np.clip(first + inside - (1 << level), 0, count)
        whole = (runs[np.minimum(first, count)] >= level) & (runs[behind] >= level)
        return places, until, own, known >= REPEATED, whole, known == FIRST

    def gone(self, texts: np.ndarray, codes: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of bytes that go: the text, first byte and end of each."""
        single = (codes & 255) == STRING
        places, until, own, known, _, _ = self.strings(texts[~single], codes[~single])
        whole, string = np.flatnonzero(copies > 1), (codes[single] >> 8) + self.bounds[texts[single]]
        own = np.concatenate([own[known], texts[single], whole])
        starts = np.concatenate([places[known], string, self.bounds[whole]])
        ends = np.concatenate([until[known] - 1 + self.length, string + self.length, self.bounds[whole + 1]])
        order = np.argsort(starts, kind="stable")
        own, starts, ends = own[order], starts[order], np.maximum.accumulate(ends[order])
        if not len(own):
            return own, starts, ends
        new = np.flatnonzero(np.concatenate([[True], (starts[1:] > ends[:-1]) | (own[1:] != own[:-1])]))
        return own[new], starts[new], ends[np.concatenate([new[1:], [len(ends)]]) - 1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time: these, the bytes of their texts, and where each begins and the last one ends."""
    for batch in batches:
        column = batch.column("text")
        if not len(column):
            continue
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data, first = np.frombuffer(column.buffers()[2], np.uint8), 0
        while first < len(column):
            end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PIECE, "right")) - 1)
            yield batch.slice(first, end - first), data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
            first = end


def distinct_texts(docs: DataFrame, length: int, path: str) -> str:
    """Name of a table of each distinct text that is long enough: its digest as `d1` and `d2`,
    `sha`, the text as bytes, its copies and a number; in buckets by digest."""
    long = docs.filter(F.octet_length("text") >= length)
    half = [F.conv(F.substring(F.hex("sha"), at, 16), 16, -10).cast("bigint") for at in (1, 17)]
    keyed = long.select(half[0].alias("d1"), half[1].alias("d2"), "sha", "text")
    one = keyed.groupBy("d1", "d2").agg(
        F.first("sha").alias("sha"), F.first("text").cast("binary").alias("text"), F.count("*").alias("copies")
    )
    name, buckets = f"texts_{uuid.uuid4().hex}", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = one.withColumn("uid", F.monotonically_increasing_id())
    numbered.write.bucketBy(buckets, "d1", "d2").option("path", path).option("compression", "zstd").saveAsTable(name)
    return name


def _letters(texts: DataFrame, length: int) -> DataFrame:
    """All letters: where, their digest as `a` and `b`, and how many cover the strings from there (`span`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in _pieces(batches):
            found = Letters(data, bounds, length)
            at, spans = found.letters()
            own = found.own[at]
            pairs = np.frombuffer(b"".join(found.digests(at)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {
                    "uid": batch.column("uid").to_numpy()[own],
                    "at": (at - found.firsts[own]).astype(np.int32),
                    "span": spans.astype(np.int32),
                    "most": found.most(at, spans)[own].astype(np.int32),
                    "a": pairs[:, 0],
                    "b": pairs[:, 1],
                    "c": np.zeros(len(pairs), np.int32),
                }
            )

    return texts.select("uid", "text").mapInArrow(run, "uid bigint, at int, span int, most int, a bigint, b bigint, c int")


def _numbered(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Ranks of the sorted rows of one range.

    Rows of a group of one are left out, but for the range's first and last group. Two
    more rows, without a text, tell the keys and sizes of these two groups.
    """
    names = ["uid", "at", "span", "most", "c"]
    base, seen, key, first, size, held, edge = part << 40, 0, None, 0, 0, None, None

    def out(batch: pa.RecordBatch, rank: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        columns = [batch.column(name) for name in names] + [pa.array(rank), pa.array(starts)]
        nothing = [pa.nulls(batch.num_rows, pa.int64())] * 3
        return pa.RecordBatch.from_arrays(columns + nothing, names=[*names, "rank", "first", "a", "b", "n"]).filter(pa.array(keep))

    def end(which: tuple[int, int, int], rank: int, n: int) -> pa.RecordBatch:
        row = {"uid": None, "at": None, "span": None, "most": None, "c": int(which[2]), "rank": rank, "first": None}
        return pa.RecordBatch.from_pylist([row | {"a": int(which[0]), "b": int(which[1]), "n": n}], _RANKED)

    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        a, b, c = (batch.column(name).to_numpy() for name in "abc")
        changes = np.ones(rows, bool)
        changes[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        changes[0] = key != (a[0], b[0], c[0])
        begins = np.flatnonzero(changes)
        group = np.cumsum(changes)
        ranks = np.concatenate([[first], begins + seen])[group] + base
        sizes = np.diff(np.concatenate([[0], begins, [rows]]))
        sizes[0] += size
        if held is not None:  # the last row so far, alone in its group
            if not changes[0]:
                yield held
            held = None
        if len(begins) and key is not None and edge is None:
            edge = end(key, first + base, int(sizes[0]))
        keep = sizes[group] > 1
        if edge is None:
            keep |= group == (0 if key is not None else 1)
            if key is None and len(begins) > 1:
                edge = end((a[0], b[0], c[0]), int(ranks[0]), int(sizes[1]))
        if len(begins):
            first, size = int(begins[-1]) + seen, int(sizes[-1])
        else:
            size = int(sizes[0])
        key = (a[-1], b[-1], c[-1])
        if not keep[-1]:
            last = np.zeros(rows, bool)
            last[-1] = True
            held = out(batch, ranks, changes, last)
        yield out(batch, ranks, changes, keep)
        seen += rows
    if key is not None:
        if held is not None:
            yield held
        if edge is not None:
            yield edge
        yield end(key, first + base, size)


_RANKED = pa.schema(
    [
        ("uid", pa.int64()), ("at", pa.int32()), ("span", pa.int32()), ("most", pa.int32()), ("c", pa.int32()),
        ("rank", pa.int64()), ("first", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()),
    ]
)
_RANKED_KINDS = "uid bigint, at int, span int, most int, c int, rank bigint, first boolean, a bigint, b bigint, n bigint"


def ranked(rows: DataFrame, keep: Scratch) -> DataFrame:
    """The rows whose key `a`, `b`, `c` is there more than once, with its `rank` in the order of keys.

    `first` marks one row of each key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _numbered(batches, TaskContext.get().partitionId())

    order = ["a", "b", "c", "uid", "at"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = keep(ranges.select("uid", "at", "span", "most", "a", "b", "c").mapInArrow(run, _RANKED_KINDS), "ranked")
    ends = found.filter("uid is null").select("a", "b", "c", "n", F.col("rank").alias("_old"))
    whole = ends.groupBy("a", "b", "c").agg(
        F.sum("n").alias("_n"), F.min("_old").alias("_rank"), F.collect_list("_old").alias("_olds")
    )
    known = whole.select(F.explode("_olds").alias("_old"), "_n", "_rank")  # two rows a range at most
    joined = found.filter("uid is not null").join(F.broadcast(known), F.col("rank") == F.col("_old"), "left")
    return joined.filter("_n is null or _n > 1").select(
        "uid", "at", "span", "most", "c", F.coalesce("_rank", "rank").alias("rank"),
        (F.col("first") & (F.coalesce("_rank", "rank") == F.col("rank"))).alias("first"),
    )


def _level(rows: DataFrame, keep: Scratch) -> DataFrame:
    with Scratch(rows.sparkSession, "ranks") as passing:
        return keep(ranked(rows, passing), "level")


def doubled(letters: DataFrame, length: int, keep: Scratch) -> DataFrame:
    """What is known of each mark: `uid, code`, its number * 256 + what."""
    now = _level(letters, keep)
    found = [_last(now.filter("span = 1"))]
    apart, level = 1, 0
    while not now.filter(F.col("most") > apart).isEmpty():
        further = F.when(F.col("most") >= 2 * apart, apart)
        both = F.array(further, F.when(F.col("span").between(apart + 1, 2 * apart - 1), F.col("span") - apart))
        left = now.select("uid", "at", "span", "most", F.col("rank").alias("a"), F.explode(both).alias("c")).filter("c is not null")
        left = left.withColumn("_to", F.col("at") + F.col("c"))
        right = now.select(F.col("uid").alias("_uid"), F.col("at").alias("_at"), F.col("rank").alias("b"))
        pairs = left.join(right, (F.col("uid") == F.col("_uid")) & (F.col("_to") == F.col("_at")))
        next_ones = _level(pairs.select("uid", "at", "span", "most", "a", "b", "c"), keep)
        found.append(_last(next_ones.filter(F.col("c") < apart)))
        now, apart, level = next_ones.filter(F.col("c") == apart), 2 * apart, level + 1
        found += [_last(now.filter(F.col("span") == apart)), now.select("uid", (F.col("at").cast("bigint") * 256 + level).alias("code"))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return keep(out, "known")


def _last(rows: DataFrame) -> DataFrame:
    what = F.when(F.col("first"), FIRST).otherwise(REPEATED)
    return rows.select("uid", (F.col("at").cast("bigint") * 256 + what).alias("code"))


def _beside(texts: DataFrame, known: DataFrame) -> DataFrame:
    """`texts` with all codes of each; the buckets stay where they are."""
    codes = known.groupBy("uid").agg(F.collect_list("code").alias("codes"))
    keyed = codes.join(texts.select("uid", "d1", "d2"), "uid").drop("uid")
    return texts.join(keyed.hint("shuffle_hash"), ["d1", "d2"], "left")


def _codes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All codes, each with the number of its row."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings in the order of their digests, which are the first of one digest, and which are not its only one."""
    order = np.argsort(rows["a"])
    a, b = rows["a"][order], rows["b"][order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((rows["b"], rows["a"]))
        a, b = rows["a"][order], rows["b"][order]
    new = np.ones(len(rows), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return rows[order], new, ~(new & np.append(new[1:], True))


def _known(rows: np.ndarray) -> bytes:
    found = np.empty(len(rows), _KNOWN)
    found["uid"], found["code"] = rows["uid"], rows["at"].astype(np.int64) * 256 + STRING
    return found.tobytes()


def _dealt(rows: np.ndarray, parts: int, own: int) -> pa.RecordBatch:
    """The strings by parts of the digests' range, one of each digest; and, for part `own`, those that repeat among these already."""
    rows, new, many = _grouped(rows)
    known = _known(rows[many & ~rows["sure"]])
    rows["sure"] |= many
    rows = rows[new]
    which = ((rows["a"] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    some, starts = np.unique(which, return_index=True)
    asked = [part.tobytes() for part in np.split(rows, starts[1:])]
    columns = {"part": pa.array([*some.tolist(), own % parts], pa.int32()), "asked": pa.array([*asked, None], pa.binary())}
    return pa.RecordBatch.from_pydict(columns | {"known": pa.array([None] * len(asked) + [known], pa.binary())})


def _strings(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """The strings that must be compared one by one, packed by parts of their digests' range.

    Those of one digest that a task has together are settled there and leave as one, so
    that no part grows by a string that is everywhere.
    """

    def asked(batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        uids, copies, view = batch.column("uid").to_numpy(), batch.column("copies").to_numpy(), memoryview(data)
        places, until, own, known, maybe, first = Letters(data, bounds, length).strings(*_codes(batch.column("codes")))
        those = np.flatnonzero((maybe & ~known) | first)
        places, own, sure = places[those], own[those], known[those] | (copies[own[those]] > 1)
        ends = np.cumsum(until[those] - places)
        shift = places - np.concatenate([[0], ends])[:-1]
        for start in range(0, int(ends[-1]) if len(ends) else 0, MOST_STRINGS):
            at = np.arange(start, min(start + MOST_STRINGS, ends[-1]))
            which = np.searchsorted(ends, at, "right")
            at += shift[which]
            pairs = b"".join([xxhash.xxh3_128_digest(view[p : p + length]) for p in at.tolist()])
            pairs, text, rows = np.frombuffer(pairs, "<u8").reshape(-1, 2), own[which], np.empty(len(at), _ASKED)
            rows["a"], rows["b"], rows["uid"], rows["at"], rows["sure"] = pairs[:, 0], pairs[:, 1], uids[text], at - bounds[text], sure[which]
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, waiting, count = TaskContext.get().partitionId(), [], 0
        for piece in _pieces(batches):
            for rows in asked(*piece):
                waiting.append(rows)
                count += len(rows)
                if count >= MOST_STRINGS:
                    yield _dealt(np.concatenate(waiting), parts, own)
                    own, waiting, count = own + 1, [], 0
        if waiting:
            yield _dealt(np.concatenate(waiting), parts, own)

    return texts.select("uid", "text", "copies", "codes").mapInArrow(run, "part int, asked binary, known binary")


def _repeated(strings: DataFrame, parts: int) -> DataFrame:
    """Of packed strings, those that are there more than once and were not known to be: `uid, code`."""

    def codes(known: bytes) -> pa.RecordBatch:
        found = np.frombuffer(known, _KNOWN)
        return pa.RecordBatch.from_pydict({name: np.ascontiguousarray(found[name]) for name in ("uid", "code")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for batch in batches:
            waiting += [np.frombuffer(some, _ASKED) for some in batch.column("asked").drop_null().to_pylist()]
            yield from map(codes, batch.column("known").drop_null().to_pylist())
        if waiting:
            rows, _, many = _grouped(np.concatenate(waiting))
            yield codes(_known(rows[many & ~rows["sure"]]))

    return strings.repartitionById(parts, "part").mapInArrow(run, "uid bigint, code bigint")


def _kept(texts: DataFrame, length: int) -> DataFrame:
    """What goes from each distinct text that loses any bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in _pieces(batches):
            copies, view, rest = batch.column("copies").to_numpy(), memoryview(data), []
            own, starts, ends = Letters(data, bounds, length).gone(*_codes(batch.column("codes")), copies)
            some, spans = np.unique(own, return_counts=True)
            stops, firsts = iter(ends.tolist()), iter(starts.tolist())
            for place, end, n in zip(bounds[some].tolist(), bounds[some + 1].tolist(), spans.tolist(), strict=True):
                digest = sha256()
                for _ in range(n):
                    digest.update(view[place : next(firsts)])
                    place = next(stops)
                digest.update(view[place:end])
                rest.append(digest.hexdigest())
            removed = np.bincount(own, ends - starts, len(bounds))[some].astype(np.int64)
            columns = [batch.column("sha").take(pa.array(some)), *map(pa.array, (copies[some], removed, spans)), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["sha", "copies", "n_removed", "n_spans", "kept_sha256"])

    kinds = "sha binary, copies bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return texts.select("sha", "text", "copies", "codes").mapInArrow(run, kinds)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Each document with its bytes, how many and in how many runs go, and the digest of the rest."""
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    spark = docs.sparkSession
    with Scratch(spark, "doubling") as keep:
        name = distinct_texts(own, length, f"{keep.path}/texts")
        texts = spark.table(name)
        known = doubled(_letters(texts, length), length, keep)
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
        strings = keep(_repeated(_strings(_beside(texts, known), length, parts), parts), "strings")
        known = known.unionByName(strings)
        gone = settle(_kept(_beside(texts, known), length), "gone")
        spark.sql(f"drop table {name}")
    docs = own.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), "sha")
    out = with_totals(docs, "sha", gone, "copies")
    return out.select(
        F.col("id").alias(id),
        "n_bytes",
        *(F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in ("n_removed", "n_spans")),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
