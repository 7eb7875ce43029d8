"""SimHash near-duplicates with a Gray-order hierarchical index.

A text's A-Z are lower-cased, its words are runs without ASCII white space, and its
features are the runs of three words with repeats (fewer words: the whole sequence).
A bit of the 64-bit fingerprint is set if it is set in over half of the features'
XXH64. Texts without words have fingerprint zero. Fingerprints that differ in at most
two bits are linked, and links join documents into components.

The index over the distinct fingerprints has two parts. Its upper nodes are masked
patterns: for each choice of six of the eight bytes, the value of those bytes. Two
fingerprints that differ in two bits at most agree on some choice, and a node holds
2^16 fingerprints at most, so Spark can deal out whole nodes. Within a node, the
fingerprints are sorted by Gray rank, so that neighbours differ in few bits; runs of
them form lower nodes, runs of those the next, and each keeps the bits that all of
its fingerprints share. The node is joined with itself from the top: a pair of groups
is dropped with all that is below it as soon as the differences that have added up in
the bits that both share exceed two. A node yields a star for each of its connected
parts, not its pairs.

Null texts count as empty. Equal fingerprints are linked whatever their number: the
index sees each once. Rows with a null id take part; a component's id is its smallest
id that is not null, or null. An empty table gives an empty result. Columns that have
the name of an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from frameloom.session import settle

SEED, WORDS, DISTANCE = 42, 3, 2
#: Lower nodes join so many neighbours.
FAN = 16
#: Groups up to this size are compared without lower nodes.
LEAF = 64
#: Pairs of groups that are looked at together.
BLOCK = 1 << 12
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: The masks of the upper nodes: all bytes but two.
MASKS = [
    sum(0xFF << (8 * byte) for byte in range(8) if byte not in left_out) for left_out in combinations(range(8), DISTANCE)
]


def simhash(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < WORDS:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=False)], "<u8"
    )
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


@F.arrow_udf(LongType())
def _simhash(column: pa.Array) -> pa.Array:
    values = np.fromiter((simhash(text.as_py()) for text in column), np.uint64, len(column))
    return pa.array(values.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text, its 64 bits as a long."""
    return _simhash(text)


def written(fingerprint: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def gray_rank(fingerprint: Column) -> Column:
    """The place of a bit pattern in the Gray sequence."""
    rank = fingerprint
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Give rows that a pair joins, directly or not, the smallest label among them."""
    while len(left):
        low, high = np.minimum(label[left], label[right]), np.maximum(label[left], label[right])
        apart = low != high
        left, right, low, high = left[apart], right[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        while len(left) and not np.array_equal(label, jumped := label[label]):
            label[:] = jumped


def _close(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[left] ^ values[right]) <= DISTANCE


def _pairs(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of pairs of groups, each once; `n` children in all."""
    step = np.arange(FAN)
    left = np.broadcast_to((i * FAN)[:, None, None] + step[:, None], (len(i), FAN, FAN)).ravel()
    right = np.broadcast_to((j * FAN)[:, None, None] + step[None, :], (len(i), FAN, FAN)).ravel()
    there = (left <= right) & (right < n) & (left < n)
    return left[there], right[there]


def _join_node(values: np.ndarray, label: np.ndarray) -> None:
    """Join one upper node, sorted by Gray rank, with itself; `label` gets its parts."""
    levels = []  # for each level of lower nodes the shared bits and their pattern
    both = either = values
    while len(both) > 1:
        cut = np.arange(0, len(both), FAN)
        both, either = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut)
        shared = ~(both ^ either)
        levels.append((shared, both & shared))
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > BLOCK:
            todo += [(level, i[:BLOCK], j[:BLOCK]), (level, i[BLOCK:], j[BLOCK:])]
            continue
        i, j = _pairs(i, j, len(levels[level - 1][0]) if level else len(values))
        if level:
            shared, pattern = levels[level - 1]
            near = np.bitwise_count((pattern[i] ^ pattern[j]) & shared[i] & shared[j]) <= DISTANCE
            todo.append((level - 1, i[near], j[near]))
        else:
            near = _close(values, i, j)
            _merge(label, i[near], j[near])


def join_nodes(node: np.ndarray, pattern: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the first row of its part of its upper node. Rows are sorted by node."""
    n = len(values)
    label = np.arange(n)
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (pattern[1:] != pattern[:-1])]) if n else label
    size = np.diff(np.r_[first, n])
    of = np.repeat(np.arange(len(first)), size)
    in_leaf = size[of] <= LEAF
    for step in range(1, min(LEAF, int(size.max(initial=1)))):
        at = np.flatnonzero((of[step:] == of[:-step]) & in_leaf[step:])
        close = at[_close(values, at, at + step)]
        _merge(label, close, close + step)
    for k in np.flatnonzero(size > LEAF):
        rows = slice(first[k], first[k] + size[k])
        own = np.arange(size[k])
        _join_node(values[rows], own)
        label[rows] = own + first[k]
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each row to the first of its part; a node that goes on in the next batch waits."""
    masks = np.array(MASKS, np.uint64)
    kept = [np.empty(0, np.int64), np.empty(0, np.uint64)]

    def links(node: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        label = join_nodes(node, values & masks[node], values)
        linked = np.flatnonzero(label != np.arange(len(label)))
        ends = [values[linked].view(np.int64), values[label[linked]].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    for batch in batches:
        node = np.concatenate([kept[0], batch.column(0).to_numpy().astype(np.int64)])
        values = np.concatenate([kept[1], batch.column(1).to_numpy().view(np.uint64)])
        if not len(node):
            continue
        pattern = values & masks[node]
        going_on = (node == node[-1]) & (pattern == pattern[-1])
        done = len(node) - int(going_on.sum())
        kept = [node[done:], values[done:]]
        if done:
            yield links(node[:done], values[:done])
    if len(kept[0]):
        yield links(*kept)


def fingerprint_links(distinct: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Links `a`, `b` that connect whatever differs in two bits at most.

    Every linked pair is connected through links, most pairs are no link themselves.
    """
    value = F.col("value")
    nodes = distinct.select(F.col(fingerprint).alias("value")).select(
        F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in MASKS])).alias("node", "mask"), "value"
    )
    pattern = value.bitwiseAND(F.col("mask"))
    dealt = nodes.withColumn("pattern", pattern).repartition("node", "pattern")
    ordered = dealt.sortWithinPartitions("node", "pattern", gray_rank(value)).select("node", "value")
    return ordered.mapInArrow(_stars, "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """`node` and `root` for every node of a link; one root for each connected part.

    In each round all nodes move to the first of their neighbours in a hashed order
    and links between those that met go. Links are written after each round.
    """
    links = settle(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = settle(ends.withColumn("root", F.col("node")), "roots")

    def first_of(links: DataFrame) -> DataFrame:
        both = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
        near = links.select(F.inline(both))
        place = F.struct(F.xxhash64("y").alias("place"), F.col("y").alias("to"))
        own = F.struct(F.xxhash64("x").alias("place"), F.col("x").alias("to"))
        return near.groupBy("x").agg(F.min(place).alias("best")).select("x", F.least("best", own)["to"].alias("to"))

    while not links.isEmpty():
        first = settle(first_of(links), "first")
        moved = (
            links.join(first, links.a == first.x)
            .select(F.col("to").alias("a"), "b")
            .join(first, F.col("b") == first.x)
            .select("a", F.col("to").alias("b"))
        )
        met = moved.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = settle(met, "links")
        roots = settle(
            roots.join(first, roots.root == first.x, "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
        )
    return roots


def components(marked: DataFrame, id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Each distinct `fingerprint` with the `component_id` and the `component` that it is in.

    `marked`, a written table, holds the fingerprint of every document as a long.
    """
    firsts = settle(
        marked.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.min(id).alias("_first")), "fingerprints"
    )
    roots = connected(fingerprint_links(firsts))
    known = settle(
        firsts.join(roots, firsts.fingerprint == roots.node, "left").select(
            "fingerprint", "_first", F.coalesce("root", "fingerprint").alias("component")
        ),
        "members",
    )
    smallest = known.groupBy(F.col("component").alias("_part")).agg(F.min("_first").alias("component_id"))
    return settle(
        known.join(settle(smallest, "smallest"), F.col("component") == F.col("_part")).select(
            "fingerprint", "component", "component_id"
        ),
        "components",
    )


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """`id`, `fingerprint` (hex) and `component_id` of every document."""
    marked = settle(docs.select(id, fingerprint(F.col(text)).alias("fingerprint")), "marked")
    return marked.join(components(marked, id), "fingerprint").select(
        id, written(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The columns of `docs`; of every component the row with the smallest id stays.

    Of rows that share that id and their fingerprint, the one with the smallest text
    stays, and of those with equal texts any.
    """
    columns = docs.columns
    marked = settle(docs.select(F.struct(*columns).alias("_row"), fingerprint(F.col(text)).alias("fingerprint")), "marked")
    ids = marked.select(F.col("_row").getField(id).alias(id), "fingerprint")
    groups = settle(ids.groupBy("fingerprint", id).count(), "groups")
    parts = components(groups, id)
    best = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), "fingerprint", "count")).alias("best")
    keepers = settle(
        groups.join(parts, "fingerprint").groupBy("component").agg(best).select(
            F.col("best.id").alias("_id"), F.col("best.fingerprint").alias("_fingerprint"), F.col("best.count").alias("_rows")
        ),
        "keepers",
    )
    same = (F.col("fingerprint") == F.col("_fingerprint")) & F.col("_row").getField(id).eqNullSafe(F.col("_id"))
    kept = marked.join(keepers, same)
    single = kept.filter("_rows = 1").select("_row.*")
    shared = kept.filter("_rows > 1").groupBy("_fingerprint", "_id").agg(F.min_by("_row", F.coalesce(F.col("_row").getField(text), F.lit(""))).alias("_row"))
    return single.unionByName(shared.select("_row.*"))
