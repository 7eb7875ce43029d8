"""Document quality by a linear-chain conditional random field over lines.

A text is split at line feeds; each line is good or bad. What is measured of a line
(capitals, digits, marks, word lengths, repeated words, repeated lines, its own length)
falls into bins, and the field's features are the bins of the line and of the lines
before and after it; two weights a pair of neighbours tie their labels. The forward and
backward passes give each line its chance to be good, and a document's quality is the
mean of these, weighted by the lines' lengths in bytes plus one.

The field is fitted on at most `most` labelled documents of either label, those whose
ids have the lowest digests; all lines of such a document carry its label. These serve as
examples in the order of the digests until they hold `most_lines` lines, each whole and
whatever its length. Every text is scored whole; of a text above 2 MiB blocks are counted one
by one, cut at line feeds or spaces, with the same counts.

Null texts count as empty, and an empty text is one empty line. Without examples of
both labels every score is their smoothed share. Labels that are not 0 or 1, and ids
whose labels disagree, do not count. Columns that have the name of an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from frameloom.llm.training import minimize, sampled, sampled_texts
from frameloom.session import settle

#: Labelled documents with label 0 and label 1 that the field is fitted on at most.
MOST = (2000, 3000)
#: Once the examples hold so many lines, no other is added.
MOST_LINES = 1_000_000
PENALTY = 1.0
THRESHOLD = 0.7
#: Bytes of text that are measured together.
BLOCK = 1 << 21

#: The kinds of bytes that are counted; a byte has one kind at most.
KINDS = {
    "capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "bar": b"|",
    "call": b"!?",
    "stop": b".,;:'\"-()",
    "mark": b"#$%&*+/<=>@[\\]^_`{}~",
    "other": bytes([*range(9), *range(14, 32), 127]),
}
COUNTS = [*KINDS, "high", "words", "again", "bytes"]
AT = {name: i for i, name in enumerate(COUNTS)}
KIND = np.zeros(256, np.uint8)
for _n, _bytes in enumerate(KINDS.values(), 1):
    KIND[list(_bytes)] = _n
KIND[128:] = len(KINDS) + 1
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Random numbers of pairs of bytes; a word's code is the sum over its pairs.
PAIRS = np.random.default_rng(1).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
#: Bins of shares, of mean word lengths and of line lengths.
SHARES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 0.9])
WORD_LENGTHS = np.array([2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.5, 10.0, 14.0])
LINE_LENGTHS = np.array([1.0, 8.0, 20.0, 50.0, 120.0, 300.0, 800.0, 3000.0])
MEASURES = 11
BINS = 10
#: Features of a line: the bins of its neighbours' and its own measures, and one for either end.
PER_PLACE = MEASURES * BINS + 1
FEATURES = 3 * PER_PLACE


def _counted(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each line of `data`, which ends with a line feed, a code of its words, and all words' codes."""
    buffer = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.r_[0, ends[:-1] + 1]
    counts = np.zeros((len(ends), len(COUNTS)), np.int64)
    kind = KIND[buffer]
    for n in range(len(KINDS) + 1):
        at = np.flatnonzero(kind == n + 1)
        counts[:, n] = np.bincount(np.searchsorted(ends, at), minlength=len(ends))
    counts[:, AT["bytes"]] = ends - starts
    space = SPACE[buffer]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    codes, words = np.zeros(len(ends), np.uint64), np.empty(0, np.uint64)
    if len(begin):
        line = np.searchsorted(ends, begin)
        counts[:, AT["words"]] = np.bincount(line, minlength=len(ends))
        plain = np.where(space, np.uint8(32), buffer)
        pairs = PAIRS[(plain[:-1].astype(np.uint16) << 8) | plain[1:]]
        pairs[space[:-1]] = 0
        words = np.add.reduceat(pairs, begin)
        again = line[1:][(words[1:] == words[:-1]) & (line[1:] == line[:-1])]
        counts[:, AT["again"]] = np.bincount(again, minlength=len(ends))
        np.add.at(codes, line, words)
    return counts, codes, words


def count_lines(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each line of `data`, which ends with a line feed, and a code of its words."""
    return _counted(data)[:2]


def _blocks(data: bytes) -> Iterator[bytes]:
    """A text cut into blocks behind line feeds, else behind spaces; a longer word stays whole."""
    at = 0
    while len(data) - at > BLOCK:
        cut = data.rfind(b"\n", at, at + BLOCK) + 1 or data.rfind(b" ", at, at + BLOCK) + 1
        if not cut:
            found = [n for n in (data.find(b"\n", at + BLOCK), data.find(b" ", at + BLOCK)) if n >= 0]
            cut = min(found, default=len(data) - 1) + 1
        yield data[at:cut]
        at = cut
    if at < len(data):
        yield data[at:]


def _long(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As `count_lines` for one long text: counts and codes of a cut line's parts add up.

    Words are not cut. Of the parts of a line, the last word of all before is kept.
    """
    parts, whole, last = [], True, None
    for block in _blocks(data + b"\n"):
        ended = block.endswith(b"\n")
        counts, codes, words = _counted(block if ended else block + b"\n")
        following = words[-1] if counts[-1, AT["words"]] else None
        if not whole:
            if counts[0, AT["words"]]:
                counts[0, AT["again"]] += last is not None and last == words[0]
            elif len(counts) == 1:
                following = last
            parts[-1][0][-1] += counts[0]
            parts[-1][1][-1:] += codes[:1]
            counts, codes = counts[1:], codes[1:]
        parts.append((counts, codes)) if len(counts) else None
        whole, last = ended, following
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def measured(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all lines (uint8), their bytes, and the number of lines of each text."""
    lines = np.array([text.count(b"\n") + 1 for text in texts], np.int64)
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        counts, codes = _long(texts[0])
    else:
        counts, codes = count_lines(b"\n".join(texts) + b"\n")
    size, words = counts[:, AT["bytes"]], counts[:, AT["words"]]
    per_byte = [counts[:, AT[k]] / np.maximum(size, 1) for k in ("capital", "digit", "stop", "other", "high")]
    per_word = [counts[:, AT[k]] / np.maximum(words, 1) for k in ("bar", "call", "mark", "again")]
    of = np.repeat(np.arange(len(texts)), lines)
    order = np.lexsort((codes, of))
    same = (codes[order][1:] == codes[order][:-1]) & (of[order][1:] == of[order][:-1]) & (words[order][1:] > 0)
    repeated = np.zeros(len(codes), np.uint8)
    repeated[order] = np.r_[same, False] | np.r_[False, same]
    bins = np.empty((len(codes), MEASURES), np.uint8)
    for i, share in enumerate([*per_byte, *per_word]):
        bins[:, i] = np.searchsorted(SHARES, share)
    spread = np.searchsorted(WORD_LENGTHS, size / np.maximum(words, 1))
    bins[:, 9] = np.searchsorted(LINE_LENGTHS, size)
    bins[:, 10] = np.where(repeated > 0, 9, np.minimum(spread, 8))
    return bins, size, lines


class Chains:
    """Documents' lines side by side: all first lines, all second lines, and so on."""

    def __init__(self, bins: np.ndarray, lines: np.ndarray):
        self.lines = lines
        self.documents = np.argsort(-lines, kind="stable")
        longest = int(lines.max(initial=0))
        first = (np.cumsum(lines) - lines)[self.documents]
        self.active = np.searchsorted(-lines[self.documents], -np.arange(longest), side="left")
        self.offset = np.cumsum(np.r_[0, self.active])
        rows = [first[: self.active[t]] + t for t in range(longest)]
        self.row = np.concatenate(rows) if rows else np.empty(0, np.int64)
        place = np.empty(len(self.row), np.int64)
        place[self.row] = np.arange(len(self.row))
        self.place = place  # of each line among the chains
        own = bins.astype(np.int16) + np.arange(MEASURES, dtype=np.int16) * BINS
        start = np.zeros(len(bins), bool)
        start[np.cumsum(lines) - lines] = True
        end = np.zeros(len(bins), bool)
        end[np.cumsum(lines) - 1] = True
        none = np.int16(PER_PLACE - 1)
        before = np.where(start[:, None], none, np.roll(own, 1, axis=0)) + PER_PLACE
        after = np.where(end[:, None], none, np.roll(own, -1, axis=0)) + 2 * PER_PLACE
        self.features = np.concatenate([own, before, after], axis=1)[self.row]

    def passes(self, good: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of all labelings before and after each line, for either label."""
        ahead, back = np.zeros((len(good), 2)), np.zeros((len(good), 2))
        ahead[:, 1] = good
        for t in range(1, len(self.active)):
            a, n = self.offset[t], self.active[t]
            last = ahead[self.offset[t - 1] : self.offset[t - 1] + n]
            for y in (0, 1):
                ahead[a : a + n, y] += np.logaddexp(last[:, 0] + tie[0, y], last[:, 1] + tie[1, y])
        for t in range(len(self.active) - 1, 0, -1):
            a, n = self.offset[t], self.active[t]
            later = back[a : a + n].copy()
            later[:, 1] += good[a : a + n]
            into = self.offset[t - 1]
            for y in (0, 1):
                back[into : into + n, y] = np.logaddexp(later[:, 0] + tie[y, 0], later[:, 1] + tie[y, 1])
        return ahead, back


@dataclass
class Field:
    weights: np.ndarray  # of features, for a good line
    tie: np.ndarray  # of neighbouring labels
    share: float | None = None  # the score of every text where nothing could be learnt

    def quality(self, texts: list[bytes]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        bins, size, lines = measured(texts)
        chains = Chains(bins, lines)
        ahead, back = chains.passes(self.weights[chains.features].sum(axis=1), self.tie)
        total = ahead + back
        good = (1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))))[chains.place]
        weight = size + 1.0
        starts = np.cumsum(lines) - lines
        return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def fit_bins(bins: list[np.ndarray], labels: np.ndarray, shares: tuple[int, int]) -> Field:
    """The field of documents given by the bins of their lines; `shares` counts all labels."""
    found = np.bincount(labels, minlength=2)
    if not found.all():
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), (shares[1] + 1) / (sum(shares) + 2))
    lines = np.array([len(b) for b in bins])
    chains = Chains(np.concatenate(bins), lines)
    truth = np.repeat(labels, lines)[chains.row].astype(float)
    follows = np.concatenate([np.arange(chains.active[t]) + chains.offset[t - 1] for t in range(1, len(chains.active))] or [np.empty(0, np.int64)])
    later = np.arange(chains.active[0], len(truth)) if len(chains.active) else follows
    # every document counts alike within its label, and the labels by their shares
    documents = chains.documents
    weight = (np.array(shares) / found)[labels[documents]]
    weight *= len(labels) / weight.sum()
    per_line = weight[np.arange(len(truth)) - np.repeat(chains.offset[:-1], chains.active)]

    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        own, tie = point[:FEATURES], point[FEATURES:].reshape(2, 2)
        good = own[chains.features].sum(axis=1)
        ahead, back = chains.passes(good, tie)
        n = chains.active[0]
        whole = np.logaddexp(ahead[:n, 0] + back[:n, 0], ahead[:n, 1] + back[:n, 1])
        total = whole[np.arange(len(truth)) - np.repeat(chains.offset[:-1], chains.active)]
        marginal = np.exp(ahead[:, 1] + back[:, 1] - total)
        path = float((per_line * good * truth).sum())
        slope = np.zeros(FEATURES + 4)
        pull = per_line * (marginal - truth)
        slope[:FEATURES] = np.bincount(chains.features.ravel(), np.repeat(pull, chains.features.shape[1]), FEATURES)
        for a in (0, 1):
            for b in (0, 1):
                both = np.exp(ahead[follows, a] + tie[a, b] + (good[later] if b else 0.0) + back[later, b] - total[later])
                seen = (truth[follows] == a) & (truth[later] == b)
                path += tie[a, b] * float((per_line[later] * seen).sum())
                slope[FEATURES + 2 * a + b] = float((per_line[later] * (both - seen)).sum())
        value = float((weight * whole).sum()) - path + 0.5 * PENALTY * float(point @ point)
        return value, slope + PENALTY * point

    point = minimize(loss, np.zeros(FEATURES + 4), rounds=80)
    return Field(point[:FEATURES], point[FEATURES:].reshape(2, 2))


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > BLOCK:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _bytes(column: pa.Array) -> list[bytes]:
    return [(text or "").encode() for text in column.to_pylist()]


@F.arrow_udf(BinaryType())
def _bins(column: pa.Array) -> pa.Array:
    return pa.array([measured([text])[0].tobytes() for text in _bytes(column)], pa.binary())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    most: tuple[int, int] = MOST,
    most_lines: int = MOST_LINES,
) -> Field:
    """The field; `labels` holds `_id` and `_label`, each id once."""
    sample, shares = sampled(labels, most)
    texts = sampled_texts(docs, sample, text, id)
    digest = F.xxhash64(F.col("_id").cast("string")).alias("_digest")
    found = settle(texts.select("_id", digest, "_label", _bins(F.col("_text")).alias("bins")), "examples")
    # at most as many rows as the sample has, and two numbers each
    before = F.sum(F.length("bins")).over(Window.orderBy("_digest", "_id").rowsBetween(Window.unboundedPreceding, -1))
    some = found.withColumn("_before", F.coalesce(before, F.lit(0))).select("_id", "_before")
    kept = found.join(F.broadcast(some.filter(F.col("_before") < most_lines * MEASURES)), "_id")
    rows = kept.orderBy("_digest", "_id").select("_label", "bins").toArrow()
    return fit_bins(
        [np.frombuffer(b.as_py(), np.uint8).reshape(-1, MEASURES) for b in rows.column("bins")],
        rows.column("_label").to_numpy().astype(np.int64),
        shares,
    )


def score(text: Column, field: Field) -> Column:
    """The quality of a text."""

    @F.arrow_udf(DoubleType())
    def run(column: pa.Array) -> pa.Array:
        found = [field.quality(some) for some in _batches(_bytes(column))]
        return pa.array(np.concatenate([np.empty(0), *found]), pa.float64())

    return run(text)


def classify(docs: DataFrame, field: Field, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `score` and `predicted`, 1 if the score reaches the threshold."""
    return docs.withColumn("score", score(F.col(text), field)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
