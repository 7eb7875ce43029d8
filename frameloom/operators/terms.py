"""Terms of documents, counted and weighed batch by batch inside Spark's tasks.

A batch is a list of words for each document. What leaves a task is small: sums per
term, or a document's weights as lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from frameloom.functions.text import WHITE_SPACE

CHAR_GRAMS = (3, 4, 5)
#: Words whose terms are counted at once, if they are not of a single document.
WORDS_AT_ONCE = 250_000


@dataclass(frozen=True)
class Counts:
    """The distinct terms of each of `size` documents."""

    size: int
    document: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    terms: pa.Array


def lists(batches: Iterator[pa.RecordBatch], names: Sequence[str] = ("words", "_char")) -> Iterator[pa.RecordBatch]:
    """The batches, with texts in the columns `names` split at white space."""
    for batch in batches:
        for name in names:
            if name in batch.schema.names and not pa.types.is_nested(batch.column(name).type):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, name, _split(batch.column(name)))
        yield batch


def _split(text: pa.Array) -> pa.ListArray:
    """The words between white space."""
    found = pc.split_pattern_regex(pc.fill_null(text.cast(pa.string()), ""), pattern=f"[{WHITE_SPACE}]+")
    words = found.flatten()
    kept = pc.not_equal(words, "")  # at the ends of a text
    until = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(until[np.concatenate([[0], ends])], pa.int32()), words.filter(kept))


def slices(batch: pa.RecordBatch, words: str) -> Iterator[pa.RecordBatch]:
    """`batch` in parts of few words."""
    until = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(words)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = until[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(until, before + WORDS_AT_ONCE, "right")))
        yield batch.slice(start, end - start)
        start = end


def _in_order(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each with its times; as one number where both fit, which sorts faster."""
    if not len(key):
        return key, times
    bits = int(times.max()).bit_length()
    if int(key.max()).bit_length() + bits < 64:
        both = np.sort(key << bits | times)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(key)
    return key[order], times[order]


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the times of each."""
    if not len(key):
        return key, times
    key, times = _in_order(key, times)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(times, starts)


def _encoded(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The document and the number of each word, and the distinct words."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    found = words.flatten().dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(words)), sizes), codes, found.dictionary.cast(pa.string())


def word_counts(words: pa.ListArray) -> Counts:
    """Words and pairs of neighboring words."""
    return _word_counts(len(words), *_encoded(words))


def _word_counts(
    size: int, document: np.ndarray, codes: np.ndarray, distinct: pa.Array, more: tuple[np.ndarray, ...] = ()
) -> Counts:
    """`more` pairs have their documents, left and right words."""
    inside = document[1:] == document[:-1]
    owner, left, right = (
        np.concatenate(column) for column in zip((document[:-1][inside], codes[:-1][inside], codes[1:][inside]), more or [[]] * 3)
    )
    pairs, pair = np.unique((left * len(distinct) + right).astype(np.int64), return_inverse=True)
    left, right = (distinct.take(pa.array(side)) for side in (pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)))
    terms = pa.concat_arrays([distinct, pc.binary_join_element_wise(left, right, " ")])
    every = np.concatenate([document, owner]).astype(np.int64)
    term = np.concatenate([codes, pair + len(distinct)])
    key, tf = np.unique(every * len(terms) + term, return_counts=True)
    return Counts(size, key // max(len(terms), 1), key % max(len(terms), 1), tf, terms)


def _pieces(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of `text`, which is UTF-8, by their first bytes and lengths."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = text[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many numbers from each start on, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def char_counts(words: pa.ListArray) -> Counts:
    """Character 3- to 5-grams inside words padded with one space on each side.

    A word has the same grams wherever it stands, so each distinct word is cut up once
    and its grams count as often as the word.
    """
    return _char_counts(len(words), *_encoded(words))


def _char_counts(
    size: int, document: np.ndarray, codes: np.ndarray, distinct: pa.Array, more: tuple[np.ndarray, ...] = ()
) -> Counts:
    """No gram goes from word to word, so `more` pairs have none."""
    documents = size
    key, times = np.unique(document * len(distinct) + codes, return_counts=True)
    document, word = key // max(len(distinct), 1), key % max(len(distinct), 1)
    # All words one after the other, by code points; `row` ends in five more so that a gram may look ahead.
    padded = pc.binary_join_element_wise("", distinct, "", " ")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(padded)], pa.int32()), padded), "")[0].as_py()
    row = np.frombuffer((joined + " " * CHAR_GRAMS[-1]).encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.frombuffer(joined.encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum(1 + (row >= 0x80) + (row >= 0x800) + (row >= 0x10000))])
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    starts = np.cumsum(lengths) - lengths
    used = np.zeros(0x110000, bool)
    used[row] = True
    row, letters = (np.cumsum(used) - 1)[row], int(used.sum())
    gram, most, found, parts, names = row[: len(joined)], letters, 0, [], []
    for size in range(2, CHAR_GRAMS[-1] + 1):
        if most * letters >= 1 << 63:
            # Of so many letters a gram's number gets too large; it is made the place among those there are.
            gram = np.unique(gram, return_inverse=True)[1]
            most = len(gram)
        # A gram is the number of the one before it in length, and its last letter.
        gram, most = gram * letters + row[size - 1 : size - 1 + len(joined)], most * letters
        if size not in CHAR_GRAMS:
            continue
        # Grams that only cross from word to word are left out.
        inside = np.maximum(lengths - size + 1, 0)
        place = _ranges(starts, inside)
        encoded = pa.array(gram[place]).dictionary_encode()
        number, grams = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(encoded.dictionary)
        some = np.zeros(grams, np.int64)
        some[number] = place
        each = inside[word]
        own = number[_ranges((np.cumsum(inside) - inside)[word], each)]
        bits = grams.bit_length()
        key, tf = _summed(np.repeat(document << bits, each) | own, np.repeat(times, each))
        parts.append((key >> bits, (key & ((1 << bits) - 1)) + found, tf))
        names.append(_pieces(text, at[some], at[some + size] - at[some]))
        found += grams
    return Counts(documents, *(np.concatenate(column) for column in zip(*parts)), pa.concat_arrays(names))


ANALYZERS = {"word": word_counts, "char": char_counts}
_COUNTERS = {"word": _word_counts, "char": _char_counts}


@dataclass(frozen=True)
class Shared:
    """Terms of documents that may end alike. A document has the terms of the piece of its own
    number and those of its `base`, a piece behind those of the documents (-1: none), and no
    term is in both. A piece belongs to so many documents as `times` says."""

    counts: Counts
    base: np.ndarray
    times: np.ndarray


def groups(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """A number for each row, the same for neighbors that agree in the columns `names`."""
    new = np.ones(batch.num_rows, bool)
    if len(new) > 1 and names:
        same = [pc.fill_null(pc.equal(batch.column(n).slice(1), batch.column(n).slice(0, len(new) - 1)), False) for n in names]
        new[1:] = ~np.logical_and.reduce([column.to_numpy(zero_copy_only=False) for column in same])
    return np.cumsum(new) - 1


def _common_ends(codes: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many words all documents of a group have in common at their ends; none if there is but one."""
    ends, second = np.cumsum(sizes), np.flatnonzero(group[1:] == group[:-1]) + 1
    tails = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    most = np.minimum(sizes[second], sizes[second - 1])
    back = _ranges(np.zeros(len(second), np.int64), most)
    other = codes[np.repeat(ends[second] - 1, most) - back] != codes[np.repeat(ends[second - 1] - 1, most) - back]
    pair = np.repeat(np.arange(len(second)), most)[other]
    np.minimum.at(most, pair, back[other])
    np.minimum.at(tails, group[second], most)
    return np.where(tails == np.iinfo(np.int64).max, 0, tails)[group]


def shared_counts(analyzer: str, words: pa.ListArray, group: np.ndarray) -> Shared:
    """As the analyzers count, but what the documents of a group end with is counted once for all.
    The members of a group, which has a number, are neighbors."""
    size, (document, codes, distinct) = len(words), _encoded(words)
    sizes = np.bincount(document, minlength=size)
    ends, tail = np.cumsum(sizes), _common_ends(codes, sizes, group)
    starts = (tail > 0) & np.concatenate([[True], group[1:] != group[:-1]])[:size]
    number, heads = np.cumsum(starts) - 1, np.flatnonzero(starts)
    base = np.where(tail > 0, size + number, -1)
    times = np.concatenate([np.ones(size, np.int64), np.bincount(number[tail > 0], minlength=len(heads))])
    place = np.concatenate([_ranges(ends - sizes, sizes - tail), _ranges((ends - tail)[heads], tail[heads])])
    piece = np.repeat(np.arange(len(times)), np.concatenate([sizes - tail, tail[heads]]))
    # The pair of a document's own last word and the first one in common is its own.
    both = np.flatnonzero((tail > 0) & (tail < sizes))
    more = both, codes[(ends - tail)[both] - 1], codes[(ends - tail)[both]]
    counts = _COUNTERS[analyzer](len(times), piece, codes[place], distinct, more)

    # Terms that are in a document's own piece and in its base go from the base to all its documents.
    bits = len(counts.terms).bit_length()
    own, key = counts.document < size, counts.document << bits | counts.term
    there, entry = _in_order(key[~own], np.flatnonzero(~own))
    asked = counts.document[own], counts.term[own]
    asked = (base[asked[0]] << bits | asked[1])[base[asked[0]] >= 0]
    at = np.minimum(np.searchsorted(there, asked), max(len(there) - 1, 0))
    moved = np.unique(entry[at[there[at] == asked]]) if len(there) else np.zeros(0, np.int64)
    left = ~own
    left[moved] = False
    each = times[counts.document[moved]]
    given = _ranges(heads[counts.document[moved] - size], each) << bits | np.repeat(counts.term[moved], each)
    key, tf = _summed(np.concatenate([key[own], given]), np.concatenate([counts.tf[own], np.repeat(counts.tf[moved], each)]))
    columns = (key >> bits, counts.document[left]), (key & ((1 << bits) - 1), counts.term[left]), (tf, counts.tf[left])
    return Shared(Counts(len(times), *map(np.concatenate, columns), counts.terms), base, times)


@dataclass(frozen=True)
class Weights:
    """Weights of the vocabulary's terms, by document and then by slot."""

    size: int
    document: np.ndarray
    slot: np.ndarray
    tf: np.ndarray
    weight: np.ndarray

    def offsets(self) -> np.ndarray:
        return np.searchsorted(self.document, np.arange(self.size + 1))


def _plain_weights(counts: Counts, known: pa.Array, idf: np.ndarray) -> Weights:
    """`(1 + ln tf) * idf` of the terms in `known`, whose places are the slots."""
    slots = pc.fill_null(pc.index_in(counts.terms, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    slot = slots[counts.term] if len(counts.term) else np.zeros(0, np.int64)
    kept = np.flatnonzero(slot >= 0)
    bits = len(known).bit_length()
    key, tf = _in_order(counts.document[kept] << bits | slot[kept], counts.tf[kept])
    document, slot = key >> bits, key & ((1 << bits) - 1)
    return Weights(counts.size, document, slot, tf, (1.0 + np.log(tf.astype(np.float64))) * idf[slot])


def weigh(counts: Counts, known: pa.Array, idf: np.ndarray) -> Weights:
    """Unit-length weights `(1 + ln tf) * idf` of the terms in `known`, whose places are the slots."""
    found = _plain_weights(counts, known, idf)
    length = np.sqrt(np.bincount(found.document, found.weight**2, minlength=counts.size))
    return replace(found, weight=found.weight / length[found.document])


def weigh_shared(shared: Shared, known: pa.Array, idf: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Of the pieces, the weights before they are scaled, and by how much each document scales its own."""
    found, size = _plain_weights(shared.counts, known, idf), len(shared.base)
    squares = np.bincount(found.document, found.weight**2, minlength=shared.counts.size)
    squares = squares[:size] + np.where(shared.base >= 0, np.append(squares, 0.0)[shared.base], 0.0)
    return found, 1.0 / np.sqrt(np.where(squares > 0, squares, 1.0))
