"""I-Match fingerprints with randomised lexicon subsets.

A text's terms are its distinct runs of ASCII letters, digits and other characters above
ASCII, lower-cased and hashed to `TERM_BITS` bits, so that terms hardly ever share a hash.
The lexicon holds the terms that between the shares `LEAST` and `MOST` of all documents
contain, and two documents at least: a band of inverse document frequencies. A document
keeps its terms in the lexicon, or all of them where none is in it, sorted. The first part
of its fingerprint is the hash of what it keeps. The other parts are the hashes of what it
keeps in fixed random subsets of the lexicon, the same for all documents: `FAMILIES` random
orders with a nested subset of each of `SIZES`. A subset that holds none of its terms gives
`-`. The likeness of two fingerprints is 1 if their first parts are equal, else the part of
the subsets on which they agree, leaving out those that hold terms of neither.

The lexicon has at most a document's mean number of terms / `LEAST` rows, however many
documents there are. It reaches all rows as one value, a variable of the session: lists of terms by the leading bits
of their hash, and each term is looked up in its list: no pairs of documents and terms are
shuffled but those counted within a task.

Null texts count as empty and have no terms; texts without terms share a fingerprint. Equal
texts have equal fingerprints. Texts of any length count whole. An empty table gives an
empty result. Columns that have the name of an output are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import ranged
from frameloom.session import settle

TERM_BITS = 63
#: The shares of all documents between which a term of the lexicon is held.
LEAST, MOST = 0.001, 0.1
#: Random orders of the lexicon, and of how many of 256 terms a subset of each holds one place.
FAMILIES, SIZES = 8, (64, 16, 4, 1)
#: The lexicon is cut into so many lists, as a power of two.
LIST_BITS = 14
#: ASCII characters that end a term.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The id that stands for none, behind all others.
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """The distinct hashed terms of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << TERM_BITS) - 1))))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> Column:
    """The terms of the band in lists by their leading bits, as a value."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").count()
    band = counts.filter(F.col("count").between(F.lit(max(2.0, total * least)), F.lit(total * most)))
    lists = band.groupBy(_list(F.col("term")).alias("list")).agg(F.collect_list("term").alias("terms"))
    every = docs.sparkSession.range(1 << LIST_BITS).withColumnRenamed("id", "list").join(settle(lists, "lexicon"), "list", "left")
    ordered = F.sort_array(F.collect_list(F.struct("list", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))))
    one = every.agg(ordered.alias("lists")).select("lists.terms")
    spark, name = docs.sparkSession, f"lexicon_{uuid.uuid4().hex}"
    spark.sql(f"declare variable {name} array<array<bigint>>")
    spark.sql(f"set var {name} = (select terms from {{one}})", one=one)
    return F.expr(name)


def _list(term: Column) -> Column:
    return F.shiftright(term, TERM_BITS - LIST_BITS).cast("int")


def _hash(terms: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(terms)), 16, "0"))


def fingerprinted(docs: DataFrame, lists: Column, text: str, name: str) -> DataFrame:
    """`docs` with the fingerprint of a text column as `name`."""
    all_terms = docs.withColumn("_terms", terms(F.col(text)))
    banded = all_terms.withColumn("_band", F.filter("_terms", lambda t: F.array_contains(F.get(lists, _list(t)), t)))
    kept = F.sort_array(F.when(F.size("_band") > 0, F.col("_band")).otherwise(F.col("_terms")))
    # a byte of a term's hash is its place in each order
    rows = banded.withColumn("_kept", F.transform(kept, lambda t: F.struct(t.alias("t"), F.xxhash64(t).alias("h"))))
    parts, above = [], {n: F.col("_kept") for n in range(FAMILIES)}
    for level, size in enumerate(SIZES):
        drawn = {n: F.filter(above[n], _below(n, size)) for n in range(FAMILIES)}
        rows = rows.withColumns({f"_{level}_{n}": column for n, column in drawn.items()})
        above = {n: F.col(f"_{level}_{n}") for n in range(FAMILIES)}
        parts += [F.when(F.size(above[n]) > 0, _hash(above[n]["t"]).substr(1, 6)).otherwise(F.lit("-")) for n in range(FAMILIES)]
    whole = F.concat_ws(".", _hash(F.col("_kept")["t"]), *parts)
    return rows.select(*docs.columns, F.when(F.size("_kept") > 0, whole).otherwise(F.lit("-")).alias(name))


def _below(family: int, size: int):
    return lambda x: F.shiftrightunsigned(x["h"], 8 * family).bitwiseAND(F.lit(255)) < size


def likeness(left: Column, right: Column) -> Column:
    """1 for equal fingerprints, else the part of the subsets, but those without terms on both sides, that agree."""
    pairs = F.arrays_zip(F.split(left, "\\.").alias("a"), F.split(right, "\\.").alias("b"))
    told = F.filter(F.slice(pairs, 2, FAMILIES * len(SIZES)), lambda p: (p["a"] != "-") | (p["b"] != "-"))
    agree = F.size(F.filter(told, lambda p: p["a"] == p["b"]))
    either_none = (left == "-") | (right == "-")
    return F.when(left == right, 1.0).when(either_none | (F.size(told) == 0), 0.0).otherwise(agree / F.size(told))


def followers(ids: DataFrame) -> DataFrame:
    """Each `key` with its `next` key in descending order; the first follows the last.

    Keys are distinct. They are written in ranges, and only the ranges' ends meet.
    """
    rows = ranged(ids, F.col("key"), name="keys")
    ends = rows.groupBy("_range").agg(F.max("key").alias("top"))
    before = F.lag("top").over(Window.orderBy("_range"))
    last = F.max("top").over(Window.partitionBy())
    ends = ends.select("_range", F.coalesce(before, last).alias("_before"))  # one row per partition
    lower = F.lag("key").over(Window.partitionBy("_range").orderBy("key"))
    return rows.withColumn("next", lower).join(F.broadcast(ends), "_range").select(
        *ids.columns, F.coalesce("next", "_before").alias("next")
    )


def with_next(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with `next_start` and `next_fingerprint` of the next document in descending `key`.

    `docs` holds a `fingerprint`, and neither key nor text is null. `next_start` has half
    as many characters as the longest text of the key, or all that there are. Rows of one
    key have the same next one; of several rows with the next key, the smallest start counts.
    If `docs` has these three columns only, both joins share one shuffle of it.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    ids = docs.select(F.col(key).alias("key"), half.alias("need")).groupBy("key").agg(F.max("need").alias("need"))
    asks = followers(ids).select(F.col("next").alias("_next"), F.col("key").alias("_asks"), F.col("need").alias("_need"))
    wanted = settle(asks, "followers")
    start = F.struct(F.left(text, F.col("_need")).alias("start"), "fingerprint")
    starts = docs.join(wanted, F.col(key) == F.col("_next")).select("_asks", start.alias("_start"))
    starts = starts.groupBy("_asks").agg(F.min("_start").alias("_start"))
    return docs.join(starts, F.col(key) == F.col("_asks")).withColumns(
        {"next_start": F.col("_start.start"), "next_fingerprint": F.col("_start.fingerprint")}
    ).drop("_asks", "_start")


def edited(text: Column, next_start: Column) -> Column:
    """The text whose last half is replaced by as much of the next text, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(next_start, half))


def compare_with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and their edited texts, and how alike they and the next ones are.

    A null id comes last.
    """
    key = F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("_key")
    chosen = docs.select(key, F.coalesce(text, F.lit("")).alias("text"))
    band = lexicon(chosen)
    paired = with_next(fingerprinted(chosen, band, "text", "fingerprint"), "_key")
    paired = paired.withColumn("_edited", edited(F.col("text"), F.col("next_start"))).drop("next_start")
    rows = fingerprinted(paired, band, "_edited", "edited_fingerprint")
    return rows.select(
        F.nullif("_key", F.lit(NO_ID)).alias(id),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
