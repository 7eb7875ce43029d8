"""Mixing sources to target weights with hash-threshold histograms.

A text's size is its number of words. Sources in code point order, null last, weigh
`weights` in turn and share the size of the whole corpus; no target exceeds `most`
times its source, and what is above is shared again by weight until none is above.

A source that needs `c` whole copies and a rest takes every document `c` times, and
the rest by threshold: each document has a place in [0, 2^60) from a digest of its
id, and those below the threshold are taken once more. The threshold is found without
sorting: sizes are summed by source and bucket of places, the bucket in which the
budget runs out is the only one that is refined, and so on down to one place. Rows that
share a place stand in the order of a digest of their text; of rows that share both, as
many as the budget holds are taken. What the budget lacks then is filled by further,
nested thresholds for the documents that are small enough for it.

Null texts have size 0, a null id counts as empty text, and a null source is a source.
Which of the rows that are equal in id and text are taken depends on their partitions,
how many does not. An empty table stays empty.
Columns that have the name of an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import ranged, small
from frameloom.session import settle

WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often.
MOST = 3
#: Bits of a place, and of the buckets of one histogram.
PLACE_BITS, BUCKET_BITS = 60, 12
#: Nested thresholds of a source; each fills what the one before left of the budget.
PASSES = 3

WORD = "[^\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """`docs` with `size`, `place`, and `tie`, the order of rows with one place."""
    digest = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    return docs.withColumns(
        {
            "size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint"),
            "place": F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("bigint"),
            "tie": F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - PLACE_BITS),
        }
    )


def numbered_sources(sizes: DataFrame, source: str) -> DataFrame:
    """Each `source` with its `source_size` and its `number` from 0 in code point order, null last."""
    totals = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    rows = ranged(totals, F.col(source).isNull(), F.col(source), name="sources")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("_range").orderBy(F.col(source).isNull(), F.col(source))
    return (
        rows.withColumn("_at", F.row_number().over(within))
        .join(F.broadcast(ranges.select("_range", "_before")), "_range")  # one row per partition
        .select(source, "source_size", (F.col("_before") + F.col("_at") - 1).alias("number"))
    )


def targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: `source_size`, `weight` and `target`."""
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), (F.col("number") % len(weights)).cast("int"))
    rows = settle(numbered_sources(sizes, source).withColumn("weight", weight).drop("number"), "weighted")
    highest = F.col("source_size") * most
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = highest <= F.col("weight") * level
        count, taken, rest = rows.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, highest)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if count == full or not rest:
            break
        full, level = count, (total - taken) / rest
    share = F.when(highest <= F.col("weight") * level, highest.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return rows.withColumn("target", F.lit(0.0) if not total else share)


def _boundary(rows: DataFrame, source: str, column: str, shift: int) -> DataFrame:
    """Per source the first bucket at which the sizes exceed `budget`, and what came `before` it.

    With them the bucket's largest `size`, and its lowest and highest `tie`.
    """
    sums = rows.groupBy(source, "budget", F.shiftright(column, shift).alias("at")).agg(
        F.sum("size").alias("sum"), F.max("size").alias("size"), F.min("tie").alias("low"), F.max("tie").alias("high")
    )
    upto = F.sum("sum").over(Window.partitionBy(source).orderBy("at"))
    before = (F.col("upto") - F.col("sum")).alias("before")
    first = F.min(F.struct("at", before, "size", "low", "high")).alias("first")
    return sums.withColumn("upto", upto).filter("upto > budget").groupBy(source, "budget").agg(first)


def _refined(rows: DataFrame, source: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Per source the value of `column` at which the budget runs out, and the rows that have it.

    The budget of these rows is what is left of it before them.
    """
    shifts = [*range(PLACE_BITS - BUCKET_BITS, PLACE_BITS - 3 * BUCKET_BITS, -BUCKET_BITS), 0]
    found = None
    for shift in shifts:
        edge = _boundary(rows, source, column, shift).select(
            F.col(source).alias("_source"),
            F.col("first.at").alias("at"),
            (F.col("budget") - F.col("first.before")).alias("rest"),
            F.col("first.size").alias("_size"),
            F.col("first.low").alias("low"),
            F.col("first.high").alias("high"),
        )
        found = settle(edge, "edges")
        inside = F.col(source).eqNullSafe(F.col("_source")) & (F.shiftright(column, shift) == F.col("at"))
        rows = rows.join(small(found), inside).select(source, "size", "place", "tie", F.col("rest").alias("budget"))
    return found, rows


def _thresholds(rows: DataFrame, source: str) -> DataFrame:
    """Per source the place and tie at which the budget runs out, as `limit` and `tie`.

    Of the rows that share both, `many` are taken, and `rest` is what the budget lacks then.
    """
    places, rows = _refined(rows, source, "place")
    limits = places.select(F.col("_source").alias(source), F.col("at").alias("limit"))
    ties = places.withColumn("at", F.col("low"))
    if not places.filter("low < high").isEmpty():
        ties, _ = _refined(rows, source, "tie")
    many = F.floor(F.col("rest") / F.col("_size")).cast("bigint")
    taken = ties.select(
        "_source", F.col("at").alias("tie"), many.alias("many"), (F.col("rest") - many * F.col("_size")).alias("rest")
    )
    return limits.join(taken, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")


def _from(n: int) -> Column:
    """Whether a row stands at the end of pass `n` or behind it."""
    return (F.col("place") > F.col(f"limit{n}")) | ((F.col("place") == F.col(f"limit{n}")) & (F.col("tie") >= F.col(f"tie{n}")))


def plan(sizes: DataFrame, source: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: `source_size`, `target`, whole `copies`, and its thresholds.

    `sizes` holds `source`, `size`, `place` and `tie` and is read several times. A document
    is taken once more if its place and tie are below `limit1` and `tie1`, or below `limit2`
    and `tie2` and its size at most `rest1`, and so on. Of those that stand at such a pair
    itself, `many1`, `many2` and so on are taken.
    """
    rows = targets(sizes, source, weights, most).withColumns(
        {"copies": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)}
    )
    zero = F.lit(0).cast("bigint")
    rest = F.floor(F.col("target") - F.col("copies") * F.col("source_size"))
    rows = settle(rows.withColumns({"limit0": zero, "tie0": zero, "many0": zero, "rest0": rest}), "targets")
    for n in range(1, PASSES + 1):
        last, budget = f"limit{n - 1}", f"rest{n - 1}"
        goal = small(rows.select(F.col(source).alias("_source"), last, F.col(f"tie{n - 1}"), F.col(budget).alias("budget")))
        open_ = F.col(source).eqNullSafe(F.col("_source")) & _from(n - 1)
        fits = F.col("size") <= F.col("budget") if n > 1 else F.lit(True)
        candidates = sizes.join(goal, open_ & fits & (F.col("size") > 0)).select(source, "size", "place", sizes["tie"], "budget")
        edges = _thresholds(candidates, source).select(
            F.col(source).alias("_source"), *[F.col(kind).alias(f"{kind}{n}") for kind in ("limit", "tie", "many", "rest")]
        )
        joined = rows.join(edges, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
        everything = F.when(F.col(budget) > 0, F.lit(1 << PLACE_BITS)).otherwise(F.col(last))
        rows = settle(
            joined.withColumns(
                {f"limit{n}": F.coalesce(f"limit{n}", everything)}
                | {f"{kind}{n}": F.coalesce(f"{kind}{n}", zero) for kind in ("many", "rest")}
                | {f"tie{n}": F.coalesce(f"tie{n}", F.when(F.col(budget) > 0, zero).otherwise(F.col(f"tie{n - 1}")))}
            ),
            "thresholds",
        )
    return rows


def mix(docs: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """Sized `docs` with `source_size`, `target`, `copies` and `taken` words."""
    goals = small(plan.withColumnRenamed(source, "_source").withColumnRenamed("copies", "_copies").drop("weight"))
    docs = docs.drop("source_size", "target", "copies", "taken", "_source", "_copies", "_more", "_edge")
    more, edge, many = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for n in range(1, PASSES + 1):
        fits = F.col("size") <= F.col(f"rest{n - 1}") if n > 1 else F.lit(True)
        more = more | (_from(n - 1) & ~_from(n) & fits)
        at = (F.col("place") == F.col(f"limit{n}")) & (F.col("tie") == F.col(f"tie{n}")) & (F.col(f"many{n}") > 0) & (F.col("size") > 0)
        edge, many = F.when(at & fits, n).otherwise(edge), F.when(at & fits, F.col(f"many{n}")).otherwise(many)
    limits = [f"{kind}{n}" for kind in ("limit", "tie", "many", "rest") for n in range(PASSES + 1)]
    rows = docs.join(goals, F.col(source).eqNullSafe(F.col("_source"))).withColumns({"_more": more, "_edge": edge, "_many": many})
    rows = rows.drop(*limits)
    if not plan.filter(" or ".join(f"many{n} > 0" for n in range(1, PASSES + 1))).isEmpty():
        rows = rows.filter("_edge is null").unionByName(_counted(rows.filter("_edge is not null"), source))
    return (
        rows.withColumn("copies", F.col("_copies") + F.col("_more").cast("int"))
        .withColumn("taken", (F.col("size") * F.col("copies")).cast("bigint"))
        .drop("_source", "_copies", "_more", "_edge", "_many")
    )


def _counted(rows: DataFrame, source: str) -> DataFrame:
    """The rows at the end of a pass, `_many` of each source and pass with `_more`.

    They are written as they lie and numbered within their partitions.
    """
    rows = settle(rows.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "edge-rows")
    before = Window.partitionBy(source, "_edge").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(source, "_edge", "_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    parts = parts.select(F.col(source).alias("_s"), F.col("_edge").alias("_e"), F.col("_part").alias("_p"), "_before")
    same = F.col(source).eqNullSafe(F.col("_s")) & (F.col("_edge") == F.col("_e")) & (F.col("_part") == F.col("_p"))
    within = Window.partitionBy(source, "_edge", "_part").orderBy("_nth")
    numbered = rows.withColumn("_at", F.row_number().over(within)).join(parts, same)
    more = F.col("_before") + F.col("_at") <= F.col("_many")
    return numbered.withColumn("_more", more).drop("_part", "_nth", "_at", "_s", "_e", "_p", "_before")


def mixed_rows(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; those without words go."""
    sizes = settle(sized(docs, text, id).select(source, "size", "place", "tie"), "sizes")
    taken = mix(sized(docs.select(F.struct(*docs.columns).alias("_row"), text, id, source), text, id), plan(sizes, source), source)
    repeated = taken.filter("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("_row.*")
