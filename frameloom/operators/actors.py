"""Free-text actor names: counting, canonical mapping and the per-post roll-up.

Every rule about a name is applied to distinct names. What the row-level pass
does is one lookup per mention and one aggregate per post.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.contract import NO_ACTOR, OTHER_ACTOR, POST_KEY, TOP_ACTORS, TOP_REPORTED
from frameloom.functions.names import fold_names
from frameloom.functions.posts import source_actor
from frameloom.operators.ranking import BROADCAST_BYTES, lookup_join
from frameloom.session import settle

SEPARATOR = ";"
BLANK_NAMES = ("", "none")
MAX_TOP = 100_000


def focal_items(rows: DataFrame, column: str = "focal") -> DataFrame:
    """One row per listed actor; a blank list gives one blank item."""
    parts = F.split(F.coalesce(F.col(column), F.lit("")), SEPARATOR)
    return rows.withColumn("item", F.explode(parts)).drop(column)


def folded_item_counts(rows: DataFrame, column: str = "focal") -> DataFrame:
    """Distinct raw items with their mentions and folded label."""
    mentions = focal_items(rows.select(column), column).groupBy("item").agg(
        F.count(F.lit(1)).alias("mentions")
    )
    return fold_names(mentions)


# --- actor map ---------------------------------------------------------------


def fold_actor_map(entries: DataFrame) -> DataFrame:
    """Fold label and canonical of every map entry; blank labels are dropped.

    The log grows with every decision, the names in it hardly: each is folded once.
    """
    for name in ("label", "canonical"):
        folded = fold_names(entries.select(name).distinct(), name, "_folded")
        entries = entries.join(folded, name, "left").withColumn(name, F.coalesce("_folded", F.lit(""))).drop("_folded")
    return entries.filter(F.col("label") != "")


def actor_map_clean(entries: DataFrame, order: str = "seq") -> DataFrame:
    """One canonical per folded label: the entry recorded last wins."""
    return fold_actor_map(entries).groupBy("label").agg(
        F.max_by("canonical", F.col(order)).alias("canonical")
    )


def map_targets(entries: DataFrame) -> DataFrame:
    """Total occurrences per folded label and canonical; unreadable counts are 0."""
    count = F.coalesce(F.expr("try_cast(occurrences as bigint)"), F.lit(0))
    return (
        fold_actor_map(entries)
        .filter(F.col("canonical") != "")
        .groupBy("label", "canonical")
        .agg(F.sum(count).alias("total"))
    )


def _chosen() -> Column:
    """Canonical with the largest total, the first by name among equals."""
    return F.min_by("canonical", F.struct(-F.col("total"), F.col("canonical")))


def actor_map_resolve(entries: DataFrame) -> DataFrame:
    """Settle label collisions by frequency; occurrences are summed over targets."""
    return (
        map_targets(entries)
        .groupBy("label")
        .agg(_chosen().alias("canonical"), F.sum("total").alias("occurrences"))
        .orderBy(F.desc("occurrences"), "label")
    )


def actor_map_conflicts(entries: DataFrame) -> DataFrame:
    """Labels with more than one target, their sorted targets and the winner."""
    return (
        map_targets(entries)
        .groupBy("label")
        .agg(F.sort_array(F.collect_list("canonical")).alias("targets"), _chosen().alias("chosen"))
        .filter(F.size("targets") > 1)
        .withColumn("targets", F.array_join("targets", ", "))
    )


# --- counts --------------------------------------------------------------------


def label_counts(rows: DataFrame, column: str = "focal") -> DataFrame:
    """Mentions per folded label, most frequent first; blank and none dropped."""
    return (
        folded_item_counts(rows, column)
        .filter(~F.col("label").isin(*BLANK_NAMES))
        .groupBy("label")
        .agg(F.sum("mentions").alias("mentions"))
        .orderBy(F.desc("mentions"), "label")
    )


def label_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("mentions").alias("mentions"), F.count(F.lit(1)).alias("labels"))


def pending_labels(counts: DataFrame, actor_map: DataFrame) -> DataFrame:
    """Counted labels the map does not know yet: the work list of a mapper."""
    return counts.join(actor_map.select("label"), "label", "left_anti").orderBy(F.desc("mentions"), "label")


def mapped_names(rows: DataFrame, actor_map: DataFrame, column: str = "focal") -> DataFrame:
    """Distinct raw items with mentions, folded label and canonical actor."""
    return folded_item_counts(rows, column).join(actor_map.select("label", "canonical"), "label", "left")


def _names_an_actor() -> Column:
    return ~F.col("label").isin(*BLANK_NAMES) & F.col("canonical").isNotNull() & (F.col("canonical") != "none")


def top_actors(names: DataFrame, n: int = TOP_ACTORS) -> DataFrame:
    """The most mentioned canonical actors, ties by name. They are broadcast, so `n` is limited."""
    if n > MAX_TOP:
        raise ValueError(f"At most {MAX_TOP} actors can be kept.")
    return (
        names.filter(_names_an_actor())
        .groupBy("canonical")
        .agg(F.sum("mentions").alias("mentions"))
        .orderBy(F.desc("mentions"), "canonical")
        .limit(n)
    )


def canonical_counts(names: DataFrame, n: int = TOP_REPORTED, catch_all: str = OTHER_ACTOR) -> DataFrame:
    """Slots per top actor; everything else, blanks included, in one catch-all."""
    top = F.broadcast(top_actors(names, n).select("canonical", F.lit(True).alias("_top")))
    slots = names.withColumn("canonical", F.when(_names_an_actor(), F.col("canonical"))).groupBy("canonical").agg(
        F.sum("mentions").alias("slots")
    )
    shown = F.when(F.col("_top"), F.col("canonical")).otherwise(F.lit(catch_all))
    return (
        slots.join(top, "canonical", "left")
        .groupBy(shown.alias("actor"))
        .agg(F.sum("slots").alias("slots"))
        .orderBy(F.desc("slots"), "actor")
    )


def slot_totals(counts: DataFrame, catch_all: str = OTHER_ACTOR) -> DataFrame:
    """Slots covered by the top actors, and slots left to the catch-all."""
    rest = F.col("actor") == catch_all
    return counts.agg(
        F.coalesce(F.sum(F.when(~rest, F.col("slots"))), F.lit(0)).alias("top_slots"),
        F.coalesce(F.sum(F.when(rest, F.col("slots"))), F.lit(0)).alias("other_slots"),
    )


# --- items and posts -------------------------------------------------------------


def mapped_focal_items(
    rows: DataFrame, actor_map: DataFrame, column: str = "focal", max_broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every mention with its folded label and canonical actor (null if unmapped)."""
    names = settle(mapped_names(rows, actor_map, column), "names")
    return lookup_join(focal_items(rows, column), names, "item", max_broadcast_bytes)


def name_components(names: DataFrame, n: int = TOP_ACTORS) -> DataFrame:
    """What each distinct item counts as: an actor, `Other` or `None`."""
    top = F.broadcast(top_actors(names, n).select("canonical", F.lit(True).alias("_top")))
    component = (
        F.when(F.col("label").isin(*BLANK_NAMES) | (F.col("canonical") == "none"), NO_ACTOR)
        .when(F.col("_top"), F.col("canonical"))
        .otherwise(OTHER_ACTOR)
    )
    return names.join(top, "canonical", "left").select("item", "mentions", component.alias("focal_component"))


def clean_focal_items(
    rows: DataFrame,
    actor_map: DataFrame,
    n: int = TOP_ACTORS,
    column: str = "focal",
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every mention with its component. The names are folded, mapped, ranked and
    classified once each; the mentions themselves see a single lookup."""
    names = settle(mapped_names(rows, actor_map, column), "names")
    components = settle(name_components(names, n), "components")
    return lookup_join(focal_items(rows, column), components, "item", max_broadcast_bytes).drop("item")


def roll_up_items(items: DataFrame, key: Sequence[str] = POST_KEY) -> DataFrame:
    """Per post: its known actors, sorted and distinct, and whether others occur."""
    component = F.col("focal_component")
    known = F.when(~component.isin(NO_ACTOR, OTHER_ACTOR), component)
    return items.groupBy(*key).agg(
        F.sort_array(F.collect_set(known)).alias("known_actors"),
        F.bool_or(component == OTHER_ACTOR).alias("has_other"),
    )


def rolled_actor() -> Column:
    """One focal actor string from `category` and the rolled-up columns. An account's
    own country is left out when the post names anyone else; a post nobody labeled
    counts as `None`."""
    own = F.coalesce(source_actor(F.col("category")), F.lit(""))
    known = F.coalesce(F.col("known_actors"), F.array().cast("array<string>"))
    others = F.array_remove(known, own)
    has_other = F.coalesce(F.col("has_other"), F.lit(False))
    return (
        F.when((F.size(known) > 0) & (F.size(others) > 0), F.array_join(others, SEPARATOR))
        .when(F.array_contains(known, own) & ~has_other, own)
        .when(has_other, OTHER_ACTOR)
        .otherwise(NO_ACTOR)
    )


def focal_rollup(posts: DataFrame, items: DataFrame, key: Sequence[str] = POST_KEY) -> DataFrame:
    """The key and the focal actor of every post."""
    joined = posts.select(*key, "category").join(roll_up_items(items, key), list(key), "left")
    return joined.select(*key, rolled_actor().alias("focal_actor"))


def attach_focal(posts: DataFrame, items: DataFrame, key: Sequence[str] = POST_KEY) -> DataFrame:
    """Replace the focal columns of the corpus with ones rolled up from `items`, in one join."""
    kept = posts.drop("focal_actor", "has_focal_actor")
    joined = kept.join(roll_up_items(items, key), list(key), "left").withColumn("focal_actor", rolled_actor())
    return joined.drop("known_actors", "has_other").withColumn("has_focal_actor", F.col("focal_actor") != NO_ACTOR)


def focal_audit(posts: DataFrame) -> DataFrame:
    """Posts per focal actor, most frequent first."""
    return (
        posts.groupBy("focal_actor")
        .agg(F.count(F.lit(1)).alias("posts"))
        .orderBy(F.desc("posts"), "focal_actor")
    )
