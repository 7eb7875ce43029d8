"""Actor operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from frameloom.operators import actors

KEY = ["merge_key", "key_occurrence"]


def rows(spark, *focals):
    data = [(f"p{n}", 1, focal) for n, focal in enumerate(focals)]
    return spark.createDataFrame(data, "merge_key string, key_occurrence long, focal string")


def actor_map(spark, **pairs):
    return spark.createDataFrame(list(pairs.items()), "label string, canonical string")


def entries(spark, *items):
    data = [(n, *item) for n, item in enumerate(items)]
    return spark.createDataFrame(data, "seq long, label string, canonical string, occurrences string")


def test_blank_and_null_lists_give_one_blank_item(spark):
    got = actors.focal_items(rows(spark, "", None, "a;b;")).orderBy("merge_key", "item").collect()
    assert [(r["merge_key"], r["item"]) for r in got] == [("p0", ""), ("p1", ""), ("p2", ""), ("p2", "a"), ("p2", "b")]


def test_map_collisions(spark):
    log = entries(
        spark, ("G-7", "g7", "6"), ("G7", "group", "3"), ("g 7", "x", "bad"), ("G7+", "Group", "3"), ("(a)", "z", "9"), ("b", "", "1")
    )
    resolved = [tuple(r) for r in actors.actor_map_resolve(log).collect()]
    assert resolved == [("g7", "g7", 12), ("g 7", "x", 0)]
    assert [tuple(r) for r in actors.actor_map_conflicts(log).collect()] == [("g7", "g7, group", "g7")]
    assert {r["label"]: r["canonical"] for r in actors.actor_map_clean(log).collect()} == {"g7": "group", "g 7": "x", "b": ""}


def test_counts_put_the_rest_in_one_place(spark):
    posts = rows(spark, "China;china", "USA", "None", "", "Atlantis;Nobody", "EU")
    names = actors.mapped_names(posts, actor_map(spark, china="china", usa="usa", nobody="none", eu="eu"))
    assert [tuple(r) for r in actors.canonical_counts(names, 2).collect()] == [("Other", 5), ("china", 2), ("eu", 1)]
    assert tuple(actors.slot_totals(actors.canonical_counts(names, 2)).first()) == (3, 5)
    assert [tuple(r) for r in actors.top_actors(names, 2).collect()] == [("china", 2), ("eu", 1)]
    counts = actors.label_counts(posts)
    assert tuple(actors.label_totals(counts).first()) == (6, 5)
    pending = actors.pending_labels(counts, actor_map(spark, china="china", eu="eu"))
    assert [r["label"] for r in pending.collect()] == ["atlantis", "nobody", "usa"]


@pytest.mark.parametrize("max_broadcast_bytes", [1_000_000, 0])
def test_roll_up_precedence(spark, max_broadcast_bytes):
    focals = ["China", "China;USA", "USA;EU;usa", "China;Atlantis", "Atlantis", "None", "", "Nobody", "Russia;Atlantis"]
    labels = rows(spark, *focals)
    known = actor_map(spark, china="china", usa="usa", eu="eu", russia="russia", nobody="none")
    items = actors.clean_focal_items(labels, known, 10, max_broadcast_bytes=max_broadcast_bytes)
    posts = spark.createDataFrame(
        [(f"p{n}", 1, "China_Media") for n in range(10)], "merge_key string, key_occurrence long, category string"
    )
    got = {r["merge_key"]: r["focal_actor"] for r in actors.focal_rollup(posts, items).collect()}
    assert [got[f"p{n}"] for n in range(10)] == [
        "china", "usa", "eu;usa", "Other", "Other", "None", "None", "None", "russia", "None",
    ]
    other = posts.withColumn("category", F.lit("US_Media"))
    got = {r["merge_key"]: r["focal_actor"] for r in actors.focal_rollup(other, items).collect()}
    assert [got["p0"], got["p1"], got["p3"]] == ["china", "china;usa", "china"]
    attached = actors.attach_focal(posts.withColumn("focal_actor", F.lit("old")), items)
    assert attached.columns == [*KEY, "category", "focal_actor", "has_focal_actor"]
    assert attached.filter("has_focal_actor").count() == 6


def test_actors_beyond_the_top_are_other(spark):
    labels = rows(spark, "USA", "USA", "EU")
    items = actors.clean_focal_items(labels, actor_map(spark, usa="usa", eu="eu"), 1)
    assert sorted(r["focal_component"] for r in items.collect()) == ["Other", "usa", "usa"]
