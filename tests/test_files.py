"""Readers and writers, with the guards around them."""

import pytest
from pyspark.sql import functions as F

from frameloom.sinks import files
from frameloom.sources import csv as sources
from frameloom.sources.corpus import read_corpus, register_views


def write(path, text, bom=False):
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    return str(path)


MESSY = (
    '"source","text","note"\n'
    '"a","say ""hi""\nto all","x"\n'
    "b,,NA\n"
    '"c","",""\n'
    "short,row\n"
    "long,row,here,extra\n"
    "longer,row,here,,\n"
    'd," spaced ",null\n'
)


def test_posts_csv_keeps_blanks_and_skips_long_rows(spark, tmp_path):
    path = write(tmp_path / "posts.csv", MESSY, bom=True)
    assert sources.csv_columns(spark, path) == ["source", "text", "note"]
    rows = [tuple(row) for row in sources.read_posts_csv(spark, path).collect()]
    assert rows == [
        ("a", 'say "hi"\nto all', "x"),
        ("b", "", "NA"),
        ("c", "", ""),
        ("short", "row", ""),
        ("d", " spaced ", "null"),
    ]


def test_column_choice_does_not_change_the_rows(spark, tmp_path):
    path = write(tmp_path / "posts.csv", MESSY)
    assert [r["source"] for r in sources.read_posts_csv(spark, path).select("source").collect()] == [
        "a", "b", "c", "short", "d",
    ]
    assert sources.read_posts_csv(spark, path).count() == 5


def test_strict_csv_stops_at_a_bad_row(spark, tmp_path):
    good = write(tmp_path / "good.csv", 'id,focal\n1,"a;b"\n2,\n')
    assert [tuple(r) for r in sources.read_focal_csv(spark, good).collect()] == [("1", "a;b"), ("2", None)]
    assert [tuple(r) for r in sources.read_strict_csv(spark, good).collect()] == [("1", "a;b"), ("2", "")]
    bad = write(tmp_path / "bad.csv", "id,focal\n1,a\n2,b,c\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_focal_csv(spark, bad).collect()
    with pytest.raises(ValueError, match="Available columns: id, other"):
        sources.read_focal_csv(spark, write(tmp_path / "no.csv", "id,other\n1,2\n"))


def test_labels_csv_types(spark, tmp_path):
    path = write(tmp_path / "labels.csv", "merge_key,key_occurrence,frame_domain\nk,1,AUT\n")
    typed = sources.read_labels_csv(spark, path, "merge_key string, key_occurrence bigint, frame_domain string")
    assert typed.first()["key_occurrence"] == 1
    assert dict(sources.read_labels_csv(spark, path).dtypes)["key_occurrence"] == "int"


def test_require_columns_names_what_exists(spark):
    with pytest.raises(ValueError, match="Missing columns: b. Available columns: a, c"):
        sources.require_columns(["a", "c"], ["a", "b"])


def test_actor_map_keeps_the_order_of_entries(spark, tmp_path):
    from frameloom.operators.actors import actor_map_clean

    path = write(tmp_path / "map.csv", "label,canonical,occurrences\nG-7,old,1\nG7,new,2\n(x),y,3\n")
    entries = sources.read_actor_map(spark, path)
    assert [tuple(r) for r in actor_map_clean(entries).collect()] == [("g7", "new")]


def test_the_last_append_to_an_actor_map_wins(spark, tmp_path):
    from frameloom.operators.actors import actor_map_clean

    kinds = "label string, canonical string, occurrences int"
    for n in range(20):
        path = str(tmp_path / f"map{n}") + "/" * (n % 2)
        if n % 3 == 0:
            spark.createDataFrame([("g7", "start", 9)], kinds).write.option("header", True).csv(path)
        for canonical in ("first", "last"):
            files.append_actor_map(spark.createDataFrame([("G-7", canonical, 1)], kinds), path)
        cleaned = actor_map_clean(sources.read_actor_map(spark, path))
        assert [tuple(row) for row in cleaned.collect()] == [("g7", "last")]


def test_labeled_csv_appends_and_refuses_another_header(spark, tmp_path):
    out = str(tmp_path / "labeled.csv")
    first = spark.createDataFrame([("1", 'a "b"\nc', "")], "id string, text string, aut string")
    files.write_labeled_csv(first, out)
    files.write_labeled_csv(first.withColumn("id", F.lit("2")), out)
    rows = sorted(tuple(r) for r in sources.read_strict_csv(spark, out).collect())
    assert rows == [("1", 'a "b"\nc', ""), ("2", 'a "b"\nc', "")]
    part = max((path.read_text() for path in (tmp_path / "labeled.csv").glob("*.csv")), key=len)
    assert part.startswith('"id","text","aut"\n') and part.endswith('""\n')
    with pytest.raises(ValueError, match="another output"):
        files.write_labeled_csv(first.withColumnRenamed("aut", "dem"), out)


def test_rebuild_swaps_only_when_allowed(spark, tmp_path):
    out = str(tmp_path / "corpus")
    files.rebuild_parquet(spark.range(3), out)
    with pytest.raises(FileExistsError):
        files.rebuild_parquet(spark.range(4), out)
    current = read_corpus(spark, out)
    assert files.rebuild_parquet(current.withColumn("id", F.col("id") * 2), out, overwrite=True).count() == 3
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 2, 4]
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}.old1").collect()) == [0, 1, 2]
    spark.range(1).write.parquet(f"{out}.staging")
    with pytest.raises(FileExistsError, match="staging"):
        files.rebuild_parquet(spark.range(1), out, overwrite=True)


def test_rebuild_takes_a_path_that_ends_in_a_slash(spark, tmp_path):
    out = f"{tmp_path}/corpus/"
    files.rebuild_parquet(spark.range(3), out)
    files.rebuild_parquet(read_corpus(spark, out).withColumn("id", F.col("id") + 1), out, overwrite=True)
    assert sorted(row["id"] for row in read_corpus(spark, out).collect()) == [1, 2, 3]
    assert sorted(path.name for path in tmp_path.iterdir()) == ["corpus", "corpus.old1"]


def test_predictions_never_overwrite(spark, tmp_path):
    out = str(tmp_path / "predictions")
    files.write_predictions(spark.range(2), out)
    assert any("zstd" in name.name for name in (tmp_path / "predictions").iterdir())
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_predictions(spark.range(2), out)


def test_actor_map_versions(spark, tmp_path):
    folder = str(tmp_path / "maps")
    table = spark.createDataFrame([("g7", "g7", 3)], "label string, canonical string, occurrences int")
    assert files.rewrite_actor_map(table, folder).endswith("/v1")
    assert files.rewrite_actor_map(table, folder).endswith("/v2")
    assert files.latest_actor_map(spark, folder).endswith("/v2")
    files.append_actor_map(table, files.latest_actor_map(spark, folder))
    assert sources.read_actor_map(spark, files.latest_actor_map(spark, folder)).count() == 2
    assert sources.read_actor_map(spark, f"{folder}/v1").count() == 1


def test_default_names():
    assert files.labeled_name(["AUT", "DEM"], True) == "labeled_aut_dem_focal.csv"
    assert files.focal_name("TEST_") == "labeled_test_focal.csv"
    assert files.sample_name(12, 42) == "focal_valence_pilot_canonical_n12_seed42.csv"
    assert files.sample_name(25, 1) == "focal_valence_sample_canonical_n25_seed1.csv"


def test_views(spark):
    register_views({"numbers": spark.range(4)})
    assert spark.sql("select sum(id) as s from numbers").first()["s"] == 6


def test_work_folder_comes_from_the_session(spark):
    from frameloom.session import settle, work_folder

    local = work_folder(spark)
    assert local == work_folder(spark)
    assert settle(spark.range(5)).count() == 5

    class Named:
        class conf:
            @staticmethod
            def get(name, default):
                return {"spark.checkpoint.dir": "hdfs://shared/"}.get(name, default)

    class Unnamed:
        class conf:
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:
            master = "yarn"

    assert work_folder(Named) == "hdfs://shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Unnamed)
