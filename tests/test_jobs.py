"""The five jobs from files to files, and the restart of the streaming job."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.rules import rule_labeler
from frameloom.contract import TASK_LABELS
from frameloom.operators import features
from frameloom.operators.applications import eligible_applications
from frameloom.operators.labeling import try_shorter
from frameloom.plans import jobs
from frameloom.sources.csv import read_posts_csv, read_strict_csv
from frameloom.streaming.labeling import label_stream, stream_posts

ELECTIONS = TASK_LABELS["DEM"][1]


def flaky(log, fail=""):
    """Labels everything, fails on posts with `fail`, and logs what it was asked."""

    def start(task):
        def ask(prompt):
            post = prompt.rsplit('Post:\n"', 1)[1].rstrip('"\n')
            with open(log, "a") as lines:
                lines.write(post + "\n")
            if fail and fail in post:
                raise RuntimeError("down")
            return ELECTIONS

        return try_shorter(ask)

    return start


def test_labeling_resumes_by_key(spark, tmp_path):
    path, out, log = tmp_path / "posts.csv", str(tmp_path / "out"), str(tmp_path / "log")
    path.write_text("source,text\n" + "".join(f"s,post {n}\n" for n in range(6)))
    first = jobs.label_csv(spark, str(path), out, flaky(log, "post 4"), ["dem"])
    assert first.filter("dem = ''").count() == 1 and first.count() == 6
    # the file grows at its start; nothing that was done is asked again
    path.write_text("source,text\ns,new\n" + "".join(f"s,post {n}\n" for n in range(6)))
    open(log, "w").close()
    second = jobs.label_csv(spark, str(path), out, flaky(log), ["dem"])
    assert sorted(open(log).read().splitlines()) == ["new", "post 4"]
    assert second.count() == 7 and second.filter("dem = ''").count() == 0
    # what lies on disk has one row per post as well
    assert read_strict_csv(spark, out).select("text").distinct().count() == read_strict_csv(spark, out).count() == 7
    open(log, "w").close()
    third = jobs.label_csv(spark, str(path), out, flaky(log), ["dem"])
    assert open(log).read() == "" and third.count() == 7


def test_limits_of_the_labeling_job(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text("source,text\n" + "".join(f"s,post {n}\n" for n in range(9)))
    rows = jobs.label_csv(
        spark, str(path), str(tmp_path / "a"), flaky(str(tmp_path / "l")), ["dem"], limit=4, random_sample=True, parallelism=2
    )
    assert rows.count() == 4
    assert jobs.label_csv(spark, str(path), str(tmp_path / "b"), flaky(str(tmp_path / "l")), ["dem"], limit=3).count() == 3
    with pytest.raises(ValueError):
        jobs.label_csv(spark, str(path), str(tmp_path / "c"), flaky("x"), limit=0)
    with pytest.raises(ValueError):
        jobs.label_csv(spark, str(path), str(tmp_path / "c"), flaky("x"), random_sample=True)
    with pytest.raises(ValueError, match="Missing columns: body"):
        jobs.label_csv(spark, str(path), str(tmp_path / "c"), flaky("x"), text="body")


def test_rebuild_matches_the_operators(spark, sf, tmp_path):
    from catalog.queries import QUERIES

    corpus, focal_csv, map_csv = (str(tmp_path / name) for name in ("corpus", "focal", "map"))
    raw = fx.raw_posts(spark, sf)
    fx.posts(spark, sf).write.parquet(corpus)
    columns = ["source", "category", "link", "standardized_date", "text", "focal"]
    single = raw.withColumn("n", F.count("*").over(Window.partitionBy("source", "text")))
    # copies of a post are numbered by the raw columns; unique posts are compared
    raw.select(*columns).coalesce(1).write.option("header", True).option("escape", '"').csv(focal_csv)
    fx.map_log(spark, sf).orderBy("seq").select("label", "canonical", "occurrences").coalesce(1).write.option(
        "header", True
    ).csv(map_csv)
    out = str(tmp_path / "out")
    jobs.rebuild_corpus(spark, corpus, focal_csv, map_csv, out, str(tmp_path / "audit"), top=8)
    rebuilt = spark.read.parquet(out)
    unique = single.filter("n = 1").select("post_id")
    want = QUERIES["attach_focal"](spark, sf).join(unique, "post_id", "left_semi")
    got = rebuilt.join(unique, "post_id", "left_semi")
    pick = ["post_id", "focal_actor", "has_focal_actor"]
    assert rebuilt.count() == raw.count() and unique.count() > 100
    assert {tuple(r) for r in got.select(*pick).collect()} == {tuple(r) for r in want.select(*pick).collect()}
    with pytest.raises(FileExistsError):
        jobs.rebuild_corpus(spark, corpus, focal_csv, map_csv, out, top=8)
    # the corpus itself may be replaced when that is allowed
    jobs.rebuild_corpus(spark, out, focal_csv, map_csv, out, top=8, overwrite=True)
    assert spark.read.parquet(out).count() == raw.count()


def test_valence_jobs(spark, sf, tmp_path):
    corpus = str(tmp_path / "corpus")
    fx.posts(spark, sf).write.parquet(corpus)
    drawn = jobs.sample_valence(spark, corpus, str(tmp_path / "sample"), None, 24)
    assert drawn.count() == 24 and "focal_valence" not in drawn.columns
    labeled = jobs.sample_valence(spark, corpus, str(tmp_path / "labeled"), rule_labeler(), 24)
    assert {r[0] for r in labeled.select("focal_valence").collect()} <= {"Pro", "Anti", "Neutral"}
    with pytest.raises(ValueError):
        jobs.sample_valence(spark, corpus, str(tmp_path / "x"), None, 0)
    out = str(tmp_path / "full")
    first = jobs.full_valence(spark, corpus, out, rule_labeler(), limit=10)
    assert first.count() == 10
    every = jobs.full_valence(spark, corpus, out, rule_labeler())
    assert every.count() == every.dropDuplicates(["merge_key", "key_occurrence"]).count() > 10
    no_none = str(tmp_path / "no_none")
    fx.posts(spark, sf).withColumn("focal_actor", F.lit("china")).write.parquet(no_none)
    with pytest.raises(ValueError, match="rebuild"):
        jobs.full_valence(spark, no_none, str(tmp_path / "y"), rule_labeler())


def test_profile_and_score(spark, sf, tmp_path):
    tables = jobs.profile_labels(fx.labeled(spark, sf, "TEST_"), str(tmp_path / "out"), prefix="TEST_")
    assert tables["coverage_summary"].count() == 4
    assert (tmp_path / "out" / "label_combinations").exists()
    with pytest.raises(ValueError, match="without the prefix exist: aut, dem, west, focal"):
        jobs.profile_labels(fx.labeled(spark, sf), prefix="TEST_")
    with pytest.raises(ValueError, match="Missing columns: nope"):
        jobs.profile_labels(fx.labeled(spark, sf), columns=["aut", "nope"])
    empty = jobs.profile_labels(fx.labeled(spark, sf).limit(0))
    assert [r["nonblank_pct"] for r in empty["coverage_summary"].collect()] == [0.0] * 4
    scores = jobs.score_predictions(fx.audit(spark, sf))
    assert {r["task"] for r in scores["accuracy"].collect()} == {"aut", "dem", "west", "focal"}
    no_flag = fx.audit(spark, sf).drop("Focal Country Correct?", "TEST_west")
    assert {r["task"] for r in jobs.score_predictions(no_flag)["accuracy"].collect()} == {"aut", "dem"}
    with pytest.raises(ValueError, match="sample_from"):
        jobs.score_predictions(fx.labeled(spark, sf))


def test_train_and_predict(spark, sf, tmp_path):
    posts = fx.posts(spark, sf).withColumn(
        "embedding", F.array(*[(F.col("post_id") % n).cast("float") for n in (2, 3, 5)])
    )
    labeled = eligible_applications(posts).join(fx.truth_labels(spark, sf), "post_id")
    out = str(tmp_path / "model")
    done = jobs.train_classifier(labeled, out, names=["majority_baseline", "embedding_logistic_regression"], k=2)
    assert done.predictor.name in ("majority_baseline", "embedding_logistic_regression")
    assert (tmp_path / "model" / "selected_models").exists()
    target = str(tmp_path / "predictions")
    jobs.predict_unlabeled(posts, labeled, done.predictor, target)
    rows = spark.read.parquet(target)
    keys = ["merge_key", "key_occurrence", "frame_domain"]
    assert rows.count() + labeled.count() == eligible_applications(posts).count()
    assert rows.join(labeled, keys).count() == 0
    assert rows.filter("(focal_actor = 'None') <> (predicted_focal_valence = 'Not Applicable')").count() == 0
    with pytest.raises(ValueError, match="at least 2"):
        jobs.train_classifier(labeled, out, k=1)
    with pytest.raises(ValueError, match="fewer than 5000 rows"):
        jobs.train_classifier(labeled, out, per_stratum=5000)
    assert features.prepare_features(labeled).count() == labeled.count()


def test_stream_continues_without_loss_or_repeats(spark, tmp_path):
    inbox, out, state = (tmp_path / name for name in ("in", "out", "state"))
    inbox.mkdir()

    def run():
        posts = stream_posts(spark, str(inbox), ["id", "text"], max_files=1)
        label_stream(posts, str(out), str(state), ["DEM", "AUT"], rule_labeler(), focal=True).awaitTermination()
        return sorted(int(r["id"]) for r in spark.read.parquet(str(out)).collect())

    (inbox / "a.csv").write_text('id,text\n1,"one\nline"\n2,two\n')
    assert run() == [1, 2]
    assert run() == [1, 2]
    (inbox / "b.csv").write_text("id,text\n3,three\n")
    (inbox / "c.csv").write_text("id,text\n4,\n")
    assert run() == [1, 2, 3, 4]


def test_stream_reads_rows_like_a_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text('id,text\n1,2\n3,4,5\n6\n"7","x, ""y""\nz"\n"8","x,y",9\n')
    batch = sorted(map(tuple, read_posts_csv(spark, str(inbox)).collect()))
    query = (
        stream_posts(spark, str(inbox))
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch
    assert batch == [("1", "2"), ("6", ""), ("7", 'x, "y"\nz')]
