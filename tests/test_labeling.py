"""The labeling job: failures, repair, gate, resume."""

import pytest
from pyspark.sql import functions as F

from frameloom.contract import TASK_LABELS, VALENCES
from frameloom.functions.text import cut_ladder
from frameloom.operators import labeling
from frameloom.operators.labeling import TextTooLong, try_shorter

ELECTIONS, SOCIETY = TASK_LABELS["DEM"][1], TASK_LABELS["DEM"][3]
ALLIANCES = TASK_LABELS["AUT"][4]


def scripted(script, log=None):
    """A labeler whose reply is looked up by task and by a word of the post."""

    def start(task):
        def ask(prompt):
            if log:
                with open(log, "a") as lines:
                    lines.write(f"{task}\n")
            post = prompt.rsplit('Post:\n"', 1)[1] if 'Post:\n"' in prompt else prompt
            for word, reply in script.get(task, {}).items():
                if word in post:
                    if isinstance(reply, str) and reply.startswith("!"):
                        raise RuntimeError(reply[1:])
                    return reply
            return "No Category"

        return try_shorter(ask)

    return start


def posts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def labels(df, *columns):
    # Sorted here: a Spark sort would sample, and so run, the labeler once more.
    rows = sorted(df.collect(), key=lambda row: row["id"])
    return [tuple(row[column] for column in columns) for row in rows]


def test_all_tasks_and_gated_focal(spark):
    script = {
        "DEM": {"vote": ELECTIONS},
        "AUT": {"bloc": f'["{ALLIANCES}"]'},
        "FOCAL": {"vote": "China; USA", "bloc": '"Russia"'},
    }
    df = labeling.label_posts(posts(spark, "vote now", "a bloc", "nothing", None), ["AUT", "DEM"], scripted(script), focal=True)
    assert df.columns == ["id", "text", "aut", "dem", "focal"]
    assert labels(df, "aut", "dem", "focal") == [
        ("No Category", ELECTIONS, "China; USA"),
        (ALLIANCES, "No Category", "Russia"),
        ("No Category", "No Category", ""),
        ("No Category", "No Category", ""),
    ]


def test_an_answer_off_the_list_is_repaired_once(spark):
    script = {"DEM": {"vote": "Voting", "club": "???"}, "DEM:repair": {"vote": ELECTIONS.upper(), "club": "???"}}
    df = labeling.label_posts(posts(spark, "vote", "club"), ["DEM"], scripted(script))
    assert labels(df, "dem") == [(ELECTIONS,), ("",)]


def test_a_failed_row_is_blank_and_asked_no_further(spark, tmp_path):
    log = str(tmp_path / "calls")
    script = {"AUT": {"bad": "!broken"}, "DEM": {"bad": ELECTIONS, "fine": ELECTIONS}}
    rows = posts(spark, "bad", "fine").coalesce(1)
    df = labeling.label_posts(rows, ["AUT", "DEM"], scripted(script, log), focal=True, prefix="TEST_")
    assert labels(df, "TEST_aut", "TEST_dem", "TEST_focal") == [("", "", ""), ("No Category", ELECTIONS, "No Category")]
    asked = sorted(open(log).read().split())
    assert asked == ["AUT", "AUT", "DEM", "FOCAL"]


def test_each_prompt_is_asked_once_when_written(spark, tmp_path):
    log = str(tmp_path / "calls")
    rows = posts(spark, *[f"vote {n}" for n in range(20)]).repartition(3)
    script = {"DEM": {"vote": "wrong"}, "DEM:repair": {"vote": SOCIETY}}
    df = labeling.label_posts(rows, ["DEM"], scripted(script, log)).filter(F.col("dem") != "x")
    df.write.parquet(str(tmp_path / "out"))
    calls = open(log).read().split()
    assert calls.count("DEM") == 20 and calls.count("DEM:repair") == 20


def test_raise_stops_the_job(spark):
    script = {"DEM": {"bad": "!broken"}}
    df = labeling.label_posts(posts(spark, "bad"), ["DEM"], scripted(script), on_error="raise")
    with pytest.raises(Exception, match="broken"):
        df.collect()
    fine = labeling.label_posts(posts(spark, "fine"), ["DEM"], scripted(script), on_error="raise")
    assert labels(fine, "dem") == [("No Category",)]


def test_focal_only_labels_every_row_or_raises(spark):
    script = {"FOCAL": {"one": "China;USA", "two": "None", "bad": "!broken"}}
    df = labeling.label_focal(posts(spark, "one", "two"), scripted(script))
    assert labels(df, "focal") == [("China;USA",), ("None",)]
    with pytest.raises(Exception, match="broken"):
        labeling.label_focal(posts(spark, "bad"), scripted(script)).collect()


def test_shorter_texts_are_tried_when_too_long():
    asked = []

    def ask(prompt):
        asked.append(prompt)
        if len(prompt) > 5:
            raise TextTooLong(prompt)
        return "ok"

    answer = try_shorter(ask)
    assert answer([["123456789", "1234567", "1234"]]) == [("ok", 2, None)]
    assert len(asked) == 3
    reply, _, error = answer([["123456789", "1234567"]])[0]
    assert reply is None and "TextTooLong" in error

    def broken(prompt):
        asked.append(prompt)
        raise ValueError("no")

    asked.clear()
    assert try_shorter(broken)([["a", "b"]])[0][2] == "ValueError: no" and asked == ["a"]


def test_ladder_reaches_the_labeler_and_repair_keeps_the_cut(spark):
    def start(task):
        def ask(prompt):
            if len(prompt) > 1700:
                raise TextTooLong("long")
            return "wrong" if task == "DEM" else ELECTIONS

        return try_shorter(ask)

    df = labeling.label_posts(posts(spark, "word " * 2000), ["DEM"], start)
    assert labels(df, "dem") == [(ELECTIONS,)]


def test_validate_and_repair_statuses(spark):
    rows = spark.createDataFrame(
        [(0, ELECTIONS, "t"), (1, "wrong", "vote"), (2, "wrong", "club"), (3, "wrong", "bad")],
        "id int, reply string, text string",
    )
    script = {"DEM:repair": {"vote": ELECTIONS, "club": "still wrong", "bad": "!broken"}}
    df = labeling.validate_and_repair(rows, "DEM", [ELECTIONS, SOCIETY], scripted(script))
    assert labels(df, "label", "status") == [
        (ELECTIONS, "ok"),
        (ELECTIONS, "repaired"),
        (None, "invalid"),
        (None, "error"),
    ]


def test_valence_failures_become_neutral(spark):
    rows = posts(spark, "good", "bad", "odd", "sad").withColumns(
        {
            "focal_actor": F.lit("china"),
            "source_country": F.lit("China"),
            "account_type": F.lit(None).cast("string"),
        }
    )
    script = {
        "VALENCE": {"good": "positive", "bad": "!broken", "odd": "hm", "sad": "ANTI"},
        "VALENCE:repair": {"odd": "hm"},
    }
    df = labeling.label_valence(rows, scripted(script), status=True)
    assert labels(df, "focal_valence") == [("Pro",), ("Neutral",), ("Neutral",), ("Anti",)]
    assert set(VALENCES) == {"Pro", "Anti", "Neutral"}


def test_unfinished_rows_are_matched_by_key(spark):
    todo = posts(spark, "a", "b", "c", "d")
    done = spark.createDataFrame(
        [(0, ELECTIONS, "China"), (1, "", ""), (2, "No Category", ""), (3, ELECTIONS, "")], "id int, dem string, focal string"
    )
    left = labeling.unfinished(todo, done, ["id"], ["DEM"], focal=True)
    assert sorted(r["id"] for r in left.collect()) == [1, 3]
    assert [r["id"] for r in labeling.unfinished(todo, done, ["id"], ["DEM"]).collect()] == [1]
    with pytest.raises(ValueError, match="aut"):
        labeling.unfinished(todo, done, ["id"], ["AUT"])


def test_task_words():
    assert labeling.parse_tasks(None) == ["AUT", "DEM", "WEST"]
    assert labeling.parse_tasks(["dem,west", "DEM"]) == ["DEM", "WEST"]
    for bad in (["x"], [","]):
        with pytest.raises(ValueError):
            labeling.parse_tasks(bad)


def test_column_names():
    assert labeling.label_columns(["AUT", "WEST"], True, "TEST_") == ["TEST_aut", "TEST_west", "TEST_focal"]
    assert labeling.output_columns(["text", "aut"], ["aut", "dem"]) == ["text", "aut", "dem"]


def test_observed_counts(spark, tmp_path):
    df, watch = labeling.observe_labels(spark.createDataFrame([("x",), ("",)], "dem string"), ["dem"], "watch")
    df.write.parquet(str(tmp_path / "out"))
    assert watch.get == {"rows": 2, "blank_dem": 1}



def test_texts_too_long_are_shown_shorter(spark):
    rows = spark.createDataFrame([(1, "w " * 300), (2, "short"), (3, None), (4, "x" * 3000)], "id int, text string")

    def labeler(task):
        def ask(prompt):
            if len(prompt) > limit:
                raise labeling.TextTooLong("too long")
            return "yes"

        return labeling.try_shorter(ask)

    limit = len(labeling.TASK_TEMPLATES["DEM"]) + 420
    got = {r.id: (r.reply, r.shown, r.failed) for r in labeling.label_shown(rows, "DEM", labeler).collect()}
    assert got[2] == ("yes", 5, False) and got[3] == ("yes", 0, False)
    assert all(got[i][0] == "yes" and 390 < got[i][1] <= 404 for i in (1, 4))
    limit = 10
    assert {r.failed for r in labeling.label_shown(rows, "DEM", labeler).collect()} == {True}


def test_cuts_put_together_in_python_are_those_of_the_ladder(spark):
    texts = ["", "short", "word " * 700, "x" * 4000, "x" * 1600 + " y" * 700, "ö ü\n" * 900, "a  b" * 800]
    ladders = spark.createDataFrame([(t,) for t in texts], "t string").select(cut_ladder(F.col("t")).alias("c")).collect()
    for (cuts,) in ladders:
        assert list(labeling.Cuts(cuts[0], [len(cut) for cut in cuts[1:]])) == cuts
