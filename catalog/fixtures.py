"""Input tables of the jobs, projected from the test tables by plain arithmetic.

`catalog.sql` states the same projections for DuckDB. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.contract import INVALID_LABEL, NO_CATEGORY, TASK_LABELS
from frameloom.operators.applications import (
    eligible_applications,
    unlabeled_applications,
    with_key_occurrence,
    with_merge_key,
)
from frameloom.session import settle

CATEGORIES = ["China_Media", "China_Diplomats", "RF_Media", "RF_Diplomats", "China_Other", "US_Media"]
FRAMES = {
    "aut": (6, [*TASK_LABELS["AUT"], NO_CATEGORY, INVALID_LABEL]),
    "dem": (7, [*TASK_LABELS["DEM"], NO_CATEGORY, None]),
    "west": (5, [*TASK_LABELS["WEST"], NO_CATEGORY]),
}
FOCAL_ACTORS = ["None", "Other", "china", "russia;usa", "eu"]
FOCALS = [
    "China",
    "Russia;USA",
    "U.S.A. (Gov);China",
    "None",
    " ",
    "G-7;G7+",
    "Côte d'Ivoire",
    "Atlantis",
    "Nobody",
    "Russia",
    "china ; CHINA",
    "EU;Atlantis;Russia",
]
MAP_ENTRIES = [
    ("China", "china", "90"),
    ("Russia", "russia", "80"),
    ("USA", "usa", "70"),
    ("U.S.A.", "usa", "5"),
    ("u s a", "america", "2"),
    ("G-7", "g7", "6"),
    ("G7", "group of seven", "3"),
    ("G7+", "g7", "bad"),
    ("Cote d'Ivoire", "ivory coast", "4"),
    ("EU", "eu", "9"),
    ("Nobody", "none", "1"),
    ("(x)", "x", "1"),
]
FIRST_WORD = "\\p{L}+"


def pick(number: Column, values: list) -> Column:
    """The value at position `number` modulo the list length."""
    return F.get(F.array(*[F.lit(value) for value in values]), (number % len(values)).cast("int"))


def div(by: int, column: str = "doc_id") -> Column:
    return F.floor(F.col(column) / by).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def frame(task: str) -> Column:
    by, labels = FRAMES[task]
    return pick(div(by), labels)


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 without keys."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("post_id"),
        F.col("lang").alias("source"),
        pick(F.col("doc_id"), CATEGORIES).alias("category"),
        F.lit("").alias("link"),
        F.lit("").alias("standardized_date"),
        "text",
        (F.lit(2018) + F.col("doc_id") % 9).cast("int").alias("post_year"),
        (F.lit(1) + F.col("doc_id") % 12).cast("int").alias("post_month"),
        pick(div(2), FOCAL_ACTORS).alias("focal_actor"),
        frame("aut").alias("aut_frame"),
        frame("dem").alias("dem_frame"),
        frame("west").alias("west_frame"),
        focal_list().alias("focal"),
    )


_corpora: dict[tuple[str, str], DataFrame] = {}


def keyed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_key_occurrence(with_merge_key(raw_posts(spark, sf_dir)), ["post_id"])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed corpus as a table, written once per session. The jobs start from
    a clean corpus on disk; only the key operators start from raw posts."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _corpora:
        _corpora[place] = settle(keyed_posts(spark, sf_dir), "corpus")
    return _corpora[place]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the clean corpus."""
    return corpus(spark, sf_dir).drop("focal")


def focal_list() -> Column:
    first_word = F.regexp_extract(F.col("text"), FIRST_WORD, 0)
    written = F.concat_ws(";", first_word, F.col("source"))
    which = div(3) % (len(FOCALS) + 1)
    return F.when(which == len(FOCALS), written).otherwise(pick(which, FOCALS))


def focal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys and the raw actor list of every post."""
    return corpus(spark, sf_dir).select("merge_key", "key_occurrence", "focal")


def focal_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 without keys, for the operators that count names."""
    return documents(spark, sf_dir).select(focal_list().alias("focal"))


def map_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a log of mapping decisions, one per document."""
    which = div(2) % (len(MAP_ENTRIES) + 1)
    other = which == len(MAP_ENTRIES)
    labels, targets, counts = (list(part) for part in zip(*MAP_ENTRIES))
    undecided = (F.col("doc_id") % 11 == 0) & ~other
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("seq"),
        F.when(other, F.col("source")).otherwise(pick(which, labels)).alias("label"),
        F.when(other, F.concat(F.lit("Outlet "), F.col("source")))
        .when(undecided, F.lit("Undecided"))
        .otherwise(pick(which, targets))
        .alias("canonical"),
        F.when(other, (F.col("n_chars") % 97).cast("string")).otherwise(pick(which, counts)).alias("occurrences"),
    )


def labeled(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """labeled posts for profiling."""
    aut = (
        F.when(F.col("doc_id") % 10 == 3, "")
        .when(F.col("doc_id") % 10 == 7, " no categories ")
        .otherwise(frame("aut"))
    )
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("post_id"),
        aut.alias(f"{prefix}aut"),
        F.coalesce(frame("dem"), F.lit("NaN")).alias(f"{prefix}dem"),
        frame("west").alias(f"{prefix}west"),
        focal_list().alias(f"{prefix}focal"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audited truth beside predictions."""
    doc = F.col("post_id")
    truth = F.when(doc % 4 < 2, frame_of("aut")).when(doc % 4 == 2, frame_of("dem")).otherwise(frame_of("west"))
    predicted = {
        f"TEST_{name}": F.when(doc % 7 != 0, F.col(name)).otherwise("") for name in ("aut", "dem", "west", "focal")
    }
    return (
        labeled(spark, sf_dir)
        .withColumns(
            {
                "sample_from": pick(doc, ["aut", "AUT_LABEL", "dem", " west "]),
                "label_value": F.coalesce(truth, F.lit("")),
                "Label_value Correct?": F.when(doc % 5 == 0, "N").otherwise(" y "),
                "Focal Country Correct?": F.when(doc % 3 == 0, "Y").otherwise(""),
                **predicted,
            }
        )
        .drop("post_id")
    )


def frame_of(task: str) -> Column:
    by, labels = FRAMES[task]
    return pick(div(by, "post_id"), labels)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw model replies in every shape the parser knows."""
    number = F.col("conv_id") * 10 + F.col("turn")
    label = pick(number, list(TASK_LABELS["DEM"]))
    reply = (
        F.when(number % 7 == 0, label)
        .when(number % 7 == 1, F.concat(F.lit('["'), label, F.lit('", "x"]')))
        .when(number % 7 == 2, F.concat(F.lit("Answer: ["), label, F.lit(", other]")))
        .when(number % 7 == 3, F.concat(F.lit('"'), label, F.lit('"')))
        .when(number % 7 == 4, F.regexp_replace(F.upper(label), " ", "  "))
        .when(number % 7 == 5, F.lit("No Categories."))
        .otherwise(F.lit("unknown"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"), "text")


def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited stance per post."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    stance = (
        F.when(F.col("doc_id") % 11 == 0, "Not Applicable")
        .when(good & ~toxic, "Pro")
        .when(~good & ~toxic, "Neutral")
        .otherwise("Anti")
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"), stance.alias("focal_valence"))


def valence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labeled applications for training."""
    return eligible_applications(posts(spark, sf_dir)).join(truth_labels(spark, sf_dir), "post_id")


def unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications outside F7."""
    return unlabeled_applications(
        eligible_applications(posts(spark, sf_dir)), valence_labels(spark, sf_dir)
    )


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: predictions of two models on five folds."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("post_id"), "n_chars")
    guess = F.when(F.col("model") == "m0", "Pro").otherwise(pick(F.col("n_chars"), ["Pro", "Anti", "Neutral"]))
    return (
        rows.join(truth_labels(spark, sf_dir), "post_id")
        .withColumn("model", F.explode(F.array(F.lit("m0"), F.lit("m1"))))
        .select(
            F.lit("focal_valence").alias("target"),
            "model",
            (F.col("post_id") % 5).alias("fold"),
            F.col("focal_valence").alias("y_true"),
            guess.alias("y_pred"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with a class, a group of two rows and two structured columns,
    one of which has a value seen in a single fold."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        F.concat(F.lit("class "), F.col("label").cast("string")).alias("topic"),
        div(2, "vec_id").cast("string").alias("group_id"),
        pick(vec, ["China", "Russia", "Russia", "China"]).alias("source_country"),
        F.when(div(2, "vec_id") % 40 == 0, "rare")
        .otherwise(pick(vec, ["eu", "usa", "china", "None", "russia", "Other"]))
        .alias("focal_actor"),
    )
