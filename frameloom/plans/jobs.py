"""The five jobs, from files to files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.contract import POST_KEY, TOP_ACTORS, VALENCE_COLUMN
from frameloom.operators import actors, applications, audit, features, folds, labeling, metrics, models, profiling
from frameloom.operators import sampling
from frameloom.operators.labeling import Labeler
from frameloom.session import settle
from frameloom.sinks import files
from frameloom.sources import csv as sources
from frameloom.sources.corpus import read_corpus


def label_csv(
    spark: SparkSession,
    path: str,
    out: str,
    labeler: Labeler,
    tasks: Sequence[str] | None = None,
    focal: bool = False,
    text: str = "text",
    prefix: str = "",
    key: Sequence[str] = POST_KEY,
    limit: int | None = None,
    random_sample: bool = False,
    seed: int = 42,
    parallelism: int | None = None,
) -> DataFrame:
    """Job 1: label the posts of a CSV, continuing after what `out` already holds.

    Posts are told apart by content key and occurrence, so a restart asks only for
    posts without a complete row, whatever order the files come in. A restart writes
    the output anew beside the old one and swaps them: one row per post.
    """
    chosen = labeling.parse_tasks(tasks)
    if limit is not None and limit <= 0:
        raise ValueError("limit must be greater than 0")
    if random_sample and limit is None:
        raise ValueError("random_sample needs a limit")
    posts = sources.read_posts_csv(spark, path)
    sources.require_columns(posts, [text])
    keyed = _keyed(posts, text)
    if limit is not None:
        keyed = sampling.random_n(keyed, key, limit, seed) if random_sample else sampling.first_n(keyed, key, limit)
    labels = labeling.label_columns(chosen, focal, prefix)
    columns = labeling.output_columns(keyed.columns, labels)
    todo, kept = keyed, None
    if files.exists(spark, out):
        before = labeled_rows(spark, out, key, chosen, focal, prefix)
        todo = labeling.unfinished(keyed, before, key, chosen, focal, prefix)
        kept = before.join(todo.select(*key), list(key), "left_anti")
    if parallelism:
        todo = todo.repartition(parallelism)
    labeled = labeling.label_posts(todo, chosen, labeler, focal, text, prefix).select(*columns)
    if kept is None:
        files.write_labeled_csv(labeled, out)
    else:
        # A post that failed before gets its new row in place of the old one.
        files.require_header(labeled, out)
        files.replace_labeled_csv(kept.select(*columns).unionByName(labeled), out)
    return sources.read_strict_csv(spark, out)


def _keyed(posts: DataFrame, text: str) -> DataFrame:
    """Add the post key; columns the file does not have count as blank."""
    missing = [name for name in ("source", "link", "standardized_date") if name not in posts.columns]
    order = [name for name in posts.columns]
    filled = posts.withColumns({name: F.lit("") for name in missing})
    if text != "text":
        filled = filled.withColumn("text", F.col(text))
    keyed = applications.with_key_occurrence(applications.with_merge_key(filled), order)
    return keyed.select(*POST_KEY, *[f"`{name}`" for name in posts.columns]).withColumn(
        "key_occurrence", F.col("key_occurrence").cast("string")
    )


def labeled_rows(
    spark: SparkSession, out: str, key: Sequence[str], tasks: Sequence[str], focal: bool = False, prefix: str = ""
) -> DataFrame:
    """The output with one row per post: a complete row goes before failed ones, and
    among equals the largest in column order."""
    rows = sources.read_strict_csv(spark, out)
    missing = [name for name in labeling.label_columns(tasks, focal, prefix) if name not in rows.columns]
    if missing:
        raise ValueError(f"The existing output lacks {', '.join(missing)}; choose another output.")
    whole = F.struct(*[f"`{name}`" for name in rows.columns])
    best = F.max(F.struct(labeling.is_complete(tasks, focal, prefix).alias("done"), whole.alias("row")))
    return rows.groupBy(*key).agg(best.alias("_best")).select("_best.row.*")


def rebuild_corpus(
    spark: SparkSession,
    corpus: str,
    focal_csv: str,
    actor_map: str,
    out: str,
    audit_folder: str | None = None,
    top: int = TOP_ACTORS,
    overwrite: bool = False,
) -> DataFrame:
    """Job 2: attach canonical focal actors to the corpus and swap it in."""
    if top < 1:
        raise ValueError("top must be at least 1")
    if files.exists(spark, out) and not overwrite:
        raise FileExistsError(f"Refusing to replace {out}; pass overwrite=True.")
    posts = read_corpus(spark, corpus)
    labels = sources.read_focal_csv(spark, focal_csv)
    known = [name for name in applications.BASE_COLUMNS if name in labels.columns]
    # The label is the last order column: equal posts with different labels stay in step.
    keyed = settle(
        applications.with_key_occurrence(applications.with_merge_key(labels), [*known, "focal"]).select(
            *POST_KEY, "focal"
        ),
        "focal",
    )
    cleaned = actors.actor_map_clean(sources.read_actor_map(spark, actor_map))
    items = actors.clean_focal_items(keyed, cleaned, top)
    rebuilt = files.rebuild_parquet(actors.attach_focal(posts, items), out, overwrite)
    if audit_folder:
        files.write_summaries({"canonical_focal_audit": actors.focal_audit(rebuilt)}, audit_folder)
    return rebuilt


def sample_valence(
    spark: SparkSession,
    corpus: str,
    out: str,
    labeler: Labeler | None,
    size: int = 12,
    seed: int = 42,
) -> DataFrame:
    """Job 3: draw the stratified sample and, given a labeler, label its valence."""
    if size <= 0:
        raise ValueError("size must be greater than 0")
    pairs = applications.eligible_applications(read_corpus(spark, corpus))
    sample = settle(sampling.stratified_sample(pairs, size, seed), "sample")
    sampling.require_rows(sample)
    rows = sample if labeler is None else settle(labeling.label_valence(sample, labeler), "valence")
    files.write_labeled_csv(rows, out)
    return rows


def full_valence(
    spark: SparkSession, corpus: str, out: str, labeler: Labeler, limit: int | None = None
) -> DataFrame:
    """Job 3, whole corpus: one label per eligible post, continuing after `out`."""
    posts = read_corpus(spark, corpus)
    applications.require_none_posts(posts)
    # Rows are told apart by key, so the corpus need not be sorted to be labeled.
    rows = applications.full_posts(posts, ordered=False)
    if limit is not None:
        if limit <= 0:
            raise ValueError("limit must be greater than 0")
        rows = sampling.first_n(rows, POST_KEY, limit).repartition(spark.sparkContext.defaultParallelism)
    if files.exists(spark, out):
        done = settle(sources.read_strict_csv(spark, out).select(*POST_KEY), "done")
        typed = done.select("merge_key", F.col("key_occurrence").cast("long").alias("key_occurrence"))
        rows = rows.join(typed, list(POST_KEY), "left_anti")
    shown = [name for name in rows.columns if name not in ("text", "frame_domain", "frame_subframe")]
    labeled = labeling.label_valence(rows, labeler).select(*shown, VALENCE_COLUMN)
    files.write_labeled_csv(labeled, out)
    return sources.read_strict_csv(spark, out)


def profile_labels(
    df: DataFrame,
    out: str | None = None,
    prefix: str = "",
    columns: Sequence[str] | None = None,
    include_no_category: bool = True,
) -> dict[str, DataFrame]:
    """Job 4: coverage, distribution and combinations of the label columns.

    The rows are read once; all tables come from the counted combinations of labels.
    """
    names = profiling.detect_label_columns(df, prefix, columns)
    n = "label_rows"
    counted = profiling.counted_labels(df, names, n)
    tables = {
        "coverage_summary": profiling.coverage(counted, names, n),
        "label_distribution": profiling.label_distribution(counted, names, n),
        "label_combinations": profiling.label_combinations(counted, names, include_no_category, n),
    }
    if out:
        files.write_summaries(tables, out)
    return tables


def score_predictions(df: DataFrame, prefix: str = "TEST_") -> dict[str, DataFrame]:
    """Job 4: accuracy against audited truth, overall and by truth label."""
    rows = audit.audit_rows(df, prefix)
    return {"accuracy": audit.accuracy(rows), "accuracy_by_label": audit.accuracy_by_truth(rows)}


@dataclass(frozen=True)
class Training:
    metrics: DataFrame
    summary: DataFrame
    predictor: models.Predictor


def train_classifier(
    labeled: DataFrame,
    out: str,
    target: str = VALENCE_COLUMN,
    names: Sequence[str] = models.EMBEDDING_MODELS,
    k: int = 5,
    seed: int = 42,
    per_stratum: int | None = None,
) -> Training:
    """Job 5: cross-validate, select by macro F1, fit on all rows, save.

    `labeled` holds prepared applications; embedding models need an `embedding`
    column. `per_stratum` draws a small trial set of that many rows per stratum and
    uses two folds.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    spark = labeled.sparkSession
    rows = features.prepare_features(labeled)
    if per_stratum:
        k = 2
        rows = sampling.per_stratum_n(rows, per_stratum, seed).drop("stratum_rank", "available")
        rows = sampling.require_full_strata(settle(rows, "trial"), per_stratum)
    rows = settle(features.require_classes(features.eligible_target(rows, target), target), "labeled")
    scores = settle(
        models.cross_validate(folds.with_folds(rows, k, seed, target), names, k, target, seed=seed), "scores"
    )
    summary = metrics.metric_summary(scores)
    best = models.select_model(scores)
    predictor = models.fit_model(rows, best, target, seed=seed)
    files.write_summaries({"cv_metrics_by_fold": scores, "cv_metrics_summary": summary}, out)
    files.write_record(spark, models.selected_models_record({target: best}), f"{out}/selected_models")
    predictor.save(f"{out}/{target}_production_model", spark)
    return Training(scores, summary, predictor)


def predict_unlabeled(
    corpus: DataFrame, labeled: DataFrame, predictor: models.Predictor, out: str
) -> None:
    """Job 5: predict all applications that are not in the labeled sample."""
    pairs = applications.eligible_applications(corpus)
    rest = features.prepare_features(applications.unlabeled_applications(pairs, labeled))
    files.write_predictions(models.predict_rest(rest, predictor.predict, predictor.target), out)
