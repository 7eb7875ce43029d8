"""Text and embedding classifiers on Spark ML: compare, select, fit, predict."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from frameloom.contract import APPLICATION_KEY, MAX_TERMS, NO_ACTOR, NOT_APPLICABLE, POST_KEY, STRUCTURED_COLUMNS, VALENCE_COLUMN
from frameloom.operators import fitting
from frameloom.operators.features import (
    Settle,
    TfidfVectorizer,
    embedding_vector,
    split_documents,
    with_class_weight,
    words_of,
)
from frameloom.operators.folds import require_no_leak
from frameloom.operators.metrics import best_model, confusion, metric_rows, metric_summary
from frameloom.session import Scratch, settle

# Training settings.
MAX_ITERATIONS = 1500
REGULARIZATION_C = 1.0
HIDDEN_LAYERS = (256, 64)
MLP_ITERATIONS = 200
SVM_ITERATIONS = 1000
TOLERANCE, MLP_TOLERANCE = 1e-4, 1e-6

BASELINE = "majority_baseline"
TFIDF_MODELS = ("tfidf_logistic_regression", "tfidf_linear_svm")
EMBEDDING_MODELS = ("embedding_logistic_regression", "embedding_linear_svm", "embedding_mlp")
MODELS = (BASELINE, *TFIDF_MODELS, *EMBEDDING_MODELS)
#: What the models read.
INPUTS = {"none": (BASELINE,), "tfidf": TFIDF_MODELS, "embedding": EMBEDDING_MODELS}
#: Classes of a target at most.
MAX_CLASSES = 1000
PREDICTED = "predicted"


def majority_class(df: DataFrame, target: str = VALENCE_COLUMN) -> Column:
    """Most frequent class, first by name among equals, as a scalar subquery."""
    counts = df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label")))).scalar()


def feature_stages(structured: Sequence[str], vector: str) -> list:
    """One-hot structured columns beside a vector column, as `features`.

    The indexer keeps a last slot for unseen values and the encoder drops that
    slot, so that an unseen value is all zeros. A vector alone stays as it is: an
    assembler would write a name for each of its slots into the schema.
    """
    if not structured:
        return [SQLTransformer(statement=f"select *, {vector} as _x from __THIS__")]
    indexed = [f"_i_{name}" for name in structured]
    slots = [f"_s_{name}" for name in structured]
    return [
        StringIndexer(
            inputCols=list(structured), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=slots, dropLast=True),
        VectorAssembler(inputCols=[vector, *slots], outputCol="_x"),
    ]


def fit_classifiers(name: str, tables: Sequence[fitting.Table], seed: int) -> list[fitting.Classifier]:
    """Fit what a model name stands for on each table, all at once, with C = 1."""
    data = fitting.blocks(tables)
    limit = MLP_ITERATIONS if name.endswith("mlp") else SVM_ITERATIONS if name.endswith("linear_svm") else MAX_ITERATIONS
    try:
        if name.endswith("mlp"):
            found = fitting.perceptron(data, tables, HIDDEN_LAYERS, limit, MLP_TOLERANCE, seed)
        elif name.endswith("linear_svm"):
            found = fitting.support_vectors(data, tables, REGULARIZATION_C, limit, TOLERANCE)
        elif name.endswith("logistic_regression"):
            found = fitting.logistic_regression(data, tables, REGULARIZATION_C, limit, TOLERANCE)
        else:
            raise ValueError(f"Unknown model {name}")
    finally:
        data.unpersist()
    if any(fitted.iterations >= limit for fitted in found):
        warnings.warn(f"{name} stopped after {limit} iterations without converging.", stacklevel=3)
    return found


@dataclass(frozen=True)
class Predictor:
    """A fitted model: adds the predicted class to rows with the same inputs.

    The pipeline makes the classifier's inputs. Without a classifier it predicts by itself,
    as models that were saved before do.
    """

    name: str
    target: str
    constant: str | None = None
    pipeline: PipelineModel | None = None
    classifier: fitting.Classifier | None = None
    vectorizer: TfidfVectorizer | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        if self.pipeline is None:
            return df.withColumn(PREDICTED, F.lit(self.constant))
        if self.vectorizer is not None and self.classifier is not None:
            return df.drop(PREDICTED).join(settle(self.predict_documents(words_of(df)), "predicted"), list(APPLICATION_KEY))
        return self.predict_vectors(_with_vector(df, self.vectorizer, settle)).select(*df.columns, PREDICTED)

    def predict_documents(self, documents: DataFrame, key: Sequence[str] = APPLICATION_KEY) -> DataFrame:
        """`key` and the predicted class of split documents; a document's vector does not leave its task."""
        maker = self.vectorizer.maker(key, [name for name in key if name in POST_KEY])
        shared = documents.sparkSession.sparkContext.broadcast(self.classifier)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, fields in maker(batches):
                model, nothing = shared.value, np.zeros(part.num_rows)
                found = model.named(model.best_of(fitting.Block(0, model.width, nothing, nothing, **fields)))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*key, PREDICTED])

        kinds = StructType([*(documents.schema[name] for name in key), StructField(PREDICTED, StringType())])
        return self.vectorizer.needed(documents, key).mapInArrow(run, kinds)

    def predict_vectors(self, df: DataFrame) -> DataFrame:
        """As `predict`, for rows that have their vector as `_v` already."""
        if self.pipeline is None:
            return df.withColumn(PREDICTED, F.lit(self.constant))
        inputs = self.pipeline.transform(df)
        if self.classifier is None:
            return inputs
        return inputs.withColumn(PREDICTED, self.classifier.predicted(F.col("_x"), df.sparkSession))

    def save(self, path: str, spark: SparkSession) -> None:
        """Write the model as a folder: a small record, the pipeline, vocabularies."""
        terms = self.vectorizer.terms if self.vectorizer else {}
        record = {
            "name": self.name,
            "target": self.target,
            "constant": self.constant,
            "pipeline": self.pipeline is not None,
            "classes": list(self.classifier.classes) if self.classifier else None,
            "terms": list(terms),
            "size": self.vectorizer.size if self.vectorizer else 0,
        }
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")
        if self.classifier is not None:
            self.classifier.save(f"{path}/weights", spark)
        for analyzer, table in terms.items():
            table.write.mode("overwrite").parquet(f"{path}/terms-{analyzer}")
        line = spark.createDataFrame([(json.dumps(record),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/record")

    @staticmethod
    def load(path: str, spark: SparkSession) -> Predictor:
        record = json.loads(spark.read.text(f"{path}/record").first()["value"])
        terms = {name: spark.read.parquet(f"{path}/terms-{name}") for name in record["terms"]}
        classes = record.get("classes")
        return Predictor(
            record["name"],
            record["target"],
            constant=record["constant"],
            pipeline=PipelineModel.load(f"{path}/pipeline") if record["pipeline"] else None,
            classifier=fitting.Classifier.load(f"{path}/weights", classes, spark) if classes else None,
            vectorizer=TfidfVectorizer(terms, record["size"]) if terms else None,
        )


def _with_vector(df: DataFrame, vectorizer: TfidfVectorizer | None, settle: Settle) -> DataFrame:
    if vectorizer is None:
        return df.withColumn("_v", embedding_vector(F.col("embedding")))
    return vectorizer.transform(df, settle, target="_v")


def class_list(df: DataFrame, target: str = VALENCE_COLUMN) -> list[str]:
    """The classes in order; they become the label index, so they must be few."""
    found = [row[0] for row in df.select(target).distinct().orderBy(target).limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"Target {target} has more than {MAX_CLASSES} classes.")
    return found


def fit_model(
    train: DataFrame,
    name: str,
    target: str = VALENCE_COLUMN,
    structured: Sequence[str] = STRUCTURED_COLUMNS,
    seed: int = 42,
    max_terms: int = MAX_TERMS,
) -> Predictor:
    """Fit one model. Vocabularies, indexers and class weights see `train` alone."""
    if name == BASELINE:
        return fit_vectors(train, name, target, structured, seed)
    with Scratch(train.sparkSession, "fit") as scratch:
        if name not in TFIDF_MODELS:
            return fit_vectors(_with_vector(train, None, scratch), name, target, structured, seed)
        documents = split_documents(train, scratch, carry=[target])
        vectorizer = TfidfVectorizer.learn(documents, settle, max_terms)
        return fit_documents(documents, name, target, seed, vectorizer)


def fit_documents(documents: DataFrame, name: str, target: str, seed: int, vectorizer: TfidfVectorizer) -> Predictor:
    """Fit one model on split documents that carry their class; their vectors are made where the
    blocks of the fit are, and nowhere else."""
    weighted, columns = with_class_weight(documents, target), [target, "class_weight"]
    table = fitting.Table(
        vectorizer.needed(weighted, [*columns, *POST_KEY]),
        documents.count(),
        vectorizer.size,
        tuple(class_list(documents, target)),
        dense=False,
        kind=np.float32,
        maker=vectorizer.maker(columns, POST_KEY),
        group=POST_KEY,
    )
    pipeline = PipelineModel(feature_stages([], "_v"))
    found = fit_classifiers(name, [table], seed)[0]
    return Predictor(name, target, pipeline=pipeline, classifier=found, vectorizer=vectorizer)


def fit_vectors(
    train: DataFrame,
    name: str,
    target: str = VALENCE_COLUMN,
    structured: Sequence[str] = STRUCTURED_COLUMNS,
    seed: int = 42,
    vectorizer: TfidfVectorizer | None = None,
) -> Predictor:
    """Fit one model on rows that have their vector as `_v`."""
    return fit_together([train], name, target, structured, seed, [vectorizer])[0]


def fit_together(
    trains: Sequence[DataFrame],
    name: str,
    target: str,
    structured: Sequence[str],
    seed: int,
    vectorizers: Sequence[TfidfVectorizer | None],
) -> list[Predictor]:
    """As `fit_vectors`, for several training sets whose fits share their passes."""
    if name == BASELINE:
        return [Predictor(name, target, constant=train.select(majority_class(train, target)).first()[0]) for train in trains]
    extra, deep = [] if name in TFIDF_MODELS else structured, name.endswith("mlp")
    with Scratch(trains[0].sparkSession, "train") as scratch, ThreadPoolExecutor(len(trains)) as pool:

        def table(train: DataFrame) -> tuple[PipelineModel, fitting.Table]:
            classes = class_list(train, target)
            weighted = with_class_weight(train.select(target, "_v", *extra), target)
            ready = scratch(weighted, "train")
            prepared = Pipeline(stages=feature_stages(extra, "_v")).fit(ready)
            inputs = prepared.transform(ready).select("_x", target, F.lit(1.0) if deep else F.col("class_weight"))
            width = inputs.first()["_x"].size
            dense = deep or width <= fitting.DENSE_WIDTH
            kind = np.float32 if deep else np.float64  # embeddings are 32-bit numbers themselves
            return prepared, fitting.Table(inputs, ready.count(), width, tuple(classes), dense, kind)

        pipelines, tables = zip(*pool.map(table, trains))
        found = fit_classifiers(name, tables, seed)
    return [
        Predictor(name, target, pipeline=pipeline, classifier=classifier, vectorizer=vectorizer)
        for pipeline, classifier, vectorizer in zip(pipelines, found, vectorizers)
    ]


def cross_validate(
    df: DataFrame,
    models: Sequence[str],
    folds: int,
    target: str = VALENCE_COLUMN,
    structured: Sequence[str] = STRUCTURED_COLUMNS,
    seed: int = 42,
    max_terms: int = MAX_TERMS,
    parallelism: int = 5,
) -> DataFrame:
    """Metrics of every model on every held-out fold, `parallelism` folds at a time, whose fits
    share their passes over the rows.

    `df` carries a `fold` column. Documents are split into words once; in each fold both TF-IDF
    models share one vocabulary, learned from its training rows, and one table of
    vectors. What a fold leaves behind is its confusion counts, a table of classes
    squared.
    """
    by_input = {kind: [n for n in models if n in names] for kind, names in INPUTS.items()}
    with Scratch(df.sparkSession, "folds") as every:
        data = every(require_no_leak(df), "folds")
        documents = split_documents(data, every, carry=["fold"]) if by_input["tfidf"] else None

        def run(some: Sequence[int], kind: str, pool: ThreadPoolExecutor) -> list[DataFrame]:
            """The confusion of some folds and the models that read one kind of input."""
            learns = [F.col("fold") != fold for fold in some]
            with Scratch(df.sparkSession, f"fold-{some[0]}") as scratch:

                def inputs(learns: Column) -> DataFrame:
                    if kind == "tfidf":
                        learned = TfidfVectorizer.learn(documents.filter(learns), scratch, max_terms)
                        return learned.transform(data.drop("text", "model_text"), scratch, target="_v", documents=documents)
                    return _with_vector(data, None, scratch) if kind == "embedding" else data

                def scored(name: str, fold: int, rows: DataFrame, fitted: Predictor) -> DataFrame:
                    rows = fitted.predict_vectors(rows).select(
                        F.lit(target).alias("target"),
                        F.lit(name).alias("model"),
                        F.lit(fold).alias("fold"),
                        F.col(target).cast("string").alias("y_true"),
                        F.col(PREDICTED).alias("y_pred"),
                    )
                    return settle(confusion(rows), "confusion")

                ready, tables = list(pool.map(inputs, learns)), []
                for name in by_input[kind]:
                    trains = [rows.filter(by) for rows, by in zip(ready, learns)]
                    fitted = fit_together(trains, name, target, structured, seed, [None] * len(some))
                    held = [rows.filter(~by) for rows, by in zip(ready, learns)]
                    tables += pool.map(scored, [name] * len(some), some, held, fitted)
            return tables

        with ThreadPoolExecutor(parallelism) as pool:
            tables = []
            for first in range(1, folds + 1, parallelism):
                some = range(first, min(first + parallelism, folds + 1))
                tables += [table for kind, names in by_input.items() if names for table in run(some, kind, pool)]
    return metric_rows(reduce(DataFrame.unionByName, tables))


def select_model(metrics: DataFrame) -> str:
    return best_model(metric_summary(metrics)).first()["model"]


def predict_rest(
    applications: DataFrame, predict: Callable[[DataFrame], DataFrame], target: str = VALENCE_COLUMN
) -> DataFrame:
    """Predict applications that name a focal actor; the others do not apply."""
    columns = [
        name
        for name in (
            "merge_key",
            "key_occurrence",
            "source",
            "category",
            "post_date",
            "post_year",
            "post_month",
            "source_country",
            "account_type",
            "frame_domain",
            "frame_subframe",
            "focal_actor",
        )
        if name in applications.columns
    ]
    # The test is null where the actor is null; such rows do not apply either.
    names_actor = F.coalesce(F.col("focal_actor") != NO_ACTOR, F.lit(False))
    scored = predict(applications.filter(names_actor)).select(*columns, F.col(PREDICTED).alias(f"predicted_{target}"))
    rest = applications.filter(~names_actor).select(*columns, F.lit(NOT_APPLICABLE).alias(f"predicted_{target}"))
    return scored.unionByName(rest)


def selected_models_record(selected: dict[str, str]) -> str:
    return json.dumps(selected, indent=2)
