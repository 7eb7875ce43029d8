"""Features, folds, metrics and models on small data."""

import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from frameloom.functions.text import WHITE_SPACE
from frameloom.operators import features, fitting, folds, metrics, models, terms
from frameloom.session import settle

TEXTS = ["The cat sat. The cat!", "a cat and the dog_1", "Öl und Cat", "", "x"]


def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, model_text string").coalesce(1)


def word_rule(text):
    words = re.findall(r"(?u)\b\w\w+\b", text.lower())
    return Counter(words + [" ".join(pair) for pair in zip(words, words[1:])])


def char_rule(text):
    counts = Counter()
    for word in text.lower().split():
        padded = f" {word} "
        for size in (3, 4, 5):
            for start in range(len(padded) - size + 1):
                counts[padded[start : start + size]] += 1
    return counts


def tfidf_rule(counts):
    seen = Counter(term for count in counts for term in count)
    kept = {term for term, n in seen.items() if n >= 2}
    weights = {}
    for number, count in enumerate(counts):
        row = {
            term: (1 + math.log(tf)) * (math.log((1 + len(counts)) / (1 + seen[term])) + 1)
            for term, tf in count.items()
            if term in kept
        }
        length = math.sqrt(sum(value * value for value in row.values()))
        weights.update({(number, term): value / length for term, value in row.items()})
    return weights


@pytest.mark.parametrize("analyzer, rule", [("word", word_rule), ("char", char_rule)])
def test_tfidf(spark, analyzer, rule):
    got = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(documents(spark), ["id"], analyzer=analyzer).collect()}
    assert got == pytest.approx(tfidf_rule([rule(text) for text in TEXTS]))


@pytest.mark.parametrize("analyzer, rule", [("word", word_rule), ("char", char_rule)])
def test_totals_are_the_sums_of_the_weights(spark, analyzer, rule):
    counts = [rule(text) for text in TEXTS]
    expected = {}
    for (number, term), weight in tfidf_rule(counts).items():
        seen, tf, total = expected.get(term, (0, 0, 0.0))
        expected[term] = (seen + 1, tf + counts[number][term], total + weight)
    got = {r["term"]: tuple(r)[1:] for r in features.tfidf_totals(documents(spark), ["id"], analyzer=analyzer).collect()}
    assert got.keys() == expected.keys()
    assert all(got[term] == pytest.approx(expected[term]) for term in got)


def test_texts_are_split_where_their_words_are_read():
    texts = ["a b", None, "", " \t ", f"{WHITE_SPACE}öl{WHITE_SPACE}b\u200bc\x00", "x"]
    batch = pa.RecordBatch.from_pydict({"_char": pa.array(texts, pa.string()), "_word": pa.array([["q"]] * 6)})
    found = next(terms.lists(iter([batch.slice(1), batch])))
    assert found.column("_char").to_pylist() == [[], [], [], ["öl", "b\u200bc\x00"], ["x"]]
    assert found.column("_word").to_pylist() == [["q"]] * 5


@pytest.mark.parametrize("at_once", [1, 4, 100])
def test_terms_are_counted_in_parts_of_few_words(monkeypatch, at_once):
    monkeypatch.setattr(terms, "WORDS_AT_ONCE", at_once)
    lists = [["a1", "b1", "a1"], [], None, ["öl"], ["a1"] * 9, ["x" * 9, "öl", "x" * 9]]
    batch = pa.RecordBatch.from_pydict({"words": pa.array(lists, pa.list_(pa.string()))})
    for name, rule in (("word", word_rule), ("char", char_rule)):
        found, before = {}, 0
        for part in terms.slices(batch, "words"):
            counts = terms.ANALYZERS[name](part.column("words"))
            for document, term, tf in zip(counts.document, counts.term, counts.tf):
                found.setdefault(before + int(document), {})[counts.terms[int(term)].as_py()] = int(tf)
            before += part.num_rows
        assert before == len(lists)
        assert [found.get(n, {}) for n in range(before)] == [dict(rule(" ".join(words or []))) for words in lists]


SHARING = ["a1 b1 same end b1", "b1 x1 same end b1", "end b1", "end b1", "alone here", "same end b1", "", "b1 same end b1", "c1 other"]
POSTS = [0, 0, 1, 1, 2, 3, 4, 5, 5]


@pytest.mark.parametrize("analyzer, rule", [("word", word_rule), ("char", char_rule)])
def test_what_texts_of_a_post_end_with_is_counted_once(analyzer, rule):
    words = pa.array([text.split() for text in SHARING], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_pydict({"post": POSTS, "words": words})
    found = terms.shared_counts(analyzer, words, terms.groups(batch, ["post"]))
    names, size = found.counts.terms.to_pylist(), len(SHARING)
    pieces = [Counter() for _ in range(found.counts.size)]
    for piece, term, tf in zip(found.counts.document, found.counts.term, found.counts.tf):
        pieces[piece][names[term]] = tf
    assert [n >= size for n in found.base] == [True] * 4 + [False] * 5
    for text, own, base in zip(SHARING, pieces, found.base):
        shared = pieces[base] if base >= 0 else Counter()
        assert not own.keys() & shared.keys() and own + shared == rule(text)
    assert list(found.times) == [1] * size + [2, 2]
    known = pa.array(names[: len(names) // 2])
    idf = 1.0 + pc.utf8_length(known).to_numpy()
    plain, (weights, scale) = terms.weigh(terms.ANALYZERS[analyzer](words), known, idf), terms.weigh_shared(found, known, idf)
    wanted = {(d, t): w for d, t, w in zip(plain.document.tolist(), plain.slot.tolist(), plain.weight)}
    got = {
        (d, t): w * scale[d]
        for piece, t, w in zip(weights.document.tolist(), weights.slot.tolist(), weights.weight)
        for d in ([piece] if piece < size else [d for d in range(size) if found.base[d] == piece])
    }
    assert got == pytest.approx(wanted)


def test_a_post_is_held_once_in_the_blocks(spark, monkeypatch):
    body = " ".join(f"word{n}" for n in range(200))
    data = [(f"k{n}", 1, domain, ("Pro", "Anti")[n % 2], f"frame={domain} text={body} {n % 2}x") for n in range(6) for domain in ("AUT", "DEM", "WEST")]
    rows = spark.createDataFrame(
        data, "merge_key string, key_occurrence int, frame_domain string, focal_valence string, model_text string"
    )
    some, blocks = [], fitting.blocks
    monkeypatch.setattr(fitting, "blocks", lambda tables: some.append(blocks(tables)) or some[0])
    fitted = models.fit_model(rows, "tfidf_logistic_regression")
    held, whole = some[0].map(lambda block: len(block.at)).sum(), features.TfidfVectorizer.vectorize(
        fitted.vectorizer, features.split_documents(rows, settle)
    ).agg(F.sum(F.size("features.indices"))).first()[0]
    assert held < 0.5 * whole  # all of it before
    assert some[0].map(lambda block: len(block.y)).sum() == 18
    assert fitted.predict(rows).filter("predicted = focal_valence").count() == 18


def test_vectors_are_made_where_the_documents_are(spark):
    split = features.split_documents(documents(spark), settle, ["id"])
    plan = features.TfidfVectorizer.learn(split, settle).vectorize(split, ["id"])._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Aggregate" not in plan.toString()


def test_vectorizer_uses_the_training_vocabulary(spark):
    vectorizer = features.TfidfVectorizer.fit(documents(spark), settle, ["id"])
    fresh = spark.createDataFrame([(7, "the cat"), (8, "zebra")], "id int, model_text string")
    got = {r["id"]: r["features"] for r in vectorizer.transform(fresh, settle, ["id"]).collect()}
    assert got[7].size == got[8].size == vectorizer.size
    assert got[8].numNonzeros() == 0
    assert got[7].norm(2) == pytest.approx(math.sqrt(2))


def test_vocabulary_limit_keeps_the_most_frequent(spark):
    got = features.tfidf(documents(spark), ["id"], max_terms=1).select("term").distinct().collect()
    assert [r["term"] for r in got] == ["cat"]


def test_unseen_categories_are_all_zeros(spark):
    train = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "place string, embedding array<float>")
    test = spark.createDataFrame([("a", [1.0]), ("new", [3.0])], "place string, embedding array<float>")
    stages = models.feature_stages(["place"], "_v")
    ready = train.withColumn("_v", features.embedding_vector(F.col("embedding")))
    fitted = models.Pipeline(stages=stages).fit(ready)
    rows = fitted.transform(test.withColumn("_v", features.embedding_vector(F.col("embedding")))).collect()
    assert {r["place"]: list(r["_x"].toArray()) for r in rows} == {"a": [1.0, 1.0, 0.0], "new": [3.0, 0.0, 0.0]}


def test_prepared_features(spark):
    row = ["k", 1, " ", None, "AUT", " f ", "china", None]
    schema = (
        "merge_key string, key_occurrence long, source_country string, account_type string, "
        "frame_domain string, frame_subframe string, focal_actor string, text string"
    )
    got = features.prepare_features(spark.createDataFrame([row], schema)).first()
    assert got["group_id"] == "k:1"
    assert got["model_text"] == (
        "source_country=None account_type=None frame=AUT subframe=f focal_actor=china text="
    )


def test_target_guards(spark):
    df = spark.createDataFrame([("Pro",), ("Not Applicable",), ("Pro",)], "focal_valence string")
    kept = features.eligible_target(df)
    assert kept.count() == 2
    with pytest.raises(ValueError, match="two classes"):
        features.require_classes(kept)


def grouped(spark, rows=600):
    """Three classes, one with two thirds of the rows; two rows per post."""
    return spark.range(rows).select(
        F.floor(F.col("id") / 2).cast("string").alias("group_id"),
        F.when(F.col("id") % 6 < 4, "Pro").when(F.col("id") % 6 == 4, "Anti").otherwise("Neutral").alias("focal_valence"),
    )


def test_folds_keep_posts_together_and_balance_classes(spark):
    rows = settle(folds.with_folds(grouped(spark), 5, 42))
    assert rows.count() == 600
    assert folds.leaking_groups(rows).count() == 0
    sizes = folds.grouped_folds(grouped(spark), 5, 42).groupBy("label", "fold").count().collect()
    for label in {r["label"] for r in sizes}:
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    train, test = rows.filter("fold <> 1"), rows.filter("fold = 1")
    assert folds.overlapping_groups(train, test).count() == 0
    with pytest.raises(ValueError, match="more than one fold"):
        folds.require_no_leak(rows.withColumn("fold", F.monotonically_increasing_id()))
    with pytest.raises(ValueError):
        folds.grouped_folds(rows, 1, 42)


def test_metrics_count_classes_that_are_only_predicted(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), ("a", "a")]
    df = spark.createDataFrame([("t", "m", 1, *pair) for pair in pairs], "target string, model string, fold int, y_true string, y_pred string")
    table = metrics.confusion(df)
    macro = {r["metric"]: r["value"] for r in metrics.macro_metrics(table).collect()}
    # a: precision 1, recall 2/3, f1 4/5; b: 1/2, 1/2, 1/2; c: all 0
    assert macro == pytest.approx(
        {"accuracy": 3 / 5, "precision_macro": 1.5 / 3, "recall_macro": (2 / 3 + 1 / 2) / 3, "f1_macro": 1.3 / 3}
    )
    classes = {(r["label"], r["metric"]): r["value"] for r in metrics.class_metrics(table).collect()}
    assert classes == pytest.approx(
        {
            ("a", "precision"): 1.0, ("a", "recall"): 2 / 3, ("a", "f1"): 0.8,
            ("b", "precision"): 0.5, ("b", "recall"): 0.5, ("b", "f1"): 0.5,
        }
    )


def test_class_weights_are_balanced(spark):
    weights = {r["label"]: r["weight"] for r in features.class_weights(grouped(spark)).collect()}
    assert weights == pytest.approx({"Pro": 600 / (3 * 400), "Anti": 2.0, "Neutral": 2.0})


def test_models_beat_the_baseline_on_embeddings(spark, sf, tmp_path):
    rows = folds.with_folds(fx.vectors(spark, sf), 2, 42, target="topic")
    names = ["majority_baseline", "embedding_logistic_regression"]
    structured = ["source_country", "focal_actor"]
    scores = settle(models.cross_validate(rows, names, 2, "topic", structured))
    mean = {r["model"]: r["mean"] for r in metrics.metric_summary(scores).filter("metric = 'f1_macro'").collect()}
    assert mean["embedding_logistic_regression"] > mean["majority_baseline"]
    assert models.select_model(scores) == "embedding_logistic_regression"
    fitted = models.fit_model(rows, "embedding_logistic_regression", "topic", structured)
    fitted.save(str(tmp_path / "model"), spark)
    again = models.Predictor.load(str(tmp_path / "model"), spark)
    plain = rows.drop("topic")
    assert {tuple(r) for r in fitted.predict(plain).select("vec_id", "predicted").collect()} == {
        tuple(r) for r in again.predict(plain).select("vec_id", "predicted").collect()
    }


def test_tfidf_model_learns_words(spark, tmp_path):
    words = {"Pro": "friendly success trade", "Anti": "hostile crisis sanctions"}
    data = [
        (f"k{n}", 1, "AUT", label, f"{words[label]} filler{n % 3} text") for n in range(24) for label in [("Pro", "Anti")[n % 2]]
    ]
    rows = spark.createDataFrame(
        data, "merge_key string, key_occurrence int, frame_domain string, focal_valence string, model_text string"
    ).coalesce(2)
    for name in models.TFIDF_MODELS:
        fitted = models.fit_model(rows, name)
        wrong = fitted.predict(rows).filter("predicted <> focal_valence").count()
        assert wrong == 0
    fitted.save(str(tmp_path / "model"), spark)
    again = models.Predictor.load(str(tmp_path / "model"), spark)
    assert again.predict(rows.drop("focal_valence")).filter("predicted is null").count() == 0


def test_vectors_of_texts_are_not_written(spark, monkeypatch):
    words = {"Pro": "friendly success trade", "Anti": "hostile crisis sanctions", "Neutral": "report meeting visit"}
    data = [(f"k{n}", 1, "AUT", list(words)[n % 3], f"{list(words.values())[n % 3]} filler{n % 4} text") for n in range(30)]
    rows = spark.createDataFrame(
        data, "merge_key string, key_occurrence int, frame_domain string, focal_valence string, model_text string"
    )

    def transform(*_, **__):
        raise AssertionError("a table of vectors, many times as large as the texts")

    monkeypatch.setattr(features.TfidfVectorizer, "transform", transform)
    fitted = models.fit_model(rows, "tfidf_logistic_regression")
    assert fitted.predict(rows).filter("predicted = focal_valence").count() == 30


def test_grams_of_more_letters_than_a_number_holds():
    text = "".join(chr(0x4E00 + n) for n in range(7000))
    lists = [[text], ["ab", text[5:11], "ab"], [text[::-1]]]
    counts = terms.char_counts(pa.array(lists, pa.list_(pa.string())))
    found = [{} for _ in lists]
    for document, term, tf in zip(counts.document, counts.term, counts.tf):
        found[document][counts.terms[int(term)].as_py()] = int(tf)
    assert found == [dict(char_rule(" ".join(words))) for words in lists]


def test_models_predict_in_a_session_that_has_observed(spark):
    from pyspark.sql import Observation

    watch = Observation("rows")
    spark.range(3).observe(watch, F.count(F.lit(1)).alias("n")).collect()
    rows = spark.createDataFrame([([float(n % 2), 1.0], "ab"[n % 2]) for n in range(20)], "embedding array<double>, topic string")
    for name in models.EMBEDDING_MODELS[:2]:
        fitted = models.fit_model(rows, name, "topic", [])
        assert fitted.predict(rows).filter("predicted <> topic").count() == 0


def test_rest_without_actor_does_not_apply(spark):
    rows = spark.createDataFrame([(1, "china"), (2, "None"), (3, None)], "key_occurrence int, focal_actor string")
    out = models.predict_rest(rows, lambda df: df.withColumn("predicted", F.lit("Pro")))
    assert {r[0]: r["predicted_focal_valence"] for r in out.collect()} == {1: "Pro", 2: "Not Applicable", 3: "Not Applicable"}
