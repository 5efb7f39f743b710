import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textyard.operators import classify, metrics, reports
from textyard.operators.contract import Model, Vectorizer
from textyard.plans import benchmark
from textyard.sources.results import RECORD, SCORES
from textyard.sources.tables import labelled


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


def by_hand(pairs):
    classes = sorted({c for p in pairs for c in p})
    rows = []
    for c in classes:
        tp = sum(a == b == c for a, b in pairs)
        said, true = sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
        p, r = tp / said if said else 0, tp / true if true else 0
        rows.append((p, r, 2 * p * r / (p + r) if p + r else 0, true))
    accuracy = sum(a == b for a, b in pairs) / len(pairs)
    macro = [sum(x[i] for x in rows) / len(rows) for i in range(3)]
    return [round(v, 4) for v in (accuracy, *macro, sum(x[2] * x[3] for x in rows) / len(pairs))]


@pytest.mark.parametrize(
    "pairs",
    [
        [(0, 0)] * 5 + [(1, 1)] * 3,
        [(0, 0)] * 5 + [(1, 0)] * 3,
        [(0, 1)] * 4,
        [(0, 0)] * 7 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)],
        [(0, 2), (1, 1), (2, 2), (0, 0)],
    ],
)
def test_scores(spark, pairs):
    assert [metrics.evaluate(predictions(spark, pairs)).first()[c] for c in SCORES] == by_hand(pairs)


def test_class_report(spark):
    pairs = [(0, 0)] * 7 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)]
    classes = metrics.per_class(metrics.confusion(predictions(spark, pairs)))
    rows = {r.row: r for r in metrics.class_report(classes, {0: "no", 1: "yes"}).collect()}
    assert set(rows) == {"no", "yes", "accuracy", "macro avg", "weighted avg"}
    assert rows["no"].support == 9 and rows["macro avg"].support == 13
    accuracy, p, r, f1, weighted = by_hand(pairs)
    assert rows["accuracy"].f1 == accuracy and rows["weighted avg"].f1 == weighted
    assert (rows["macro avg"].precision, rows["macro avg"].recall, rows["macro avg"].f1) == (p, r, f1)


def records(spark):
    rows = [
        ("toxic", m[0], 100, 1.0, 2.5, 0.5, 0.9, 0.8, 0.7, 0.6 + i / 100, 0.85)
        for i, m in enumerate(reports.METHODS)
        if m[0] != "glove"
    ]
    return spark.createDataFrame(rows, "dataset string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD))


def test_reports(spark):
    res = records(spark)
    board = reports.leaderboard(res).orderBy("display_order").collect()
    assert [r.vectorizer for r in board] == [m[0] for m in reports.METHODS]
    assert [r.vectorizer for r in board if not r.available] == ["glove"]
    assert metrics.best_method(res).first()["vectorizer"] == "roberta"
    assert reports.metrics_long(res).count() == 6 * 4
    assert reports.metrics_matrix(res).columns[2:] == list(reports.MATRIX_METRICS)
    trade = {r.display: r.total_time_s for r in reports.tradeoff(res).collect()}
    assert trade["Distilbert"] == 3.5
    assert reports.f1_by_method(res).first().axis_max == 0.74


def test_logistic_regression_reaches_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] + rng.normal(size=120) > 0.8).astype(int)
    rows = spark.createDataFrame(
        [(int(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"]
    )
    model = classify.fit_logistic(rows, tol=1e-9)
    beta, bias = np.asarray(model.coefficients), model.intercept
    weight = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum())))
    p = 1 / (1 + np.exp(-(x @ beta + bias)))
    gradient = beta + x.T @ (weight * (p - y))
    assert np.abs(gradient).max() < 1e-3 and abs((weight * (p - y)).sum()) < 1e-3
    scored = classify.predict(model, rows)
    assert scored.filter(F.col("prediction").isin(0, 1)).count() == 120
    weights = {r.label: r.weight for r in classify.class_weights(rows).collect()}
    assert np.isclose(weights[1], 120 / (2 * y.sum()))


@pytest.mark.parametrize("kind", ["vector", "array"])
def test_newton_reaches_the_optimum_in_few_jobs(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.1, 30, 12)
    y = (x @ rng.normal(size=12) + 40 * rng.normal(size=900) > 60).astype(int)
    cells = [(int(b), Vectors.dense(a) if kind == "vector" else a.tolist()) for a, b in zip(x, y)]
    rows = spark.createDataFrame(cells, ["label", "features"]).repartition(7)
    model = classify.fit_logistic(rows, c=0.7)
    assert model.steps <= 10 and model.gradient_norm < 1e-4
    weight = 0.7 * np.where(y == 1, 900 / (2 * y.sum()), 900 / (2 * (900 - y.sum())))
    p = 1 / (1 + np.exp(-(x @ model.coefficients + model.intercept)))
    assert np.abs(model.coefficients + x.T @ (weight * (p - y))).max() < 1e-3 and abs((weight * (p - y)).sum()) < 1e-3
    scored = classify.predict(model, rows).collect()
    assert [r.prediction for r in scored] == [int(np.dot(model.coefficients, np.array(r.features)) + model.intercept > 0) for r in scored]
    margins = rows.select(model.margin(F.col("features")).alias("m")).collect() if kind == "array" else []
    assert all(np.isfinite(r.m) for r in margins)


def test_newton_on_one_class_and_separable_rows(spark):
    one = spark.createDataFrame([(1, [float(i), 1.0]) for i in range(20)], "label int, features array<double>")
    model = classify.fit_logistic(one)
    assert classify.predict(model, one).where("prediction <> 1").count() == 0
    split = spark.createDataFrame([(int(i > 9), [float(i)]) for i in range(20)], "label int, features array<double>")
    model = classify.fit_logistic(split)
    assert model.gradient_norm < 1e-6 and classify.predict(model, split).where("prediction <> label").count() == 0


def test_linear_scores(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    entries = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 1, 1.0), (2, 9, 5.0)], "doc_id long, idx long, weight double")
    coef = spark.createDataFrame([(0, 1.5), (1, -1.0)], "idx long, coef double")
    got = {r.doc_id: (r.score, r.prediction) for r in classify.linear_scores(rows, entries, coef, 0.25).collect()}
    assert got == {1: (2.25, 1), 2: (-0.75, 0), 3: (0.25, 1)}


class LongestWord(Vectorizer, Model):
    """A method of one's own that reads the raw text."""

    name, dim, reads_text = "longest", 1, True

    def fit(self, corpus):
        return self

    def transform(self, corpus):
        longest = F.array_max(F.transform(F.split("text", r"\s+"), F.length)).cast("double")
        return corpus.withColumn("features", F.array(F.coalesce(longest, F.lit(0.0))))


def test_benchmark_end_to_end(spark, sf):
    table = spark.createDataFrame([("idiot", [1.0, 2.0]), ("worthless", [2.0, 1.0])], "word string, vector array<float>")
    out = benchmark.run_benchmark(
        labelled(spark, sf, "text"), "toxic", ["bow", "tfidf", "glove", "longest"], vectors=table, vector_size=2,
        own={"longest": LongestWord},
    ).collect()
    assert [r.vectorizer for r in out] == ["bow", "tfidf", "glove", "longest"]
    assert [r.embedding_dim for r in out][1:] == [out[1].embedding_dim, 2, 1]
    assert all(0 <= r[c] <= 1 for r in out for c in SCORES)
    assert all(r.fit_time_s >= 0 and r.transform_time_s > 0 for r in out)


def test_failed_dataset_is_skipped(spark, sf):
    def broken():
        raise FileNotFoundError("no such data")

    results, status = benchmark.run_datasets(
        spark, {"lost": broken, "toxic": lambda: labelled(spark, sf, "text")}, ["tfidf"]
    )
    assert {r.dataset: r.status for r in status.collect()} == {"lost": "failed", "toxic": "ok"}
    assert [r.dataset for r in results.collect()] == ["toxic"]
    with pytest.raises(ValueError, match="unknown"):
        benchmark.build_vectorizers(["nope"])
    with pytest.raises(ValueError, match="glove"):
        benchmark.build_vectorizers(["glove"])


def test_failed_dataset_is_no_result(spark, monkeypatch):
    from textyard.plans import queries

    # of the review labels none is there, so that its vocabulary has no term
    rows = [(i, f"some {'idiot' if i % 2 else 'kind'} words", i % 2) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, label int")
    monkeypatch.setattr(queries, "labelled", lambda *_, label: corpus.where(F.lit(label == "toxic")))
    with pytest.raises(RuntimeError, match="1 of 2 datasets failed: review: no term left"):
        queries.benchmark_datasets(spark, "")
    monkeypatch.setattr(queries, "labelled", lambda *_, label: corpus)
    board = queries.benchmark_datasets(spark, "").where("available").collect()
    assert {(r.dataset, r.vectorizer) for r in board} == {(d, v) for d in ("toxic", "review") for v in ("bow", "tfidf")}


def test_reports_of_a_real_run(spark, sf):
    results, report = benchmark.run_with_reports(labelled(spark, sf, "text"), "toxic", ["bow"])
    rows = {r.row: r for r in report.collect()}
    assert set(rows) == {"non-toxic", "toxic", "accuracy", "macro avg", "weighted avg"}
    record = results.first()
    assert (rows["macro avg"].f1, rows["accuracy"].f1) == (record.f1_macro, record.accuracy)
    assert {r.vectorizer for r in rows.values()} == {"bow"} and {r.dataset for r in rows.values()} == {"toxic"}


def test_prepared_corpora(spark):
    from textyard.plans import datasets

    raw = spark.createDataFrame([(i, f"text number {i:04d} of all", int(i % 9 == 0), None) for i in range(300)] + [(900, None, 1, 1)], "doc_id long, t string, a int, b int")
    got = datasets.prepare_comments(raw, "t", ["a", "b"], 200).collect()
    assert sorted(r.place for r in got) == list(range(1, 401)) and sum(r.label for r in got) == 200
    reviews = spark.createDataFrame([(i, "x" * (i % 40), i % 3 % 2) for i in range(400)] + [(900, None, 1)], "doc_id long, text string, label int")
    with pytest.warns(UserWarning):
        got = datasets.prepare_reviews(reviews).collect()
    kept = [(i, i % 3 % 2) for i in range(400) if i % 40 >= 20]
    n = min(sum(v for _, v in kept), sum(1 - v for _, v in kept))
    assert len(got) == 2 * n and sum(r.label for r in got) == n and all(20 <= len(r.text) < 40 for r in got)
    assert sorted(r.place for r in got) == list(range(1, 2 * n + 1))
