"""Comparison tables and chart data over result records.

Result records are a few rows per dataset, one per method; the small dimension table of
methods is written into the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textyard.functions import text as tx

# Method key, display name, family, place in the tables.
METHODS = (
    ("bow", "BoW", "Sparse", 1),
    ("tfidf", "TF-IDF", "Sparse", 2),
    ("word2vec", "Word2Vec", "Dense DL", 3),
    ("fasttext", "FastText", "Subword DL", 4),
    ("glove", "GloVe", "Dense DL", 5),
    ("distilbert", "DistilBERT", "Contextual", 6),
    ("roberta", "RoBERTa", "Contextual", 7),
)

# Class names of the two kinds of dataset.
CLASS_NAMES = {"toxic": {0: "non-toxic", 1: "toxic"}, "review": {0: "negative", 1: "positive"}}

CHART_METRICS = ("accuracy", "precision", "recall", "f1_macro")
MATRIX_METRICS = (*CHART_METRICS, "f1_weighted")


def leaderboard(results: DataFrame, methods: tuple = METHODS) -> DataFrame:
    """Every expected method of every dataset in display order; a missing one is flagged."""
    joined = _expected(results, methods).join(results, ["dataset", "vectorizer"], "left")
    return joined.select(
        "dataset", "display_order", "vectorizer", "display_name", "family", F.col("embedding_dim").cast("bigint"), "fit_time_s",
        "transform_time_s", "accuracy", "f1_macro", "f1_weighted", F.col("accuracy").isNotNull().alias("available"),
    )


def _expected(results: DataFrame, methods: tuple) -> DataFrame:
    fields = [
        F.struct(F.lit(k).alias("vectorizer"), F.lit(n).alias("display_name"), F.lit(f).alias("family"), F.lit(o).alias("display_order"))
        for k, n, f, o in methods
    ]
    return results.select("dataset").distinct().select("dataset", F.inline(F.array(*fields)))


def tradeoff(results: DataFrame) -> DataFrame:
    """Cost against quality: fit plus transform time and macro F1."""
    total = F.round(F.col("fit_time_s") + F.col("transform_time_s"), 3)
    return results.select(
        "dataset", "vectorizer", tx.capitalise("vectorizer").alias("display"), total.alias("total_time_s"), "f1_macro"
    )


def metrics_long(results: DataFrame, metrics: tuple[str, ...] = CHART_METRICS) -> DataFrame:
    return results.unpivot(["dataset", "vectorizer"], list(metrics), "metric", "value")


def metrics_matrix(results: DataFrame) -> DataFrame:
    """One row per method, one column per metric, three digits."""
    long = metrics_long(results, MATRIX_METRICS)
    wide = long.groupBy("dataset", "vectorizer").pivot("metric", list(MATRIX_METRICS)).agg(F.first("value"))
    return wide.select(
        "dataset", tx.capitalise("vectorizer").alias("display"), *[F.round(m, 3).alias(m) for m in MATRIX_METRICS]
    )


def f1_by_method(results: DataFrame) -> DataFrame:
    """Macro F1 per method and the upper end of the chart axis of its dataset."""
    top = results.groupBy("dataset").agg(F.round(F.least(F.lit(1.0), F.max("f1_macro") + 0.08), 4).alias("axis_max"))
    return results.select("dataset", "vectorizer", "f1_macro").join(top, "dataset")
