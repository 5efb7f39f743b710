"""Class-weighted logistic regression on vectorized documents."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import unwrap_udt

from textyard.operators import newton
from textyard.operators.newton import LinearModel
from textyard.operators.prepare import class_counts
from textyard.session import cut_lineage, few_rows, join_per_group

ROWS_PER_TASK = 5_000


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n, weight)`` with the balanced weight n / (classes * n_class)."""
    counts = class_counts(rows, label)
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    total = totals.select(F.col("n") / F.col("k")).scalar()
    return counts.withColumn("weight", total / F.col("n"))


def balanced_weights(counts: dict) -> dict:
    """The balanced weight n / (classes * n_class) of each class."""
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def fit_logistic(
    train: DataFrame,
    label: str = "label",
    features: str = "features",
    c: float = 1.0,
    max_iter: int = 1_000,
    tol: float = 1e-4,
) -> LogisticRegressionModel | LinearModel:
    """Minimise ½|β|² + C · Σ weight · logloss, intercept free.

    Dense features of at most ``newton.WIDEST`` entries and two classes are solved by Newton steps, a few jobs in all. Others go
    to MLlib, which averages the loss over the weights; these sum to the row count when balanced, hence the
    penalty 1 / (C · n).
    """
    width = F.max(_dense_width(train, features))
    rows = train.select(label, features)
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), width.alias("width"))
    few = few_rows(sizes)
    widths = {r["width"] for r in few or []}
    if few and {r[label] for r in few} <= {0, 1} and None not in widths and max(widths) <= newton.WIDEST:
        ready = cut_lineage(_packed(rows, sum(r["n"] for r in few)))
        weights = balanced_weights({r[label]: r["n"] for r in few})
        return newton.fit_newton(ready, max(widths), weights, label, features, c)
    n = sum(r["n"] for r in few) if few else train.count()
    weights = class_weights(train, label).select(label, "weight")
    weighted = _packed(join_per_group(rows, weights, [label]), n)
    lr = LogisticRegression(
        labelCol=label, featuresCol=features, weightCol="weight", maxIter=max_iter,
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=tol,
    )
    return lr.fit(weighted)


def _dense_width(rows: DataFrame, features: str) -> Column:
    """The width of a dense vector or an array, null for a sparse one."""
    if isinstance(rows.schema[features].dataType, T.ArrayType):
        return F.size(features)
    parts = unwrap_udt(F.col(features))
    return F.when(parts["type"] == 1, F.size(parts["values"]))


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """Every step is a job: for few rows, starting its tasks would cost the most."""
    tasks = -(-n // ROWS_PER_TASK)
    return rows.repartition(tasks) if tasks < rows.sparkSession.sparkContext.defaultParallelism else rows


def predict(model: LogisticRegressionModel | LinearModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows).drop("rawPrediction", "probability")
    return scored.withColumn("prediction", F.col("prediction").cast("int"))


def linear_scores(
    rows: DataFrame, entries: DataFrame, coefficients: DataFrame, intercept: float, row_id: str = "doc_id"
) -> DataFrame:
    """Score long-form features ``(doc_id, idx, weight)`` with given ``(idx, coef)``.

    ``coefficients`` has one row per vocabulary term and is therefore small enough to
    broadcast. A row of ``rows`` without entries scores the intercept.
    """
    hits = entries.join(F.broadcast(coefficients), "idx")
    sums = hits.groupBy(row_id).agg(F.sum(F.col("weight") * F.col("coef")).alias("_s"))
    score = F.coalesce(F.col("_s"), F.lit(0.0)) + F.lit(float(intercept))
    return rows.join(sums, row_id, "left").select(
        *rows.columns, score.alias("score"), (F.round(score, 6) > 0).cast("int").alias("prediction")
    )
