"""Classification metrics as aggregates over the confusion matrix.

``by`` names the columns that tell results apart, such as dataset and vectorizer. The
predictions are read once; everything after ``confusion`` works on a few rows per result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def confusion(predictions: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    return predictions.groupBy(*by, label, "prediction").agg(F.count(F.lit(1)).alias("n"))


def per_class(matrix: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support of every class seen as a label or a prediction.

    A ratio with an empty denominator is 0.
    """
    hit = F.when(F.col(label) == F.col("prediction"), F.col("n")).otherwise(0)
    # each cell counts once for its true class and once for its predicted class
    sides = F.inline(
        F.array(
            F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("tp")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
        )
    )
    totals = matrix.select(*by, sides).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    return totals.select(*by, "class", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "tp")


def scores(classes: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Accuracy, macro precision/recall/F1 and support-weighted F1, rounded."""
    return classes.groupBy(*by).agg(
        F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
        F.round(F.avg("precision"), digits).alias("precision"),
        F.round(F.avg("recall"), digits).alias("recall"),
        F.round(F.avg("f1"), digits).alias("f1_macro"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), digits).alias("f1_weighted"),
    )


def evaluate(predictions: DataFrame, by: Sequence[str] = (), label: str = "label", digits: int = 4) -> DataFrame:
    return scores(per_class(confusion(predictions, by, label), by, label), by, digits)


def class_report(
    classes: DataFrame, names: dict[int, str], by: Sequence[str] = (), digits: int = 4
) -> DataFrame:
    """Rows per class plus accuracy, macro and weighted average."""
    named = F.coalesce(*[F.when(F.col("class") == c, F.lit(n)) for c, n in names.items()], F.col("class").cast("string"))
    columns = ("precision", "recall", "f1")
    rows = classes.select(*by, named.alias("row"), *columns, "support")
    total = F.sum("support").alias("support")
    accuracy = F.sum("tp") / F.sum("support")
    # the report shows accuracy as one figure; it stands in the F1 column
    empty = F.lit(None).cast("double")
    overall = classes.groupBy(*by).agg(accuracy.alias("f1"), total).select(
        *by, F.lit("accuracy").alias("row"), empty.alias("precision"), empty.alias("recall"), "f1", "support"
    )
    macro = classes.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns], total)
    weighted = classes.groupBy(*by).agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in columns], total
    )
    out = (
        rows.unionByName(overall)
        .unionByName(macro.withColumn("row", F.lit("macro avg")))
        .unionByName(weighted.withColumn("row", F.lit("weighted avg")))
    )
    return out.select(*by, "row", *[F.round(c, digits).alias(c) for c in columns], "support")


def best_method(results: DataFrame, by: Sequence[str] = ("dataset",), score: str = "f1_macro") -> DataFrame:
    """Highest score and the method that has it (tie: alphabetical)."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col("vectorizer").alias("v"))).alias("_b")
    return results.groupBy(*by).agg(best).select(
        *by, F.col("_b.v").alias("vectorizer"), (-F.col("_b.s")).alias(score)
    )
