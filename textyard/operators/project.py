"""Two-dimensional projection of document vectors and how well it separates classes."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from textyard.session import cut_lineage

# Squarings of the covariance matrix: 2**12 steps of power iteration.
SQUARINGS = 12


def project_2d(rows: DataFrame, features: str = "features") -> DataFrame:
    """Add ``x`` and ``y``: the first two principal components of the centred features.

    Each axis points so that its largest loading is positive. Needs one covariance matrix
    (width squared) on the driver, whatever the number of rows.
    """
    centring = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred")
    centred = centring.fit(rows).transform(rows)
    model = PCA(k=2, inputCol="_centred", outputCol="_pc").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, k]).argmax(), k] > 0 else -1.0 for k in range(2)]
    pc = vector_to_array("_pc")
    return model.transform(centred).select(
        *[c for c in rows.columns if c != features], (pc[0] * signs[0]).alias("x"), (pc[1] * signs[1]).alias("y")
    )


def class_centroids(rows: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """Mean vector of each class in long form ``(label, dim, value)``."""
    means = rows.groupBy(label).agg(Summarizer.mean(array_to_vector(vector)).alias("_m"))
    cells = means.select(label, F.posexplode(vector_to_array("_m")).alias("dim", "value"))
    return cells.select(label, F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def class_separation(rows: DataFrame, label: str = "label", features: str = "features") -> float:
    """Mean silhouette (squared Euclidean) with the classes as clusters."""
    evaluator = ClusteringEvaluator(predictionCol="_class", featuresCol=features)
    return evaluator.evaluate(rows.select(features, F.col(label).cast("double").alias("_class")))


def covariance(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """``(i, j, cov, mean_i)`` for i <= j of an array column, in one pass.

    Each entry is a centred co-moment that tasks build up and merge, so no difference of large sums is taken; a task sends one
    row per entry, whatever its number of rows. Vectors that are null or hold a null are left out.
    """
    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    left = whole.select(F.col(vector).alias("_v"), F.posexplode(vector).alias("i", "_x"))
    both = left.select("i", "_x", F.posexplode(F.expr("slice(_v, i + 1, size(_v))")).alias("_step", "_y"))
    cells = both.groupBy("i", (F.col("i") + F.col("_step")).alias("j"))
    return cells.agg(F.covar_samp(F.col("_x").cast("double"), F.col("_y").cast("double")).alias("cov"), F.avg("_x").alias("mean_i"))


def covariance_matrix(cells: DataFrame) -> DataFrame:
    """One row: ``m``, the symmetric matrix as an array of arrays, and ``mean``. Its size is the width squared."""
    full = cells.select("i", "j", "cov").unionByName(cells.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    lines = full.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "cov"))).alias("_r"))
    lines = lines.select("i", F.col("_r.cov").alias("r"))
    means = cells.where("i = j").select("i", "mean_i")
    whole = lines.join(means, "i").agg(F.array_sort(F.collect_list(F.struct("i", "r", "mean_i"))).alias("_m"))
    return whole.select(F.col("_m.r").alias("m"), F.col("_m.mean_i").alias("mean"))


# the matrix squared again and again, scaled by its largest entry; a column of the last one is the leading axis
_POWER = """
WITH RECURSIVE power(step, m) AS (
  SELECT 0, m FROM {matrix}
  UNION ALL
  SELECT step + 1, transform(s, r -> transform(r, x -> if(top > 0, x / top, 0d)))
  FROM (SELECT step, s, array_max(transform(s, r -> array_max(transform(r, x -> abs(x))))) AS top
        FROM (SELECT step, transform(m, r -> transform(m, c -> aggregate(zip_with(r, c, (a, b) -> a * b), 0d, (t, x) -> t + x))) AS s
              FROM power WHERE step < {last}))
),
column AS (SELECT element_at(m, cast(array_position(d, array_max(d)) as int)) AS v
           FROM (SELECT m, transform(m, (r, i) -> r[i]) AS d FROM power WHERE step = {last}))
SELECT transform(v, x -> if(size > 0, x / size, 0d)) AS axis
FROM (SELECT v, sqrt(aggregate(v, 0d, (t, x) -> t + x * x)) AS size FROM column)
"""


def leading_axis(matrix: DataFrame, squarings: int = SQUARINGS) -> DataFrame:
    """The first principal axis of a covariance matrix (one row ``m``), by recursive squaring; its largest entry is positive."""
    return matrix.sparkSession.sql(_POWER, matrix=matrix, last=squarings)


def principal_axes(cells: DataFrame, k: int = 2, squarings: int = SQUARINGS) -> DataFrame:
    """``(component, axis, variance, share, mean)`` of the first ``k`` principal axes.

    After each axis its part is taken out of the matrix. The matrix is one row of the width squared; everything
    before it, and the projection after it, is distributed.
    """
    start = cut_lineage(covariance_matrix(cells))
    trace = F.aggregate(F.transform("m", lambda r, i: F.get(r, i)), F.lit(0.0), lambda a, x: a + x)
    total = start.select(trace.alias("total"), "mean")
    matrix, parts = start.select("m"), []
    for component in range(1, k + 1):
        axis = leading_axis(matrix, squarings)
        # one row each side
        both = cut_lineage(matrix.join(F.broadcast(axis)))
        image = F.transform("m", lambda r: F.aggregate(F.zip_with(r, F.col("axis"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
        length = F.aggregate(F.zip_with(image, "axis", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        both = both.withColumn("variance", length)
        parts.append(both.select(F.lit(component).cast("bigint").alias("component"), "axis", "variance"))
        rest = F.transform("m", lambda r, i: F.transform(r, lambda x, j: x - F.col("variance") * F.get("axis", i) * F.get("axis", j)))
        matrix = both.select(rest.alias("m"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    share = F.when(F.col("total") > 0, F.col("variance") / F.col("total")).otherwise(0.0)
    return cut_lineage(out.join(F.broadcast(total)).select("component", "axis", "variance", share.alias("share"), "mean"))


def on_axes(rows: DataFrame, axes: DataFrame, vector: str = "vector") -> DataFrame:
    """Add each row's place on every axis as ``places``; axes are few and broadcast."""
    shared = axes.agg(F.array_sort(F.collect_list(F.struct("component", "axis", "mean"))).alias("_axes"))
    centred = lambda a: F.zip_with(F.col(vector), a["mean"], lambda x, m: x - m)
    place = lambda a: F.aggregate(F.zip_with(centred(a), a["axis"], lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
    return rows.join(F.broadcast(shared)).withColumn("places", F.transform("_axes", place)).drop("_axes")
