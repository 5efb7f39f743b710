"""Result records: JSON in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

TIMES = ("fit_time_s", "transform_time_s", "classifier_train_time_s")
SCORES = ("accuracy", "precision", "recall", "f1_macro", "f1_weighted")

RECORD = T.StructType(
    [T.StructField("vectorizer", T.StringType()), T.StructField("embedding_dim", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in TIMES + SCORES]
)


def read_results(spark: SparkSession, path: str, dataset: str, fallback: str | None = None) -> DataFrame:
    """Read a JSON array of records; ``fallback`` is read when ``path`` does not exist."""
    for candidate in filter(None, (path, fallback)):
        try:
            rows = spark.read.schema(RECORD).option("multiLine", True).json(candidate)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return rows.select(F.lit(dataset).alias("dataset"), "*")
    raise FileNotFoundError(f"no results for {dataset} at {path}")


def parse_results(json_array: Column) -> Column:
    """Parse a JSON array of records held in a string column."""
    return F.from_json(json_array, T.ArrayType(RECORD))


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per dataset, one JSON record per line."""
    df.write.mode(mode).partitionBy("dataset").json(path)


def read_result_table(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_results`` wrote."""
    rows = spark.read.schema(T.StructType([*RECORD.fields, T.StructField("dataset", T.StringType())])).json(path)
    return rows.select("dataset", *[c for c in rows.columns if c != "dataset"])


def results_union(*parts: DataFrame | None) -> DataFrame:
    """Concatenate result sets; an absent one counts as empty."""
    present = [p for p in parts if p is not None]
    if not present:
        raise ValueError("no result set given")
    out = present[0]
    for part in present[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
