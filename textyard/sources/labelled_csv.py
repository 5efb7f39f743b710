"""Labelled text files: quoted, multi-line CSV in and out."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textyard.session import few_rows, join_per_group
from textyard.sources.split_csv import records

# Tokens the data-frame reader of the studied tool takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The flag columns of the multi-label comment file.
FLAGS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")

REVIEWS = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("game", T.StringType())]
)
CORPUS = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
COMMENTS = T.StructType(
    [T.StructField("comment_text", T.StringType())] + [T.StructField(f, T.IntegerType()) for f in FLAGS]
)


# How the fields of a record are quoted.
QUOTED = {"quote": '"', "escape": '"', "multiLine": "true", "maxColumns": "2000"}


def read_labelled_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = CORPUS) -> DataFrame:
    """Read with a fixed schema; texts may hold commas, quotes and line breaks, and a file is read by many tasks.

    Columns are matched to the schema by each file's own header, so their order may differ between files and
    columns the schema does not name are left out. Whole numbers may be written as ``1.0``.
    """
    rows = records(spark, path)
    first = (F.col("block") == 0) & (F.col("n") == 0)
    heads = rows.where(first).select("file", F.regexp_replace("text", "^\ufeff", "").alias("head"))
    kinds = few_rows(heads.select("head").distinct())
    if kinds is None:
        raise ValueError(f"the files of {path} have too many different headers")
    body = rows.where(~first)
    if len(kinds) > 1:
        body = join_per_group(body, heads, ["file"])
    parts = []
    for kind in sorted(r["head"] for r in kinds):
        names = next(csv.reader([kind]))
        missing = [f.name for f in schema.fields if f.name not in names]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        own = body if len(kinds) == 1 else body.where(F.col("head") == kind)
        fields = ", ".join(f"c{i} string" for i in range(len(names)))
        cells = own.select(F.from_csv("text", fields, QUOTED).alias("r"))
        parts.append(cells.select(*[_value(F.col(f"r.c{names.index(f.name)}"), f.dataType).alias(f.name) for f in schema.fields]))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def _value(cell: Column, kind: T.DataType) -> Column:
    given = F.when(~cell.isin(*NA_TOKENS), cell)
    return given.cast("double").cast(kind) if isinstance(kind, T.IntegralType) else given.cast(kind)


def read_sources(spark: SparkSession, paths: dict[str, str], schema: T.StructType = CORPUS) -> DataFrame:
    """Concatenate one file (or folder) per source, keeping the source's name."""
    frames = [read_labelled_csv(spark, p, schema).withColumn("source", F.lit(s)) for s, p in paths.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_labelled_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_labelled_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
