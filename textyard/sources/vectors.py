"""Word-vector text files: ``word v1 ... vd`` per line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parse_vector_line(line: Column) -> list[Column]:
    """``word`` and ``vector`` of one line; white space at its end is dropped."""
    parts = F.split(F.regexp_replace(line, r"\s+$", ""), " ")
    vector = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: v.cast("float"))
    return [F.element_at(parts, 1).alias("word"), vector.alias("vector")]


def read_vector_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows ``seq, word, vector``; ``seq`` grows with the place in the files, in the order they are given.

    A folder's files follow each other by name. A place is the file, the byte at which the task's block of it begins, and
    the number of the row in the task, which follows the lines of a block.
    """
    parts = []
    for number, one in enumerate([path] if isinstance(path, str) else path):
        lines = spark.read.text(one).where(F.trim("value") != "")
        place = F.struct(
            F.lit(number).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        parts.append(lines.select(place.alias("seq"), *parse_vector_line(F.col("value"))))
    return reduce(DataFrame.unionByName, parts)


def dedupe_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Keep the row of the highest ``seq`` for each ``key``."""
    rest = [c for c in df.columns if c not in (key, seq)]
    newest = F.max_by(F.struct(*rest), F.col(seq)).alias("_last")
    return df.groupBy(key).agg(newest).select(key, *[F.col("_last")[c].alias(c) for c in rest])
