"""Nested review pages flattened to one row per review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textyard.functions import text as tx
from textyard.operators.prepare import MAX_LEN, MIN_LEN
from textyard.operators.sampling import cap_per_group
from textyard.session import cut_lineage, join_per_group

PAGE = T.StructType(
    [
        T.StructField("success", T.IntegerType()),
        T.StructField("cursor", T.StringType()),
        T.StructField(
            "reviews",
            T.ArrayType(
                T.StructType([T.StructField("review", T.StringType()), T.StructField("voted_up", T.BooleanType())])
            ),
        ),
    ]
)


# A page with its source and its number there, from 0.
SOURCED_PAGE = T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.LongType()), *PAGE.fields])


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(PAGE).option("multiLine", True).json(path)


def parse_page(json_text: Column) -> Column:
    return F.from_json(json_text, PAGE)


def flatten_reviews(pages: DataFrame, *keep: str, min_len: int = MIN_LEN, max_len: int = MAX_LEN) -> DataFrame:
    """One row per review of the successful pages: ``text, label`` and the ``keep`` columns.

    Row-local, so it runs unchanged on a stream.
    """
    reviews = pages.filter(F.col("success") == 1).select(*keep, F.explode("reviews").alias("_r"))
    rows = reviews.select(
        *keep,
        tx.trim_space(F.col("_r.review")).alias("text"),
        F.coalesce(F.col("_r.voted_up"), F.lit(False)).cast("int").alias("label"),
    )
    return rows.filter(F.length("text").between(min_len, max_len))


def reviews_of() -> T.StructType:
    return T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])


def accepted(pages: DataFrame, min_len: int = MIN_LEN, max_len: int = MAX_LEN) -> DataFrame:
    """``(source, page, good, last, kept)``: whether a page counts, whether its source ends behind it, its accepted reviews."""
    trimmed = F.transform("reviews", lambda r: F.struct(
        tx.trim_space(r["review"]).alias("text"), F.coalesce(r["voted_up"], F.lit(False)).cast("int").alias("label")
    ))
    kept = F.filter(trimmed, lambda r: F.length(r["text"]).between(min_len, max_len))
    good = F.coalesce((F.col("success") == 1) & (F.size("reviews") > 0), F.lit(False))
    last = F.coalesce(F.col("cursor") == "", F.lit(True))
    return pages.select("source", "page", good.alias("good"), last.alias("last"), F.coalesce(kept, F.array().cast(T.ArrayType(reviews_of()))).alias("kept"))


def take_reviews(pages: DataFrame, target: int) -> DataFrame:
    """``(source, text, label)``: the first ``target`` accepted reviews of every source, read page by page.

    Pages come by number, a repeated one counts once. A page without success or reviews ends its source ahead of it, an empty or
    missing cursor behind it. Where a source ends is an aggregate, and the target is cut by ranges of its reviews, so a
    source with most of the pages is never in one task.
    """
    measured = cut_lineage(accepted(pages).dropDuplicates(["source", "page"]))
    end = F.min(F.when(~F.col("good"), F.col("page")).when(F.col("last"), F.col("page") + 1)).alias("_end")
    ends = measured.groupBy(F.to_json(F.struct("source")).alias("_key")).agg(end)
    live = join_per_group(measured.withColumn("_key", F.to_json(F.struct("source"))), ends, ["_key"])
    live = live.where(F.col("_end").isNull() | (F.col("page") < F.col("_end")))
    # a page holds far fewer reviews than this
    each = live.select("source", "page", F.posexplode("kept").alias("_at", "_r"))
    placed = each.select("source", (F.col("page") * 1_000_000 + F.col("_at")).alias("_place"), "_r.text", "_r.label")
    return cap_per_group(placed, "source", target, "_place").drop("_place")
