"""Binarising, filtering and counting a labelled corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The accepted length of a review, in characters, both ends included.
MIN_LEN = 20
MAX_LEN = 512


def any_flag(flags: Sequence[Column]) -> Column:
    """1 if any of the flags is set; missing flags count as 0."""
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(flag, F.lit(0))
    return (total > 0).cast("int")


def binarise(df: DataFrame, text: str, flags: Sequence[str], *keep: str) -> DataFrame:
    return df.select(*keep, F.col(text).alias("text"), any_flag([F.col(f) for f in flags]).alias("label"))


def length_filter(df: DataFrame, text: str = "text", low: int = MIN_LEN, high: int = MAX_LEN) -> DataFrame:
    """Rows whose text is present and within the band of characters."""
    return df.filter(F.col(text).isNotNull() & F.length(text).between(low, high))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Total, positives and positive rate."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(label).cast("bigint")).alias("n_pos"),
        F.round(F.avg(label), 4).alias("pos_rate"),
    )


def group_breakdown(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Total, positives and negatives per group."""
    total, pos = F.count(F.lit(1)), F.sum(F.col(label).cast("bigint"))
    return df.groupBy(group).agg(total.alias("total"), pos.alias("pos"), (total - pos).alias("neg"))
