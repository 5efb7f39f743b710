"""Parquet tables and the labelled corpus built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textyard.functions import text as tx
from textyard.session import spread


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The document table, its texts spread over all cores."""
    return spread(table(spark, folder, "documents", *(columns or ("doc_id", "text"))))


def labelled(spark: SparkSession, folder: str, *columns: str, label: str = "toxic") -> DataFrame:
    """Documents that carry a label, as ``doc_id, label`` and the wanted document columns."""
    wanted = ["doc_id", *columns]
    docs = table(spark, folder, "documents", *wanted)
    if "text" in columns:
        docs = spread(docs)
    labels = table(spark, folder, "labels").select("doc_id", F.col(label).cast("int").alias("label"))
    return docs.join(labels, "doc_id")


def with_tokens(corpus: DataFrame) -> DataFrame:
    """Add ``tokens`` cleaned from ``text`` unless the frame already has them."""
    if "tokens" in corpus.columns:
        return corpus
    return corpus.withColumn("tokens", tx.tokens("text")).drop("text")


def token_rows(corpus: DataFrame, *keep: str) -> DataFrame:
    """One row per token: the ``keep`` columns and ``word``.

    A plain explode lets the optimizer infer a filter on the array's size and evaluate the
    whole cleaner a second time for it; the outer form does not.
    """
    rows = with_tokens(corpus).select(*keep, F.explode_outer("tokens").alias("word"))
    return rows.filter(F.col("word").isNotNull())
