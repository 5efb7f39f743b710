"""The text cleaner as SQL functions: named expressions that the optimizer inlines, no Python in the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from textyard.functions import text as tx
from textyard.functions.stopwords import ENGLISH


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def definitions(stopwords: Sequence[str] = ENGLISH) -> dict[str, str]:
    """Signature and body of each function, in an order in which each uses only earlier ones.

    A missing text is empty. As in the column form, cheap tests of the raw text spare most rows the patterns.
    """
    links = " OR ".join(f"contains(t, '{mark}')" for mark in ("://", "ww.", "wW.", "Ww.", "WW."))
    kept = f"x NOT IN ({', '.join(repr(w) for w in stopwords)})" if stopwords else "true"
    follow = "zip_with(slice(t, 1, greatest(size(t) - 1, 0)), slice(t, 2, size(t)), (a, b) -> concat(a, ' ', b))"
    return {
        "strip_urls(t STRING) RETURNS STRING": f"CASE WHEN {links} THEN regexp_replace(lower(t), {_raw(tx.URL)}, ' ') ELSE lower(t) END",
        "strip_html(t STRING, raw STRING) RETURNS STRING": f"CASE WHEN contains(raw, '<') THEN regexp_replace(t, {_raw(tx.TAG)}, ' ') ELSE t END",
        "text_words(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(strip_html(strip_urls(coalesce(t, '')), coalesce(t, '')), {_raw(tx.WORD)}, 0)",
        "text_tokens(t STRING) RETURNS ARRAY<STRING>": f"filter(text_words(t), x -> {kept})",
        "clean_text(t STRING) RETURNS STRING": "array_join(text_tokens(t), ' ')",
        "text_bigrams(t ARRAY<STRING>) RETURNS ARRAY<STRING>": f"concat(t, {follow})",
    }


def register(spark: SparkSession, stopwords: Sequence[str] = ENGLISH) -> None:
    """Create the functions for this session: ``SELECT clean_text(body) FROM t``."""
    for head, body in definitions(stopwords).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
