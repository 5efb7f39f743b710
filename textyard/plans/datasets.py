"""Raw rows to balanced, shuffled corpora, end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textyard.functions.hashing import draw_key
from textyard.operators.prepare import binarise, length_filter
from textyard.operators.sampling import balance_min, balance_n, prefix, ranked
from textyard.session import cut_lineage

PER_CLASS = 10_000
REVIEWS_PER_CLASS = 20_000
SEED = 42


def shuffled_corpus(rows: DataFrame, *ids: str, seed: int = SEED) -> DataFrame:
    """``(place, text, label)``: the rows in seeded order, numbered from 1, without sorting them in one task."""
    key = draw_key(F.concat_ws(":", *ids), seed)
    placed = ranked(rows, key, prefix(key))
    return placed.select(F.col("rank").alias("place"), "text", "label")


def prepare_comments(
    rows: DataFrame, text: str, flags: Sequence[str], n: int | None = PER_CLASS, row_id: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """Comments with flags: one label, ``n`` rows a class (the smaller one drawn with replacement when short), shuffled.

    Without ``n`` the classes get as many rows as class 0 has.
    """
    labelled = cut_lineage(binarise(rows, text, flags, row_id))
    each = labelled.filter(F.col("label") == 0).count() if n is None else n
    return shuffled_corpus(balance_n(labelled, each, row_id, seed=seed), row_id, "draw_no", seed=seed)


def prepare_reviews(rows: DataFrame, n: int = REVIEWS_PER_CLASS, row_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Reviews ``(row_id, text, label)``: those with a text of accepted length, as many of each class, shuffled."""
    kept = cut_lineage(length_filter(rows.select(row_id, "text", "label")))
    return shuffled_corpus(balance_min(kept, n, row_id, seed=seed), row_id, seed=seed)
