"""Bag-of-words and TF-IDF: term statistics, vocabularies, weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F, types as T

from textyard.functions import text as tx
from textyard.operators.contract import Model, Vectorizer
from textyard.operators.frequent import frequent_terms
from textyard.sources.tables import with_tokens

MAX_FEATURES = 10_000
NGRAMS = (1, 2)
MIN_DF = 2


def term_stats(corpus: DataFrame, ngrams: tuple[int, int] = NGRAMS) -> DataFrame:
    """Corpus frequency ``tf`` and document frequency ``df`` of every term.

    Each document sends its terms once for ``tf`` and its distinct terms once for ``df``,
    so one shuffle of counts already combined per task is enough; tokens never move.
    """
    terms = with_tokens(corpus).select(tx.ngrams("tokens", *ngrams).alias("terms"))
    sides = F.array(
        F.struct(F.col("terms").alias("terms"), F.lit(1).alias("t"), F.lit(0).alias("d")),
        F.struct(F.array_distinct("terms").alias("terms"), F.lit(0).alias("t"), F.lit(1).alias("d")),
    )
    rows = terms.select(F.inline(sides)).select(F.explode("terms").alias("term"), "t", "d")
    return rows.groupBy("term").agg(F.sum("t").alias("tf"), F.sum("d").alias("df"))


def top_terms(stats: DataFrame, max_features: int = MAX_FEATURES, min_df: int = 1) -> DataFrame:
    """The most frequent terms (tie: alphabetical), numbered alphabetically from 0."""
    kept = stats.filter(F.col("df") >= min_df) if min_df > 1 else stats
    top = kept.orderBy(F.desc("tf"), "term").limit(max_features)
    # at most max_features rows reach this one-task window
    return top.withColumn("idx", (F.row_number().over(W.orderBy("term")) - 1).cast("bigint"))


def idf(df: Column, n_docs: Column, mode: str = "smooth") -> Column:
    if mode == "smooth":
        return F.log((1 + n_docs) / (1 + df)) + 1
    if mode == "plain":
        return F.log(n_docs / df)
    raise ValueError(f"unknown idf mode {mode}")


def term_counts(corpus: DataFrame, vocabulary: DataFrame, ngrams: tuple[int, int] = NGRAMS, row_id: str = "doc_id") -> DataFrame:
    """Raw counts ``(doc_id, idx, cnt)`` of vocabulary terms; unseen terms drop out.

    ``vocabulary`` comes from ``top_terms`` and so has at most ``max_features`` rows. The
    join precedes the aggregate, so only ids and counts are shuffled.
    """
    rows = with_tokens(corpus).select(row_id, F.explode(tx.ngrams("tokens", *ngrams)).alias("term"))
    found = rows.join(F.broadcast(vocabulary.select("term", "idx")), "term")
    return found.groupBy(row_id, "idx").agg(F.count(F.lit(1)).alias("cnt"))


def _weigh(weights: np.ndarray | None, sublinear: bool, norm: bool, keep: list[str], as_vector: bool):
    """Arrow batches of sparse count vectors -> weighted sparse vectors, whole batches at a time."""

    def run(batches):
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("_tf"))
            size, idx, val = vec.field("size"), vec.field("indices"), vec.field("values")
            flat = val.flatten().to_numpy(zero_copy_only=False)
            lengths = np.asarray(val.value_lengths(), dtype=np.int64)
            terms = idx.flatten()
            w = 1.0 + np.log(flat) if sublinear else flat.astype(np.float64)
            if weights is not None:
                w = w * weights[terms.to_numpy(zero_copy_only=False)]
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            if norm and len(w):
                row = np.repeat(np.arange(len(lengths)), lengths)
                square = np.bincount(row, weights=w * w, minlength=len(lengths))
                w = w / np.sqrt(square)[row]
            idx = pa.ListArray.from_arrays(pa.array(offsets), terms)
            val = pa.ListArray.from_arrays(pa.array(offsets), pa.array(w, pa.float64()))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if as_vector:
                kind = pa.array(np.zeros(len(lengths), dtype=np.int8))
                out = [pa.StructArray.from_arrays([kind, size, idx, val], ["type", "size", "indices", "values"])]
                names = [*keep, "features"]
            else:
                out, names = [idx, val], [*keep, "indices", "values"]
            yield pa.RecordBatch.from_arrays([*kept, *out], names=names)

    return run


@dataclass
class TermModel(Model):
    """A fitted vocabulary; ``vocabulary`` holds ``term, idx, tf, df, idf`` in index order."""

    name: str
    spark: object
    vocabulary_rows: list
    n_docs: int
    ngrams: tuple[int, int]
    tfidf: bool
    sublinear: bool = True
    norm: bool = True

    @property
    def dim(self) -> int:
        return len(self.vocabulary_rows)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.vocabulary_rows, "term string, idx bigint, tf bigint, df bigint, idf double"
        )

    def save(self, path: str) -> None:
        """One Parquet row per term; the settings are repeated in every row."""
        low, high = self.ngrams
        settings = {
            "name": self.name, "n_docs": self.n_docs, "low": low, "high": high,
            "tfidf": self.tfidf, "sublinear": self.sublinear, "norm": self.norm,
        }
        self.vocabulary.select("*", *[F.lit(v).alias(f"_{k}") for k, v in settings.items()]).write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> TermModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["idx"])
        terms = [Row(**{c: r[c] for c in ("term", "idx", "tf", "df", "idf")}) for r in rows]
        head = rows[0]
        return cls(
            head["_name"], spark, terms, head["_n_docs"], (head["_low"], head["_high"]),
            head["_tfidf"], head["_sublinear"], head["_norm"],
        )

    def _weighted(self, corpus: DataFrame, as_vector: bool) -> DataFrame:
        corpus = with_tokens(corpus)
        keep = [c for c in corpus.columns if c != "tokens"]
        counter = CountVectorizerModel.from_vocabulary(
            [r["term"] for r in self.vocabulary_rows], inputCol="_terms", outputCol="_tf"
        )
        terms = corpus.select(*keep, tx.ngrams("tokens", *self.ngrams).alias("_terms"))
        counts = counter.transform(terms).drop("_terms")
        if not self.tfidf and as_vector:
            return counts.withColumnRenamed("_tf", "features")
        weights = np.array([r["idf"] for r in self.vocabulary_rows]) if self.tfidf else None
        fields = [corpus.schema[c] for c in keep]
        if as_vector:
            out = [T.StructField("features", VectorUDT())]
        else:
            out = [T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
        work = _weigh(weights, self.tfidf and self.sublinear, self.tfidf and self.norm, keep, as_vector)
        return counts.mapInArrow(work, T.StructType([*fields, *out]))

    def transform(self, corpus: DataFrame) -> DataFrame:
        """Add the sparse ``features``; row-local, no shuffle."""
        return self._weighted(corpus, as_vector=True)

    def transform_long(self, corpus: DataFrame, row_id: str = "doc_id") -> DataFrame:
        """The non-zero entries as ``(doc_id, idx, weight)``."""
        rows = self._weighted(with_tokens(corpus).select(row_id, "tokens"), as_vector=False)
        cells = F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("weight"))
        return rows.select(row_id, F.inline(cells)).withColumn("idx", F.col("idx").cast("bigint"))


@dataclass
class BagOfWords(Vectorizer):
    """Raw counts of the ``max_features`` most frequent word n-grams."""

    max_features: int = MAX_FEATURES
    ngrams: tuple[int, int] = NGRAMS
    name: str = "bow"
    min_df: int = 1

    def vocabulary_frame(self, corpus: DataFrame) -> DataFrame:
        """The vocabulary; only terms that may belong to it are shuffled, all of them where counts are too flat for that."""
        rows = with_tokens(corpus).select(tx.ngrams("tokens", *self.ngrams).alias("terms"))
        stats = frequent_terms(rows, "terms", self.max_features, self.min_df)
        if stats is None:
            stats = term_stats(corpus, self.ngrams)
        return top_terms(stats, self.max_features, self.min_df)

    def fit(self, corpus: DataFrame) -> TermModel:
        return self._fit(corpus, tfidf=False)

    def _fit(self, corpus: DataFrame, tfidf: bool, mode: str = "smooth", **options) -> TermModel:
        n_docs = corpus.count()
        frame = self.vocabulary_frame(corpus).withColumn("idf", idf(F.col("df"), F.lit(n_docs), mode))
        # at most max_features rows
        rows = sorted(frame.select("term", "idx", "tf", "df", "idf").collect(), key=lambda r: r["idx"])
        if not rows:
            raise ValueError("no term left for the vocabulary")
        return TermModel(self.name, corpus.sparkSession, rows, n_docs, self.ngrams, tfidf, **options)


@dataclass
class TfIdf(BagOfWords):
    """(1 + ln tf) * idf over the vocabulary, rows scaled to length 1."""

    name: str = "tfidf"
    min_df: int = MIN_DF
    sublinear: bool = True
    idf_mode: str = "smooth"
    norm: bool = True

    def fit(self, corpus: DataFrame) -> TermModel:
        return self._fit(corpus, tfidf=True, mode=self.idf_mode, sublinear=self.sublinear, norm=self.norm)
