"""Word vectors, trained or pretrained, and documents as their mean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from textyard.operators import cooccur
from textyard.operators.contract import Model, Vectorizer
from textyard.operators.pooling import mean_pool
from textyard.session import cut_lineage, kept
from textyard.sources.tables import token_rows, with_tokens
from textyard.sources.vectors import dedupe_last, read_vector_text

SEED = 42


def word_counts(corpus: DataFrame, min_count: int = 2) -> DataFrame:
    """Corpus frequency of words seen at least ``min_count`` times."""
    rows = token_rows(corpus)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("tf")).filter(F.col("tf") >= min_count)


@dataclass
class WordVectorModel(Model):
    """A table ``(word, vector)`` of known size; documents are the mean of known words."""

    name: str
    vectors: DataFrame
    dim: int
    n_vectors: int

    def pool(self, corpus: DataFrame, row_id: str = "doc_id") -> DataFrame:
        return mean_pool(corpus, self.vectors, self.dim, self.n_vectors, row_id)

    def transform(self, corpus: DataFrame, row_id: str = "doc_id") -> DataFrame:
        return self.pool(corpus, row_id).withColumn("features", array_to_vector("vector")).drop("vector")

    def save(self, path: str) -> None:
        self.vectors.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, name: str = "word2vec") -> WordVectorModel:
        table = spark.read.parquet(path)
        n, dim = table.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        return cls(name, table, dim or 0, n)


def trained_words(corpus: DataFrame, dim: int, window: int, min_count: int, seed: int) -> tuple[DataFrame, int]:
    """``(word, fixed)`` of the words seen ``min_count`` times, from what stands beside them, and their number."""
    corpus = with_tokens(corpus).select("tokens")
    vocabulary = cut_lineage(word_counts(corpus, min_count).select("word"))
    n, size = vocabulary.agg(F.count(F.lit(1)), F.sum(F.octet_length("word") + 64)).first()
    pairs, words = cooccur.vocabulary_pairs(corpus, vocabulary, n, size or 0, window)
    pmi = cooccur.word_pmi(kept(pairs), size or 0)
    return cut_lineage(cooccur.project(pmi, cut_lineage(words), size or 0, dim, seed)), n


@dataclass
class CoOccurrence(Vectorizer):
    """Word vectors from the words around: positive pointwise mutual information, projected on random signs.

    Counts, joins and whole-number sums; the same vectors on any number of cores and in any order of the rows.
    """

    vector_size: int = 100
    window: int = 5
    min_count: int = 2
    seed: int = SEED
    name: str = "word2vec"

    def fit(self, corpus: DataFrame) -> WordVectorModel:
        words, n = trained_words(corpus, self.vector_size, self.window, self.min_count, self.seed)
        vectors = words.select("word", cooccur.unfix(F.col("fixed"), self.vector_size).alias("vector"))
        return WordVectorModel(self.name, vectors, self.vector_size, n)


@dataclass
class Pretrained(Vectorizer):
    """Word vectors from a text file or a frame ``(word, vector)``; the corpus is not used.

    A frame may have ``seq``; the last vector of a repeated word wins.
    """

    source: str | DataFrame
    vector_size: int = 100
    name: str = "glove"

    def fit(self, corpus: DataFrame) -> WordVectorModel:
        if isinstance(self.source, DataFrame):
            table = self.source
        else:
            table = read_vector_text(corpus.sparkSession, self.source)
        if "seq" in table.columns:
            table = cut_lineage(dedupe_last(table, "word", "seq"))
        n, low, high = table.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if n and (low, high) != (self.vector_size, self.vector_size):
            raise ValueError(f"vectors are {low} to {high} wide, expected {self.vector_size}")
        return WordVectorModel(self.name, table.select("word", "vector"), self.vector_size, n)
