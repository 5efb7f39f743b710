"""Subword vectors: character n-grams of a word hashed to buckets, so unseen words have a vector too."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textyard.functions import text as tx
from textyard.functions.hashing import BUCKET_FUNCTIONS
from textyard.operators import cooccur
from textyard.operators.contract import Model, Vectorizer
from textyard.operators.pooling import id_sums, mean_pool, table_bytes, with_ids
from textyard.operators.wordvec import trained_words
from textyard.session import cut_lineage, fan_out, lookup_join
from textyard.sources.tables import token_rows, with_tokens

SEED = 42
# Fixed value: the number of buckets of the public subword trainer.
BUCKETS = 2_000_000


def gram_buckets(word: str, buckets: int, low: int = 3, high: int = 6, hashing: str = "md5") -> Column:
    """Bucket number of every character n-gram of a word; repeats are kept."""
    bucket = BUCKET_FUNCTIONS[hashing]
    return F.transform(tx.char_ngrams(word, low, high), lambda g: bucket(g, buckets))


def subword_vectors(
    words: DataFrame,
    buckets: DataFrame,
    n_buckets: int,
    dim: int,
    known: DataFrame | None = None,
    n_vectors: int | None = None,
    low: int = 3,
    high: int = 6,
    hashing: str = "md5",
    single: bool = False,
) -> DataFrame:
    """``(word, vector)`` of distinct ``words``, unseen ones included.

    A word is the mean of its n-grams' bucket vectors ``(bucket, vector)`` and, if it is in
    ``known`` ``(word, vector)``, of its own vector. That is mean pooling over the parts of a
    word instead of the words of a document. ``n_vectors`` is the number of vectors in both tables, if it is known;
    buckets without a vector are left out.
    """
    if n_vectors is None:
        n_vectors = buckets.count() + (0 if known is None else known.count())
    parts = F.transform(gram_buckets("word", n_buckets, low, high, hashing), lambda b: F.concat(F.lit("b"), b))
    parts = F.concat(parts, F.array(F.concat(F.lit("w"), "word")))
    narrow = F.col("vector").cast("array<float>").alias("vector")
    table = buckets.select(F.concat(F.lit("b"), "bucket").alias("word"), narrow)
    if known is not None:
        table = table.unionByName(known.select(F.concat(F.lit("w"), "word").alias("word"), narrow))
    return mean_pool(fan_out(words).select("word", parts.alias("tokens")), table, dim, n_vectors, "word", single=single, value_bytes=4)


@dataclass
class SubwordModel(Model):
    """Bucket and word vectors; any token, unseen ones included, gets a vector."""

    name: str
    words: DataFrame
    buckets: DataFrame
    n_words: int
    n_vectors: int
    n_buckets: int
    dim: int
    low: int
    high: int
    hashing: str

    def save(self, path: str) -> None:
        self.words.write.parquet(f"{path}/words")
        self.buckets.write.parquet(f"{path}/buckets")

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, n_buckets: int = BUCKETS, low: int = 3, high: int = 6,
        hashing: str = "md5", name: str = "fasttext",
    ) -> SubwordModel:
        """The n-gram settings must be those the model was trained with."""
        words, buckets = spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/buckets")
        n, dim = words.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        return cls(name, words, buckets, n, buckets.count(), n_buckets, dim or 0, low, high, hashing)

    def word_vectors(self, words: DataFrame) -> DataFrame:
        return subword_vectors(
            words, self.buckets, self.n_buckets, self.dim, self.words, self.n_words + self.n_vectors, self.low, self.high, self.hashing, single=True
        )

    def pool(self, corpus: DataFrame, row_id: str = "doc_id") -> DataFrame:
        """Mean over all tokens; each distinct token is built once."""
        corpus = with_tokens(corpus)
        distinct = token_rows(corpus).distinct()
        table = cut_lineage(self.word_vectors(distinct))
        return mean_pool(corpus, table, self.dim, table.count(), row_id)

    def transform(self, corpus: DataFrame, row_id: str = "doc_id") -> DataFrame:
        return self.pool(corpus, row_id).withColumn("features", array_to_vector("vector")).drop("vector")


def bucket_vectors(words: DataFrame, n: int, buckets: int, dim: int, low: int, high: int, hashing: str) -> DataFrame:
    """``(bucket, vector)``: the mean over the n-grams in a bucket of the vectors of their words, ``n`` rows ``(word, fixed)``.

    Words meet their buckets as numbers, and the sums are taken with some columns of the vectors at a time, so what is shuffled
    is narrow. Words whose hashes pass the broadcast budget are joined to their vectors instead.
    """
    found = cooccur.hashes_apart(words, n)
    if found is not None:
        hashes, seed = found
        grams = fan_out(words.select("word")).select(cooccur.hash_of("word", seed).alias("_hash"), F.explode(tx.char_ngrams("word", low, high)).alias("_gram"))
        grams = grams.select("_hash", BUCKET_FUNCTIONS[hashing](F.col("_gram"), buckets).alias("_row"))
        lists = grams.repartition("_row").groupBy("_row").agg(F.collect_list("_hash").alias("_hashes"))
        sums = id_sums(cut_lineage(with_ids(lists, ["_row"], hashes)), words.select(cooccur.hash_of("word", seed).alias("_hash"), F.col("fixed").alias("vector")), hashes, dim)
        return sums.select(F.col("_row").alias("bucket"), cooccur.unfix(F.col("_sums"), dim, F.col("_times")).alias("vector"))
    grams = fan_out(words.select("word")).select("word", F.explode(gram_buckets("word", buckets, low, high, hashing)).alias("bucket"))
    found = lookup_join(grams.repartition("bucket"), words.select("word", "fixed"), "word", table_bytes(n, dim))
    sums = cooccur.sum_arrays(found, ["bucket"], "fixed", dim)
    return sums.select("bucket", cooccur.unfix(F.col("sums"), dim, F.col("times")).alias("vector"))


@dataclass
class SubwordCoOccurrence(Vectorizer):
    """Co-occurrence vectors shared by spelling: a word is the mean of its own vector and its n-grams'.

    An n-gram's vector is the mean over the words it occurs in, so a word never seen takes after those spelled like it.
    """

    vector_size: int = 100
    window: int = 5
    min_count: int = 2
    min_n: int = 3
    max_n: int = 6
    buckets: int = BUCKETS
    hashing: str = "md5"
    seed: int = SEED
    name: str = "fasttext"

    def fit(self, corpus: DataFrame) -> SubwordModel:
        own, n = trained_words(corpus, self.vector_size, self.window, self.min_count, self.seed)
        means = bucket_vectors(own, n, self.buckets, self.vector_size, self.min_n, self.max_n, self.hashing)
        # as they are read: half the size
        table = cut_lineage(means.withColumn("vector", F.col("vector").cast("array<float>")))
        words = own.select("word", cooccur.unfix(F.col("fixed"), self.vector_size).alias("vector"))
        return SubwordModel(self.name, words, table, n, table.count(), self.buckets, self.vector_size, self.min_n, self.max_n, self.hashing)
