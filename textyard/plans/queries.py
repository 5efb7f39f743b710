"""Registered queries: each runs one operator over whole tables of the given folder."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from textyard.functions import sql as sql_functions, text as tx
from textyard.functions.hashing import md5_bucket, md5_int
from textyard.operators import classify, cooccur, metrics, pooling, prepare, project, reports, sampling, subword, terms, wordvec
from textyard.plans import benchmark, datasets
from textyard.session import cut_lineage, fan_out, kept
from textyard.sources import results as res, reviews, vectors
from textyard.sources.tables import documents, labelled, table, token_rows, with_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Words seen at least this often get a vector in the stand-in word-vector table.
KNOWN_MIN_COUNT = 5
CAP_PER_SOURCE = 5
PAGE_SPAN = 100
REVIEW_TARGET = 3

# Methods of the report queries: fixed predictors whose results the SQL twins can compute too. Key, display name,
# family, place in the tables. None predicts with "neighbours", so that a missing result shows.
RULES = (
    ("keyword", "Keywords", "Rule", 1),
    ("length", "Text length", "Rule", 2),
    ("majority", "Always 0", "Baseline", 3),
    ("neighbours", "Neighbours", "Rule", 4),
)


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def token_frame(spark: SparkSession, folder: str) -> DataFrame:
    return with_tokens(documents(spark, folder))


# Sources ---------------------------------------------------------------------------


@query
def scan_labelled(spark, folder):
    return labelled(spark, folder, "text")


@query
def vector_table(spark, folder):
    line = F.concat_ws(" ", F.concat(F.lit("v"), F.col("vec_id")), F.transform("embedding", lambda v: v.cast("string")))
    lines = table(spark, folder, "embeddings").select(line.alias("value"))
    parsed = lines.select(*vectors.parse_vector_line(F.col("value")))
    return pooling.long_form(parsed, "word", "vector", 6)


@query
def dedupe_last(spark, folder):
    return vectors.dedupe_last(table(spark, folder, "conversations"), "conv_id", "turn")


def review_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as nested review pages in JSON text, at most PAGE_SPAN reviews a page, in the order of their ids."""
    docs = labelled(spark, folder, "text", "source").withColumn("page", F.expr(f"doc_id div {PAGE_SPAN}"))
    review = F.struct(
        "doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n")).alias("review"),
        F.when(F.col("label") == 1, F.lit(True)).alias("voted_up"),
    )
    name = F.concat_ws(":", "source", "page")
    pages = docs.groupBy("source", "page").agg(F.array_sort(F.collect_list(review)).alias("reviews"))
    page = F.struct((md5_int(name, 1) > 0).cast("int").alias("success"), name.alias("cursor"), "reviews")
    return pages.select("source", "page", F.to_json(page).alias("body"))


@query
def reviews_flatten(spark, folder):
    pages = review_pages(spark, folder).select("source", "page", reviews.parse_page(F.col("body")).alias("p"))
    return reviews.flatten_reviews(pages.select("source", "page", "p.*"), "source", "page")


@query
def reviews_until(spark, folder):
    pages = review_pages(spark, folder).select("source", "page", reviews.parse_page(F.col("body")).alias("p"))
    return reviews.take_reviews(pages.select("source", "page", "p.*"), REVIEW_TARGET)


# Preparation -----------------------------------------------------------------------


@query
def binarise(spark, folder):
    docs = documents(spark, folder)
    flags = table(spark, folder, "labels").select(
        "doc_id", "toxic", (1 - F.col("quality")).alias("poor"), F.lit(None).cast("int").alias("unknown")
    )
    return prepare.binarise(docs.join(flags, "doc_id"), "text", ["toxic", "poor", "unknown"], "doc_id")


@query
def length_filter(spark, folder):
    kept = prepare.length_filter(documents(spark, folder))
    return kept.select("doc_id", F.length("text").cast("bigint").alias("n"), "text")


@query
def class_totals(spark, folder):
    return prepare.class_counts(labelled(spark, folder))


@query
def class_balance(spark, folder):
    return prepare.class_balance(labelled(spark, folder))


@query
def group_breakdown(spark, folder):
    return prepare.group_breakdown(labelled(spark, folder, "source"), "source")


@query
def class_weights(spark, folder):
    weights = classify.class_weights(labelled(spark, folder))
    return weights.select("label", "n", F.round("weight", 6).alias("weight"))


@query
def prepare_comments(spark, folder):
    flags = table(spark, folder, "labels").select("doc_id", "toxic", (1 - F.col("quality")).alias("poor"))
    rows = documents(spark, folder).join(flags, "doc_id")
    return datasets.prepare_comments(rows, "text", ["toxic", "poor"], None)


@query
def prepare_reviews(spark, folder):
    return datasets.prepare_reviews(labelled(spark, folder, "text", label="quality"))


# Sampling --------------------------------------------------------------------------


@query
def shuffled(spark, folder):
    return sampling.shuffled_ranks(table(spark, folder, "documents", "doc_id"))


@query
def balance_n(spark, folder):
    docs = labelled(spark, folder)
    majority = docs.filter(F.col("label") == 0).count()
    return sampling.balance_n(docs, majority)


@query
def balance_min(spark, folder):
    return sampling.balance_min(labelled(spark, folder))


@query
def projection_subset(spark, folder):
    return sampling.projection_subset(labelled(spark, folder))


@query
def balance_and_split(spark, folder):
    return sampling.balance_and_split(labelled(spark, folder))


@query
def stratified_split(spark, folder):
    return sampling.stratified_split(labelled(spark, folder))


@query
def cap_per_group(spark, folder):
    docs = prepare.length_filter(documents(spark, folder, "doc_id", "text", "source"))
    return sampling.cap_per_group(docs.select("doc_id", "source"), "source", CAP_PER_SOURCE)


@query
def bootstrap_draw(spark, folder):
    docs = labelled(spark, folder)
    sizes = {r["label"]: r["n"] for r in prepare.class_counts(docs).collect()}
    minority = docs.filter(F.col("label") == 1).select("doc_id")
    return sampling.draw_with_replacement(minority, sizes.get(0, 0), sizes.get(1, 1))


# Text ------------------------------------------------------------------------------


@query
def strip_urls(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    return pages.select("page_id", tx.strip_urls(F.lower(F.concat_ws(" ", "url", "html"))).alias("stripped"))


@query
def strip_html(spark, folder):
    return table(spark, folder, "pages", "page_id", "html").select("page_id", tx.strip_html("html").alias("stripped"))


@query
def strip_nonalnum(spark, folder):
    return documents(spark, folder).select("doc_id", tx.strip_nonalnum(F.lower("text")).alias("stripped"))


@query
def normalise_space(spark, folder):
    return documents(spark, folder).select("doc_id", tx.normalise_space("text").alias("normal"))


@query
def clean_text(spark, folder):
    return documents(spark, folder).select("doc_id", tx.clean("text").alias("clean"))


@query
def tokens(spark, folder):
    rows = documents(spark, folder).select("doc_id", tx.tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@query
def stopwords_removed(spark, folder):
    rows = documents(spark, folder).select("doc_id", tx.words("text").alias("w"))
    kept = rows.select("doc_id", "w", tx.without_stopwords("w").alias("k"))
    return kept.select("doc_id", (F.size("w") - F.size("k")).cast("bigint").alias("n_removed"), F.array_join("k", " ").alias("kept"))


@query
def ngrams(spark, folder):
    rows = token_frame(spark, folder).select("doc_id", tx.ngrams("tokens").alias("g"))
    return rows.select("doc_id", F.size("g").cast("bigint").alias("n_grams"), F.array_join("g", "|").alias("grams"))


@query
def char_ngrams(spark, folder):
    words = wordvec.word_counts(token_frame(spark, folder), 1).select("word")
    return fan_out(words).select("word", F.array_join(tx.char_ngrams("word"), "|").alias("grams"))


def in_sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A statement with the cleaner's SQL functions over the documents."""
    sql_functions.register(spark)
    return spark.sql(text, documents=documents(spark, folder))


@query
def sql_clean_text(spark, folder):
    return in_sql(spark, folder, "SELECT doc_id, clean_text(text) AS clean FROM {documents}")


@query
def sql_tokens(spark, folder):
    return in_sql(spark, folder, """
        SELECT doc_id, CAST(size(t) AS BIGINT) AS n_tokens, array_join(t, '|') AS tokens
        FROM (SELECT doc_id, text_tokens(text) AS t FROM {documents})""")


@query
def sql_ngrams(spark, folder):
    return in_sql(spark, folder, """
        SELECT doc_id, CAST(size(g) AS BIGINT) AS n_grams, array_join(g, '|') AS grams
        FROM (SELECT doc_id, text_bigrams(text_tokens(text)) AS g FROM {documents})""")


# Bag of words and TF-IDF ------------------------------------------------------------


@query
def term_stats(spark, folder):
    return terms.term_stats(token_frame(spark, folder))


@query
def vocab_size(spark, folder):
    stats = terms.term_stats(token_frame(spark, folder))
    unigram = ~F.col("term").contains(" ")
    return stats.agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.count_if(F.col("df") >= terms.MIN_DF).alias("n_min_df"),
        F.count_if(unigram & (F.col("tf") >= 2)).alias("n_words"),
    )


@query
def bow_vocab(spark, folder):
    return terms.BagOfWords().vocabulary_frame(token_frame(spark, folder))


@query
def tfidf_vocab(spark, folder):
    return terms.TfIdf().vocabulary_frame(token_frame(spark, folder))


@query
def idf(spark, folder):
    docs = token_frame(spark, folder)
    n_docs = F.lit(docs.count())
    vocabulary = terms.TfIdf().vocabulary_frame(docs)
    return vocabulary.select(
        "term", "df", F.round(terms.idf(F.col("df"), n_docs), 6).alias("smooth"),
        F.round(terms.idf(F.col("df"), n_docs, "plain"), 6).alias("plain"),
    )


@query
def bow_transform(spark, folder):
    docs = token_frame(spark, folder)
    return terms.term_counts(docs, terms.BagOfWords().vocabulary_frame(docs))


@query
def tfidf_transform(spark, folder):
    docs = token_frame(spark, folder)
    rows = terms.TfIdf().fit(docs).transform_long(docs)
    return rows.withColumn("weight", F.round("weight", 6))


@query
def w2v_vocab(spark, folder):
    return wordvec.word_counts(token_frame(spark, folder))


# Word vectors ----------------------------------------------------------------------


def word_table(spark: SparkSession, folder: str, docs: DataFrame) -> tuple[DataFrame, int, int]:
    """A stand-in for a pretrained table: frequent words mapped to rows of ``embeddings``.

    Returns the stored frame ``(word, vec_id, vector)``, its row count and its width.
    """
    emb = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n, dim = emb.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    words = wordvec.word_counts(docs, KNOWN_MIN_COUNT).select("word", md5_bucket(F.col("word"), n).alias("vec_id"))
    known = cut_lineage(words.join(emb, "vec_id"))
    return known, known.count(), dim


@query
def oov_inner_join(spark, folder):
    docs = token_frame(spark, folder)
    known, n, dim = word_table(spark, folder, docs)
    return pooling.known_tokens(docs, known.select("word", "vec_id"), pooling.table_bytes(n, 1))


@query
def oov_tokens(spark, folder):
    docs = token_frame(spark, folder)
    known, n, dim = word_table(spark, folder, docs)
    return pooling.unknown_tokens(docs, known, pooling.table_bytes(n, 1))


@query
def mean_pool(spark, folder):
    docs = token_frame(spark, folder)
    known, n, dim = word_table(spark, folder, docs)
    model = wordvec.Pretrained(known.select("word", "vector"), dim).fit(docs)
    return pooling.long_form(model.pool(docs))


@query
def mean_pool_join(spark, folder):
    """The same pooling with room for a third of the word vectors, so that the rest is joined."""
    docs = token_frame(spark, folder)
    known, n, dim = word_table(spark, folder, docs)
    pooled = pooling.mean_pool(docs, known.select("word", "vector"), dim, n, budget=pooling.table_bytes(n, dim) // 3)
    return pooling.long_form(pooled)


def vocabulary_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """Pairs of words seen twice or more by their ids, the words and their size."""
    docs = token_frame(spark, folder)
    words = cut_lineage(wordvec.word_counts(docs).select("word"))
    n, size = words.agg(F.count(F.lit(1)), F.sum(F.octet_length("word") + 64)).first()
    pairs, words = cooccur.vocabulary_pairs(docs, words, n, size or 0)
    return pairs, cut_lineage(words), size or 0


@query
def word_pairs(spark, folder):
    return cooccur.named(*vocabulary_pairs(spark, folder))


@query
def word_pmi(spark, folder):
    pairs, words, size = vocabulary_pairs(spark, folder)
    pmi = cooccur.named(cooccur.word_pmi(kept(pairs), size), words, size)
    return pmi.select("a", "b", F.round("pmi", 6).alias("pmi"))


def _digest(rows: DataFrame, key: str) -> DataFrame:
    """A vector in a few figures: its width, length, ends, and sums plain and weighted by place."""
    v = F.col("vector")
    rows = rows.withColumn("vector", v.cast("array<double>"))
    ramp = F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        key, F.size(v).cast("bigint").alias("n_dims"), _rounded(F.sqrt(_squares("vector")), "norm"), _rounded(v[0], "first"),
        _rounded(F.element_at(v, -1), "last"), _rounded(total, "total"), _rounded(ramp, "ramp"),
    )


def _rounded(value, name: str):
    """Four places, minus zero as zero."""
    return (F.round(value, 4) + F.lit(0.0)).alias(name)


@query
def word2vec_vectors(spark, folder):
    return _digest(wordvec.CoOccurrence().fit(token_frame(spark, folder)).vectors, "word")


@query
def word2vec_docs(spark, folder):
    docs = token_frame(spark, folder)
    return _digest(wordvec.CoOccurrence().fit(docs).pool(docs), "doc_id")


@query
def subword_vectors(spark, folder):
    docs = token_frame(spark, folder)
    known, n, dim = word_table(spark, folder, docs)
    emb = table(spark, folder, "embeddings").select(F.col("vec_id").alias("bucket"), F.col("embedding").alias("vector"))
    words = token_rows(docs).distinct()
    built = subword.subword_vectors(words, emb, emb.count(), dim, known.select("word", "vector"), n)
    v = F.col("vector")
    ramp = F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return built.select(
        "word", F.round(v[0], 4).alias("first"), F.round(F.element_at(v, -1), 4).alias("last"),
        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(ramp, 4).alias("ramp"),
    )


@query
def fasttext_vectors(spark, folder):
    model = subword.SubwordCoOccurrence().fit(token_frame(spark, folder))
    return _digest(model.word_vectors(model.words.select("word")), "word")


@query
def fasttext_docs(spark, folder):
    docs = token_frame(spark, folder)
    return _digest(subword.SubwordCoOccurrence().fit(docs).pool(docs), "doc_id")


def _squares(vector: str):
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


# Classifier and metrics --------------------------------------------------------------


def keyword_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed predictor: an insult word, or one row in sixteen whatever its text."""
    insult = F.lower("text").rlike(INSULT)
    noise = md5_int(F.concat(F.col("doc_id").cast("string"), F.lit(":noise")), 1) == 0
    docs = labelled(spark, folder, "text")
    return docs.select("doc_id", "label", (insult | noise).cast("int").alias("prediction"))


@query
def lr_score(spark, folder):
    """Scores with given coefficients: log odds of a term's document share in the classes."""
    docs = with_tokens(labelled(spark, folder, "text"))
    sizes = {r["label"]: r["n"] for r in prepare.class_counts(labelled(spark, folder)).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = cut_lineage(terms.term_counts(docs, terms.TfIdf().vocabulary_frame(docs)))
    label = labelled(spark, folder)
    seen = counts.join(label, "doc_id").groupBy("idx").agg(
        F.count_if(F.col("label") == 1).alias("d1"), F.count_if(F.col("label") == 0).alias("d0")
    )
    coef = F.log((F.col("d1") + 1) / F.lit(n1 + 2)) - F.log((F.col("d0") + 1) / F.lit(n0 + 2))
    entries = counts.select("doc_id", "idx", F.col("cnt").cast("double").alias("weight"))
    intercept = math.log((n1 + 1) / (n0 + 1))
    scored = classify.linear_scores(label, entries, seen.select("idx", coef.alias("coef")), intercept)
    return scored.withColumn("score", F.round("score", 4))


def plain_features(spark: SparkSession, folder: str) -> DataFrame:
    """Two figures of each labelled document: a tenth of the logarithm of its length, and whether it has an insult."""
    docs = labelled(spark, folder, "text", "n_chars")
    figures = F.array(F.log(F.col("n_chars") + 1.0) / 10, F.lower("text").rlike(INSULT).cast("double"))
    return docs.select("doc_id", "label", figures.alias("features"))


@query
def lr_newton(spark, folder):
    """The optimum of the class-weighted classifier on two features; the intercept has the last place."""
    model = classify.fit_logistic(plain_features(spark, folder))
    entries = [(i, float(round(c, 6))) for i, c in enumerate([*model.coefficients, model.intercept])]
    return spark.createDataFrame(entries, "idx bigint, coef double")


@query
def lr_dense(spark, folder):
    """Scores on the test split of a classifier trained on pooled vectors, and whether its gradient vanishes."""
    known, n, dim = word_table(spark, folder, token_frame(spark, folder))
    docs = with_tokens(sampling.stratified_split(labelled(spark, folder, "text")))
    ready = cut_lineage(pooling.mean_pool(docs, known.select("word", "vector"), dim, n).withColumnRenamed("vector", "features"))
    model = classify.fit_logistic(ready.filter(F.col("split") == "train"))
    scored = classify.predict(model, ready.filter(F.col("split") == "test"))
    return metrics.evaluate(scored).withColumn("at_optimum", F.lit(bool(model.gradient_norm < 1e-5)))


@query
def lr_metrics(spark, folder):
    docs = with_tokens(sampling.stratified_split(labelled(spark, folder, "text")))
    train = docs.filter(F.col("split") == "train")
    ready = terms.TfIdf().fit(train).transform(docs)
    model = classify.fit_logistic(ready.filter(F.col("split") == "train"))
    return metrics.evaluate(classify.predict(model, ready.filter(F.col("split") == "test")))


@query
def confusion(spark, folder):
    return metrics.confusion(keyword_predictions(spark, folder))


@query
def scores(spark, folder):
    return metrics.evaluate(keyword_predictions(spark, folder))


QUERIES["metrics"] = QUERIES.pop("scores")


@query
def class_report(spark, folder):
    classes = metrics.per_class(metrics.confusion(keyword_predictions(spark, folder)))
    return metrics.class_report(classes, reports.CLASS_NAMES["toxic"])


# Reports -----------------------------------------------------------------------------


INSULT = r"\b(idiot|moron|stupid)"


def rule_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result records of the fixed predictors on both labels of the documents.

    The cost columns hold counted work instead of seconds, so that reruns agree: millions of characters read to
    fit and to transform (the length rule reads the corpus for its mean). Stored, since reports read it twice.
    """
    docs = table(spark, folder, "documents", "doc_id", "text", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    mean = docs.agg(F.avg("n_chars").alias("mean_chars"))
    predictions = {
        "keyword": F.coalesce(F.lower("text").rlike(INSULT), F.lit(False)).cast("int"),
        "length": F.coalesce(F.col("n_chars") > F.col("mean_chars"), F.lit(False)).cast("int"),
        "majority": F.lit(0),
    }
    cells = [
        F.struct(F.lit(dataset).alias("dataset"), F.col(label).alias("label"), F.lit(rule).alias("vectorizer"), given.alias("prediction"))
        for dataset, label in (("toxic", "toxic"), ("review", "quality"))
        for rule, given in predictions.items()
    ]
    rows = docs.join(F.broadcast(mean)).select("n_chars", F.inline(F.array(*cells)))
    by = ["dataset", "vectorizer"]
    cells = cut_lineage(rows.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")))
    scored = metrics.scores(metrics.per_class(cells, by), by)
    chars = cells.groupBy(*by).agg(F.sum("chars").alias("chars"))
    rule, read = F.col("vectorizer"), F.round(F.col("chars") / 1_000_000, 3)
    width = F.when(rule == "keyword", 3).when(rule == "length", 1).otherwise(0).cast("bigint")
    fit = F.when(rule == "length", read).otherwise(F.lit(0.0))
    transform = F.when(rule == "majority", F.lit(0.0)).otherwise(read)
    costs = [c.alias(name) for c, name in zip((fit, transform, F.lit(0.0)), res.TIMES)]
    return cut_lineage(scored.join(chars, by).select(*by, width.alias("embedding_dim"), *costs, *res.SCORES))


@query
def results_scan(spark, folder):
    records = rule_results(spark, folder)
    fields = [c for c in records.columns if c != "dataset"]
    files = records.groupBy("dataset").agg(F.to_json(F.collect_list(F.struct(*fields))).alias("body"))
    return files.select("dataset", F.inline(res.parse_results(F.col("body"))))


@query
def results_union(spark, folder):
    records = rule_results(spark, folder)
    sparse = F.col("vectorizer") == "keyword"
    return res.results_union(records.filter(sparse), None, records.filter(~sparse).drop("classifier_train_time_s"))


@query
def leaderboard(spark, folder):
    board = reports.leaderboard(rule_results(spark, folder), RULES)
    # pandas, which compares the results, holds integers with nulls as floats
    return board.withColumn("embedding_dim", F.col("embedding_dim").cast("double"))


@query
def tradeoff(spark, folder):
    return reports.tradeoff(rule_results(spark, folder))


@query
def metrics_long(spark, folder):
    return reports.metrics_long(rule_results(spark, folder))


@query
def metrics_matrix(spark, folder):
    return reports.metrics_matrix(rule_results(spark, folder))


@query
def f1_by_method(spark, folder):
    return reports.f1_by_method(rule_results(spark, folder))


@query
def best_method(spark, folder):
    return metrics.best_method(rule_results(spark, folder))


# Projection --------------------------------------------------------------------------


@query
def project_2d(spark, folder):
    emb = table(spark, folder, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    return project.project_2d(emb)


def subset_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, label, vector)``: an equal number of labelled documents of each class, pooled with the word table."""
    docs = token_frame(spark, folder)
    known, n, dim = word_table(spark, folder, docs)
    chosen = sampling.projection_subset(labelled(spark, folder, "text"))
    return cut_lineage(pooling.mean_pool(with_tokens(chosen), known.select("word", "vector"), dim, n))


@query
def project_variance(spark, folder):
    """Variance along the first two axes of the documents' vectors."""
    axes = project.principal_axes(project.covariance(subset_vectors(spark, folder)))
    return axes.select("component", F.round("variance", 6).alias("variance"), F.round("share", 6).alias("share"))


@query
def project_documents(spark, folder):
    """The documents on these two axes."""
    rows = subset_vectors(spark, folder)
    placed = project.on_axes(rows, project.principal_axes(project.covariance(rows)))
    return placed.select("doc_id", "label", _rounded(F.col("places")[0], "x"), _rounded(F.col("places")[1], "y"))


@query
def class_centroids(spark, folder):
    return project.class_centroids(table(spark, folder, "embeddings"), "label", "embedding")


@query
def class_separation(spark, folder):
    emb = table(spark, folder, "embeddings").select("label", array_to_vector("embedding").alias("features"))
    value = project.class_separation(emb)
    return emb.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("silhouette", F.round(F.lit(value), 6))


# Benchmark ---------------------------------------------------------------------------


@query
def benchmark_tfidf(spark, folder):
    return benchmark.run_benchmark(labelled(spark, folder, "text"), "toxic", ["tfidf"])


@query
def benchmark_reports(spark, folder):
    """Precision, recall and F1 of every class in a real run."""
    return benchmark.run_with_reports(labelled(spark, folder, "text"), "toxic", ["bow", "tfidf"])[1]


@query
def benchmark_datasets(spark, folder):
    """Both labels of the documents in one run, merged into one table with the methods that did not run flagged."""
    corpora = {d: lambda c=column: labelled(spark, folder, "text", label=c) for d, column in (("toxic", "toxic"), ("review", "quality"))}
    results, _ = benchmark.run_datasets(spark, corpora, ["bow", "tfidf"], whole=True)
    return reports.leaderboard(results)


@query
def benchmark_all(spark, folder):
    corpus = labelled(spark, folder, "text")
    known, _, dim = word_table(spark, folder, with_tokens(documents(spark, folder)))
    return benchmark.run_benchmark(
        corpus, "toxic", vectors=known.select("word", "vector"), vector_size=dim
    )
