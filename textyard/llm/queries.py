"""Registered queries of the operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from textyard.llm import (
    attribution, collocations, conversations, hnsw, host_rules, licences, line_dedup, mixing, ngram_join, packing, quality, topk,
    toxicity,
)
from textyard.llm.common import table
from textyard.llm.setjoin import Likeness

QUERIES: dict[str, Callable] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op1_embedding_neardup(spark, folder) -> DataFrame:
    return hnsw.near_duplicates(table(spark, folder, "embeddings"))


@query
def op2_mixing(spark, folder) -> DataFrame:
    return mixing.plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_ngram_join(spark, folder) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"), Likeness(words=3, percent=90))


@query
def op4_token_sections(spark, folder) -> DataFrame:
    return attribution.tokens_by_line(table(spark, folder, "documents"))


@query
def op5_line_dedup(spark, folder) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, folder, "documents"))


@query
def op6_packing(spark, folder) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op7_quality(spark, folder) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_topk(spark, folder) -> DataFrame:
    return topk.top_inner_products(table(spark, folder, "embeddings"))


@query
def op9_toxicity(spark, folder) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_licences(spark, folder) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


@query
def op11_host_rules(spark, folder) -> DataFrame:
    return host_rules.judge(table(spark, folder, "documents"))


@query
def op12_conversation_repair(spark, folder) -> DataFrame:
    return conversations.repair(table(spark, folder, "conversations"))


@query
def op13_collocations(spark, folder) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query
def pipeline(spark, folder) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


# Sums of integers below 2**53 are exact in doubles; components are floats widened to doubles, as in the query.
OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_topk": OP8, "op10_licences": licences.scan_sql(), "op11_host_rules": host_rules.judge_sql(),
        "op12_conversation_repair": conversations.repair_sql(), "op13_collocations": collocations.collocations_sql(),
    }
