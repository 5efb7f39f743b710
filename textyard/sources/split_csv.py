"""Quoted, multi-line CSV read by many tasks a file.

Spark splits a file into blocks of lines, but a record may run over lines and blocks. Whether a block begins inside
quotes follows from the number of quotes ahead of it: blocks are counted in one pass, their parities summed along each
file, and a second pass puts lines together from the first true record of each block. The pieces of records that
cross blocks, two a block at most, are joined at last.

A quote is doubled inside a quoted field and stands in no unquoted one, as CSV writers do it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textyard.session import cut_lineage

# Records put out at a time.
BATCH = 5_000

PIECES = "file string, block bigint, n bigint, kind string, text string"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, line)``; the lines of a block follow each other in one task."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def inside_quotes(rows: DataFrame) -> DataFrame:
    """``(file, block)`` of the blocks that begin inside quotes."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    odd = rows.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    # one row a block
    ahead = F.sum("odd").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return odd.withColumn("ahead", ahead).where("ahead % 2 = 1").select("file", "block")


def _assemble(shared):
    """Lines of whole blocks -> records: ``whole``, or ``head`` and ``tail`` of one that crosses the block's ends.

    A block in the middle of a long record is a tail that stays open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, n, open_, first, held, out = shared.value, None, 0, False, False, [], []

        def closed():
            """The pieces that the end of a block leaves."""
            if held:
                out.append((*at, n, "tail" if first else "head" if open_ else "whole", "\n".join(held)))

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    if at is not None:
                        closed()
                    at, n, held = (file, block), 0, []
                    first = open_ = at in begun
                held.append(line)
                open_ ^= line.count('"') % 2 == 1
                if not open_:
                    text = "\n".join(held)
                    out.append((*at, n, "tail" if first else "whole", text.removesuffix("\r")))
                    n, held, first = n + 1, [], False
            if len(out) >= BATCH:
                yield _batch(out)
                out.clear()
        if at is not None:
            closed()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "block", "n", "kind", "text"])


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, n, text)``: every record of the files as text, numbered within the block it begins in.

    Blank lines between records are none.
    """
    rows = lines(spark, path)
    # one entry for each block of the input, 128 MB by default
    begun = {(r["file"], r["block"]) for r in inside_quotes(rows).toLocalIterator()}
    pieces = cut_lineage(rows.mapInArrow(_assemble(spark.sparkContext.broadcast(begun)), PIECES))
    parts = pieces.where("kind <> 'whole'")
    order = W.partitionBy("file").orderBy("block", F.col("kind") == "head")
    numbered = parts.withColumn("record", F.count_if(F.col("kind") == "head").over(order))
    joined = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", F.col("kind") == "head", "n", "text"))).alias("p"))
    crossing = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["n"].alias("n"), F.array_join("p.text", "\n").alias("text"))
    return pieces.where("kind = 'whole'").drop("kind").unionByName(crossing).where(F.trim("text") != "")
