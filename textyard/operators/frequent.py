"""The most frequent terms, exactly, without shuffling every term.

Each task keeps a bounded summary of its terms (Misra and Gries): when it holds too many, the count of the first one
too many is taken off all. Summaries merge the same way, up a tree, and what was taken off bounds the error. Terms of the
last summary are then counted exactly; if the k-th count passes the error, no other term can have a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import unwrap_udt

from textyard.session import cut_lineage, ensure_checkpoint_dir

# Terms of the first summary for each term wanted; a summary that is too coarse grows.
WIDTH = 16
# Beyond this many terms a summary is no better than counting everything.
LARGEST = 1 << 21
# Summaries merged at a time.
FAN_IN = 8
# Terms of a batch, or rows of summaries, that a task adds up at a time: its memory does not depend on the batches it gets.
SLICE = 1 << 18
# Terms sent to a task in one row: a batch has a fixed number of rows, whatever the length of the texts.
RUN = 64

SUMMARY = "part int, term string, n bigint, error bigint"


def shrink(terms: pa.Array, counts: np.ndarray, capacity: int) -> tuple[pa.Array, np.ndarray, int]:
    """At most ``capacity`` terms: the largest count that does not fit is taken off all, and returned."""
    if len(counts) <= capacity:
        return terms, counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    kept = np.flatnonzero(counts > taken)
    return terms.take(pa.array(kept)), counts[kept] - taken, taken


def add(terms: list, counts: list, capacity: int) -> tuple[pa.Array, np.ndarray, int]:
    """Counts of equal terms added up, then shrunk."""
    summed = pa.table({"t": pa.chunked_array(terms, pa.string()), "n": pa.chunked_array([pa.array(c, pa.int64()) for c in counts], pa.int64())})
    summed = summed.group_by("t").aggregate([("n", "sum")]).combine_chunks()
    column = summed["t"].chunk(0) if summed["t"].num_chunks else pa.array([], pa.string())
    return shrink(column, summed["n_sum"].to_numpy(), capacity)


def _rows(part: int, terms: pa.Array, counts: np.ndarray, error: int) -> pa.RecordBatch:
    """A summary as rows; one without terms still tells its error."""
    if not len(terms):
        terms, counts = pa.array([None], pa.string()), np.zeros(1, dtype=np.int64)
    same = np.ones(len(terms), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array((same * part).astype(np.int32)), terms, pa.array(counts), pa.array(same * error)], names=["part", "term", "n", "error"]
    )


def _summarise(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, error = pa.array([], pa.string()), np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            every = batch.column(0).flatten()
            for at in range(0, len(every), SLICE):
                found = pc.value_counts(every.slice(at, SLICE).drop_null())
                terms, counts, taken = add([terms, found.field(0)], [counts, found.field(1).to_numpy(zero_copy_only=False)], capacity)
                error += taken
        yield _rows(TaskContext.get().partitionId(), terms, counts, error)

    return run


def _merge(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, held, error, errors = [pa.array([], pa.string())], [np.zeros(0, dtype=np.int64)], 0, 0, {}
        for batch in batches:
            for part, its in zip(*(batch.column(c).to_numpy() for c in ("part", "error"))):
                errors[int(part)] = int(its)
            real = batch.filter(pc.is_valid(batch.column("term")))
            terms.append(real.column("term"))
            counts.append(real.column("n").to_numpy())
            held += real.num_rows
            if held >= SLICE:
                one, its, taken = add(terms, counts, capacity)
                terms, counts, held, error = [one], [its], 0, error + taken
        one, its, taken = add(terms, counts, capacity)
        yield _rows(min(errors) // FAN_IN, one, its, error + taken + sum(errors.values()))

    return run


def summary(rows: DataFrame, terms: str, capacity: int) -> DataFrame:
    """(term, n, error) of one summary over an array column: a term's count lies in n to n + error, and a term that
    is not listed occurs at most ``error`` times.

    A merge reads ``FAN_IN`` summaries at most and holds little more than one, so neither a task nor a shuffle group grows
    with the rows.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1)), F.lit(RUN))
    # the outer form, as a plain one would have the terms made a second time to test their number
    runs = rows.select(F.col(terms).cast("array<string>").alias("t")).select(F.explode_outer(F.transform(starts, lambda i: F.slice("t", i, RUN))))
    level = cut_lineage(runs.mapInArrow(_summarise(capacity), SUMMARY))
    parts = level.agg(F.max("part")).first()[0]
    while parts:  # at least one row a task
        level = level.groupBy(F.expr(f"part div {FAN_IN}").alias("_group")).applyInArrow(_merge(capacity), SUMMARY)
        parts //= FAN_IN
    return level.select("term", "n", "error")


def _exact(rows: DataFrame, terms: str, wanted: DataFrame) -> DataFrame:
    """``tf`` and ``df`` of the wanted terms, as many as a summary has at most; no other term leaves its row."""
    listed = [r["term"] for r in wanted.collect()]
    spark = rows.sparkSession
    if not listed:
        return spark.createDataFrame([], "term string, tf bigint, df bigint")
    counter = CountVectorizerModel.from_vocabulary(listed, inputCol="_terms", outputCol="_tf")
    given = rows.select(F.array_compact(F.col(terms).cast("array<string>")).alias("_terms")).where("_terms is not null")
    vector = unwrap_udt(F.col("_tf"))
    each = counter.transform(given).select(F.inline(F.arrays_zip(vector["indices"].alias("_i"), vector["values"].alias("_n"))))
    counts = each.groupBy("_i").agg(F.sum("_n").cast("bigint").alias("tf"), F.count(F.lit(1)).alias("df"))
    names = spark.createDataFrame(pa.table({"_i": pa.array(range(len(listed)), pa.int32()), "term": pa.array(listed, pa.string())}))
    return counts.join(names, "_i").select("term", "tf", "df")


def frequent_terms(rows: DataFrame, terms: str, k: int, min_df: int = 1, width: int = WIDTH, largest: int = LARGEST) -> DataFrame | None:
    """``(term, tf, df)`` with the k terms of largest ``tf`` (among those with df >= ``min_df``) in it, or None.

    None says that no summary of up to ``largest`` terms tells them apart, as in a corpus where all terms are
    about equally frequent; then every term has to be counted. A corpus with fewer terms gives all of them. Nulls in
    the array are no terms.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    capacity = max(width * k, 1)
    while capacity <= largest:
        found = cut_lineage(summary(rows, terms, capacity))
        error, n = found.agg(F.max("error"), F.count("term")).first()
        if not error or n >= k:
            exact = cut_lineage(_exact(rows, terms, found.where("term is not null").select("term")))
            if not error:
                return exact
            kept = exact.where(F.col("df") >= min_df).orderBy(F.desc("tf")).limit(k)
            last, size = kept.agg(F.min("tf"), F.count(F.lit(1))).first()
            if size == k and last > error:
                return exact
        capacity *= 4
    return None
