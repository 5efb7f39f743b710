"""Helpers shared by the operators: stored intermediates, Arrow text slices, bounded bitmaps and counters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textyard.session import ensure_checkpoint_dir

# Bytes of text a Python worker turns into arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
# Bytes of texts sent to a Python worker at once, a little less than four slices; both sides hold them, the JVM twice while they grow.
BATCH_BYTES = 15 * SLICE_BYTES // 4
BATCH_SETTING, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
# Slots of a bitmap of ids (2 MB); two ids in one slot only let a few rows more through.
BITMAP_SLOTS = 1 << 24


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: lineage ends there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a null text is empty."""
    column = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    start = 0
    while start < batch.num_rows:
        # a slice takes rows up to the limit, one at least; only its own texts are copied
        upto = np.cumsum(sizes[start : start + 10_000])
        end = start + max(int(np.searchsorted(upto, limit, side="right")), 1)
        yield batch.slice(start, end - start), [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column.slice(start, end - start)]
        start = end


def in_arrow(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``rows.mapInArrow(work, schema)`` for rows that hold texts, in batches of about ``BATCH_BYTES`` whatever the length of a text.

    Spark reads the limit when the rows are computed, so the session keeps it; one that the session has set itself stays.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, SPARKS_OWN) == SPARKS_OWN:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return rows.mapInArrow(work, schema)


def share(df: DataFrame, value) -> object:
    return df.sparkSession.sparkContext.broadcast(value)


def slot_counts(df: DataFrame, slots: int) -> np.ndarray:
    """Sum ``n`` by ``slot`` (0 to slots - 1) into one array; its size depends on ``slots`` alone."""
    summed = df.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, dtype=np.int64)
    out[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return out


def id_bitmap(ids: DataFrame, column: str, slots: int = BITMAP_SLOTS) -> np.ndarray:
    """A bit for each ``id mod slots`` that occurs, gathered as 32-bit words."""
    slot = f"pmod({column}, {slots})"
    words = ids.selectExpr(f"int({slot} div 32) as word", f"shiftleft(1L, int({slot} % 32)) as bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(slots // 32, dtype=np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = np.mod(ids.astype(np.int64), bitmap.size * 32)
    return (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def integer_ids(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 and which of them are given; a null id is 0 there."""
    col = batch.column(column)
    valid = np.asarray(col.is_valid())
    return np.asarray(col.fill_null(0)).astype(np.int64), valid


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def list_array(flat: np.ndarray, sizes: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    """Rows of ``sizes`` values each, in the order of ``flat``."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=type_))


def run_batches(work: Callable, text: int = 1) -> Callable:
    """A ``mapInArrow`` function from ``work(slice, blobs)``, which returns a record batch or None."""

    def run(batches):
        for batch in batches:
            for part, blobs in text_slices(batch, text):
                out = work(part, blobs)
                if out is not None and out.num_rows:
                    yield out

    return run


# Ids that are broadcast to drop rows; more are dropped by a shuffle join.
BROADCAST_IDS = 1_000_000


def few(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` (short) rows."""
    return F.broadcast(df) if df.count() <= rows else df
