"""What the two vector operators share: checks of components and packs of vectors as one binary row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def sound(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector and all its components are given and finite, as doubles. Vectors of different lengths cannot be
    compared; callers keep them apart by ``size``."""
    good = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(good)
    return rows.withColumn(column, F.transform(column, lambda v: v.cast("double")))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length as a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def packs(rows: DataFrame, keys: list[str], columns: list[str], vector: str, size: int) -> DataFrame:
    """Runs of at most ``size`` rows of one key as one row: keys, pack, and each column as little-endian bytes.

    Rows must come sorted by ``keys`` within partitions; a key may have packs in several partitions, numbered
    from the partition's own number.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "pack bigint", "rows int", *(f"{c} binary" for c in columns), f"{vector} binary"])

    def gather(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, key = [], None

        def row():
            nonlocal number
            whole = pa.Table.from_batches(held)
            values = [whole[k][0].as_py() for k in keys]
            data = [np.asarray(whole[c].combine_chunks(), dtype="<i8").tobytes() for c in columns]
            data.append(matrix(whole[vector].combine_chunks()).astype("<f8").tobytes())
            number += 1
            cells = [*values, number, whole.num_rows, *data]
            return pa.RecordBatch.from_pylist([dict(zip(types.names, cells))], schema=types)

        types = None
        for batch in batches:
            if types is None:
                types = pa.schema([*(batch.schema.field(k) for k in keys), pa.field("pack", pa.int64()), pa.field("rows", pa.int32()), *(pa.field(c, pa.binary()) for c in [*columns, vector])])
            code = [tuple(v) for v in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys))] if keys else [()] * batch.num_rows
            start = 0
            for i in range(batch.num_rows + 1):
                have = sum(b.num_rows for b in held)
                ended = i == batch.num_rows
                if ended or (i > start or held) and (code[i] != key or have + i - start >= size):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                        start = i
                    if not ended and held:
                        yield row()
                        held = []
                if not ended:
                    key = code[i]
        if held:
            yield row()

    return rows.select(*keys, *columns, vector).mapInArrow(gather, schema)


def unpack(cell: bytes, kind: str = "<f8", rows: int | None = None) -> np.ndarray:
    flat = np.frombuffer(cell, dtype=kind)
    return flat if rows is None else flat.reshape(rows, -1)


def numbered(packed: DataFrame, order: list, name: str) -> DataFrame:
    """Number packs 0, 1, ... over narrow rows (one per pack)."""
    narrow = packed.select("pack", *[c for c in packed.columns if c in ("rows", "top")])
    ids = narrow.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1).select("pack", name)
    return packed.join(ids, "pack")
