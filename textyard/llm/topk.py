"""Exact top-k search by inner product over integer components: norm-sorted, with rotated partial sums.

Vectors are packed in blocks by descending length. All vectors are rotated by the eigenvectors of their Gram
matrix, so that the first coordinates carry most of a product; a product is at most the partial sum over them
plus the product of the two remaining lengths, and at most the product of the whole lengths (Cauchy-Schwarz).
Each query first takes its k-th best score in the block of longest vectors as a bound; pairs of a query pack
and a block that cannot reach it are never joined, and inside a block only candidates that may reach the
bound get their exact integer product. The bounds have room for rounding, so pruning loses nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textyard.llm.common import share, stored
from textyard.llm.vectors import matrix, numbered, packs, sound, unpack

SCALE = 1024
K = 10
BLOCK_ROWS = 4096
QUERY_ROWS = 512
CHUNK = 512
# Products above this are not exact in doubles; they are summed in whole numbers then.
EXACT = float(1 << 53)
LONG = float(1 << 63)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x, norm) with x = floor(scale * component) as whole doubles."""
    rows = sound(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("x")).where("vec_id is not null"), "x")
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("double")))
    return rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))


def rotation(rows: DataFrame) -> np.ndarray:
    """Eigenvectors of the Gram matrix, strongest first; only d x d sums reach the driver."""

    def gram(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    cells = rows.select("x").mapInArrow(gram, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").toArrow()
    d = int(round(np.sqrt(cells.num_rows)))
    if not d:
        return np.zeros((0, 0))
    total = cells["v"].to_numpy().reshape(d, d)
    return np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])


def best_of(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, vec_id and score of each query's k best in a block sorted by descending length, as far as they may reach ``bound``."""
    head = max(1, q.shape[1] // 4)
    qr, xr = q @ axes, x @ axes
    q_norm, x_norm = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    q_rest, x_rest = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(xr[:, head:], axis=1)
    slack = 1e-9 * q_norm * (x_norm.max() if len(x_norm) else 0) + 1e-6
    bound = bound.copy()
    who, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = len(q) and len(x) and float(q_norm.max()) * float(x_norm.max()) >= EXACT
    if large:
        if max(np.abs(q).max(), np.abs(x).max()) >= LONG:
            raise ValueError("a component leaves the range of a long")
        # whole numbers wrap around, so a sum is exact whenever the score itself is in range
        q_whole, x_whole = q.astype(np.int64), x.astype(np.int64)
    else:
        q_whole, x_whole = q, x
    for start in range(0, len(x), CHUNK):
        part = slice(start, start + CHUNK)
        live = np.flatnonzero(q_norm * x_norm[part].max() + slack >= bound)
        if not len(live):
            break
        upper = qr[live, :head] @ xr[part, :head].T + np.outer(q_rest[live], x_rest[part])
        a, b = np.nonzero(upper + slack[live, None] >= bound[live, None])
        a, b = live[a], b + start
        other = q_ids[a] != ids[b]
        a, b = a[other], b[other]
        exact = np.concatenate([np.einsum("ij,ij->i", q_whole[a[i : i + 65536]], x_whole[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        if large and (np.abs(np.einsum("ij,ij->i", q[a], x[b])) >= LONG * (1 - 1e-9)).any():
            raise ValueError("a score leaves the range of a long")
        exact = exact.astype(np.int64)
        reach = exact >= bound[a] - (slack[a] if large else 0)
        who, found, score = np.concatenate([who, a[reach]]), np.concatenate([found, ids[b[reach]]]), np.concatenate([score, exact[reach]])
        order = np.lexsort((found, -score, who))
        who, found, score = who[order], found[order], score[order]
        first = np.searchsorted(who, who, side="left")
        place = np.arange(len(who)) - first
        keep = place < k
        full = place == k - 1
        bound[who[full]] = np.maximum(bound[who[full]], score[full])
        who, found, score = who[keep], found[keep], score[keep]
    return who, found, score


def top_inner_products(vectors: DataFrame, k: int = K, every: int = 100, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer products of every query.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows with another vec_id; ties go
    to the smaller vec_id. Vectors that are null or hold null or non-finite components take no part, nor do those
    without vec_id. Vectors of one length are searched together, each length by itself. Of rows that share a vec_id and a
    length the smallest vector is the query, and each row is a candidate. Zero vectors take part. A score beyond the range of a long is an
    error. Columns besides vec_id and embedding are not read.
    """
    every_row = stored(quantised(vectors, scale).withColumn("d", F.size("x")))
    lengths = [r["d"] for r in every_row.select("d").distinct().orderBy("d").collect()]
    found = [_search_length(every_row.where(F.col("d") == d).drop("d"), k, every) for d in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if len(found) == 1:
        return found[0]
    # of a vec_id with vectors of several lengths all candidates are ranked together
    scored = reduce(DataFrame.unionByName, found).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_length(rows: DataFrame, k: int, every: int) -> DataFrame:
    """The search among vectors of one length."""
    axes = share(rows, rotation(rows))
    sized = rows.select("vec_id", "x", "norm")
    total = rows.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    ordered = sized.repartitionByRange(blocks, F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), "vec_id")
    packed = packs(ordered, [], ["vec_id"], "x", BLOCK_ROWS)
    packed = stored(with_longest(packed))
    packed = stored(numbered(packed, [F.desc("top"), "pack"], "block"))
    count = packed.count()
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    spread = asked.repartition(max(1, -(-total // (every * QUERY_ROWS))), "vec_id")
    queries = packs(spread, [], ["vec_id"], "x", QUERY_ROWS).select("pack", "rows", F.col("vec_id").alias("q_ids"), F.col("x").alias("q"))
    first = packed.where("block = 0").select(F.col("rows").alias("b_rows"), F.col("vec_id").alias("ids"), F.col("x").alias("xs"))

    def bounds(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q = unpack(r["q"], rows=r["rows"])
                who, _, score = best_of(unpack(r["q_ids"], "<i8"), q, np.full(len(q), -np.inf), unpack(r["ids"], "<i8"), unpack(r["xs"], rows=r["b_rows"]), axes.value, k)
                bound = np.full(len(q), -np.inf)
                full = np.bincount(who, minlength=len(q)) >= k
                lowest = np.full(len(q), np.inf)
                np.minimum.at(lowest, who, score)
                bound[full] = lowest[full]
                norm = np.linalg.norm(q, axis=1)
                reach = np.where(np.isfinite(bound) & (bound > 0), bound / np.maximum(norm, 1e-300), 0.0).min() if len(q) else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([r["pack"]]), pa.array([r["rows"]], pa.int32()), pa.array([r["q_ids"]]), pa.array([r["q"]]), pa.array([bound.astype("<f8").tobytes()]), pa.array([float(reach) * (1 - 1e-9) - 1e-6])], ["pack", "rows", "q_ids", "q", "bound", "reach"])

    # one block of bounded size meets every query pack
    aimed = stored(queries.join(F.broadcast(first)).mapInArrow(bounds, "pack bigint, rows int, q_ids binary, q binary, bound binary, reach double")) if count else None
    if aimed is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    lengths = packed.select("block", "top")
    wanted = aimed.select("pack", "reach", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block")).join(lengths, "block").where("top >= reach").select("pack", "block")
    pairs = wanted.join(aimed, "pack").join(packed.select("block", F.col("rows").alias("b_rows"), F.col("vec_id").alias("ids"), F.col("x").alias("xs")), "block")

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids = unpack(r["q_ids"], "<i8")
                who, found, score = best_of(q_ids, unpack(r["q"], rows=r["rows"]), unpack(r["bound"]), unpack(r["ids"], "<i8"), unpack(r["xs"], rows=r["b_rows"]), axes.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(found), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

    scored = pairs.select("q_ids", "q", "rows", "bound", "ids", "xs", "b_rows").mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def with_longest(packed: DataFrame) -> DataFrame:
    """Add ``top``, the greatest length in the pack; its first row has it."""

    def measure(batches):
        for batch in batches:
            x, n = batch.column(batch.schema.get_field_index("x")), batch.column(batch.schema.get_field_index("rows"))
            top = [float(np.linalg.norm(unpack(a.as_py(), rows=b.as_py())[0])) for a, b in zip(x, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top)], names=[*batch.schema.names, "top"])

    return packed.mapInArrow(measure, "pack bigint, rows int, vec_id binary, x binary, top double")
