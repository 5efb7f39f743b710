"""Small helpers around the session: checkpoint folder, scan spreading, size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

# A lookup side is broadcast only when its checked size is at most this many bytes.
BROADCAST_BUDGET = 256 * 1024 * 1024
# Keys joined by broadcast when the lookup side is beyond the budget: the most frequent ones, so that a key left for the
# shuffle holds at most one row in this many.
HEAD_KEYS = 10_000
# Per-group figures are held on the driver only for at most this many groups.
GROUP_LIMIT = 10_000

_SHIPPED: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return
    if sc.getCheckpointDir() is not None:
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, for many narrow rows: as compressed Parquet in the checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers run side by side on all cores, so each gets one thread for linear algebra
    unless the session says otherwise (spark.executorEnv.*).
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), "textyard.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        sc.environment.setdefault(name, "1")
    _SHIPPED.add(sc.applicationId)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan over all cores when its files give fewer splits than cores.

    A table of many files is returned unchanged, so at scale no shuffle is added.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        return scan.repartition(cores)
    return scan


def fan_out(df: DataFrame) -> DataFrame:
    """Spread rows that are short but costly to work on over all shuffle partitions.

    By size alone adaptive execution would put them into a few tasks; it leaves an explicit
    partition count as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores))


def few_rows(df: DataFrame, limit: int = GROUP_LIMIT) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``limit``, else None."""
    head = df.limit(limit + 1).collect()
    return head if len(head) <= limit else None


def join_per_group(rows: DataFrame, per_group: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join rows to a frame of one row per group, without moving the rows when groups are few."""
    head = few_rows(per_group)
    if head is not None:
        local = rows.sparkSession.createDataFrame(head, per_group.schema)
        return rows.join(F.broadcast(local), by, how)
    return head_tail_join(rows, cut_lineage(per_group), by, how)


def head_tail_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", head_keys: int = HEAD_KEYS) -> DataFrame:
    """Join many ``rows`` to a keyed ``table`` too large to broadcast, whatever share of the rows one key holds.

    Keys are counted (combined per task) and the ``head_keys`` most frequent ones join by broadcast where their rows
    are; the others are shuffled, and none of them can hold a large share. Rows are read once for each of these steps.
    """
    if how not in ("inner", "left", "left_anti", "left_semi"):
        raise ValueError(f"unsupported lookup join: {how}")
    frequent = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), *on).limit(head_keys).select(*on)
    frequent = F.broadcast(cut_lineage(frequent))
    head = table.join(frequent, on, "left_semi")
    near = rows.join(frequent, on, "left_semi").join(F.broadcast(head), on, how)
    return near.unionByName(rows.join(frequent, on, "left_anti").join(table, on, how))


def lookup_join(
    rows: DataFrame, table: DataFrame, on: str, table_bytes: int, how: str = "inner", budget: int = BROADCAST_BUDGET
) -> DataFrame:
    """Join many ``rows`` to a keyed ``table`` of known size: broadcast within ``budget``, by head and tail beyond."""
    if table_bytes <= budget:
        return rows.join(F.broadcast(table), on, how)
    room = max(budget // max(table_bytes // max(table.count(), 1), 1), 1)
    return head_tail_join(rows, table, [on], how, min(HEAD_KEYS, room))
