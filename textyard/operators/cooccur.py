"""Word vectors from co-occurrence: pair counts in windows, positive pointwise mutual information, sign projection.

Words are numbered and paired by number, a slice of the texts at a time in each task; the rest is joins and aggregates. A word's vector is the sum of its contexts' sign vectors, weighted by information; the
signs are bits of the context's md5, so no matrix is stored or sent. Weights are whole numbers (information in units of
1 / ``SCALE``), so sums are exact and do not depend on the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textyard.functions.hashing import HEX_DIGITS, md5_int
from textyard.session import BROADCAST_BUDGET, cut_lineage, lookup_join
from textyard.sources.tables import with_tokens

SCALE = 1 << 16
# Dimensions that one md5 prefix gives signs for.
BITS = 4 * HEX_DIGITS
# Columns summed at a time.
WIDE = 50
# Tokens of a text paired at a time; pairs across the cuts are kept.
RUN = 4_096
# Tokens that a task pairs at once, and pairs that it packs at once.
SLICE = 1 << 19
# Pairs whose signs are unpacked at a time.
SIGNED = 1 << 13
# Runs of words that a task adds up, one after the other, and the most words of a run.
PARTS = 8
MOST_WORDS = 1 << 12


def word_pairs(corpus: DataFrame, window: int = 5) -> DataFrame:
    """``(a, b, n)``: how often two words, a <= b, stand at most ``window`` places apart.

    Each pair of places counts once. A long text is cut into runs that see ``window`` tokens of the next one, so an array
    of pairs stays short; counts are combined in each task before they are shuffled.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(RUN))
    runs = with_tokens(corpus).where(F.size("tokens") > 1).select("tokens", F.explode(starts).alias("_at"))
    run = runs.select(F.slice("tokens", F.col("_at") + 1, F.lit(RUN + window)).alias("t"))
    left = F.slice("t", 1, RUN)

    def beside(step: int) -> Column:
        right = F.slice("t", step + 1, RUN)
        both = F.zip_with(left, right, lambda x, y: F.when(y.isNotNull(), F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
        return F.array_compact(both)

    pairs = run.select(F.explode(F.concat(*[beside(d) for d in range(1, window + 1)])).alias("p")).select("p.a", "p.b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _hashed(word: Column | str, seed: int) -> Column:
    return F.xxhash64(word, F.lit(seed))


def hash_of(word: Column | str, seed: int) -> Column:
    """What ``hashes_apart`` knows a word by."""
    return _hashed(word, seed)


def hashes_apart(vocabulary: DataFrame, n: int) -> tuple[np.ndarray, int] | None:
    """The sorted hashes of at most ``n`` distinct words and the seed that keeps them apart; None if they would pass the broadcast budget."""
    if 8 * n > BROADCAST_BUDGET:
        return None
    seed = 0
    while True:
        hashes = np.sort(vocabulary.select(_hashed("word", seed).alias("h")).toArrow()["h"].to_numpy())
        if not (hashes[1:] == hashes[:-1]).any():
            return hashes, seed
        seed += 1  # two words of one hash: another seed tells them apart


def numbered(vocabulary: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, int] | None:
    """``(word, id)`` of ``n`` distinct words, their hashes in the order of the ids and the seed that keeps them apart.

    None if the hashes would pass the broadcast budget; then words have to be paired as they are.
    """
    found = hashes_apart(vocabulary, n)
    if found is None:
        return None
    hashes, seed = found
    shared = vocabulary.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(shared.value, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], names=["word", "id"])

    rows = vocabulary.select("word", _hashed("word", seed).alias("h"))
    return rows.mapInArrow(run, "word string, id bigint"), hashes, seed


def _pairs_beside(ids: np.ndarray, lengths: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids at most ``window`` places apart in the same row, the first among its ``run`` first places, as one number
    (the smaller id in the upper half), and their counts; ids below zero have no pairs."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    here = np.arange(len(ids))
    first = (ids >= 0) & (here - (ends - np.repeat(lengths, lengths)) < run)
    keys = []
    for step in range(1, min(window, len(ids) - 1) + 1):
        both = first[:-step] & (ids[step:] >= 0) & (here[step:] < ends[:-step])
        x, y = ids[:-step][both], ids[step:][both]
        keys.append(np.minimum(x, y) << 32 | np.maximum(x, y))
    return np.unique(np.concatenate(keys or [np.zeros(0, dtype=np.int64)]), return_counts=True)


def _runs(spark: SparkSession, n: int) -> tuple[int, int]:
    """The tasks that ``n`` words are dealt to and how many words make a run; each task works on one run after the other."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return tasks, max(1, min(MOST_WORDS, -(-n // (PARTS * tasks))))


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers as binary values that end at ``ends``."""
    offsets = pa.py_buffer((np.append(0, ends) * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
    keys, n = keys[order], n[order]
    first = np.append(0, np.flatnonzero(np.diff(keys)) + 1)
    return keys[first], np.add.reduceat(n, first)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (part, keys, n) of packed counts, each part's rows together -> (key, n), a row for each key."""

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(keys, n)], names=["key", "n"])

    last, keys, n, fresh = None, [], [], 0
    for batch in batches:
        for part, some, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if part != last:
                if last is not None:
                    yield ended()
                last, keys, n, fresh = part, [], [], 0
            keys.append(np.frombuffer(some.as_buffer(), np.int64))
            n.append(np.frombuffer(times.as_buffer(), np.int64))
            fresh += len(keys[-1])
            if fresh >= max(SLICE, len(keys[0])):
                (known, total), fresh = _summed(keys, n), 0
                keys, n = [known], [total]
    if last is not None:
        yield ended()


def id_pairs(corpus: DataFrame, hashes: np.ndarray, seed: int, window: int = 5) -> DataFrame:
    """``word_pairs`` of the words that are numbered, as ``(a, b, n)`` of their ids, a <= b.

    A task looks ids up by hash and combines the pairs of a slice of its texts before they are shuffled, packed by runs of words,
    as one number each.
    """
    length = RUN
    spark = corpus.sparkSession
    shared, (tasks, per) = spark.sparkContext.broadcast(hashes), _runs(spark, len(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            column = batch.column(0)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(sizes) and len(known):
                upto = np.cumsum(sizes[at:])
                k = max(int(np.searchsorted(upto, SLICE, side="right")), 1)
                flat = column.slice(at, k).flatten()
                given, flat = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy()
                ids = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                ids[~given | (known[ids] != flat)] = -1
                keys, n = _pairs_beside(ids, sizes[at : at + k], window, length)
                at += k
                if len(keys):
                    part = ((keys >> 32) // per).astype(np.int32)
                    ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(part[ends - 1]), _blobs(keys, ends), _blobs(n.astype(np.int64), ends)], names=["part", "keys", "n"])

    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0)), F.lit(RUN))
    hashed = F.transform("tokens", lambda w: F.when(w.isNotNull(), _hashed(w, seed)))
    rows = with_tokens(corpus).select(hashed.alias("t"))
    # the outer form, as a plain one would have the texts cleaned a second time to test their length
    runs = rows.select(F.explode_outer(F.transform(starts, lambda i: F.slice("t", i + 1, F.lit(RUN + window)))))
    packed = runs.mapInArrow(run, "part int, keys binary, n binary").repartition(tasks, "part").sortWithinPartitions("part")
    counts = packed.mapInArrow(_merged, "key bigint, n bigint")
    return counts.select(F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n")


def named(pairs: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Pairs of ids as pairs of words, a <= b; ``size`` is what the words take broadcast."""
    met = lookup_join(pairs, words.select(F.col("id").alias("a"), F.col("word").alias("_a")), "a", size)
    met = lookup_join(met, words.select(F.col("id").alias("b"), F.col("word").alias("_b")), "b", size)
    return met.withColumns({"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")}).select("a", "b", *[c for c in pairs.columns if c not in ("a", "b")])


def vocabulary_pairs(corpus: DataFrame, vocabulary: DataFrame, n: int, size: int, window: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(a, b, n)`` of pairs of two of the ``n`` vocabulary words, and the words ``(word, id)`` that a and b stand for.

    Words of a vocabulary whose hashes pass the budget stand for themselves.
    """
    known = numbered(vocabulary, n)
    if known is None:
        return known_pairs(word_pairs(corpus, window), vocabulary, size), vocabulary.select("word", F.col("word").alias("id"))
    words, hashes, seed = known
    return id_pairs(corpus, hashes, seed, window), words


def _both_ways(pairs: DataFrame, *values: str) -> DataFrame:
    """Each pair from both sides as ``(word, context, ...)``; a word beside itself once."""
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("context")), F.struct(F.col("b").alias("word"), F.col("a").alias("context")))
    sides = F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides)
    return pairs.select(F.inline(sides), *values)


def known_pairs(pairs: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """Pairs of two vocabulary words; ``size`` is what the words take broadcast."""
    words = vocabulary.select("word")
    kept = lookup_join(pairs, words.withColumnRenamed("word", "a"), "a", size, "left_semi")
    return lookup_join(kept, words.withColumnRenamed("word", "b"), "b", size, "left_semi")


def word_pmi(pairs: DataFrame, size: int) -> DataFrame:
    """``(a, b, n, pmi)`` of the pairs that meet more often than by chance.

    pmi = ln(n total / (m_a m_b)), where a word's m counts the places beside it and a word beside itself counts twice.
    """
    times = F.when(F.col("a") == F.col("b"), 2).otherwise(1)
    seen = _both_ways(pairs, "n", times.alias("times")).groupBy("word").agg(F.sum(F.col("n") * F.col("times")).alias("m"))
    seen = cut_lineage(seen)
    total = float(seen.agg(F.sum("m")).first()[0] or 0)
    one, two = seen.toDF("a", "m_a"), seen.toDF("b", "m_b")
    met = lookup_join(lookup_join(pairs, one, "a", size), two, "b", size)
    count = (F.col("n") * times).cast("double")
    chance = F.col("m_a").cast("double") * F.col("m_b").cast("double")
    return met.select("a", "b", "n", F.log(count * total / chance).alias("pmi")).where("pmi > 0")


def sum_arrays(rows: DataFrame, by: list[str], vector: str, dim: int, weight: Column | None = None, wide: int = WIDE) -> DataFrame:
    """Element sums of an array column per group, as ``sums``, and the number of rows (or the sum of weights) as ``times``.

    An array is summed in parts of ``wide`` columns: more columns than Spark compiles in one go would be interpreted. Rows
    that come partitioned by the group are not shuffled again.
    """
    one = F.lit(1).cast("bigint") if weight is None else weight
    parts = [F.struct(F.lit(j).alias("_part"), F.slice(vector, j * wide + 1, wide).alias("_v")) for j in range(math.ceil(dim / wide))]
    each = rows.select(*by, one.alias("_w"), F.inline(F.array(*parts)))
    value = [F.coalesce(F.sum(F.get("_v", F.lit(i)) * F.col("_w")), F.lit(0)) for i in range(min(wide, dim))]
    return _joined_parts(each.groupBy(*by, "_part").agg(F.sum("_w").alias("times"), *[v.alias(f"_{i}") for i, v in enumerate(value)]), by, min(wide, dim), dim)


def _joined_parts(sums: DataFrame, by: list[str], wide: int, dim: int) -> DataFrame:
    """Sums of the parts of an array, put together in their order."""
    cells = sums.select(*by, "times", F.struct("_part", F.array(*[f"_{i}" for i in range(wide)]).alias("v")).alias("_p"))
    whole = cells.groupBy(*by).agg(F.max("times").alias("times"), F.array_sort(F.collect_list("_p")).alias("_p"))
    return whole.select(*by, "times", F.slice(F.flatten("_p.v"), 1, dim).alias("sums"))


def sign_bits(word: str, dim: int, seed: int) -> list[Column]:
    """Whole numbers whose bits are the signs of a word in ``dim`` dimensions."""
    return [md5_int(F.concat(F.col(word), F.lit(f":{seed}:{j}"))) for j in range(math.ceil(dim / BITS))]


def project(pmi: DataFrame, vocabulary: DataFrame, size: int, dim: int, seed: int) -> DataFrame:
    """``(word, fixed)`` of the vocabulary: each word's projected information as whole numbers, zeros without contexts.

    A vocabulary with ``id`` says what its words are called in the pairs; whole numbers there count from 0.
    """
    if "id" not in vocabulary.columns:
        vocabulary = vocabulary.select("word", F.col("word").alias("id"))
    # halves go up, as with round(), which takes a decimal number for each value
    scaled = F.col("pmi") * SCALE
    weight = F.floor(scaled) + (scaled - F.floor(scaled) >= 0.5).cast("bigint")
    weighed, bits = pmi.select("a", "b", weight.alias("q")), sign_bits("word", dim, seed)
    if isinstance(vocabulary.schema["id"].dataType, T.LongType) and 8 * len(bits) * (n := vocabulary.count()) <= BROADCAST_BUDGET:
        return _projected(weighed, vocabulary, n, bits, dim)
    rows = _both_ways(weighed, "q")
    words = vocabulary.select(F.col("id").alias("context"), F.array(*bits).alias("bits"))
    signed = lookup_join(rows, words, "context", size + 8 * (len(bits) + 2) * max(size // 64, 1))
    # narrow rows are shuffled, not the wide sums; a word has at most as many of them as there are words
    each = signed.select("word", "q", "bits").repartition("word").select("word", "q", F.posexplode("bits").alias("_part", "b"))
    wide = min(BITS, dim)
    # the sum with signs is twice the sum of the positive ones less the sum of all
    up = [F.sum(F.col("q") * F.shiftright("b", i).bitwiseAND(F.lit(1).cast("bigint"))) for i in range(wide)]
    parts = each.groupBy("word", "_part").agg(F.sum("q").alias("times"), *[u.alias(f"_{i}") for i, u in enumerate(up)])
    sums = _joined_parts(parts, ["word"], wide, dim).select("word", F.transform("sums", lambda x: 2 * x - F.col("times")).alias("sums"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), dim)
    return vocabulary.join(sums.withColumnRenamed("word", "id"), "id", "left").select("word", F.coalesce("sums", zeros).alias("fixed"))


def _dealt(per: int):
    """Arrow batches (a, b, q) of ids -> packed rows (part, at, context, q): both ways of the pairs, by runs of ``per`` words."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, q = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in range(3))
        other = a != b  # a word beside itself counts once
        keys, q = np.concatenate([a << 32 | b, (b << 32 | a)[other]]), np.concatenate([q, q[other]])
        order = np.argsort(keys)
        keys, q = keys[order], q[order]
        at, context = (keys >> 32).astype(np.int32), (keys & (1 << 32) - 1).astype(np.int32)
        part = at // per
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
        blobs = [_blobs(x, ends) for x in (at, context, q)]
        yield pa.RecordBatch.from_arrays([pa.array(part[ends - 1]), *blobs], names=["part", "at", "context", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= SLICE:
                yield from packed(held)
                held, rows = [], 0
        if held:
            yield from packed(held)

    return run


def _add_signs(sums: np.ndarray, at: np.ndarray, context: np.ndarray, q: np.ndarray, signs: np.ndarray) -> None:
    """Adds each context's signs, weighted, to the line of its word; ``at`` ascends."""
    dim = sums.shape[1]
    for begin in range(0, len(at), SIGNED):
        lines, w = at[begin : begin + SIGNED], q[begin : begin + SIGNED]
        first = np.append(0, np.flatnonzero(np.diff(lines)) + 1)
        bits = np.unpackbits(signs[context[begin : begin + SIGNED]].view(np.uint8).reshape(len(lines), -1, 8), axis=2, bitorder="little")
        up = np.add.reduceat(bits[:, :, :BITS].reshape(len(lines), -1)[:, :dim] * w[:, None], first, axis=0)
        # the sum with signs is twice the sum of the positive ones less the sum of all
        sums[lines[first]] += 2 * up - np.add.reduceat(w, first)[:, None]


def _sign_sums(shared, per: int, dim: int):
    """Arrow batches (part, id, word, at, context, q), each part's rows together -> (word, fixed) of the words of the parts."""

    def ended(names: dict[int, str], sums: np.ndarray) -> pa.RecordBatch:
        lines = np.array(sorted(names), dtype=np.int64)
        ends = pa.array(np.arange(len(lines) + 1, dtype=np.int32) * dim)
        words = pa.array([names[i] for i in lines.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.ListArray.from_arrays(ends, pa.array(sums[lines].ravel()))], names=["word", "fixed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, last, names, sums = shared.value, None, {}, None
        for batch in batches:
            for part, id, word, *packed in zip(*[c.to_pylist() for c in batch.columns[:3]], *batch.columns[3:]):
                if part != last:
                    if last is not None:
                        yield ended(names, sums)
                    last, names, sums = part, {}, np.zeros((per, dim), dtype=np.int64)
                if id is not None:
                    names[id - part * per] = word
                else:
                    at, context, q = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(packed, (np.int32, np.int32, np.int64)))
                    _add_signs(sums, at - part * per, context, q, signs)
        if last is not None:
            yield ended(names, sums)

    return run


def _projected(pairs: DataFrame, vocabulary: DataFrame, n: int, bits: list[Column], dim: int) -> DataFrame:
    """``project`` of ``n`` words numbered from 0: signs are broadcast as bits, the numbers of a pair are packed and shuffled by
    runs of words, and a task adds up a run at a time. The words' names come with their runs."""
    found = vocabulary.select("id", *[b.alias(f"_{j}") for j, b in enumerate(bits)]).toArrow()
    signs = np.zeros((n, len(bits)), dtype=np.int64)
    for j in range(len(bits)):
        signs[found["id"].to_numpy(), j] = found[f"_{j}"].to_numpy()
    tasks, per = _runs(vocabulary.sparkSession, n)
    shared = vocabulary.sparkSession.sparkContext.broadcast(signs)
    dealt = pairs.select("a", "b", "q").mapInArrow(_dealt(per), "part int, at binary, context binary, q binary")
    named = vocabulary.select(F.expr(f"int(id div {per})").alias("part"), "id", "word")
    each = named.unionByName(dealt, allowMissingColumns=True).repartition(tasks, "part").sortWithinPartitions("part")
    return each.select("part", "id", "word", "at", "context", "q").mapInArrow(_sign_sums(shared, per, dim), "word string, fixed array<bigint>")


def unfix(fixed: Column, dim: int, times: Column | None = None) -> Column:
    """Whole numbers (sums of ``times`` of them) back to a vector; projections keep their length on average."""
    unit = F.lit(SCALE * math.sqrt(dim))
    return F.transform(fixed, lambda x: x / (unit if times is None else unit * times))
