"""Collocation mining: phrases counted by a multikey quicksort of suffix pointers, scored, the best of each language kept.

A suffix is the next five words of a piece of text, from any word. Suffixes are routed over the tasks by their leading
words, sorted there word by word with three-way partitions, and an equal partition's size is the count of its phrase;
partitions below the least count are abandoned. Before they are routed, suffixes are cut where no phrase can go on: ahead of a word below
the least count, and between two neighbours that occur together less often. Both are counted first, combined in each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from textyard.llm import shingles as sh, words as wd
from textyard.llm.common import id_bitmap, in_bitmap, share, stored, text_slices

LEAST = 100
LONGEST = 5
KEPT = 2_000
# Words broadcast with their counts (16 bytes each); with more, rarer words are told apart only after routing.
TABLE_WORDS = 1 << 22
# Text turned into suffixes at once, and suffixes mined at once.
SLICE = 1 << 22
BUFFER = 1 << 18
# Bits that tell frequent neighbours (16 MB); two pairs in one bit only let a suffix run on.
PAIR_SLOTS = 1 << 27
# Pairs and suffixes a task counts before it sends them.
PAIRS_HELD = 1 << 22
SUFFIXES_HELD = 1 << 19
# Parts of a language ranked apart before its best phrases are.
RANK_PARTS = 64
# Buckets of routes for each task. A route takes at most a bucket's share of all suffixes, or ``ROUTE_ROWS``.
TASK_SHARE = 4
ROUTE_ROWS = 10_000

_BREAKS = wd.byte_set(b".,;:!?\n\x0b\x0c\r")
_APART = _BREAKS | wd.byte_set(b" \t")


def language(lang: str = "lang"):
    return F.coalesce(F.col(lang).cast("string"), F.lit("und"))


def _words(langs: pa.Array, blobs: list[bytes], fields: tuple[str, ...]) -> list[np.ndarray]:
    """Fields of all words; a hash covers the language and the word."""
    found = wd.gathered(wd.scan(blobs, _APART, _BREAKS, lower=True), ("hashes", "owner", *fields))
    tongue = np.array([xxhash.xxh3_64_intdigest(v.as_buffer()) for v in langs], dtype=np.uint64)
    hashes = sh.mix(found[0] ^ sh.mix(tongue)[found[1]]) if len(found[0]) else found[0]
    return [hashes, *found[1:]]


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, lang, word, f): the count of each word in each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blobs in text_slices(batch, 1, SLICE):
                hashes, owner, start, length = _words(part.column(0), blobs, ("start", "length"))
                h, first, f = np.unique(hashes, return_index=True, return_counts=True)
                named = [blobs[o][s : s + n].lower() for o, s, n in zip(owner[first].tolist(), start[first].tolist(), length[first].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column(0).take(pa.array(owner[first])), pa.array(named, pa.binary()).cast(pa.string()), pa.array(f)],
                    names=["h", "lang", "word", "f"],
                )

    rows = docs.select(language().alias("lang"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(count, "h bigint, lang string, word string, f bigint")
    return counted.groupBy("h", "lang", "word").agg(F.sum("f").alias("f"))


@dataclass(frozen=True)
class WordTable:
    """Frequent words by hash with their counts. If not ``complete``, a word that is missing may reach the least count,
    but not more than ``rest``."""

    hashes: np.ndarray
    counts: np.ndarray
    complete: bool
    rest: int

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id of each word (0: too rare for any phrase), its count or an upper bound, and which are known."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)
        if self.complete:
            return np.where(known, at + 1, 0).astype(np.uint32), np.where(known, self.counts[at] if len(self.counts) else 0, 0), known
        return hashes, np.where(known, self.counts[at], self.rest), known

    def names(self, ids: np.ndarray) -> np.ndarray:
        """The hashes that ids stand for."""
        return (self.hashes[ids.astype(np.int64) - 1] if self.complete else ids).view(np.int64)


def word_table(frequent: DataFrame, limit: int = TABLE_WORDS) -> WordTable:
    """The words to broadcast: all frequent ones, or the ``limit`` most frequent if there are more."""
    n = frequent.count()
    rows = (frequent if n <= limit else frequent.orderBy(F.desc("f"), "h").limit(limit)).select("h", "f").toArrow()
    hashes, counts = rows["h"].to_numpy().view(np.uint64), rows["f"].to_numpy()
    order = np.argsort(hashes)
    return WordTable(hashes[order], counts[order], n <= limit, int(counts.min()) if n > limit else 0)


def pair_keys(ids: np.ndarray, run: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word and the next one of its run, 0 where there is none or one of them is too rare."""
    keys = np.zeros(len(ids), dtype=np.uint64)
    if len(ids) > 1:
        both = sh.mix(ids[:-1].astype(np.uint64) * np.uint64(sh._BASE) ^ sh.mix(ids[1:].astype(np.uint64) + np.uint64(1))) | np.uint64(1)
        keys[:-1] = np.where((run[1:] == run[:-1]) & (ids[:-1] != 0) & (ids[1:] != 0), both, np.uint64(0))
    return keys


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(docs: DataFrame, words: WordTable) -> DataFrame:
    """(pair, n): counts of neighbours, added up in each task."""
    table = share(docs, words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table.value
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        send = lambda: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["pair", "n"])
        for batch in batches:
            for part, blobs in text_slices(batch, 1, SLICE):
                hashes, owner, run = _words(part.column(0), blobs, ("run",))
                found = pair_keys(words.look(hashes)[0], run)
                found, n = np.unique(found[found != 0], return_counts=True)
                keys, counts = _merged(np.concatenate([keys, found]), np.concatenate([counts, n]))
                if len(keys) >= PAIRS_HELD:
                    yield send()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield send()

    rows = docs.select(language().alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, words: WordTable, pairs: np.ndarray, route_rows: int, buckets: int) -> DataFrame:
    """(bucket, sizes, whole, ids, n): suffixes of two words and more, equal ones counted, a row for each bucket of a task.

    ``pairs`` is a bitmap of the neighbours that may lie in a phrase; a suffix ends between any others.

    A route is the hash of as few leading words as needed for some of them to occur at most ``route_rows`` times, so no
    route is longer, however frequent its first words. Suffixes whose words are all more frequent are routed by all their
    words; they are alike, and each task sends one. Routes share ``buckets``. ``whole`` is the least depth at which a route holds all
    occurrences of a suffix's leading words.
    """
    table, near = share(docs, words), share(docs, pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = table.value, near.value
        held: list[tuple] = []
        send = lambda key, route, *rest: _packed((route % np.uint64(buckets)).astype(np.int32), *rest)
        for batch in batches:
            for part, blobs in text_slices(batch, 1, SLICE):
                hashes, owner, run = _words(part.column(0), blobs, ("run",))
                ids, counts, _ = words.look(hashes)
                keys = pair_keys(ids, run)
                goes_on = (keys != 0) & in_bitmap(pairs, keys.view(np.int64))
                for begin in range(0, len(ids), BUFFER):
                    # the next words of the last suffixes belong to them too
                    end = min(begin + BUFFER + LONGEST - 1, len(ids))
                    held.append(_suffix_rows(ids[begin:end], counts[begin:end], goes_on[begin:end], min(BUFFER, len(ids) - begin), route_rows))
                held = [_counted(*(np.concatenate(c) for c in zip(*held)))] if held else held
                if held and len(held[0][0]) >= SUFFIXES_HELD:
                    yield send(*held.pop())
        if held and len(held[0][0]):
            yield send(*held[0])

    rows = docs.select(language().alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "bucket int, sizes binary, whole binary, ids binary, n binary")


def _suffix_rows(ids, counts, goes_on, m: int, route_rows: int) -> tuple:
    """Suffixes of the first ``m`` words as (key, route, whole, n, words); ``goes_on`` tells whether a suffix may hold a word
    and the next one."""
    held = np.zeros((m, LONGEST), dtype=ids.dtype)
    least, whole, size = np.full(m, np.iinfo(np.int64).max), np.zeros(m, dtype=np.int32), np.zeros(m, dtype=np.int32)
    route = np.zeros(m, dtype=np.uint64)
    padded = lambda a, fill: np.concatenate([a, np.full(LONGEST, fill, dtype=a.dtype)])
    ids, counts, goes_on = padded(ids, 0), padded(counts, 0), padded(goes_on, False)
    alive = ids[:m] != 0
    for d in range(LONGEST):
        alive = alive & goes_on[d - 1 : d - 1 + m] if d else alive
        held[alive, d] = ids[d : d + m][alive]
        size += alive
        open_ = alive & (whole == 0)
        route[open_] = sh.mix(route[open_] * np.uint64(sh._BASE) + ids[d : d + m][open_].astype(np.uint64) + np.uint64(1))
        least = np.where(alive, np.minimum(least, counts[d : d + m]), least)
        whole[open_ & (least <= route_rows)] = d + 1
    whole[whole == 0] = LONGEST + 1  # no leading words are rare enough: routed by all words
    used = np.flatnonzero(size >= 2)
    key = route[used].copy()
    for d in range(LONGEST):
        key = sh.mix(key * np.uint64(sh._BASE) + held[used, d].astype(np.uint64))
    return _counted(key, route[used], whole[used], np.ones(len(used), dtype=np.int64), held[used])


def _counted(key: np.ndarray, route: np.ndarray, whole: np.ndarray, n: np.ndarray, held: np.ndarray) -> tuple:
    """Equal suffixes once, with the sum of their counts."""
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] ^ np.uint64(1)))
    at = order[first]
    return key[at], route[at], whole[at], np.add.reduceat(n[order], first) if len(first) else n[at], held[at]


def _packed(bucket: np.ndarray, whole: np.ndarray, n: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    """One row a bucket of routes for the shuffle, with its suffixes' sizes, words and counts one behind the other."""
    order = np.argsort(bucket, kind="stable")
    bucket, whole, n, held = bucket[order], whole[order], n[order], held[order]
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    ends = np.append(first, len(bucket))
    kept = held != 0
    words = np.append(0, np.cumsum(kept.sum(axis=1)))

    def column(values: np.ndarray, at: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer((at * values.itemsize).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])

    columns = [column(kept.sum(axis=1).astype(np.uint8), ends), column(whole.astype(np.uint8), ends), column(held[kept], words[ends]), column(n, ends)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), *columns], names=["bucket", "sizes", "whole", "ids", "n"])


def _unpacked(rows: pa.Table | pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (0 behind a suffix's end), counts and ``whole`` of every suffix."""
    sizes, whole, ids, n = (b"".join(rows.column(c).to_pylist()) for c in ("sizes", "whole", "ids", "n"))
    sizes = np.frombuffer(sizes, dtype=np.uint8)
    held = np.zeros((len(sizes), LONGEST + 1), dtype=kind)
    held[np.arange(LONGEST + 1) < sizes[:, None]] = np.frombuffer(ids, dtype=kind)
    return held, np.frombuffer(n, dtype=np.int64), np.frombuffer(whole, dtype=np.uint8).astype(np.int32)


def multikey_counts(ids: np.ndarray, n: np.ndarray, whole: np.ndarray, least: int) -> tuple[list, list, list]:
    """Sort suffixes (rows of ids, 0 behind their end) and count phrases: (a row with it, its words, count).

    Pointers are parted in three by the word at a depth: smaller, equal, larger. The equal part's weight is the count of
    its first words. A part below ``least`` is abandoned, unless other routes may hold more of its phrases.
    """
    rows, depths, found = [], [], []
    todo = [(np.arange(len(ids)), 0)]
    while todo:
        at, depth = todo.pop()
        key = ids[at, depth]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        same = key == pivot
        equal = at[same]
        if pivot:
            weight = int(n[equal].sum())
            if weight >= least or whole[equal].max() > depth + 1:
                if depth:
                    rows.append(equal[0])
                    depths.append(depth + 1)
                    found.append(weight)
                if depth + 1 < LONGEST:
                    todo.append((equal, depth + 1))
        for part in (at[key < pivot], at[key > pivot]):
            if len(part) and (n[part].sum() >= least or whole[part].max() > depth + 1):
                todo.append((part, depth))
    return rows, depths, found


def mine(dealt: DataFrame, words: WordTable, least: int) -> DataFrame:
    """(phrase as hashes, a) of the phrases of two words and more in routed suffixes, sorted by bucket."""
    table = share(dealt, words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table.value
        kind = np.dtype(np.uint32 if words.complete else np.uint64)
        held, total = [], 0
        for part, size in _few_at_a_time(batches):
            held.append(part)
            total += size
            if total < BUFFER:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            bucket = rows["bucket"].to_numpy()
            upto = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if upto:
                yield from _mined(rows.slice(0, upto), kind, words, least)
            rest = rows.slice(upto)
            held, total = rest.to_batches(), pc.sum(pc.binary_length(rest["sizes"])).as_py() or 0
        if total:
            yield from _mined(pa.Table.from_batches(held).combine_chunks(), kind, words, least)

    return dealt.mapInArrow(count, "phrase array<bigint>, a bigint")


def _few_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Batches cut into runs of rows with about ``BUFFER`` suffixes, and the number of these."""
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.binary_length(batch.column("sizes"))).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(upto, before + BUFFER, side="right")), start + 1)
            yield batch.slice(start, end - start), int(upto[end - 1]) - before
            start, before = end, int(upto[end - 1])


def _mined(rows: pa.Table, kind: np.dtype, words: WordTable, least: int) -> Iterator[pa.RecordBatch]:
    ids, n, whole = _unpacked(rows, kind)
    at, depths, found = multikey_counts(ids, n, whole, least)
    if at:
        at, depths = np.array(at), np.array(depths, dtype=np.int32)
        flat = words.names(ids[at][np.arange(LONGEST + 1) < depths[:, None]])
        offsets = np.zeros(len(at) + 1, dtype=np.int32)
        np.cumsum(depths, out=offsets[1:])
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(found, pa.int64())], names=["phrase", "a"])


def frequent_phrases(docs: DataFrame, least: int = LEAST, table_words: int = TABLE_WORDS, route_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (phrase as word hashes, a) of 1 to 5 words with a >= ``least``, the words (h, lang, word, f), and n by language."""
    counted = stored(word_counts(docs))
    totals = stored(counted.groupBy("lang").agg(F.sum("f").cast("bigint").alias("n")))
    frequent = stored(counted.where(F.col("f") >= least))
    words = word_table(frequent, table_words)
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    if route_rows is None:
        total = totals.agg(F.sum("n")).first()[0] or 0
        route_rows = max(ROUTE_ROWS, total // (TASK_SHARE * tasks))
    near = pair_counts(docs, words).where(F.col("n") >= least)
    dealt = suffixes(docs, words, id_bitmap(near, "pair", PAIR_SLOTS), route_rows, TASK_SHARE * tasks)
    # buckets are dealt in turn, as many to each task
    dealt = dealt.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket")
    parts = mine(dealt, words, least)
    longer = parts.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    single = frequent.select(F.array("h").alias("phrase"), F.col("f").alias("a"))
    return stored(single.unionByName(longer)), frequent, totals


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, table_words: int = TABLE_WORDS, route_rows: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    Null texts are empty, a null language is ``und``; ids are not read, so repeated rows count each and null ids do not
    matter. Empty tables and texts without phrases give an empty result. Ties stand as the order says: score, a, phrase.
    Languages are told apart whatever their number. Columns besides lang and text are not read.
    """
    every, words, totals = frequent_phrases(docs, least, table_words, route_rows)
    phrases = every.where("size(phrase) > 1")
    # a longer phrase with the same count drops a shorter one inside it; then each phrase between them has that count too
    inner = phrases.where("size(phrase) > 2").select(
        F.explode(F.expr("array(slice(phrase, 1, size(phrase) - 1), slice(phrase, 2, size(phrase) - 1))")).alias("phrase"), F.col("a").alias("outer_a")
    )
    covered = inner.groupBy("phrase").agg(F.max("outer_a").alias("outer_a"))
    own = phrases.join(covered, "phrase", "left").where("outer_a is null or 100 * outer_a < 100 * a").drop("outer_a")
    spoken = words.select(F.col("h").alias("_h"), "lang", "word")
    told = own.select("phrase", "a", F.posexplode("phrase").alias("_at", "_h")).join(spoken, "_h")
    said = told.groupBy("phrase", "a", "lang").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("said"))
    named = said.select("phrase", "a", "lang", F.expr("array_join(transform(said, x -> x.word), ' ')").alias("text"))
    cuts = named.join(totals, "lang").select("*", F.explode(F.expr("sequence(1, size(phrase) - 1)")).alias("k"))
    halves = cuts.select("*", F.expr("slice(phrase, 1, k)").alias("_l"), F.expr("slice(phrase, k + 1, size(phrase) - k)").alias("_r"))
    counts = every.select(F.col("phrase").alias("_p"), F.col("a").alias("_f"))
    both = halves.join(counts.toDF("_l", "l"), "_l").join(counts.toDF("_r", "r"), "_r")
    # up to 19 digits each; the products are decimals of up to 38
    exact = "cast((cast(1000 as decimal(4)) * cast(a as decimal(19)) * cast(n as decimal(15))) div (cast(l as decimal(19)) * cast(r as decimal(19))) as bigint)"
    best = both.groupBy("lang", "text", "a", "n").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    scored = best.select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # parts of a language first, so that one task never holds all of its phrases
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    ahead = scored.select("*", part).withColumn("_place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    scored = ahead.where(F.col("_place") <= kept).drop("_place", "part")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")
    return scored.withColumn("rank", rank).where(F.col("rank") <= kept).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """The same in DuckDB SQL, on ``documents``."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM w WHERE len(w) >= {k}"
        for k in range(1, LONGEST + 1)
    )
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    f AS (SELECT lang, size, g, count(*) AS f FROM ({grams}) GROUP BY lang, size, g HAVING count(*) >= {LEAST}),
    longer AS (SELECT lang, f, string_split(g, ' ') AS w, size FROM f WHERE size > 2),
    inner_ AS (SELECT lang, array_to_string(w[1:size - 1], ' ') AS g, f FROM longer UNION ALL SELECT lang, array_to_string(w[2:], ' '), f FROM longer),
    covered AS (SELECT lang, g, max(f) AS outer_f FROM inner_ GROUP BY lang, g),
    own AS (SELECT f.lang, f.g, f.f AS a, f.size, string_split(f.g, ' ') AS w FROM f LEFT JOIN covered c ON c.lang = f.lang AND c.g = f.g
            WHERE f.size > 1 AND (outer_f IS NULL OR outer_f < f.f)),
    cuts AS (SELECT *, unnest(range(1, size)) AS k FROM own),
    halves AS (SELECT c.*, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * a * t.n) // (l.f::HUGEINT * r.f) AS score
               FROM cuts c JOIN t USING (lang) JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:k], ' ')
               JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.w[k + 1:], ' ')),
    best AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best)
    SELECT lang, rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {KEPT}
    """
