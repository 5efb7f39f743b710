"""Exact Jaccard joins of token sets: what the document join and the line join share.

A unit is a whole document or a line of one; its set holds the hashes of its distinct word shingles. All
sets are put into one global order, rarest shingle first, so that two sets as alike as asked must share one
of their first few shingles (the prefix). Rarity comes from counters over all shingles of the corpus, held
in a table of fixed size: shingles that fall into one counter only share a rank, and ties go by hash, so the
order is always total and the join exact. Sets are named by a 64-bit id. Full sets are computed again from
the texts of the few documents that need verifying, instead of being kept for all. Whole documents have a sketch besides, the
number of their shingles by the leading bits of the hash: two sets can have no more in common than the smaller numbers add up
to, so pairs that only met by chance go before any set is sent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textyard.llm import shingles as sh, words as wd
from textyard.llm.common import id_bitmap, in_arrow, in_bitmap, integer_ids, list_array, share, text_slices

# Counters of the rarity table (power of two): 8 MB when shared.
RARITY_SLOTS = 1 << 20
# Counters shuffled as one value.
COUNTER_RUN = 1 << 12
# Ids that a task remembers, to send the prefix of a set it has sent already only once.
SEEN_LIMIT = 1 << 18
# A prefix token with at most this many occurrences is grouped in one task; the counters only overstate.
GROUPED_LIMIT = 100_000
# Shingles a place of a sketch counts on average, half of it at least; the fewest places; the most that one place can hold.
SKETCH_SHARE = 8
SKETCH_LEAST = 16
SKETCH_MOST = 127


@dataclass(frozen=True)
class Likeness:
    """Shingle length and the least Jaccard similarity, in hundredths."""

    words: int = 5
    percent: int = 80

    def prefix(self, n):
        return n - (self.percent * n + 99) // 100 + 1

    def similar(self, common: str, a: str, b: str) -> str:
        """SQL: sets of sizes a and b with so many common members are alike."""
        return f"100 * ({common}) >= {self.percent} * ({a} + {b} - ({common}))"

    def may_be(self, na: str, nb: str, pa_: str, pb: str) -> str:
        """SQL: sets of these sizes whose first common token stands at these places can be alike: length and position.

        Nothing before the first common token is common, so no more than the rest of either set can be.
        """
        rest = f"least({na} - {pa_}, {nb} - {pb})"
        return f"{length_ok(self, na, nb)} and {self.similar(rest, na, nb)}"


@dataclass(frozen=True)
class Units:
    """How texts are cut into units: whole texts, or lines. One with fewer words than a shingle has them all as one."""

    like: Likeness
    lines: bool

    def shingles(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shingles and their unit; the row and the number (in its text) of each unit."""
        if not self.lines:
            hashes, owner = sh.word_hashes(blobs)
            tokens, who = sh.shingles(hashes, owner, self.like.words)
            return tokens, who, np.arange(len(blobs)), np.zeros(len(blobs), dtype=np.int64)
        joined = b"\n".join(blobs)
        ends = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 10)
        hashes, start = wd.gathered(wd.scan([joined], lower=True), ("hashes", "start"))
        tokens, who = sh.shingles(hashes, np.searchsorted(ends, start), self.like.words)
        sizes = np.array([b.count(b"\n") + 1 for b in blobs], dtype=np.int64)
        row = np.repeat(np.arange(len(blobs)), sizes)
        return tokens, who, row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def rarity(docs: DataFrame, units: Units, slots: int = RARITY_SLOTS) -> np.ndarray:
    """Occurrences of all shingles of all ``(doc_id, text)``, by hash modulo ``slots``."""

    def count(batches):
        total = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for _, blobs in text_slices(batch, 1):
                tokens, *_ = units.shingles(blobs)
                total += np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        yield from blocks({i: total[i * width : (i + 1) * width] for i in range(slots // width)})

    def blocks(sums):
        """A run of counters as one value: it is shuffled and added as a whole."""
        used = {i: v for i, v in sums.items() if v.any()}
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(list(used), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in used.values()])], ["block", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(blob, dtype="<i8")
        yield from blocks(sums)

    width, schema = min(COUNTER_RUN, slots), "block int, counts binary"
    summed = in_arrow(docs, count, schema).repartition("block").mapInArrow(add, schema).toArrow()
    out = np.zeros(slots, dtype=np.int64)
    for i, blob in zip(summed["block"].to_pylist(), summed["counts"].to_pylist()):
        out[i * width : (i + 1) * width] = np.frombuffer(blob, dtype="<i8")
    return out


def sketches(tokens: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Per set, how many of its tokens have each value of the leading bits; null where a number passes ``SKETCH_MOST``.

    ``tokens`` holds sets of sizes ``n`` one after the other. The places are a power of two, in proportion to the size.
    """
    bits = np.log2(np.maximum(n // SKETCH_SHARE, SKETCH_LEAST // 2)).astype(np.uint64) + np.uint64(1)
    width = np.int64(1) << bits.astype(np.int64)
    first = np.cumsum(width) - width
    place = np.repeat(first, n) + (tokens >> np.repeat(np.uint64(64) - bits, n)).astype(np.int64)
    counts = np.bincount(place, minlength=int(width.sum()))
    over = np.maximum.reduceat(counts, first) > SKETCH_MOST if len(n) else np.zeros(0, dtype=bool)
    offsets = pa.array(np.append(first, width.sum()).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.minimum(counts, SKETCH_MOST).astype(np.int8)), mask=pa.array(over))


def plausible(pairs: DataFrame, sketched: DataFrame, like: Likeness) -> DataFrame:
    """The ``pairs`` (a, b, na, nb) of set ids whose sketches, in ``(sid, sketch)``, do not rule out that they are alike.

    Where one sketch is twice as long, its neighbours are added up. A pair without comparable sketches stays.
    """
    left = sketched.select(F.col("sid").alias("a"), F.col("sketch").alias("sa"))
    right = sketched.select(F.col("sid").alias("b"), F.col("sketch").alias("sb"))
    halved = lambda s: f"transform(sequence(1, size({s}), 2), i -> {s}[i - 1] + int({s}[i]))"
    least = lambda x, y: f"aggregate(zip_with({x}, {y}, (x, y) -> int(least(x, y))), 0L, (s, x) -> s + x)"
    common = f"case when size(sa) = size(sb) then {least('sa', 'sb')} when size(sa) = 2 * size(sb) then {least(halved('sa'), 'sb')} when size(sb) = 2 * size(sa) then {least('sa', halved('sb'))} end"
    met = pairs.join(left, "a").join(right, "b").withColumn("common", F.expr(common))
    return met.where(F.col("common").isNull() | F.expr(like.similar("common", "na", "nb"))).select("a", "b", "na", "nb")


def profiles(docs: DataFrame, units: Units, counts: np.ndarray) -> DataFrame:
    """One row per unit: doc_id, number, n (set size), sid (set id), pid (id of size and prefix), cold (prefix
    tokens with few occurrences; they come first) and the prefix, empty where this task has sent the same before;
    for whole documents the sketch too. A unit without shingles has n = 0 and null ids."""
    counts = share(docs, counts)
    limit = max(GROUPED_LIMIT, int(4 * counts.value.mean()))
    like = units.like

    def describe(batches):
        table, seen = counts.value, set()
        for batch in batches:
            for part, blobs in text_slices(batch, 1):
                ids, valid = integer_ids(part, 0)
                tokens, who, row, number = units.shingles(blobs)
                tokens, who, rare = sh.ordered_sets(tokens, who, table)
                unit, first, n = sh.runs(who)
                sid = sh.set_ids(tokens, first, n)
                length = like.prefix(n)
                place = np.arange(len(tokens)) - np.repeat(first, n)
                head = place < np.repeat(length, n)
                prefix, starts = tokens[head], np.cumsum(length) - length
                pid = sh.set_ids(prefix, starts, n) if len(n) else sid
                cold = np.add.reduceat((rare[head] <= limit).astype(np.int64), starts) if len(n) else n
                if len(seen) > SEEN_LIMIT:
                    seen = set()
                send = np.ones(len(n), dtype=bool)
                for i, p in enumerate(pid.tolist()):
                    send[i] = p not in seen
                    seen.add(p)
                count = len(row)
                full = {"n": np.zeros(count, np.int64), "cold": np.zeros(count, np.int64), "sid": np.zeros(count, np.int64), "pid": np.zeros(count, np.int64), "size": np.zeros(count, np.int64)}
                full["n"][unit], full["cold"][unit] = n, cold
                full["sid"][unit], full["pid"][unit] = sid.view(np.int64), pid.view(np.int64)
                full["size"][unit] = np.where(send, length, 0)
                none, absent = full["n"] == 0, ~valid[row]
                sent = prefix[np.repeat(send, length)] if len(n) else prefix
                columns = {
                    "doc_id": pa.array(ids[row], pa.int64(), mask=absent), "number": pa.array(number, pa.int32()), "n": pa.array(full["n"]),
                    "sid": pa.array(full["sid"], mask=none), "pid": pa.array(full["pid"], mask=none),
                    "cold": pa.array(full["cold"], pa.int32()), "prefix": list_array(sent.view(np.int64), full["size"], pa.int64()),
                }
                if not units.lines:
                    place = np.full(count, -1)
                    place[unit] = np.arange(len(unit))
                    columns["sketch"] = sketches(tokens, n).take(pa.array(place, mask=none))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, number int, n bigint, sid bigint, pid bigint, cold int, prefix array<bigint>"
    return in_arrow(docs, describe, schema if units.lines else f"{schema}, sketch array<tinyint>")


def shared_tokens(prefixes: DataFrame, by: str) -> DataFrame:
    """(token, ``by``, n, pos) of the prefix tokens that occur with more than one ``by``.

    Tokens with few occurrences are grouped to see that; their groups are bounded by ``GROUPED_LIMIT``. The
    others are kept as they are, since a join can split them.
    """
    rows = prefixes.where(F.size("prefix") > 0).select(by, "n", "cold", F.posexplode("prefix").alias("pos", "token"))
    keep = ["token", by, "n", "pos"]
    group = Window.partitionBy("token")
    few = rows.where("pos < cold").select(*keep)
    few = few.select(*keep, F.min(by).over(group).alias("lo"), F.max(by).over(group).alias("hi")).where("lo <> hi").select(*keep)
    # equal rows are on the same side of the cut; the grouped ones are in one task by now and need no other shuffle
    return few.distinct().union(rows.where("pos >= cold").select(*keep).distinct())


def verified(docs: DataFrame, units: Units, pairs: DataFrame, homes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of set ids, sizes in ``na`` and ``nb``, that are alike.

    ``homes`` has ``(sid, doc_id)``: a document that holds the set. Only those documents are cut again.
    """
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = share(docs, (id_bitmap(ends, "sid"), id_bitmap(ends.join(homes, "sid"), "doc_id")))

    def members(batches):
        sids, homes_ = wanted.value
        seen = set()
        for batch in batches:
            ids, valid = integer_ids(batch, 0)
            batch = batch.filter(pa.array(valid & in_bitmap(homes_, ids)))
            for _, blobs in text_slices(batch, 1):
                tokens, who, *_ = units.shingles(blobs)
                tokens, who, _ = sh.ordered_sets(tokens, who, None)
                _, first, n = sh.runs(who)
                sid = sh.set_ids(tokens, first, n).view(np.int64)
                take = in_bitmap(sids, sid)
                if len(seen) > SEEN_LIMIT:
                    seen = set()
                for i in np.flatnonzero(take):
                    take[i] = sid[i] not in seen
                    seen.add(int(sid[i]))
                if take.any():
                    chosen = tokens[np.repeat(take, n)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(sid[take]), list_array(chosen, n[take], pa.int64())], ["sid", "members"])

    sets = in_arrow(docs, members, "sid bigint, members array<bigint>")
    left = sets.select(F.col("sid").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("sid").alias("b"), F.col("members").alias("mb"))
    common = "size(array_intersect(ma, mb))"
    return pairs.join(left, "a").join(right, "b").where(units.like.similar(common, "na", "nb")).select("a", "b").distinct()


def length_ok(like: Likeness, a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {like.percent} * greatest({a}, {b})"
