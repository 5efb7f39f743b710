"""Packing token sequences by cutting-stock column generation.

Documents are encoded once and cut into pieces of at most the sequence length. The histogram of piece lengths
(in classes of ``unit`` tokens, rounded up) is the demand of a cutting-stock problem; a linear program over
patterns (how many pieces of each class share a sequence) is solved by column generation, where a knapsack
dynamic program prices new patterns. Only the histogram, whose size is fixed, reaches the driver. Patterns are
rounded down to whole sequences, what is left over is filled greedily, and pieces, ranked within their class,
take the slots of the patterns.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textyard.llm import words as wd
from textyard.llm.common import in_arrow, stored, text_slices

LENGTH = 2048
UNIT = 8
END_ID = 1
# Distinct words that a worker remembers, and their ids in all.
WORD_CACHE = 1_500_000
ID_CACHE = 1 << 23
# Text encoded at once: the more, the fewer distinct words are looked up for all of them, and the more arrays per word and id are held.
SLICE = 1 << 20
# Pieces ranked in one task.
RANK_ROWS = 50_000


class Words:
    """Ids of texts by a tokenizer that cuts at white space, lower-cases, and marks word ends by a suffix.

    Texts are cut at ASCII white space, where no token can cross. Words are told apart by 64-bit hashes, each distinct one is
    looked up once for a slice of text and encoded once per worker. Letters-only words are encoded many at a time and cut at
    the word-end ids.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # the words known: hashes in order, where their ids begin in the flat table, and how many they are
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many ids each word has."""
        text = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(text) if t.isalpha()]
        other = [i for i, t in enumerate(text) if not t.isalpha()]
        sizes, parts, order = np.zeros(len(text), dtype=np.int64), [], [*plain, *other]
        for i in range(0, len(plain), 256 * 16):
            runs = [plain[j : j + 256] for j in range(i, min(i + 256 * 16, len(plain)), 256)]
            for run, found in zip(runs, self._batch([" ".join(text[k] for k in run) for run in runs])):
                cuts = np.flatnonzero(self.ends[found]) + 1
                if len(cuts) == len(run):
                    sizes[run] = np.diff(cuts, prepend=0)
                else:
                    each = self._batch([text[k] for k in run])
                    sizes[run] = [len(e) for e in each]
                    found = np.concatenate(each)
                parts.append(found)
        for i in range(0, len(other), 1024):
            each = self._batch([text[k] for k in other[i : i + 1024]])
            sizes[other[i : i + 1024]] = [len(e) for e in each]
            parts += each
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        # from the order of encoding back to that of the words
        begin = np.zeros(len(text), dtype=np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[_runs(begin, sizes)], sizes

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Add words, hashes ascending."""
        flat, sizes = self._ids(words)
        at = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.keys, self.size = np.insert(self.keys, at, keys), np.insert(self.size, at, sizes)
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many ids each text has."""
        hashes, owner, start, length = wd.gathered(wd.scan(blobs, lower=True), ("hashes", "owner", "start", "length"))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place, known = self._find(distinct)
        missing = np.flatnonzero(~known)
        if len(missing):
            if len(self.keys) + len(missing) > WORD_CACHE or len(self.flat) > ID_CACHE:
                self._keep(place[known])
            at = first[missing]
            new = [blobs[o][s : s + n].lower() for o, s, n in zip(owner[at].tolist(), start[at].tolist(), length[at].tolist())]
            self._learn(distinct[missing], new)
        place = self._find(distinct)[0][which]
        size = self.size[place]
        return self.flat[_runs(self.begin[place], size)], np.bincount(owner, weights=size, minlength=len(blobs)).astype(np.int64)

    def _keep(self, places: np.ndarray) -> None:
        """Forget all words but those at these places, ascending."""
        self.flat = self.flat[_runs(self.begin[places], self.size[places])]
        self.keys, self.size = self.keys[places], self.size[places]
        self.begin = np.cumsum(self.size) - self.size

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of runs, one run after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


# One tokenizer and its words for all tasks of a Python worker.
_WORDS: dict[str | None, Words] = {}


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode ``(doc_id, text)`` and cut at multiples of ``length``: doc_id, start, length, ids_crc32, doc_tokens,
    and the ids themselves if asked. A document ends with ``end_id``; a null text is empty."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * with_ids

    def encode(batches):
        words = _WORDS[path] if path in _WORDS else _WORDS.setdefault(path, Words(path))
        for batch in batches:
            for part, blobs in text_slices(batch, 1, SLICE):
                ids, sizes = words.encode(blobs)
                rows, at = [[] for _ in range(5 + with_ids)], 0
                for doc, size in zip(part.column(0).to_pylist(), sizes.tolist()):
                    whole = np.append(ids[at : at + size], end_id).astype("<u4")
                    at += size
                    for start in range(0, len(whole), length):
                        piece = whole[start : start + length]
                        for column, value in zip(rows, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(whole), piece)):
                            column.append(value)
                arrays = [pa.array(c, pa.int64()) for c in rows[:5]] + [pa.array(c, pa.list_(pa.int64())) for c in rows[5:]]
                yield pa.RecordBatch.from_arrays(arrays, names=schema_names(schema))

    return in_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), encode, schema)


def schema_names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def patterns(demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold ``demand[i]`` items of size ``i + 1`` in bins of ``capacity``.

    The linear program over patterns starts from a greedy solution: patterns of large sizes first, each used until
    a size runs out, so that they form a triangular basis. Revised simplex then brings in the pattern that an
    unbounded knapsack prices best, until none saves more than ``gap`` of the bound or ``rounds`` are over. Prices
    are drawn towards sizes (a price system that is always valid), which keeps them from swinging.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    need = demand[sizes - 1].astype(float)
    basis, amount = greedy_basis(sizes, need, capacity)
    inverse = np.linalg.inv(np.array(basis).T)
    by_size = sizes / capacity
    bound = max(float(need @ by_size), 1.0)
    for _ in range(rounds):
        if amount.sum() <= bound * (1 + gap):
            break
        price = inverse.sum(axis=0)
        for trust in (0.2, 0.6, 1.0):
            drawn = np.maximum(trust * price + (1 - trust) * by_size, 0)
            column = best_pattern(drawn, sizes, capacity)
            bound = max(bound, float(need @ drawn) / max(1.0, float(drawn @ column)))
            if price @ column > 1 + 1e-7:
                break
        else:
            break
        move = inverse @ column
        ratio = np.where(move > 1e-8, amount / np.where(move > 1e-8, move, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(ratio[out], 0.0)
        amount -= step * move
        amount[out] = step
        inverse[out] /= move[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(move[others], inverse[out])
        basis[out] = column
    whole = np.floor(np.maximum(amount, 0) + 1e-9).astype(np.int64)
    left = demand[sizes - 1].astype(np.int64)
    found = []
    for column, times in zip(basis, whole):
        items = np.round(column).astype(np.int64)
        used = items > 0
        times = min(int(times), int((left[used] // items[used]).min()))
        if times:
            left -= times * items
            found.append((full_pattern(items, sizes, len(demand)), times))
    while left.any():
        items, room = np.zeros_like(left), capacity
        for i in np.flatnonzero(left)[::-1]:
            items[i] = min(left[i], room // sizes[i])
            room -= items[i] * sizes[i]
        used = items > 0
        times = int((left[used] // items[used]).min())
        left -= times * items
        found.append((full_pattern(items, sizes, len(demand)), times))
    return found


def greedy_basis(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One pattern per size, and how often each is used: the fullest pattern of the sizes left, large ones
    preferred, until one of its sizes is used up."""
    left, basis, amount = need.copy(), [], []
    live = np.ones(len(sizes), dtype=bool)
    while live.any():
        at = np.flatnonzero(live)
        worth = sizes[at] / capacity + 1e-4 * (sizes[at] / capacity) ** 2
        column = np.zeros(len(sizes))
        column[at] = best_pattern(worth, sizes[at], capacity)
        used = np.flatnonzero(column)
        spent = used[np.argmin(left[used] / column[used])]
        times = left[spent] / column[spent]
        left = np.maximum(left - times * column, 0)
        live[spent] = False
        left[spent] = 0
        basis.append(column)
        amount.append(times)
    return basis, np.array(amount)


def full_pattern(items: np.ndarray, sizes: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros(classes, dtype=np.int64)
    out[sizes - 1] = items
    return out


def best_pattern(price: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern of highest total price: unbounded knapsack by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, room, side="right"))
        best[room] = best[room - 1]
        if n:
            value = best[room - sizes[:n]] + price[:n]
            i = int(np.argmax(value))
            if value[i] > best[room] + 1e-12:
                best[room], choice[room] = value[i], i
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            column[choice[room]] += 1
            room -= sizes[choice[room]]
    return column


def pack(docs: DataFrame, length: int = LENGTH, unit: int = UNIT, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: the columns of ``pieces``, sequence_id and offset.

    Each id of each document lies in exactly one piece; the pieces of a sequence adjoin from offset 0 and hold
    at most ``length`` ids. Rows that share a doc_id are packed each on their own; a null doc_id is kept.
    Columns besides doc_id and text are not read.
    """
    if length % unit:
        raise ValueError("length must be a multiple of unit")
    spark = docs.sparkSession
    cut = stored(pieces(docs, length, path=path, with_ids=with_ids).withColumn("size_class", F.expr(f"int((length + {unit - 1}) div {unit})")))
    counts = {r["size_class"]: r["n"] for r in cut.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.zeros(length // unit, dtype=np.int64)
    for size, n in counts.items():
        demand[size - 1] = n
    slots, taken, sequence = [], np.zeros(len(demand), dtype=np.int64), 0
    for items, times in patterns(demand, length // unit):
        for i in np.flatnonzero(items):
            slots.append((int(i + 1), int(taken[i]), int(taken[i] + times * items[i]), int(items[i]), sequence))
            taken[i] += times * items[i]
        sequence += times
    # as Arrow, as rows would start plain Python workers beside those that encode
    fields = [pa.field("size_class", pa.int32()), *(pa.field(c, pa.int64()) for c in ("lo", "hi", "copies", "first"))]
    layout = spark.createDataFrame(pa.table([pa.array([s[i] for s in slots], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields)))
    parts = max(1, int(demand.sum()) // RANK_ROWS)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("size_class", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = dealt.join(offsets, ["size_class", "part"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("size_class", "part").orderBy("doc_id", "start", "ids_crc32")) - 1)
    # at most a few patterns per class: the table has at most (length / unit) squared rows
    placed = ranked.join(F.broadcast(layout), "size_class").where("rank >= lo and rank < hi")
    placed = placed.withColumn("sequence_id", F.expr("first + (rank - lo) div copies")).withColumn("slot", F.expr("(rank - lo) % copies"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("size_class").desc(), "slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "sequence_id", "offset")
