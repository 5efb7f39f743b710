"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once with numpy.

Words are runs of anything but the six ASCII spaces; A-Z count as a-z. UTF-8 keeps those bytes apart
from all others, so words are cut in the bytes. Two different words or shingles share a hash with
probability 2**-64.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the public SplitMix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base & _MASK, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of its text in ``blobs``, in order."""
    joined = b" ".join(blobs).lower()
    buf = np.frombuffer(joined, dtype=np.uint8)
    if not len(buf):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buf] * power[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    first = np.zeros(len(blobs), dtype=np.int64)
    np.cumsum([len(b) + 1 for b in blobs[:-1]], out=first[1:])
    return hashes, np.searchsorted(first, starts, side="right") - 1


def shingles(hashes: np.ndarray, owner: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of one owner; an owner with fewer words has its whole sequence as one
    (or nothing, if not ``short``). Not yet distinct; owners ascend."""
    n = len(hashes)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    m = max(n - k + 1, 0)
    total = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        total += hashes[j : j + m] * factors[j]
    whole = owner[:m] == owner[k - 1 : k - 1 + m] if m else np.zeros(0, dtype=bool)
    out, who = mix(total[whole]), owner[:m][whole]
    if short and n:
        begin = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
        size = np.diff(np.append(begin, n))
        few = np.flatnonzero(size < k)
        if len(few):
            whole_few = np.zeros(len(few), dtype=np.uint64)
            for j in range(k - 1):
                has = size[few] > j
                whole_few[has] += hashes[begin[few][has] + j] * factors[j]
            whole_few = mix(whole_few + size[few].astype(np.uint64))
            out, who = np.concatenate([out, whole_few]), np.concatenate([who, owner[begin[few]]])
            order = np.argsort(who, kind="stable")
            out, who = out[order], who[order]
    return out, who


def ordered_sets(tokens: np.ndarray, owner: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each owner, rarest first by the counters, ties by hash.

    Returns tokens, owners and the counter of each token.
    """
    rarity = counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)] if counts is not None else np.zeros(len(tokens), dtype=np.int64)
    order = np.lexsort((tokens, rarity, owner))
    tokens, owner, rarity = tokens[order], owner[order], rarity[order]
    if len(tokens):
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner, rarity = tokens[new], owner[new], rarity[new]
    return tokens, owner, rarity


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first place and size of each run of equal owners."""
    if not len(owner):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    first = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    return owner[first], first, np.diff(np.append(first, len(owner)))


def set_ids(tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal sets have equal ids, others only with probability 2**-64."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    a = np.add.reduceat(mix(tokens + np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    b = np.add.reduceat(mix(tokens ^ np.uint64(0x3C3C3C3C3C3C3C3C)), first)
    return mix(mix(a) + (b ^ sizes.astype(np.uint64)))
