"""Words of whole texts as 64-bit hashes, scanned in pieces of bounded size.

A text is read in pieces of at most ``PIECE`` bytes, cut anywhere: a word that a cut divides is hashed from its
parts, so memory per byte of text does not depend on where its spaces are. Two different words share a hash with
probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from textyard.llm import shingles as sh

PIECE = 1 << 20


class Words(NamedTuple):
    """One entry per word, in order: hash, number of its text, first byte and length there, run it belongs to."""

    hashes: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    length: np.ndarray
    run: np.ndarray


def byte_set(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


SPACES = byte_set(b" \t\n\x0b\x0c\r")


def groups(blobs: list[bytes], piece: int = PIECE) -> Iterator[tuple[int, int, int]]:
    """(first text, end text, first byte): short texts share a group of at most ``piece`` bytes, a long text is
    given piece by piece."""
    at = 0
    while at < len(blobs):
        if len(blobs[at]) > piece:
            for begin in range(0, len(blobs[at]), piece):
                yield at, at + 1, begin
            at += 1
            continue
        end, total = at, 0
        while end < len(blobs) and total + len(blobs[end]) + 1 <= piece + 1:
            total += len(blobs[end]) + 1
            end += 1
        yield at, end, 0
        at = end


def scan(blobs: list[bytes], apart: np.ndarray = SPACES, breaks: np.ndarray | None = None, lower: bool = False, piece: int = PIECE) -> Iterator[Words]:
    """The words of ``blobs``: longest runs of bytes outside ``apart`` (which holds the line feed).

    A run of words ends at the end of a text and, if given, at each byte of ``breaks``. With ``lower`` A-Z count as a-z.
    """
    run, open_word = 0, None  # open_word: raw sum, length, first byte of a word that the last cut divided
    for first, end, begin in groups(blobs, piece):
        if begin == 0:
            run += 1
        if end - first == 1:
            data = blobs[first] if begin == 0 and len(blobs[first]) <= piece else blobs[first][begin : begin + piece]
            more = begin + piece < len(blobs[first])
        else:
            data, more = b"\n".join(blobs[first:end]), False
        buf = np.frombuffer(data.lower() if lower else data, dtype=np.uint8)
        if not len(buf):
            continue
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = ~apart[buf]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = sh._powers(piece + 2)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(sh._BYTES[buf] * power[: len(buf)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        sizes = np.array([len(b) + 1 for b in blobs[first:end]], dtype=np.int64)
        offset = np.cumsum(sizes) - sizes
        owner = np.searchsorted(offset, starts, side="right") - 1
        place, length = starts - offset[owner] + begin, ends - starts
        if breaks is not None:
            stops = np.cumsum(breaks[buf], dtype=np.int64)
            number = run + stops[starts] + owner  # a word's first byte is no break
            run += int(stops[-1]) + end - first - 1
        else:
            number = run + owner
            run += end - first - 1
        if open_word is not None:
            value, size, where, its_run = open_word
            open_word = None
            if len(starts) and starts[0] == 0:
                raw[0] = np.uint64((value + int(raw[0]) * pow(sh._BASE, size, 1 << 64)) & sh._MASK)
                place[0], length[0], number[0] = where, length[0] + size, its_run
            else:
                yield _word(value, first, where, size, its_run)
        last = len(starts)
        if more and last and ends[-1] == len(buf):
            last -= 1
            open_word = (int(raw[-1]), int(length[-1]), int(place[-1]), int(number[-1]))
        yield Words(sh.mix(raw[:last]), (owner[:last] + first).astype(np.int32), place[:last], length[:last].astype(np.int32), number[:last])


def _word(value: int, owner: int, start: int, length: int, run: int) -> Words:
    return Words(
        sh.mix(np.array([value], dtype=np.uint64)), np.array([owner], np.int32), np.array([start], np.int64),
        np.array([length], np.int32), np.array([run], np.int64),
    )


def gathered(parts: Iterator[Words], fields: tuple[str, ...]) -> list[np.ndarray]:
    """The named fields of all parts, each in one array."""
    kinds = {"hashes": np.uint64, "owner": np.int32, "start": np.int64, "length": np.int32, "run": np.int64}
    kept: dict[str, list] = {f: [np.zeros(0, dtype=kinds[f])] for f in fields}
    for part in parts:
        for f in fields:
            kept[f].append(getattr(part, f))
    return [np.concatenate(kept[f]) for f in fields]
