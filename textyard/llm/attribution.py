"""Token counts by section: each whole document is encoded once and its tokens are joined to sections by their spans.

The tokenizer is byte-level, so the tokens of a text adjoin and their spans are running sums of token lengths
in bytes. A token belongs to the section in which its span lies; one that crosses a boundary goes to one
section by an explicit rule, so that the counts of a document's sections always sum up to its tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textyard.llm.common import integer_ids, text_slices

RULES = ("first", "last", "most")


class ByteTokens:
    """Ids and byte lengths of a rank file's tokens; loaded once per task."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.length[list(ranks.values())] = [len(t) for t in ranks]

    def ends(self, blob: bytes) -> np.ndarray:
        """Where each token of the text ends, in bytes."""
        return np.cumsum(self.length[self.encoding.encode_ordinary(blob.decode("utf-8", "replace"))])


def allot(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary. ``starts`` ascends from 0; a section of no
    bytes gets no token. Rules: the section of the first byte, of the last, or of most bytes (ties: the earlier)."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    home = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        stops = np.append(starts[1:], ends[-1] if len(ends) else 0)
        for t in crossing:
            over = np.arange(first[t], last[t] + 1)
            home[t] = over[np.argmax(np.minimum(stops[over], ends[t]) - np.maximum(starts[over], begins[t]))]
    return np.bincount(home, minlength=len(starts)), np.bincount(home[crossing], minlength=len(starts))


def line_starts(blob: bytes) -> np.ndarray:
    """Lines as sections; a line break belongs to the line it ends."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(blob, dtype=np.uint8) == 10) + 1])


def tokens_by_line(docs: DataFrame, rule: str = "first", path: str | None = None) -> DataFrame:
    """doc_id, section (line number from 0), n_tokens and n_crossing for every line of every text.

    A null or empty text has one section without tokens. Rows that share a doc_id each give their sections; a
    null doc_id is kept. Columns besides doc_id and text are not read.
    """
    return _counted(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), None, rule, path).select("doc_id", "section", "n_tokens", "n_crossing")


def tokens_by_field(rows: DataFrame, key: str, fields: list[str], separator: str = "\n", rule: str = "first", path: str | None = None) -> DataFrame:
    """``key``, field and its tokens when the fields are encoded as one document, joined by ``separator``.

    The separator belongs to the field before it; a null field is empty.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    sizes = [F.octet_length(F.concat(p, F.lit(separator)) if i + 1 < len(parts) else p) for i, p in enumerate(parts)]
    whole = rows.select(F.col(key).cast("bigint").alias("doc_id"), F.concat_ws(separator, *parts).alias("text"), F.array(*sizes).alias("sizes"))
    counted = _counted(whole, 2, rule, path)
    return counted.select(F.col("doc_id").alias(key), F.element_at(F.array(*map(F.lit, fields)), F.col("section") + 1).alias("field"), "n_tokens", "n_crossing")


def _counted(texts: DataFrame, sizes: int | None, rule: str, path: str | None) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches):
        tokens = ByteTokens(path)
        for batch in batches:
            for part, blobs in text_slices(batch, 1):
                ids, valid = integer_ids(part, 0)
                given = part.column(sizes).to_pylist() if sizes is not None else None
                starts = [line_starts(b) if given is None else np.concatenate([[0], np.cumsum(given[i])[:-1]]).astype(np.int64) for i, b in enumerate(blobs)]
                pairs = [allot(tokens.ends(b), s, rule) for b, s in zip(blobs, starts)]
                sections = np.array([len(s) for s in starts])
                row = np.repeat(np.arange(len(blobs)), sections)
                number = np.concatenate([np.arange(n) for n in sections]) if len(sections) else sections
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row], mask=~valid[row]), pa.array(number, pa.int32()), pa.array(np.concatenate([p[0] for p in pairs]).astype(np.int64)), pa.array(np.concatenate([p[1] for p in pairs]).astype(np.int64))],
                    ["doc_id", "section", "n_tokens", "n_crossing"],
                )

    return texts.mapInArrow(count, "doc_id bigint, section int, n_tokens bigint, n_crossing bigint")
