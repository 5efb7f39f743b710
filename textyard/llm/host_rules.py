"""Host-level quality rules: failures of document rules counted by host, shrunk rates, verdicts joined back.

Two rules judge a document by itself: too few words, or too many of them in repeated windows. A host's rate of
failing documents is drawn towards the rate of all hosts by a beta prior whose strength the hosts' own scatter gives
(moments of the beta-binomial), so that a host of few documents is not judged on chance. All documents of a host
whose shrunk rate passes ``MAX_RATE`` go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textyard.llm import shingles as sh, words as wd
from textyard.llm.common import stored, text_slices
from textyard.session import join_per_group

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
# A host with a larger shrunk rate of failing documents is rejected whole.
MAX_RATE = 0.5
# Most correlation within hosts: the prior weighs as much as one document at least.
MOST_ALIKE = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOLS = wd.byte_set(b"#*$%&|<>")
# bytes that start no new code point
_INNER = np.arange(256) & 0xC0 == 0x80


def repeated_words(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``window`` words that its text holds twice or more."""
    inside = np.zeros(len(hashes) + 1, dtype=np.int32)
    m = len(hashes) - window + 1
    if m < 2:
        return inside[:-1] > 0
    begin = np.flatnonzero(owner[:m] == owner[window - 1 :])
    found, who = sh.shingles(hashes, owner, window, short=False)
    key = found ^ sh.mix(who.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = begin[twice]
    inside[at] += 1
    inside[at + window] -= 1
    return np.cumsum(inside[:-1]) > 0


def repeated_lines(blob: bytes, whole: int = wd.PIECE) -> int:
    """Lines with a word that equal an earlier line; of a text longer than ``whole`` only line hashes are kept."""
    if len(blob) <= whole:
        lines = [line for line in blob.split(b"\n") if line.strip()]
        return len(lines) - len(set(lines))
    hashes, view, begin = [], memoryview(blob), 0
    count, seen = 0, np.zeros(0, dtype=np.uint64)
    while begin <= len(blob):
        end = blob.find(b"\n", begin)
        end = len(blob) if end < 0 else end
        line = view[begin:end]
        if any(bytes(line[i : i + 4096]).strip() for i in range(0, len(line), 4096)):
            hashes.append(xxhash.xxh3_64_intdigest(line))
            count += 1
        begin = end + 1
        if len(hashes) >= 1 << 16:
            seen, hashes = np.union1d(seen, np.array(hashes, dtype=np.uint64)), []
    return count - len(np.union1d(seen, np.array(hashes, dtype=np.uint64)))


def counts(blobs: list[bytes]) -> list[np.ndarray]:
    """The columns ``COUNTS`` of the texts."""
    n = len(blobs)
    hashes, owner = wd.gathered(wd.scan(blobs), ("hashes", "owner"))
    signs, chars = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for first, end, begin in wd.groups(blobs):
        part = blobs[first:end] if begin == 0 and end - first > 1 else [blobs[first][begin : begin + wd.PIECE]]
        buf = np.frombuffer(b"".join(part), dtype=np.uint8)
        upto = np.cumsum([0, *(len(b) for b in part)])
        for out, mask in ((signs, _SYMBOLS[buf]), (chars, ~(wd.SPACES | _INNER)[buf])):
            total = np.zeros(len(buf) + 1, dtype=np.int64)
            np.cumsum(mask, out=total[1:])
            out[first:end] += np.diff(total[upto])
    repeats = np.bincount(owner[repeated_words(hashes, owner)], minlength=n)
    lines = np.array([repeated_lines(b) for b in blobs], dtype=np.int64)
    return [np.bincount(owner, minlength=n), chars, signs, lines, repeats]


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each whole text."""
    source = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blobs in text_slices(batch, 2):
                values = [pa.array(v.astype(np.int64)) for v in counts(blobs)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *values], names=["doc_id", "host", *COUNTS])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, host string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """host, its documents and failures, and its rate shrunk towards the rate of all hosts.

    With rate m over N documents of H hosts, the hosts' scatter S = sum n (p - m)^2 is m (1 - m) ((H - 1) + r (N - sum n^2 / N
    - (H - 1))) on average, where r is the correlation within hosts; the prior is beta with mean m and strength 1 / r - 1.
    r counts as ``MOST_ALIKE`` at most. Where the hosts scatter no more than chance (r <= 0) or there is nothing to compare, every host has rate m.
    """
    hosts = stored(judged.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("host_failures")))
    n, f = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    # one row, whatever the number of hosts
    sums = hosts.agg(
        F.count(F.lit(1)).alias("h"), F.sum("host_docs").alias("n"), F.sum("host_failures").alias("f"),
        F.sum(f * f / n).alias("ff"), F.sum(n * n).alias("nn"),
    ).first()
    if not sums["n"]:
        return hosts.withColumn("host_rate", F.lit(0.0))
    total, m = float(sums["n"]), sums["f"] / sums["n"]
    spread, free = m * (1 - m), sums["h"] - 1
    room = total - sums["nn"] / total - free
    r = ((sums["ff"] - sums["f"] ** 2 / total) / spread - free) / room if spread > 0 and room > 0 else 0.0
    r = min(r, MOST_ALIKE)
    if r <= 0:
        return hosts.withColumn("host_rate", F.lit(float(m)))
    strength = 1 / r - 1
    return hosts.withColumn("host_rate", (f + F.lit(strength * m)) / (n + F.lit(strength)))


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, host, the counts, base_failed, the host's documents, failures and rate (6 places), and kept.

    A null text has no words, a null host is a host of its own, rows sharing a doc_id are judged each, a null doc_id is
    kept as it is. An empty table gives an empty result. Columns besides doc_id, text and the host are not read.

    Texts pass once; hosts are counted with partial sums in each task, so a host with a third of all documents sends a row
    a task. Few hosts are broadcast, beyond that the hosts of most documents are.
    """
    judged = stored(measured(docs, host).withColumn("base_failed", base_failed()))
    rates = host_rates(judged).select(_key(), "host_docs", "host_failures", F.round("host_rate", 6).alias("host_rate"))
    joined = join_per_group(judged.withColumn("_key", _key()), rates, ["_key"]).drop("_key")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))


def _key():
    """A host as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), "host"), F.lit("null")).alias("_key")


def keep(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns: each row is judged by its own text and host."""
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    rows = whole.select(F.monotonically_increasing_id().alias("doc_id"), F.col(f"row.{host}").alias("host"), F.col("row.text").alias("text"), "row")
    # the numbers hold in what is stored, not in a second evaluation
    rows = stored(rows)
    kept = judge(rows, "host", max_rate).where("kept").select("doc_id")
    return rows.join(kept, "doc_id", "left_semi").select("row.*")


def judge_sql() -> str:
    """The same in DuckDB SQL, on ``documents``."""
    window = f"array_to_string(w[i:i + {WINDOW - 1}], ' ')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
    v AS (SELECT rid, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: {{'i': i, 'g': {window}}}), recursive := true) FROM w),
    twice AS (SELECT rid, i FROM v QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    places AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice),
    repeats AS (SELECT rid, count(*) AS n FROM places GROUP BY rid),
    lines AS (SELECT rid, l, count(*) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
              WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid, l),
    dups AS (SELECT rid, CAST(sum(n - 1) AS BIGINT) AS n FROM lines GROUP BY rid),
    m AS (SELECT doc_id, host, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
                 coalesce(repeats.n, 0) AS n_repeat_words
          FROM w LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid)),
    j AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m),
    hosts AS (SELECT host, count(*) AS host_docs, count(*) FILTER (base_failed) AS host_failures FROM j GROUP BY host),
    sums AS (SELECT count(*) - 1 AS free, sum(host_docs)::DOUBLE AS n, sum(host_failures)::DOUBLE AS f,
                    sum(host_failures::DOUBLE * host_failures / host_docs) AS ff, sum(host_docs::DOUBLE * host_docs) AS nn FROM hosts),
    prior AS (SELECT f / n AS m, least(((ff - f * f / n) / nullif(f / n * (1 - f / n), 0) - free) / nullif(greatest(n - nn / n - free, 0), 0), {MOST_ALIKE}) AS r FROM sums),
    rates AS (SELECT host, host_docs, host_failures,
                     round(CASE WHEN r > 0 THEN (host_failures + (1 / r - 1) * m) / (host_docs + (1 / r - 1)) ELSE m END, 6) AS host_rate
              FROM hosts, prior)
    SELECT doc_id, j.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failures, host_rate,
           NOT base_failed AND host_rate <= {MAX_RATE} AS kept
    FROM j JOIN rates ON j.host IS NOT DISTINCT FROM rates.host
    """
