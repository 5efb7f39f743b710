"""Toxicity: non-negative positive-unlabelled learning of a linear classifier over hashed words.

Confirmed toxic texts are the positives, texts without regard to any label the unlabelled ones. The risk is
the class-prior-corrected estimate prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]): where
the second part turns negative, the step goes back on it. Features are words and their first few bytes, by
hash, so that forms of one stem share a feature. Learning uses bounded samples, scoring every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textyard.llm import shingles as sh
from textyard.llm.common import share, slot_counts, text_slices
from textyard.llm.quality import held_out, labelled_rows

POSITIVE_ROWS = 10_000
UNLABELLED_ROWS = 30_000
SLOTS = 1 << 18
FEATURES = 1024
STEMS = (4, 5, 6)
THRESHOLD = 0.5
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of each text and the number of their text, in order of texts.

    Words are runs of letters, digits and non-ASCII bytes; each gives itself and its first bytes, if longer.
    """
    buf = np.frombuffer(b" ".join(blobs).lower(), dtype=np.uint8)
    if not len(buf):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = sh._powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(sh._BYTES[buf] * power[:-1], out=sums[1:])
    first = np.zeros(len(blobs), dtype=np.int64)
    np.cumsum([len(b) + 1 for b in blobs[:-1]], out=first[1:])
    owner = np.searchsorted(first, start, side="right") - 1
    slots, who = [], []
    for n in (0, *STEMS):
        use = slice(None) if n == 0 else end - start > n
        stop = end if n == 0 else start[use] + n
        hashed = sh.mix((sums[stop] - sums[start[use]]) * inverse[start[use]] + np.uint64(n))
        slots.append((hashed & np.uint64(SLOTS - 1)).astype(np.int64))
        who.append(owner[use])
    pairs = np.unique(np.concatenate(who) * SLOTS + np.concatenate(slots))
    return pairs % SLOTS, pairs // SLOTS


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    intercept: float

    def scores(self, blobs: list[bytes]) -> np.ndarray:
        slots, who = features(blobs)
        margin = np.bincount(who, self.weights[slots], minlength=len(blobs)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the non-negative risk with logistic loss; rows are lists of features that are 1."""
    sizes = np.array([len(r) for r in positive + unlabelled])
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.concatenate([*positive, *unlabelled]).astype(np.int64) if len(row) else np.zeros(0, dtype=np.int64)
    n, is_positive = len(positive), np.arange(len(sizes)) < len(positive)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    share_p, share_u = 1 / max(n, 1), 1 / max(len(unlabelled), 1)
    for step in range(1, steps + 1):
        f = np.bincount(row, w[column], minlength=len(sizes)) + b
        s = 1 / (1 + np.exp(-f))
        negative_loss = np.logaddexp(0, f)
        rest = negative_loss[n:].sum() * share_u - prior * negative_loss[:n].sum() * share_p
        as_positive = np.where(is_positive, prior * share_p * (s - 1), 0)
        as_negative = np.where(is_positive, -prior * share_p * s, share_u * s)
        g = as_positive + as_negative if rest >= 0 else -as_negative
        grad = np.append(np.bincount(column, g[row], minlength=width) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Classifier:
    """Learn from rows of the learning folds only. The prior is the toxic share of the labelled ones.

    Without a positive the classifier gives every text the smallest prior."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")
    marked = labelled_rows(ids, labels, "toxic").select("doc_id", "y")
    totals = marked.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    prior = float(np.clip((totals["p"] or 0) / max(totals["n"], 1), 0.01, 0.9))
    toxic = marked.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positive_rows).select("doc_id").toArrow()["doc_id"].to_numpy()
    others = ids.where(~held_out()).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(unlabelled_rows).toArrow()["doc_id"].to_numpy()
    weights = np.zeros(SLOTS)
    if not len(toxic):
        return Classifier(weights, float(np.log(prior / (1 - prior))))
    sample = share(docs, (np.unique(toxic), np.unique(others)))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))

    def sampled(batches):
        p, u = sample.value
        for batch in batches:
            given = np.asarray(batch.column(0).is_valid())
            at = np.asarray(batch.column(0).fill_null(0))
            batch = batch.filter(pa.array(given & (np.isin(at, p) | np.isin(at, u))))
            for part, blobs in text_slices(batch, 1):
                doc = np.asarray(part.column(0))
                slots, who = features(blobs)
                yield np.isin(doc, p), np.isin(doc, u), slots, who

    def frequencies(batches):
        count = np.zeros((2, SLOTS), dtype=np.int64)
        for p, u, slots, who in sampled(batches):
            count[0] += np.bincount(slots[p[who]], minlength=SLOTS)
            count[1] += np.bincount(slots[u[who]], minlength=SLOTS)
        flat = count.ravel()
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(flat[used])], ["slot", "n"])

    in_p, in_u = slot_counts(texts.mapInArrow(frequencies, "slot int, n bigint"), 2 * SLOTS).reshape(2, SLOTS)
    chosen = telling(in_p, in_u, len(np.unique(toxic)), len(np.unique(others)))
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))
    places = share(docs, place)

    def rows(batches):
        for p, u, slots, who in sampled(batches):
            column = places.value[slots]
            who, column = who[column >= 0], column[column >= 0]
            lists = [column[a:b] for a, b in zip(np.searchsorted(who, np.arange(len(p))), np.searchsorted(who, np.arange(len(p)), side="right"))]
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(u), pa.array(lists, pa.list_(pa.int32()))], ["p", "u", "x"])

    found = texts.mapInArrow(rows, "p boolean, u boolean, x array<int>").toArrow()
    order = sorted(zip(found["p"].to_pylist(), found["u"].to_pylist(), found["x"].to_pylist()), key=lambda r: r[2])
    x = [(p, u, np.asarray(r, dtype=np.int64)) for p, u, r in order]
    w, b = fit_nnpu([r for p, _, r in x if p], [r for _, u, r in x if u], len(chosen), prior)
    weights[chosen] = w
    return Classifier(weights, b)


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, limit: int = FEATURES) -> np.ndarray:
    """The features whose share among positives most exceeds that among unlabelled texts, by a z value."""
    a, b = in_p / max(n_p, 1), in_u / max(n_u, 1)
    pooled = (in_p + in_u) / max(n_p + n_u, 1)
    z = (a - b) / np.sqrt(pooled * (1 - pooled) * (1 / max(n_p, 1) + 1 / max(n_u, 1)) + 1e-9)
    z[in_p < 3] = 0
    best = np.argsort(-z, kind="stable")[:limit]
    return np.sort(best[z[best] > 3])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; empty and null texts get the score of no words.

    Of several labels of a document the largest counts, those other than 0 and 1 are not used.
    """
    model = share(docs, fit(docs, labels))

    def score(batches):
        for batch in batches:
            for part, blobs in text_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.scores(blobs))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
