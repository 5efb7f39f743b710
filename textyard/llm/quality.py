"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow boosted trees propose conjunctive rules (the paths from a root), an L1-penalised logistic regression
keeps few of them, and the kept rules become one Spark column expression over the statistics. Trees and
weights are fitted with numpy on the driver, on at most ``FIT_ROWS`` labelled rows in the order of a hash of
their id; everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textyard.llm import shingles as sh
from textyard.llm.common import crc32_of, few, in_arrow, stored, text_slices

FIT_ROWS = 20_000
TREES = 60
DEPTH = 3
BINS = 32
PENALTY = 2e-3
# Rows of the rule table that one product turns into doubles on the driver.
STEP_ROWS = 1 << 10
THRESHOLD = 0.3
FOLDS = 5

# byte classes counted per text, as shares of its bytes
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c",
    "line": b"\n", "stop": b".,;:?", "shout": b"!", "bar": b"|", "symbol": b"#$%&*@^~+=<>{}[]\\/_", "high": bytes(range(128, 256)),
}
STATS = tuple(
    f"stat_{s}"
    for s in (
        *(f"{c}_share" for c in CLASSES), "log_bytes", "log_words", "word_bytes", "distinct_words", "distinct_trigrams",
        "distinct_lines", "line_words", "marked_words",
    )
)


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the statistics of the whole text; those of an empty or null text are 0.

    A text that is kept goes to Python once."""
    kept_text = text in keep and docs.schema[text].dataType == T.StringType()
    source = docs.select(*keep) if kept_text else docs.select(*keep, F.col(text).cast("string").alias("_measured"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]), *(f"{s} double" for s in STATS)])
    lut = np.zeros(256, dtype=np.int64)
    for i, members in enumerate(CLASSES.values()):
        lut[list(members)] = i + 1
    marks = np.zeros(256, dtype=bool)
    marks[list(CLASSES["symbol"] + CLASSES["shout"] + CLASSES["bar"])] = True
    width = len(keep)

    def measure(batches):
        for batch in batches:
            for part, blobs in text_slices(batch, keep.index(text) if kept_text else width):
                values = text_statistics(blobs, lut, marks)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *(pa.array(v) for v in values)], names=[*keep, *STATS])

    return in_arrow(source, measure, fields)


def text_statistics(blobs: list[bytes], lut: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
    n = len(blobs)
    size = np.array([len(b) for b in blobs], dtype=np.int64)
    buf = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    owner = np.repeat(np.arange(n), size)
    kinds = len(CLASSES) + 1
    counts = np.bincount(owner * kinds + lut[buf], minlength=n * kinds).reshape(n, kinds)[:, 1:]
    hashes, who = sh.word_hashes(blobs)
    words = np.bincount(who, minlength=n)

    def distinct(tokens, mine):
        order = np.lexsort((tokens, mine))
        t, m = tokens[order], mine[order]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (m[1:] != m[:-1])
        return np.bincount(m[new], minlength=n)

    grams, gram_of = sh.shingles(hashes, who, 3)
    lines = [b.split(b"\n") for b in blobs]
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    line_count = np.array([len(x) for x in lines], dtype=np.int64) * (size > 0)
    marked = marks[buf] & np.append(sh._SPACE[buf[1:]], True) if len(buf) else np.zeros(0, dtype=bool)
    return [
        *(share(counts[:, i], size) for i in range(kinds - 1)),
        np.log1p(size), np.log1p(words), share(size - counts[:, 3] - counts[:, 4], words), share(distinct(hashes, who), words),
        share(distinct(grams, gram_of), np.bincount(gram_of, minlength=n)),
        share(np.array([len(set(x)) for x in lines]) * (size > 0), line_count), share(words, line_count),
        share(np.bincount(owner[marked], minlength=n), words),
    ]


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds ``(statistic, is_upper, value)`` and its weight."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float

    def sql(self) -> str:
        return " and ".join(f"`{s}` {'<=' if upper else '>'} {value!r}D" for s, upper, value in self.bounds)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a column of the statistics."""
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            total = total + F.when(F.expr(rule.sql()), F.lit(float(rule.weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, residual: np.ndarray, weight: np.ndarray, rng, names) -> tuple[np.ndarray, list[tuple]]:
    """One regression tree on binned columns: its step for each row and the paths of its nodes."""
    step, paths = np.zeros(len(x)), []
    columns = rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
    todo = [(np.arange(len(x)), ())]
    while todo:
        rows, path = todo.pop()
        if path:
            paths.append(path)
        g, h = residual[rows].sum(), weight[rows].sum() + 1.0
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 20:
            for j in columns:
                if not len(cuts[j]):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], residual[rows], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], weight[rows], len(cuts[j]) + 1))[:-1] + 1.0
                nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(cuts[j]) + 1))[:-1]
                gain = gl**2 / hl + (g - gl) ** 2 / (h - hl + 2.0) - g**2 / h
                gain[(nl < 10) | (len(rows) - nl < 10)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1] is None:
            step[rows] = g / h
            continue
        j, k = best[1]
        low = binned[rows, j] <= k
        bound = (names[j], float(cuts[j][k]))
        todo += [(rows[low], (*path, (bound[0], True, bound[1]))), (rows[~low], (*path, (bound[0], False, bound[1])))]
    return step, paths


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> RuleModel:
    """Boosted trees propose rules; lasso logistic regression (accelerated proximal gradient) weighs them.

    With one class or no rows the model is the smoothed share of label 1."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(np.unique(y)) < 2:
        return RuleModel((), base)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    margin, seen = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        half = rng.random(len(y)) < 0.5
        step, paths = grow(x, cuts, binned, np.where(half, y - p, 0.0), np.where(half, p * (1 - p), 0.0), rng, names)
        margin += 0.3 * step
        for path in paths:
            seen.setdefault(tuple(sorted(path)))
    column = {n: i for i, n in enumerate(names)}
    paths = list(seen)
    fires = np.ones((len(y), len(paths)), dtype=np.float32)
    for r, path in enumerate(paths):
        for name, upper, value in path:
            fires[:, r] *= x[:, column[name]] <= value if upper else x[:, column[name]] > value
    middle, scale = fires.mean(axis=0), np.maximum(fires.std(axis=0), 0.05)
    # in place, and multiplied some rows at a time: a product in doubles would copy all of it in every step
    z = fires
    z -= middle
    z /= scale
    parts = [slice(i, i + STEP_ROWS) for i in range(0, len(y), STEP_ROWS)]
    w, b, look, t = np.zeros(len(paths)), base, np.zeros(len(paths)), 1.0
    gram = sum(a.T @ a for a in (z[i].astype(float) for i in parts))
    # the largest singular value, rounded as the table is: its own decomposition would copy the table as doubles, twice
    largest = np.float32(np.sqrt(np.linalg.eigvalsh(gram).max(initial=0)))
    rate = 4.0 / (largest**2 / len(y) + 1)
    previous_b, look_b = b, b
    for _ in range(400):
        p = 1 / (1 + np.exp(-(np.concatenate([z[i] @ look for i in parts]) + look_b)))
        step = look - rate * sum(z[i].T @ (p - y)[i] for i in parts) / len(y)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0)
        new_b = look_b - rate * (p - y).mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_next * (new - w)
        look_b = new_b + (t - 1) / t_next * (new_b - previous_b)
        w, previous_b, t = new, new_b, t_next
    raw = w / scale
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(tuple(Rule(paths[i], float(raw[i])) for i in kept), float(previous_b - raw @ middle))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc32_of(doc_id) % FOLDS == 0, F.lit(False))


def labelled_rows(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows of the learning folds with a 0/1 label ``y``; of several labels of an id the largest."""
    marks = labels.where(f"{label} in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    return rows.join(marks, rows["doc_id"] == marks["_id"]).drop("_id").where(~held_out())


def fit(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> RuleModel:
    sample = labelled_rows(stats.select("doc_id", *STATS), labels, "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("y", *STATS).toArrow()
    x = np.stack([sample[s].to_numpy() for s in STATS], axis=1)
    return fit_rules(x, sample["y"].to_numpy().astype(float), list(STATS))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Labels other than 0 and 1 are not used, of several labels of a document the largest counts. Empty and null
    texts are scored by statistics of 0; a null doc_id is scored and never held out.
    """
    stats = stored(statistics(docs, ["doc_id"]))
    model = fit(stats, labels)
    scored = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns, each judged by its own text.

    The model is fitted on the labelled rows' statistics; all rows then pass it where they are."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id").distinct()
    taught = docs.select("doc_id", "text").where("doc_id is not null").join(few(marks), "doc_id", "left_semi")
    model = fit(stored(statistics(taught, ["doc_id"])), labels)
    # names of the statistics must not meet those of the caller
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    rows = statistics(plain, plain.columns, f"c{docs.columns.index('text')}")
    return rows.where(model.score() >= threshold).select(*plain.columns).toDF(*docs.columns)
