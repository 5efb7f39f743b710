"""Line dedup by an exact set-similarity join of lines.

A line's set holds its distinct word shingles. A line goes if an earlier line, by (doc_id, line number), has
the same set or one of the asked Jaccard similarity; whether that line stays itself does not matter, so the
result does not depend on the order of work. Tokens are ordered by rarity; prefix, length and position
filters pick the pairs to verify. Every line is first compared with one line for each of its shared prefix
tokens, that in which the token comes first: the line with the fewest shingles of its own, from which copies
were made. This settles families of copies with one comparison each; only lines without an earlier match so
far are then compared with all earlier lines that pass the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textyard.llm.common import few, stored
from textyard.llm.setjoin import Likeness, Units, profiles, rarity, shared_tokens, verified


def repeated_lines(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(doc_id, line) of the lines to remove, lines counted from 0.

    Lines end at ``\\n``. A line with fewer words than a shingle has its whole sequence as one, so it goes where it stood before
    word for word; one without words stays. Rows
    that share a doc_id are taken as one document given again: equal lines at equal places do not remove each
    other. Rows without doc_id or text keep all lines and remove none.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = Units(like, lines=True)
    rows = stored(profiles(texts, units, rarity(texts, units)).where("sid is not null and doc_id is not null"))
    sets = stored(rows.groupBy("sid").agg(F.min(F.struct("doc_id", "number")).alias("at"), F.min("n").alias("n")).select("sid", "n", "at", F.col("at.doc_id").alias("doc_id")))
    index = stored(shared_tokens(rows, "sid").join(sets.select("sid", "at"), "sid"))
    pivots = index.groupBy("token").agg(F.min(F.struct("pos", "at", "sid", "n")).alias("p"))
    other = pivots.select("token", F.col("p.sid").alias("b"), F.col("p.n").alias("nb"), F.col("p.pos").alias("pb"))
    this = index.select("token", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("at").alias("at_a"))
    near = like.may_be("na", "nb", "pa", "pb")
    first = stored(this.join(other, "token").where("a <> b").where(near).select("a", "b", "na", "nb").distinct())
    ends = sets.select(F.col("sid").alias("a"), F.col("at").alias("at_a")), sets.select(F.col("sid").alias("b"), F.col("at").alias("at_b"))
    alike = verified(texts, units, first, sets).join(ends[0], "a").join(ends[1], "b")
    settled = stored(alike.select(F.expr("if(at_a > at_b, a, b)").alias("sid")).distinct())
    open_ = this.join(settled.select(F.col("sid").alias("a")), "a", "left_anti")
    earlier = index.select("token", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("at").alias("at_b"))
    second = stored(open_.join(earlier, "token").where("a <> b and at_b < at_a").where(near).select("a", "b", "na", "nb").distinct())
    late = verified(texts, units, second, sets).select(F.col("a").alias("sid")).distinct()
    gone = settled.union(late).distinct().withColumn("gone", F.lit(True))
    verdict = sets.select("sid", "at").join(gone, "sid", "left")
    placed = rows.select("doc_id", "number", "sid").join(verdict, "sid")
    out = placed.where("gone or doc_id <> at.doc_id or number <> at.number")
    return out.select("doc_id", F.col("number").alias("line")).distinct()


def without_repeated_lines(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``docs`` with the repeated lines cut out of ``text`` and ``n_chars`` counted anew where it is given.

    A document of which nothing but white space remains, though it had words, is dropped: all it said is said
    earlier. Empty and null texts stay as they are, and so do all other columns.
    """
    gone = repeated_lines(docs, like).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    joined = whole.join(few(stored(gone)), "doc_id", "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "lines")
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    out = joined.withColumn("text", F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(kept))
    out = out.where(F.col("lines").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {c: F.col(f"row.{c}") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("lines").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(columns[c].alias(c) for c in docs.columns))
