"""N-gram Jaccard join of documents: grouped prefix join.

Documents with the same set are one node, nodes with the same size and prefix are one group, and only groups
meet in the prefix index. Links are found in two rounds. First each node is compared with the leader of its
group and each group's leader with one leader for every prefix token they share: at most as many pairs as
index rows, and enough to join nearly all copies. What these links connect need not be compared again, so the second
round takes the group pairs of a token in which not all sides are connected yet, filters them by length and
position, expands them to their members and verifies those. Before sets are sent, sketches drop the pairs that cannot be alike. Every link between documents that are not
connected otherwise is verified, so the components are exact; a family of thousands of copies costs one
comparison each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textyard.llm.common import few, stored
from textyard.llm.components import components
from textyard.llm.setjoin import Likeness, Units, plausible, profiles, rarity, shared_tokens, verified


def similar_documents(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their sets of distinct word shingles is at least
    ``like.percent`` hundredths. component_id is the smallest doc_id reachable by links. A text with fewer words
    than a shingle has its whole sequence as one; a null text or one without words has an empty set and links
    with nothing. Rows that share a doc_id are one document with several sets, all in one component. A row with
    a null doc_id links with nothing and has a null component. Columns besides doc_id and text are not read.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = Units(like, lines=False)
    rows = stored(profiles(texts, units, rarity(texts, units)))
    named = rows.where("sid is not null and doc_id is not null")
    sets = stored(named.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("pid").alias("pid"), F.min("n").alias("n"), F.first("sketch").alias("sketch")))
    sketched = sets.select("sid", "sketch")
    groups = stored(sets.groupBy("pid").agg(F.min("sid").alias("leader"), F.min("n").alias("n")))
    index = stored(shared_tokens(named, "pid"))
    links = stored(verified(texts, units, stored(plausible(_leader_pairs(sets, groups, index, like), sketched, like)), sets))
    first = components(links)
    placed = stored(sets.join(first.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "pid", "n", "doc_id", F.coalesce("root", "sid").alias("root")))
    rest = stored(plausible(_open_pairs(placed, index, like), sketched, like))
    more = verified(texts, units, rest, sets)
    roots = placed.select("sid", "root")
    bridges = more.join(roots.select(F.col("sid").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("sid").alias("b"), F.col("root").alias("rb")), "b")
    # rows that share a doc_id are one document: its sets are joined too
    several = named.select("doc_id", "sid").distinct().join(placed.select("sid", "root"), "sid").groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    chained = named.select("doc_id", "sid").distinct().join(several.select("doc_id", "a"), "doc_id").join(roots, "sid").select("a", F.col("root").alias("b"))
    second = components(bridges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(chained))
    final = placed.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("sid", "doc_id", F.coalesce("top", "root").alias("top"))
    smallest = final.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    by_set = final.join(smallest, "top").select("sid", "component_id")
    return rows.join(by_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _leader_pairs(sets: DataFrame, groups: DataFrame, index: DataFrame, like: Likeness) -> DataFrame:
    """Each set with its group's leader, and leaders of groups that share a token with that token's first group."""
    within = sets.join(groups.select("pid", "leader"), "pid").where("sid <> leader").select(F.col("sid").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"))
    # the group in which a token comes earliest has the fewest shingles of its own: the text others were made from
    pivots = index.groupBy("token").agg(F.min(F.struct("pos", "n", "pid")).alias("p")).select("token", F.col("p.pos").alias("pp_pos"), F.col("p.n").alias("pn"), F.col("p.pid").alias("pp"))
    met = index.join(pivots, "token").where("pid <> pp").where(like.may_be("n", "pn", "pos", "pp_pos")).select("pid", "pp").distinct()
    mine = groups.select("pid", F.col("leader").alias("a"), F.col("n").alias("na"))
    other = groups.select(F.col("pid").alias("pp"), F.col("leader").alias("b"), F.col("n").alias("nb"))
    across = met.join(mine, "pid").join(other, "pp").select("a", "b", "na", "nb")
    return within.union(across)


def _open_pairs(placed: DataFrame, index: DataFrame, like: Likeness) -> DataFrame:
    """Members of groups that share a token, or of one group, and are not connected yet."""
    spans = placed.groupBy("pid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    rows = index.join(spans, "pid")
    pivots = rows.groupBy("token").agg(F.min("lo").alias("base"), F.max("hi").alias("top")).where("base <> top").select("token", "base")
    rows = rows.join(pivots, "token")
    odd = rows.where("lo <> base or hi <> base").select("token", F.col("pid").alias("p"), F.col("n").alias("n1"), F.col("pos").alias("pos1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    all_ = rows.select("token", F.col("pid").alias("q"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    open_ = "p <> q and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2) and " + like.may_be("n1", "n2", "pos1", "pos2")
    met = odd.join(all_, "token").where(open_).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    met = met.union(spans.where("lo <> hi").select(F.col("pid").alias("p"), F.col("pid").alias("q")))
    left = placed.select(F.col("pid").alias("p"), F.col("sid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = placed.select(F.col("pid").alias("q"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    return met.join(left, "p").join(right, "q").where("ra <> rb and (p <> q or a < b)")


def keep_one(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The documents without later copies: of each component, the rows of its smallest doc_id stay.

    Rows without doc_id stay, as they link with nothing. Columns are those of ``docs``.
    """
    found = similar_documents(docs, like)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(few(stored(gone)), "doc_id", "left_anti").select(*docs.columns)
