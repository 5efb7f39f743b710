"""Seeded shuffles, samples and splits that are exact and reproducible.

A row's draw key is the md5 of its id and the seed, so a sample depends only on the ids
and never on partitioning. No step sorts a whole class in one task: a histogram over key
prefixes finds the prefix in which a cut falls, and only rows of that prefix are ranked.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textyard.functions.hashing import draw_key, md5_int
from textyard.session import cut_lineage, few_rows, join_per_group

SEED = 42
TEST_SHARE = 0.20
# Histogram of 16**4 = 65,536 key prefixes: 10**11 rows leave about 1.5 million per prefix.
PREFIX_DIGITS = 4
BUCKETS = 16**PREFIX_DIGITS


def prefix(key: Column) -> Column:
    """The part of a draw key that is counted."""
    return F.substr(key, F.lit(1), F.lit(PREFIX_DIGITS))


@dataclass
class Draws:
    """Seeded draws from one set of rows, any number of them, off one table of counts.

    The rows are read once for their ids, classes and draw keys, which are stored; ``(class, prefix, n)`` counted from
    these gives class sizes and finds every cut. What a draw keeps is then decided row by row, so the rows themselves
    are read a second time at most, whatever the number of draws. Rows without a class are in no draw.
    """

    rows: DataFrame
    row_id: str = "doc_id"
    label: str = "label"
    seed: int = SEED

    @property
    def key(self) -> Column:
        return draw_key(F.col(self.row_id), self.seed)

    @cached_property
    def keys(self) -> DataFrame:
        narrow = self.rows.select(F.col(self.label).alias("_label"), self.key.alias("_key"))
        return cut_lineage(narrow.where("_label is not null").withColumn("_bucket", prefix(F.col("_key"))))

    @cached_property
    def histogram(self) -> DataFrame:
        return cut_lineage(self.keys.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_n")))

    @property
    def size_frame(self) -> DataFrame:
        """``(_label, _size)``, one row per class whatever their number."""
        return self.histogram.groupBy("_label").agg(F.sum("_n").alias("_size"))

    @cached_property
    def sizes(self) -> dict:
        """Rows of each class of a label with few values."""
        counts = few_rows(self.size_frame)
        if counts is None:
            raise ValueError(f"{self.label} has too many values for a class label")
        return {r["_label"]: r["_size"] for r in sorted(counts, key=lambda r: r["_label"])}

    def quotas(self, quota: dict) -> DataFrame:
        kind = self.rows.schema[self.label].dataType.simpleString()
        return self.rows.sparkSession.createDataFrame([(c, n) for c, n in quota.items() if n > 0], f"_label {kind}, _quota bigint")

    def cuts(self, wanted: dict[str, DataFrame]) -> DataFrame:
        """``(_label, one column per draw)``: the key of a class's last row in each draw ``{name: (_label, _quota)}``.

        Only rows whose prefix holds a cut are ranked, for all draws at once.
        """
        asked = reduce(DataFrame.unionByName, [q.select(F.lit(name).alias("_draw"), "_label", "_quota") for name, q in wanted.items()])
        upto = F.sum("_n").over(W.partitionBy("_label").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
        edges = (
            self.histogram.withColumn("_below", upto - F.col("_n")).join(asked, "_label").where("_below < _quota")
            .groupBy("_draw", "_label").agg(F.max(F.struct("_bucket", (F.col("_quota") - F.col("_below")).alias("_left"))).alias("_edge"))
            .select("_draw", "_label", "_edge.*")
        )
        edges = cut_lineage(edges)
        spots = edges.select("_label", "_bucket").distinct()
        near = join_per_group(self.keys, spots, ["_label", "_bucket"])
        ranks = near.withColumn("_rank", F.row_number().over(W.partitionBy("_label", "_bucket").orderBy("_key")))
        # equal draws share a prefix: the ranked rows of one prefix meet every edge that lies in it
        inside = ranks.join(F.broadcast(edges), ["_label", "_bucket"]) if few_rows(edges) else ranks.join(edges, ["_label", "_bucket"])
        found = inside.where("_rank <= _left").groupBy("_label").pivot("_draw", list(wanted)).agg(F.max("_key"))
        return cut_lineage(found)

    def marked(self, wanted: dict[str, DataFrame]) -> DataFrame:
        """The rows with a boolean column for each draw."""
        cuts = self.cuts(wanted).withColumnRenamed("_label", "_class")
        rows = self.rows.withColumn("_class", F.col(self.label))
        named = [F.coalesce(self.key <= F.col(f"`{name}`"), F.lit(False)).alias(name) for name in wanted]
        return join_per_group(rows, cuts, ["_class"], "left").select(*self.rows.columns, *named)

    def drawn(self, quota: DataFrame) -> DataFrame:
        """The rows of one draw."""
        return self.marked({"_in": quota}).where("_in").drop("_in")


def split_quota_frame(sizes: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """``split_quotas`` for any number of classes: ``(_label, _quota)`` from ``(_label, _size)``."""
    sizes = cut_lineage(sizes)
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    n_test = math.ceil(round(test_share * total, 9))
    share = F.lit(n_test).cast("decimal(19)") * F.col("_size").cast("decimal(19)")
    whole = sizes.select("_label", F.expr("_size").alias("_size"), share.alias("_share")) if total else sizes.withColumn("_share", F.lit(0))
    base = whole.select("_label", F.expr(f"cast(_share div {max(total, 1)} as bigint)").alias("_quota"), F.expr(f"_share % {max(total, 1)}").alias("_over"))
    rest = n_test - (base.agg(F.sum("_quota")).first()[0] or 0)
    lucky = base.orderBy(F.desc("_over"), "_label").limit(rest).select("_label", F.lit(1).alias("_more"))
    return base.join(lucky, "_label", "left").select("_label", (F.col("_quota") + F.coalesce("_more", F.lit(0))).alias("_quota"))


def ranked(rows: DataFrame, key: Column, bucket: Column) -> DataFrame:
    """Add the 1-based ``rank`` by ``key`` without a one-task sort.

    A row's rank is its place within its prefix plus the count of all lower prefixes.
    """
    keyed = rows.withColumn("_key", key).withColumn("_bucket", bucket)
    histogram = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most BUCKETS rows reach this one-task window and the broadcast
    lower = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = histogram.select("_bucket", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy("_bucket").orderBy("_key"))
    placed = keyed.withColumn("_within", within).join(F.broadcast(offsets), "_bucket")
    return placed.withColumn("rank", F.col("_within") + F.col("_offset")).select(*rows.columns, "rank")


def shuffled_ranks(rows: DataFrame, row_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Place of each row in the seeded full shuffle."""
    key = draw_key(F.col(row_id), seed)
    return ranked(rows, key, prefix(key))


def shuffle_rows(rows: DataFrame, row_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The rows in seeded random order (a range-partitioned sort)."""
    return rows.orderBy(draw_key(F.col(row_id), seed), row_id)


def draw_without_replacement(
    rows: DataFrame, quota: dict, row_id: str = "doc_id", label: str = "label", seed: int = SEED
) -> DataFrame:
    """A seeded draw of exactly ``quota[class]`` rows of each class named in ``quota``."""
    draws = Draws(rows, row_id, label, seed)
    return draws.drawn(draws.quotas(quota))


def draw_with_replacement(
    rows: DataFrame, n: int, size: int, row_id: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """``n`` seeded draws from ``rows`` (``size`` of them) as ``draw_no`` and the row id.

    Draw i takes the row whose rank is ``md5(i:seed) mod size``; the join is on that
    rank, so draws spread evenly over tasks.
    """
    places = shuffled_ranks(rows.select(row_id), row_id, seed)
    draw_no = F.col("id").alias("draw_no")
    pick = F.pmod(md5_int(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), F.lit(size).cast("bigint"))
    draws = rows.sparkSession.range(1, n + 1).select(draw_no, (pick + 1).alias("rank"))
    return draws.join(places, "rank").select("draw_no", row_id)


def balance_n(
    rows: DataFrame, n: int = 10_000, row_id: str = "doc_id", label: str = "label", seed: int = SEED
) -> DataFrame:
    """``n`` rows per class. Class 0 must have that many; class 1 is drawn with
    replacement when it is short. ``row_id`` of a repeated draw is kept unique in ``draw_no``
    (0 for draws without replacement)."""
    draws = Draws(rows, row_id, label, seed)
    sizes = draws.sizes
    if sizes.get(0, 0) < n:
        raise ValueError(f"class 0 has {sizes.get(0, 0)} rows, fewer than {n}")
    if not sizes.get(1, 0):
        raise ValueError("class 1 has no rows")
    once = {c: n for c in (0, 1) if sizes[c] >= n}
    out = draws.drawn(draws.quotas(once)).withColumn("draw_no", F.lit(0).cast("bigint"))
    if 1 not in once:
        minority = rows.filter(F.col(label) == 1)
        again = draw_with_replacement(minority, n, sizes[1], row_id, seed)
        out = out.unionByName(minority.join(again, row_id))
    return out


def balance_min(
    rows: DataFrame, cap: int = 20_000, row_id: str = "doc_id", label: str = "label", seed: int = SEED
) -> DataFrame:
    """Downsample both classes to ``min(positives, negatives, cap)``."""
    draws = Draws(rows, row_id, label, seed)
    n = balanced_size(draws.sizes, cap)
    return draws.drawn(draws.quotas({0: n, 1: n}))


def balanced_size(sizes: dict, cap: int = 20_000) -> int:
    """Rows of each class in a downsampled corpus."""
    n = min(sizes.get(0, 0), sizes.get(1, 0), cap)
    if n < cap:
        warnings.warn(f"only {n} rows available per class (wanted {cap})", stacklevel=3)
    return n


def balance_and_split(
    rows: DataFrame, cap: int = 20_000, test_share: float = TEST_SHARE, row_id: str = "doc_id", label: str = "label", seed: int = SEED
) -> DataFrame:
    """``balance_min`` and ``stratified_split`` of what it keeps, from one table of counts.

    Both draws take the lowest keys, so the test rows of the balanced corpus are the first of its rows.
    """
    draws = Draws(rows, row_id, label, seed)
    n = balanced_size(draws.sizes, cap)
    test = split_quotas({0: n, 1: n}, test_share) if n else {}
    both = draws.marked({"_kept": draws.quotas({0: n, 1: n}), "_test": draws.quotas(test)})
    return both.where("_kept").select(*rows.columns, F.when(F.col("_test"), "test").otherwise("train").alias("split"))


def projection_subset(
    rows: DataFrame, n: int | None = None, row_id: str = "doc_id", label: str = "label", seed: int = SEED
) -> DataFrame:
    """Equal share of every class: as many rows each as the smallest has, at most ``n // 2`` if ``n`` is given."""
    draws = Draws(rows, row_id, label, seed)
    each = min(draws.sizes.values(), default=0)
    each = each if n is None else min(n // 2, each)
    return draws.drawn(draws.quotas(dict.fromkeys(draws.sizes, each)))


def split_quotas(sizes: dict, test_share: float = TEST_SHARE) -> dict:
    """Test rows per class: ceil(share * n) in all, shared out by largest remainder
    (a tie goes to the smaller label)."""
    total = sum(sizes.values())
    if not total:
        return {}
    n_test = math.ceil(round(test_share * total, 9))
    exact = {c: n_test * n / total for c, n in sizes.items()}
    quota = {c: n_test * n // total for c, n in sizes.items()}
    rest = n_test - sum(quota.values())
    for c in sorted(sizes, key=lambda c: (-(n_test * sizes[c] % total), c))[:rest]:
        quota[c] += 1
    assert all(abs(quota[c] - exact[c]) <= 1 for c in sizes)
    return quota


def stratified_split(
    rows: DataFrame,
    test_share: float = TEST_SHARE,
    row_id: str = "doc_id",
    label: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: 'test' for the exact stratified share of every class, else 'train'."""
    draws = Draws(rows, row_id, label, seed)
    marked = draws.marked({"_test": split_quota_frame(draws.size_frame, test_share)})
    return marked.select(*rows.columns, F.when(F.col("_test"), "test").otherwise("train").alias("split"))


# Rows that one range of a group may hold before it is ranked, and ranges a group is cut into at a time.
RANGE_ROWS = 1 << 20
RANGES = 64


def cap_cuts(rows: DataFrame, n: int, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """``(_group, _cut)``: the ``n``-th smallest ``_order`` of each group that has more rows than that.

    A quantile sketch of each group gives ranges of equal depth, whatever the spacing of the values; exact counts tell in
    which of them the ``n``-th row lies, and a range above ``range_rows`` is cut again. Rows are ranked only inside one
    range per group. Sketches are combined in each task, so a hot group sends one per task.
    """
    sized = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > n)
    # the open range of each group: values above _low up to _high, _below of them before it
    state = cut_lineage(sized.select("_group", F.lit(None).cast("bigint").alias("_low"), F.lit(None).cast("bigint").alias("_high"), F.lit(0).cast("bigint").alias("_below"), "_size"))
    inside = (F.col("_low").isNull() | (F.col("_order") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_order") <= F.col("_high")))
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    while state.where(F.col("_size") > range_rows).limit(1).count():
        wide = state.where(F.col("_size") > range_rows)
        open_rows = join_per_group(rows, wide.select("_group", "_low", "_high"), ["_group"]).where(inside)
        edges = open_rows.groupBy("_group").agg(F.kll_sketch_agg_bigint("_order").alias("_sketch"), F.max("_order").alias("_top"))
        quantiles = F.array_distinct(F.kll_sketch_get_quantile_bigint("_sketch", at))
        # the largest value closes the last range
        edges = cut_lineage(edges.select("_group", F.array_sort(F.array_union(quantiles, F.array("_top"))).alias("_edges")))
        spot = F.size(F.filter("_edges", lambda e: e < F.col("_order")))
        counted = join_per_group(open_rows.select("_group", "_order"), edges, ["_group"]).groupBy("_group", spot.alias("_spot")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(W.partitionBy("_group").orderBy("_spot").rowsBetween(W.unboundedPreceding, 0))
        found = (
            counted.withColumn("_before", upto - F.col("_n")).join(wide, "_group").where(F.col("_below") + F.col("_before") < n)
            .groupBy("_group").agg(F.max(F.struct("_spot", "_before", "_n")).alias("_at"), F.first("_low").alias("_old"), F.first("_below").alias("_under"))
            .join(edges, "_group")
            .select(
                "_group", F.coalesce(F.get("_edges", F.col("_at._spot") - 1), "_old").alias("_low"), F.get("_edges", F.col("_at._spot")).alias("_high"),
                (F.col("_under") + F.col("_at._before")).alias("_below"), F.col("_at._n").alias("_size"),
            )
        )
        # values are unique in a group, so a range of one value holds one row and the loop ends
        state = cut_lineage(state.where(F.col("_size") <= range_rows).unionByName(found))
    near = join_per_group(rows, state, ["_group"]).where(inside)
    rank = F.row_number().over(W.partitionBy("_group").orderBy("_order"))
    return near.withColumn("_rank", rank).where(F.col("_rank") + F.col("_below") == n).select("_group", F.col("_order").alias("_cut"))


def cap_per_group(rows: DataFrame, group: str, n: int = 10_000, order: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The first ``n`` rows of each group in arrival order, given by the unique integer ``order``.

    Null is a group of its own; groups of at most ``n`` rows stay whole. Rows without an order come last: they are kept
    only where the whole group is.
    """
    named = F.to_json(F.struct(F.col(group)))
    narrow = cut_lineage(rows.select(named.alias("_group"), F.col(order).cast("bigint").alias("_order")))
    if n < 1:
        return rows.limit(0)
    placed = narrow.where("_order is not null")
    cuts = cut_lineage(cap_cuts(placed, n, range_rows).unionByName(_short_of_order(narrow, n)))
    joined = join_per_group(rows.withColumn("_group", named), cuts, ["_group"], "left")
    kept = F.col("_cut").isNull() | F.coalesce(F.col(order).cast("bigint") <= F.col("_cut"), F.lit(False))
    return joined.where(kept).select(*rows.columns)


def _short_of_order(narrow: DataFrame, n: int) -> DataFrame:
    """Groups of more than ``n`` rows of which at most ``n`` have an order: all of those are kept, and no others."""
    counts = narrow.groupBy("_group").agg(F.count(F.lit(1)).alias("_all"), F.count("_order").alias("_placed"))
    short = counts.where((F.col("_all") > n) & (F.col("_placed") <= n))
    return short.select("_group", F.lit(2**63 - 1).cast("bigint").alias("_cut"))
