import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textyard.operators import sampling


def draw(i, seed=42):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 3, 1).otherwise(0).alias("label")
    ).repartition(5)


def by_label(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.label, []).append(r.doc_id)
    return {k: sorted(v, key=draw) for k, v in out.items()}


def test_ranks_are_exact(rows):
    got = {r.doc_id: r.rank for r in sampling.shuffled_ranks(rows).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(range(1000), key=draw))}
    assert [r.doc_id for r in sampling.shuffle_rows(rows).collect()] == sorted(range(1000), key=draw)


def test_balance_min_keeps_the_lowest_draws(rows):
    want = by_label(rows)
    with pytest.warns(UserWarning, match="only 100"):
        got = by_label(sampling.balance_min(rows, 500))
    assert got == {0: want[0][:100], 1: want[1]}
    got = by_label(sampling.balance_min(rows, 7))
    assert got == {k: v[:7] for k, v in want.items()}


def test_balance_n_draws_the_short_class_again(rows):
    got = sampling.balance_n(rows, 300)
    counts = Counter(r.label for r in got.collect())
    assert counts == {0: 300, 1: 300}
    ranked = by_label(rows)[1]
    want = Counter(ranked[int(draw(i)[:15], 16) % 100] for i in range(1, 301))
    assert Counter(r.doc_id for r in got.filter("label = 1").collect()) == want
    assert got.filter("label = 1").select("draw_no").distinct().count() == 300
    with pytest.raises(ValueError, match="class 0"):
        sampling.balance_n(rows, 901)


def test_projection_subset(rows):
    assert Counter(r.label for r in sampling.projection_subset(rows, 50).collect()) == {0: 25, 1: 25}


@pytest.mark.parametrize("sizes", [{0: 7, 1: 3}, {0: 10, 1: 1}, {0: 5, 1: 5, 2: 5}, {0: 1}, {0: 348, 1: 51}])
def test_split_quotas(sizes):
    from math import ceil, floor

    quota = sampling.split_quotas(sizes)
    total = sum(sizes.values())
    assert sum(quota.values()) == ceil(total / 5)
    for c, n in sizes.items():
        assert floor(ceil(total / 5) * n / total) <= quota[c] <= ceil(ceil(total / 5) * n / total)


def test_stratified_split(rows):
    got = sampling.stratified_split(rows)
    assert got.count() == 1000
    assert Counter((r.label, r.split) for r in got.collect())[(1, "test")] == 20
    want = by_label(rows)
    assert by_label(got.filter("split = 'test'")) == {0: want[0][:180], 1: want[1][:20]}


def test_cap_per_group_with_a_hot_group(spark):
    rows = spark.range(3000).select(
        (F.col("id") * 7 + 5).alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("source")
    )
    got = sampling.cap_per_group(rows, "source", 11).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        want.setdefault(r.source, []).append(r.doc_id)
    have = {}
    for r in got:
        have.setdefault(r.source, []).append(r.doc_id)
    assert {k: sorted(v) for k, v in have.items()} == {k: v[:11] for k, v in want.items()}


def test_many_groups_take_the_shuffle_path(spark, monkeypatch):
    import textyard.session as session

    rows = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 40).cast("string").alias("source"))
    want = sorted(map(tuple, sampling.cap_per_group(rows, "source", 3).collect()))
    monkeypatch.setattr(session.few_rows, "__defaults__", (5,))
    assert sorted(map(tuple, sampling.cap_per_group(rows, "source", 3).collect())) == want
    assert len(want) == 120


def test_several_draws_from_one_table(spark, rows):
    draws = sampling.Draws(rows)
    assert draws.sizes == {0: 900, 1: 100}
    marked = draws.marked({"a": draws.quotas({0: 7, 1: 100}), "b": draws.quotas({0: 900, 1: 3}), "none": draws.quotas({0: 0})})
    want = by_label(rows)
    for name, sizes in (("a", {0: 7, 1: 100}), ("b", {0: 900, 1: 3}), ("none", {0: 0, 1: 0})):
        got = by_label(marked.where(name))
        assert got == {c: want[c][:n] for c, n in sizes.items() if n}
    assert marked.count() == 1000


def test_balance_and_split_is_a_split_of_the_balanced_rows(rows):
    with pytest.warns(UserWarning):
        got = sampling.balance_and_split(rows)
        kept = sampling.balance_min(rows)
    again = sampling.stratified_split(kept)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_many_classes_and_rows_without_one(spark):
    rows = spark.range(36_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 12_000)).alias("label"))
    got = sampling.stratified_split(rows).groupBy("label", "split").count().collect()
    sizes = {r["_label"]: r["_size"] for r in sampling.Draws(rows).size_frame.collect()}
    assert len(sizes) == 8_000 and set(sizes.values()) == {3}
    test = Counter(r["count"] for r in got if r.split == "test" and r.label is not None)
    # 4,800 test rows over 8,000 classes of three: one each for 4,800 of them
    assert sum(n * c for n, c in test.items()) == 4_800 and test == {1: 4_800}
    quota = {r["_label"]: r["_quota"] for r in sampling.split_quota_frame(sampling.Draws(rows).size_frame).collect()}
    assert quota == sampling.split_quotas(sizes)
    assert [r["count"] for r in got if r.label is None] == [12_000]


@pytest.mark.parametrize("range_rows", [5, 100, 1 << 20])
def test_cap_per_group_by_quantiles(spark, range_rows):
    """Far-off and wide ids, null groups and orders, hot and small groups."""
    far = [-(2**63), 2**63 - 1, 2**62]
    rows = [("hot", i * i) for i in range(2_000)] + [("hot", v) for v in far] + [(None, 7 * i) for i in range(300)]
    rows += [("small", v) for v in (5, 3)] + [("wide", v) for v in (*far, *range(40))] + [("gone", None)] * 30 + [("half", i if i < 6 else None) for i in range(30)]
    got = sampling.cap_per_group(spark.createDataFrame(rows, "source string, doc_id long"), "source", 11, range_rows=range_rows).collect()
    have = {}
    for r in got:
        have.setdefault(r.source, []).append(r.doc_id)
    want = {}
    for g, v in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        want.setdefault(g, []).append(v)
    want = {g: v[:11] for g, v in want.items()}
    assert {g: sorted(v) for g, v in have.items()} == want


def test_same_sample_for_any_partitioning(spark, rows):
    one = sampling.stratified_split(rows.coalesce(1)).filter("split = 'test'")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = sampling.stratified_split(rows.repartition(13)).filter("split = 'test'")
        assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in other.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
