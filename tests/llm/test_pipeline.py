import random
from collections import Counter

import pytest

from brute import WORD

import corpus_pipeline
from textyard.llm import host_rules, line_dedup, mixing, ngram_join, quality

CLASHES = ("size", "passes", "ranges", "_text", "_lines", "lines", "stat_line_share", "row", "host", "kept", "c0", "part", "since")


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def prose(seed, n):
    """Documents of sentences that no other document has, so every clean one must stay."""
    rng = random.Random(seed)
    vowels, rest = "aeiou", "bcdfghklmnprstvw"
    word = lambda: "".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    return [(i, "\n".join(" ".join(word() for _ in range(rng.randint(8, 14))).capitalize() + "." for _ in range(rng.randint(4, 9)))) for i in range(n)]


def junk(rng):
    return "".join(rng.choice("#$%&*|<>{}[]~^0123456789!! ") for _ in range(400))


def test_run_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    rng = random.Random(3)
    clean = prose(1, 240)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in clean]
    bad = [(1_000 + i, junk(rng), "en", "s1", 400) for i in range(60)]
    copies = [(2_000 + i, clean[i][1], "en", "s0", len(clean[i][1])) for i in range(20)]
    docs = spark.createDataFrame(rows + bad + copies, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 0) for r in bad], "doc_id bigint, quality int, toxic int")
    folder = tables(spark, tmp_path, docs, labels)
    stages = dict(corpus_pipeline.STAGES)
    good = quality.keep_good(docs, labels).toPandas()
    assert set(good.doc_id) >= {r[0] for r in rows} and not set(good.doc_id) & {r[0] for r in bad}
    assert list(good.columns) == docs.columns and len(stages) == 5
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    # every clean document is packed as often as its source is mixed, at most three times; copies and junk are gone
    starts = pieces[pieces.start == 0].doc_id.value_counts()
    assert set(starts.index) <= {r[0] for r in rows} and starts.max() <= 3 * 2
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        assert (group.offset.to_numpy() == group.length.cumsum().to_numpy() - group.length.to_numpy()).all()


def test_run_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, None)], "doc_id bigint, quality int, toxic int")
    docs = awkward.selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars")
    for name, some, marks in (("awkward", docs, labels), ("unlabelled", docs, labels.limit(0)), ("empty", docs.limit(0), labels.limit(0))):
        pieces = corpus_pipeline.run(spark, tables(spark, tmp_path / name, some, marks)).toPandas()
        assert len(pieces) == 0 if name == "empty" else pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, t, f"s{i % 2}", *([777] * len(CLASHES))) for i, t in prose(5, 30)] + [(90, None, None, *([777] * len(CLASHES))), (91, "", "s0", *([777] * len(CLASHES)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{c} int" for c in CLASHES))
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(30)], "doc_id bigint, quality int")
    stages = {
        "quality": quality.keep_good(docs, labels, threshold=0.0), "lines": line_dedup.without_repeated_lines(docs),
        "join": ngram_join.keep_one(docs), "mixing": mixing.mixed(docs), "hosts": host_rules.keep(docs, max_rate=1.0),
    }
    for name, out in stages.items():
        got = out.collect()
        assert out.columns == docs.columns and got, name
        assert all(r[c] == 777 for r in got for c in CLASHES), name
        if name in ("quality", "lines", "join"):
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows), name


@pytest.mark.parametrize("sizes", [[10] * 6, [1, 1, 1], [3, 100_000], [0, 7, 50_000, 20], [64, 64, 640]])
def test_mixing_meets_small_targets(spark, sizes):
    rows, at = [], 0
    for s, size in enumerate(sizes):
        left = size
        while left > 0 or size == 0:
            n = min(left, 1 + 37 * (at % 50))
            rows.append((at, " ".join(["w"] * n), f"s{s}"))
            at, left = at + 1, left - n
            if size == 0:
                break
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shard=30_000).toPandas()
    by = plan.groupby("source").agg({"taken": "sum", "target": "first", "size": "sum"})
    assert (by["size"].to_numpy() == sizes).all() and abs(by.target.sum() - sum(sizes)) < 1e-6 * sum(sizes) + 1e-9
    for source, r in by.iterrows():
        assert abs(r.taken - r.target) <= max(64, 0.02 * r.target) if r.target >= 4096 else abs(r.taken - r.target) <= 1, (source, r)
    assert (plan.taken <= 3 * plan["size"]).all()


def test_empty_texts_take_nothing_and_stay(spark):
    docs = spark.range(3_000).selectExpr("id as doc_id", "if(id % 100 = 0, 'some words here', if(id % 2 = 0, '', null)) as text", "'one' as source")
    plan = mixing.plan(docs).toPandas()
    assert len(plan) == 3_000 and plan.taken.sum() == 90 and plan[plan["size"] == 0].taken.sum() == 0
    mixed = mixing.mixed(docs).collect()
    assert sum(not r.text for r in mixed) == 2_970 and sum(len(WORD.findall(r.text or "")) for r in mixed) == 90
