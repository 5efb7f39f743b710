import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from brute import WORD, word_set

from textyard.llm import common, mixing, ngram_join, packing, quality, setjoin, shingles as sh
from textyard.llm.setjoin import Likeness


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chance_documents(n, words, seed=3):
    """Documents of which every two share one phrase of their own: nearly all shingles are shared, no two documents are alike."""
    rng = random.Random(seed)
    phrase = {(i, j): " ".join(f"w{rng.randrange(10**9)}" for _ in range(words)) for i in range(n) for j in range(i)}
    return [(i, " ".join(phrase[max(i, j), min(i, j)] for j in range(n) if j != i)) for i in range(n)]


def test_pairs_that_meet_by_chance_are_not_verified(spark, monkeypatch):
    rows = chance_documents(9, 60)
    edited = rows[7][1].split()
    edited[100] = "changed"
    rows.append((900, " ".join(edited)))
    sent, real = [], ngram_join.verified

    def seen(texts, units, pairs, homes):
        sent.append(pairs.count())
        return real(texts, units, pairs, homes)

    monkeypatch.setattr(ngram_join, "verified", seen)
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), Likeness(3, 90)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 7 if i == 900 else i for i, _ in rows}
    assert sum(sent) <= 2  # the one pair, from either side


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_sketches_drop_no_pair_that_is_alike(spark, percent):
    rng = random.Random(percent)
    texts = []
    for size in (1, 4, 20, 62, 70, 126, 133, 250, 260, 900):
        base = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        for share in (0, 1, 3, 5, 10, 40, 100):
            edited = [f"e{rng.randrange(10**9)}" if rng.randrange(300) < share else w for w in base]
            texts.append(" ".join(edited[: size - rng.randrange(1 + size // 8)] or base))
    texts += ["same words here " * 50, " ".join(["x"] * 400)]
    like = Likeness(3, percent)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    units = setjoin.Units(like, lines=False)
    found = setjoin.profiles(rows, units, setjoin.rarity(rows, units)).select("doc_id", "n", "sid", "sketch").toPandas()
    sets = {i: word_set(t, 3) for i, t in enumerate(texts)}
    sid, n = dict(zip(found.doc_id, found.sid)), dict(zip(found.doc_id, found.n))
    assert n == {i: len(s) for i, s in sets.items()}
    assert all(sum(s) == k for s, k in zip(found.sketch, found.n))
    pairs = [(i, j) for i in sid for j in sid if i < j and sid[i] != sid[j] and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j])]
    frame = spark.createDataFrame([(int(sid[i]), int(sid[j]), int(n[i]), int(n[j])) for i, j in pairs], "a bigint, b bigint, na bigint, nb bigint")
    sketched = spark.createDataFrame([(int(s), [int(x) for x in k]) for s, k in {s: k for s, k in zip(found.sid, found.sketch)}.items()], "sid bigint, sketch array<tinyint>")
    left = {(r.a, r.b) for r in setjoin.plausible(frame, sketched, like).collect()}
    alike = {(sid[i], sid[j]) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert alike <= left and len(left) < len({(sid[i], sid[j]) for i, j in pairs})
    assert percent == 100 or alike


def test_a_sketch_that_overflows_is_null_and_drops_nothing(spark):
    tokens = np.arange(600, dtype=np.uint64)  # all leading bits are 0
    got = setjoin.sketches(np.concatenate([tokens, sh.mix(tokens)]), np.array([600, 600])).to_pylist()
    assert got[0] is None and sum(got[1]) == 600
    frame = spark.createDataFrame([(1, 2, 600, 600)], "a bigint, b bigint, na bigint, nb bigint")
    sketched = spark.createDataFrame([(1, None), (2, got[1])], "sid bigint, sketch array<tinyint>")
    assert setjoin.plausible(frame, sketched, Likeness(3, 90)).count() == 1


def test_mix_moves_texts_once_and_sends_no_list_of_blocks(spark):
    docs = spark.range(2_000).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 300) as text", "concat('s', id % 3) as source")
    # the draw is not joined block by block, and no text goes to a Python worker
    plan = physical(mixing.mixed(docs))
    assert "MapInArrow" not in plan and not re.search(r"Join \[[^\]]*block#", plan)
    texts = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(texts) == 1, plan


def reference(text, ranges):
    spans = [m.span() for m in WORD.finditer(text)]
    parts, at = [], None
    for r in ranges:
        if at == r["from"]:
            parts[-1][1] = spans[r["to"] - 1][1]
        else:
            parts.append([spans[r["from"]][0], spans[r["to"] - 1][1]])
        at = r["to"]
    return "\n".join(text[a:b] for a, b in parts)


def test_ranges_are_cut_as_they_stand(spark):
    rng = random.Random(11)
    spaces = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "  ", "\r\n", " \n \n"]
    words = ["a", "été", " x", "b c", "$1", "\\", "日本", "end.\u0085", "😀"]
    docs = []
    for i in range(200):
        text = "".join(rng.choice(words) * rng.randint(1, 3) + rng.choice(spaces) for _ in range(rng.randint(1, 90)))
        docs.append((i, rng.choice(["", " ", "\n\t"]) + (text if i % 2 else text.rstrip(" \n\t\x0b\x0c\r")), f"s{i % 4}"))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    whole, want = {i: t for i, t, _ in docs}, []
    for r in mixing.plan(frame, block=3, shard=200).collect():
        want += [(r.doc_id, whole[r.doc_id])] * r.passes
        if r.ranges:
            want.append((r.doc_id, reference(whole[r.doc_id], r.ranges)))
    got = [(r.doc_id, r.text) for r in mixing.mixed(frame, block=3, shard=200).collect()]
    assert sorted(got) == sorted(want) and any(t not in whole.values() for _, t in got)


def test_rows_that_share_a_doc_id_each_get_their_turn(spark):
    rows = [(None, "x " * 40, "a"), (None, "y " * 40, "a"), (None, None, None), (1, "z " * 7, None), (1, "z " * 7, "b"), (1, "q " * 40, "b"), (1, "q " * 40, "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.plan(frame, block=4, shard=64).collect()
    mixed = mixing.mixed(frame, block=4, shard=64).collect()
    for source in {r.source for r in plan}:
        taken = sum(r.taken for r in plan if r.source == source)
        assert taken == sum(len(WORD.findall(r.text or "")) for r in mixed if r.source == source)


def test_rules_are_fitted_without_copies_of_the_rule_table(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.random((6_000, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    tracemalloc.start()
    model = quality.fit_rules(x, y, list("abcd"))
    peak, table = tracemalloc.get_traced_memory()[1], 6_000 * quality.TREES * (2 ** (quality.DEPTH + 1) - 2) * 4
    tracemalloc.stop()
    # the table in single precision and one more like it for its spread; it never stands in doubles
    assert peak < 2.6 * table
    few = quality.fit_rules(x, y, list("abcd")[:4])
    monkeypatch.setattr(quality, "STEP_ROWS", 100_000)
    whole = quality.fit_rules(x, y, list("abcd"))
    assert model == few and [r.bounds for r in model.rules] == [r.bounds for r in whole.rules]
    assert np.allclose([r.weight for r in model.rules], [r.weight for r in whole.rules], rtol=1e-9) and len(model.rules) > 3
    assert quality.fit_rules(x[:6], np.array([0, 1, 0, 1, 1, 0.0]), list("abcd")).rules == ()


def test_texts_are_encoded_in_little_memory():
    rng = random.Random(5)
    known = [f"w{i}" for i in range(2_000)]
    blobs = [" ".join(rng.choices(known, k=500)).encode() for _ in range(3_500)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([b.decode() for b in blobs])})
    words, total = packing.Words(), 0
    words.encode([" ".join(known).encode()])
    tracemalloc.start()
    for _, some in common.text_slices(batch, 0, packing.SLICE):
        total += int(words.encode(some)[1].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    text = sum(map(len, blobs))
    assert total >= 1_750_000 and text > 1 << 23 and peak < 6 * text, peak / text


def test_texts_reach_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    docs = spark.range(0, 12_000, 1, 1).selectExpr("id as doc_id", "repeat('two words ', 200) as text")
    units = setjoin.Units(Likeness(), lines=True)
    try:
        for step in (lambda d: packing.pieces(d), lambda d: quality.statistics(d, ["doc_id"]), lambda d: setjoin.profiles(d, units, np.zeros(64, dtype=np.int64)), lambda d: setjoin.verified(d, units, spark.createDataFrame([], "a bigint, b bigint, na bigint, nb bigint"), spark.createDataFrame([], "sid bigint, doc_id bigint"))):
            spark.conf.unset(common.BATCH_SETTING)
            step(docs)
            got = [r["size"] for r in docs.mapInArrow(sizes, "size bigint").collect()]
            assert sum(got) > 24_000_000 and max(got) < 1.1 * common.BATCH_BYTES
        # a setting of the session's own stays
        spark.conf.set(common.BATCH_SETTING, "1m")
        packing.pieces(docs)
        assert spark.conf.get(common.BATCH_SETTING) in ("1m", "1048576b")
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_packing_starts_no_plain_python_workers(spark):
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2, 3], "text": ["one two", "three " * 3_000, None]}))
    packed = packing.pack(docs)
    assert "PythonRDD" not in packed._jdf.queryExecution().toRdd().toDebugString() and "ExistingRDD" not in physical(packed)
    assert sorted((r.doc_id, r.start) for r in packed.collect()) == [(1, 0), (2, 0), (2, 2048), (3, 0)]
