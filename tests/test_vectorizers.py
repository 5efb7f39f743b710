import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textyard.functions.hashing import HEX_DIGITS
from textyard.operators import cooccur, frequent, pooling, project, subword, terms, wordvec


def corpus(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id long, tokens array<string>")


def test_unigram_bags_ignore_order(spark):
    docs = corpus(spark, "not toxic", "toxic not")
    rows = {r.doc_id: r.features for r in terms.BagOfWords(ngrams=(1, 1)).fit_transform(docs).collect()}
    assert rows[0] == rows[1]
    rows = {r.doc_id: r.features for r in terms.BagOfWords().fit_transform(docs).collect()}
    assert rows[0] != rows[1]


def test_counts_add_up_without_a_bound(spark, sf):
    from textyard.sources.tables import documents, with_tokens

    docs = with_tokens(documents(spark, sf))
    vocabulary = terms.BagOfWords(max_features=10**6).vocabulary_frame(docs)
    total = terms.term_counts(docs, vocabulary).agg(F.sum("cnt")).first()[0]
    n = F.size("tokens")
    assert total == docs.agg(F.sum(n + F.greatest(n - 1, F.lit(0)))).first()[0]


def test_ties_are_cut_alphabetically(spark):
    docs = corpus(spark, "d c b a")
    top = terms.BagOfWords(max_features=2, ngrams=(1, 1)).vocabulary_frame(docs)
    assert [(r.term, r.idx) for r in top.orderBy("idx").collect()] == [("a", 0), ("b", 1)]


def test_vector_and_relational_counts_agree(spark, sf):
    from textyard.sources.tables import documents, with_tokens

    docs = with_tokens(documents(spark, sf))
    model = terms.BagOfWords(max_features=500).fit(docs)
    long = {(r.doc_id, r.idx, r.weight) for r in model.transform_long(docs).collect()}
    assert long == {(r.doc_id, r.idx, float(r.cnt)) for r in terms.term_counts(docs, model.vocabulary).collect()}
    assert model.transform(docs).count() == docs.count()


def test_tfidf_by_hand(spark):
    docs = corpus(spark, "x x x y", "x z", "y", "")
    model = terms.TfIdf(ngrams=(1, 1), min_df=1).fit(docs)
    assert [r["term"] for r in model.vocabulary_rows] == ["x", "y", "z"]
    idf = {t: math.log((1 + 4) / (1 + d)) + 1 for t, d in {"x": 2, "y": 2, "z": 1}.items()}
    got = {r.doc_id: r.features.toArray() for r in model.transform(docs).collect()}
    want = np.array([(1 + math.log(3)) * idf["x"], idf["y"], 0])
    assert np.allclose(got[0], want / np.linalg.norm(want))
    assert np.allclose(np.linalg.norm(got[1]), 1) and not got[3].any()
    plain = terms.TfIdf(ngrams=(1, 1), min_df=1, idf_mode="plain").fit(docs)
    assert [round(r["idf"], 9) for r in plain.vocabulary_rows] == [round(math.log(v), 9) for v in (2, 2, 4)]


def test_unseen_terms_and_empty_documents(spark):
    model = terms.TfIdf(min_df=1).fit(corpus(spark, "known words"))
    rows = model.transform(corpus(spark, "other text", "", "known")).orderBy("doc_id").collect()
    assert [r.features.numNonzeros() for r in rows] == [0, 0, 1]
    with pytest.raises(ValueError, match="no term"):
        terms.TfIdf(min_df=5).fit(corpus(spark, "a b"))
    assert not hasattr(terms.TfIdf(), "transform")


VECTORS = [(0, "cat", [1.0, 0.0]), (1, "dog", [3.0, 2.0]), (2, "cow", [9.0, 9.0]), (3, "cat", [1.0, 4.0])]


@pytest.mark.parametrize("budget", [10**9, pooling.table_bytes(1, 2), pooling.table_bytes(2, 2), 0])
def test_mean_pool_gives_one_answer(spark, budget):
    """By broadcast, by head and tail, by joins alone: repeats and nulls count the same."""
    given = [*VECTORS, (4, None, [7.0, 7.0]), (5, "hen", None)]
    table = spark.createDataFrame(given, "seq long, word string, vector array<float>").drop("seq")
    tokens = [["cat", "cat", "dog", "bird"], ["bird"], [], ["cow"], [None, "cow", "hen"], None, ["cow"] * 3 + ["dog"]]
    docs = spark.createDataFrame([(i % 5, f"d{i}", t) for i, t in enumerate(tokens)], "doc_id long, name string, tokens array<string>")
    got = {r.name: r.vector for r in pooling.mean_pool(docs, table, 2, 6, budget=budget).collect()}
    # the two cats count with both vectors
    want = {"d0": [7 / 5, 10 / 5], "d1": [0, 0], "d2": [0, 0], "d3": [9, 9], "d4": [9, 9], "d5": [0, 0], "d6": [30 / 4, 29 / 4]}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    single = pooling.mean_pool(docs, table, 2, 6, budget=budget, single=True)
    assert dict(single.dtypes)["vector"] == "array<float>" and single.columns == ["doc_id", "name", "vector"]


def test_pretrained_last_vector_wins_and_width_is_checked(spark):
    table = spark.createDataFrame(VECTORS, "seq long, word string, vector array<float>")
    docs = corpus(spark, "cat dog")
    model = wordvec.Pretrained(table, 2).fit(docs)
    assert model.n_vectors == 3
    assert np.allclose(model.pool(docs).first().vector, [2.0, 3.0])
    with pytest.raises(ValueError, match="wide"):
        wordvec.Pretrained(table, 3).fit(docs)


def test_head_and_tail_join_equals_broadcast(spark, sf):
    from textyard.sources.tables import documents, with_tokens

    docs = with_tokens(documents(spark, sf))
    words = wordvec.word_counts(docs, 5).select("word", F.array(F.length("word").cast("float"), F.lit(1.0).cast("float")).alias("vector")).cache()
    n = words.count()
    a = {r.doc_id: r.vector for r in pooling.mean_pool(docs, words, 2, n).collect()}
    b = {r.doc_id: r.vector for r in pooling.mean_pool(docs, words, 2, n, budget=0).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    known = pooling.known_tokens(docs, words, 10**12).count()
    unknown = pooling.unknown_tokens(docs, words, 10**12).count()
    assert known + unknown == pooling.token_counts(docs).count()
    assert known == pooling.known_tokens(docs, words, 1).count()


def test_subword_vectors_by_hand(spark):
    buckets = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "bucket long, vector array<double>")
    known = spark.createDataFrame([("cat", [10.0, 10.0])], "word string, vector array<double>")
    words = spark.createDataFrame([("cat",), ("unseen",)], "word string")
    got = {r.word: r.vector for r in subword.subword_vectors(words, buckets, 7, 2, known, 1, hashing="fnv1a").collect()}

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    for w in ("cat", "unseen"):
        m = f"<{w}>"
        parts = [[fnv(m[i : i + n]) % 7, 1.0] for n in range(3, 7) for i in range(len(m) - n + 1)]
        parts += [[10.0, 10.0]] if w == "cat" else []
        assert np.allclose(got[w], np.mean(parts, axis=0))


def planted(spark, n=1200):
    """Two topics; 'alpha'/'omega' keep the same company, 'stone' another one."""
    rng = np.random.default_rng(0)
    one, two = [f"red{i}" for i in range(8)], [f"blue{i}" for i in range(8)]
    texts = []
    for i in range(n):
        topic, name = (one, ("alpha", "omega")[i % 2]) if i % 3 else (two, "stone")
        words = list(rng.choice(topic, 6))
        texts.append(" ".join(words[:3] + [name] + words[3:]))
    return corpus(spark, *texts)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b)


def brute_pairs(docs, window):
    pairs = Counter()
    for tokens in docs:
        for i, x in enumerate(tokens):
            for y in tokens[i + 1 : i + 1 + window]:
                pairs[min(x, y), max(x, y)] += 1
    return pairs


def test_pairs_and_information_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "RUN", 7)  # pairs across the cuts stay
    rng = np.random.default_rng(5)
    texts = [[f"w{int(k)}" for k in rng.geometric(0.2, n)] for n in (0, 1, 2, 5, 7, 8, 40, 100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, tokens array<string>")
    got = cooccur.word_pairs(docs, 3)
    assert {(r.a, r.b): r.n for r in got.collect()} == brute_pairs(texts, 3)
    tf = Counter(w for t in texts for w in t)
    words = spark.createDataFrame([(w,) for w in tf if tf[w] > 1], "word string")
    pairs = {p: n for p, n in brute_pairs(texts, 3).items() if tf[p[0]] > 1 and tf[p[1]] > 1}
    seen = Counter()
    for (a, b), n in pairs.items():
        seen[a] += n
        seen[b] += n
    total = sum(seen.values())
    want = {(a, b): math.log(n * (2 if a == b else 1) * total / (seen[a] * seen[b])) for (a, b), n in pairs.items()}
    for size in (10, 10**12):
        kept = cooccur.known_pairs(got, words, size)
        have = {(r.a, r.b): r.pmi for r in cooccur.word_pmi(kept, size).collect()}
        assert have.keys() == {p for p, v in want.items() if v > 0} and all(math.isclose(v, want[p]) for p, v in have.items())


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_numbered_pairs_equal_brute_force(spark, monkeypatch, budget):
    monkeypatch.setattr(cooccur, "RUN", 7)  # pairs across the cuts stay
    monkeypatch.setattr(cooccur, "BROADCAST_BUDGET", budget)  # without room the words stand for themselves
    rng = np.random.default_rng(6)
    texts = [[f"w{int(k)}" for k in rng.geometric(0.2, n)] for n in (0, 1, 2, 5, 7, 8, 40, 100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (3, [])], "doc_id long, tokens array<string>")
    tf = Counter(w for t in texts for w in t)
    words = spark.createDataFrame([(w,) for w in tf if tf[w] > 1], "word string")
    want = {p: n for p, n in brute_pairs(texts, 3).items() if tf[p[0]] > 1 and tf[p[1]] > 1}
    for size in (10, 10**12):
        pairs, ids = cooccur.vocabulary_pairs(docs, words, words.count(), size, 3)
        assert dict(pairs.dtypes)["a"] == ("bigint" if budget else "string")
        got = cooccur.named(pairs, ids, size)
        assert got.columns == ["a", "b", "n"]
        assert {(r.a, r.b): r.n for r in got.collect()} == want


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    hashed = cooccur._hashed
    monkeypatch.setattr(cooccur, "_hashed", lambda w, seed: hashed(w, seed) if seed else hashed(w, seed) % 2)
    words = spark.createDataFrame([(w,) for w in "abcde"], "word string")
    rows, hashes, seed = cooccur.numbered(words, 5)
    assert seed == 1 and len(hashes) == 5 and sorted(r.id for r in rows.collect()) == [0, 1, 2, 3, 4]


def test_projected_vectors_equal_brute_force(spark):
    import hashlib

    pmi = spark.createDataFrame([("a", "b", 3, 1.5), ("b", "b", 1, 0.25), ("b", "c", 2, 0.75)], "a string, b string, n long, pmi double")
    words = spark.createDataFrame([(w,) for w in "abcd"], "word string")
    dim = 130  # more than two md5 prefixes have bits
    got = {r.word: r.fixed for r in cooccur.project(pmi, words, 100, dim, 7).collect()}

    def signs(word):
        return [2 * (int(hashlib.md5(f"{word}:7:{d // 60}".encode()).hexdigest()[:HEX_DIGITS], 16) >> d % 60 & 1) - 1 for d in range(dim)]

    around = {"a": [("b", 1.5)], "b": [("a", 1.5), ("b", 0.25), ("c", 0.75)], "c": [("b", 0.75)], "d": []}
    for word, contexts in around.items():
        want = np.zeros(dim)
        for other, value in contexts:
            want += np.array(signs(other)) * value * cooccur.SCALE
        assert got[word] == want.tolist()


def test_numbered_words_are_projected_without_wide_rows(spark, monkeypatch):
    """The same sums as by words, packed in small runs; what is shuffled has no array of a word's dimensions or signs."""
    rng = np.random.default_rng(1)
    words = spark.createDataFrame([(f"w{i}", i) for i in range(60)], "word string, id long")
    seen = {tuple(sorted(p)) for p in rng.integers(0, 50, (400, 2)).tolist()} | {(7, 7)}
    pairs = spark.createDataFrame([(a, b, 1, float(rng.random() * 5)) for a, b in sorted(seen)], "a long, b long, n long, pmi double")
    by_name = pairs.select(F.concat(F.lit("w"), "a").alias("a"), F.concat(F.lit("w"), "b").alias("b"), "n", "pmi")
    want = {r.word: r.fixed for r in cooccur.project(by_name, words.select("word"), 100, 130, 7).collect()}
    monkeypatch.setattr(cooccur, "SLICE", 50)
    monkeypatch.setattr(cooccur, "SIGNED", 16, raising=False)
    monkeypatch.setattr(cooccur, "MOST_WORDS", 7, raising=False)
    monkeypatch.setattr(cooccur, "_joined_parts", lambda *_: pytest.fail("sums are shuffled"))
    rows = cooccur.project(pairs, words, 100, 130, 7).collect()
    assert len(rows) == 60 and {r.word: r.fixed for r in rows} == want


def test_packed_counts_are_merged_in_bounded_steps(monkeypatch):
    """Parts that go on in the next batch, keys in several rows of a part; no more is held than the keys and a slice."""
    import pyarrow as pa

    rng, want, batches = np.random.default_rng(2), Counter(), []
    for parts in ([0, 0, 0, 1], [1, 1], [], [1, 4, 4]):
        cells = []
        for part in parts:
            keys, n = np.unique(rng.integers(0, 30, 12) + 100 * part, return_counts=True)
            want.update(dict(zip(keys.tolist(), n.tolist())))
            cells.append((part, keys.astype(np.int64).tobytes(), n.astype(np.int64).tobytes()))
        columns = list(zip(*cells)) or [[], [], []]
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["part", "keys", "n"]))
    held, summed = [], cooccur._summed
    monkeypatch.setattr(cooccur, "_summed", lambda keys, n: held.append(sum(map(len, keys))) or summed(keys, n))
    monkeypatch.setattr(cooccur, "SLICE", 10)
    got = [(k, c) for b in cooccur._merged(iter(batches)) for k, c in zip(*[x.to_pylist() for x in b.columns])]
    assert dict(got) == want and len(got) == len(want) and max(held) <= 60


@pytest.mark.parametrize("kind, budget", [("bigint", 10**9), ("bigint", 5 * 8 * 3), ("float", 5 * 4 * 2), ("double", 0)])
def test_sums_by_columns_equal_brute_force(spark, monkeypatch, kind, budget):
    """However few columns there is room for: repeated, unknown and null words, a word given twice, rows without any."""
    lists = [["a", "b", "a"], [], ["zz", None, "c"], None, ["e"] * 5, ["d", "zz"]]
    given = [(w, [i * 7 + j * (-1) ** i for j in range(7)]) for i, w in enumerate("abcde")] + [("c", [100] * 7)]
    table = spark.createDataFrame(given, "word string, vector array<bigint>").select("word", F.col("vector").cast(f"array<{kind}>").alias("vector"))
    hashes, seed = cooccur.hashes_apart(table.select("word").distinct(), 6)
    rows = spark.createDataFrame(list(enumerate(lists)), "_row long, t array<string>")
    rows = rows.select("_row", F.transform("t", lambda w: F.when(w.isNotNull(), cooccur.hash_of(w, seed))).alias("_hashes"))
    monkeypatch.setattr(pooling, "SLICE", 2)
    got = pooling.id_sums(pooling.with_ids(rows, ["_row"], hashes), table.select(cooccur.hash_of("word", seed).alias("_hash"), "vector"), hashes, 7, budget).collect()
    for r in got:
        hits = [v for w in lists[r._row] or [] for x, v in given if x == w]
        assert r._times == len(hits) and r._sums == np.sum([np.zeros(7, int), *hits], axis=0).tolist()
    assert len(got) == len(lists)


def test_vectors_beyond_the_budget_are_not_joined(spark, monkeypatch):
    """Pooling and bucket vectors send no vector by word or bucket."""
    monkeypatch.setattr(pooling, "lookup_join", lambda *_, **__: pytest.fail("vectors are shuffled"))
    monkeypatch.setattr(subword, "lookup_join", lambda *_, **__: pytest.fail("vectors are shuffled"))
    table = spark.createDataFrame([(w, v) for _, w, v in VECTORS], "word string, vector array<float>")
    docs = spark.createDataFrame([(1, ["cat", "dog"]), (1, ["bird"])], "doc_id long, tokens array<string>")
    got = sorted(r.vector for r in pooling.mean_pool(docs, table, 2, 4, budget=0).collect())
    assert np.allclose(got, [[0, 0], [5 / 3, 2]])
    words = spark.createDataFrame([("cat", [4, 8]), ("cats", [2, 2])], "word string, fixed array<bigint>")
    unit = cooccur.SCALE * 2**0.5
    rows = subword.bucket_vectors(words, 2, 1, 2, 3, 3, "md5").collect()
    # three n-grams of <cat> and four of <cats> in one bucket
    assert [r.bucket for r in rows] == [0] and np.allclose(rows[0].vector, [20 / 7 / unit, 32 / 7 / unit])


@pytest.mark.parametrize("budget", [pooling.table_bytes(1, 2), 0])
def test_words_too_many_to_number_are_joined(spark, monkeypatch, budget):
    monkeypatch.setattr(pooling, "hashes_apart", lambda *_: None)
    test_mean_pool_gives_one_answer(spark, budget)


def test_trained_vectors_find_planted_synonyms_and_repeat(spark):
    docs = planted(spark, 6000)
    vectorizer = wordvec.CoOccurrence(vector_size=64)
    first = {r.word: r.vector for r in vectorizer.fit(docs).vectors.collect()}
    second = {r.word: r.vector for r in vectorizer.fit(docs.repartition(5)).vectors.collect()}
    assert first == second
    assert cosine(first["alpha"], first["omega"]) > cosine(first["alpha"], first["stone"]) + 0.05
    assert len(first) == 19


def test_subword_training_places_a_misspelling(spark):
    docs = planted(spark)
    model = subword.SubwordCoOccurrence(vector_size=64).fit(docs)
    words = spark.createDataFrame([("stone",), ("stones",), ("alpha",)], "word string")
    v = {r.word: r.vector for r in model.word_vectors(words).collect()}
    assert cosine(v["stone"], v["stones"]) > cosine(v["alpha"], v["stones"])
    pooled = model.pool(corpus(spark, "stones neverseen", "", "qqq")).orderBy("doc_id").collect()
    assert any(pooled[0].vector) and not any(pooled[1].vector) and not any(pooled[2].vector)


def test_empty_vocabulary_gives_zero_vectors(spark):
    docs = corpus(spark, "each word once")
    for vectorizer in (wordvec.CoOccurrence(vector_size=4), subword.SubwordCoOccurrence(vector_size=4, buckets=16)):
        row = vectorizer.fit(docs).pool(docs).first()
        assert row.vector == [0.0] * 4


def test_pooling_looks_up_a_bounded_number_of_tokens(monkeypatch):
    """However many tokens a batch holds; what the table lacks comes out with the sums."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes, index_in = [], pc.index_in
    monkeypatch.setattr(pooling.pc, "index_in", lambda flat, **k: sizes.append(len(flat)) or index_in(flat, **k))
    monkeypatch.setattr(pooling, "LOOKED_UP", 5, raising=False)
    texts = [["a", "b"], None, [], ["x", "a", "y", None, "a", "z"], ["b"], ["b", "b", "x"], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.list_(pa.string()))], ["_row", "tokens"])
    known = pooling._Table(pa.array(["a", "b"]), np.array([[1.0, 2.0], [10.0, 20.0]]), np.array([1.0, 2.0]))
    work = pooling._pool_batches(type("B", (), {"value": known}), 2, ["_row"], np.float64, True)
    got = [r for b in work(iter([batch])) for r in b.to_pylist()]
    assert max(sizes) <= 6
    assert [r["_others"] for r in got] == [[], [], [], ["x", "y", "z"], [], ["x"], []]
    assert [r["vector"] for r in got] == [[11, 22], [0, 0], [0, 0], [2, 4], [10, 20], [20, 40], [1, 2]]
    assert [r["_times"] for r in got] == [3, 0, 0, 2, 2, 4, 1]


def brute_top(docs, k, min_df):
    tf, df = Counter(), Counter()
    for t in docs:
        tf.update(t)
        df.update(set(t))
    rows = sorted(((-n, w) for w, n in tf.items() if df[w] >= min_df))[:k]
    return {w: (-n, df[w]) for n, w in rows}


@pytest.mark.parametrize("shape, least_width", [("zipf", 4), ("flat", 4), ("few", 16)])
def test_heavy_hitters_are_exact(spark, shape, least_width):
    rng = np.random.default_rng(len(shape))
    draws = {"zipf": rng.zipf(1.3, 60_000) % 5_000, "flat": rng.permutation(np.repeat(np.arange(6_000), 3)), "few": rng.integers(0, 9, 4_000)}[shape]
    docs = [[f"t{v}" for v in d] for d in np.array_split(draws, 300)]
    rows = spark.createDataFrame([(d,) for d in docs] + [(None,), ([],), ([None],)], "terms array<string>").repartition(20)
    for k, min_df in ((1, 1), (25, 2), (40, 3)):
        found = frequent.frequent_terms(rows, "terms", k, min_df, width=least_width, largest=2_000)
        want = brute_top(docs, k, min_df)
        if found is None:
            assert shape == "flat"
            continue
        top = terms.top_terms(found, k, min_df).collect()
        assert {r.term: (r.tf, r.df) for r in top} == want
    if shape == "flat":
        assert frequent.frequent_terms(rows, "terms", 25, 1, least_width, 500) is None
        # a wide enough summary holds everything and is exact again
        assert terms.top_terms(frequent.frequent_terms(rows, "terms", 25, 1, 400, 10_000), 25).count() == 25


def test_a_task_adds_up_a_bounded_number_of_terms(monkeypatch):
    """However many terms its batches hold."""
    import pyarrow as pa

    sizes, add = [], frequent.add
    monkeypatch.setattr(frequent, "add", lambda terms, counts, k: sizes.append(sum(map(len, terms))) or add(terms, counts, k))
    monkeypatch.setattr(frequent, "SLICE", 100)
    monkeypatch.setattr(frequent, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda _: 9})())}))
    texts = pa.array([[f"t{i}" for i in range(at, at + 500)] + [None] for at in range(0, 2_000, 500)])
    (found,) = frequent._summarise(50)(iter([pa.RecordBatch.from_arrays([texts], ["terms"])]))
    assert max(sizes) <= 150 and found.num_rows <= 50
    sizes.clear()
    same = np.ones(60, dtype=np.int64)
    parts = [frequent._rows(p, pa.array([f"p{p}t{i}" for i in range(60)]), same * (p + 1), p) for p in range(8)]
    (merged,) = frequent._merge(50)(iter(parts))
    assert max(sizes) <= 50 + 160 and merged.num_rows <= 50
    n, error = merged.column("n").to_numpy(), merged.column("error")[0].as_py()
    assert error >= sum(range(8)) and (n + error >= 1).all()


def test_summaries_bound_their_error(spark):
    rng = np.random.default_rng(3)
    draws = rng.zipf(1.2, 40_000) % 3_000
    docs = [[f"t{v}" for v in d] for d in np.array_split(draws, 100)]
    true = Counter(w for d in docs for w in d)
    rows = spark.createDataFrame([(d,) for d in docs], "terms array<string>").repartition(70)
    found = frequent.summary(rows, "terms", 200).collect()
    error = found[0].error
    assert len(found) <= 200 and 0 < error <= 40_000 / 200
    listed = {r.term: r.n for r in found if r.term is not None}
    assert all(listed[w] <= true[w] <= listed[w] + error for w in listed)
    assert all(n <= error for w, n in true.items() if w not in listed)


def test_projection(spark, sf):
    from pyspark.ml.functions import array_to_vector

    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = emb.select("vec_id", "label", array_to_vector("embedding").alias("features"))
    got = project.project_2d(rows).orderBy("vec_id").toPandas()
    x = np.array([r.embedding for r in emb.orderBy("vec_id").collect()])
    x = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    for k, name in enumerate("xy"):
        axis = axes[k] * np.sign(axes[k][np.abs(axes[k]).argmax()])
        assert np.allclose(got[name], x @ axis, atol=1e-6)
    assert -1 <= project.class_separation(rows) <= 1


def test_covariance_and_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ np.diag([3, 2.9, 1, 1, 0.5, 0]) + 1e6  # large means would spoil plain sums
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0])], "doc_id long, vector array<double>")
    cells = project.covariance(rows.repartition(9))
    got = np.zeros((6, 6))
    for r in cells.collect():
        got[r.i, r.j] = got[r.j, r.i] = r.cov
    want = np.cov(x.T)
    assert np.allclose(got, want, atol=1e-6)
    axes = project.principal_axes(cells, 3, squarings=16).orderBy("component").collect()
    values, vectors = np.linalg.eigh(want)
    for k, r in enumerate(axes):
        v = vectors[:, -1 - k] * np.sign(vectors[np.abs(vectors[:, -1 - k]).argmax(), -1 - k])
        assert np.allclose(r.axis, v, atol=1e-4) and np.isclose(r.variance, values[-1 - k]) and np.isclose(r.share, values[-1 - k] / values.sum())
    whole = rows.where("doc_id < 900")
    placed = project.on_axes(whole, project.principal_axes(cells, 2)).orderBy("doc_id").collect()
    assert np.allclose([r.places[0] for r in placed], (x - x.mean(0)) @ np.array(axes[0].axis), atol=1e-2)
    still = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "doc_id long, vector array<double>")
    assert [(r.variance, r.share) for r in project.principal_axes(project.covariance(still)).collect()] == [(0.0, 0.0)] * 2


def test_word_counts(spark):
    got = {r.word: r.tf for r in wordvec.word_counts(corpus(spark, "a b a", "b c"), 2).collect()}
    assert got == {k: v for k, v in Counter("abab").items()}


def test_models_are_saved_and_loaded(spark, tmp_path):
    docs = corpus(spark, "red blue red", "blue green", "red green green")
    model = terms.TfIdf(min_df=1).fit(docs)
    model.save(str(tmp_path / "tfidf"))
    again = terms.TermModel.load(spark, str(tmp_path / "tfidf"))
    assert again.transform(docs).collect() == model.transform(docs).collect()
    model = subword.SubwordCoOccurrence(vector_size=4, buckets=32).fit(docs)
    model.save(str(tmp_path / "subword"))
    again = subword.SubwordModel.load(spark, str(tmp_path / "subword"), n_buckets=32)
    assert again.pool(docs).orderBy("doc_id").collect() == model.pool(docs).orderBy("doc_id").collect()
    model = wordvec.CoOccurrence(vector_size=4).fit(docs)
    model.save(str(tmp_path / "words"))
    again = wordvec.WordVectorModel.load(spark, str(tmp_path / "words"))
    assert (again.dim, again.n_vectors) == (4, 3)
    assert again.pool(docs).orderBy("doc_id").collect() == model.pool(docs).orderBy("doc_id").collect()
