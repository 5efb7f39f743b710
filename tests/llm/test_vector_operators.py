import numpy as np
import pytest

from brute import smallest_reachable

from textyard.llm import hnsw, topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, node string")


def some_vectors(seed, n, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    rows = [(i, [float(v) for v in (centres[i % 8] + rng.normal(scale=0.04 if i % 3 else 1.0, size=d)).astype(np.float32)], int(rng.integers(0, 3)), "x") for i in range(n)]
    rows += [(n, None, 1, None), (n + 1, [0.0] * d, 1, "x"), (n + 2, [float("nan")] * d, 1, "x"), (n + 3, rows[5][1], None, "x"), (n + 4, rows[5][1], rows[5][2], "x"), (n + 5, [1.0, None] * (d // 2), 0, "x"), (n + 6, [1.0] * (d + 1), 0, "x")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = some_vectors(2, 600)
    rows += [(5_000, [3.0, 4.0], 1, "x"), (5_001, [0.6, 0.8], 1, "y"), (5_002, [0.6, 0.8], 2, "y")]  # another length
    rows += [(5_010, [1e38, 1e38] * 8, 7, "x"), (5_011, [1e-38, 1e-38] * 8, 7, "x"), (5_012, [1e38, -1e38] * 8, 7, "x")]
    got = hnsw.near_duplicates(frame(spark, rows), shard_rows=120).toPandas().set_index("vec_id")
    good = [r for r in rows if r[1] and r[2] is not None and len(r[1]) == 16 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = np.array([r[1] for r in good])
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    label, ids = np.array([r[2] for r in good]), np.array([r[0] for r in good])
    link = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    a, b = np.nonzero(link)
    root = smallest_reachable([r[0] for r in rows], [*zip(ids[a], ids[b]), (5_000, 5_001)])
    assert len(got) == len(rows) and got.component_id.to_dict() == root
    want = dict.fromkeys(root, 0) | dict(zip(ids, link.sum(1))) | {5_000: 1, 5_001: 1}
    assert want[5_010] == want[5_011] == 1 and want[5_012] == 0
    assert got.n_links.to_dict() == want and (got.kept == (got.index == got.component_id)).all()
    assert hnsw.near_duplicates(frame(spark, [])).count() == 0


def test_only_zero_vectors_are_no_division_by_zero(spark):
    rows = [(1, [0.0, 0.0], 1, "x"), (2, [0.0, 0.0], 1, "x"), (3, [3.0, 4.0], 1, "x"), (4, [6.0, 8.0], 1, "x"), (5, [0.0, -0.0], None, "x")]
    got = hnsw.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_a_shard_half_of_near_copies(spark):
    """Dense groups are compared block by block: all links, little memory, no walk through every pair."""
    import time

    rng = np.random.default_rng(9)
    x = rng.normal(size=(5_000, 64))
    x[:2_500] = x[0] + rng.normal(scale=0.005, size=(2_500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.Graph.build(x)
    q, ids = x[:2_048], np.arange(2_048)
    began, links, most = time.perf_counter(), np.zeros(2_048, dtype=np.int64), 0
    for who, node in hnsw.links_of(ids, q, graph, x, 0.98, 0.999):
        links += np.bincount(who, minlength=2_048)
        most = max(most, len(who))
    assert np.array_equal(links, (q @ x.T >= 0.98).sum(axis=1)) and most <= 128 * 5_000
    assert time.perf_counter() - began < 20


def test_products_of_large_components_and_other_lengths(spark):
    rows = [(i, [float(3 * 2**k + i), 1.0, -2.0**k], 0, "x") for i, k in enumerate((3, 20, 16, 17, 18, 19, 20, 20, 20, 20, 19, 18, 20))]
    rows += [(100 + i, [float(i), 2.0**16], 0, "x") for i in range(4)]
    got = topk.top_inner_products(frame(spark, rows), k=5, every=2).collect()
    want = []
    for r in rows:
        if r[0] % 2 == 0:
            q = [int(np.floor(1024 * np.float32(v))) for v in r[1]]
            scored = sorted((-sum(a * int(np.floor(1024 * np.float32(b))) for a, b in zip(q, o[1])), o[0]) for o in rows if o[0] != r[0] and len(o[1]) == len(r[1]))
            want += [(r[0], k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, got)) == sorted(want) and max(w[3] for w in want) > 2**53
    with pytest.raises(Exception, match="range of a long"):
        topk.top_inner_products(frame(spark, [(0, [1e30], 0, "x"), (1, [1e30], 0, "x")])).collect()


def test_graph_recall_without_audit():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.Graph.build(x)
    q = x[:200] + rng.normal(scale=0.05, size=(200, 24))
    q /= np.linalg.norm(q, axis=1)[:, None]
    ids, _ = graph.descend(q.astype(np.float32), 64)
    best = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, best)]) > 0.95


@pytest.mark.parametrize("n, every", [(700, 50), (8, 2)])
def test_top_products_equal_brute_force(spark, n, every):
    rows = some_vectors(3, n)
    got = topk.top_inner_products(frame(spark, rows), every=every).toPandas()
    good = [r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1])]
    x = [np.floor(1024 * np.array(r[1])).astype(np.int64) for r in good]
    want = set()
    for r, q in zip(good, x):
        if r[0] % every == 0:
            scored = sorted((-int(q @ c), o[0]) for o, c in zip(good, x) if o[0] != r[0] and len(c) == len(q))[:10]
            want |= {(r[0], k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert set(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == want
    assert topk.top_inner_products(frame(spark, [])).count() == 0
