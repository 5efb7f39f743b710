"""Embedding near-dedup with a navigable small-world graph per shard.

Vectors of one label are dealt to shards of bounded size; each shard builds a hierarchical graph with numpy,
in one task. Packs of vectors query the graphs of every shard of their label: a beam finds the neighbourhood,
and hits are followed along the graph as long as they bring further hits. A share of each pack is compared
with the whole shard; while the audit finds less than the asked recall, beams are widened and the pack is
searched again, at last by comparing everything. Cosines are verified in double precision. A task returns,
for its pack and shard, how many links a vector has and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textyard.llm.common import stored
from textyard.llm.components import components
from textyard.llm.vectors import matrix, packs, sound, unpack

COSINE = 0.98
SHARD_ROWS = 32_768
QUERY_ROWS = 2048
NEIGHBOURS = 24
BUILD_BEAM = 40
SEARCH_BEAM = 48
RECALL = 0.999
AUDIT_SHARE = 16


def greatest_first(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of candidates by descending similarity, those nearer to the base than to any chosen one; room is filled with the next best."""
    between = np.einsum("bcd,bed->bce", x[ids], x[ids])
    dead, chosen = (ids < 0) | ~np.isfinite(sims), np.zeros(ids.shape, dtype=bool)
    absent = dead.copy()
    for j in range(ids.shape[1]):
        take = ~dead[:, j] & (chosen.sum(axis=1) < width)
        chosen[take, j] = True
        dead[take] |= between[take, j] > sims[take]
    rank = np.where(chosen, 2, np.where(absent, 0, 1))
    order = np.argsort(-rank, axis=1, kind="stable")[:, :width]
    out = np.full((len(ids), width), -1)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(rank, order, 1) > 0, np.take_along_axis(ids, order, 1), -1)
    return out


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all of them, each next one a random share."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None, m: int = NEIGHBOURS):
        self.x, self.m = np.ascontiguousarray(x, dtype=np.float32), m
        self.layers = layers or []

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` most similar nodes found from ``entry`` for each query, best first; all queries move in step."""
        links, n = self.layers[layer], len(q)
        ids = np.full((n, width), -1)
        sims = np.full((n, width), -np.inf, dtype=np.float32)
        ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", q, self.x[entry])
        done = np.zeros((n, width), dtype=bool)
        seen = np.zeros((n, len(self.x)), dtype=bool)
        seen[np.arange(n), entry] = True
        while True:
            open_ = np.where(done | (ids < 0), -np.inf, sims)
            pick = open_.argmax(axis=1)
            live = np.flatnonzero(np.isfinite(open_[np.arange(n), pick]))
            if not len(live):
                return ids, sims
            done[live, pick[live]] = True
            near = links[ids[live, pick[live]]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            a, b = np.nonzero(fresh)
            seen[live[a], near[a, b]] = True
            value = np.full(near.shape, -np.inf, dtype=np.float32)
            value[a, b] = np.einsum("kd,kd->k", q[live[a]], self.x[near[a, b]])
            every_id = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            every_sim = np.concatenate([sims[live], value], axis=1)
            every_done = np.concatenate([done[live], ~fresh], axis=1)
            order = np.argsort(-every_sim, axis=1, kind="stable")[:, :width]
            ids[live], sims[live] = np.take_along_axis(every_id, order, 1), np.take_along_axis(every_sim, order, 1)
            done[live] = np.take_along_axis(every_done, order, 1)

    def descend(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full(len(q), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self.beam(q, entry, 2, layer)[0][:, 0]
        return self.beam(q, entry, width, 0)

    @classmethod
    def build(cls, x: np.ndarray, m: int = NEIGHBOURS, seed: int = 5) -> "Graph":
        """Insert vectors in growing batches; members of a batch see the graph before it and each other."""
        n = len(x)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 6)
        order = np.argsort(-level, kind="stable")
        graph = cls(x, [np.full((n, m), -1) for _ in range(int(level.max()) + 1 if n else 1)], m)
        graph.entry = int(order[0]) if n else 0
        at = 1
        while at < n:
            batch = order[at : at + int(min(max(at // 2, 1), 512))]
            q = graph.x[batch]
            entry = np.full(len(batch), graph.entry)
            for layer in range(len(graph.layers) - 1, -1, -1):
                ids, sims = graph.beam(q, entry, BUILD_BEAM if layer == 0 else 8, layer)
                entry = ids[:, 0]
                joins = np.flatnonzero(level[batch] >= layer)
                if len(joins):
                    graph._link(batch[joins], ids[joins], sims[joins], layer)
            at += len(batch)
        return graph

    def _link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int) -> None:
        links, m = self.layers[layer], self.m
        own = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(own, -np.inf)
        ids = np.concatenate([ids, np.broadcast_to(nodes, own.shape)], axis=1)
        ids, sims = greatest_first(ids, np.concatenate([sims, own], axis=1), BUILD_BEAM)
        links[nodes] = diverse(self.x, ids, sims, m)
        a, b = np.nonzero(links[nodes] >= 0)
        source, target = nodes[a], links[nodes][a, b]
        value = np.einsum("kd,kd->k", self.x[source], self.x[target])
        order = np.lexsort((-value, target))
        source, target, value = source[order], target[order], value[order]
        node, first = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        use = place < m
        row = np.searchsorted(node, target[use])
        more = np.full((len(node), m), -1)
        more[row, place[use]] = source[use]
        for part in np.array_split(np.arange(len(node)), max(1, len(node) // 1024)):
            every = np.concatenate([links[node[part]], more[part]], axis=1)
            twice = (every[:, :m, None] == more[part][:, None, :]).any(axis=2)
            every[:, :m][twice] = -1
            value = np.where(every >= 0, np.einsum("bcd,bd->bc", self.x[every], self.x[node[part]]), -np.inf)
            links[node[part]] = diverse(self.x, *greatest_first(every, value, 2 * m), m)

    def within(self, q: np.ndarray, least: float, width: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs of at least ``least`` similarity: the beam's, and those reached through pairs of least - slack;
        and which queries have a beam full of them: these lie in a dense group, and are left to the exact product."""
        ids, sims = self.descend(q, min(width, len(self.x)))
        full = ((ids >= 0) & (sims >= least)).all(axis=1)
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        a, b = np.nonzero((ids >= 0) & (sims >= least - slack) & ~full[:, None])
        who, node, value = a, ids[a, b], sims[a, b]
        seen[who, node] = True
        found = [(who, node, value)]
        while len(who):
            near = self.layers[0][node]
            a, b = np.nonzero(near >= 0)
            code = np.unique(who[a] * len(self.x) + near[a, b])
            who, node = code // len(self.x), code % len(self.x)
            new = ~seen[who, node]
            who, node = who[new], node[new]
            seen[who, node] = True
            value = np.concatenate([np.einsum("kd,kd->k", q[who[i : i + 65536]], self.x[node[i : i + 65536]]) for i in range(0, len(who), 65536)] or [np.zeros(0)])
            go = value >= least - slack
            who, node, value = who[go], node[go], value[go]
            found.append((who, node, value))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), full


def links_of(ids_q: np.ndarray, q: np.ndarray, graph: Graph, exact: np.ndarray, cosine: float, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified (query, node) pairs, in runs of bounded size.

    Beams widen until an audit of some queries against all nodes finds ``recall`` of their links. Queries whose beam holds nothing
    but links have more of them than a walk of the graph finds cheaply: they are compared with all nodes, block by block.
    """
    rough = cosine - 1e-5
    audit = np.flatnonzero(ids_q % AUDIT_SHARE == 0)
    audit = audit if len(audit) >= 32 else np.arange(min(len(q), 32))
    true = np.zeros(len(q), dtype=np.int64)
    true[audit] = (q[audit] @ exact.T >= cosine).sum(axis=1)
    audited = np.zeros(len(q), dtype=bool)
    audited[audit] = True
    width, slack, left = SEARCH_BEAM, 0.01, np.arange(len(q))
    q32 = q.astype(np.float32)
    while width < len(exact) and len(left):
        who, node, full = graph.within(q32[left], rough, width, slack)
        who = left[who]
        yield from compared(left[full], q, exact, cosine)
        left = left[~full]
        value = np.concatenate([np.einsum("kd,kd->k", q[who[i : i + 65536]], exact[node[i : i + 65536]]) for i in range(0, len(who), 65536)] or [np.zeros(0)])
        who, node = who[value >= cosine], node[value >= cosine]
        if audited[who].sum() >= recall * true[left].sum():
            yield who, node
            return
        width, slack = 2 * width, 2 * slack
    yield from compared(left, q, exact, cosine)


def compared(rows: np.ndarray, q: np.ndarray, exact: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of some queries by comparison with all nodes."""
    for i in range(0, len(rows), 128):
        part = rows[i : i + 128]
        a, b = np.nonzero(q[part] @ exact.T >= cosine)
        yield part[a], b


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id on a link with the smallest id it is connected to by these links."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors of one label, which is not null, and one length are compared. Vectors that are null, zero, or hold null or
    non-finite components link with nothing, nor does a row without vec_id (its component is null). Equal vectors are searched once, and each counts as a link of the others. Rows that
    share a vec_id are one node with the links of all of them. Columns besides vec_id, embedding and label are
    not read.
    """
    named = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("x"), F.col("label").alias("label"))
    rows = sound(named.where("vec_id is not null and label is not null"), "x")
    # scaled by the largest component, so that no square overflows or vanishes; a join may scale zero vectors before they are dropped
    top = F.array_max(F.transform("x", lambda v: F.abs(v)))
    rows = rows.withColumn("_t", top).where("_t > 0").withColumn("x", F.transform("x", lambda v: F.try_divide(v, F.col("_t")))).drop("_t")
    rows = rows.withColumn("label", F.to_json(F.struct(F.size("x").alias("d"), "label")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    groups = stored(rows.groupBy("label", "x").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    members = stored(rows.join(groups, ["label", "x"]).select("vec_id", "node", "copies"))
    # a vec_id may stand for several vectors: nodes of the search are then told apart by label and vector
    nodes = stored(groups.select("label", "x", "node", "copies", F.xxhash64("label", "x").alias("key")))
    shards = nodes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    unit = F.transform("x", lambda v: v / norm)
    dealt = nodes.join(shards, "label").withColumn("shard", F.pmod(F.col("key"), F.col("shards")).cast("int")).withColumn("x", unit)
    label_type = nodes.schema["label"].dataType.simpleString()

    def build(key, table):
        order = np.argsort(table["node"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        x = matrix(table["x"].combine_chunks())
        graph = Graph.build(x)
        cells = [[key[0].as_py()], [key[1].as_py()], [len(x)], [table["node"].to_numpy().astype("<i8").tobytes()], [table["copies"].to_numpy().astype("<i8").tobytes()], [x.astype("<f8").tobytes()], [[g.astype("<i4").tobytes() for g in graph.layers]], [graph.entry]]
        return pa.table([pa.array(c, t) for c, t in zip(cells, (key[0].type, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int32()))], names=["label", "shard", "size", "ids", "weights", "xs", "layers", "entry"])

    graphs = stored(dealt.select("label", "shard", "node", "copies", "x").groupBy("label", "shard").applyInArrow(build, f"label {label_type}, shard int, size int, ids binary, weights binary, xs binary, layers array<binary>, entry int"))
    spread = dealt.select("label", "shards", "node", "x", F.pmod(F.xxhash64("key"), F.lit(64)).alias("salt"))
    sorted_ = spread.repartition("label", "salt").sortWithinPartitions("label", "shards")
    asked = stored(packs(sorted_, ["label", "shards"], ["node"], "x", QUERY_ROWS))
    asked = asked.select("label", "pack", F.col("rows").alias("q_rows"), F.col("node").alias("q_ids"), F.col("x").alias("q"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    pairs = asked.join(graphs, ["label", "shard"]).select("q_rows", "q_ids", "q", "size", "ids", "weights", "xs", "layers", "entry")

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids = unpack(r["q_ids"], "<i8"), unpack(r["ids"], "<i8")
                q, x = unpack(r["q"], rows=r["q_rows"]), unpack(r["xs"], rows=r["size"])
                graph = Graph(x, [unpack(g, "<i4", r["size"]).astype(np.int64) for g in r["layers"]])
                graph.entry = r["entry"]
                weights, links = unpack(r["weights"], "<i8"), np.zeros(len(q_ids), dtype=np.int64)
                on, root = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                for who, node in links_of(q_ids, q, graph, x, cosine, recall):
                    real = q_ids[who] != ids[node]
                    who, node = who[real], node[real]
                    links += np.bincount(who, weights[node], minlength=len(q_ids)).astype(np.int64)
                    # of many links only the trees they form are kept
                    on, root = forest(np.concatenate([on, q_ids[who]]), np.concatenate([root, ids[node]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([q_ids, on])), pa.array(np.concatenate([links, np.zeros(len(on), np.int64)])), pa.array(np.concatenate([q_ids, root]))], ["node", "links", "root"])

    found = stored(pairs.mapInArrow(search, "node bigint, links bigint, root bigint"))
    linked = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(members.where("vec_id <> node").select("vec_id", "node")))
    smallest = linked.groupBy("root").agg(F.min("node").alias("component_id"))
    tops = linked.join(smallest, "root").select(F.col("node").alias("vec_id"), "component_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = members.join(counts, "node").select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    own = own.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = named.select("vec_id").join(own, "vec_id", "left").join(tops, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.coalesce(F.col("vec_id") == component, F.lit(False))).alias("kept"))
