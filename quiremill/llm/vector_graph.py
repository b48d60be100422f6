"""Embedding near-duplicates by navigable small-world graphs, one for each shard.

Distinct vectors are dealt into shards by a hash of their smallest id. Every shard
builds a hierarchical graph over its own vectors and answers the queries of all
vectors. A beam that ends with nothing but links is not wide enough to show all of
them; such queries are answered exactly by blocks of the shard. Before a shard answers,
audits compare sample queries with brute force and double the beam until recall holds.
Links are verified in double precision, counted for each query, and returned as a
spanning forest, never as all pairs of a dense group.

The number of shards is ``MIN_SHARDS`` until a shard would pass ``SHARD_ROWS`` vectors,
and grows with the input from there. The search stays approximate: see the README for
measured recall.

Defined results: vectors that are null, zero or empty, or hold null or non-finite
components, and rows without an id, link with nothing; vectors of different lengths do
not link; equal vectors are one node that counts as often as it comes; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.common import connected_components, written

MIN_SHARDS = 8
SHARD_ROWS = 40_000
NEIGHBOURS = 14
BEAM = 32
#: Queries that walk a graph in step.
BATCH = 512
#: Share of true links that an audit must find.
AUDIT_RECALL = 0.97
AUDIT_QUERIES = 96
AUDIT_NODES = 192


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors, built and asked in batches."""

    def __init__(self, vectors: np.ndarray, m: int = NEIGHBOURS, build_beam: int = 40, seed: int = 7):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        self.m, self.build_beam = m, build_beam
        level = np.minimum((-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(m)).astype(int), 8)
        order = np.argsort(-level, kind="stable")  # top nodes first, so that every layer has its entry
        self.level = level
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        at = 1
        while at < n:
            size = min(max(1, at // 2), BATCH, n - at)
            self._insert(order[at : at + size])
            at += size

    def _insert(self, nodes: np.ndarray) -> None:
        x = self.x[nodes]
        near = np.full((len(nodes), 1), self.entry)
        among = x @ x.T
        np.fill_diagonal(among, -2)
        for k in range(len(self.links) - 1, -1, -1):
            mine = self.level[nodes] >= k
            ids, sims = self.beam(x, near, k, self.build_beam if mine.any() else 1)
            near = ids[:, : min(4, ids.shape[1])]
            rows = np.flatnonzero(mine)
            if not len(rows):
                continue
            # Nodes of the same batch see each other, too.
            peers = among[np.ix_(rows, rows)]
            most = min(self.m, len(rows))
            best = np.argpartition(-peers, most - 1, axis=1)[:, :most]
            all_ids = np.c_[ids[rows], nodes[rows][best]]
            all_sims = np.c_[sims[rows], np.take_along_axis(peers, best, 1)]
            all_sims[(all_ids < 0) | (all_ids == nodes[rows][:, None])] = -2
            self._link(k, nodes[rows], all_ids, all_sims)

    def _link(self, k: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        width = self.links[k].shape[1]
        best = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        chosen = self._spread(ids, sims, self.m)
        self.links[k][nodes, : chosen.shape[1]] = chosen
        src = np.repeat(nodes, chosen.shape[1])
        dst = chosen.ravel()
        real = dst >= 0
        src, dst = src[real], dst[real]
        back = np.unique(dst)
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        starts = np.searchsorted(dst, back)
        counts = np.diff(np.r_[starts, len(dst)])
        for low in range(0, len(back), 2048):
            some = slice(low, low + 2048)
            most = int(counts[some].max())
            pos = starts[some][:, None] + np.arange(most)
            new = np.where(np.arange(most) < counts[some][:, None], src[np.minimum(pos, len(src) - 1)], -1)
            both = np.c_[self.links[k][back[some]], new]
            value = np.einsum("nd,nkd->nk", self.x[back[some]], self.x[both])
            value[both < 0] = -2
            best = np.argsort(-value, axis=1)
            both, value = np.take_along_axis(both, best, 1), np.take_along_axis(value, best, 1)
            same = np.zeros_like(both, bool)
            same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
            both[same] = -1
            value[same] = -2
            self.links[k][back[some]] = self._spread(both, value, width)

    def _spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """The nearest candidates that are nearer to the node than to one already chosen; then the nearest others."""
        n, c = ids.shape
        out = np.full((n, most), -1, np.int32)
        kept = np.zeros((n, c), bool)
        count = np.zeros(n, int)
        vectors = self.x[np.maximum(ids, 0)]
        closest = np.full((n, c), -2.0, np.float32)
        half = max(1, most // 2)
        for j in range(c):
            take = (ids[:, j] >= 0) & (sims[:, j] > -2) & (closest[:, j] < sims[:, j]) & (count < half)
            if take.any():
                kept[take, j] = True
                count[take] += 1
                rows = np.flatnonzero(take)
                closest[rows] = np.maximum(closest[rows], np.einsum("nd,nkd->nk", vectors[rows, j], vectors[rows]))
        usable = (ids >= 0) & (sims > -2)
        rank = np.where(kept, 0, np.where(usable, 1, 2)) * (c + 1) + np.arange(c)
        best = np.argsort(rank, axis=1)[:, :most]
        picked = np.where(np.take_along_axis(usable, best, 1), np.take_along_axis(ids, best, 1), -1)
        out[:, : picked.shape[1]] = picked
        return out

    def beam(self, q: np.ndarray, near: np.ndarray, k: int, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` nodes that each query reaches on layer k, best first; all queries step together."""
        count, links = len(q), self.links[k]
        visited = np.zeros((count, len(self.x)), bool)
        rows = np.arange(count)[:, None]
        ids = np.full((count, width), -1, np.int64)
        sims = np.full((count, width), -2.0, np.float32)
        spent = np.ones((count, width), bool)
        first = near[:, : min(width, near.shape[1])]
        e = first.shape[1]
        ids[:, :e] = first
        sims[:, :e] = np.where(first >= 0, np.einsum("qd,qkd->qk", q, self.x[first]), -2)
        spent[:, :e] = first < 0
        visited[rows, np.maximum(first, 0)] |= first >= 0
        at_once = min(at_once, width)
        live = np.arange(count)
        while len(live):
            value = np.where(spent[live], -3.0, sims[live])
            pick = np.argpartition(-value, at_once - 1, axis=1)[:, :at_once]
            open_ = np.take_along_axis(value, pick, 1) > -3
            going = open_.any(1)
            live, pick, open_ = live[going], pick[going], open_[going]
            if not len(live):
                break
            r = live[:, None]
            spent[r, pick] = True
            nodes = np.where(open_, ids[r, pick], -1)
            nb = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
            fresh = (nb >= 0) & ~visited[r, nb]
            nb = np.where(fresh, nb, -1)
            # One neighbour may come from two nodes at once.
            nb = -np.sort(-nb, axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            fresh = nb >= 0
            most = int(fresh.sum(1).max(initial=0))
            if most == 0:
                continue
            if most < nb.shape[1]:
                order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
                nb, fresh = np.take_along_axis(nb, order, 1), np.take_along_axis(fresh, order, 1)
            rr, cc = np.nonzero(fresh)
            visited[live[rr], nb[rr, cc]] = True
            s = np.where(fresh, np.einsum("qd,qkd->qk", q[live], self.x[np.maximum(nb, 0)]), -2)
            all_ids, all_sims = np.c_[ids[live], nb], np.c_[sims[live], s]
            all_spent = np.c_[spent[live], ~fresh]
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            spent[live] = np.take_along_axis(all_spent, best, 1)
        best = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the layers to the best ``width`` nodes for each query."""
        q = np.asarray(q, np.float32)
        near = np.full((len(q), 1), self.entry)
        for k in range(len(self.links) - 1, 0, -1):
            near, _ = self.beam(q, near, k, 4)
        return self.beam(q, near, 0, min(width, len(self.x)))


class Shard:
    """A graph, its audited beam, and the links that queries find in it."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, times: np.ndarray, least: float):
        self.ids, self.unit, self.times, self.least = ids, unit, times, least
        self.graph = SmallWorld(unit)
        self.width = BEAM

    def audit(self, q: np.ndarray, who: np.ndarray) -> float:
        """Widen the beam until queries find their links: sample queries all that brute force finds but themselves,
        and vectors turned away from sample nodes as far as a link may be, these nodes."""
        some = slice(None, None, max(1, len(q) // AUDIT_QUERIES))
        q, who = q[some], who[some]
        nodes = np.arange(0, len(self.ids), max(1, len(self.ids) // AUDIT_NODES))
        aside = np.random.default_rng(11).normal(size=self.unit[nodes].shape)
        aside -= np.einsum("nd,nd->n", aside, self.unit[nodes])[:, None] * self.unit[nodes]
        length = np.sqrt(np.einsum("nd,nd->n", aside, aside))[:, None]
        turned = self.least * self.unit[nodes] + np.sqrt(max(0.0, 1 - self.least**2)) * aside / np.maximum(length, 1e-12)
        linked = (q @ self.unit.T >= self.least) & (self.ids[None, :] != who[:, None])
        while True:
            ids, sims = self.graph.search(np.concatenate([q, turned]), self.width)
            seen = np.zeros_like(linked)
            rows, cols = np.nonzero(ids[: len(q)] >= 0)
            seen[rows, ids[rows, cols]] = True
            full = sims[: len(q), -1] >= self.least  # answered exactly
            some = linked & ~full[:, None]
            own = (ids[len(q) :] == nodes[:, None]).any(1) | (sims[len(q) :, -1] >= self.least)
            recall = min(own.mean(), seen[some].mean() if some.any() else 1.0)
            if recall >= AUDIT_RECALL or self.width >= len(self.ids):
                return float(recall)
            self.width *= 2

    def answer(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query position, node position) of the verified links of a batch of queries."""
        ids, sims = self.graph.search(q, self.width)
        slack = self.least - 1e-4
        wide = (sims[:, -1] >= slack) & (len(self.ids) > self.width)
        rows, cols = np.nonzero((sims >= slack) & ~wide[:, None] & (ids >= 0))
        nodes = ids[rows, cols]
        ok = np.einsum("nd,nd->n", q[rows], self.unit[nodes]) >= self.least
        found = [(rows[ok], nodes[ok])]
        full = np.flatnonzero(wide)
        for low in range(0, len(self.ids), 8192):  # an exact answer for queries with more links than the beam
            if len(full):
                r, c = np.nonzero(q[full] @ self.unit[low : low + 8192].T >= self.least)
                found.append((full[r], c + low))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _units(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.sqrt(np.einsum("nd,nd->n", flat, flat))[:, None]


def _asked(least: float):
    """Rows sorted by (dim, shard, own first) to counts of links (kind 0) and forest links (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quiremill.llm.simhash_trie import _united

        key, shard, gathered, lowest = None, None, [], {}

        def told(kind, a, b):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"]
            )

        def built():
            ids, unit, times = (np.concatenate(x) for x in zip(*gathered))
            made = Shard(ids, unit, times, least)
            made.labels = np.arange(len(ids))
            made.audits = {True, False}
            return made

        def asked(ids, unit, own):
            for low in range(0, len(ids), BATCH):
                q, who = unit[low : low + BATCH], ids[low : low + BATCH]
                if own in shard.audits:  # the shard's own vectors first, then those of the others
                    shard.audit(q, who)
                    shard.audits.remove(own)
                rows, nodes = shard.answer(q)
                other = shard.ids[nodes] != who[rows]
                rows, nodes = rows[other], nodes[other]
                if not len(rows):
                    continue
                counts = np.bincount(rows, weights=shard.times[nodes], minlength=len(q)).astype(np.int64)
                some = counts > 0
                yield told(0, who[some], counts[some])
                # One link from each query, and the nodes that it joins: a forest says as much as all pairs.
                first = np.r_[True, rows[1:] != rows[:-1]] if (np.diff(rows) >= 0).all() else None
                if first is None:
                    order = np.argsort(rows, kind="stable")
                    rows, nodes = rows[order], nodes[order]
                    first = np.r_[True, rows[1:] != rows[:-1]]
                lead = nodes[np.flatnonzero(first)[np.cumsum(first) - 1]]
                shard.labels = _united(shard.labels, lead, nodes)
                yield told(1, who[rows[first]], shard.ids[nodes[first]])

        def closed():
            linked = shard.labels != np.arange(len(shard.labels))
            if linked.any():
                yield told(1, shard.ids[linked], shard.ids[shard.labels[linked]])

        for batch in batches:
            dims, shards = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
            cut = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1])])
            for low, high in zip(cut, np.r_[cut[1:], len(dims)]):
                part = batch.slice(int(low), int(high - low))
                now = (int(dims[low]), int(shards[low]))
                if now != key:
                    if gathered and shard is None:
                        shard = built()
                        yield from asked(shard.ids, shard.unit, True)
                    if shard is not None:
                        yield from closed()
                    key, shard, gathered = now, None, []
                own = part.column("own").to_numpy(zero_copy_only=False).astype(bool)
                ids, times = part.column("id").to_numpy(), part.column("times").to_numpy()
                unit = _units(part, now[0])
                if own.any():
                    gathered.append((ids[own], unit[own], times[own]))
                if not own.all() and gathered:
                    if shard is None:
                        shard = built()
                        yield from asked(shard.ids, shard.unit, True)
                    yield from asked(ids[~own], unit[~own], False)
        if gathered and shard is None:
            shard = built()
            yield from asked(shard.ids, shard.unit, True)
        if shard is not None:
            yield from closed()

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each row of ``vectors``: (id, n_links, component_id)."""
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(embedding).alias("embedding"))
    sound = F.expr(
        "vec_id is not null and embedding is not null and size(embedding) > 0 "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(embedding, x -> x != 0)"
    )
    base = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = base.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    nodes = written(nodes.withColumn("dim", F.size("embedding")), "vectors")
    total = nodes.count()
    shards = max(MIN_SHARDS, -(-total // SHARD_ROWS))
    dealt = nodes.select(
        "*",
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("home"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    ).withColumn("own", F.col("home") == F.col("shard"))
    dealt = dealt.select("dim", "shard", "own", "id", "times", "embedding")
    # One shard a task.
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", F.desc("own"), "id")
    told = written(dealt.mapInArrow(_asked(least), "kind int, a long, b long"), "vector-links")
    counts = told.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    groups = connected_components(told.where("kind = 1").select("a", "b"))
    known = (
        nodes.join(counts, nodes.id == counts.a, "left")
        .join(groups, nodes.id == groups.node, "left")
        .select("embedding", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    )
    linked = base.where("sound").join(known, "embedding").select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = base.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("vec_id", id_col)
