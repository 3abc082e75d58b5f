"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, every shard asked, pairs verified, components joined.

Equal vectors are one class. The classes of a label are dealt to shards by hash, and each shard's graph is built in one task,
where every node has to find itself. Then each pair of a label's shards meets in one task, which asks either graph with the
other's vectors, so that a pair counts for both its ends, whichever found it. Each such search is audited by brute force on
sampled vectors; the beam is widened until the audit passes or wider beams find no more. What lies near is followed along the graph, so that a group
larger than the beam is found whole. Searches are in single precision, verified in double. What leaves a task is a count per
vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import cut, join_small
from .components import components
from .search import valid

#: Rows of a shard, about.
SHARD_ROWS = 16_384
#: Neighbours of a node (twice as many in the lowest layer); beams while building, at first when asking and at most; vectors that an audit samples and the recall of their links that it asks for.
M, BUILD_BEAM, BEAM, WIDEST, AUDIT, RECALL = 12, 24, 16, 256, 256, 0.995
_EXPAND, _LOCKSTEP = 4, 256
#: What single precision may lack; such pairs are left to the verification. By how much less than a link's cosine a node may have that is followed.
SLACK, FOLLOWED = 1e-5, 0.03


class Graph:
    """Each node's neighbours (-1 for none) in each layer, from the lowest. A layer's nodes are the first rows of vectors; upper layers have fewer."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]) -> None:
        self.vectors, self.layers = vectors, layers
        self.fast = vectors.astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 5) -> Graph:
        """vectors: unit rows, in any order that has nothing to do with what they are like. The layers are filled from the top, each from the nodes of the one above it on."""
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / np.log(M)).astype(int)
        graph = cls(vectors, [])
        for lev in range(int(level.max(initial=0)), -1, -1):
            n = int((level >= lev).sum())
            graph.layers.insert(0, np.full((n, M if lev else 2 * M), -1, np.int32))
            done = min(n, 2 * M)
            graph._connect(np.arange(done), None)
            while done < n:
                batch = np.arange(done, min(n, done + min(done, _LOCKSTEP)))
                graph._connect(batch, graph._search(graph.fast[batch], 0, BUILD_BEAM, done)[0])
                done = int(batch[-1]) + 1
        graph._mend()
        return graph

    def lost(self) -> np.ndarray:
        """Nodes that a search for them doesn't find."""
        every = np.arange(len(self.vectors))
        return np.concatenate([[], *(part[~(self._search(self.fast[part], 0, BEAM)[0] == part[:, None]).any(axis=1)] for part in np.split(every, every[_LOCKSTEP::_LOCKSTEP]))]).astype(int)

    def _mend(self, rounds: int = 4) -> None:
        """Let the nearest nodes that a search finds, which is where it ends, lead to a node that it doesn't find."""
        near = self.layers[0]
        for k in range(rounds):
            lost = self.lost()
            if not len(lost):
                return
            for part in np.split(lost, np.arange(_LOCKSTEP, len(lost), _LOCKSTEP)):
                ends = self._search(self.fast[part], 0, BEAM)[0]
                for node, row in zip(part.tolist(), ends.tolist(), strict=True):
                    for end in [x for x in row if x >= 0][: 1 + k]:
                        near[end, int(np.argmin(near[end] >= 0)) if (near[end] < 0).any() else near.shape[1] - 1 - node % 4] = node

    def _connect(self, batch: np.ndarray, found: np.ndarray | None) -> None:
        """Link new nodes of the lowest layer to the diverse nearest of those found and of the batch, both ways."""
        near = self.layers[0]
        x = self.fast[batch]
        own = x @ x.T
        np.fill_diagonal(own, -2)
        few = min(len(batch), BUILD_BEAM // 2)
        inside = batch[np.argsort(-own, axis=1, kind="stable")[:, :few]]
        inside[np.take_along_axis(own, inside - batch[0], axis=1) < -1] = -1
        pool = inside if found is None else np.concatenate([found, inside], axis=1)
        chosen = self._diverse(x, pool, near.shape[1] // 2 if len(self.layers) and near.shape[1] == 2 * M else near.shape[1])
        near[batch, : chosen.shape[1]] = chosen
        width = near.shape[1]
        at, to = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        at, to = at[to >= 0], to[to >= 0]
        known = (near[to] == at[:, None]).any(axis=1)
        order = np.argsort(to[~known], kind="stable")
        at, to = at[~known][order], to[~known][order]
        slot = (near[to] >= 0).sum(axis=1) + np.arange(len(to)) - np.searchsorted(to, to)
        fits = slot < width
        near[to[fits], slot[fits]] = at[fits]
        at, to, slot = at[~fits], to[~fits], slot[~fits] - width
        full = np.unique(to)
        for a in range(0, len(full), _LOCKSTEP):
            part = full[a : a + _LOCKSTEP]
            some = slice(np.searchsorted(to, part[0]), np.searchsorted(to, part[-1], "right"))
            more = np.full((len(part), int(slot[some].max()) + 1), -1)
            more[np.searchsorted(part, to[some]), slot[some]] = at[some]
            near[part] = self._diverse(self.fast[part], np.concatenate([near[part], more], axis=1), width)

    def _diverse(self, x: np.ndarray, pool: np.ndarray, most: int) -> np.ndarray:
        """Of each row's pool, by falling similarity: those nearer to x than to any chosen before; then the nearest of the rest."""
        v = self.fast[pool]
        sims = np.where(pool >= 0, np.einsum("bd,bpd->bp", x, v), -2.0)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(BUILD_BEAM, most)]
        pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        between = v @ v.transpose(0, 2, 1)
        closest, rank, kept = np.full(pool.shape, -2.0), np.full(pool.shape, 2 * pool.shape[1]), np.zeros(len(pool), int)
        for k in range(pool.shape[1]):
            good = (sims[:, k] > closest[:, k]) & (kept < most) & (sims[:, k] > -2)
            rank[good, k] = k
            kept += good
            closest = np.where(good[:, None], np.maximum(closest, between[:, k, :]), closest)
        rank = np.where((rank > pool.shape[1]) & (sims > -2), pool.shape[1] + np.arange(pool.shape[1]), rank)
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(rank, best, 1) < 2 * pool.shape[1], np.take_along_axis(pool, best, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out

    def _search(self, q: np.ndarray, layer: int, beam: int, done: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of each query's beam, the nearest first, all queries in lockstep. done: nodes of the layer that are linked already."""
        near = self.layers[layer]
        if layer + 1 < len(self.layers):
            start = np.maximum(self._search(q, layer + 1, 2)[0], 0)
            start = start if done is None else start % done
        else:
            start = np.zeros((len(q), 1), int)
        held, sims, open_ = np.full((len(q), beam), -1), np.full((len(q), beam), -2.0, np.float32), np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), len(near) + 1), bool)
        rows = np.arange(len(q))[:, None]
        seen[:, -1] = True
        for j in range(start.shape[1]):
            fresh = ~seen[rows[:, 0], start[:, j]]
            held[fresh, j], open_[fresh, j] = start[fresh, j], True
            sims[fresh, j] = np.einsum("bd,bd->b", q[fresh], self.fast[start[fresh, j]])
            seen[rows[:, 0], start[:, j]] = True
        live = np.arange(len(q))
        while len(live):
            s, o, h = sims[live], open_[live], held[live]
            best = np.argsort(-np.where(o, s, -3.0), axis=1)[:, :_EXPAND]
            use = np.take_along_axis(o, best, 1)
            more = use.any(axis=1)
            live, s, o, h, best, use = live[more], s[more], o[more], h[more], best[more], use[more]
            if not len(live):
                break
            r = np.arange(len(live))[:, None]
            o[r, best] = False
            nodes = np.where(use[:, :, None], near[np.where(use, h[r, best], 0)], -1).reshape(len(live), -1)
            nodes[seen[live[:, None], nodes]] = -1
            nodes = -np.sort(-nodes, axis=1)  # the unseen first: as many columns are compared as a query has of them
            nodes = nodes[:, : max(1, int((nodes >= 0).sum(axis=1).max()))]
            nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
            seen[live[:, None], nodes] = True
            new = nodes >= 0
            found = np.where(new, (self.fast[nodes] @ q[live][:, :, None])[:, :, 0], np.float32(-2.0))
            s, o, h = np.concatenate([s, found], 1), np.concatenate([o, new], 1), np.concatenate([h, nodes], 1)
            order = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            sims[live], open_[live], held[live] = np.take_along_axis(s, order, 1), np.take_along_axis(o, order, 1), np.take_along_axis(h, order, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        held, sims = np.take_along_axis(held, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -2, held, -1), sims

    def near(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of each query (unit rows), its number and the nodes found with cosine >= least: those of the beam, and what can be reached from them through nodes about as near."""
        fast, edges, n = q.astype(np.float32), self.layers[0], len(self.vectors)
        for a in range(0, len(q), _LOCKSTEP):
            part = fast[a : a + _LOCKSTEP]
            held, sims = self._search(part, 0, min(beam, n))
            seen = np.zeros((len(part), n + 1), bool)
            seen[np.arange(len(part))[:, None], held] = True
            seen[:, -1] = True
            rows, at = np.nonzero(sims >= least - FOLLOWED)
            nodes = held[rows, at]
            hits = [(rows[ok], nodes[ok]) for ok in [sims[rows, at] >= least - SLACK]]
            while len(rows):
                out_rows, out_nodes = [], []
                for c in range(0, len(rows), 4096):
                    to = edges[nodes[c : c + 4096]]
                    of = np.repeat(rows[c : c + 4096], to.shape[1])
                    to = to.ravel()
                    fresh = ~seen[of, to]
                    pairs = np.unique(of[fresh] * (n + 1) + to[fresh])
                    of, to = pairs // (n + 1), pairs % (n + 1)
                    seen[of, to] = True
                    sim = np.einsum("ij,ij->i", part[of], self.fast[to])
                    ok, hit = sim >= least - FOLLOWED, sim >= least - SLACK
                    out_rows.append(of[ok])
                    out_nodes.append(to[ok])
                    hits.append((of[hit], to[hit]))
                rows, nodes = np.concatenate(out_rows), np.concatenate(out_nodes)
            rows, nodes = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(rows, kind="stable")
            for i, found in zip(range(a, a + len(part)), np.split(nodes[order], np.searchsorted(rows[order], np.arange(1, len(part)))), strict=True):
                yield i, found[self.vectors[found] @ q[i] >= least]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{f"n{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        x = np.load(io.BytesIO(data))
        return cls(x["vectors"], [x[f"n{k}"] for k in range(len(x.files) - 1)])


class Pairs:
    """Which row of a and which of b are linked, a bit each. Of one shard with itself, both ways and without its diagonal."""

    def __init__(self, a: Graph, b: Graph) -> None:
        self.a, self.b = a, b
        self.bits = np.zeros((len(a.vectors), -(-len(b.vectors) // 8)), np.uint8)

    def add(self, least: float, beam: int) -> None:
        """Ask b with all rows of a, and a with all rows of b."""
        for i, found in self.b.near(self.a.vectors, least, beam):
            np.bitwise_or.at(self.bits[i], found >> 3, (1 << (found & 7)).astype(np.uint8))
            if self.a is self.b:
                self.bits[found, i >> 3] |= 1 << (i & 7)
        for j, found in self.a.near(self.b.vectors, least, beam) if self.a is not self.b else ():
            self.bits[found, j >> 3] |= 1 << (j & 7)
        if self.a is self.b:
            every = np.arange(len(self.bits))
            self.bits[every, every >> 3] &= ~(1 << (every & 7)).astype(np.uint8)

    def rows(self, some: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.bits[some], axis=1, count=len(self.b.vectors), bitorder="little").astype(bool)

    def audit(self, least: float) -> tuple[int, int]:
        """(found, links) of sampled rows of a, against brute force."""
        some = np.random.default_rng(3).permutation(len(self.a.vectors))[:AUDIT]
        truth = self.a.vectors[some] @ self.b.vectors.T >= least
        if self.a is self.b:
            truth[np.arange(len(some)), some] = False
        return int((truth & self.rows(some)).sum()), int(truth.sum())

    def found(self, least: float) -> tuple[int, int]:
        """Search with wider beams, until the audit passes or a beam twice as wide finds nothing more; the last audit's result."""
        beam, before = BEAM, -1
        while True:
            self.add(least, beam)
            hits, links = self.audit(least)
            if hits >= RECALL * links or beam >= WIDEST or hits == before:
                return hits, links
            beam, before = 2 * beam, hits

    def summed(self, counts_a: np.ndarray, counts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """For each row of a and of b the rows linked with it, by their counts; and a forest of all links over a's rows and, after them, b's (the same ones if they are one shard)."""
        n, shift = len(self.bits), 0 if self.a is self.b else len(self.bits)
        of_a, of_b, top = np.zeros(n, np.int64), np.zeros(len(counts_b), np.int64), np.arange(shift + len(counts_b))
        forest: list[tuple[int, int]] = []
        for k in range(0, n, _LOCKSTEP):
            some = np.arange(k, min(n, k + _LOCKSTEP))
            here = self.rows(some)
            of_a[some] = here @ counts_b
            of_b += counts_a[some] @ here
            for i in np.flatnonzero(here.any(axis=1)):
                nodes = np.append(np.flatnonzero(here[i]) + shift, k + i)
                while (top[top[nodes]] != top[nodes]).any():
                    top[nodes] = top[top[nodes]]
                trees = np.unique(top[nodes])
                forest += [(x, int(trees[0])) for x in trees[1:].tolist()]
                top[trees] = top[nodes] = trees[0]
        return of_a, of_b, forest


def _units(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors (vec_id, embedding, label) to vec_id, n_links, component_id, kept and recall, a row for each row.

    Rows link if their labels are equal and not null and the cosine is at least `least`. Rows with a null id or label, and
    vectors that are null, empty, zero or not finite link with nothing: 0 links, their own component. Vectors of unlike
    lengths don't link. Repeated rows are vectors of their own with one id. kept: vec_id is the component's least. recall: the
    least share of sampled links that an audit of a search with the row's shard found; null where the row takes no part. Extra columns are left out.
    """
    usable = valid("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.when(usable, F.col("embedding").cast("array<double>")).alias("embedding"))
    classes = cut(rows.filter("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    sizes = cut(sizes.select("label", "dim", F.ceil(F.col("n") / shard_rows).alias("shards")), "sizes")
    dealt = join_small(classes.withColumn("dim", F.size("embedding")), sizes, ["label", "dim"], "inner")
    label = classes.schema["label"].dataType.simpleString()

    def build(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("rep")
        x = x.iloc[np.random.default_rng(7).permutation(len(x))]
        graph = Graph.build(_units(x["embedding"]))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "graph": [graph.to_bytes()], "reps": [x["rep"].to_numpy().tobytes()], "counts": [x["copies"].to_numpy().tobytes()]})

    in_shard = dealt.withColumn("shard", F.pmod(F.xxhash64("rep"), "shards")).select("label", "dim", "shard", "rep", "copies", "embedding")
    graphs = cut(in_shard.groupBy("label", "dim", "shard").applyInPandas(build, f"label {label}, dim int, shard long, graph binary, reps binary, counts binary"), "graphs")

    # each pair of shards of a label is a task's work: first x's graph, then, unless it is the same one, y's
    both = graphs.select("label", "dim", "shard").join(sizes.select("label", "dim", "shards"), ["label", "dim"])
    first = both.select("label", "dim", "shard", F.explode(F.expr("sequence(shard, shards - 1)")).alias("y")).withColumn("x", F.col("shard"))
    second = both.filter("shard > 0").select("label", "dim", "shard", F.explode(F.expr("sequence(0L, shard - 1)")).alias("x")).withColumn("y", F.col("shard"))
    tiles = join_small(graphs, cut(first.unionByName(second), "tiles"), ["label", "dim", "shard"], "inner").select("label", "dim", "x", "y", "shard", "graph", "reps", "counts")
    tiles = tiles.repartition("label", "dim", "x", "y").sortWithinPartitions("label", "dim", "x", "y", "shard")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for _, shards in groupby(rows, lambda r: r[:4]):
            loaded = [(Graph.from_bytes(r[5]), np.frombuffer(r[6], np.int64), np.frombuffer(r[7], np.int64)) for r in shards]
            (a, reps_a, counts_a), (b, reps_b, counts_b) = loaded[0], loaded[-1]
            pairs = Pairs(a, b)
            hits, links = pairs.found(least)
            of_a, of_b, forest = pairs.summed(counts_a, counts_b)
            reps, counts = (reps_a, of_a) if a is b else (np.concatenate([reps_a, reps_b]), np.concatenate([of_a, of_b]))
            x, y = np.array(forest, np.int64).reshape(-1, 2).T
            n = len(reps) + len(x)
            values = np.concatenate([reps, reps[x]]), pa.array(np.concatenate([reps, reps[y]]), mask=np.arange(n) < len(reps)), np.concatenate([counts, np.zeros(len(x), np.int64)]), np.full(n, hits / links if links else 1.0)
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], ["a", "b", "links", "recall"])

    answers = cut(tiles.mapInArrow(ask, "a long, b long, links long, recall double"), "answers")
    joined = components(answers.filter("b is not null").select("a", "b"))
    counts = answers.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"), F.min("recall").alias("recall"))
    known = classes.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = cut(known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "recall"), "known")
    out = rows.join(known, ["label", "embedding"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), "recall").withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
