"""Approximate nearest neighbours by cosine with balanced posting lists.

Centroids are fitted by k-means on a bounded sample of unit vectors and linked into a neighbour graph. Every vector
goes to the posting list of its nearest centroid, and, near a boundary, to those of further centroids whose
distance is within ``1 + closure`` times the nearest's. A query searches the lists whose distance is within
``1 + prune`` times the nearest's, ``max_lists`` of them at most. Both bounds grow as
far as it takes: ``held_out`` candidates that are no queries, left out of the sample, are compared with every vector, and the lists
that hold their true neighbours give the least prune and max_lists that find the share ``recall`` of them. No query takes part in the fit,
unless every candidate is one. ``cell_lists`` lists are one group of the join, and groups of over ``part_rows`` rows are dealt out in parts, so tasks stay even. Scores are exact
cosines of the original vectors in double precision. ``exact`` makes one list of all vectors, in parts, so that every
query meets every vector.

Bounds: the sample has about ``sample_rows`` rows and the graph at most ``max_centroids`` nodes; they go to the
driver and the tasks. The driver works out about 1,000,000 cosines at a time. Beyond ``list_rows * max_centroids`` vectors the lists grow with the table. Every vector is indexed. Of equal vectors the k + 1 smallest ids are kept in the lists: no
query's k nearest can hold another.

Cases: components of any finite size count (a vector is scaled by a power of two first, which changes no digit of a
cosine); vectors that are null, zero, or hold a null or non-finite component take no part; shorter vectors count as
zero past their end; rows of one id count once, by the least vector; a query never gets rows of its own id; with fewer
than k candidates all are returned; empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import list_array, write_scratch
from .topk_search import one_vector


def _vectors(lists: pa.Array, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component lies between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.maximum(_norms(x), 1e-300)[:, None]).astype(np.float32)


def _blocks(rows: int, width: int, cells: int = 1_000_000):
    """Slices of ``rows`` rows with about ``cells`` values each, of ``width`` in a row: what is worked out for all of them has bounded memory."""
    step = max(1, cells // max(1, width))
    return (slice(i, i + step) for i in range(0, rows, step))


@dataclass
class CentroidGraph:
    """Centroids on the unit sphere, each linked to its nearest others and a few random ones."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, sample: np.ndarray, n: int, degree: int = 16, rounds: int = 6, seed: int = 5) -> CentroidGraph:
        rng = np.random.default_rng(seed)
        x = np.unique(sample, axis=0)
        n = max(1, min(n, len(x)))
        centers = x[np.sort(rng.choice(len(x), n, replace=False))] if len(x) else np.zeros((1, sample.shape[1] or 1), np.float32)
        for _ in range(rounds if len(x) > n else 0):
            nearest = np.concatenate([np.argmax(x[rows] @ centers.T, axis=1) for rows in _blocks(len(x), n)])
            size = np.bincount(nearest, minlength=n)
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, x)
            full = size > 0
            centers[full] = sums[full] / np.maximum(_norms(sums[full].astype(float)), 1e-30)[:, None]
            # balance: centroids of empty or tiny lists move into the largest ones
            small, large = np.flatnonzero(size * 8 < len(x) / n), np.argsort(-size, kind="stable")
            for a, b in zip(small, large[: len(small)], strict=True):
                if size[b] > 2 * len(x) / n:
                    centers[a] = x[rng.choice(np.flatnonzero(nearest == b))]
        degree = min(degree, n - 1)
        # copies: a view would keep the order of all centroids for each of them
        near = np.concatenate([np.argsort(-(centers[rows] @ centers.T), axis=1)[:, 1 : degree + 1].copy() for rows in _blocks(n, n)]) if n > 1 else np.zeros((1, 0), np.int64)
        far = rng.integers(0, n, (n, min(4, n)))
        return cls(centers.astype(np.float32), np.hstack([near, far]).astype(np.int64), rng.choice(n, min(n, 32), replace=False))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk for all rows of q at once: (nodes, cosines), best first, -1 where none."""
        width = min(width, len(self.centroids))
        if width * self.links.shape[1] >= len(self.centroids):  # the walk would look at most of them
            cos = q @ self.centroids.T
            order = np.argsort(-cos, axis=1, kind="stable")[:, :width]
            return order, np.take_along_axis(cos, order, 1)
        rows = np.arange(len(q))[:, None]
        cos = q @ self.centroids[self.entries].T
        order = np.argsort(-cos, axis=1, kind="stable")[:, :width]
        beam, score = self.entries[order], np.take_along_axis(cos, order, 1)
        pad = width - beam.shape[1]
        beam = np.pad(beam, ((0, 0), (0, pad)), constant_values=-1)
        score = np.pad(score, ((0, 0), (0, pad)), constant_values=-np.inf)
        done = beam < 0
        for _ in range(4 * width + 16):
            pick = np.argmax(~done, axis=1)[:, None]  # the beam is sorted: the first open node is the best
            if done[rows, pick].all():
                break
            live = ~done[rows, pick][:, 0]
            done[rows, pick] = True
            next_ = self.links[np.maximum(beam[rows, pick][:, 0], 0)]
            s = np.einsum("ijk,ik->ij", self.centroids[next_], q)
            known = (next_[:, :, None] == beam[:, None, :]).any(2) | ~live[:, None]
            for j in range(1, next_.shape[1]):
                known[:, j] |= (next_[:, :j] == next_[:, j : j + 1]).any(1)
            s = np.where(known, -np.inf, s)
            every, value, closed = np.hstack([beam, np.where(known, -1, next_)]), np.hstack([score, s]), np.hstack([done, known])
            order = np.argsort(-value, axis=1, kind="stable")[:, :width]
            beam, score, done = (np.take_along_axis(x, order, 1) for x in (every, value, closed))
        return beam, score


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def _kept(nodes: np.ndarray, cos: np.ndarray, ratio: float, least: int, most: int) -> np.ndarray:
    """Which of the nearest centroids' lists are taken."""
    dist = _distance(cos)
    keep = (nodes >= 0) & ((dist <= dist[:, :1] * (1 + ratio) + 1e-6) | (np.arange(nodes.shape[1]) < least))
    keep[:, most:] = False
    return keep


def true_neighbours(kept: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> list:
    """Rows (query, v): vectors of the k nearest in ``kept`` for each of a few queries, none of its own id."""
    width = vectors.shape[1]
    shared = kept.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches):
        own, q = shared.value
        best, at = np.full((len(q), k), -np.inf, np.float32), np.zeros((len(q), k), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                found = part.column(0).to_numpy()
                cos = q @ _unit(_vectors(part.column(1), width)).T
                cos[own[:, None] == found[None, :]] = -np.inf
                every = np.hstack([best, cos])
                names = np.hstack([at, np.broadcast_to(found, cos.shape)])
                pick = np.argpartition(-every, k - 1, axis=1)[:, :k]
                best, at = np.take_along_axis(every, pick, 1), np.take_along_axis(names, pick, 1)
        some = best > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(some)[0]), pa.array(at[some]), pa.array(best[some].astype(float))], names=["query", "id", "score"])

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    top = kept.select("id", "v").mapInArrow(run, "query long, id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(kept.select("id", "v"), "id").select("query", "v").collect()  # k for each of the few queries


def bounds_for_recall(graph: CentroidGraph, queries: np.ndarray, query: np.ndarray, neighbours: np.ndarray, postings: tuple[int, float, int], prune: float, least: int, most: int, recall: float) -> tuple[float, int]:
    """The prune and max_lists, no less than given, that reach a list of the share ``recall`` of the neighbours."""
    n = len(graph.centroids)
    if not len(query) or n <= least:
        return prune, most
    beam, ratio, replicas = postings
    nodes, near = graph.search(neighbours, beam)
    held = _kept(nodes, near, ratio, 1, replicas)
    rank, need = np.zeros(len(query), np.int64), np.zeros(len(query), np.float32)
    for rows in _blocks(len(queries), n):
        cos = queries[rows] @ graph.centroids.T
        order = np.argsort(-cos, axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        dist = np.take_along_axis(_distance(cos), order, 1)
        some = np.flatnonzero((query >= rows.start) & (query < rows.stop))
        own = query[some] - rows.start
        rank[some] = np.where(held[some], place[own[:, None], np.maximum(nodes[some], 0)], n).min(1)  # of the nearest list with the neighbour
        need[some] = np.where(rank[some] < least, 0, dist[own, np.minimum(rank[some], n - 1)] / np.maximum(dist[own, 0], 1e-9) - 1)
    spare = (1 + recall) / 2  # each bound takes half of what may be lost
    quantile = lambda x: np.sort(x)[min(len(x), int(np.ceil(spare * len(x)))) - 1]
    return max(prune, float(quantile(need)) + 1e-6), max(most, int(quantile(rank)) + 1)


def _lists(rows: DataFrame, shared, width: int, beam: int, ratio: float, least: int, most: int) -> DataFrame:
    """(id, v, list) of each vector for its nearest centroid and those within the distance ratio."""

    def run(batches):
        graph = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                nodes, cos = graph.search(_unit(_vectors(part.column(1), width)), beam)
                keep = _kept(nodes, cos, ratio, least, most)
                at = np.repeat(np.arange(len(nodes)), keep.sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(nodes[keep])], names=["id", "v", "list"])

    return rows.mapInArrow(run, "id long, v array<double>, list long")


def _probes(rows: DataFrame, shared, width: int, ratio: float, least: int, most: int, cell_lists: int) -> DataFrame:
    """(id, v, cell, lists) of each query for each cell of ``cell_lists`` lists in which it searches some."""

    def run(batches):
        graph = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                nodes, cos = graph.search(_unit(_vectors(part.column(1), width)), most)
                row, at = np.nonzero(_kept(nodes, cos, ratio, least, most))
                node = nodes[row, at]
                order = np.lexsort((node, row))
                row, node = row[order], node[order]
                cell = node // cell_lists
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
                heads = np.flatnonzero(new)
                sizes = np.diff(np.concatenate([heads, [len(row)]]))
                own = pa.array(row[heads])
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(cell[heads]), list_array(node, sizes, pa.int64())], names=["id", "v", "cell", "lists"])

    return rows.mapInArrow(run, "id long, v array<double>, cell long, lists array<long>")


def nearest(candidates: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", list_rows: int = 64, part_rows: int = 4096, sample_rows: int = 32_768, max_centroids: int = 16_384, cell_lists: int = 32, closure: float = 0.1, replicas: int = 4, prune: float = 0.1, min_lists: int = 1, max_lists: int = 8, recall: float = 0.98, held_out: int = 256, exact: bool = False, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest candidates found for each query."""
    valid = lambda rows: one_vector(rows, key, vector).where(F.exists("v", lambda x: x != 0))
    rows, wanted = valid(candidates), valid(queries)
    equal = W.partitionBy("v").orderBy("id")
    kept = write_scratch(rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1), "vectors")
    info = kept.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    width = max(1, info["d"] or 0, wanted.agg(F.max(F.size("v"))).first()[0] or 0)
    share = min(1.0, sample_rows / max(1, info["n"]))
    single = kept.where("copy = 1")
    others = single.join(wanted.select("id"), "id", "left_anti")
    free = others if others.limit(1).count() else single
    taken = free.where(F.xxhash64("id", F.lit(seed)) <= F.lit(int((2 * share - 1) * (2**63 - 1024))))
    unit = lambda found: _unit(_vectors(pa.array([r["v"] for r in found], pa.list_(pa.float64())), width))

    def units(batches):
        for batch in batches:
            x = _unit(_vectors(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], names=["unit"])

    tried = free.select("id", "v").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(held_out).collect()
    tried_ids, tried_v = np.array([r["id"] for r in tried], np.int64), unit(tried)
    sample = taken.where(~F.col("id").isin(tried_ids.tolist())).select("v").mapInArrow(units, "unit binary").toArrow().column(0)
    sample = np.frombuffer(b"".join(x.as_py() for x in sample), np.float32).reshape(-1, width)
    graph = CentroidGraph.build(sample, 1 if exact else min(max_centroids, max(1, info["n"] // list_rows)), seed=seed)
    shared = kept.sparkSession.sparkContext.broadcast(graph)
    if len(tried) and len(graph.centroids) > min_lists:
        true = true_neighbours(kept, tried_ids, tried_v, k)
        prune, max_lists = bounds_for_recall(graph, tried_v, np.array([r["query"] for r in true], np.int64), unit(true), (16, closure, replicas), prune, min_lists, max_lists, recall)
    postings = write_scratch(_lists(kept.select("id", "v"), shared, width, 16, closure, 1, replicas), "postings")
    probes = _probes(wanted.select("id", "v"), shared, width, prune, min_lists, max_lists, cell_lists)
    # neighbouring numbers of lists are one cell; a cell's rows lie in parts of about part_rows, its queries go to each part
    cells = postings.withColumn("cell", F.floor(F.col("list") / cell_lists))
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
    left = cells.join(parts, "cell").select("id", "v", "list", "cell", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    right = probes.join(parts, "cell").select("id", "v", "lists", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if a.num_rows and b.num_rows:
            order = np.argsort(a.column("list").to_numpy(), kind="stable")
            lists, ids = a.column("list").to_numpy()[order], a.column("id").to_numpy()[order]
            x = _scaled(_vectors(a.column("v"), width))[order]
            norm = _norms(x)
            names, rows = np.unique(lists, return_index=True)
            held = dict(zip(names.tolist(), np.split(np.arange(len(ids)), rows[1:]), strict=True))
            for own, q, wanted_lists in zip(b.column("id").to_numpy(), _scaled(_vectors(b.column("v"), width)), b.column("lists").to_pylist(), strict=True):
                some = [held[n] for n in wanted_lists if n in held]
                if not some:
                    continue
                rows = np.concatenate(some)
                _, once = np.unique(ids[rows], return_index=True)  # a vector may lie in several lists
                rows = rows[once]
                rows = rows[ids[rows] != own]
                score = (x[rows] * q).sum(axis=1) / (norm[rows] * np.sqrt((q * q).sum()))
                best = np.arange(len(rows))
                if len(score) > k:
                    best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    best = best[np.lexsort((ids[rows[best]], -score[best]))][:k]
                out[0].append(np.full(len(best), own))
                out[1].append(ids[rows[best]])
                out[2].append(score[best])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(run, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
