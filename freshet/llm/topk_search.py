"""Exact top-k inner products with Fagin's threshold algorithm.

Components become integers, floor(scale * x). Candidates are dealt into blocks by a hash of their id, queries
into blocks of their own, and every pair of blocks is one group. Inside it each dimension has its list of
candidates sorted by value. For a query the lists are read in step from the end that helps it, new candidates are
scored in full, and reading stops once the bound, the query's product with the values at the current
depths, is below the k-th score (an equal bound goes on, for ties), or nothing unseen is worth another step of
reading. Blocks' results are merged by score, then
smaller id.

This is a stated query set against all rows, so its work is their product; a group holds one block of
each, whatever the input's size.

Cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as zero
past their end; rows of one id count once, by the least vector; a query never gets rows of its own id; with
fewer than k candidates all are returned; empty tables give empty tables. Components whose products need not fit a long are an
error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import write_scratch

BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def one_vector(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v: doubles): usable vectors, one for each id."""
    usable = rows.where(F.col(key).isNotNull() & finite(vector)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return usable.groupBy("id").agg(F.min("v").alias("v"))


class SortedLists:
    """A block of candidates and, for each dimension, their order by value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids)  # by id, so that a stable sort by score keeps smaller ids first
        self.ids, self.values = ids[order], values[order]
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best candidates other than ``own``."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.ids == own
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.values.dtype)
        depth, step = 0, 4
        while depth < n:
            end = min(n, depth + step)
            unseen = n - int(np.count_nonzero(seen))
            if unseen <= (end - depth) * (len(up) + len(down)) // 8 or not len(up) + len(down):
                # few are left, against what the next step reads: score them all, which ends the search
                fresh, end = np.flatnonzero(~seen), n
            else:
                new = np.zeros(n, bool)
                new[self.order[n - end : n - depth, up]] = True
                new[self.order[depth:end, down]] = True
                fresh = np.flatnonzero(new & ~seen)
            seen[fresh] = True
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, self.values[fresh] @ q])
            if len(rows) > 2 * k:  # all that reach the k-th score, ties included
                reach = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[reach], scores[reach]
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            depth, step = end, step * 2
            if len(rows) == k and depth < n:
                bound = self.sorted[n - depth, up] @ q[up] + self.sorted[depth - 1, down] @ q[down]
                if bound < scores[-1]:
                    break
        return rows, scores


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def top_inner_products(candidates: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query's k highest integer inner products."""
    as_int = lambda rows: one_vector(rows, key, vector).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))
    c, q = write_scratch(as_int(candidates), "vectors"), write_scratch(as_int(queries), "queries")
    largest = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))))
    shape = [F.count("*").alias("n"), F.max(F.size("v")).alias("d"), largest.alias("most")]
    sizes, n_q = c.agg(*shape).first(), q.agg(*shape).first()
    width = max(1, sizes["d"] or 0, n_q["d"] or 0)
    if width * (sizes["most"] or 0) * (n_q["most"] or 0) >= 2**63:
        raise ValueError("scores of these components need not fit a long; use a smaller scale")
    c_blocks, q_blocks = max(1, -(-sizes["n"] // BLOCK_ROWS)), max(1, -(-n_q["n"] // BLOCK_QUERIES))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = c.select("id", "v", block(c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    right = q.select("id", "v", every(c_blocks).alias("cb"), block(q_blocks).alias("qb"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if a.num_rows and b.num_rows:
            values, wanted = _matrix(a, width), _matrix(b, width)
            if width * float(np.abs(values).max()) * float(np.abs(wanted).max()) < 2**53:  # exact, and faster, as doubles
                values, wanted = values.astype(np.float64), wanted.astype(np.float64)
            lists = SortedLists(a.column("id").to_numpy(), values)
            for own, vec in zip(b.column("id").to_numpy(), wanted, strict=True):
                rows, scores = lists.top(vec, own, k)
                out[0].append(np.full(len(rows), own))
                out[1].append(lists.ids[rows])
                out[2].append(scores.astype(np.int64))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"query_id": flat[0].astype(np.int64), "vec_id": flat[1].astype(np.int64), "score": flat[2]})

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
