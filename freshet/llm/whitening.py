"""Whitening of integer vectors by eigenvectors of their covariance, refined from float32 in mixed precision.

Entries become integers, floor(scale * c). The fit list is each distinct vector once. Its sums are exact; its covariance is
gathered as one d x d matrix of products from each task, of vectors less the rounded mean, so that the doubles are exact sums of
integers below 2 ** 53, and the rounding of the mean is taken off at the end. Only d x d numbers, whatever the number of rows,
come to the driver, where the eigenvectors of the float32 matrix are corrected by the iteration of Ogita and Aishima
(RefSyEv) in extended precision. Eigenvalues that are too close for the current vectors form a cluster, and each
cluster's part of the shifted matrix is solved on its own before the next step.

Cases: vectors that are null or hold a null or non-finite entry take no part, nor do those with an entry beyond 2 ** 53 after scaling;
shorter vectors are zero past their end. Repeated rows each get their results, and count once in the fit list. A null id is an id like others. Components without
variance (e <= 1e-13 d times the greatest) don't exist; so one distinct vector, or an empty table, gives no rows. Equal eigenvalues: any orthonormal basis of their
space, the same for all rows. The sign makes a component's largest entry positive. A deviation beyond a long is null. Further columns stay in ``whiten``; those named
like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, packed, unpacked, write_scratch

RESULT = ("whitened", "deviation")
_LONG = np.iinfo(np.int64).max


# --- eigenvectors -------------------------------------------------------------------------------


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One step of Ogita and Aishima: better eigenvectors of ``a``, eigenvalues, which pairs are too close, size of the correction."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # so that the correction keeps the vectors orthogonal where gaps are tiny
    value = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    delta = 2 * (np.sqrt((off**2).sum()) + np.abs(value).max() * np.sqrt((r**2).sum()))
    gap = value[None, :] - value[:, None]
    close = np.abs(gap) <= delta
    e = np.where(close, r / 2, (s + value[None, :] * r) / np.where(close, 1, gap))
    return x + x @ e, value, close, float(np.abs(e).max())


def clusters(value: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Groups of two or more eigenvalues that neighbours in order tie together."""
    order = np.argsort(-value, kind="stable")
    cuts = np.flatnonzero(~close[order[:-1], order[1:]]) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def solve_cluster(a: np.ndarray, x: np.ndarray, group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The group's vectors turned to eigenvectors of the matrix, shifted by their mean eigenvalue, within their own space."""
    own = x[:, group]
    part = own.T @ (a @ own - value[group].mean() * own)
    part = (part + part.T) / 2
    size = np.abs(part).max()
    if size == 0:
        return own
    _, turn = np.linalg.eigh((part / size).astype(np.float64))
    return own @ turn[:, ::-1].astype(a.dtype)


def eigen(covariance: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, to double precision."""
    size = np.abs(covariance).max() if covariance.size else 0
    if size == 0:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    a = covariance.astype(np.longdouble) / size
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    for _ in range(steps):
        x, value, close, change = refine(a, x)
        if change < 1e-18:
            break
        for group in clusters(value, close):
            x[:, group] = solve_cluster(a, x, group, value)
    x /= np.sqrt((x**2).sum(axis=0))
    value = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    value, x = value[order], x[:, order]
    if np.abs(a @ x - x * value).max() > 1e-14 or np.abs(x.T @ x - np.eye(len(x))).max() > 1e-14:
        raise ArithmeticError("eigenvectors didn't settle")
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1, 1)
    return (value * size).astype(np.float64), x.astype(np.float64)


# --- the fit ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their exact sums, eigenvalues (falling) and eigenvectors (columns) of their covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def trace(self) -> float:
        return float(self.values.sum())

    @property
    def rank(self) -> int:
        return int((self.values > 1e-13 * self.width * max(self.values[0], 0)).sum()) if self.n > 1 else 0

    def center(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as integers and what they leave of it: S / n = whole + rest."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole, strict=True)])

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """(x - S / n) on the first k components, over the roots of their eigenvalues."""
        whole, rest = self.center()
        return ((x - whole).astype(np.float64) - rest) @ self.vectors[:, :k] / np.sqrt(self.values[:k])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) ** 2, exact; None beyond a long."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most and most**2 * self.width > _LONG:
            exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
            return [int(v) if v <= _LONG else None for v in exact]
        return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vector: str, scale: float, width: int) -> Column:
    """``width`` longs for a usable vector; null if an entry is too large."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    filled = F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(x)))
    return F.when(usable(vector) & F.forall(x, lambda c: F.abs(c) < F.lit(2**53)), filled)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def integer_rows(rows: DataFrame, vector: str, scale: float) -> tuple[DataFrame, int]:
    """(row, x) of the rows that take part, and the length of x."""
    width = rows.where(usable(vector)).agg(F.max(F.size(vector))).first()[0] or 0
    return rows.select(packed(rows), integers(vector, scale, width).alias("x")).where("x is not null"), width


def fit(distinct: DataFrame, width: int) -> Whitening:
    """Model of a fit list, a table of different vectors ``x`` of ``width`` longs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = distinct.select("x").mapInArrow(sums, "i int, n long, high long, low long").groupBy("i").agg(exact("n"), exact("high"), exact("low")).orderBy("i").collect()
    n = int(parts[0].n) if parts else 0
    total = tuple((int(p.high) << 32) + int(p.low) for p in parts)
    if n < 2:
        return Whitening(n, total, np.zeros(len(total)), np.eye(len(total)))
    whole, _ = Whitening(n, total, np.zeros(width), np.eye(width)).center()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((width, width))
        for batch in batches:
            y = (matrix(batch.column(0), width) - whole).astype(np.float64)
            own += y.T @ y
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(own))], names=["i", "p"])

    entries = distinct.select("x").mapInArrow(products, "i int, p array<double>").select("i", F.posexplode("p").alias("j", "p")).where("j >= i").groupBy("i", "j").agg(F.sum("p").alias("p"))
    gram = np.zeros((width, width), np.longdouble)
    for r in entries.collect():  # a triangle of width x width numbers
        gram[r.i, r.j] = gram[r.j, r.i] = r.p
    rest = np.array([np.longdouble(s - n * int(w)) / n for s, w in zip(total, whole, strict=True)])
    return Whitening(n, total, *eigen(gram / n - np.outer(rest, rest)))


def identity_error(distinct: DataFrame, model: Whitening, k: int) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, measured on the list."""
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(matrix(batch.column(0), model.width), k)
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(first), pa.array(list(second))], names=["i", "m", "p"])

    parts = distinct.select("x").mapInArrow(moments, "i int, m double, p array<double>").groupBy("i").agg(F.sum("m").alias("m"), *(F.sum(F.col("p")[j]).alias(f"p{j}") for j in range(k))).orderBy("i").collect()
    mean = np.array([r.m for r in parts]) / model.n  # of vectors that are centred already
    covariance = np.array([[r[f"p{j}"] for j in range(k)] for r in parts]) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", scale: float = 256.0, components: int | None = None) -> tuple[DataFrame, Whitening, float]:
    """Rows that take part with ``whitened`` (doubles, one for each of the first ``components`` that exist) and ``deviation``
    (long); the model; and the identity error of the fit list."""
    found, width = integer_rows(rows, vector, scale)
    distinct = write_scratch(found.select("x").distinct(), "vectors")
    model = fit(distinct, width)
    k = min(model.rank, width if components is None else components)
    error = identity_error(distinct, model, k)
    drop_scratch(distinct)
    schema = found.select("row", F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("bigint").alias("deviation")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            made = [pa.array(list(model.project(x, k)), pa.list_(pa.float64())), pa.array(model.deviations(x), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", *RESULT])

    out = found.mapInArrow(run, schema) if k else found.select("row", F.array().cast("array<double>").alias("whitened"), F.lit(0).cast("bigint").alias("deviation"))
    return out.select(*unpacked(rows, skip=RESULT), *RESULT), model, error
