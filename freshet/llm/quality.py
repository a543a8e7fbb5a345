"""Quality classifier: statistics of a text, random Fourier features, ridge, isotonic calibration.

The statistics of a document come from its text alone. Random Fourier features approximate a Gaussian
kernel over the standardized statistics; each partition sums its share of the normal equations, the
driver solves the ridge system, and pooled-adjacent-violators turns
out-of-fold scores into probabilities.

Bounds: about ``max_train_rows`` labelled rows train at most (chosen by a hash of doc_id). Partitions' sums are
added row by row of the matrix in Spark, so what reaches the driver is one matrix for each fold, whatever the
input. Everything else covers all rows.

Cases: a null or empty text has all-zero statistics and gets a score as any other; labels that are null
don't train, several labels of one document count by their mean; with no usable label at all every score is
0.5; null doc_ids are scored but never train; an empty table gives an empty table. Repeated rows are each
scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_slices, list_array, mix64, mix_pair, packed, text_buffers, unpacked, word_hashes

TRAIN_PARTITIONS = 16
FOLDS = 3
_CLASSES = {"upper": [(65, 91)], "lower": [(97, 123)], "digit": [(48, 58)], "high": [(128, 256)], "space": [(32, 33)], "line": [(10, 11)], "stop": [(46, 47), (63, 64)], "comma": [(44, 45), (59, 60)], "bang": [(33, 34)], "bar": [(124, 125)], "symbol": [(35, 39), (42, 44), (60, 63), (64, 65), (91, 97), (123, 124), (125, 127)], "quote": [(34, 35), (39, 42), (45, 46), (47, 48), (58, 59)]}
_BAND = np.full(256, len(_CLASSES), np.uint8)
for _k, _spans in enumerate(_CLASSES.values()):
    for _a, _b in _spans:
        _BAND[_a:_b] = _k
_N_BANDS = len(_CLASSES) + 1
N_FEATURES = _N_BANDS + 12


def _per_doc(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values by document; firsts has n + 1 indexes."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by document, and the count of the most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate([at, [len(d)]]))
    most = np.zeros(n)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=n).astype(float), most


def text_statistics(texts: pa.Array) -> np.ndarray:
    """(texts, N_FEATURES) float64: shares of byte classes, word, sentence and line shapes, repetition."""
    data, offsets = text_buffers(texts)
    n = len(offsets) - 1
    if not n:
        return np.zeros((0, N_FEATURES))
    size = np.diff(offsets).astype(float)
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    bands = np.bincount(doc_of_byte * _N_BANDS + _BAND[data], minlength=n * _N_BANDS).reshape(n, _N_BANDS)
    out = np.zeros((n, N_FEATURES))
    safe = np.maximum(size, 1)
    out[:, :_N_BANDS] = np.sqrt(bands / safe[:, None])
    words, starts, ends, firsts = word_hashes(data, offsets)
    n_words = np.diff(firsts).astype(float)
    length = (ends - starts).astype(float)
    doc_w = np.repeat(np.arange(n), np.diff(firsts))
    w1 = np.maximum(n_words, 1)
    mean = _per_doc(length, firsts) / w1
    k = _N_BANDS
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(n_words)
    out[:, k + 2] = np.log1p(mean)
    out[:, k + 3] = np.sqrt(np.maximum(_per_doc(length**2, firsts) / w1 - mean**2, 0))
    distinct, most = _distinct(doc_w, words, n)
    out[:, k + 4] = distinct / w1
    out[:, k + 5] = most / w1
    if len(words) > 3:
        grams = mix_pair(mix_pair(words[:-2], words[1:-1]), words[2:])
        same = doc_w[2:] == doc_w[:-2]
        grams, doc_g = grams[same], doc_w[2:][same]
        g, top = _distinct(doc_g, grams, n)
        total = np.maximum(np.bincount(doc_g, minlength=n), 1)
        out[:, k + 6], out[:, k + 7] = g / total, top / total
    # lines: hashes by the sums of their words' hashes
    if len(words):
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        line = newline[starts] + doc_w  # a document begins a line
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        at = np.flatnonzero(new)
        sums = mix64(np.add.reduceat(mix64(words) * np.uint64(3), at))
        doc_l = doc_w[at]
        lines, top = _distinct(doc_l, sums, n)
        count = np.maximum(np.bincount(doc_l, minlength=n), 1)
        out[:, k + 8], out[:, k + 9], out[:, k + 10] = lines / count, np.log1p(n_words / count), top / count
    sentences = bands[:, list(_CLASSES).index("stop")]
    out[:, k + 11] = np.log1p(n_words / np.maximum(sentences, 1))
    out[size == 0] = 0
    return out


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<double>) of every row, in one scan without a shuffle."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, "text"):
                stats = text_statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(stats.ravel(), np.full(len(stats), N_FEATURES), pa.float64())], names=["key", "stats"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[key]
    return rows.mapInArrow(run, f"key {kind}, stats array<double>").withColumnRenamed("key", key)


@dataclass
class QualityModel:
    """Fixed-size model; small enough for a task's closure (N_FEATURES x features doubles)."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability; inside a level, a thousandth of it keeps the raw order."""
        raw = self.raw(stats)
        if not len(self.knots):
            return np.full(len(raw), 0.5)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30))), 0, 1)


def pooled_adjacent_violators(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means of y by ascending x: the middles of the pooled blocks and their levels."""
    blocks: list[list[float]] = []  # level, weight, weighted x
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([b, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            level, weight, wx = blocks.pop()
            p = blocks[-1]
            p[0] = (p[0] * p[1] + level * weight) / (p[1] + weight)
            p[1] += weight
            p[2] += wx
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def _chosen(h: Column, wanted: int, total: int) -> Column:
    """Whether a row with hash h is among the about ``wanted`` of ``total`` rows with the smallest hashes of it."""
    return F.xxhash64(h) <= F.lit(int((2 * wanted / total - 1) * (2**63 - 1024)))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", n_features: int = 192, gamma: float = 0.02, ridge: float = 3.0, max_train_rows: int = 200_000, seed: int = 11) -> QualityModel:
    """Fit on the rows of ``stats`` (key, stats) that ``labels`` (key, label 0/1) marks."""
    truth = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = stats.join(truth, key).select(F.xxhash64(key).alias("h"), "stats", "y")
    total = rows.count()
    if total > max_train_rows:
        rows = rows.where(_chosen(F.col("h"), max_train_rows, total))
    rows = rows.repartition(TRAIN_PARTITIONS, "h").persist()
    rng = np.random.default_rng(seed)
    moments = rows.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("k").collect()
    mean, scale = (np.array([r[c] for r in moments]) if moments else np.full(N_FEATURES, float(c == "s")) for c in ("m", "s"))
    directions = rng.normal(0, np.sqrt(2 * gamma), (N_FEATURES, n_features))
    model = QualityModel(mean, np.maximum(np.nan_to_num(scale), 1e-6), directions, rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + N_FEATURES + 1), np.zeros(0), np.zeros(0))
    if not moments:
        rows.unpersist()
        return model
    d = len(model.weights)

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
        return batch.column(0).to_numpy() % FOLDS, values, batch.column(2).to_numpy(zero_copy_only=False)

    def sums(batches):
        a, b = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d))
        for batch in batches:
            fold, x, y = unpack(batch)
            z = model.lift(x)
            for k in range(FOLDS):
                a[k] += z[fold == k].T @ z[fold == k]
                b[k] += z[fold == k].T @ y[fold == k]
        if a.any():  # one row for each row of each fold's matrix, with its right-hand side last
            rows_of = np.concatenate([a, b[:, :, None]], axis=2).reshape(FOLDS * d, d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOLDS * d)), list_array(rows_of.ravel(), np.full(FOLDS * d, d + 1), pa.float64())], names=["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        total = table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, d + 1).sum(0)
        return pa.table({"i": table.column("i").slice(0, 1), "row": list_array(total, np.array([d + 1]), pa.float64())})

    parts = rows.mapInArrow(sums, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").orderBy("i").collect()  # FOLDS * d rows, whatever the input
    both = np.array([p["row"] for p in parts]).reshape(FOLDS, d, d + 1)
    a, b = both[:, :, :d], both[:, :, d]
    penalty = np.diag(np.full(d, ridge))
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a.sum(0) + penalty, b.sum(0))
    others = np.stack([np.linalg.solve(a.sum(0) - a[k] + penalty, b.sum(0) - b[k]) for k in range(FOLDS)])

    def out_of_fold(batches):
        for batch in batches:
            fold, x, y = unpack(batch)
            raw = (model.lift(x) * others[fold]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.round(raw * 500), -2000, 3000).astype(np.int64)), pa.array(y)], names=["bin", "y"])

    bins = rows.mapInArrow(out_of_fold, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.knots, model.levels = pooled_adjacent_violators(np.array([r["bin"] / 500 for r in bins]), np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    rows.unpersist()
    return model


def training_ids(labels: DataFrame, key: str = "doc_id", label: str = "quality", max_train_rows: int = 200_000) -> DataFrame:
    """(key) of the labelled documents that may train: all, or about ``max_train_rows`` of them by the hash that :func:`fit`
    orders them by. So bounded, they can be sent to every task, and texts need no shuffle to meet their labels."""
    ids = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key).distinct()
    total = ids.count()
    if total > max_train_rows:
        ids = ids.where(_chosen(F.xxhash64(key), max_train_rows, total))
    return ids


def score_statistics(stats: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    """(key, score) of rows of :func:`document_statistics`."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["key", "score"])

    kind = dict(stats.dtypes)[key]
    return stats.select(F.col(key).alias("key"), "stats").mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; statistics and scores are made in
    one pass, so a task needs one Python worker."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), packed(docs))

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, "text"):
                score = model.score(text_statistics(part.column(0)))
                yield part.select(["row"]).filter(pa.array(score >= threshold))

    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select(*unpacked(docs))
