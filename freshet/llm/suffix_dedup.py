"""Substring dedup: prefix doubling over sparse suffixes.

Removes each byte covered by a ``span``-byte string that also starts in a document with a smaller doc_id.
A rank names the suffixes that begin with the same bytes. Spark sorts pairs of a suffix's rank and the key of the bytes at the
next offset, drops pairs that one document alone has, and numbers the others in their order as ranks of the greater
length, until the threshold ``span`` is reached:

* length ``k`` (20): not every suffix takes part, as that would be a row for each byte. Every ``span``-byte window has
  one anchor, the position of its least ``k``-byte key, and equal windows have equal anchors, so only anchors are
  sorted: about one position in 15. Consecutive windows of one anchor form a chunk. A chunk whose whole text a smaller
  document also has is a copy: all its windows are, and no byte of it is looked at again. Anchors
  in one document only leave.
* length ``k + (span - k) / 2`` (35): windows reach past their anchor by at least half the rest on one side. The pairs are the
  anchor's rank and the key of the ``k`` bytes at that offset, on the left or on the right.
* length ``span`` (50): the pairs are the rank before and the key of the whole window, one for each window that is left. The
  class's smallest doc_id decides.

The keys at an offset are 64-bit hashes (doubled inside the task from 1, 2, 4 ... bytes) and are made where the text is, so
that no row is needed for a position only because another looks it up; the last comparison is on two of them, 128 bits.
Identical chunks of one slice of the input are merged before the shuffle, which keeps groups of copies small.

Cases: a null or empty text has no bytes; a text shorter than ``span`` is kept; matches never cross
documents; strings are judged on the input. Rows with a null doc_id are kept whole and match nothing.
Rows that repeat a doc_id don't match each other and share their removed spans (a doc_id is meant to name
one text); doc_id is a long. An empty table gives an empty table. Further columns are kept by :func:`remove_repeats` and
:func:`cut_texts`, whatever their names; columns named kept_bytes, n_bytes, n_removed or n_spans are replaced by the former's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, byte_slices, drop_scratch, list_array, mix64, packed, signed, text_buffers, write_scratch

_MUL = mix64(np.arange(64, dtype=np.uint64)) | np.uint64(1)
_SHIFT = np.uint64(31)
_LOW = np.uint64((1 << 23) - 1)


def _join_hash(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Hash of two neighbouring strings from their hashes."""
    x = a * _MUL[level]
    x += b
    x ^= x >> _SHIFT
    x *= _MUL[level + 32]
    return x


class Grams:
    """Hashes of the 2 ** i bytes from each position, doubled on demand; of any length by two of them."""

    def __init__(self, data: np.ndarray) -> None:
        self.n, self.levels = len(data), [_BYTE[data]]

    def level(self, i: int) -> np.ndarray:
        while len(self.levels) <= i:
            h, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_join_hash(h[:-step], h[step:], len(self.levels)))
        return self.levels[i]

    def at(self, start: np.ndarray, length: int | np.ndarray, level: int) -> np.ndarray:
        """Hash of ``length`` bytes from each start: its first and last (and a middle) 2 ** level bytes."""
        h, step = self.level(level), 1 << level
        out = _join_hash(h[start], h[start + length - step], 20)
        return mix64(_join_hash(out, h[start + (length - step) // 2], 21) + np.asarray(length, dtype=np.uint64))


def chunks_of(data: np.ndarray, offsets: np.ndarray, span: int, k: int):
    """Runs of windows with one anchor: first window, number of windows, anchor; and the grams."""
    z = np.zeros(0, np.int64)
    grams = Grams(data)
    if len(data) < span:
        return z, z, z, grams
    top = 4 if k >= 16 else 3
    step = 1 << top
    h = grams.level(top)
    m = _join_hash(h[: len(data) - k + 1], h[k - step :], 22)  # k bytes as two overlapping blocks
    m &= ~_LOW
    m |= np.arange(len(m), dtype=np.uint64)
    width, w = 1, span - k + 1
    while width < w:
        step = min(width, w - width)
        m = np.minimum(m[:-step], m[step:])
        width += step
    anchor = (m & _LOW).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for end in offsets[1:-1]:  # windows must not cross into the next text
        valid[max(0, end - span + 1) : end] = False
    s = np.flatnonzero(valid)
    if not len(s):
        return z, z, z, grams
    p = anchor[s]
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    return s[at], np.diff(np.concatenate([at, [len(s)]])), p[at], grams


def _length_hash(grams: Grams, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of strings of 50 to 80 bytes (span to span + windows - 1), covered by three 32-byte blocks."""
    return grams.at(start, length, 5)


def anchor_rows(docs: DataFrame, span: int, k: int) -> DataFrame:
    """(key, whole, doc_id, place): anchor hash, chunk hash, first window << 8 | number of windows.

    A chunk that a smaller doc_id of the same slice holds too is a copy already: its place is negated, and its
    key is spread by its position, as it needs no rank.
    """

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                data, offsets = text_buffers(part.column(1))
                first, n, anchor, grams = chunks_of(data, offsets, span, k)
                if not len(first):
                    continue
                key = _gram_at(grams, anchor, k)
                whole = _length_hash(grams, first, n + span - 1) ^ key
                row = np.searchsorted(offsets, first, side="right") - 1
                doc, place = ids[row], (first - offsets[row]) << 8 | n
                order = np.lexsort((doc, whole))
                w, d = whole[order], doc[order]
                head = np.ones(len(w), bool)
                head[1:] = w[1:] != w[:-1]
                least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
                copy = np.zeros(len(w), bool)
                copy[order] = d > least
                key[copy] = mix64(key[copy] + place[copy].astype(np.uint64))
                place[copy] *= -1
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(whole)), pa.array(doc), pa.array(place)], names=["key", "whole", "doc_id", "place"])

    # the positions in a slice fit 23 bits: a longer text is cut below, with its pieces overlapping
    return docs.where("doc_id is not null and octet_length(text) >= " + str(span)).select("doc_id", "text").mapInArrow(_long_texts(run, span), "key long, whole long, doc_id long, place long")


def _gram_at(grams: Grams, start: np.ndarray, k: int) -> np.ndarray:
    top = 4 if k >= 16 else 3
    h, step = grams.level(top), 1 << top
    return mix64(_join_hash(h[start], h[start + k - step], 23))


MAX_TEXT = 4_000_000


def _long_texts(run, span: int):
    """Texts over MAX_TEXT bytes go through ``run`` in pieces that share span - 1 bytes; places are shifted."""

    def outer(batches):
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1))
            long = pa.compute.greater(sizes, MAX_TEXT)
            if not pa.compute.any(long).as_py():
                yield from run([batch])
                continue
            yield from run([batch.filter(pa.compute.invert(long))])
            for row in batch.filter(long).to_pylist():
                raw = row["text"].encode()
                for at in range(0, len(raw) - span + 1, MAX_TEXT - span + 1):
                    piece = pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), pa.array([raw[at : at + MAX_TEXT]], pa.binary())], names=["doc_id", "text"])
                    for out in run([piece]):
                        yield out.set_column(3, "place", pa.array(out.column(3).to_numpy() + np.sign(out.column(3).to_numpy()) * (at << 8)))

    return outer


def window_rows(docs: DataFrame, chunks: DataFrame, span: int, k: int) -> DataFrame:
    """The windows of open chunks, in groups of one side: (rank: the anchor's, next: key of the ``k`` bytes at the
    offset on that side, doc_id, first, windows: their keys)."""
    reach = (span - k) // 2
    lists = chunks.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    both = docs.select("doc_id", "text").join(lists, "doc_id").select("doc_id", "text", "places")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, offsets = text_buffers(batch.column(1).slice(i, 1))
                places = np.unique(batch.column(2).slice(i, 1).flatten().to_numpy())
                first, n = places >> 8, places & 255
                first, n = first[first + n + span - 1 <= len(data)], n[first + n + span - 1 <= len(data)]
                if not len(first):
                    continue
                # only the chunks' own bytes are hashed
                size = n + span - 1
                begin = np.cumsum(size) - size
                own = data[np.repeat(first - begin, size) + np.arange(size.sum())]
                grams = Grams(own)
                at = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                window = grams.at(at, span, 5)
                # the anchor again: least k-byte hash of each chunk's first window
                _, _, anchor, _ = _anchors(own, begin, span, k)
                anchor = np.repeat(anchor, n)
                left = at <= anchor - reach
                rank = _gram_at(grams, anchor, k)
                beside = _gram_at(grams, np.where(left, anchor - reach, anchor + reach), k) ^ left.astype(np.uint64)
                doc_place = np.repeat(first - begin, n) + at
                new = np.ones(len(at), bool)
                new[1:] = (np.repeat(np.arange(len(n)), n)[1:] != np.repeat(np.arange(len(n)), n)[:-1]) | (left[1:] != left[:-1])
                heads = np.flatnonzero(new)
                counts = np.diff(np.concatenate([heads, [len(at)]]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(rank[heads])), pa.array(signed(beside[heads])), pa.array(np.full(len(heads), batch.column(0)[i].as_py())), pa.array(doc_place[heads]), list_array(signed(window), counts, pa.int64())], names=["rank", "next", "doc_id", "first", "windows"])

    return both.mapInArrow(run, "rank long, next long, doc_id long, first long, windows array<long>")


def _anchors(own: np.ndarray, begin: np.ndarray, span: int, k: int):
    """Anchor of the first window of each chunk, by the same order as :func:`chunks_of`."""
    grams = Grams(own)
    top = 4 if k >= 16 else 3
    step = 1 << top
    h = grams.level(top)
    m = _join_hash(h[: len(own) - k + 1], h[k - step :], 22) & ~_LOW
    at = begin[:, None] + np.arange(span - k + 1)[None, :]
    return None, None, begin + np.argmin(m[at], axis=1), grams


def shared_classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, new, low) of pairs that several documents have: their number in the sorted order, and the smallest doc_id."""
    classes = rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    return classes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("new", F.monotonically_increasing_id())


def repeated_spans(docs: DataFrame, span: int = 50, k: int = 20) -> DataFrame:
    """(doc_id, place): ``place >> 8`` is the first byte of ``place & 255`` consecutive repeated windows."""
    if not 32 <= k + (span - k) // 2 <= 64 or not 16 <= k <= 32 or span + span - k > 96:
        raise ValueError("span and k must keep every length within two or three hash blocks")
    rows = anchor_rows(docs, span, k).repartition("key")  # one shuffle serves both windows
    inner, outer = W.partitionBy("key", "whole"), W.partitionBy("key")
    ranked = rows.withColumn("least", F.min("doc_id").over(inner)).withColumn("low", F.min("least").over(outer)).withColumn("high", F.max("least").over(outer))
    copy = (F.col("place") < 0) | (F.col("doc_id") > F.col("least"))
    hits = write_scratch(ranked.where(copy | (F.col("low") < F.col("high"))).select("doc_id", F.abs("place").alias("place"), F.when(~copy, F.col("key")).alias("key")), "hits")
    windows = write_scratch(window_rows(docs, hits.where("key is not null"), span, k), "windows")
    classes = shared_classes(windows.select("rank", "next", "doc_id"), ["rank", "next"])
    ranked = windows.join(classes, ["rank", "next"]).select(F.col("new").alias("rank"), "doc_id", "first", F.posexplode("windows").alias("i", "next"))
    single = write_scratch(ranked.select("rank", "next", "doc_id", (F.col("first") + F.col("i")).alias("first")), "windows")
    drop_scratch(windows)
    least = single.groupBy("rank", "next").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    late = single.join(least, ["rank", "next"]).where("doc_id > low").select("doc_id", F.shiftleft("first", 8).bitwiseOR(F.lit(1)).alias("place"))
    found = write_scratch(hits.where("key is null").select("doc_id", "place").unionByName(late), "places")
    drop_scratch(hits, single)
    return found


def _cut(raw: bytes, places: np.ndarray | None, span: int) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the number of removed runs."""
    if places is None or not len(places):
        return raw, 0, 0
    delta = np.zeros(len(raw) + 1, np.int64)
    first = np.minimum(places >> 8, len(raw))
    np.add.at(delta, first, 1)
    np.add.at(delta, np.minimum(first + (places & 255) + span - 1, len(raw)), -1)
    gone = np.cumsum(delta[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and gone[0]))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _kept(docs: DataFrame, span: int, k: int, as_text: bool) -> DataFrame:
    """(row: all columns but text, text, kept, n_bytes, n_removed, n_spans); kept is binary, or text without the characters
    that a cut splits."""
    places = repeated_spans(docs.select("doc_id", "text"), span, k).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    both = docs.select("doc_id", "text", packed(docs.select(*others))).join(places, "doc_id", "left").select("row", "text", "places")
    names = ["row", "text", "kept", "n_bytes", "n_removed", "n_spans"]

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, limit=8_000_000):
                kept, n, gone, runs = [], [], [], []
                texts, lists = part.column(1), part.column(2)
                for i in range(part.num_rows):
                    raw = (texts[i].as_py() or "").encode()
                    a, b, c = _cut(raw, lists[i].values.to_numpy() if lists[i].is_valid else None, span)
                    kept.append(a.decode("utf-8", "ignore") if as_text else a), n.append(len(raw)), gone.append(b), runs.append(c)
                yield pa.RecordBatch.from_arrays([part.column(0), texts, pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (n, gone, runs))], names=names)

    out = T.StructType([both.schema["row"], both.schema["text"]])
    for name, kind in zip(names[2:], ("string" if as_text else "binary", "long", "long", "long"), strict=True):
        out = out.add(name, kind)
    return both.mapInArrow(run, out)


def remove_repeats(docs: DataFrame, span: int = 50, k: int = 20) -> DataFrame:
    """``docs`` (doc_id, text and any further columns) with kept_bytes, n_bytes, n_removed, n_spans."""
    own = ("kept_bytes", "n_bytes", "n_removed", "n_spans")
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in own]
    return _kept(docs, span, k, as_text=False).select(*columns, F.col("kept").alias("kept_bytes"), *own[1:])


def kept_digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def cut_texts(docs: DataFrame, span: int = 50, k: int = 20) -> DataFrame:
    """``docs`` with their columns, where text is what :func:`remove_repeats` keeps, less characters that a cut
    splits; n_chars, if there is one, follows. A null text stays null."""
    cut = (F.col("n_removed") > 0) & F.col("text").isNotNull()
    own = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(cut, F.length("kept").cast(kind)).otherwise(F.col("row.n_chars")).alias("n_chars")
    columns = [own[c] if c in own else F.col("row").getField(c).alias(c) for c in docs.columns]
    return _kept(docs, span, k, as_text=True).select(*columns)
