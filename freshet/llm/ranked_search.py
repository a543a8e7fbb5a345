"""Ranked lexical search with range-maximum tables over posting lists, best document intervals first.

Terms are the maximal runs of characters other than ASCII punctuation, blanks and controls, A-Z lower-cased. One pass over the texts
counts terms and leaves, for each document, its length and the items' terms in it; document frequencies are counted from that table. Each task then
builds shards of its own documents, in order of their lengths, so no posting is shuffled: a posting list for each term, impacts in document order, and one
sparse table of range maxima over all lists. For an item the search starts with the interval of all documents in a shard. An interval's bound
is the sum of its terms' range maxima; the intervals with the greatest bounds are split at the document of the greatest
single impact, which is scored, until no bound reaches the k-th score so far (equal bounds go on, for ties). That score is
carried from shard to shard of a task. Tasks give k documents for each item at most, merged by score and id.

The items are the stated queries: they are read in pages of ``PAGE_ITEMS``, each answered by one pass over all documents.

Cases: a null or empty text has no term and isn't counted. Rows with a null doc_id count in all statistics and are never returned.
Repeated rows are documents of their own. Rows of one item_id are one item, with all their terms; those with a null one, and items without terms, get no answer.
Equal scores go by ascending doc_id. Texts of any length are read whole, in windows cut between terms. Empty tables give an
empty table. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, byte_slices, drop_scratch, list_array, mix64, powers, running_sums, text_buffers, write_scratch

PAGE_ITEMS, SHARD_ROWS, WINDOW_BYTES, SPLITS = 2048, 16_384, 4_000_000, 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def item_terms(text: Column) -> Column:
    """The terms of a text, by expressions."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _SMALL), F.lit(TERM), 0)


# --- terms of documents -------------------------------------------------------------------------


class Vocabulary:
    """The terms of a page of items, found in texts by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        words = [t.encode() for t in terms]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(words), np.uint8)
        power, inverse = powers(len(self.data) + 1)
        sums = running_sums(_BYTE[self.data], power[:-1])
        hashes = self._hash(sums, inverse, self.starts, self.starts + self.sizes)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ArithmeticError("two terms of a page have one 64-bit hash; use another page size")

    @staticmethod
    def _hash(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((sums[ends] - sums[starts]) * inverse[starts] ^ mix64((ends - starts).astype(np.uint64)))

    def find(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all terms in lower-cased bytes, cut at ``begins`` of texts too; and the places and numbers of known ones."""
        inside = _INSIDE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = begins[begins < len(data)]
        first[begins] = inside[begins]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        ends = np.flatnonzero(last) + 1
        if not len(starts) or not len(self.hashes):
            return starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
        power, inverse = powers(len(data) + 1)
        hashes = self._hash(running_sums(_BYTE[data], power[:-1]), inverse, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        term = self.order[at]
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[term] == ends - starts))
        term = term[hit]
        # compare the bytes of each hit with its term's
        n = self.sizes[term]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = data[np.repeat(starts[hit], n) + step] == self.data[np.repeat(self.starts[term], n) + step]
        if len(same):
            equal = np.logical_and.reduceat(same, np.cumsum(n) - n)
            hit, term = hit[equal], term[equal]
        return starts, starts[hit], term


def _windows(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``WINDOW_BYTES``, cut where no term goes across."""
    a = 0
    while a < len(data):
        b = min(len(data), a + WINDOW_BYTES)
        while b < len(data) and _INSIDE[data[b]]:
            outside = np.flatnonzero(~_INSIDE[data[b : b + WINDOW_BYTES]])
            b = b + int(outside[0]) if len(outside) else min(len(data), b + WINDOW_BYTES)
        yield a, b
        a = b


def document_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tf) for each document with a term: its number of terms, and which of ``terms`` it holds how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(terms)
        for batch in batches:
            for part in byte_slices(batch):
                raw, offsets = text_buffers(part.column(1))
                n = np.zeros(part.num_rows, np.int64)
                pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, b in _windows(raw):
                    starts, places, found = own.find(_LOWER[raw[a:b]], offsets[(offsets >= a) & (offsets < b)] - a)
                    n += np.bincount(np.searchsorted(offsets, starts + a, side="right") - 1, minlength=len(n))
                    key, times = np.unique((np.searchsorted(offsets, places + a, side="right") - 1) * len(terms) + found, return_counts=True)
                    pairs.append(key)
                    counts.append(times)
                key, back = np.unique(np.concatenate(pairs), return_inverse=True)  # a long text has several windows
                times = np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
                kept = np.flatnonzero(n)
                sizes = np.bincount(key // max(1, len(terms)), minlength=len(n))[kept]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(n[kept]), list_array(key % max(1, len(terms)), sizes, pa.int32()), list_array(times, sizes, pa.int64())], names=["doc_id", "n", "terms", "tf"])

    schema = docs.select("doc_id", F.lit(0).cast("bigint").alias("n"), F.array().cast("array<int>").alias("terms"), F.array().cast("array<bigint>").alias("tf")).schema
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# --- shards -------------------------------------------------------------------------------------


class Shard:
    """Posting lists of some documents, one after the other, with a sparse table of range maxima over all of them."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Postings (doc, term, impact); doc is a place in ``ids``."""
        self.ids, self.size = ids, len(ids)
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.key = term[order].astype(np.int64) * self.size + self.doc
        # table[j][i]: where the greatest of the 2 ** j impacts from i on is; lists are never crossed by what is asked
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.table = [np.arange(len(order), dtype=np.int32)]
        while 2 ** len(self.table) <= longest:
            a = self.table[-1]
            b = a[2 ** (len(self.table) - 1) :]
            a = a[: len(b)]
            nxt = np.where(self.impact[b] > self.impact[a], b, a)
            self.table.append(np.concatenate([nxt, self.table[-1][len(b) :]]))
        self.table = np.stack(self.table) if len(order) else np.zeros((1, 0), np.int32)

    def maxima(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ranges [low, high) of its terms: the sum of their maxima and the place of the greatest, by the range-maximum table."""
        length = high - low
        some = length > 0
        level = np.frexp(np.maximum(length, 1))[1] - 1
        last = max(0, self.table.shape[1] - 1)
        a = self.table[level, np.minimum(low, last)]
        b = self.table[level, np.clip(high - (1 << level), 0, last)]
        best = np.where(self.impact[b] > self.impact[a], b, a)
        value = np.where(some, self.impact[best], 0)
        top = value.argmax(axis=1)
        return value.sum(axis=1), best[np.arange(len(best)), top]

    def top(self, terms: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (scores, ids) of what is given and this shard, and how many documents were scored."""
        low = np.searchsorted(self.key, terms * self.size)
        high = np.searchsorted(self.key, (terms + 1) * self.size)
        held = high > low
        terms, low, high = terms[held], low[held], high[held]
        if not len(terms):
            return scores, ids, 0
        base = terms * self.size
        bound, split = self.maxima(low[None], high[None])
        heap, ranges, scored = [(-int(bound[0]), 0, int(split[0]))], {0: (low, high)}, 0
        number = 1
        while heap:
            least = int(scores[-1]) if len(scores) == k else 1
            taken = []
            while heap and len(taken) < SPLITS and -heap[0][0] >= least:
                taken.append(heapq.heappop(heap))
            if not taken:
                break
            low, high = (np.stack(x) for x in zip(*(ranges.pop(t[1]) for t in taken), strict=True))
            at = self.doc[[t[2] for t in taken]].astype(np.int64)
            middle = np.clip(np.searchsorted(self.key, base[None] + at[:, None]), low, high)
            inside = (middle < high) & (self.doc[np.minimum(middle, len(self.doc) - 1)] == at[:, None])
            value = np.where(inside, self.impact[np.minimum(middle, len(self.doc) - 1)], 0).sum(axis=1)
            scored += len(at)
            scores, ids = np.concatenate([scores, value]), np.concatenate([ids, self.ids[at]])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            least = int(scores[-1]) if len(scores) == k else 1
            low, high = np.concatenate([low, middle + inside]), np.concatenate([middle, high])
            bound, split = self.maxima(low, high)
            for j in np.flatnonzero(bound >= least):
                heapq.heappush(heap, (-int(bound[j]), number, int(split[j])))
                ranges[number] = (low[j], high[j])
                number += 1
        return scores, ids, scored


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers."""
    m = 100 - 50 + (50 * n * documents) // max(1, length)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def _answer(found: DataFrame, wanted: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [np.zeros(0, np.int64) for _ in wanted]
        ids = [np.zeros(0, np.int64) for _ in wanted]
        waiting: list[pa.RecordBatch] = []

        def search() -> None:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            rows = rows.take(pa.array(np.argsort(rows.column("n").to_numpy(), kind="stable")))  # near lengths have near impacts, so bounds are closer
            terms, times = (rows.column(c).combine_chunks() for c in ("terms", "tf"))
            sizes = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), sizes)
            term = terms.flatten().to_numpy()
            value = impacts(times.flatten().to_numpy(), rows.column("n").to_numpy()[doc], weights[term], documents, length)
            some = value > 0
            shard = Shard(rows.column("doc_id").to_numpy(), doc[some], term[some], value[some])
            for j, own in enumerate(wanted):
                scores[j], ids[j], _ = shard.top(own, k, scores[j], ids[j])

        for batch in batches:
            for i in range(0, batch.num_rows, SHARD_ROWS):
                waiting.append(batch.slice(i, SHARD_ROWS))
                if sum(b.num_rows for b in waiting) >= SHARD_ROWS:
                    search()
        if waiting:
            search()
        if any(len(s) for s in scores):
            item = np.repeat(np.arange(len(wanted), dtype=np.int32), [len(s) for s in scores])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(scores))], names=["item", "doc_id", "score"])

    return found.where("doc_id is not null and size(terms) > 0").mapInArrow(run, "item int, doc_id long, score long")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 50, item_key: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0.

    docs: doc_id (integer), text; items: ``item_key``, text."""
    spark = docs.sparkSession
    each = items.select(F.col(item_key).alias("item"), F.explode(item_terms(F.col("text"))).alias("term")).where("item is not null").distinct()
    each = write_scratch(each.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")), "items")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pages, last = [], None
    while page := (each if last is None else each.where(F.col("item") > F.lit(last))).orderBy("item").limit(PAGE_ITEMS).collect():
        last = page[-1].item
        terms = sorted({t for r in page for t in r.terms})
        number = {t: i for i, t in enumerate(terms)}
        found = write_scratch(document_terms(texts, terms), "terms")
        whole = found.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        frequency = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the page
        weights = np.array([term_weight(whole.documents, frequency.get(i, 0)) for i in range(len(terms))], np.int64)
        wanted = [np.array([number[t] for t in r.terms], np.int64) for r in page]
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(page)], each.select(F.lit(0).alias("i"), "item").schema)
        best = _answer(found, wanted, weights, whole.documents, whole.length, k)
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
        pages.append(write_scratch(ranked.join(names.select(F.col("i").alias("item"), F.col("item").alias(item_key)), "item").select(item_key, "rank", "doc_id", "score"), "ranked"))
        drop_scratch(found)
    drop_scratch(each)
    if not pages:
        return items.select(F.col(item_key), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out
