"""Lexical retrieval packing: documents become token sequences of at most ``window`` tokens.

A document's tokens are the tokenizer's ids and then ``end_id``. What fills whole windows of its own is cut
off first; the rest (under a window) is its remnant. Remnants are retrieved for each other: they are dealt
into shards of neighbouring lexical signatures, each shard holds an inverted index with BM25 weights (document
frequencies and the mean length are counted over all remnants), every seed scores the shard's unused
remnants, and the best fill its window greedily. The neighbour that doesn't fit is cut and its rest
seeds the next window. What is left at a shard's end is cut into sequences whose lengths are powers of two,
which need no padding.

Every id counts. For those that many of a shard's remnants hold, one matrix product gives their part of all scores in
the shard; the others have postings.

Bounds: a shard has at most ``shard_docs`` remnants, and a score for each pair of them; the frequencies have one row for each vocabulary entry.
Ids travel as 16-bit (or 32-bit) binaries. sequence_id is the partition's number and a counter in it.

Cases: a null or empty text is the end id alone; texts of any length are cut freely; equal rows are
packed each on their own; a null doc_id is packed too and stays null; an empty table gives an empty table;
only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, write_scratch

# Fixed value: how byte-level vocabularies cut a text into pieces
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_tokenizers: dict[str, FastTokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class FastTokenizer:
    """Ids of texts as bytes, as the ``tokenizers`` library gives them.

    A plain byte-level vocabulary is merged by ``tiktoken``, about three times faster, from the same file; it is
    compared with the library at the start. Texts with a special token's string, and any other tokenizer, go through the
    library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.size = self.inner.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.merge = self._merger(spec)

    def _merger(self, spec: dict):
        """encode(text) -> ids for a plain byte-level vocabulary whose ids follow its merges; else None."""
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("type") != "BPE":
            return None
        import tiktoken
        from tokenizers import pre_tokenizers

        # the printable stand-ins of bytes, read off the library: one byte for each character
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        if set(stand_in) != set(pre_tokenizers.ByteLevel.alphabet()):
            return None
        special = set(self.special)
        ranks = {bytes(stand_in[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = " it's 12 the, Élan\tñ 日本 😀 THEREFORE!! aaaaaaa  don't_stop\n\n x" + "".join(map(chr, range(32, 1500)))
        return encode if encode(probe) == self.inner.encode(probe, add_special_tokens=False).ids else None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.inner.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.merge is None:
            return self.whole(texts)
        code = "H" if self.kind.itemsize == 2 else "I"
        return [self.whole([t])[0] if any(s in t for s in self.special) else array(code, self.merge(t)).tobytes() for t in texts]


def tokenizer(path: str) -> FastTokenizer:
    """One for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = FastTokenizer(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, ids: binary with the end id)."""

    def run(batches):
        tok = tokenizer(path)
        end = np.array([end_id], tok.kind).tobytes()
        for batch in batches:
            for part in byte_slices(batch, limit=4_000_000):
                ids = tok.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + end for x in ids], pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def _remnants(batch: pa.RecordBatch, kind: np.dtype, window: int) -> list[np.ndarray]:
    ids = batch.column(batch.schema.get_field_index("ids"))
    all_ids = [np.frombuffer(x.as_buffer(), kind) for x in ids]
    return [x[len(x) - len(x) % window :] for x in all_ids]


def frequencies(tokens: DataFrame, kind: np.dtype, window: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id over all remnants, their number, and their mean length."""

    def run(batches):
        df, n, size = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            parts = [x for x in _remnants(batch, kind, window) if len(x)]
            n, size = n + len(parts), size + sum(map(len, parts))
            if parts:
                more = np.bincount(np.concatenate([np.unique(x) for x in parts]))
                df = np.pad(df, (0, max(0, len(more) - len(df))))
                df[: len(more)] += more
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([seen, [-1, -2]]), pa.int64()), pa.array(np.concatenate([df[seen], [n, size]]), pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one for each vocabulary entry
    found = {r["id"]: r["n"] for r in rows}
    df = np.zeros(max([0, *found]) + 1, np.int64)
    for i, n in found.items():
        if i >= 0:
            df[i] = n
    n = found.get(-1, 0)
    return df, n, max(1.0, found.get(-2, 0) / max(1, n))


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """BM25's weight of each id: low for frequent ones, never zero."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Shard:
    """Inverted index of a shard's remnants with BM25 weights; greedy windows from it."""

    def __init__(self, parts: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> None:
        self.n = len(parts)
        sizes = np.array([len(x) for x in parts], np.int64)
        doc = np.repeat(np.arange(self.n), sizes)
        key, tf = np.unique(np.concatenate(parts).astype(np.int64) << 24 | doc, return_counts=True) if self.n else (np.zeros(0, np.int64), np.zeros(0))
        self.term, self.doc = key >> 24, key & 0xFFFFFF
        self.weight = idf[self.term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[self.doc] / mean)) if self.n else np.zeros(0)
        top = int(self.term.max()) + 2 if len(self.term) else 1
        held = np.bincount(self.term, minlength=top)
        common = np.flatnonzero(held * 16 > max(self.n, 16))
        column = np.full(top, -1, np.int64)
        column[common] = np.arange(len(common))
        dense = column[self.term] >= 0
        weights = np.zeros((self.n, len(common)))
        weights[self.doc[dense], column[self.term[dense]]] = self.weight[dense]
        self.common = (weights != 0).astype(float) @ weights.T  # by seed, then remnant
        self.term, self.doc, self.weight = self.term[~dense], self.doc[~dense], self.weight[~dense]
        order = np.argsort(self.doc, kind="stable")
        self.terms_of = np.split(self.term[order], np.cumsum(np.bincount(self.doc, minlength=self.n))[:-1]) if self.n else []
        self.begin = np.searchsorted(self.term, np.arange(top))

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused remnants, best BM25 score for the seed's terms first, ties in the shard's order."""
        terms = self.terms_of[seed]
        lo, hi = self.begin[terms], self.begin[terms + 1]
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        scores = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n) + self.common[seed]
        left = np.flatnonzero(unused)
        return left[np.argsort(-scores[left], kind="stable")]

    def windows(self, lengths: list[int], window: int):
        """Lists of (remnant, start, length) that fill a window each; the last may be shorter."""
        unused = np.ones(self.n, bool)
        filled, room = [], window
        seed, start = 0, 0
        carried = False
        while True:
            if not carried:
                while seed < self.n and not unused[seed]:
                    seed += 1
                if seed == self.n:
                    break
                current, start = seed, 0
                unused[current] = False
            take = min(room, lengths[current] - start)
            filled.append((current, start, take))
            room, start, carried = room - take, start + take, False
            for other in self.ranked(current, unused) if room else ():
                unused[other] = False
                take = min(room, lengths[other])
                filled.append((int(other), 0, take))
                room -= take
                if not room:
                    current, start = int(other), take
                    break
            if not room:
                yield filled
                filled, room = [], window
                carried = start < lengths[current]
        if filled:
            yield filled


def powers_of_two(pieces: list[tuple[int, int, int]]):
    """Cut the pieces of an unfilled window into sequences whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    sizes = [1 << i for i in reversed(range(total.bit_length())) if total >> i & 1]
    out, room = [], sizes.pop(0) if sizes else 0
    for doc, start, length in pieces:
        while length:
            take = min(room, length)
            out.append((doc, start, take))
            start, length, room = start + take, length - take, room - take
            if not room:
                yield out
                out, room = [], sizes.pop(0) if sizes else 0


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = 1024, end_id: int = 0, shard_docs: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (the piece's
    ids, little-endian binary of the tokenizer's width)."""
    path = tokenizer_path or default_tokenizer()
    kind = tokenizer(path).kind
    tokens = write_scratch(tokenize(docs, path, end_id), "tokens")
    df, n, mean = frequencies(tokens, kind, window)
    idf = weights(df, n)
    shared = docs.sparkSession.sparkContext.broadcast((df, idf))  # as long as the vocabulary

    def sign(batches):
        """Signature: the id with the fewest documents, among those that at least one more has."""
        freq, _ = shared.value
        for batch in batches:
            found = []
            for x in _remnants(batch, kind, window):
                x = x[freq[x] > 1] if len(x) else x
                found.append(int(x[np.argmin(freq[x])]) if len(x) else -1)
            yield batch.append_column("sig", pa.array(found, pa.int64()))

    id_type = dict(tokens.dtypes)["doc_id"]
    dealt = tokens.mapInArrow(sign, f"doc_id {id_type}, ids binary, sig long").repartitionByRange("sig", F.hash("doc_id"), "doc_id").sortWithinPartitions("sig", "doc_id")

    def run(batches):
        _, idf = shared.value
        number = TaskContext.get().partitionId() << 36
        out: list[list] = [[] for _ in range(8)]

        def emit(pieces):
            nonlocal number
            offset = 0
            for doc_id, ids, total, start, length in pieces:
                part = ids[start : start + length]
                for column, value in zip(out, (doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), total, number, offset, part.tobytes()), strict=True):
                    column.append(value)
                offset += length
            number += 1

        def flush():
            kinds = [pa_kind, *[pa.int64()] * 6, pa.binary()]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            for c in out:
                c.clear()
            return done

        def close(shard):
            parts = [x[len(x) - len(x) % window :] for _, x in shard]
            index = Shard(parts, idf, mean)
            at = lambda p: (shard[p[0]][0], shard[p[0]][1], len(shard[p[0]][1]), len(shard[p[0]][1]) - len(parts[p[0]]) + p[1], p[2])
            for pieces in index.windows([len(x) for x in parts], window):
                if sum(p[2] for p in pieces) == window:
                    emit([at(p) for p in pieces])
                else:
                    for some in powers_of_two(pieces):
                        emit([at(p) for p in some])

        shard, pa_kind = [], None
        for batch in batches:
            pa_kind = batch.schema.field("doc_id").type
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer(), kind)
                for start in range(0, len(ids) - window + 1, window):
                    emit([(doc_id, ids, len(ids), start, window)])
                if len(ids) % window:
                    shard.append((doc_id, ids))
                if len(shard) == shard_docs:
                    close(shard)
                    shard = []
                if len(out[0]) > 4096:
                    yield flush()
        if shard:
            close(shard)
        if out[0]:
            yield flush()

    return dealt.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
