"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes marked words: a dummy mark in front, each space a mark, and cuts before marks, which no piece
crosses. The distinct marked words of a batch that are not in the worker's bounded cache are sorted and
traversed depth-first as a trie: the forward scores, and the vocabulary-trie nodes that are still open, are kept
for each position of the current word and reused for the prefix that the next word shares with it. The best
segmentation has the highest sum of piece scores; of equal ones the last piece that starts first wins. Characters
outside the vocabulary fall back to byte pieces.

A segmentation is the best by the model file's scores. For a model trained as BPE this can differ from its
merge order. Nothing is shuffled: encoding and decoding are one pass over the rows.

Words over ``LONG_WORD`` characters (texts without spaces) aren't shared or cached; they are segmented one by one, in
pieces between positions that no vocabulary piece crosses.

Cases: a null text is empty; an empty text has no ids; several spaces in a row stay one word with several
marks; decoding drops the dummy mark, turns marks into spaces, and gives back the encoded text exactly, save that
the mark character itself (U+2581) reads as a space; byte pieces that aren't UTF-8 decode to U+FFFD; repeated rows
are each encoded; a null id list decodes to an empty text.
"""

from __future__ import annotations

import re
from array import array
from collections import ChainMap
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_slices

MARK = "▁"
CACHE_WORDS = 500_000
LONG_WORD = 2_000
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass
class PieceModel:
    """Pieces and scores of a model; as large as its vocabulary."""

    pieces: list[str]
    scores: list[float]
    byte_ids: dict[int, int]
    unknown: int
    _trie: dict | None = field(default=None, repr=False)
    _words: dict[str, bytes] = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, path: str | None = None) -> PieceModel:
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = lambda i: not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        model = cls([sp.id_to_piece(i) if plain(i) else "" for i in ids], [sp.get_score(i) for i in ids], {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}, sp.unk_id())
        if any(MARK in p.lstrip(MARK) for p in model.pieces):
            raise ValueError("a piece has a mark after another character; words can't be cut at marks")
        return model

    def __getstate__(self):
        return {"pieces": self.pieces, "scores": self.scores, "byte_ids": self.byte_ids, "unknown": self.unknown, "_trie": None, "_words": {}}

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2") if len(self.pieces) <= 1 << 16 else np.dtype("<u4")

    @property
    def trie(self) -> dict:
        if self._trie is None:
            root: dict = {}
            for i, piece in enumerate(self.pieces):
                node = root
                for c in piece:
                    node = node.setdefault(c, {})
                if piece:
                    node[""] = (i, self.scores[i])
            self._trie = root
        return self._trie

    def segment(self, words: list[str]) -> dict[str, list[int]]:
        """Best ids of each distinct word, sharing the work on common prefixes."""
        root, floor = self.trie, min(s for p, s in zip(self.pieces, self.scores, strict=True) if p) - UNKNOWN_PENALTY
        out: dict[str, list[int]] = {}
        best, came = [0.0], [(0, 0)]  # by position: score, (start, id) of the last piece
        opened: list[list[tuple[int, dict]]] = [[]]  # vocabulary nodes that reach the position, earliest start first
        before = ""
        for word in sorted(set(words)):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del best[same + 1 :], came[same + 1 :], opened[same + 1 :]
            for at in range(same, len(word)):
                c, live, top, how, single = word[at], [], None, (at, -1), False
                for start, node in (*opened[at], (at, root)):
                    node = node.get(c)
                    if node is None:
                        continue
                    live.append((start, node))
                    hit = node.get("")
                    if hit is not None:
                        single |= start == at
                        score = best[start] + hit[1]
                        if top is None or score > top:
                            top, how = score, (start, hit[0])
                if not single and (top is None or best[at] + floor > top):
                    top, how = best[at] + floor, (at, -1)
                best.append(top)
                came.append(how)
                opened.append(live)
            ids: list[int] = []
            at = len(word)
            while at:
                start, i = came[at]
                if i >= 0:
                    ids.append(i)
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in reversed(word[start:at].encode()))
                else:
                    ids.append(self.unknown)
                at = start
            out[word] = ids[::-1]
            before = word
        return out

    def segment_long(self, word: str) -> bytes:
        """Best ids of one long word, as :func:`segment` gives them. Up to a position that no piece of the vocabulary
        crosses all is settled and written out; in between a position takes 16 bytes."""
        root, floor = self.trie, min(s for p, s in zip(self.pieces, self.scores, strict=True) if p) - UNKNOWN_PENALTY
        out: list[np.ndarray] = []
        base, best, start_of, id_of = 0, array("d", [0.0]), array("i", [0]), array("i", [0])
        live: list[tuple[int, dict]] = []

        def settle(end: int) -> None:
            ids: list[int] = []
            at = end - base
            while at:
                start, i = start_of[at], id_of[at]
                if i >= 0:
                    ids.append(i)
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in reversed(word[base + start : base + at].encode()))
                else:
                    ids.append(self.unknown)
                at = start
            out.append(np.array(ids[::-1], self.kind))

        for at, c in enumerate(word):
            spot, still, top, how, single = at - base, [], None, (at - base, -1), False
            for start, node in (*live, (spot, root)):
                node = node.get(c)
                if node is None:
                    continue
                hit = node.get("")
                if len(node) > (hit is not None):
                    still.append((start, node))
                if hit is not None:
                    single |= start == spot
                    score = best[start] + hit[1]
                    if top is None or score > top:
                        top, how = score, (start, hit[0])
            if not single and (top is None or best[spot] + floor > top):
                top, how = best[spot] + floor, (spot, -1)
            best.append(top)
            start_of.append(how[0])
            id_of.append(how[1])
            live = still
            if not live:
                settle(at + 1)
                base, best, start_of, id_of = at + 1, array("d", [0.0]), array("i", [0]), array("i", [0])
        settle(len(word))
        return np.concatenate(out).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each as a little-endian binary."""
        marked = [_WORD.findall(MARK + t.replace(" ", MARK)) if "  " in t or MARK in t or t[:1] == " " else [MARK + w for w in t.split(" ")] if t else [] for t in texts]
        long = {w: self.segment_long(w) for ws in marked for w in ws if len(w) > LONG_WORD}
        missing = {w for ws in marked for w in ws}.difference(self._words, long)
        if missing:
            if len(self._words) + len(missing) > CACHE_WORDS:
                self._words.clear()
                missing = {w for ws in marked for w in ws}.difference(long)
            kind = self.kind
            self._words.update((w, np.array(ids, kind).tobytes()) for w, ids in self.segment(list(missing)).items())
        get = ChainMap(long, self._words).__getitem__ if long else self._words.__getitem__
        return [b"".join(map(get, ws)) for ws in marked]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        table = [p.replace(MARK, " ").encode() for p in self.pieces]
        for value, i in self.byte_ids.items():
            table[i] = bytes([value])
        table[self.unknown] = table[self.unknown] or " ⁇ ".encode()
        get = table.__getitem__
        return [b"".join(map(get, x.tolist())).decode("utf-8", "replace")[1:] for x in ids]


def ship(spark: SparkSession, model: PieceModel):
    return spark.sparkContext.broadcast(model)


def encode(rows: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_ids, ids: little-endian binary of 16 or 32 bits)."""
    shared, width = ship(rows.sparkSession, model), model.kind.itemsize
    kind = dict(rows.dtypes)[key]

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in byte_slices(batch, text, 4_000_000):
                ids = own.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[key, "n_ids", "ids"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_ids long, ids binary")


def decode(encoded: DataFrame, model: PieceModel, key: str = "doc_id") -> DataFrame:
    """(key, n_ids, ids, text) of rows of :func:`encode`."""
    shared, kind = ship(encoded.sparkSession, model), model.kind

    def run(batches):
        own = shared.value
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer() if x.is_valid else b"", kind) for x in batch.column(2)]
            for i in range(0, len(ids), 500):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 500) for c in batch.columns), pa.array(own.decode(ids[i : i + 500]))], names=[key, "n_ids", "ids", "text"])

    return encoded.select(key, "n_ids", "ids").mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, n_ids long, ids binary, text string")
