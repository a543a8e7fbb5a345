"""Language identification by compression: the language whose dictionary makes a text smallest.

Fitting takes a bounded sample of labelled texts for each language, ``DICTIONARY_BYTES`` of slices of ``SLICE_CHARS``
characters, as a raw-content zstandard dictionary. A text is lower-cased and its runs of other characters than letters become
spaces; then each of its pieces of ``PIECE_BYTES`` is compressed on its own with each dictionary, as the text's own history would soon
count for more than any dictionary. The sum of the sizes decides. Every piece of a text is compressed; one pass over the texts without a shuffle.

``margin`` is the share by which the second best sum is larger; under ``min_margin`` the answer is ``rejected``, and
``lang_pred`` then still names the smallest. ``score`` is the best language's share when each language weighs 2 to the power
of minus its size in bits over ``BITS_SCALE``.

Cases: a null text and one without a letter are ``und`` with score 0, rejected. Equal sizes go to the language with more labelled
rows, then to the lesser name. Texts of any length are read whole, in pieces. Repeated rows are answered alike. Rows without
text or language don't take part in the fit; without any labelled row all answers are ``und``. With one language every text with a letter is that one, with
score 1. Of more than ``max_langs`` languages the most frequent are learned. An empty table gives an empty table. Further columns stay; those named like a
result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_slices, packed, text_buffers, unpacked

DICTIONARY_BYTES, SLICE_CHARS, PIECE_BYTES, LEVEL, BITS_SCALE = 65_536, 256, 1024, 6, 8.0
RESULT = ("lang_pred", "score", "margin", "rejected")


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the most frequent first, and the raw-content dictionary of each."""

    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        raw = (zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in self.dictionaries)
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in raw]


def letters(text: Column) -> Column:
    """Lower-case letters, a space for each run of anything else; null without a letter."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))
    return F.when(text.rlike(r"\p{L}"), plain)


def fit(labelled: DataFrame, max_langs: int = 64) -> LanguageModel:
    """Model of (text, lang) rows. At most ``max_langs`` times about 64 KB of slices come to the driver."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), letters(F.col("text")).alias("t")).where("lang is not null and t is not null")
    top = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    # slices from anywhere in the texts, those of the least hashes: each task keeps that many a language before the shuffle
    at = F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - SLICE_CHARS, F.lit(1))).cast("int") + 1
    slices = rows.select("lang", F.xxhash64("t", F.lit(1)).alias("h"), F.substring("t", at, F.lit(SLICE_CHARS)).alias("t"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))
    kept = slices.withColumn("nth", nth).where(F.col("nth") <= DICTIONARY_BYTES // SLICE_CHARS).join(top, "lang")
    texts: dict[str, list[str]] = {}
    for r in kept.orderBy(F.desc("n"), "lang", "nth").select("lang", "t").toLocalIterator():
        texts.setdefault(r.lang, []).append(r.t)
    return LanguageModel(tuple(texts), tuple("".join(t).encode()[:DICTIONARY_BYTES] for t in texts.values()))


def sizes(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Compressed bytes of all pieces of one text, for each language."""
    total = np.zeros(len(compressors), np.int64)
    for i in range(0, len(text), PIECE_BYTES):
        piece = text[i : i + PIECE_BYTES]
        total += [len(c.compress(piece)) for c in compressors]
    return total


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = 0.005) -> DataFrame:
    """All rows of ``docs`` with lang_pred, score, margin and rejected."""
    langs = np.array(model.langs, dtype=object)
    whole = docs.select(packed(docs), F.struct(letters(F.col(f"`{text}`")).alias("t")).alias("own"))
    fields = {"lang_pred": pa.string(), "score": pa.float64(), "margin": pa.float64(), "rejected": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).field(0)], names=["row", "text"])
            for part in byte_slices(flat):
                data, offsets = text_buffers(part.column(1))
                raw = data.tobytes()
                pred, score, margin = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    if a == b or not len(langs):
                        continue
                    n = sizes(raw[a:b], compressors)
                    best = int(np.argmin(n))
                    pred[k] = langs[best]
                    score[k] = 1 / np.exp2((n[best] - n) * (8 / BITS_SCALE)).sum()
                    margin[k] = (np.partition(n, 1)[1] - n[best]) / n[best] if len(n) > 1 else 1.0
                made = {"lang_pred": pred, "score": score, "margin": margin, "rejected": margin < min_margin}
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, fields[c]) for c, v in made.items())], names=["row", *made])

    schema = whole.select("row", *(F.lit(None).cast(t).alias(c) for c, t in zip(RESULT, ("string", "double", "double", "boolean"), strict=True))).schema
    return whole.mapInArrow(run, schema).select(*unpacked(docs, skip=RESULT), *RESULT)
