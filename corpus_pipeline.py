"""Corpus pipeline: quality classifier, line dedup, near-duplicate join, suffix-array dedup, packing.

Each stage works on all rows that its predecessor kept, and its decisions take effect. All but the last return
the columns of ``documents`` (and any further ones, whatever their names); packing returns one row for each piece. Labels are
looked up by doc_id.

Cases, at every stage: an empty table gives an empty table. A null text is scored as an empty one, and otherwise stays null; an
empty text has no line, shingle or byte to lose and is packed as one end id. Rows with a null doc_id are scored and packed; they
match nothing. Repeated rows: the quality stage judges each alike, line and byte cuts treat rows of one doc_id as one document,
the near-copy stage keeps one. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import line_dedup, ngram_join, packing, quality, suffix_dedup
from freshet.llm.common import packed, read_table, unpacked, write_scratch
from freshet.llm.queries import training_labels


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7; the rest go."""
    labels = training_labels(read_table(spark, sf_dir, "labels"))
    labelled = docs.join(F.broadcast(quality.training_ids(labels)), "doc_id", "left_semi")  # about 200,000 ids at most
    model = quality.fit(write_scratch(quality.document_statistics(labelled), "quality"), labels)
    return quality.keep_good(docs, model)


def no_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs leave their texts; n_chars follows. Documents stay, if empty."""
    cut = line_dedup.drop_repeated_lines(docs.select("doc_id", "text", packed(docs.drop("text"))))
    fewer = F.col("n_removed") > 0
    own = {"text": F.col("text"), "n_chars": F.when(fewer, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars")).alias("n_chars")}
    return cut.select(*(own.get(c, whole) for c, whole in zip(docs.columns, unpacked(docs), strict=True)))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def no_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 50-byte strings leave their texts; a character that a cut splits goes with them."""
    return suffix_dedup.cut_texts(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("ids")


STAGES = [("quality", good_quality), ("lines", no_repeated_lines), ("near_copies", no_near_copies), ("substrings", no_repeated_bytes), ("packing", into_sequences)]
#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
