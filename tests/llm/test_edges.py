"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import chat_format, line_dedup, ngram_join, packing, quality, sentencepiece_viterbi, substring_dedup, suffix_dedup

#: Names that the operators use inside or give their results.
NAMES = "row key whole place places kept kept_bytes n_bytes n_removed n_spans th runs lines solid gone line after rank first size next stats h n seed pos other at ids n_ids sig list part id v t i k x start stop top round length own low high new windows component_id lead band copy h1 n_lines n_runs n_shingles score text_ a b u m".split()


def with_names(df, names):
    return df.select("*", *(F.lit(j).alias(n) for j, n in enumerate(names)))


@pytest.fixture(scope="module")
def odd(spark):
    """(doc_id, text, lang, source, n_chars): 40 rows of ties, copies, nulls, empties and two texts of over a million bytes."""
    rng = random.Random(6)
    words = ["river", "bank", "flow", "gauge", "level", "reach", "basin", "storm"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    long = "\n".join(prose(12) for _ in range(13_000))
    solid = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000))
    texts = [prose(80) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:5] + [None, "", None, "", " \n\t ", long, solid, long, "x", "x"])]
    rows += [(None, None), (None, ""), (None, texts[0]), (None, texts[0]), (3, texts[3]), (3, texts[3]), (3, None)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="module")
def model(odd, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (None, 1)], "doc_id long, quality int")
    return quality.fit(quality.document_statistics(odd), labels)


def sentencepiece(docs):
    own = sentencepiece_viterbi.PieceModel.read()
    read = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs, own), own)
    return read.select("doc_id", "text")


KEEPS_ROWS = {"suffix": suffix_dedup.remove_repeats, "cut": suffix_dedup.cut_texts, "lines": line_dedup.drop_repeated_lines, "ngrams": ngram_join.jaccard_components, "statistics": quality.document_statistics, "sentencepiece": sentencepiece}


@pytest.mark.parametrize("name", sorted(KEEPS_ROWS))
def test_rows_are_kept(odd, name):
    f = KEEPS_ROWS[name]
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    clash = with_names(odd, NAMES)
    out = f(clash)
    assert ids(out) == ids(odd)
    own = [c for c in out.columns if c in NAMES and c not in clash.columns]
    assert not own  # results replace columns of their name
    if name == "cut":
        assert out.columns == clash.columns
        assert out.where(" or ".join(f"`{n}` <> {j}" for j, n in enumerate(NAMES))).count() == 0
    if name in ("suffix", "lines"):
        mine = {"suffix": {"kept_bytes", "n_bytes", "n_removed", "n_spans"}, "lines": {"n_lines", "n_removed", "n_runs"}}[name]
        assert sorted(out.columns) == sorted(clash.columns)
        assert out.where(" or ".join(f"`{n}` <> {j}" for j, n in enumerate(NAMES) if n not in mine)).count() == 0
    assert f(odd.limit(0)).count() == 0


def test_texts_survive(odd):
    want = sorted(str((r.doc_id, r.text or "")) for r in odd.collect())
    assert sorted(str((r.doc_id, r.text)) for r in sentencepiece(odd).collect()) == want


def test_copies_leave(odd, model):
    kept = ngram_join.keep_one(with_names(odd, NAMES))
    assert kept.columns == [*odd.columns, *NAMES]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null and length(text) > 100").select("doc_id").collect()) == [*range(10), 20, 21]
    assert kept.where("doc_id is null").count() == 4
    good = quality.keep_good(with_names(odd, NAMES), model, 0.0)
    assert good.columns == [*odd.columns, *NAMES] and good.count() == odd.count()
    assert ngram_join.keep_one(odd.limit(0)).count() == 0
    assert quality.keep_good(odd.limit(0), model).count() == 0


def test_packing_covers_all(odd):
    pieces = packing.pack(with_names(odd, NAMES))
    total = pieces.agg(F.sum("length")).first()[0]
    texts = odd.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert pieces.where("start = 0").count() == odd.count()
    assert pieces.select("doc_id").distinct().count() == texts.count()
    assert total == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert packing.pack(odd.limit(0)).count() == 0


def test_passages_of_odd_rows(odd):
    rows = substring_dedup.fuzzy_passages(with_names(odd, NAMES)).collect()
    assert {r.doc_id for r in rows} == {10, 11, 12, 13, 14, 22}
    assert all(r.first_doc_id == r.doc_id - 10 for r in rows if r.doc_id < 15)
    assert max(r.stop for r in rows if r.doc_id == 22) == 13_000 * 12
    assert substring_dedup.fuzzy_passages(odd.limit(0)).count() == 0


def test_chats_of_odd_rows(spark):
    long = "word [x] </s> " * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, None, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "")]
    table = with_names(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), NAMES)
    read = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(table)).collect()}
    assert [t.text for t in read[1].turns] == [long] * 3 and read[1].loss_texts == [long] * 2
    assert [(t.role, t.text) for t in read[2].turns] == [("", "")]
    assert read[None].loss_texts == [""]


@pytest.mark.parametrize("number", range(5))
def test_stages_of_odd_rows(spark, odd, number):
    d = "/root/testdata/sf0.001"
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, with_names(odd, NAMES), d)
    if name != "packing":
        assert out.columns == [*odd.columns, *NAMES]
        assert out.where(" or ".join(f"`{n}` <> {j}" for j, n in enumerate(NAMES))).count() == 0
    assert out.count() > 0 or name == "quality"
    assert stage(spark, odd.limit(0), d).count() == 0
