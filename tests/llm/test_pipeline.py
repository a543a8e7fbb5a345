import os

import duckdb
import pytest

import corpus_pipeline
from freshet.llm import queries as Q

DATA = os.environ.get("TESTDATA", "/root/testdata")


def test_stages_on_their_own_rows(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "substrings", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, odd, d).count() == 2


def test_stages_are_the_brute_force(spark, docs, corpus):
    """The three dedup stages in a row give the texts that exhaustive versions give, and packing covers them."""
    from test_dedup import brute_components, brute_lines
    from tokenizers import Tokenizer

    from freshet.llm import packing

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    d, stages = f"{DATA}/sf0.001", dict(corpus_pipeline.STAGES)
    lines = stages["lines"](spark, plain, d).cache()
    cut = brute_lines(corpus, 2)
    texts = {i: cut[i][0] if i in cut else None for i, _ in corpus}
    assert {r.doc_id: r.text for r in lines.collect()} == texts
    assert all(r.n_chars == len(r.text or "") for r in lines.collect())
    single = stages["near_copies"](spark, lines, d).cache()
    texts = {i: texts[i] for i, (_, c) in brute_components(texts.items()).items() if i == c}
    assert {r.doc_id: r.text for r in single.collect()} == texts
    bare = stages["substrings"](spark, single, d).cache()
    seen: dict = {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if seen.setdefault(raw[s : s + 50], i) < i:
                gone[s : s + 50] = bytes([1]) * 50
        if texts[i] is not None:
            texts[i] = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in bare.collect()} == texts
    tok = Tokenizer.from_file(packing.default_tokenizer())
    got: dict = {}
    for r in stages["packing"](spark, bare, d).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_quality_stage_is_the_classifier(spark):
    """The stage keeps exactly the rows whose score, from a model of the same labels, reaches 0.7."""
    from freshet.llm import quality

    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, Q.training_labels(spark.read.parquet(f"{d}/labels.parquet")))
    want = sorted(r.doc_id for r in quality.score_statistics(stats, model).where("score >= 0.7").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, d).collect()) == want


def test_training_ids_are_bounded(spark):
    """No more than about the bound, the same ones that fit() takes, and all where they are few."""
    from freshet.llm import quality

    labels = spark.range(4000).selectExpr("id doc_id", "cast(if(id % 10 = 0, null, id % 2) as int) quality").union(spark.createDataFrame([(None, 1), (7, 0)], "doc_id long, quality int"))
    every = {r.doc_id for r in quality.training_ids(labels).collect()}
    assert every == {i for i in range(4000) if i % 10}
    few = [r.doc_id for r in quality.training_ids(labels, max_train_rows=600).collect()]
    assert len(few) == len(set(few)) and set(few) <= every and 500 < len(few) < 700
    assert quality.training_ids(labels.limit(0)).count() == 0


def test_run_is_the_stages(spark):
    d = f"{DATA}/sf0.001"
    assert corpus_pipeline.run(spark, d).where("length > 0").count() > 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_against_sql(spark, name):
    d = f"{DATA}/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        path = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = Q.queries()[name](spark, d)
    columns = sorted(df.columns)
    cursor = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_all_thirteen_are_registered():
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 14)}
