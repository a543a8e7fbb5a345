"""Ranked search, language identification and whitening against brute force, and their defined cases."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from freshet.llm import language_id, queries, ranked_search, whitening

SMALL = "/root/testdata/sf0.001"
CLASH = "rank score item terms tf n doc t x row whitened deviation lang_pred margin rejected own documents".split()


def with_names(df, names=CLASH):
    return df.select("*", *(F.lit(j).alias(n) for j, n in enumerate(names) if n not in df.columns))


# --- ranked search ------------------------------------------------------------------------------


def terms_of(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(ranked_search.TERM, lower)


def brute_ranks(docs, items, k):
    counts = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i].update(terms_of(t))
    out = {}
    for item, terms in wanted.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return {i: v for i, v in out.items() if v}


def ranks(spark, docs, items, k):
    d = with_names(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    q = with_names(spark.createDataFrame(items, "item_id long, text string"))
    got = collections.defaultdict(list)
    for r in ranked_search.best_documents(d, q, k).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    return dict(got)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(3)
    words = ["the"] * 60 + [f"w{i}" for i in range(60)] + ["Été", "DÉJÀ", "naïve", "x1", "日本"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "!", "-y", "\x7f"]) for _ in range(rng.randrange(1, 90)))) for i in range(400)]
    docs += [(400 + i, t) for i, t in docs[:40]]  # ties
    docs += [(500, None), (501, ""), (502, " .,!\n"), (None, "w1 w2 the"), (3, docs[3][1]), (503, "w5-" * 30_000), (504, "THE the The")]
    items = [(i, " ".join(rng.sample(words, 12))) for i in range(25)] + [(30, "w1 W2 the"), (30, "w7"), (31, None), (32, "..."), (33, "absent"), (None, "w1"), (34, "été ÉTÉ DÉJÀ")]
    return docs, items


def test_ranked_search_equals_brute_force(spark, searched, monkeypatch):
    docs, items = searched
    want = brute_ranks(docs, items, 7)
    for shard, page, window in ((16_384, 2048, 4_000_000), (37, 5, 1000)):
        monkeypatch.setattr(ranked_search, "SHARD_ROWS", shard)
        monkeypatch.setattr(ranked_search, "PAGE_ITEMS", page)
        monkeypatch.setattr(ranked_search, "WINDOW_BYTES", window)
        assert ranks(spark, docs, items, 7) == want


def test_ranked_search_of_few_or_no_rows(spark, searched):
    docs, items = searched
    assert ranks(spark, docs[:3], items, 50) == brute_ranks(docs[:3], items, 50)
    assert ranks(spark, [], items, 50) == ranks(spark, docs, [], 50) == {}
    assert ranks(spark, [(1, "a b")], [(1, "a b")], 50) == brute_ranks([(1, "a b")], [(1, "a b")], 50)


def test_range_maxima():
    rng = np.random.default_rng(1)
    for docs in (1, 2, 50):
        doc, term = (x.ravel() for x in np.meshgrid(np.arange(docs), np.arange(3), indexing="ij"))
        keep = rng.random(len(doc)) < 0.7
        impact = rng.integers(1, 9, len(doc))
        shard = ranked_search.Shard(np.arange(docs), doc[keep].astype(np.int32), term[keep], impact[keep])
        for a in range(len(shard.doc)):
            for b in range(a + 1, len(shard.doc) + 1):
                if shard.key[a] // docs == shard.key[b - 1] // docs:
                    total, best = shard.maxima(np.array([[a]]), np.array([[b]]))
                    assert total[0] == shard.impact[a:b].max() == shard.impact[best[0]] and a <= best[0] < b


def test_the_search_leaves_most_documents_out():
    """The bounds end a search: with one rare term and a frequent one few documents are scored."""
    n = 8000
    doc = np.concatenate([np.arange(n), np.arange(0, n, 400)]).astype(np.int32)
    term = np.concatenate([np.zeros(n, np.int64), np.ones(n // 400, np.int64)])
    impact = np.concatenate([np.full(n, 5) + np.arange(n) % 3, np.full(n // 400, 1000)])
    scores, ids, scored = ranked_search.Shard(np.arange(n), doc, term, impact).top(np.array([0, 1]), 10, np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert scored < n / 20
    exact = np.bincount(doc, weights=impact).astype(int)
    best = sorted((-s, i) for i, s in enumerate(exact))[:10]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == best


def test_ranked_search_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = sorted(map(tuple, queries.op11_ranked_search(spark, SMALL).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == sorted(db.execute(queries.oracle_sql()["op11_ranked_search"]).fetchall())


# --- language identification --------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op12_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) >= 0.97


def test_predictions_equal_plain_compression(spark, docs):
    model = language_id.fit(docs.select("text", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb").alias("lang")))
    rows = language_id.identify(docs, model).collect()
    for r in rows:
        text = re.sub(r"[\W\d_]+", " ", (r.text or "").lower())
        if not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        raw = f" {text.strip(' ')} ".encode()
        sizes = []
        for d in model.dictionaries:
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[i : i + language_id.PIECE_BYTES])) for i in range(0, len(raw), language_id.PIECE_BYTES)))
        assert r.lang_pred == model.langs[int(np.argmin(sizes))]
        assert r.margin == pytest.approx(max(sizes) / min(sizes) - 1) and r.rejected == (r.margin < 0.005)


def test_language_cases(spark, docs):
    long = "mot à mot " * 200_000
    rows = [(1, "der und die", "de"), (2, "le et la été", "fr"), (3, None, "de"), (4, "123 !?", "de"), (5, "x", None), (6, long, "fr"), (6, long, "fr"), (7, "", "fr")]
    table = with_names(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = language_id.fit(table)
    assert model.langs == ("fr", "de") and all(len(d) <= language_id.DICTIONARY_BYTES for d in model.dictionaries)
    out = language_id.identify(table, model)
    assert set(out.columns) == set(table.columns) | set(language_id.RESULT) and len(out.columns) == len(set(out.columns))
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].lang_pred == "de" and got[2].lang_pred == got[6].lang_pred == "fr"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 7))
    assert got[5].n == table.where("doc_id = 5").first().n
    assert language_id.identify(table.limit(0), model).count() == 0
    none = language_id.identify(table, language_id.fit(table.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = language_id.identify(table, language_id.fit(table.where("lang = 'de'"))).where("doc_id = 2").first()
    assert (one.lang_pred, one.score, one.rejected) == ("de", 1.0, False)
    assert language_id.fit(table, max_langs=1).langs == ("fr",)


# --- whitening ----------------------------------------------------------------------------------


def covariance(x):
    y = np.array([[int(v) for v in r] for r in x], dtype=object)
    n = len(y)
    s = y.sum(axis=0)
    z = n * y - s  # exact
    return np.array((z.T @ z), dtype=object) / n**3


def residual(v, values, vectors):
    v = v.astype(float)
    size = np.abs(v).max()
    return max(np.abs(v @ vectors - vectors * values).max() / size, np.abs(vectors.T @ vectors - np.eye(len(v))).max())


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "rank one", "tiny gaps"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(2)
    d = 24
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = {"spread": np.arange(1.0, d + 1), "clustered": np.r_[np.full(6, 5.0) + np.arange(6) * 1e-9, np.arange(1.0, d - 5)], "equal": np.full(d, 3.0), "rank one": np.r_[7.0, np.zeros(d - 1)], "tiny gaps": 1 + np.arange(d) * 1e-7}[kind]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.eigen(v)
    assert (np.diff(values) <= 0).all()
    assert residual(v, values, vectors) < 2e-14
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * e.max())


def test_float32_alone_would_not_do():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 16))
    v = a.T @ a
    start = np.linalg.eigh(v.astype(np.float32))
    assert residual(v, start[0].astype(float), start[1].astype(float)) > 1e-9
    assert residual(v, *whitening.eigen(v)) < 1e-14


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 40
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(300 + i, rows[0][1]) for i in range(150)]  # a third of all are one vector
    return [*rows, (0, rows[1][1]), (None, rows[2][1]), (600, None), (601, [1.0, None]), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (604, [1.0]), (605, []), (606, [1e300] * 6)]


def test_whitening_equals_brute_force(spark, vectors):
    table = with_names(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4))
    out, model, error = whitening.whiten(table, components=4)
    assert len(out.columns) == len(set(out.columns)) and set(table.columns) <= set(out.columns)
    used = [(i, [math.floor(256 * c) for c in v] + [0] * (6 - len(v))) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e200 for c in v)]
    fit = sorted({tuple(v) for _, v in used})
    n, s = len(fit), np.array(fit, dtype=object).sum(axis=0)
    assert model.n == n and list(model.sums) == list(s)
    v = covariance(fit)
    assert residual(v, model.values, model.vectors) < 1e-14
    assert error < 1e-9
    centered = np.array([[float(n * c - t) / n for c, t in zip(x, s, strict=True)] for _, x in used])
    want = collections.Counter((i, sum(int(n * c - t) ** 2 for c, t in zip(x, s, strict=True)), tuple(np.round(w, 8))) for (i, x), w in zip(used, centered @ model.vectors[:, :4] / np.sqrt(model.values[:4]), strict=True))
    assert collections.Counter((r.vec_id, r.deviation, tuple(np.round(r.whitened, 8))) for r in out.collect()) == want


def test_whitening_cases(spark, vectors):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], vectors[:1], [vectors[0]] * 5, [(1, None)], [(1, [])]):
        out, model, error = whitening.whiten(table(rows), components=4)
        assert sum(len(r.whitened) for r in out.collect()) == 0 and model.rank == 0 and error == 0
    out, model, error = whitening.whiten(table([(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [3.0, 6.0])]), components=4)
    assert model.rank == 1 and error < 1e-12
    assert sorted(round(r.whitened[0], 9) for r in out.collect()) == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    far, model, _ = whitening.whiten(table([(0, [2.0**44, 0.0]), (1, [2.0**44 + 1, 0.0])]), components=4)
    assert sorted(r.deviation for r in far.collect()) == [256**2] * 2 and model.values[0] == 128**2
    assert {r.deviation for r in whitening.whiten(table([(0, [0.0]), (1, [2.0**44])]))[0].collect()} == {None}


def test_whitening_query(spark):
    rows = queries.op13_whitening(spark, SMALL).collect()
    assert {r.component for r in rows} == {1, 2, 3, 4} and {type(r.n) for r in rows} == {int}
    assert max(r.identity_error for r in rows) < 1e-9
    each = collections.defaultdict(set)
    for r in rows:
        each[r.component].add(r.explained)
    assert all(len(v) == 1 for v in each.values()) and sorted((v.pop() for v in each.values()), reverse=True)[0] < 1


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_language_id", "op13_whitening"])
def test_registered(name):
    assert name in queries.queries()
