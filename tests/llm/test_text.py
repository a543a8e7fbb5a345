import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import chat_format, packing, quality, sentencepiece_viterbi


def test_packing(docs, corpus, no_docs, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in corpus}
    rows = packing.pack(docs, window=256, shard_docs=8).collect()
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            assert np.frombuffer(r.ids, "<u2").tolist() == part.tolist()
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0
    assert packing.pack(no_docs).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.doc_tokens) for r in packing.pack(odd).collect()) == [("1", 1), ("1", 1), ("None", 2)]


def test_packing_fills_windows_with_lexical_neighbours():
    parts = [np.array(x) for x in ([1, 1, 2, 3], [9, 8, 9, 8], [1, 2, 3, 3], [8, 8, 9, 7])]
    shard = packing.Shard(parts, np.ones(20), 4.0)
    assert shard.ranked(0, np.array([False, True, True, True])).tolist()[0] == 2
    assert [[p[0] for p in w] for w in shard.windows([4] * 4, 8)] == [[0, 2], [1, 3]]
    assert [sum(p[2] for p in s) for s in packing.powers_of_two([(0, 0, 5), (1, 0, 6)])] == [8, 2, 1]


def test_packing_scores_are_bm25_over_all_ids():
    rng = np.random.default_rng(3)
    parts = [np.minimum(rng.zipf(1.3, rng.integers(5, 60)), 400) for _ in range(90)]
    n, size = len(parts), np.array([len(x) for x in parts])
    idf = np.log1p((n - 3.0) / (np.arange(401) + 1))
    shard = packing.Shard(parts, idf, size.mean())
    for seed in range(0, n, 7):
        want = [sum(idf[t] * (x == t).sum() * 2.2 / ((x == t).sum() + 1.2 * (0.25 + 0.75 * len(x) / size.mean())) for t in set(parts[seed]) & set(x)) for x in parts]
        got = shard.ranked(seed, np.ones(n, bool))
        assert (np.diff(np.array(want)[got]) < 1e-9).all()


def test_packing_frequent_ids_count(spark):
    """Ids that half of all rows hold outweigh one rare id that a row shares with its neighbour in the shard."""
    base = ["river bank flow gauge level reach basin storm rain delta", "lock tide lake pond marsh creek brook spring ford weir"]
    rows = [(i, f" {base[i % 2]} {1000 + i // 2 * 37}") for i in range(60)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=28).where("length > 4").collect()
    windows: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        windows.setdefault(p.sequence_id, []).append(p.doc_id % 2)
    pairs = [w[0] == w[1] for w in windows.values() if len(w) > 1]
    assert len(pairs) > 10 and sum(pairs) / len(pairs) > 0.8


def test_tokenizer_is_the_librarys(corpus):
    tok = packing.FastTokenizer(packing.default_tokenizer())
    assert tok.merge is not None
    texts = [t or "" for _, t in corpus] + ["a  b\t\n c", "<|endoftext|> x", "日本 語 ñ 😀", " lead", "it's we'll 12 34", "  x y"]
    assert tok.encode(texts) == tok.whole(texts)


def brute_segment(model, word):
    best = [(0.0, [])] + [None] * len(word)
    floor = min(s for p, s in zip(model.pieces, model.scores, strict=True) if p) - 10
    known = {p: (i, s) for i, (p, s) in enumerate(zip(model.pieces, model.scores, strict=True)) if p}
    for j in range(1, len(word) + 1):
        for i in range(j):
            piece = word[i:j]
            if piece in known:
                score = best[i][0] + known[piece][1]
            elif j - i == 1:
                score = best[i][0] + floor
            else:
                continue
            if best[j] is None or score > best[j][0]:
                ids = [known[piece][0]] if piece in known else [model.byte_ids[b] for b in piece.encode()]
                best[j] = (score, best[i][1] + ids)
    return best[len(word)][1]


@pytest.fixture(scope="module")
def model():
    return sentencepiece_viterbi.PieceModel.read()


def test_viterbi_against_brute_force(model):
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("aeiounrstlé日😀\n") for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    got = model.segment(words)
    for w in words:
        assert got[w] == brute_segment(model, w), w


def test_sentencepiece_round_trip(docs, corpus, no_docs, model, spark):
    read = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs, model), model)
    assert {r.doc_id: r.text for r in read.collect()} == {i: t or "" for i, t in corpus}
    assert sentencepiece_viterbi.encode(no_docs, model).count() == 0
    texts = ["a  b", "  x ", "▁mark", "日本\t😀", " "]
    odd = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    read = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(odd, model), model)
    assert sorted(r.text for r in read.collect()) == sorted(t.replace("▁", " ") for t in texts)


def test_chat_round_trip(spark):
    rows = [(1, 1, "user", "</s><s>[INST] \\l \\\\ \x1f ]"), (1, 2, "assistant", "a[b]\\u"), (1, 3, "assistant", None), (1, 0, None, "sys"), (2, 0, "assistant", "ok"), (None, 0, "user", "x"), (2, 0, "assistant", "ok"), (3, 5, "a]b<", "\x1f\\")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, t int")
    read = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(table)).collect()}
    for conv in (1, 2, 3, None):
        want = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [(x.role, x.text) for x in read[conv].turns] == [(r, x) for _, r, x in want]
        assert read[conv].loss_texts == [x for _, r, x in want if r == "assistant"]
    assert read[1].formatted.count("<s>[") == 3  # adjacent assistant turns are one block
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_quality_learns_and_handles_edges(spark, docs, no_docs):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "over", "stones"]) + rng.choice(["", "s", "y"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW"]) + "!!" for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    stats = quality.document_statistics(table)
    model = quality.fit(stats, labels)
    scores = {r.doc_id: r.score for r in quality.score_statistics(stats, model).collect()}
    assert min(scores[i] for i in range(200, 300) if i % 3) >= 0.7 > max(scores[i] for i in range(200, 300) if not i % 3)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert quality.score_statistics(quality.document_statistics(docs), model).where("score between 0 and 1").count() == docs.count()
    assert quality.keep_good(no_docs, model).count() == 0
    blank = quality.fit(quality.document_statistics(no_docs), labels)
    assert {r.score for r in quality.score_statistics(stats, blank).collect()} == {0.5}
    level = quality.pooled_adjacent_violators(np.arange(4.0), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))[1]
    assert level.tolist() == [0.0, 0.5, 1.0]


def test_statistics_read_the_whole_text():
    import pyarrow as pa

    a, b = "the river ran. " * 4000, "the river ran. " * 4000 + "!" * 4000
    x = quality.text_statistics(pa.array([a, b, None, ""]))
    assert not np.allclose(x[0], x[1]) and not x[2].any() and not x[3].any()
    assert hashlib.sha256(quality.text_statistics(pa.array([a])).tobytes()).digest() == hashlib.sha256(x[:1].tobytes()).digest()


def test_viterbi_of_long_words(model):
    """Words beyond the shared-prefix limit get the ids of the exhaustive search, in bounded memory."""
    rng = random.Random(8)
    for alphabet in ("aeiounrstlé日😀\n", "a", "ab"):
        word = "▁" + "".join(rng.choice(alphabet) for _ in range(300))
        assert np.frombuffer(model.segment_long(word), "<u2").tolist() == brute_segment(model, word)
    text = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    assert model.decode([np.frombuffer(model.encode([text])[0], "<u2")]) == [text]
    assert not any(len(w) > sentencepiece_viterbi.LONG_WORD for w in model._words)


def test_quality_is_the_ridge_and_isotonic_solution(spark):
    """Weights, out-of-fold bins and calibration levels as one process computes them from all rows."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "river", "ran", "BUY", "now!!", "12"]) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    labels = [(i, int(len(t) % 7 > 2)) for i, t in rows]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(quality.document_statistics(table), marks, n_features=24)
    import pyarrow as pa

    x, y = quality.text_statistics(pa.array([t for _, t in rows])), np.array([q for _, q in labels], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z = model.lift(x)
    penalty = np.diag(np.full(z.shape[1], 3.0))
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    hashes = {r.doc_id: r.h for r in table.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    fold = np.array([hashes[i] for i, _ in rows]) % quality.FOLDS
    raw = np.zeros(len(rows))
    for k in range(quality.FOLDS):
        rest = fold != k
        raw[fold == k] = z[fold == k] @ np.linalg.solve(z[rest].T @ z[rest] + penalty, z[rest].T @ y[rest])
    bins = np.clip(np.round(raw * 500), -2000, 3000)
    edges = np.unique(bins)
    mean, weight = np.array([y[bins == b].mean() for b in edges]), np.array([(bins == b).sum() for b in edges])
    # the isotonic mean at i: the largest, over starts up to i, of the smallest mean of a stretch from there to i or beyond
    stretch = lambda a, b: (mean[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum()
    want = [max(min(stretch(a, b) for b in range(i, len(edges))) for a in range(i + 1)) for i in range(len(edges))]
    assert np.allclose(np.unique(np.round(want, 9)), np.unique(np.round(model.levels, 9)), atol=1e-6)
    raw_all = z @ model.weights
    assert np.allclose(model.score(x), np.clip(0.999 * np.interp(raw_all, model.knots, model.levels) + 0.001 / (1 + np.exp(-np.clip(4 * (raw_all - 0.5), -30, 30))), 0, 1))
