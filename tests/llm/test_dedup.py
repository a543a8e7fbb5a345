import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from freshet.llm import line_dedup, ngram_join, substring_dedup, suffix_dedup
from freshet.llm.common import components


def brute_bytes(corpus, span=50):
    seen, out = {}, {}
    for i, text in sorted(corpus):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if seen.setdefault(b[s : s + span], i) < i:
                gone[s : s + span] = b"\1" * span
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(docs, corpus, no_docs, spark):
    removed = suffix_dedup.remove_repeats(docs)
    assert removed.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.kept_digest(removed).collect()}
    assert got == brute_bytes(corpus)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    cut = suffix_dedup.cut_texts(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    odd = spark.createDataFrame([(None, "q" * 80), (3, "q" * 80), (3, "q" * 80), (4, "q" * 80)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect()) == [("3", 0), ("3", 0), ("4", 80), ("None", 0)]


def test_suffix_dedup_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_TEXT", 1000)
    import random

    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(5000))
    corpus = [(1, a), (2, "#" + a[900:2100] + "#" + a[4000:4200]), (3, a[::-1])]
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.kept_digest(suffix_dedup.remove_repeats(df)).collect()}
    assert got == brute_bytes(corpus)


def shingles(text, k=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(corpus):
    sets = {i: shingles(t) for i, t in corpus}
    name = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(name[i], name[j])
            if name[i] != low or name[j] != low:
                name[i] = name[j] = low
                changed = True
    return {i: (len(sets[i]), name[i]) for i in sets}


def test_ngram_join(docs, corpus, no_docs, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, frequent_at_least=3).collect()}
    assert got == brute_components(corpus)
    large = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, frequent_at_least=3, small_bucket=2).collect()}
    assert large == got
    assert ngram_join.jaccard_components(no_docs).count() == 0
    kept = ngram_join.keep_one(docs)
    want = {i for i, (_, c) in got.items() if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd).collect()) == [("1", 2, 1), ("2", 2, 1), ("2", 2, 1), ("9", 0, 9), ("None", 2, None)]


def test_ngram_join_null_id_before_a_near_copy(spark):
    """A row without an id doesn't stand for the document with its text; rows of one id with different texts stay."""
    words = [f"w{i}" for i in range(80)]
    rows = [(None, " ".join(words)), (5, " ".join(words)), (3, " ".join(words[:79] + ["x"])), (8, "a b c d e f"), (8, "a b c d e f"), (8, "g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == {(None, None), (5, 3), (3, 3), (8, 8)}
    kept = sorted((str(r.doc_id), r.text) for r in ngram_join.keep_one(df).collect())
    assert kept == sorted((str(i), t) for i, t in [rows[0], rows[2], rows[3], rows[5]])


def test_group_blocks(spark):
    """Blocks smaller than a group lose no link."""
    base = [f"w{i}" for i in range(60)]
    corpus = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(1, 58, 3)]
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    groups = df.select(F.lit(0).cast("long").alias("lead"), "doc_id", F.col("doc_id").alias("component_id"))
    links = ngram_join.link_components(groups, df, 5, 80, block=4)
    got = {r.id: r.component_id for r in components(links).collect()}
    want = {i: c for i, (_, c) in brute_components(corpus).items()}
    assert {i: got.get(i, i) for i in want} == want


def test_group_blocks_stay_linear(spark):
    """A group of one large component and a few others is sent about once, and an outsider's link is found."""
    base = [f"w{i}" for i in range(60)]
    corpus = [(i, " ".join(base[:55] + [f"x{i}"] + base[56:])) for i in range(600)] + [(600, " ".join(base[:57] + ["a", "b", "c"])), (601, " ".join(f"q{i}" for i in range(40)))]
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    groups = df.select(F.lit(0).cast("long").alias("lead"), "doc_id", F.when(F.col("doc_id") < 600, 0).otherwise(F.col("doc_id")).cast("long").alias("component_id"))
    links = [(r.a, r.b) for r in ngram_join.link_components(groups, df, 5, 80, block=16).collect()]
    assert links and all({a, b} & {600} for a, b in links)
    sent = ngram_join.block_pairs(groups, 16).count()
    assert sent <= 602 + 2 * (600 // 16 + 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (50, 51), (51, 52), (60, 60)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 1, 50: 50, 51: 50, 52: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(corpus, least):
    seen, out = {}, {}
    order = sorted((i, t) for i, t in corpus if t is not None)
    for i, text in order:
        lines = text.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for s in range(len(solid) - least + 1):
            key = tuple(lines[k] for k in solid[s : s + least])
            if seen.setdefault(key, (i, s)) != (i, s):
                gone |= set(range(s, s + least))
        cut = {solid[s] for s in gone}
        runs = sum(s - 1 not in gone for s in gone)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in cut), len(lines), len(gone), runs)
    return out


def test_line_dedup(docs, corpus, no_docs, spark):
    for least in (1, 2, 3):
        cut = line_dedup.drop_repeated_lines(docs, least)
        assert cut.columns[: len(docs.columns)] == docs.columns
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in cut.collect()}
        want = brute_lines(corpus, least)
        assert {i: v for i, v in got.items() if i in want} == want
        assert all(v == (None, 0, 0, 0) for i, v in got.items() if i not in want)
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0
    odd = spark.createDataFrame([(None, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, "x\na\nb\n\ny")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.drop_repeated_lines(odd).collect()) == [("1", "a\nb"), ("1", "a\nb"), ("2", "x\n\ny"), ("None", "a\nb")]


def test_fuzzy_passages(docs, corpus, no_docs):
    rows = substring_dedup.fuzzy_passages(docs).collect()
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in corpus}
    covered = defaultdict(set)
    for r in rows:
        assert r.first_doc_id < r.doc_id and r.stop - r.start >= 50 and 0.8 <= r.identity <= 1
        assert r.stop <= len(words[r.doc_id]) and r.first_stop <= len(words[r.first_doc_id])
        covered[r.doc_id] |= set(range(r.start, r.stop))
    seen: dict = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            if seen.setdefault(tuple(words[i][s : s + 50]), i) < i:
                assert set(range(s, s + 50)) <= covered[i], (i, s)
    assert substring_dedup.fuzzy_passages(no_docs).count() == 0


def test_fuzzy_passages_of_a_mosaic(spark):
    """A repeat whose seeds first occur in different documents, each under 50 words, meets the document that holds it all."""
    first, second = ([f"{c}{i}" for i in range(30)] for c in "pq")
    around = lambda i: [f"x{i}n{j}" for j in range(20)]
    texts = [first, second, first + second, first + second, around(4) + second + first, around(5) + second + first + around(6)]
    texts += [around(7) + first[5:] + second[:24], around(8) + first[6:] + second[:26] + around(9)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = substring_dedup.fuzzy_passages(docs).collect()
    covered = defaultdict(set)
    for r in rows:
        assert r.first_doc_id < r.doc_id and r.stop - r.start >= 50 and 0.8 <= r.identity <= 1
        covered[r.doc_id] |= set(range(r.start, r.stop))
    seen: dict = {}
    for i, words in enumerate(texts):
        for s in range(len(words) - 49):
            if seen.setdefault(tuple(words[s : s + 50]), i) < i:
                assert set(range(s, s + 50)) <= covered[i], (i, s)
    assert covered[3] == set(range(60)) and 4 not in covered


def test_fuzzy_passages_with_regular_changes(spark):
    """60 words with every 6th to 10th changed (identity 0.83 to 0.9), at each offset, are found."""
    rows, want = [], {}
    for every in (6, 7, 8, 10):
        for offset in range(every):
            n = len(rows)
            own = lambda i: [f"o{i}n{j}" for j in range(15)]
            passage = [f"p{n}n{j}" for j in range(60)]
            changed = [f"c{n}n{j}" if j % every == offset else x for j, x in enumerate(passage)]
            rows += [(n, " ".join(own(n) + passage + own(n + 1000))), (n + 1, " ".join(own(n + 1) + changed + own(n + 1001)))]
            want[n + 1] = n
    got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.first_doc_id for r in got} == want


def test_chain_and_align():
    import numpy as np

    a = np.arange(100)
    b = np.concatenate([np.arange(500, 510), a[:40], [900, 901], a[41:]])
    pos = np.array([3, 20, 60, 80, 50])
    other = np.array([13, 30, 71, 91, 5])
    ends = lambda x: (x + 5).tolist()
    chains = substring_dedup.chain(pos.tolist(), ends(pos), other.tolist(), ends(other), [5] * 5, 5, 0.05, 45)
    assert chains[0] == [0, 1, 2, 3] and [4] in chains
    s, e, s2, e2, same = substring_dedup.align(a, b, pos[:4], other[:4], 5)
    assert (s, e, s2, e2, same) == (0, 100, 10, 111, 99)
    order, opens = substring_dedup.diagonal_segments(np.array([0, 0, 0, 0, 1]), np.array([9, 1, 4, 30, 31]), np.array([19, 11, 14, 40, 41]), 10)
    assert order.tolist() == [1, 2, 0, 3, 4] and opens.tolist() == [0, 3, 4]


def best_chain(segments, k, gap_cost):
    """Highest score of any chain, by trying every predecessor."""
    order = sorted(range(len(segments)), key=lambda i: (segments[i][0], segments[i][2]))
    score = {}
    for i in order:
        p, _, q, _, words = segments[i]
        gains = [score[j] - gap_cost * (p - segments[j][1] + q - segments[j][3]) for j in score if segments[j][1] - k < p and segments[j][3] - k < q and j != i]
        score[i] = words + max([0.0, *gains])
    return max(score.values())


def test_chain_is_the_best_of_all():
    import random

    rng = random.Random(3)
    for _ in range(200):
        segments = []
        for _ in range(rng.randrange(1, 12)):
            p, q, n = rng.randrange(80), rng.randrange(80), rng.randrange(5, 20)
            segments.append((p, p + n, q, q + n, n))
        columns = [list(c) for c in zip(*segments, strict=True)]
        chains = substring_dedup.chain(*columns, 5, 0.05, 1000)
        total = lambda c: sum(segments[i][4] for i in c) - 0.05 * sum(segments[b][0] - segments[a][1] + segments[b][2] - segments[a][3] for a, b in zip(c, c[1:], strict=False))
        assert abs(max(map(total, chains)) - best_chain(segments, 5, 0.05)) < 1e-9
        assert sorted(i for c in chains for i in c) == list(range(len(segments)))


def test_line_ranks_are_a_suffix_array(spark):
    """Ranks sort like suffixes, each round's ranks are its longest-common-prefix intervals, runs are longest common prefixes."""
    import random

    rng = random.Random(5)
    corpus = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))) for i in range(25)]
    corpus += [(i + 100, t) for i, t in corpus[:6]]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    name = {r.text: r.h for r in spark.createDataFrame([("a",), ("b",), ("c",)], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    suffix = {(i, k): [name[x] for x in t.split("\n")[k:]] for i, t in corpus if t for k in range(len(t.split("\n")))}
    for least in (1, 2, 3):
        rounds = line_dedup.suffix_ranks(line_dedup.line_positions(docs), least)
        lengths = [n for n, _ in rounds]
        assert lengths[0] == 1 and least in lengths and lengths[-1] >= max(map(len, suffix.values()))
        last = sorted((r["rank"], suffix[r.doc_id, r.i]) for r in rounds[-1][1].collect())
        assert len(last) == len(suffix) == len({r for r, _ in last})
        assert [s for _, s in last] == sorted(suffix.values())
        for length, ranks in rounds:
            groups = defaultdict(set)
            for r in ranks.where("size > 1").collect():
                groups[r["rank"]].add((r.doc_id, r.i))
            want = defaultdict(set)
            for at, s in suffix.items():
                if len(s) >= length:
                    want[tuple(s[:length])].add(at)
            assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        th = {r.doc_id: r.th for r in docs.select("doc_id", F.xxhash64("text").alias("th")).collect()}
        for r in line_dedup.repeated_runs(docs, least).collect():
            assert (r["first"].doc_id, th[r["first"].doc_id], r["first"].i) < (r.doc_id, th[r.doc_id], r.start)
            assert r.stop - r.start == common(suffix[r.doc_id, r.start], suffix[r["first"].doc_id, r["first"].i]) >= least


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_fuzzy_recall_and_precision(spark):
    """Passages of 60 to 150 words, changed by substitutions, deletions, insertions or moved parts, in documents that share
    common phrases: nearly all of identity 0.85 and more are found, and what is found is alike, by exhaustive alignment."""
    import random

    rng = random.Random(11)
    common = [[f"c{p}w{j}" for j in range(8)] for p in range(30)]

    def filler(n):
        out = []
        while len(out) < n:
            out += rng.choice(common) if rng.random() < 0.3 else [f"f{rng.randrange(10**9)}" for _ in range(8)]
        return out

    rows, want, words = [], {}, {}
    for case in range(150):
        passage = [f"p{case}w{j}" for j in range(rng.randrange(60, 150))]
        share, changed = rng.choice([0.03, 0.07, 0.12]), []
        for x in passage:
            u = rng.random()
            changed += [] if u < share / 3 else [x, f"n{rng.randrange(10**9)}"] if u < share * 2 / 3 else [f"s{rng.randrange(10**9)}"] if u < share else [x]
        if case % 5 == 0:
            half = len(changed) // 2
            changed = changed[half:] + filler(10) + changed[:half]
        first, late = 2 * case, 2 * case + 1
        for i, body in ((first, passage), (late, changed)):
            words[i] = [*filler(rng.randrange(20, 60)), *body, *filler(rng.randrange(20, 60))]
            rows.append((i, " ".join(words[i])))
        alike = longest_common(passage, changed) / max(len(passage), len(changed))
        if alike >= 0.85:
            want[late] = first
    got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    for r in got:
        a, b = words[r.doc_id][r.start : r.stop], words[r.first_doc_id][r.first_start : r.first_stop]
        assert r.stop - r.start >= 50 and longest_common(a, b) >= r.matches and r.matches / max(len(a), len(b)) >= 0.8
    found = {(r.doc_id, r.first_doc_id) for r in got}
    recall = sum(pair in found for pair in want.items()) / len(want)
    precision = sum(b == a - 1 for a, b in found) / len(found)
    assert len(want) > 80 and recall >= 0.95 and precision == 1, (recall, precision)


def test_ngram_join_moves_only_documents_of_pairs(spark):
    """Prefixes and texts of the last comparison are those of its pairs; rows without an id or a pair stay behind."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(10)] + [(None, "none"), (4, "again")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 4), (4, 7), (1, 99)], "a long, b long")
    got = sorted((r.doc_id, r.text) for r in ngram_join.of_pairs(rows, pairs).collect())
    assert got == [(1, "text 1"), (4, "again"), (4, "text 4"), (7, "text 7")]


def test_ngram_join_compares_likely_pairs_only(spark, monkeypatch):
    """Texts that share a third share too little of their prefixes to be read again."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    corpus = []
    for i in range(0, 120, 2):
        own = [rng.choice(words) + str(i) for _ in range(200)]
        near = i % 6 == 0
        other = own[:195] + ["x"] * 5 if near else own[:60] + [rng.choice(words) + "y" for _ in range(140)]
        corpus += [(i, " ".join(own)), (i + 1, " ".join(other))]
    asked = []
    whole = ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, docs, *rest: (asked.append((pairs.count(), docs.count())), whole(pairs, docs, *rest))[1])
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i % 6 in (0, 1) else i for i in range(120)}
    assert asked[0][0] <= 25 and asked[0][1] <= 50, asked


def test_fuzzy_passage_whose_seeds_have_other_documents_around_it(spark):
    """50 has a changed passage of 20; each of its pieces lies in an earlier and in a later document than 20, too."""
    pieces = [[f"p{j}x{i}" for i in range(7)] for j in range(8)]
    alone = lambda doc, piece: [f"a{doc}x{i}" for i in range(30)] + piece + [f"b{doc}x{i}" for i in range(30)]
    corpus = {j: alone(j, piece) for j, piece in enumerate(pieces)} | {30 + j: alone(30 + j, piece) for j, piece in enumerate(pieces)}
    for doc in (20, 50):
        corpus[doc] = alone(doc, [word for j, piece in enumerate(pieces) for word in [*piece, f"c{doc}x{j}"]])
    rows = spark.createDataFrame([(doc, " ".join(words)) for doc, words in corpus.items()], "doc_id long, text string").coalesce(1)  # one slice: what is found would else depend on the slices
    found = {(r.doc_id, r.first_doc_id) for r in substring_dedup.fuzzy_passages(rows).collect()}
    assert found == {(50, 20)}


def test_fuzzy_passages_compare_likely_pairs_only(spark, monkeypatch):
    """A line that opens and ends a text, 50 words apart, isn't taken for two seeds of documents that have it once."""
    line = [f"l{i}" for i in range(13)]
    fill = lambda doc, n: [f"f{doc}x{i}" for i in range(n)]
    corpus = {i: fill(i, 40) + line + fill(1000 + i, 40) for i in range(30)} | {i: line + fill(i, 37) + line for i in range(100, 105)}
    asked = []
    whole = substring_dedup.asking_pairs
    monkeypatch.setattr(substring_dedup, "asking_pairs", lambda *args: (whole(*args), asked.append(whole(*args).count()))[0])
    rows = spark.createDataFrame([(i, " ".join(words)) for i, words in corpus.items()], "doc_id long, text string").coalesce(1)
    assert substring_dedup.fuzzy_passages(rows).count() == 0
    assert asked == [10]  # those that have it twice


def test_may_extend():
    """Whenever the words around two seeds extend them, six bits of each of five words tell so."""
    import numpy as np

    rng, hits = np.random.default_rng(3), 0
    for _ in range(2000):
        a, b = rng.integers(0, 12, 14).astype(np.uint64), rng.integers(0, 12, 14).astype(np.uint64)
        i, j = int(rng.integers(0, 10)), int(rng.integers(0, 10))
        x, y = (substring_dedup.flanks(w, np.array([0]), np.array([14]), np.array([at]), 5, none) for w, at, none in ((a, i, 0), (b, j, 1)))
        for left, grown in ((False, substring_dedup._extend(a[i + 5 :], b[j + 5 :], 64)), (True, substring_dedup._extend(a[:i][::-1], b[:j][::-1], 64))):
            may = bool(substring_dedup.may_extend(x >> 30, y >> 30)[0] if left else substring_dedup.may_extend(x, y)[0])
            assert may or grown == (0, 0, 0)
            hits += not may
    assert hits > 500


def test_seeds_meet_in_blocks(spark):
    """A document's seeds go once to each block, not once for each document it is compared with; what meets there is what meets pair by pair."""
    import numpy as np

    rng = np.random.default_rng(4)
    text = {i: rng.integers(0, 12, 30).astype(np.int64) for i in range(300)} | {1000: np.arange(40) % 9, 1001: np.repeat(3, 40), 7: np.repeat(3, 30)}
    flank = lambda i, at: i * 1000 + at
    row = lambda i: (i, text[i].tolist(), list(range(len(text[i]))), [flank(i, at) for at in range(len(text[i]))])
    kind = "doc_id long, seeds array<long>, at array<int>, flanks array<long>"
    held = spark.createDataFrame([row(i) for i in range(300)], kind).repartition(3)
    asks = spark.createDataFrame([(*row(i), list(range(300))) for i in (1000, 1001)], kind + ", others array<long>")
    spread = substring_dedup.spread_seeds(held, 4).unionByName(substring_dedup.spread_seeds(asks, 4)).sort("block", "kind").toArrow()
    assert sum(len(x.as_py()) for x, k in zip(spread["seeds"], spread["kind"], strict=True) if k.as_py()) == 4 * 80 * 8
    got = []
    for pair, doc, place, near, around in substring_dedup.shared_seeds(spread.to_batches(), 5, 30):
        got += zip(substring_dedup._pair(doc, pair).tolist(), doc.tolist(), (place >> 32).tolist(), (place & (1 << 32) - 1).tolist(), near.tolist(), around.tolist(), strict=True)
    want = []
    for doc in (1000, 1001):
        for other in range(300):
            for seed in np.unique(text[doc]):
                a, b = np.flatnonzero(text[doc] == seed), np.flatnonzero(text[other] == seed)
                if len(a) * len(b) > substring_dedup.REPEATS:
                    twos = [(x, b[0]) for x in a] + [(x, y) for n, (x, y) in enumerate(zip(a, b, strict=False)) if n]
                else:
                    twos = [(x, y) for x in a for y in b]
                want += [(other, doc, x, y, flank(doc, x), flank(other, y)) for x, y in twos]
    assert sorted(got) == sorted(want)
