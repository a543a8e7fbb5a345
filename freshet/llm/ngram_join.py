"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document's set holds the distinct hashes of its 5-word shingles. Two documents link when the Jaccard
similarity of their sets reaches the threshold. Under any total order of all shingles, two such sets share
a shingle among their first ``n - ceil(t * n) + 1``, and at least as many as ``enough_shared`` says. Two orders are used;
both put shingles that many documents have last, and differ in a hash:

1. the first order's prefixes are joined shingle by shingle;
2. a candidate pair must also share enough shingles within its prefixes under every other order;
3. what is left is verified on the whole sets, recomputed from the whole texts.

No bucket is expanded into all its pairs. First every member of a bucket is paired with the bucket's
leaders only (one for each class of set sizes), verified, and linked documents get a component. Then
buckets that still hold several components are looked at again, so that no link between two components is lost.
Of buckets up to ``small_bucket`` documents the pairs are counted, and those that share enough of their prefixes
verified; larger buckets are compared as groups, in blocks inside the tasks, and only links that join two components
are written out.

Which shingles are frequent is found over all documents: every batch of a task reports those it saw more
than once and the counts are added. At most ``max_frequent`` go to the tasks (8 bytes each). This set
steers the order only, never the result.

Cases: a null or empty text, or one without words, has the empty set and no link; fewer words than
``k`` make one shingle of the whole sequence; copies of a row, and rows of one doc_id, count as one
node of the graph; rows with a null doc_id get a null component; an empty table gives an empty one.
Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_slices, components, drop_scratch, list_array, mix64, mix_pair, signed, text_buffers, word_hashes, write_scratch

ORDER_SALTS = (101, 202)


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and the sets' sizes."""
    data, offsets = text_buffers(texts)
    words, _, _, firsts = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.diff(firsts)
    doc = np.repeat(np.arange(n), counts)
    parts_h, parts_d = [], []
    if len(words) >= k:
        h = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            h = mix_pair(h, words[i : len(words) - k + 1 + i])
        inside = doc[k - 1 :] == doc[: len(doc) - k + 1]
        parts_h.append(h[inside])
        parts_d.append(doc[: len(h)][inside])
    for size in range(1, k):  # short texts: the whole sequence
        which = np.flatnonzero(counts == size)
        if len(which):
            h = words[firsts[which]].copy()
            for i in range(1, size):
                h = mix_pair(h, words[firsts[which] + i])
            parts_h.append(mix64(h + np.uint64(size)))
            parts_d.append(which)
    if not parts_h:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=n)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Prefix length: with fewer shared shingles outside it, the similarity can't be reached."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def enough_shared(n: Column, m: Column, percent: int) -> Column:
    """Shingles that the prefixes of two sets of this similarity share at least: of all that both sets hold, those beyond
    the prefix that reaches less far can be missing."""
    overlap = F.ceil(percent * (n + m) / (100 + percent))
    prefix = lambda n: n - F.ceil(percent * n / 100) + 1
    return F.least(prefix(n) - n + overlap, prefix(m) - m + overlap)


def _set_hash(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0], np.cumsum(mix64(h ^ np.uint64(77)), dtype=np.uint64)]).astype(np.uint64)
    return mix64(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))


def frequent_shingles(docs: DataFrame, k: int, at_least: int, max_frequent: int) -> np.ndarray:
    """Hashes of shingles that many different sets hold, most frequent last."""

    def run(batches):
        for batch in batches:
            found = []
            for part in byte_slices(batch):
                h, sizes = shingle_sets(part.column(0), k)
                _, first = np.unique(_set_hash(h, sizes), return_index=True)
                mask = np.zeros(len(sizes), bool)
                mask[first] = True
                found.append(np.unique(h[np.repeat(mask, sizes)], return_counts=True))
            if not found:
                continue
            h, c = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            h, group = np.unique(h, return_inverse=True)
            c = np.bincount(group, weights=c).astype(np.int64)
            many = c > 1
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[many])), pa.array(c[many])], names=["h", "c"])

    counts = docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= at_least)
    top = counts.orderBy(F.desc("c"), "h").limit(max_frequent).collect()  # max_frequent rows at most
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def _order_keys(h: np.ndarray, salt: int, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sort keys of one global order: rare shingles by a salted hash, then frequent ones by count."""
    key = mix64(h ^ np.uint64(salt)) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        hit = frequent[at] == h
        key[hit] = np.uint64(1 << 63) + place[at[hit]].astype(np.uint64)
    return key


def prefixes(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, salts=ORDER_SALTS) -> DataFrame:
    """(doc_id, n, set_hash, first: prefix under the first order, others: 32-bit prefixes under the others)."""
    sorted_at = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[sorted_at], sorted_at))

    def run(batches):
        freq, place = shared.value
        for batch in batches:
            for part in byte_slices(batch):
                h, sizes = shingle_sets(part.column(1), k)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                marks = _set_hash(h, sizes)
                once = np.zeros(len(sizes), bool)  # of equal sets in a slice, one takes part
                known = np.flatnonzero(part.column(0).is_valid().to_numpy(zero_copy_only=False))  # rows without an id link to nothing
                once[known[np.unique(marks[known], return_index=True)[1]]] = True
                take = np.where(once, needed(sizes, percent), 0)
                starts = np.cumsum(sizes) - sizes
                inside = np.arange(len(h)) - starts[doc] < take[doc]  # once sorted by document
                cols = []
                for i, salt in enumerate(salts):
                    picked = h[np.lexsort((_order_keys(h, salt, freq, place), doc))][inside]
                    cols.append(list_array(signed(picked), take, pa.int64()) if i == 0 else list_array(picked.astype(np.uint32).view(np.int32), take, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(signed(marks)), *cols], names=["doc_id", "n", "set_hash", "first", *(f"p{i}" for i in range(1, len(salts)))])

    more = "".join(f", p{i} array<int>" for i in range(1, len(salts)))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n long, set_hash long, first array<long>{more}")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) whose whole sets reach the similarity; texts meet on the ids of the pairs."""
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other")

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch):
                for small in byte_slices(part, "other"):
                    h1, n1 = shingle_sets(small.column(2), k)
                    h2, n2 = shingle_sets(small.column(3), k)
                    row = np.arange(len(n1))
                    h = np.concatenate([h1, h2])
                    r = np.concatenate([np.repeat(row, n1), np.repeat(row, n2)])
                    order = np.lexsort((h, r))
                    h, r = h[order], r[order]
                    twice = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
                    common = np.bincount(r[1:][twice], minlength=len(row))
                    good = (common > 0) & (100 * common >= percent * (n1 + n2 - common))
                    yield small.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def near_ids(rows: DataFrame, ids: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """The rows with a doc_id of ``ids``, and a few more: hashes of ``ids`` are marked in a bitmap of ``bits`` bits, 4 MB
    however many there are, which goes to the rows, so that these needn't move. A join has to follow."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    width = 1 << 15  # of Spark's bitmaps
    marks = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / width).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % width).alias("marks"))
    near = rows.where(F.col("doc_id").isNotNull()).withColumn("at", at).withColumn("bucket", F.floor(F.col("at") / width)).join(F.broadcast(marks), "bucket")
    byte = F.conv(F.hex(F.substring("marks", (F.floor(F.col("at") % width / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return near.where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1).select(*rows.columns)


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose doc_id is an end of a pair (a, b), and a few more."""
    return near_ids(rows, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))


def block_pairs(groups: DataFrame, block: int) -> DataFrame:
    """(lead, i, j, doc_id, component_id): each document once for each pair of blocks that it takes part in."""
    sizes = groups.groupBy("lead", "component_id").agg(F.count("*").alias("n")).groupBy("lead").agg(F.max(F.struct("n", "component_id")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / block)
    cut = sizes.select("lead", F.col("top.component_id").alias("largest"), blocks(F.col("top.n")).alias("of_largest"), blocks(F.col("n") - F.col("top.n")).alias("of_others"))
    mine = groups.join(cut, "lead").withColumn("in_largest", F.col("component_id") == F.col("largest"))
    number = lambda n: F.pmod(F.xxhash64("doc_id"), n)
    own = F.when(F.col("in_largest"), F.col("of_others") + number(F.col("of_largest"))).otherwise(number(F.col("of_others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    partners = F.when(F.col("in_largest"), upto(F.col("of_others"))).otherwise(upto(F.col("of_others") + F.col("of_largest")))
    pairs = mine.where("of_others > 0").withColumn("own", own).withColumn("other", F.explode(partners))
    return pairs.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "component_id")


def link_components(groups: DataFrame, docs: DataFrame, k: int, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) that join different components within groups (lead, doc_id, component_id).

    Members of a group's largest component needn't meet each other. They and the others are cut into blocks of
    about ``block`` documents each, and every pair of blocks that are not both of the largest component is one unit of work, so a
    task holds two blocks, and a group with few others is sent about once. Inside a task, whole sets are compared by a product
    of their incidence matrices; pairs are not written out, only the links that still join components.
    """
    keyed = block_pairs(groups, block)
    texts = near_ids(docs.where("text is not null").select("doc_id", "text"), groups)
    rows = keyed.join(texts, "doc_id").select("lead", "i", "j", "doc_id", "component_id", "text").repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")

    def links(group: pa.Table) -> tuple[list[int], list[int]]:
        ids, comps = group.column("doc_id").to_numpy(), group.column("component_id").to_numpy()
        if comps.min() == comps.max():
            return [], []
        h, n = shingle_sets(group.column("text"), k)
        tokens, count = np.unique(h, return_counts=True)
        tokens = tokens[count > 1]
        at = np.searchsorted(tokens, h)
        hit = (at < len(tokens)) & (tokens[np.minimum(at, max(len(tokens) - 1, 0))] == h) if len(tokens) else np.zeros(len(h), bool)
        row, at = np.repeat(np.arange(len(ids)), n)[hit], at[hit]
        common = np.zeros((len(ids), len(ids)), np.float32)  # exact up to 2 ** 24 shingles
        width = max(1, 8_000_000 // len(ids))
        for low in range(0, len(tokens), width):
            part = (at >= low) & (at < low + width)
            x = np.zeros((len(ids), min(width, len(tokens) - low)), np.float32)
            x[row[part], at[part] - low] = 1
            common += x @ x.T
        good = (common > 0) & (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (comps[:, None] != comps[None, :])
        a, b = np.nonzero(np.triu(good, 1))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        out: tuple[list[int], list[int]] = ([], [])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(int(comps[x])), find(int(comps[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out[0].append(int(ids[x]))
                out[1].append(int(ids[y]))
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def close():
            a, b = links(pa.Table.from_batches(held)) if held else ([], [])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                now = tuple(keys[:, low]) if batch.num_rows else key
                if held and now != key:
                    yield close()
                key = now
                if high > low:
                    held.append(batch.slice(low, high - low))
        yield close()

    return rows.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, frequent_at_least: int = 24, max_frequent: int = 1 << 18, small_bucket: int = 32) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    frequent = frequent_shingles(docs, k, frequent_at_least, max_frequent)
    sets = write_scratch(prefixes(docs, k, percent, frequent), "sets")
    usable = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # equal sets join their smallest doc_id
    small = usable.select("doc_id", "n", "set_hash")
    copies = small.join(small.groupBy("set_hash", "n").agg(F.min("doc_id").alias("b")), ["set_hash", "n"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    rep = usable.where(F.size("first") > 0)
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    rows = rep.select("doc_id", "n", band.alias("band"), F.explode("first").alias("h"))
    bucket = W.partitionBy("h")
    met = rows.withColumns({"low": F.min("doc_id").over(bucket), "high": F.max("doc_id").over(bucket)}).where("low < high")
    shared = write_scratch(met.select("h", "doc_id", "n", "band"), "shared")  # rows of shingles that at least two documents select
    # a set's partners have sizes in its own band or a neighbouring one
    leaders = shared.groupBy("h", "band").agg(F.min_by(F.struct("doc_id", "n"), F.xxhash64("doc_id")).alias("leader"))
    near = leaders.select("h", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "leader")
    met = shared.join(near, ["h", "band"])
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    star = met.where((F.col("doc_id") != F.col("leader.doc_id")) & fits(F.col("n"), F.col("leader.n"))).select(F.least("doc_id", "leader.doc_id").alias("a"), F.greatest("doc_id", "leader.doc_id").alias("b")).distinct()

    orders = [c for c in rep.columns if c.startswith("p")]

    def filtered(pairs: DataFrame, rep: DataFrame = rep) -> DataFrame:
        side = lambda end: rep.select(F.col("doc_id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", *orders)))
        out = pairs.join(side("a"), "a").join(side("b"), "b")
        for c in orders:
            alike = F.size(f"{c}_a") - F.size(F.array_distinct(f"{c}_a"))  # shingles whose 32 bits another one has
            out = out.where(F.size(F.array_intersect(f"{c}_a", f"{c}_b")) + alike >= enough_shared(F.col("n_a"), F.col("n_b"), percent))
        return out.select("a", "b").distinct()

    tested = write_scratch(filtered(star), "pairs")
    links = write_scratch(verify(tested, of_pairs(docs, tested), k, percent), "links")  # only texts of pairs move
    copies = write_scratch(copies, "copies")
    found = components(links.unionByName(copies))
    # documents of one bucket whose components still differ
    named = shared.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    whole = {"low": F.min("component_id"), "high": F.max("component_id"), "lead": F.min_by("doc_id", F.xxhash64("doc_id")), "size": F.count("*")}
    mixed = named.withColumns({c: x.over(bucket) for c, x in whole.items()}).where("low < high")
    still = write_scratch(mixed.select("h", "lead", "size", "doc_id", "n", "component_id"), "mixed")
    drop_scratch(shared)
    small = still.where(F.col("size") <= small_bucket)
    x, y = small.alias("x"), small.alias("y")
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component_id") != F.col("y.component_id")) & fits(F.col("x.n"), F.col("y.n")))
    counted = met.groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.count("*").alias("c"), F.max("x.n").alias("n"), F.max("y.n").alias("m"))
    # pairs of a large bucket are compared below
    likely = write_scratch(counted.where(F.col("c") >= enough_shared(F.col("n"), F.col("m"), percent)).select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
    # only prefixes and texts of documents that are left to compare move
    close = write_scratch(filtered(likely, of_pairs(rep, likely)), "pairs")
    near = write_scratch(verify(close, of_pairs(docs, close), k, percent), "links")
    groups = write_scratch(still.where(F.col("size") > small_bucket).select("lead", "doc_id", "component_id").distinct(), "groups")
    across = write_scratch(link_components(groups, docs, k, percent), "links")
    final = components(links.unionByName(near).unionByName(across).unionByName(copies).distinct())
    drop_scratch(tested, likely, close, still, groups, links, near, across, copies)
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component only the row(s) of its smallest doc_id,
    one of equal ones where it repeats. Rows with a null doc_id stay."""
    found = jaccard_components(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    rest = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    known = rest.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return known.unionByName(rest.where(F.col("doc_id").isNull()))
