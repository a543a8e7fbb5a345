"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Each document is its sequence of non-blank lines, each named by a 64-bit hash. Lines that occur once end every repeat, so
only positions of repeated lines, and those right after them, are suffixes that take part. Their ranks are
found by prefix doubling: Spark joins each suffix's rank with the rank at the current offset, sorts the distinct
pairs over range partitions, and adds their numbers in that order to their ranks, which so become ranks of twice the length.
A suffix whose rank is its own retires: its rank is final, and it is only looked up from then on. The end of a document sorts before every line and equals
nothing. Doubling stops when all ranks are unique, and all ranks together are the suffix array
(:func:`suffix_ranks`). The runs need the ranks' classes only, so there suffixes that retire are not kept.

The ranks of each round are the array's longest-common-prefix intervals of that length: suffixes of one rank share so many
lines, and the interval knows its earliest member. A later suffix is compared with the earliest member of the
longest interval in which it isn't the earliest itself: their longest common prefix comes from the ranks of the
rounds, longest first, as a sum of lengths. It is a maximal repeated run (:func:`repeated_runs`). Lines in runs of at least
``min_lines`` lines are deleted; the earliest copy stays.

A hot line is one row of the sort, as distinct pairs are counted before it, with partial sums; the join that hands ranks
back splits its rows.

Cases: a null or empty text has no lines; blank lines (only spaces, tabs, carriage returns) take no part and
stay; runs never cross documents, and overlap inside one document counts (of A A A with two lines, the first
A stays); rows of one doc_id with equal texts count as one document and are all cut alike, with different
texts as documents in the order of the texts' hashes; rows with a null doc_id stay whole; an empty table gives an
empty table. :func:`drop_repeated_lines` keeps further columns, whatever their names; columns named n_lines,
n_removed or n_runs are replaced by its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.sources.tables import observed

from .common import drop_scratch, packed, unpacked, write_scratch

BLANKS = " \t\r"
PLACE = ["doc_id", "th", "i"]
#: Rounds whose lookups are one plan; then the runs are written.
LOOKUPS = 3


def solid(line: Column) -> Column:
    """Whether a line has more than blanks."""
    return F.trim(line, F.lit(BLANKS)) != ""


def line_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, th, i, line, after, rest): i-th non-blank line of a document, its hash and that of the next, and how many lines there are from it on."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.when(solid(x), F.xxhash64(x))), lambda x: x.isNotNull())
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), lines.alias("x")).dropDuplicates(["doc_id", "th"])
    pairs = F.transform("x", lambda line, i: F.struct(line.alias("line"), F.try_element_at("x", (i + 2).cast("int")).alias("after"), (F.size("x") - i).alias("rest")))
    return rows.select("doc_id", "th", pairs.alias("x")).select("doc_id", "th", F.posexplode("x").alias("i", "l")).select(*PLACE, "l.line", "l.after", "l.rest")


def suffix_rounds(positions: DataFrame, min_lines: int, ordered: bool = False) -> tuple[list[tuple[int, DataFrame]], list[DataFrame]]:
    """(length, active) of each round, and the tables of retired suffixes (doc_id, th, i, rank).

    active: (doc_id, th, i, rest, rank, size, first) of the suffixes that share their first ``length`` lines with others; size is the number of their
    class's members and first the earliest of them. A rank is the list of the numbers that its class got in each round's sort, so ranks of different rounds
    compare; the first number is the line's hash. A suffix whose class has no other member, or that ends, retires with its final rank; active ones
    still look it up. Without ``ordered`` none is looked up: a suffix whose next rank isn't active is alone in its class, whatever the order, so
    each round's work is its active suffixes only, and no table of retired ones is kept. Lengths double, from 1 to ``min_lines`` and on from there, until no suffix is active."""
    place = F.struct(*PLACE)
    positions = write_scratch(positions, "positions")
    # the first ranks are the lines' hashes: they sort, and equal lines have equal ones
    lines = positions.groupBy("line").agg(F.count("*").alias("size"), F.min(place).alias("first")).where("size > 1")
    shared = Observation()
    active = positions.join(lines, "line").select(*PLACE, "rest", "after", F.array("line").alias("rank"), "size", "first").observe(shared, F.count(F.lit(1)).alias("n"))
    active = write_scratch(active, "ranks")
    drop_scratch(positions)
    retired = []
    if ordered:  # lines that occur once, right after a repeated one
        repeated = active.groupBy(F.col("rank")[0].alias("after")).agg(F.count("*").alias("n")).select("after")
        last = active.where("after is not null").select("doc_id", "th", (F.col("i") + 1).alias("i"), "after").join(repeated, "after", "left_anti")
        retired.append(write_scratch(last.select(*PLACE, F.array("after").alias("rank")), "ranks"))
    rounds, length, open_ = [(1, active)], 1, observed(shared).get("n")
    while open_:
        step = min(length, min_lines - length if length < min_lines else length)
        goes_on = active.where(F.col("rest") > step)
        if length == 1:
            goes_on = goes_on.withColumn("next", F.array("after"))
        else:
            known = active.select(*PLACE, "rank")
            for part in retired:
                known = known.unionByName(part)
            goes_on = goes_on.join(known.select("doc_id", "th", (F.col("i") - step).alias("i"), F.col("rank").alias("next")), PLACE)
        goes_on = goes_on.select(*PLACE, "rest", "rank", "next", F.struct(*(F.lit(None).cast(t).alias(c) for c, t in active.select(*PLACE).dtypes)).alias("end"))
        # an end is a class of its own, by place, before all others of its rank
        ends = active.where(F.col("rest") <= step).select(*PLACE, "rest", "rank", F.array().cast("array<bigint>").alias("next"), place.alias("end"))
        rows, keys = (goes_on.unionByName(ends), ["rank", "next", "end"]) if ordered else (goes_on.drop("end"), ["rank", "next"])
        classes = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.min(place).alias("first"))
        if not ordered:
            classes = classes.where("size > 1")
        numbered = classes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("new", F.monotonically_increasing_id())
        shared = Observation()
        ranked = rows.join(numbered, keys).select(*PLACE, "rest", (F.concat("rank", F.array("new")) if ordered else F.array("new")).alias("rank"), "size", F.when(F.col("size") > 1, F.col("first")).alias("first"))
        ranked = write_scratch(ranked.observe(shared, F.count_if(F.col("size") > 1).alias("n")), "ranks")
        active, length, open_ = ranked.where("size > 1"), length + step, observed(shared).get("n")
        rounds.append((length, active))
        if ordered:
            retired.append(ranked.where("size = 1").select(*PLACE, "rank"))
    return rounds, retired


def suffix_ranks(positions: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """(length, ranks) of each round: (doc_id, th, i, rank, size) of all suffixes, the last one's order being the suffix array's; rank as text."""
    rounds, retired = suffix_rounds(positions, min_lines, ordered=True)
    text = F.array_join(F.transform("rank", lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")), "").alias("rank")
    out = []
    for k, (length, active) in enumerate(rounds):
        rows = active.select(*PLACE, text, "size")
        for part in retired[: k + 1]:
            rows = rows.unionByName(part.select(*PLACE, text, F.lit(1).cast("bigint").alias("size")))
        out.append((length, rows))
    return out


def repeated_runs(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """Runs that an earlier position has too: (doc_id, th, start, stop, first), numbers of non-blank lines, stop
    exclusive, and the earlier position. Runs inside another with the same earlier copy are left out."""
    rounds, _ = suffix_rounds(line_positions(docs), min_lines)
    place = F.struct(*PLACE)
    top = lambda k, length: F.struct(F.lit(k).alias("round"), F.lit(length).cast("long").alias("length"), "first").alias("top")
    late = rounds[0][1].select(*PLACE, top(0, 0)).limit(0)
    for k, (length, active) in enumerate(rounds):
        if length >= min_lines:
            late = late.unionByName(active.where(place != F.col("first")).select(*PLACE, top(k, length)))
    tops = late.groupBy(*PLACE).agg(F.max("top").alias("top")).select(*PLACE, "top.*")
    by_doc = W.partitionBy("doc_id", "th").orderBy("i")
    before = F.lag(F.struct("i", "first")).over(by_doc)
    follows = (before["i"] == F.col("i") - 1) & (before["first"]["doc_id"] == F.col("first.doc_id")) & (before["first"]["th"] == F.col("first.th")) & (before["first"]["i"] == F.col("first.i") - 1)
    runs = write_scratch(tops.withColumn("inside", F.coalesce(follows, F.lit(False))).where("not inside").drop("inside"), "runs")
    for k in range(len(rounds) - 2, -1, -1):  # the longest common prefix with the earlier position, longest lengths first
        length, ranks = rounds[k]
        own = ranks.select("doc_id", "th", F.col("i").alias("spot"), F.col("rank").alias("own"))
        other = ranks.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("i").alias("s"), F.col("rank").alias("other"))
        met = runs.withColumn("spot", F.when(F.col("round") > k, F.col("i") + F.col("length"))).join(own, ["doc_id", "th", "spot"], "left")
        met = met.join(other, (F.col("first.doc_id") == F.col("d")) & (F.col("first.th") == F.col("t")) & (F.col("first.i") + F.col("length") == F.col("s")), "left")
        longer = F.col("length") + F.when(F.col("own") == F.col("other"), F.lit(length)).otherwise(F.lit(0))
        runs = met.select(*PLACE, "round", longer.alias("length"), "first")
        if k % LOOKUPS == 0:
            runs = write_scratch(runs, "runs")
    return runs.select("doc_id", "th", F.col("i").cast("long").alias("start"), (F.col("i") + F.col("length")).cast("long").alias("stop"), "first")


def merged_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, th, start, stop): overlapping and adjacent runs of a document as one."""
    before = W.partitionBy("doc_id", "th").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("doc_id", "th").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0)
    opens = runs.withColumn("opens", F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int"))
    return opens.withColumn("n", F.sum("opens").over(so_far)).groupBy("doc_id", "th", "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("n")


def drop_repeated_lines(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """``docs`` with its columns, text cut, and new columns n_lines, n_removed, n_runs.

    The text of rows without a later copy is as it was; a text whose lines all go is empty. Texts meet their runs in a hash
    join at every size: the runs of a partition are hashed, the texts pass by and aren't sorted.
    """
    own = ("n_lines", "n_removed", "n_runs")
    runs = merged_runs(repeated_runs(docs.select("doc_id", "text"), min_lines)).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("th"), packed(docs.drop("text"))).join(runs.hint("shuffle_hash"), ["doc_id", "th"], "left")
    lines = F.split("text", "\n", -1)
    spots = F.filter(F.transform("lines", lambda x, i: F.when(solid(x), i)), lambda i: i.isNotNull())
    gone = F.flatten(F.transform("runs", lambda r: F.slice("solid", (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    out = rows.withColumn("lines", F.when(F.col("text").isNotNull(), lines)).withColumn("solid", F.when(F.col("runs").isNotNull(), spots)).withColumn("gone", F.when(F.col("runs").isNotNull(), gone))
    columns = dict(zip([c for c in docs.columns if c not in own], unpacked(docs, own), strict=True)) | {"text": text.alias("text")}
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return out.select(*columns.values(), *(count(c).alias(n) for c, n in zip(("lines", "gone", "runs"), own, strict=True)))
