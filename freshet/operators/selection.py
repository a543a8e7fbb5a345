"""Exact percentiles by distributed selection: count by leading digits, keep the bucket that holds the rank, repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.sources.tables import drop_scratch, write_scratch

#: Buckets into which a pass splits an interval of values; with the exponents of the first pass five passes tell all doubles apart.
BUCKETS = 8192
#: Parts into which the values of one group are dealt, should the intervals be too many to broadcast.
PARTS = 32


def _exponent(x: Column) -> Column:
    """Signed binary exponent: at most 4,300 buckets, in the order of the values."""
    own = F.when(F.abs(x) == float("inf"), 5000).otherwise(F.floor(F.log2(F.abs(x))) + 2000)
    return F.when(x == 0, 0).otherwise(F.signum(x) * own).cast("int")


def _digits(x: Column) -> Column:
    """Place of a value in its interval [lo, hi]; its ends fall in the first and the last bucket."""
    return F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def exact_percentiles(rows: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """``keys`` and ``{column}_{name}`` for each probability: exact percentiles with linear interpolation over values that aren't null
    or NaN, for all columns and groups in the same passes.

    A task holds a count for each bucket, never the values: the first pass counts by exponent, each further one by 8,192 steps between the least and the
    greatest value of the bucket that holds a wanted rank, and only values in such buckets are kept for it. Groups without any value are left out; without keys there is
    one row, with nulls if there is no value.
    """
    names = names or [f"p{round(100 * p)}" for p in probabilities]
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns))))
    values = write_scratch(rows.select(key.alias("k"), each.alias("v")).select("k", "v.c", "v.x").where("x is not null and not isnan(x)"), "values")
    held = [F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    counts = write_scratch(values.groupBy("k", "c", _exponent(F.col("x")).alias("b")).agg(*held), "counts")

    # ranks from 0 and their weights, two neighbours for each percentile
    at = (F.col("total") - 1) * F.col("p.p")
    low, part = F.floor(at), at - F.floor(at)
    wanted = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probabilities))))
    ends = F.array(F.struct(low.alias("rank"), (1 - part).alias("weight")), F.struct((low + 1).alias("rank"), part.alias("weight")))
    totals = counts.groupBy("k", "c").agg(F.sum("n").alias("total")).select("k", "c", "total", wanted.alias("p"))
    ranks = totals.select("k", "c", F.col("p.j").alias("j"), F.explode(ends).alias("e")).select("k", "c", "j", "e.rank", "e.weight").where("weight > 0")
    ranks = write_scratch(ranks, "ranks")

    def pick(targets: DataFrame, buckets: DataFrame, within: list[str]) -> DataFrame:
        """Each target's bucket: the rank that is left in it, and its least and greatest value."""
        after = F.sum("n").over(W.partitionBy(*within).orderBy("lo").rowsBetween(W.unboundedPreceding, 0))
        sums = buckets.withColumn("after", after)
        found = targets.join(sums, within).where((F.col("left") >= F.col("after") - F.col("n")) & (F.col("left") < F.col("after")))
        return found.select("k", "c", "rank", (F.col("left") - F.col("after") + F.col("n")).alias("left"), "lo", "hi")

    targets = write_scratch(pick(ranks.select("k", "c", "rank", F.col("rank").alias("left")).distinct(), counts, ["k", "c"]), "targets")
    scratch, settled = [counts], []
    while True:
        settled.append(targets.where("lo = hi"))
        open_ = targets.where("lo < hi")
        if not open_.limit(1).count():
            break
        intervals = open_.select("k", "c", "lo", "hi").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        own = values.select("k", "c", "x").withColumn("part", F.pmod(F.xxhash64("x"), F.lit(PARTS)).cast("int"))
        kept = write_scratch(own.join(intervals, ["k", "c", "part"]).where("x >= lo and x <= hi").select("k", "c", "lo", "hi", "x"), "values")
        drop_scratch(values)
        values = kept
        counts = kept.groupBy("k", "c", F.col("lo").alias("from"), _digits(F.col("x")).alias("b")).agg(*held)
        targets = write_scratch(pick(open_.select("k", "c", "rank", "left", F.col("lo").alias("from")), counts, ["k", "c", "from"]), "targets")
    drop_scratch(values, *scratch)
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    both = ranks.join(found.select("k", "c", "rank", F.col("lo").alias("x")), ["k", "c", "rank"])
    value = lambda i, j: F.sum(F.when((F.col("c") == i) & (F.col("j") == j), F.col("weight") * F.col("x")))
    aggregates = [value(i, j).alias(f"{c}_{n}") for i, c in enumerate(columns) for j, n in enumerate(names)]
    if not keys:
        return both.agg(*aggregates)
    return both.groupBy("k").agg(*aggregates).select(*(F.col("k").getField(c).alias(c) for c in keys), *(f"{c}_{n}" for c in columns for n in names))
