"""Nearest neighbours in the plane by a count-driven quadtree, for any density of points.

Base tiles are a little larger than the search radius, so a point's 3 x 3 tiles hold all that it can reach. Tiles with more than
``LEAF`` sites are split in four until none has more, in rounds over the tiles that are still too full. Points descend the tree together, one
level a round: the counts and boxes of a point's tiles bound how far its k-th site can be, and tiles that begin beyond that are left
out, so a point meets a few leaves of at most ``LEAF`` sites, however many lie around it. Leaves that many points meet are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.sources.tables import write_scratch

LEAF, PART_PAIRS, DEPTH = 512, 4096, 40


def euclid(dy: Column, dx: Column) -> Column:
    return F.sqrt(dy * dy + dx * dx)


def city_block(dy: Column, dx: Column) -> Column:
    return dy + dx


def _tile(c: Column, size: float, level: int) -> Column:
    return F.floor(c * F.lit(2.0**level / size)).cast("bigint")


def _tiles(sites: DataFrame, size: float, level: int) -> DataFrame:
    return sites.withColumns({"ty": _tile(F.col("y"), size, level), "tx": _tile(F.col("x"), size, level)})


def quadtree(sites: DataFrame, size: float, leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame]:
    """Levels and leaves of (y, x) sites: for each level its tiles (ty, tx, n, box, full); and the sites with level, ty and tx of their leaf.

    A tile is full, and split, if it holds more than ``leaf`` sites that don't all lie on one spot."""
    levels, leaves, rest = [], [], sites
    box = [F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")]
    for level in range(DEPTH):
        tiled = _tiles(rest, size, level)
        full = (F.col("n") > leaf) & ((F.col("y0") < F.col("y1")) | (F.col("x0") < F.col("x1"))) & F.lit(level < DEPTH - 1)
        nodes = write_scratch(tiled.groupBy("ty", "tx").agg(*box).withColumn("full", full), "tiles")
        levels.append(nodes)
        split = nodes.where("full").select("ty", "tx")
        if not split.limit(1).count():
            leaves.append(tiled.withColumn("level", F.lit(level)))
            break
        leaves.append(tiled.join(split, ["ty", "tx"], "left_anti").withColumn("level", F.lit(level)))
        deeper = write_scratch(tiled.join(split, ["ty", "tx"], "left_semi").drop("ty", "tx"), "sites")
        rest = deeper
    return levels, reduce(DataFrame.unionByName, leaves)


def meetings(points: DataFrame, levels: Sequence[DataFrame], size: float, k: int, radius: float, metric=euclid) -> DataFrame:
    """(id, y, x, level, ty, tx): the leaves that can hold one of a point's k nearest sites within ``radius``."""
    own = ["id", "y", "x"]
    around = lambda: F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    front = _tiles(points.select(*own), size, 0).withColumn("dy", around()).withColumn("dx", around())
    front = front.select(*own, F.lit(float(radius)).alias("reach"), (F.col("ty") + F.col("dy")).alias("ty"), (F.col("tx") + F.col("dx")).alias("tx"))
    near = lambda c, a, b: F.greatest(F.col(a) - F.col(c), F.col(c) - F.col(b), F.lit(0.0))
    far = lambda c, a, b: F.greatest(F.abs(F.col(c) - F.col(a)), F.abs(F.col(c) - F.col(b)))
    half = lambda: F.explode(F.array(F.lit(0), F.lit(1)))
    # a billionth, and more than distances are rounded by
    within = F.col("near") <= F.col("reach") * (1 + 1e-9) + 1e-8
    out = []
    for level, nodes in enumerate(levels):
        met = front.join(nodes, ["ty", "tx"]).withColumn("near", metric(near("y", "y0", "y1"), near("x", "x0", "x1"))).where(within)
        if len(levels) > 1:  # the k-th site is no farther than the farthest corner of the tiles that hold k; what an earlier level gave still holds
            met = met.withColumn("far", metric(far("y", "y0", "y1"), far("x", "x0", "x1")))
            sites = F.sum("n").over(W.partitionBy(*own).orderBy("far").rangeBetween(W.unboundedPreceding, 0))
            enough = F.min(F.when(F.col("sites") >= k, F.col("far"))).over(W.partitionBy(*own))
            met = met.withColumn("sites", sites).withColumn("reach", F.least("reach", enough)).where(within)
        out.append(met.where("not full").select(*own, F.lit(level).alias("level"), "ty", "tx"))
        if level + 1 < len(levels):
            down = met.where("full").withColumn("dy", half()).withColumn("dx", half())
            front = write_scratch(down.select(*own, "reach", (F.col("ty") * 2 + F.col("dy")).alias("ty"), (F.col("tx") * 2 + F.col("dx")).alias("tx")), "front")
    return reduce(DataFrame.unionByName, out)


def near_sites(points: DataFrame, sites: DataFrame, k: int, radius: float, metric=euclid, leaf: int = LEAF) -> DataFrame:
    """(id, site) pairs that hold each point's k nearest sites within ``radius``, and more: choose among them by exact distance.

    points: (id, y, x); sites: (y, x, site), site being any struct. Of sites on one spot the k least count, as no more can be chosen."""
    size = radius * 1.0001
    spot = F.row_number().over(W.partitionBy("y", "x").orderBy("site"))
    single = write_scratch(sites.where("y is not null and x is not null").withColumn("spot", spot).where(F.col("spot") <= k).drop("spot"), "sites")
    levels, placed = quadtree(single, size, max(leaf, k))
    met = meetings(points.where("y is not null and x is not null").distinct(), levels, size, k, radius, metric)
    if len(levels) == 1:
        return _pairs(met, placed)
    return _pairs(write_scratch(met, "meetings"), placed)


def _pairs(met: DataFrame, placed: DataFrame) -> DataFrame:
    """The join of points with the sites of their leaves; leaves that many points meet are dealt by point, with a copy of their few sites for each part."""
    at = ["level", "ty", "tx"]
    parts = met.groupBy(*at).agg(F.ceil(F.count("*") / PART_PAIRS).cast("int").alias("parts"))
    dealt = met.join(parts.where("parts > 1"), at, "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = placed.join(parts, at).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*at, "part", "site")
    return dealt.join(copies, [*at, "part"]).select("id", "site")

