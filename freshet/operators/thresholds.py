"""Thresholds from history: annual maxima, Gumbel fits, and what they give each reach."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import schemas as S
from freshet.functions import scalars as X
from freshet.sources.clustered import forget_clustered, read_clustered, write_clustered
from freshet.sources.tables import drop_path, drop_scratch, observed, scratch_path, write_scratch


def annual_maxima(history: DataFrame, keys: Sequence[str] = ("lat", "lon"), flow: str = "flow_cms", time: str = "time") -> DataFrame:
    """(keys, maxima: one for each year, ascending); values that are null, NaN or not positive don't count."""
    rows = history.where(X.finite(flow) & (F.col(flow) > 0))
    yearly = rows.groupBy(*keys, F.year(time).alias("year")).agg(F.max(flow).alias("top"))
    return yearly.groupBy(*keys).agg(F.array_sort(F.collect_list("top")).alias("maxima"))


def gumbel_fits(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood (loc, scale) of consecutive samples of the given sizes, all by one bisection for the root of
    scale - mean + weighted mean; NaN where there is none. Values that aren't finite don't count."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = np.isfinite(values)
    x, owner = values[good], owner[good]
    n = np.bincount(owner, minlength=len(sizes))
    low, high = np.full(len(sizes), np.inf), np.full(len(sizes), -np.inf)
    np.minimum.at(low, owner, x)
    np.maximum.at(high, owner, x)
    fits = (n >= 2) & (low < high)
    kept = fits[owner]
    x, owner = x[kept], (np.cumsum(fits) - 1)[owner[kept]]
    n, low, high = n[fits], low[fits], high[fits]
    total = lambda y: np.bincount(owner, weights=y, minlength=len(n))
    mean, above = total(x) / n, x - low[owner]
    spread = np.sqrt(np.maximum(total(x * x) / n - mean**2, 0))

    def excess(scale: np.ndarray) -> np.ndarray:
        w = np.exp(-above / scale[owner])
        return scale - mean + total(x * w) / total(w)

    a, b = 1e-9 * np.maximum(1.0, spread), 4 * (high - low)
    while len(n) and (short := excess(b) < 0).any():
        b = np.where(short, 2 * b, b)
    for _ in range(200):
        middle = (a + b) / 2
        up = excess(middle) > 0
        a, b = np.where(up, a, middle), np.where(up, middle, b)
        if (b - a <= 1e-15 * b).all():
            break
    scale = (a + b) / 2
    loc, out = np.full(len(sizes), np.nan), np.full(len(sizes), np.nan)
    out[fits] = scale
    loc[fits] = low - scale * np.log(total(np.exp(-above / scale[owner])) / n)
    return loc, out


def gumbel_fit(samples: np.ndarray) -> tuple[float, float]:
    """(loc, scale) of one sample."""
    loc, scale = gumbel_fits(np.asarray(samples, float), np.array([len(samples)]))
    return float(loc[0]), float(scale[0])


def _fit(samples: str) -> Column:
    """struct(loc, scale) of an array column, fitted a batch at a time."""

    @F.pandas_udf("loc double, scale double")
    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in batches:
            parts = [np.asarray(x, dtype=float) for x in lists]
            loc, scale = gumbel_fits(np.concatenate([np.zeros(0), *parts]), np.array([len(x) for x in parts], dtype=np.int64))
            yield pd.DataFrame({"loc": loc, "scale": scale})

    return fit(samples)


def gumbel_quantile(loc: Column, scale: Column, period: float) -> Column:
    return loc - scale * F.lit(float(np.log(-np.log(1 - 1 / period))))


def gumbel_thresholds(maxima: DataFrame, periods: Sequence[int] = (2, 5, 20), min_n: int = 5, samples: str = "maxima") -> DataFrame:
    """Quantiles rp_<period> of a fit for rows with at least min_n maxima; failed fits are left out."""
    rows = maxima.where(F.size(samples) >= min_n).withColumn("fit", _fit(samples)).where((F.col("fit.scale") > 0) & ~F.isnan("fit.scale"))
    quantiles = [gumbel_quantile(F.col("fit.loc"), F.col("fit.scale"), p).alias(f"rp_{p}") for p in periods]
    return rows.select(*(c for c in maxima.columns if c != samples), *quantiles, F.size(samples).alias("sample_count"))


def gumbel_by_rounds(values: DataFrame, keys: Sequence[str], value: str, part_rows: int = 200_000, tolerance: float = 1e-11, max_rounds: int = 60) -> DataFrame:
    """(keys, n, loc, scale): maximum-likelihood fits of all groups at once, without a group's values in one place.

    The root of scale - mean + weighted mean, both above the least value, lies between 0 and the first mean. Each group's state (bracket, current scale) is joined with
    the values, which lie in buckets by group; one partial aggregation gives the three sums of a Newton step, kept inside the
    bracket, and groups that have converged drop out. Groups of over ``part_rows`` values are dealt to several
    buckets. Groups of fewer than two different values have no fit and are left out. Values are finite.
    """
    spark = values.sparkSession
    own = [f"k{i}" for i in range(len(keys))]
    rows = write_scratch(values.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(value).alias("x")), "samples")
    x = F.col("x")
    groups = rows.groupBy(*own).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_pop(x).alias("sd"))
    groups = groups.where("low < high").withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
    groups = write_scratch(groups, "groups")
    dealt = F.floor(F.rand(17) * F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    path = scratch_path(spark, "samples")
    write_clustered(rows.join(groups.where("parts > 1").select(*own, "parts"), own, "left").select(*own, dealt, "x"), path, [*own, "part"])
    drop_scratch(rows)
    table = read_clustered(spark, path)
    width = F.col("high") - F.col("low")
    state = groups.select(*own, "n", "parts", "low", F.lit(0.0).alias("a"), width.alias("b"), F.greatest(F.least(F.col("sd") * float(np.sqrt(6) / np.pi), width / 2), width * 1e-6).alias("s"))
    done = []
    for _ in range(max_rounds):
        spread = state.select(*own, "low", "s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        above = x - F.col("low")
        w = F.exp(-above / F.col("s"))
        sums = table.join(spread, [*own, "part"]).groupBy(*own).agg(F.sum(above).alias("span"), F.sum(w).alias("w0"), F.sum(above * w).alias("w1"), F.sum(above * above * w).alias("w2"))
        tail = F.col("w1") / F.col("w0")
        excess = F.col("s") - F.col("span") / F.col("n") + tail
        slope = 1 + (F.col("w2") / F.col("w0") - tail * tail) / (F.col("s") * F.col("s"))
        step = state.join(sums, own).withColumn("f", excess).withColumn("newton", F.col("s") - excess / slope)
        step = step.withColumns({"a": F.when(F.col("f") < 0, F.col("s")).otherwise(F.col("a")), "b": F.when(F.col("f") > 0, F.col("s")).otherwise(F.col("b"))})
        inside = (F.col("newton") >= F.col("a")) & (F.col("newton") <= F.col("b"))
        step = step.withColumn("next", F.when(F.col("f") == 0, F.col("s")).when(inside, F.col("newton")).otherwise((F.col("a") + F.col("b")) / 2))
        step = step.withColumn("settled", F.abs(F.col("next") - F.col("s")) <= tolerance * F.col("s"))
        left = Observation()
        step = step.observe(left, F.count_if(~F.col("settled")).alias("open"))
        step = write_scratch(step.select(*own, "n", "parts", "low", "a", "b", "s", "next", "settled", "w0"), "step")
        done.append(step.where("settled").select(*own, "n", (F.col("low") - F.col("s") * F.log(F.col("w0") / F.col("n"))).alias("loc"), F.col("s").alias("scale")))
        if not observed(left).get("open"):
            break
        state = step.where("not settled").select(*own, "n", "parts", "low", "a", "b", F.col("next").alias("s"))
    else:
        raise ArithmeticError(f"Gumbel fits didn't settle in {max_rounds} rounds")
    forget_clustered(table)
    drop_path(spark, path)
    drop_scratch(groups)
    fits = done[0]
    for more in done[1:]:
        fits = fits.unionByName(more)
    return fits.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), "n", "loc", "scale")


def large_groups(values: DataFrame, keys: Sequence[str], part_rows: int, bins: int = 1 << 16) -> DataFrame:
    """The keys of groups of over ``part_rows`` values. Bins of keys are counted first, which sends ``bins`` rows a task at most;
    only groups of bins that hold so many values are counted one by one."""
    spark = values.sparkSession
    at = F.pmod(F.xxhash64(*keys), F.lit(bins)).alias("bin")
    full = write_scratch(values.select(at).groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") > part_rows).select("bin"), "bins")
    if full.isEmpty():
        drop_scratch(full)
        return spark.createDataFrame([], values.select(*keys).schema)
    counted = values.select(*keys, at).join(full, "bin", "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
    found = write_scratch(counted.where(F.col("n") > part_rows).select(*keys), "large")
    drop_scratch(full)
    return found


def fits_of_groups(rows: DataFrame, keys: Sequence[str], value: str, size: str, place: str) -> DataFrame:
    """(keys, n, loc, scale) of groups that lie one after the other, each with its ``size`` and every row's ``place`` from 1; groups
    without a fit are left out. A task holds the groups of one batch, and the one that is not yet whole."""
    names = [*keys, "n", "loc", "scale"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def fits() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            head = np.flatnonzero(whole.column(place).to_numpy() == 1)
            first = whole.take(pa.array(head))
            loc, scale = gumbel_fits(whole.column(value).to_numpy(), np.diff(np.append(head, whole.num_rows)))
            columns = [*(first.column(k).combine_chunks() for k in keys), first.column(size).combine_chunks(), pa.array(loc), pa.array(scale)]
            return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(np.isfinite(scale)))

        for batch in batches:
            heads = np.flatnonzero(batch.column(batch.schema.get_field_index(place)).to_numpy() == 1)
            cut = int(heads[-1]) if len(heads) else 0
            if len(heads):
                held.append(batch.slice(0, cut))
                if sum(b.num_rows for b in held):
                    yield fits()
                held.clear()
            held.append(batch.slice(cut))
        if held and sum(b.num_rows for b in held):
            yield fits()

    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("loc", T.DoubleType()), T.StructField("scale", T.DoubleType())])
    return rows.select(*keys, size, place, value).mapInArrow(run, schema)


def sized(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``values`` (keys, value) by group and value, with the group's ``n`` and each row's ``place`` in it from 1: one shuffle by group."""
    group = W.partitionBy(*keys)
    rows = values.select(*keys, value).where(reduce(and_, (F.col(k).isNotNull() for k in keys)))
    return rows.withColumn("place", F.row_number().over(group.orderBy(value))).withColumn("n", F.count("*").over(group))


def gumbel_by_groups(values: DataFrame, keys: Sequence[str], value: str, least: int = 1, part_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Fits (keys, n, loc, scale) of the groups of at least ``least`` values, and the values of smaller ones (keys, value, place, n).

    Values are shuffled once, by group, for both results, and a group of up to ``part_rows`` values is fitted where it lies. Larger groups are
    fitted in rounds (:func:`gumbel_by_rounds`), never in one place.
    """
    large = large_groups(values, keys, part_rows)
    none = large.isEmpty()
    rows = sized(values if none else values.join(large, list(keys), "left_anti"), keys, value)
    fits = fits_of_groups(rows.where(F.col("n") >= least), keys, value, "n", "place")
    if not none:
        fits = fits.unionByName(gumbel_by_rounds(values.join(large, list(keys), "left_semi"), keys, value, part_rows))
    return fits, rows.where(F.col("n") < least)


def gumbel_thresholds_of_rows(peaks: DataFrame, keys: Sequence[str], value: str = "top", periods: Sequence[int] = (2, 5, 20), min_n: int = 5) -> DataFrame:
    """As :func:`gumbel_thresholds` for one row for each maximum: (keys, rp_<period>, sample_count)."""
    fits, _ = gumbel_by_groups(peaks.where(X.finite(value)), keys, value, min_n)
    return fits.select(*keys, *(gumbel_quantile(F.col("loc"), F.col("scale"), p).alias(f"rp_{p}") for p in periods), F.col("n").cast("int").alias("sample_count"))


def reach_thresholds_from_history(cells: DataFrame, history: DataFrame, provider: str, gumbel_from: int = 10) -> DataFrame:
    """rp_2, rp_5, rp_25 of each reach from all values of its cell: a Gumbel fit from ``gumbel_from`` values on, else percentiles.

    cells: (provider_reach_id, lat, lon) on the history's grid. Values go once through a shuffle, by cell; see :func:`gumbel_by_groups`.
    """
    at = ["lat", "lon"]
    values = history.where(X.finite("flow_cms")).select(*at, "flow_cms")
    fits, few = gumbel_by_groups(values, at, "flow_cms", gumbel_from)
    marks = (("rp_2", 0.5), ("rp_5", 0.8), ("rp_25", 0.95))
    fitted = fits.select(*at, "n", *(gumbel_quantile(F.col("loc"), F.col("scale"), 1 / (1 - p)).alias(r) for r, p in marks))
    plain = few.groupBy(*at).agg(F.count("*").alias("n"), F.percentile("flow_cms", F.array(*(F.lit(p) for _, p in marks))).alias("q"))
    out = fitted.unionByName(plain.select(*at, "n", *(F.col("q")[i].alias(r) for i, (r, _) in enumerate(marks))))
    rung = lambda r: F.col(r) if r in ("rp_2", "rp_5", "rp_25") else F.lit(None).cast("double")
    rows = cells.select("provider_reach_id", *at).join(out, at)
    return rows.select(F.lit(provider).alias("provider"), "provider_reach_id", *(rung(r).alias(r) for r in S.RUNGS), X.payload_json(sample_count=F.col("n")).alias("metadata_json"))
