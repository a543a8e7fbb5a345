"""Equi-joins and nearest-point joins between reaches, cells, thresholds and forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.functions import scalars as X
from freshet.operators import nearest
from freshet.sources.tables import write_scratch


def join_reach_attributes(meta: DataFrame, attributes: DataFrame, key: str = "LINKNO") -> DataFrame:
    """Metadata and attributes of a reach by its id as text."""
    as_id = lambda df: df.withColumn("reach_id", X.normalize_reach_id(key, dict(df.dtypes)[key] in ("double", "float"))).drop(key)
    return as_id(meta).join(as_id(attributes), "reach_id")


def _on_supported(df: DataFrame, rp: DataFrame, provider: str | None, how: str, trimmed: bool = False) -> DataFrame:
    rows = rp if provider is None else rp.where(F.col("provider") == provider)
    if trimmed:
        return df.join(rows.select("provider", "provider_reach_id"), ["provider", "provider_reach_id"], how)
    known = rows.select("provider", F.trim("provider_reach_id").alias("supported_id"))
    return df.join(known, (F.trim(df["provider_reach_id"].cast("string")) == known["supported_id"]) & (df["provider"] == known["provider"]), how)


def supported_only(df: DataFrame, rp: DataFrame, provider: str | None = None, trimmed: bool = False) -> DataFrame:
    """Rows whose reach has a ladder of its provider; ids are compared as trimmed text. trimmed: ids are trimmed text on both sides already, as in
    stored tables, so that clustered ones join in their buckets."""
    return _on_supported(df, rp, provider, "left_semi", trimmed)


def dropped_unsupported(df: DataFrame, rp: DataFrame, provider: str | None = None) -> DataFrame:
    """(provider, dropped): rows that supported_only leaves out."""
    return _on_supported(df, rp, provider, "left_anti").groupBy("provider").agg(F.count("*").alias("dropped"))


def attach_thresholds(summaries: DataFrame, rp: DataFrame) -> DataFrame:
    return summaries.join(rp.select("provider", "provider_reach_id", *S.RUNGS), ["provider", "provider_reach_id"], "left")


def enrich_streams(features: DataFrame, model: DataFrame, order: str | None = None) -> DataFrame:
    """(props, geometry) with order and drained area of the model table by numeric LINKNO.

    A hit takes the model's values (order 1 and area 0 where null), a miss the feature's own with the same
    defaults. Features without an id are left out. Of repeated model ids the row with the greatest ``order`` column, the later one, counts;
    without one, and among equals, the greatest row (order, area).
    """
    number = X.safe_double("LINKNO").cast("bigint")
    known = model.select(number.alias("link"), X.safe_double("strmOrder").cast("int").alias("o"), X.safe_double("DSContArea").alias("a"), F.col(order).alias("at") if order else F.lit(0).alias("at")).where("link is not null")
    known = known.groupBy("link").agg(F.max_by(F.struct("o", "a"), F.struct("at", "o", "a")).alias("m"))
    own = lambda name: F.get_json_object("props", f"$.{name}")
    rows = features.select(X.reach_id_fallback("props").alias("reach_id"), X.safe_double(own("strmOrder")).cast("int").alias("fo"), X.safe_double(own("DSContArea")).alias("fa"), "geometry").where("reach_id is not null")
    rows = rows.withColumn("link", F.col("reach_id").cast("bigint")).join(known, "link", "left")
    pick = lambda model_value, own_value, default: F.coalesce(F.when(F.col("m").isNotNull(), model_value).otherwise(own_value), F.lit(default))
    return rows.select("reach_id", pick(F.col("m.o"), F.col("fo"), 1).alias("strmOrder"), pick(F.col("m.a"), F.col("fa"), 0.0).alias("DSContArea"), "geometry", F.col("m").isNotNull().alias("has_model"))


def enrich_counts(features: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: processed, written, missing_id, missing_attributes; an error if nothing was written."""
    done = enriched.agg(F.count("*").alias("written"), F.count_if(~F.col("has_model")).alias("missing_attributes"))
    both = features.agg(F.count("*").alias("processed")).join(done)
    written = F.when(F.col("written") > 0, F.col("written")).otherwise(F.raise_error(F.lit("no stream was written")).cast("bigint"))
    return both.select("processed", written.alias("written"), (F.col("processed") - F.col("written")).alias("missing_id"), "missing_attributes")


def expand_cells_to_reaches(cell_rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Copy rows of a cell (lat, lon) to each reach of ``cells`` (provider_reach_id, lat, lon). Aggregate first."""
    return cell_rows.join(cells.select("provider_reach_id", "lat", "lon"), ["lat", "lon"])


def snap_regular(c: Column | str, first: float, step: float, n: int) -> Column:
    """Nearest coordinate of a regular axis; a tie takes the larger, outside takes the edge."""
    c = F.col(c) if isinstance(c, str) else c
    low, size = (first, step) if step > 0 else (first + step * (n - 1), -step)
    at = F.floor((c - F.lit(low)) / F.lit(size) + 0.5)
    return F.lit(low) + F.greatest(F.lit(0), F.least(at, F.lit(n - 1))) * F.lit(size)


def snap_irregular(df: DataFrame, column: str, axis: Sequence[float], out: str) -> DataFrame:
    """As snap_regular for any axis: its sorted values (thousands at most) go with the task."""
    values = np.unique(np.asarray(axis, dtype=float))

    @F.pandas_udf("double")
    def snap(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            at = np.clip(np.searchsorted(values, x.to_numpy(float)), 1, max(1, len(values) - 1))
            low, high = values[np.maximum(at - 1, 0)], values[np.minimum(at, len(values) - 1)]
            yield pd.Series(np.where(x.isna(), np.nan, np.where(x - low < high - x, low, high)), index=x.index)

    return df.withColumn(out, F.nanvl(snap(F.col(column).cast("double")), F.lit(None).cast("double")))


def snap_to_axis(df: DataFrame, column: str, axis: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: the value of a table's axis that is nearest to ``column``; a tie takes the larger, outside takes the edge, null and NaN and
    an empty axis give null.

    An as-of join both ways: distinct points and axis values are sorted together in ranges, each range carries its last and next axis value along, and what
    lies beyond a range's border comes from a table of one row for each range.
    """
    x = F.col(column).cast("double")
    points = df.select(F.when(~F.isnan(x), x).alias("v")).where("v is not null").distinct().select("v", F.lit(None).cast("double").alias("a"))
    marks = axis.select(F.col(value).cast("double").alias("a")).where("a is not null and not isnan(a)").distinct()
    sorted_ = write_scratch(points.unionByName(marks.select(F.col("a").alias("v"), "a")).repartitionByRange("v").withColumn("part", F.spark_partition_id()), "axis")
    ends = sorted_.groupBy("part").agg(F.min("a").alias("first"), F.max("a").alias("last"))
    up, down = (W.orderBy(order).rowsBetween(W.unboundedPreceding, -1) for order in ("part", F.desc("part")))  # a row for each range
    ends = ends.select("part", F.max("last").over(up).alias("from"), F.min("first").over(down).alias("to"))
    last = lambda order: F.last("a", ignorenulls=True).over(W.partitionBy("part").orderBy(order))
    carried = sorted_.withColumns({"low": last("v"), "high": last(F.desc("v"))})
    found = carried.where("a is null").join(ends, "part").select("v", F.coalesce("low", "from").alias("low"), F.coalesce("high", "to").alias("high"))
    nearest_ = F.when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull() | (F.col("v") - F.col("low") < F.col("high") - F.col("v")), F.col("low")).otherwise(F.col("high"))
    snapped = found.select("v", nearest_.alias("snapped"))
    return df.withColumn("_v", x).join(snapped, F.col("_v") == F.col("v"), "left").select(*(F.col(f"`{c}`") for c in df.columns if c != out), F.col("snapped").alias(out))


def thresholds_for_reaches(crosswalk: DataFrame, grid: DataFrame, tolerance: float = 0.06, leaf: int = nearest.LEAF) -> DataFrame:
    """Grid values for each matched reach: the cell equal at 4 decimals, else the nearest with an L1 distance below
    ``tolerance``. grid: lat, lon and value columns; of repeated cells the greatest values count. Unmatched reaches
    are left out."""
    values = [c for c in grid.columns if c not in ("lat", "lon")]
    key = lambda c: F.round(F.col(c) * 10000).cast("bigint")
    cells = grid.withColumn("ky", key("lat")).withColumn("kx", key("lon")).groupBy("ky", "kx").agg(F.max(F.struct("lat", "lon", *values)).alias("g"))
    points = crosswalk.select("reach_id", "grid_lat", "grid_lon").where("grid_lat is not null and grid_lon is not null")
    exact = points.withColumn("ky", key("grid_lat")).withColumn("kx", key("grid_lon")).join(cells, ["ky", "kx"]).select("reach_id", "g", F.lit(0.0).alias("l1"))
    rest = points.join(exact.select("reach_id"), "reach_id", "left_anti")
    sites = cells.select(F.col("g.lat").alias("y"), F.col("g.lon").alias("x"), F.col("g").alias("site"))
    pairs = nearest.near_sites(rest.select(F.struct("reach_id", "grid_lat", "grid_lon").alias("id"), F.col("grid_lat").alias("y"), F.col("grid_lon").alias("x")), sites, 1, tolerance, nearest.city_block, leaf)
    l1 = F.abs(F.col("id.grid_lat") - F.col("g.lat")) + F.abs(F.col("id.grid_lon") - F.col("g.lon"))
    near = pairs.withColumnRenamed("site", "g").withColumn("l1", l1).where(F.col("l1") < tolerance)
    best = near.groupBy("id.reach_id").agg(F.min_by(F.struct("g", "l1"), F.struct(F.round("l1", 9), "g.lat", "g.lon")).alias("b")).select("reach_id", "b.g", "b.l1")
    return exact.unionByName(best).select("reach_id", F.col("g.lat").alias("cell_lat"), F.col("g.lon").alias("cell_lon"), *(F.col(f"g.{v}").alias(v) for v in values), (F.col("l1") == 0).alias("exact"))


def threshold_grid_to_reaches(crosswalk: DataFrame, grid: DataFrame, lat_axis: tuple[float, float, int], lon_axis: tuple[float, float, int], provider: str) -> DataFrame:
    """Ladders of snapped cells: grid (lat, lon, return_period, threshold), axes (first, step, n). Values that are not
    positive are null, reaches without any rung are left out, and the provider's 20-year value fills rp_25."""
    milli = lambda c: F.round(c * 10000).cast("bigint")
    points = crosswalk.select("reach_id", milli(snap_regular("grid_lat", *lat_axis)).alias("ky"), milli(snap_regular("grid_lon", *lon_axis)).alias("kx"))
    value = F.when(X.finite("threshold") & (F.col("threshold") > 0), F.col("threshold"))
    slot = lambda p: F.max(F.when(F.col("return_period") == p, value))
    cells = grid.groupBy(milli(F.col("lat")).alias("ky"), milli(F.col("lon")).alias("kx")).agg(*((F.coalesce(slot(20), slot(25)) if p == 25 else slot(p)).alias(f"rp_{p}") for p in S.PERIODS))
    out = points.join(cells, ["ky", "kx"]).where(F.coalesce(*S.RUNGS).isNotNull())
    return out.select(F.lit(provider).alias("provider"), F.col("reach_id").alias("provider_reach_id"), *S.RUNGS)


def degrees(km: float) -> float:
    return float(np.degrees(km / X.EARTH_KM))


def knn_candidates(reaches: DataFrame, cells: DataFrame, k: int = 16, max_km: float = 20.0, leaf: int = nearest.LEAF) -> DataFrame:
    """The k nearest cells within ``max_km`` of each reach: (reach columns, cell columns, distance_km, nth).

    Cells are found through a quadtree whose tiles split where cells lie dense (see operators.nearest). Distances are compared at
    9 decimals, ties by latitude, then longitude, then the cell's further columns.
    """
    if max_km <= 0:
        raise ValueError("max_km must be positive")
    cell = F.struct("grid_lat", "grid_lon", *(c for c in cells.columns if c not in ("grid_lat", "grid_lon")))
    sites = cells.select(F.col("grid_lat").alias("y"), F.col("grid_lon").alias("x"), cell.alias("site"))
    reach = F.struct(*reaches.columns)
    points = reaches.select(reach.alias("id"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    pairs = nearest.near_sites(points, sites, k, degrees(max_km), nearest.euclid, leaf)
    near = pairs.select("id.*", "site.*", "site").withColumn("distance_km", X.distance_rad("lat", "lon", "grid_lat", "grid_lon") * X.EARTH_KM).where(F.col("distance_km") <= max_km)
    nth = F.row_number().over(W.partitionBy("reach_id").orderBy(F.round("distance_km", 9), "site"))
    return near.withColumn("nth", nth).where(F.col("nth") <= k).select(*reaches.columns, *cells.columns, "distance_km", "nth")


def score_crosswalk(reaches: DataFrame, candidates: DataFrame, target_provider: str, max_area_ratio: float = 10.0, area_weight: float = 20.0, max_km: float = 20.0) -> DataFrame:
    """One row per reach: its best candidate by distance and area, or a row without a cell."""
    if max_area_ratio < 1 or area_weight < 0 or max_km <= 0:
        raise ValueError("max_area_ratio must be 1 or more, area_weight 0 or more, max_km positive")
    ratio = X.area_ratio("reach_upstream_area_km2", "grid_upstream_area_km2")
    rows = candidates.withColumn("area_ratio", ratio).where((F.col("area_ratio") <= max_area_ratio) & (F.col("distance_km") <= max_km))
    rows = rows.withColumn("match_score", X.match_score(F.col("distance_km"), F.col("area_ratio"), area_weight))
    order = F.struct(F.round("match_score", 9), F.round("distance_km", 9), "grid_lat", "grid_lon")
    best = rows.groupBy("reach_id").agg(F.min_by(F.struct("grid_lat", "grid_lon", "grid_upstream_area_km2", "area_ratio", "distance_km", "match_score"), order).alias("b"))
    out = reaches.select("reach_id", "reach_upstream_area_km2").join(best, "reach_id", "left")
    return out.select("reach_id", F.lit(target_provider).alias("target_provider"), "b.grid_lat", "b.grid_lon", F.col("b.grid_upstream_area_km2").alias("upstream_area_km2"), "reach_upstream_area_km2", "b.grid_upstream_area_km2", "b.area_ratio", "b.distance_km", "b.match_score", F.lit("distance_plus_area_v1").alias("match_method"), F.col("b").isNotNull().alias("is_valid_match"))


def runs_with_data(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    return runs.join(summaries.select(*S.RUN_KEYS), S.RUN_KEYS, "left_semi")


def reach_detail(ts: DataFrame, rp: DataFrame, summaries: DataFrame, reaches: DataFrame, limit: int | None = None) -> DataFrame:
    """For each of ``reaches`` (provider, run_id, provider_reach_id): ordered timeseries, ladder, summary; absent
    parts are empty or null."""
    from freshet.operators.windows import first_n_timesteps

    wanted = reaches.select(*S.REACH_KEYS).distinct()
    rows = ts.join(wanted, S.REACH_KEYS, "left_semi")
    rows = rows if limit is None else first_n_timesteps(rows, limit)
    series = rows.groupBy(*S.REACH_KEYS).agg(F.array_sort(F.collect_list(F.struct("forecast_time_utc", *S.FLOWS))).alias("timeseries"))
    ladder = rp.select("provider", "provider_reach_id", F.struct(*S.RUNGS).alias("return_periods"))
    brief = summaries.select(*S.REACH_KEYS, F.struct(*(c for c in summaries.columns if c not in S.REACH_KEYS)).alias("summary"))
    out = wanted.join(series, S.REACH_KEYS, "left").join(ladder, ["provider", "provider_reach_id"], "left").join(brief, S.REACH_KEYS, "left")
    empty = F.array().cast(series.schema["timeseries"].dataType)
    return out.select(*S.REACH_KEYS, F.coalesce("timeseries", empty).alias("timeseries"), "return_periods", "summary")


def detail_with_fallback(stored: DataFrame, members: DataFrame, reaches: DataFrame) -> DataFrame:
    """Stored timeseries of the wanted reaches, and statistics of the cube for those without any."""
    from freshet.operators.aggregations import ensemble_stats

    wanted = reaches.select(*S.REACH_KEYS).distinct()
    columns = [*S.TIME_KEYS, *S.FLOWS]
    have = stored.join(wanted, S.REACH_KEYS, "left_semi").select(*columns)
    absent = wanted.join(stored.select(*S.REACH_KEYS), S.REACH_KEYS, "left_anti")
    return have.unionByName(ensemble_stats(members.join(absent, S.REACH_KEYS, "left_semi")).select(*columns))
