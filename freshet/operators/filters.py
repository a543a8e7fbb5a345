"""Row filters: empty statistics, threshold guard, valid reaches and cells, run lists, map tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.functions import scalars as X

# Least severity by zoom; least drained area by zoom and tier
ZOOM_SEVERITY = [(3, 4), (5, 3), (7, 2)]
MAJOR_AREA = [(0, 120000), (3, 60000), (5, 15000), (6, 0)]
MEDIUM_AREA = [(6, 20000), (7, 5000), (8, 1000), (9, 100), (10, 0)]
MINOR_AREA = [(8, 10000), (9, 2000), (10, 0)]


def drop_empty_stats(ts: DataFrame) -> DataFrame:
    return ts.where(F.coalesce(*S.FLOWS).isNotNull())


def ladder_reason(require_all: bool = True) -> Column:
    """Why a ladder is rejected, null if it is accepted."""
    rungs = [F.col(r) for r in S.RUNGS]
    missing = F.lit(False)
    for r in rungs:
        missing = missing | (~X.finite(r) if require_all else (r.isNotNull() & ~X.finite(r)))
    rises = F.lit(True)
    for a, b in zip(rungs, rungs[1:], strict=False):
        rises = rises & F.coalesce(b > a, F.lit(not require_all))
    first, last = rungs[0], rungs[-1]
    least = lambda c, ok: F.coalesce(ok, F.lit(False)) | (F.lit(not require_all) & c.isNull())
    small = ~(least(first, first >= X.MIN_THRESHOLD) & least(last, last >= X.MIN_THRESHOLD))
    flat = F.coalesce((first == last) & (first < 0.1), F.lit(False))
    return F.when(missing, "missing").when(small, "too_small").when(flat, "flat").when(~rises, "not_increasing")


def sanitize_ladder(rp: DataFrame, require_all: bool = True) -> DataFrame:
    """Ladders with six finite, strictly rising rungs of at least 0.01; require_all=False lets missing rungs pass."""
    return rp.where(ladder_reason(require_all).isNull())


def rejected_ladders(rp: DataFrame, require_all: bool = True) -> DataFrame:
    """(provider, reason, ladders)."""
    return rp.withColumn("reason", ladder_reason(require_all)).where("reason is not null").groupBy("provider", "reason").agg(F.count("*").alias("ladders"))


def valid_reaches(reaches: DataFrame, area: str = "area_m2") -> DataFrame:
    """(reach_id, lat, lon, reach_upstream_area_km2) with finite coordinates and a positive area."""
    size = X.safe_double(area) / 1e6
    rows = reaches.select(F.col("reach_id").cast("string").alias("reach_id"), X.safe_double("lat").alias("lat"), X.safe_double("lon").alias("lon"), size.alias("reach_upstream_area_km2"))
    return rows.where(X.finite("lat") & X.finite("lon") & X.finite("reach_upstream_area_km2") & (F.col("reach_upstream_area_km2") > 0))


def river_cells(areas: DataFrame, rp_2: DataFrame | None = None, min_cms: float = 1.0) -> DataFrame:
    """Cells with a finite positive area and, where thresholds are given, rp_2 of at least ``min_cms``."""
    cells = areas.where(X.finite("grid_upstream_area_km2") & (F.col("grid_upstream_area_km2") > 0))
    if rp_2 is None:
        return cells
    return cells.join(rp_2.where(X.finite("rp_2") & (F.col("rp_2") >= min_cms)), ["grid_lat", "grid_lon"])


def valid_crosswalk(crosswalk: DataFrame, target_provider: str) -> DataFrame:
    return crosswalk.where((F.col("target_provider") == target_provider) & F.col("is_valid_match") & F.col("grid_lat").isNotNull() & F.col("grid_lon").isNotNull())


def filter_summaries(s: DataFrame, provider: str, run_id: str, flagged_only: bool = False, min_severity: int | None = None) -> DataFrame:
    out = s.where((F.col("provider") == provider) & (F.col("run_id") == run_id))
    if flagged_only:
        out = out.where("is_flagged")
    return out if min_severity is None else out.where(F.col("severity_score") >= min_severity)


def parse_run_ids(paths: DataFrame, column: str = "path", suffix: str = ".zarr") -> DataFrame:
    """Distinct 10-digit run ids of the last parts of paths."""
    name = F.regexp_extract(F.rtrim(F.col(column), F.lit("/")), r"([^/]+)$", 1)
    run = F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name)
    return paths.select(run.alias("run_id")).where(F.col("run_id").rlike(r"^\d{10}$")).distinct()


def latest_listed_run(paths: DataFrame, column: str = "path", suffix: str = ".zarr") -> DataFrame:
    """One row, the greatest run id; an error if there is none."""
    top = F.max("run_id")
    return parse_run_ids(paths, column, suffix).agg(F.when(top.isNull(), F.raise_error(F.lit("no run ids listed")).cast("string")).otherwise(top).alias("run_id"))


def validate_reach_ids(df: DataFrame, column: str = "provider_reach_id") -> DataFrame:
    """With is_valid: exactly nine digits."""
    return df.withColumn("is_valid", F.coalesce(F.trim(F.col(column)).rlike("^[0-9]{9}$"), F.lit(False)))


def severity_for_zoom(s: DataFrame, zoom: Column) -> DataFrame:
    """Rows that a map at this zoom shows."""
    least = F.lit(1)
    for limit, value in reversed(ZOOM_SEVERITY):
        least = F.when(zoom <= limit, value).otherwise(least)
    return s.where(F.col("severity_score") >= least)


def visible_streams(streams: DataFrame, zoom: Column) -> DataFrame:
    """Streams that a map at this zoom shows; without order they count as 5, without area as 0."""
    order, area = F.coalesce("strmOrder", F.lit(5)), F.coalesce("DSContArea", F.lit(0.0))
    major = (order >= 7) & (area >= X.interp_linear(zoom, MAJOR_AREA))
    medium = (zoom >= 6) & (order >= 4) & (order < 7) & (area >= X.interp_linear(zoom, MEDIUM_AREA))
    minor = (zoom >= 8) & (order < 4) & (area >= X.interp_linear(zoom, MINOR_AREA))
    return streams.where(major | medium | minor)
