"""Column resolution and normalization of raw forecast, summary and threshold records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.functions import scalars as X

# Accepted names of input columns, in order of preference
ID_ALIASES = ("provider_reach_id", "river_id", "rivid", "reach_id")
RUNG_ALIASES = {f"rp_{p}": (f"rp_{p}", f"return_period_{p}", f"rp{p}", f"q{p}") for p in S.PERIODS}
LAT_ALIASES = ("lat", "latitude", "grid_lat")
LON_ALIASES = ("lon", "longitude", "grid_lon")


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """Columns found by ordered aliases, whatever their case and outer blanks; a missing optional one is null."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    out: list[Column] = []
    for name, names in aliases.items():
        found = next((have[a.lower()] for a in names if a.lower() in have), None)
        if found is None and name not in optional:
            raise ValueError(f"no column for {name}: looked for {list(names)}, found {df.columns}")
        out.append(F.lit(None).cast("string").alias(name) if found is None else F.col(f"`{found}`").alias(name))
    return df.select(*out)


def resolve_ladder(df: DataFrame, provider: str) -> DataFrame:
    """Threshold rows under any accepted names as (provider, provider_reach_id, rp_2 ... rp_100, metadata_json)."""
    rows = resolve_columns(df, {"provider_reach_id": ID_ALIASES, **RUNG_ALIASES}, optional=S.RUNGS)
    floating = dict(rows.dtypes)["provider_reach_id"] in ("double", "float")
    reach = X.normalize_reach_id("provider_reach_id", floating)
    out = rows.select(F.lit(provider).alias("provider"), reach.alias("provider_reach_id"), *(X.safe_double(r).alias(r) for r in S.RUNGS), F.lit(None).cast("string").alias("metadata_json"))
    return out.where(F.col("provider_reach_id").isNotNull())


def _present(df: DataFrame, *names: str) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return X.first_not_null(*found) if found else F.lit(None).cast("string")


def _reach(df: DataFrame) -> Column:
    blank = lambda n: F.nullif(F.trim(F.col(n).cast("string")), F.lit(""))
    found = [blank(n) for n in ("provider_reach_id", "river_id") if n in df.columns]
    return X.first_not_null(*found)


def normalize_timeseries(raw: DataFrame, provider: str, run_id: str | None = None, tag: bool = False) -> DataFrame:
    """Raw records as timeseries rows; rows without id or time are dropped.

    The short provider names win over the long ones; an explicit null falls back too. tag: keep dropped rows, with
    ``reason`` ('missing_id', 'invalid_time' or null).
    """
    short = {"flow_mean_cms": "flow_avg", "flow_median_cms": "flow_med", "flow_p25_cms": "flow_25p", "flow_p75_cms": "flow_75p", "flow_max_cms": "flow_max"}
    run = F.lit(run_id) if run_id is not None else F.col("run_id")
    rows = raw.select(F.lit(provider).alias("provider"), run.alias("run_id"), _reach(raw).alias("provider_reach_id"), X.to_utc(_present(raw, "forecast_time_utc", "time")).alias("forecast_time_utc"), *(X.safe_double(_present(raw, s, name)).alias(name) for name, s in short.items()), F.to_json(F.struct(*raw.columns)).alias("raw_payload_json"))
    reason = F.when(F.col("provider_reach_id").isNull(), "missing_id").when(F.col("forecast_time_utc").isNull(), "invalid_time")
    return rows.withColumn("reason", reason) if tag else rows.where(reason.isNull())


def normalize_summary(raw: DataFrame, provider: str, run_id: str) -> DataFrame:
    names = ["peak_mean_cms", "peak_median_cms", "peak_max_cms", "now_mean_cms", "now_max_cms"]
    rows = raw.select(F.lit(provider).alias("provider"), F.lit(run_id).alias("run_id"), _reach(raw).alias("provider_reach_id"), X.to_utc(_present(raw, "peak_time_utc")).alias("peak_time_utc"), *(X.safe_double(_present(raw, n)).alias(n) for n in names))
    return rows.where(F.col("provider_reach_id").isNotNull())


def normalize_rest_stats(stats: DataFrame, provider: str, run_id: str, reach_id: str) -> DataFrame:
    """Statistics of one reach as timeseries rows; flow_min, high_res and the row as text go to the payload."""
    text = F.create_map(*(x for c in stats.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))))
    extra = lambda n: X.safe_double(_present(stats, n))
    flows = {"flow_mean_cms": "flow_avg", "flow_median_cms": "flow_med", "flow_p25_cms": "flow_25p", "flow_p75_cms": "flow_75p", "flow_max_cms": "flow_max"}
    rows = stats.select(F.lit(provider).alias("provider"), F.lit(run_id).alias("run_id"), F.lit(reach_id).alias("provider_reach_id"), X.to_utc(_present(stats, "time", "datetime", "forecast_time_utc")).alias("forecast_time_utc"), *(extra(s).alias(n) for n, s in flows.items()), X.payload_json(flow_min=extra("flow_min"), high_res=extra("high_res"), row=text).alias("raw_payload_json"))
    return rows.where(F.col("forecast_time_utc").isNotNull())


def normalize_rest_ladders(frame: DataFrame, provider: str, index: str | None = None) -> DataFrame:
    """Per-reach threshold frames as ladder rows; the id is ``rivid``, else ``river_id``, else the ``index`` column."""
    names = [n for n in ("rivid", "river_id", index) if n in frame.columns]
    if not names:
        raise ValueError(f"no id: looked for rivid, river_id and an index column, found {frame.columns}")
    kinds = dict(frame.dtypes)
    reach = X.first_not_null(*(X.normalize_reach_id(n, kinds[n] in ("double", "float")) for n in names))
    rungs = frame.select(*(F.col(f"`{c}`") for c in frame.columns if c not in (*ID_ALIASES, index)), reach.alias("provider_reach_id"))
    return resolve_ladder(rungs, provider)


def backfill_reach_area(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.withColumn("reach_upstream_area_km2", F.coalesce("reach_upstream_area_km2", "upstream_area_km2"))


def map_view(summaries: DataFrame) -> DataFrame:
    """The twelve light columns of a summary."""
    return summaries.select(*S.MAP_VIEW)
