"""Schemas of the stored tables and of raw inputs; jobs never infer one."""

from pyspark.sql import types as T


def _ddl(text: str) -> T.StructType:
    """Columns of a DDL text; Spark's own parser would need a session when this module is imported."""
    out = T.StructType()
    for column in text.split(", "):
        out.add(*column.split(" "))
    return out


RUNGS = ["rp_2", "rp_5", "rp_10", "rp_25", "rp_50", "rp_100"]
PERIODS = [2, 5, 10, 25, 50, 100]
FLOWS = ["flow_mean_cms", "flow_median_cms", "flow_p25_cms", "flow_p75_cms", "flow_max_cms"]
RUN_KEYS = ["provider", "run_id"]
REACH_KEYS = [*RUN_KEYS, "provider_reach_id"]
TIME_KEYS = [*REACH_KEYS, "forecast_time_utc"]

RUNS = _ddl("provider string, run_id string, run_date_utc timestamp, issued_at_utc timestamp, source_type string, ingest_status string, metadata_json string")
RETURN_PERIODS = _ddl("provider string, provider_reach_id string, rp_2 double, rp_5 double, rp_10 double, rp_25 double, rp_50 double, rp_100 double, metadata_json string")
TIMESERIES = _ddl("provider string, run_id string, provider_reach_id string, forecast_time_utc timestamp, flow_mean_cms double, flow_median_cms double, flow_p25_cms double, flow_p75_cms double, flow_max_cms double, raw_payload_json string")
SUMMARY_ARTIFACT = _ddl("provider string, run_id string, provider_reach_id string, peak_time_utc timestamp, peak_mean_cms double, peak_median_cms double, peak_max_cms double, now_mean_cms double, now_max_cms double, return_period_band string, severity_score double, is_flagged boolean")
SUMMARIES = _ddl("provider string, run_id string, provider_reach_id string, peak_time_utc timestamp, first_exceedance_time_utc timestamp, peak_mean_cms double, peak_median_cms double, peak_max_cms double, now_mean_cms double, now_max_cms double, return_period_band string, severity_score integer, is_flagged boolean, metadata_json string")
CROSSWALK = _ddl("reach_id string, target_provider string, grid_lat double, grid_lon double, upstream_area_km2 double, reach_upstream_area_km2 double, grid_upstream_area_km2 double, area_ratio double, distance_km double, match_score double, match_method string, is_valid_match boolean")
MEMBERS = _ddl("provider string, run_id string, provider_reach_id string, forecast_time_utc timestamp, member long, flow_cms double")
GRID_MEMBERS = _ddl("run_id string, product string, lat double, lon double, forecast_time_utc timestamp, member long, flow_cms double")
THRESHOLD_LONG = _ddl("river_id long, return_period integer, method string, value double, max_simulated double")
#: Raw records: numbers may come as text, so everything is read as text.
RAW_FORECAST = _ddl("provider_reach_id string, river_id string, forecast_time_utc string, time string, flow_avg string, flow_med string, flow_25p string, flow_75p string, flow_max string, flow_mean_cms string, flow_median_cms string, flow_p25_cms string, flow_p75_cms string, flow_max_cms string")
MAP_VIEW = ["provider", "run_id", "provider_reach_id", "peak_time_utc", "peak_mean_cms", "peak_median_cms", "peak_max_cms", "now_mean_cms", "now_max_cms", "return_period_band", "severity_score", "is_flagged"]
