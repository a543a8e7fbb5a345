"""Ensemble, time and run aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.functions import scalars as X
from freshet.operators.selection import exact_percentiles

# Names of the stages of a run, in order
STAGES = ["discovered", "raw_acquired", "artifact_prepared", "ingested", "summarized", "map_ready"]


def _earliest(value: Column | str, time: str = "forecast_time_utc") -> Column:
    """Sort key: greatest value, then earliest time."""
    return F.struct(F.col(value) if isinstance(value, str) else value, -F.unix_micros(time))


def ensemble_stats(members: DataFrame, keys: list[str] = S.TIME_KEYS) -> DataFrame:
    """Mean, median, quartiles (linear interpolation) and maximum over members; nulls and NaN don't count.

    Long form: one row for each member. See :func:`packed_ensemble_stats` for array columns, which need no shuffle.
    """
    flow = F.when(~F.isnan("flow_cms"), F.col("flow_cms"))
    rows = members.groupBy(*keys).agg(F.avg(flow).alias("flow_mean_cms"), F.percentile(flow, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(flow).alias("flow_max_cms"))
    q = lambda i: F.try_element_at("q", F.lit(i))
    return rows.select(*keys, "flow_mean_cms", q(2).alias("flow_median_cms"), q(1).alias("flow_p25_cms"), q(3).alias("flow_p75_cms"), "flow_max_cms")


def packed_ensemble_stats(packed: DataFrame, flows: str = "flows", keys: list[str] = S.TIME_KEYS) -> DataFrame:
    """As :func:`ensemble_stats` for rows that hold all members in an array; row by row, no shuffle."""
    rows = packed.select(*keys, F.array_sort(F.filter(flows, lambda x: x.isNotNull() & ~F.isnan(x))).alias("f")).withColumn("n", F.size("f"))

    def quantile(p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        a, b = F.try_element_at("f", low + 1), F.try_element_at("f", F.least(low + 2, F.col("n")))
        return F.when(F.col("n") > 0, a + (b - a) * (at - low))

    mean = F.when(F.col("n") > 0, F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x) / F.col("n"))
    return rows.select(*keys, mean.alias("flow_mean_cms"), quantile(0.5).alias("flow_median_cms"), quantile(0.25).alias("flow_p25_cms"), quantile(0.75).alias("flow_p75_cms"), F.try_element_at("f", F.lit(-1)).alias("flow_max_cms"))


def grid_ensemble_stats(grid_members: DataFrame) -> DataFrame:
    """Statistics per (run, product, cell, time); without a member dimension only the mean is filled."""
    keys = ["run_id", "product", "lat", "lon", "forecast_time_utc"]
    rows = grid_members.withColumn("flow_cms", X.safe_double("flow_cms")).where("flow_cms is not null")
    has = rows.groupBy(*keys).agg(F.avg("flow_cms").alias("mean"), F.percentile("flow_cms", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("flow_cms").alias("top"), F.max(F.col("member").isNotNull()).alias("many"))
    many = lambda c: F.when(F.col("many"), c)
    return has.select(*keys, F.col("mean").alias("flow_mean_cms"), many(F.col("q")[1]).alias("flow_median_cms"), many(F.col("q")[0]).alias("flow_p25_cms"), many(F.col("q")[2]).alias("flow_p75_cms"), many(F.col("top")).alias("flow_max_cms"))


def bulk_summary(ts: DataFrame, keys: list[str] = S.REACH_KEYS, median: bool = True) -> DataFrame:
    """One row per reach: peaks over time, the first time of the highest maximum, and the first step's flows."""
    now = F.min_by(F.struct("flow_mean_cms", "flow_max_cms"), "forecast_time_utc")
    peak = F.max_by(F.when(F.col("flow_max_cms").isNotNull(), F.col("forecast_time_utc")), F.when(F.col("flow_max_cms").isNotNull(), _earliest("flow_max_cms")))
    middle = F.max("flow_median_cms") if median else F.max(F.lit(None).cast("double"))
    rows = ts.groupBy(*keys).agg(F.max("flow_mean_cms").alias("peak_mean_cms"), middle.alias("peak_median_cms"), F.max("flow_max_cms").alias("peak_max_cms"), peak.alias("peak_time_utc"), now.alias("now"))
    return rows.select(*keys, "peak_time_utc", "peak_mean_cms", "peak_median_cms", "peak_max_cms", F.col("now.flow_mean_cms").alias("now_mean_cms"), F.col("now.flow_max_cms").alias("now_max_cms"))


def grid_bulk_summary(stats: DataFrame, cells: DataFrame, products: tuple[str, ...] = ("cf", "pf")) -> DataFrame:
    """Cell summaries of the first product with rows, copied to the reaches of each cell; no peak median."""
    from freshet.operators.joins import expand_cells_to_reaches

    first = F.min(F.array_position(F.array(*map(F.lit, products)), F.col("product"))).alias("place")
    chosen = stats.groupBy("run_id").agg(first)
    rows = stats.join(chosen, "run_id").where(F.col("product") == F.element_at(F.array(*map(F.lit, products)), F.col("place").cast("int"))) if products else stats
    return expand_cells_to_reaches(bulk_summary(rows, ["run_id", "lat", "lon"], median=False), cells)


def pivot_ladder(long: DataFrame, provider: str, method: str = "gumbel") -> DataFrame:
    """(river_id, return_period, method, value) to one ladder row per reach, max_simulated in the payload."""
    if method not in ("gumbel", "logpearson3"):
        raise ValueError(f"unknown method {method}")
    rows = long.where(F.col("method") == method).withColumn("provider_reach_id", X.normalize_reach_id("river_id")).where("provider_reach_id is not null")
    wide = rows.groupBy("provider_reach_id").agg(*(F.max(F.when(F.col("return_period") == p, X.safe_double("value"))).alias(f"rp_{p}") for p in S.PERIODS), F.max("max_simulated").alias("m"), F.array_sort(F.collect_set("return_period")).alias("periods"))
    exact = F.col("periods") == F.array(*map(F.lit, S.PERIODS))
    checked = wide.where(F.when(exact, True).otherwise(F.raise_error(F.lit(f"return periods must be {S.PERIODS}")).cast("boolean")))
    return checked.select(F.lit(provider).alias("provider"), "provider_reach_id", *S.RUNGS, X.payload_json(max_simulated=F.col("m")).alias("metadata_json"))


def reach_summary(ts: DataFrame, rp: DataFrame, policy: str = "mean_first", requested: DataFrame | None = None) -> DataFrame:
    """Full summaries from stored timeseries, one row for each (provider, run, reach).

    policy: 'mean_first' classifies the mean, then median, then maximum peak; 'max_first' the maximum, mean, median.
    requested: (provider, run_id, provider_reach_id) that get an empty row where there is no timeseries, 'unknown'
    under mean_first and without a band under max_first.
    """
    orders = {"mean_first": ["peak_mean_cms", "peak_median_cms", "peak_max_cms"], "max_first": ["peak_max_cms", "peak_mean_cms", "peak_median_cms"]}
    value = F.coalesce("flow_max_cms", "flow_mean_cms", "flow_median_cms")
    joined = ts.join(rp.select("provider", "provider_reach_id", F.col("rp_2").alias("first_rung")), ["provider", "provider_reach_id"], "left")
    rows = joined.groupBy(*S.REACH_KEYS).agg(
        F.max_by("forecast_time_utc", _earliest(F.coalesce(value, F.lit(-1.0)))).alias("peak_time_utc"),
        F.min(F.when(value >= F.col("first_rung"), F.col("forecast_time_utc"))).alias("first_exceedance_time_utc"),
        *(F.max(f"flow_{x}_cms").alias(f"peak_{x}_cms") for x in ("mean", "median", "max")),
        F.count("*").alias("points"),
    )
    if requested is not None:
        rows = requested.select(*S.REACH_KEYS).distinct().join(rows, S.REACH_KEYS, "left")
    found = rows.join(rp.select("provider", "provider_reach_id", *S.RUNGS), ["provider", "provider_reach_id"], "left")
    found = found.withColumn("c", X.classify(F.coalesce(*orders[policy])))
    band = F.when(F.col("points").isNull() & F.lit(policy == "max_first"), None).otherwise(F.col("c.return_period_band"))
    return found.select(*S.REACH_KEYS, "peak_time_utc", "first_exceedance_time_utc", "peak_mean_cms", "peak_median_cms", "peak_max_cms", band.alias("return_period_band"), F.col("c.severity_score").alias("severity_score"), F.col("c.is_flagged").alias("is_flagged"), F.coalesce("points", F.lit(0).cast("bigint")).alias("points"))


def run_counts(ts: DataFrame, summaries: DataFrame, rp: DataFrame) -> DataFrame:
    """Per (provider, run_id): timeseries rows, their reaches, summaries, and the provider's supported reaches."""
    return run_counts_of(ts.groupBy(*S.REACH_KEYS).agg(F.count("*").alias("n")), summaries, rp)


def _run_counts(rows: DataFrame, summaries: DataFrame, rp: DataFrame) -> DataFrame:
    done = summaries.groupBy(*S.RUN_KEYS).agg(F.count("*").alias("summary_rows"))
    known = rp.groupBy("provider").agg(F.countDistinct("provider_reach_id").alias("supported_reaches"))
    both = rows.join(done, S.RUN_KEYS, "full").join(known, "provider", "left")
    return both.select(*S.RUN_KEYS, *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("timeseries_rows", "reaches", "summary_rows", "supported_reaches")))


def timeseries_delta(target: DataFrame, updates: DataFrame) -> DataFrame:
    """(provider, run_id, provider_reach_id, n): the rows that an upsert of ``updates`` adds to ``target``, by reach. Keys that are there already add none, so
    a replay adds nothing; only runs of the updates are read."""
    touched = target.select(*S.TIME_KEYS).join(updates.select(*S.RUN_KEYS).distinct(), S.RUN_KEYS, "left_semi").alias("t")
    new = updates.select(*S.TIME_KEYS).distinct().alias("u")
    added = new.join(touched, [F.col(f"u.{k}").eqNullSafe(F.col(f"t.{k}")) for k in S.TIME_KEYS], "left_anti")
    return added.groupBy(*S.REACH_KEYS).agg(F.count("*").alias("n"))


def merge_counts(*deltas: DataFrame) -> DataFrame:
    """Counts by reach of any number of deltas; the order doesn't matter."""
    rows = deltas[0]
    for more in deltas[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*S.REACH_KEYS).agg(F.sum("n").alias("n"))


def run_counts_of(reach_counts: DataFrame, summaries: DataFrame, rp: DataFrame) -> DataFrame:
    """As :func:`run_counts` from counts by reach that were kept up with each batch, without the timeseries."""
    rows = reach_counts.where("n > 0").groupBy(*S.RUN_KEYS).agg(F.sum("n").alias("timeseries_rows"), F.count("*").alias("reaches"))
    return _run_counts(rows, summaries, rp)


def run_readiness(runs: DataFrame, counts: DataFrame, ops: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Completed and missing stages and the current status of each run.

    ops: (provider, run_id, raw_succeeded, ingest_attempted, ingest_succeeded, ingest_signature); artifacts:
    (provider, run_id, signature) of present ones.
    """
    rows = runs.select(*S.RUN_KEYS).join(counts, S.RUN_KEYS, "left").join(ops, S.RUN_KEYS, "left").join(artifacts.select(*S.RUN_KEYS, "signature", F.lit(True).alias("present")), S.RUN_KEYS, "left")
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    gate = ~yes("ingest_attempted") | (yes("ingest_succeeded") & yes(F.col("ingest_signature") == F.col("signature")))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    summarized = some("summary_rows") & gate
    marks = [F.lit(True), yes("raw_succeeded"), yes("present"), some("timeseries_rows"), summarized, summarized]
    every = F.array(*map(F.lit, STAGES))
    done = F.filter(F.array(*(F.when(m, F.lit(s)) for m, s in zip(marks, STAGES, strict=True))), lambda s: s.isNotNull())
    out = rows.select(*S.RUN_KEYS, done.alias("completed_stages"), summarized.alias("map_ready"))
    return out.select(*S.RUN_KEYS, "completed_stages", F.array_except(every, F.col("completed_stages")).alias("missing_stages"), F.element_at("completed_stages", -1).alias("current_status"), "map_ready")


def provider_health(runs: DataFrame, counts: DataFrame, readiness: DataFrame) -> DataFrame:
    """Latest run with data of each provider, with its counts and readiness."""
    from freshet.operators.windows import latest_run

    latest = latest_run(runs, counts.where("summary_rows > 0"))
    return latest.select("provider", "run_id", "run_date_utc").join(counts, S.RUN_KEYS, "left").join(readiness, S.RUN_KEYS, "left").select("provider", "run_id", "timeseries_rows", "reaches", "summary_rows", "supported_reaches", "current_status", "map_ready")


def crosswalk_report(crosswalk: DataFrame) -> DataFrame:
    """One row: matched and rejected shares, quantiles and outlier counts over valid matches."""
    ok = F.col("is_valid_match")
    measures, percents = ["distance_km", "area_ratio", "match_score"], (50, 90, 99)
    over = {f"{name}_over_{limit}": F.count_if(ok & (F.col(c) > limit)) for name, c, limits in (("ratio", "area_ratio", (2, 5)), ("distance", "distance_km", (5, 10))) for limit in limits}
    rows = crosswalk.agg(F.count("*").alias("reaches"), F.count_if(ok).alias("matched"), *(v.alias(k) for k, v in over.items()))
    quantiles = exact_percentiles(crosswalk.where(ok), measures, [p / 100 for p in percents])
    share = lambda c: 100.0 * c / F.nullif(F.col("reaches"), F.lit(0))
    return rows.join(quantiles).select("reaches", "matched", share(F.col("matched")).alias("matched_pct"), share(F.col("reaches") - F.col("matched")).alias("rejected_pct"), *(f"{c}_p{p}" for c in measures for p in percents), *over)


def area_stats(df: DataFrame, column: str) -> DataFrame:
    rows = df.select(F.when(X.finite(column), F.col(column)).alias("area"))
    ends = rows.agg(F.min("area").alias("min_area"), F.max("area").alias("max_area"))
    return ends.join(exact_percentiles(rows, ["area"], [0.5])).select("min_area", F.col("area_p50").alias("median_area"), "max_area")


def request_rollup(samples: DataFrame) -> DataFrame:
    """Per (provider, endpoint): totals, errors, and latency and payload quantiles of successful requests."""
    ok = F.col("status_code") == 200
    keys = ["provider", "endpoint"]
    rows = samples.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok")).alias("r")
    found = exact_percentiles(samples.where(ok), ["duration_ms", "payload_bytes"], [0.5, 0.95], keys).alias("q")
    both = rows.join(found, [F.col(f"r.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys], "left")
    ms = lambda p: F.round(F.col(f"duration_ms_p{p}") + F.lit(1e-9), 2).alias(f"p{p}_ms")
    size = lambda p: F.floor(f"payload_bytes_p{p}").alias(f"p{p}_bytes")
    return both.select("r.provider", "r.endpoint", "total", "ok", (F.col("total") - F.col("ok")).alias("errors"), ms(50), ms(95), size(50), size(95))


def prepare_stats(tagged: DataFrame, rp: DataFrame, provider: str) -> DataFrame:
    """Counters of one pass over tagged rows (see normalize_timeseries): seen, invalid, unsupported, written."""
    known = rp.where(F.col("provider") == provider).select(F.trim("provider_reach_id").alias("provider_reach_id"), F.lit(True).alias("known")).distinct()
    rows = tagged.join(known, "provider_reach_id", "left")
    invalid = F.col("reason").isNotNull()
    return rows.agg(F.count("*").alias("records_seen"), F.count_if(invalid).alias("invalid_dropped"), F.count_if(~invalid & F.col("known").isNull()).alias("filtered_dropped"), F.count_if(~invalid & F.col("known").isNotNull()).alias("written"))
