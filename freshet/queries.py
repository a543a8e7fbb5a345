"""Registered flood-forecast queries over the given tables, and their SQL.

Doubles are rounded to four decimals on both sides, as sums differ in the last digits between engines; a
billionth is added first, so that exact halves round alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.fixtures import ctes, view
from freshet.functions import scalars as X
from freshet.operators import aggregations as A
from freshet.operators import filters as L
from freshet.operators import joins as J
from freshet.operators import projections as P
from freshet.operators import thresholds as T
from freshet.operators import upserts as U
from freshet.operators import windows as N
from freshet.plans import workflows as C
from freshet.sources import clustered as K
from freshet.sources import tables as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(c) + F.lit(1e-9), 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query; the last SELECT's double columns are named to be rounded."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            head, last = sql.rsplit("\n---\n", 1) if "\n---\n" in sql else ("", sql)
            swap = f" REPLACE ({', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in doubles.split())})" if doubles else ""
            SQL[name] = f"{head}\nSELECT *{swap} FROM ({last}) AS result"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark, d):
    return view(spark, d, "fx_members")


def ladders(spark, d):
    return view(spark, d, "fx_ladders")


def runs(spark, d):
    return view(spark, d, "fx_runs")


def stats(spark, d):
    return A.ensemble_stats(members(spark, d))


def summaries(spark, d):
    return C.classified(A.bulk_summary(stats(spark, d)), ladders(spark, d))


STATS = """, ts AS (
  SELECT provider, run_id, provider_reach_id, forecast_time_utc, avg(flow_cms) AS flow_mean_cms,
         quantile_cont(flow_cms, 0.5) AS flow_median_cms, quantile_cont(flow_cms, 0.25) AS flow_p25_cms,
         quantile_cont(flow_cms, 0.75) AS flow_p75_cms, max(flow_cms) AS flow_max_cms
  FROM fx_members GROUP BY ALL)"""
BULK = """, bulk AS (
  SELECT provider, run_id, provider_reach_id,
         arg_max(forecast_time_utc, (flow_max_cms, -epoch_us(forecast_time_utc))) FILTER (WHERE flow_max_cms IS NOT NULL) AS peak_time_utc,
         max(flow_mean_cms) AS peak_mean_cms, max(flow_median_cms) AS peak_median_cms, max(flow_max_cms) AS peak_max_cms,
         (arg_min({'x': flow_mean_cms}, forecast_time_utc)).x AS now_mean_cms, (arg_min({'x': flow_max_cms}, forecast_time_utc)).x AS now_max_cms
  FROM ts GROUP BY provider, run_id, provider_reach_id)"""


def score_sql(peak: str) -> str:
    """Severity of ``peak`` on rp_2 ... rp_100; -1 where unknown."""
    ok = lambda r: f"({r} >= 0.01 AND isfinite({r}))"
    steps = "".join(f" WHEN {r} IS NULL OR NOT {ok(r)} OR {peak} < {r} THEN {i}" for i, r in enumerate(S.RUNGS) if i)
    return f"CASE WHEN {peak} IS NULL OR rp_2 IS NULL OR NOT {ok('rp_2')} THEN -1 WHEN {peak} < rp_2 THEN 0{steps} ELSE 6 END"


def classes(score: str = "s") -> str:
    return f"""CASE {score} WHEN -1 THEN 'unknown' WHEN 0 THEN 'below_2' WHEN 1 THEN '2' WHEN 2 THEN '5' WHEN 3 THEN '10' WHEN 4 THEN '25' WHEN 5 THEN '50' ELSE '100' END AS return_period_band,
         greatest({score}, 0)::INTEGER AS severity_score, {score} > 0 AS is_flagged"""


SUMMARIES = BULK + f""", sums AS (
  SELECT * EXCLUDE (s), {classes()}
  FROM (SELECT b.*, {score_sql('peak_mean_cms')} AS s FROM bulk b LEFT JOIN fx_ladders USING (provider, provider_reach_id)))"""
BASE = ctes("fx_members", "fx_ladders") + STATS
FULL = BASE + SUMMARIES
PEAKS = "peak_mean_cms peak_median_cms peak_max_cms now_mean_cms now_max_cms"
FLOWS = " ".join(S.FLOWS)
RUNGS = " ".join(S.RUNGS)


# --- aggregations -------------------------------------------------------------------------------


@query("agg1_ensemble_stats", BASE + "\n---\nSELECT * FROM ts", FLOWS)
def _(spark, d):
    return stats(spark, d)


@query("agg1_packed_ensemble_stats", BASE + "\n---\nSELECT * FROM ts", FLOWS)
def _(spark, d):
    packed = members(spark, d).groupBy(*S.TIME_KEYS).agg(F.collect_list("flow_cms").alias("flows"))
    return A.packed_ensemble_stats(packed)


GRID = """, grid AS (
  SELECT run_id, CASE WHEN member % 3 = 0 THEN 'cf' ELSE 'pf' END AS product, 10e0 + 0.05e0 * (provider_reach_id::BIGINT % 40) AS lat,
         20e0 + 0.05e0 * (provider_reach_id::BIGINT % 7) AS lon, forecast_time_utc,
         CASE WHEN member % 3 = 0 THEN NULL ELSE member END AS member, flow_cms FROM fx_members),
grid_stats AS (
  SELECT run_id, product, lat, lon, forecast_time_utc, avg(flow_cms) AS flow_mean_cms,
         CASE WHEN bool_or(member IS NOT NULL) THEN quantile_cont(flow_cms, 0.5) END AS flow_median_cms,
         CASE WHEN bool_or(member IS NOT NULL) THEN quantile_cont(flow_cms, 0.25) END AS flow_p25_cms,
         CASE WHEN bool_or(member IS NOT NULL) THEN quantile_cont(flow_cms, 0.75) END AS flow_p75_cms,
         CASE WHEN bool_or(member IS NOT NULL) THEN max(flow_cms) END AS flow_max_cms
  FROM grid WHERE flow_cms IS NOT NULL GROUP BY run_id, product, lat, lon, forecast_time_utc)"""


def grid_members(spark, d):
    control = F.col("member") % 3 == 0
    reach = F.col("provider_reach_id").cast("bigint")
    return members(spark, d).select("run_id", F.when(control, "cf").otherwise("pf").alias("product"), (F.lit(10.0) + F.lit(0.05) * (reach % 40)).alias("lat"), (F.lit(20.0) + F.lit(0.05) * (reach % 7)).alias("lon"), "forecast_time_utc", F.when(~control, F.col("member")).alias("member"), "flow_cms")


@query("agg2_grid_ensemble_stats", ctes("fx_members") + GRID + "\n---\nSELECT * FROM grid_stats", "lat lon " + FLOWS)
def _(spark, d):
    return A.grid_ensemble_stats(grid_members(spark, d))


@query("agg3_bulk_summary", BASE + BULK + "\n---\nSELECT * FROM bulk", PEAKS)
def _(spark, d):
    return A.bulk_summary(stats(spark, d))


@query(
    "agg4_grid_bulk_summary",
    ctes("fx_members") + GRID + """, c AS (
  SELECT run_id, lat, lon, max(flow_mean_cms) AS peak_mean_cms, NULL::DOUBLE AS peak_median_cms, max(flow_max_cms) AS peak_max_cms,
         arg_max(forecast_time_utc, (flow_max_cms, -epoch_us(forecast_time_utc))) FILTER (WHERE flow_max_cms IS NOT NULL) AS peak_time_utc,
         (arg_min({'x': flow_mean_cms}, forecast_time_utc)).x AS now_mean_cms, (arg_min({'x': flow_max_cms}, forecast_time_utc)).x AS now_max_cms
  FROM grid_stats g WHERE product = (SELECT min(product) FROM grid_stats h WHERE h.run_id = g.run_id) GROUP BY run_id, lat, lon),
m AS (SELECT cast(s_suppkey AS VARCHAR) AS provider_reach_id, 10e0 + 0.05e0 * (s_suppkey % 40) AS lat, 20e0 + 0.05e0 * (s_suppkey % 7) AS lon FROM supplier)
---
SELECT lat, lon, run_id, peak_time_utc, peak_mean_cms, peak_median_cms, peak_max_cms, now_mean_cms, now_max_cms, provider_reach_id
FROM c JOIN m USING (lat, lon)""",
    "lat lon " + PEAKS,
)
def _(spark, d):
    key = F.col("s_suppkey")
    cells = table(spark, d, "supplier").select(key.cast("string").alias("provider_reach_id"), (F.lit(10.0) + F.lit(0.05) * (key % 40)).alias("lat"), (F.lit(20.0) + F.lit(0.05) * (key % 7)).alias("lon"))
    return A.grid_bulk_summary(A.grid_ensemble_stats(grid_members(spark, d)), cells)


LONG = """, long AS (
  SELECT provider_reach_id::BIGINT AS river_id, m.method, p.return_period, p.value * m.f AS value, rp_100 * 2 AS max_simulated
  FROM fx_ladders, (VALUES ('gumbel', 1e0), ('logpearson3', 1.5e0)) m(method, f),
       LATERAL (VALUES (2, rp_2), (5, rp_5), (10, rp_10), (25, rp_25), (50, rp_50), (100, rp_100)) p(return_period, value))"""


def threshold_long(spark, d):
    rows = ladders(spark, d).withColumn("max_simulated", F.col("rp_100") * 2).unpivot(["provider_reach_id", "max_simulated"], S.RUNGS, "rung", "value")
    rows = rows.withColumn("m", F.explode(F.array(F.struct(F.lit("gumbel").alias("method"), F.lit(1.0).alias("f")), F.struct(F.lit("logpearson3").alias("method"), F.lit(1.5).alias("f")))))
    return rows.select(F.col("provider_reach_id").cast("bigint").alias("river_id"), F.substring("rung", 4, 3).cast("int").alias("return_period"), "m.method", (F.col("value") * F.col("m.f")).alias("value"), "max_simulated")


@query("agg5_pivot_ladder", ctes("fx_ladders") + LONG + "\n---\nSELECT 'reach' AS provider, river_id::VARCHAR AS provider_reach_id, " + ", ".join(f"max(value) FILTER (WHERE return_period = {p}) AS rp_{p}" for p in S.PERIODS) + " FROM long WHERE method = 'logpearson3' GROUP BY river_id", RUNGS)
def _(spark, d):
    return A.pivot_ladder(threshold_long(spark, d), "reach", "logpearson3").drop("metadata_json")


def reach_summary_sql(first: str, order: str) -> str:
    return BASE + f""", j AS (
  SELECT ts.*, rp_2 AS rung, coalesce(flow_max_cms, flow_mean_cms, flow_median_cms) AS v FROM ts LEFT JOIN fx_ladders USING (provider, provider_reach_id)),
a AS (
  SELECT provider, run_id, provider_reach_id, arg_max(forecast_time_utc, (coalesce(v, -1), -epoch_us(forecast_time_utc))) AS peak_time_utc,
         min(forecast_time_utc) FILTER (WHERE v >= rung) AS first_exceedance_time_utc, max(flow_mean_cms) AS peak_mean_cms,
         max(flow_median_cms) AS peak_median_cms, max(flow_max_cms) AS peak_max_cms, count(*) AS points
  FROM j GROUP BY provider, run_id, provider_reach_id),
want AS (
  SELECT DISTINCT 'reach' AS provider, '1998010100' AS run_id, cast(s_suppkey AS VARCHAR) AS provider_reach_id FROM supplier
  UNION SELECT provider, run_id, provider_reach_id FROM ts),
b AS (
  SELECT w.provider, w.run_id, w.provider_reach_id, a.* EXCLUDE (provider, run_id, provider_reach_id), {score_sql(order)} AS s
  FROM want w LEFT JOIN a USING (provider, run_id, provider_reach_id) LEFT JOIN fx_ladders USING (provider, provider_reach_id))
---
SELECT * EXCLUDE (s, points, return_period_band), {first} AS return_period_band, coalesce(points, 0) AS points FROM (SELECT *, {classes()} FROM b)"""


def requested(spark, d):
    more = table(spark, d, "supplier").select(F.lit("reach").alias("provider"), F.lit("1998010100").alias("run_id"), F.col("s_suppkey").cast("string").alias("provider_reach_id"))
    return more.unionByName(members(spark, d).select(*S.REACH_KEYS)).distinct()


@query("agg6_reach_summary_mean_first", reach_summary_sql("return_period_band", "coalesce(peak_mean_cms, peak_median_cms, peak_max_cms)"), "peak_mean_cms peak_median_cms peak_max_cms")
def _(spark, d):
    return A.reach_summary(stats(spark, d), ladders(spark, d), "mean_first", requested(spark, d))


@query("agg6_reach_summary_max_first", reach_summary_sql("CASE WHEN points IS NOT NULL THEN return_period_band END", "coalesce(peak_max_cms, peak_mean_cms, peak_median_cms)"), "peak_mean_cms peak_median_cms peak_max_cms")
def _(spark, d):
    return A.reach_summary(stats(spark, d), ladders(spark, d), "max_first", requested(spark, d))


COUNTS = """, held AS (SELECT * REPLACE (CASE WHEN right(provider_reach_id, 1) = '7' OR run_id = '1996010100' THEN 'other' ELSE provider END AS provider) FROM sums),
counts AS (
  SELECT provider, run_id, coalesce(timeseries_rows, 0) AS timeseries_rows, coalesce(reaches, 0) AS reaches, coalesce(summary_rows, 0) AS summary_rows, coalesce(supported_reaches, 0) AS supported_reaches
  FROM (SELECT provider, run_id, count(*) AS timeseries_rows, count(DISTINCT provider_reach_id) AS reaches FROM ts GROUP BY ALL)
  FULL JOIN (SELECT provider, run_id, count(*) AS summary_rows FROM held GROUP BY ALL) USING (provider, run_id)
  LEFT JOIN (SELECT provider, count(DISTINCT provider_reach_id) AS supported_reaches FROM fx_ladders GROUP BY ALL) USING (provider))"""


def some_summaries(spark, d):
    """Summaries of which a tenth and a whole run are another provider's."""
    return summaries(spark, d).withColumn("provider", F.expr("CASE WHEN right(provider_reach_id, 1) = '7' OR run_id = '1996010100' THEN 'other' ELSE provider END"))


def counts(spark, d):
    return A.run_counts(stats(spark, d), some_summaries(spark, d), ladders(spark, d))


@query("agg7_run_counts", FULL + COUNTS + "\n---\nSELECT * FROM counts")
def _(spark, d):
    return counts(spark, d)


OPS = """, fx_runs AS (SELECT DISTINCT 'reach' AS provider, concat(year(o_orderdate)::VARCHAR, '010100') AS run_id, date_trunc('year', o_orderdate)::TIMESTAMP AS run_date_utc FROM orders),
ready AS (
  SELECT r.provider, r.run_id, (y % 2 = 0) AS raw, (y % 5 <> 4) AS present, coalesce(timeseries_rows, 0) > 0 AS ingested,
         coalesce(summary_rows, 0) > 0 AND (y % 3 <> 0 OR y % 4 <> 2) AS summarized
  FROM (SELECT *, left(run_id, 4)::INTEGER AS y FROM fx_runs) r LEFT JOIN counts USING (provider, run_id)),
status AS (
  SELECT provider, run_id, summarized AS map_ready,
         concat_ws(',', 'discovered', CASE WHEN raw THEN 'raw_acquired' END, CASE WHEN present THEN 'artifact_prepared' END, CASE WHEN ingested THEN 'ingested' END,
                   CASE WHEN summarized THEN 'summarized' END, CASE WHEN summarized THEN 'map_ready' END) AS completed,
         concat_ws(',', CASE WHEN NOT raw THEN 'raw_acquired' END, CASE WHEN NOT present THEN 'artifact_prepared' END, CASE WHEN NOT ingested THEN 'ingested' END,
                   CASE WHEN NOT summarized THEN 'summarized' END, CASE WHEN NOT summarized THEN 'map_ready' END) AS missing,
         CASE WHEN summarized THEN 'map_ready' WHEN ingested THEN 'ingested' WHEN present THEN 'artifact_prepared' WHEN raw THEN 'raw_acquired' ELSE 'discovered' END AS current_status
  FROM ready)"""


def readiness(spark, d):
    r = runs(spark, d)
    y = F.left("run_id", F.lit(4)).cast("int")
    ops = r.select(*S.RUN_KEYS, (y % 2 == 0).alias("raw_succeeded"), (y % 3 == 0).alias("ingest_attempted"), F.lit(True).alias("ingest_succeeded"), F.when(y % 4 == 2, F.lit("old")).otherwise(F.lit("new")).alias("ingest_signature"))
    # a run without an artifact has no signature: the gate is judged on present ones
    artifacts = r.where(y % 5 != 4).select(*S.RUN_KEYS, F.lit("new").alias("signature"))
    return A.run_readiness(r, counts(spark, d), ops, artifacts)


OPS = OPS.replace("(y % 3 <> 0 OR y % 4 <> 2) AS summarized", "(y % 3 <> 0 OR (y % 4 <> 2 AND y % 5 <> 4)) AS summarized")


@query("agg8_run_readiness", FULL + COUNTS + OPS + "\n---\nSELECT * FROM status")
def _(spark, d):
    text = lambda c: F.array_join(c, ",")
    return readiness(spark, d).select(*S.RUN_KEYS, "map_ready", text("completed_stages").alias("completed"), text("missing_stages").alias("missing"), "current_status")


@query("agg9_provider_health", FULL + COUNTS + OPS + "\n---\nSELECT provider, run_id, timeseries_rows, reaches, summary_rows, supported_reaches, current_status, map_ready FROM counts JOIN status USING (provider, run_id) WHERE summary_rows > 0 AND run_id IN (SELECT run_id FROM fx_runs) ORDER BY run_id DESC LIMIT 1")
def _(spark, d):
    return A.provider_health(runs(spark, d), counts(spark, d), readiness(spark, d))


@query("agg12_annual_maxima", """WITH y AS (SELECT l_suppkey, year(l_shipdate) AS year, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL)
---
SELECT cast(l_suppkey AS VARCHAR) AS provider_reach_id, count(*)::INTEGER AS years, min(top)::DOUBLE AS least, max(top)::DOUBLE AS most FROM y GROUP BY l_suppkey""", "least most")
def _(spark, d):
    rows = A_history(spark, d)
    return T.annual_maxima(rows, ["provider_reach_id"]).select("provider_reach_id", F.size("maxima").alias("years"), F.element_at("maxima", 1).alias("least"), F.element_at("maxima", -1).alias("most"))


def A_history(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("provider_reach_id"), F.col("l_shipdate").alias("time"), F.col("l_extendedprice").cast("double").alias("flow_cms"))


def gumbel_sql(samples: str) -> str:
    """fits(k, n, loc, scale) for the table ``samples`` (k, x: list, n): two hundred halvings of an interval that holds the
    root of the likelihood equation."""
    weight = lambda v, at: f"exp(-({v} - low) / {at})"
    excess = lambda at: f"{at} - mean + list_sum(list_transform(x, lambda v: v * {weight('v', at)})) / list_sum(list_transform(x, lambda v: {weight('v', at)}))"
    return f""", stat AS (SELECT k, x, n, list_min(x) AS low, list_avg(x) AS mean, 4 * (list_max(x) - list_min(x)) AS top FROM {samples} WHERE n >= 2 AND list_min(x) < list_max(x)),
half AS (
  SELECT k, x, n, low, mean, 1e-9 AS a, top * 16 AS b, 0 AS i FROM stat
  UNION ALL
  SELECT k, x, n, low, mean, CASE WHEN e > 0 THEN a ELSE m END, CASE WHEN e > 0 THEN m ELSE b END, i + 1
  FROM (SELECT *, {excess('m')} AS e FROM (SELECT *, (a + b) / 2 AS m FROM half WHERE i < 80) h) g),
fits AS (
  SELECT k, n, low - (a + b) / 2 * ln(list_avg(list_transform(x, lambda v: {weight('v', '((a + b) / 2)')}))) AS loc, (a + b) / 2 AS scale FROM half WHERE i = 80)"""


def quantile_sql(p: float) -> str:
    return f"round(loc - scale * ln(-ln({p!r}::DOUBLE)) + 1e-9, 2)"


@query("agg13_gumbel_thresholds", """WITH RECURSIVE y AS (SELECT l_suppkey, year(l_shipdate) AS year, max(l_extendedprice)::DOUBLE AS top FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL),
s AS (SELECT cast(l_suppkey AS VARCHAR) AS k, list(top ORDER BY top) AS x, count(*) AS n FROM y GROUP BY l_suppkey HAVING count(*) >= 5)""" + gumbel_sql("s") + f"""
---
SELECT k AS provider_reach_id, {quantile_sql(0.5)} AS rp_2, {quantile_sql(0.8)} AS rp_5, {quantile_sql(0.95)} AS rp_20, n::INTEGER AS sample_count FROM fits""")
def _(spark, d):
    rows = T.gumbel_thresholds(T.annual_maxima(A_history(spark, d), ["provider_reach_id"]))
    return rows.withColumns({r: F.round(F.col(r) + F.lit(1e-9), 2) for r in ("rp_2", "rp_5", "rp_20")})


def cell_history(spark, d):
    key = F.col("l_suppkey")
    return table(spark, d, "lineitem").select((F.lit(10.0) + F.lit(0.05) * key).alias("lat"), (F.lit(20.0) + F.col("l_quantity").cast("int")).alias("lon"), F.col("l_extendedprice").cast("double").alias("flow_cms"))


@query("agg14_reach_thresholds_from_history", """WITH RECURSIVE s AS (SELECT concat(l_suppkey::VARCHAR, '-', l_quantity::INTEGER::VARCHAR) AS k, list(l_extendedprice::DOUBLE ORDER BY l_extendedprice) AS x, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_suppkey, l_quantity::INTEGER),
many AS (SELECT * FROM s WHERE n >= 10)""" + gumbel_sql("many") + f""",
every AS (
  SELECT k, n, {quantile_sql(0.5)} AS rp_2, {quantile_sql(0.8)} AS rp_5, {quantile_sql(0.95)} AS rp_25 FROM fits
  UNION ALL SELECT k, n, """ + ", ".join(f"round(list_aggregate(x, 'quantile_cont', {p}) + 1e-9, 2)" for p in (0.5, 0.8, 0.95)) + """ FROM s WHERE n < 10)
---
SELECT 'grid' AS provider, k AS provider_reach_id, rp_2, rp_5, NULL::DOUBLE AS rp_10, rp_25, NULL::DOUBLE AS rp_50, NULL::DOUBLE AS rp_100, concat('{"sample_count":', n, '}') AS metadata_json FROM every""")
def _(spark, d):
    key = F.col("s_suppkey")
    # a cell for each supplier and quantity: about 12 values, so that both fits occur
    cells = table(spark, d, "supplier").select(key, F.explode(F.sequence(F.lit(1), F.lit(50))).alias("q")).select(F.concat_ws("-", key, "q").alias("provider_reach_id"), (F.lit(10.0) + F.lit(0.05) * key).alias("lat"), (F.lit(20.0) + F.col("q")).alias("lon"))
    rows = T.reach_thresholds_from_history(cells, cell_history(spark, d), "grid")
    return rows.withColumns({r: F.round(F.col(r) + F.lit(1e-9), 2) for r in ("rp_2", "rp_5", "rp_25")})


@query(
    "agg15_request_rollup",
    """WITH s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'reach' ELSE 'grid' END AS provider, event_type AS endpoint, CASE WHEN event_id % 10 = 0 THEN 500 ELSE 200 END AS status_code, value::DOUBLE AS duration_ms, event_id AS payload_bytes FROM events)
---
SELECT provider, endpoint, count(*) AS total, count(*) FILTER (WHERE status_code = 200) AS ok, count(*) FILTER (WHERE status_code <> 200) AS errors,
       round(quantile_cont(duration_ms, 0.5) FILTER (WHERE status_code = 200) + 1e-9, 2) AS p50_ms, round(quantile_cont(duration_ms, 0.95) FILTER (WHERE status_code = 200) + 1e-9, 2) AS p95_ms,
       floor(quantile_cont(payload_bytes, 0.5) FILTER (WHERE status_code = 200))::BIGINT AS p50_bytes, floor(quantile_cont(payload_bytes, 0.95) FILTER (WHERE status_code = 200))::BIGINT AS p95_bytes
FROM s GROUP BY provider, endpoint""",
)
def _(spark, d):
    samples = table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "reach").otherwise("grid").alias("provider"), F.col("event_type").alias("endpoint"), F.when(F.col("event_id") % 10 == 0, 500).otherwise(200).alias("status_code"), F.col("value").cast("double").alias("duration_ms"), F.col("event_id").alias("payload_bytes"))
    return A.request_rollup(samples)


# --- projections and filters --------------------------------------------------------------------

RAW = """, raw AS (
  SELECT CASE WHEN event_id % 13 = 0 THEN ' ' ELSE concat(' ', (user_id % 120)::VARCHAR, ' ') END AS river_id, ts,
         CASE WHEN event_id % 17 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time,
         CASE WHEN event_id % 7 = 0 THEN 'nan' ELSE value::VARCHAR END AS flow_avg, CASE WHEN event_id % 5 = 0 THEN '' ELSE (value * 2)::VARCHAR END AS flow_max, event_id, value
  FROM events),
norm AS (
  SELECT 'reach' AS provider, '2026010100' AS run_id, trim(river_id) AS provider_reach_id, date_trunc('second', ts)::TIMESTAMP AS forecast_time_utc,
         CASE WHEN event_id % 7 <> 0 THEN value::DOUBLE END AS flow_mean_cms, CASE WHEN event_id % 5 <> 0 THEN (value * 2)::DOUBLE END AS flow_max_cms, event_id
  FROM raw WHERE event_id % 13 <> 0 AND event_id % 17 <> 0)"""


def raw_records(spark, d):
    text = lambda c: c.cast("string")
    e = F.col("event_id")
    return table(spark, d, "events").select(F.when(e % 13 == 0, " ").otherwise(F.concat(F.lit(" "), text(F.col("user_id") % 120), F.lit(" "))).alias("river_id"), F.when(e % 17 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time"), F.when(e % 7 == 0, "nan").otherwise(text(F.col("value"))).alias("flow_avg"), F.when(e % 5 == 0, "").otherwise(text(F.col("value") * 2)).alias("flow_max"), e.alias("event_id"))


@query("prj2_normalize_timeseries", "WITH one AS (SELECT 1)" + RAW + "\n---\nSELECT provider, run_id, provider_reach_id, forecast_time_utc, flow_mean_cms, flow_max_cms, event_id::VARCHAR AS event FROM norm", "flow_mean_cms flow_max_cms")
def _(spark, d):
    rows = P.normalize_timeseries(raw_records(spark, d), "reach", "2026010100")
    return rows.select("provider", "run_id", "provider_reach_id", "forecast_time_utc", "flow_mean_cms", "flow_max_cms", F.get_json_object("raw_payload_json", "$.event_id").alias("event"))


@query("agg16_prepare_stats", ctes("fx_ladders") + RAW + """
---
SELECT count(*) AS records_seen, count(*) FILTER (WHERE bad) AS invalid_dropped, count(*) FILTER (WHERE NOT bad AND NOT known) AS filtered_dropped, count(*) FILTER (WHERE NOT bad AND known) AS written
FROM (SELECT event_id % 13 = 0 OR event_id % 17 = 0 AS bad, trim(river_id) IN (SELECT provider_reach_id FROM fx_ladders) AS known FROM raw)""")
def _(spark, d):
    return A.prepare_stats(P.normalize_timeseries(raw_records(spark, d), "reach", "2026010100", tag=True), ladders(spark, d), "reach")


@query("prj1_resolve_ladder", ctes("fx_ladders") + "\n---\nSELECT 'grid' AS provider, provider_reach_id, rp_2, rp_5, rp_10, NULL::DOUBLE AS rp_25, rp_50, rp_100 FROM fx_ladders", RUNGS)
def _(spark, d):
    odd = ladders(spark, d).select(F.concat("provider_reach_id", F.lit(".0")).alias("River_ID"), F.col("rp_2").alias("return_period_2"), F.col("rp_5").cast("string").alias("RP5"), F.col("rp_10").alias("q10"), F.col("rp_50").alias("rp_50"), F.col("rp_100").alias("rp_100"))
    return P.resolve_ladder(odd, "grid").drop("metadata_json")


@query("prj5_map_view", FULL + "\n---\nSELECT * FROM sums", PEAKS)
def _(spark, d):
    return P.map_view(summaries(spark, d))


@query("flt1_drop_empty_stats", BASE + "\n---\nSELECT * FROM ts WHERE coalesce(flow_mean_cms, flow_median_cms, flow_p25_cms, flow_p75_cms, flow_max_cms) IS NOT NULL", FLOWS)
def _(spark, d):
    return L.drop_empty_stats(stats(spark, d))


GUARD = """, guarded AS (
  SELECT *, CASE WHEN rp_2 IS NULL OR rp_5 IS NULL OR rp_10 IS NULL OR rp_25 IS NULL OR rp_50 IS NULL OR rp_100 IS NULL THEN 'missing'
                 WHEN rp_2 < 0.01 OR rp_100 < 0.01 THEN 'too_small' WHEN rp_2 = rp_100 AND rp_2 < 0.1 THEN 'flat'
                 WHEN NOT (rp_2 < rp_5 AND rp_5 < rp_10 AND rp_10 < rp_25 AND rp_25 < rp_50 AND rp_50 < rp_100) THEN 'not_increasing' END AS reason FROM fx_ladders)"""


@query("flt2_sanitize_ladder", ctes("fx_ladders") + GUARD + "\n---\nSELECT * EXCLUDE (reason) FROM guarded WHERE reason IS NULL", RUNGS)
def _(spark, d):
    return L.sanitize_ladder(ladders(spark, d))


@query("flt2_rejected_ladders", ctes("fx_ladders") + GUARD + "\n---\nSELECT provider, reason, count(*) AS ladders FROM guarded WHERE reason IS NOT NULL GROUP BY provider, reason")
def _(spark, d):
    return L.rejected_ladders(ladders(spark, d))


@query("flt3_valid_reaches", "SELECT cast(s_suppkey AS VARCHAR) AS reach_id, (s_suppkey % 90)::DOUBLE AS lat, (s_suppkey % 180)::DOUBLE AS lon, s_acctbal::DOUBLE AS reach_upstream_area_km2 FROM supplier WHERE s_suppkey % 7 <> 0 AND s_acctbal > 0", "reach_upstream_area_km2")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("reach_id"), F.when(k % 7 == 0, F.lit("nan")).otherwise((k % 90).cast("string")).alias("lat"), (k % 180).alias("lon"), (F.col("s_acctbal").cast("double") * 1e6).alias("area_m2"))
    return L.valid_reaches(rows)


@query("flt4_river_cells", ctes("fx_cells") + "\n---\nSELECT grid_lat, grid_lon, grid_upstream_area_km2, rp_2 FROM fx_cells WHERE rp_2 >= 1 AND grid_upstream_area_km2 > 0", "grid_lat grid_lon grid_upstream_area_km2 rp_2")
def _(spark, d):
    cells = view(spark, d, "fx_cells")
    return L.river_cells(cells.drop("rp_2"), cells.select("grid_lat", "grid_lon", "rp_2"))


@query("flt6_filter_summaries", FULL + "\n---\nSELECT provider_reach_id, severity_score FROM sums WHERE run_id = '1997010100' AND is_flagged AND severity_score >= 1")
def _(spark, d):
    return L.filter_summaries(summaries(spark, d), "reach", "1997010100", True, 1).select("provider_reach_id", "severity_score")


@query("flt7_run_ids", "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') || '00' AS run_id FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    paths = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("store/"), day, F.lit(".tmp"))).otherwise(F.concat(F.lit("store/forecasts/"), day, F.lit("00.zarr/"))).alias("path"))
    return L.parse_run_ids(paths)


@query("flt7_latest_listed_run", "SELECT max(strftime(o_orderdate, '%Y%m%d') || '00') AS run_id FROM orders")
def _(spark, d):
    return L.latest_listed_run(table(spark, d, "orders").select(F.concat(F.lit("x/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("00.zarr")).alias("path")))


@query("flt8_validate_reach_ids", "SELECT o_orderkey % 2 = 0 AS is_valid, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(k % 2 == 0, F.concat(F.lit(" "), F.lpad(k.cast("string"), 9, "7"), F.lit(" "))).otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("provider_reach_id"))
    return L.validate_reach_ids(rows).groupBy("is_valid").agg(F.count("*").alias("n"))


@query("flt9_severity_for_zoom", FULL + "\n---\nSELECT zoom::INTEGER AS zoom, run_id, count(*) AS shown FROM sums, (SELECT unnest([2, 3, 5, 7, 9]) AS zoom) WHERE severity_score >= CASE WHEN zoom <= 3 THEN 4 WHEN zoom <= 5 THEN 3 WHEN zoom <= 7 THEN 2 ELSE 1 END GROUP BY ALL")
def _(spark, d):
    rows = summaries(spark, d).withColumn("zoom", F.explode(F.array(*map(F.lit, (2, 3, 5, 7, 9)))))
    return L.severity_for_zoom(rows, F.col("zoom")).groupBy("zoom", "run_id").agg(F.count("*").alias("shown"))


def _interp_sql(stops):
    inner = " ".join(f"WHEN zoom <= {b[0]} THEN {a[1]}::DOUBLE + (zoom - {a[0]}) / {b[0] - a[0]}::DOUBLE * {b[1] - a[1]}" for a, b in zip(stops, stops[1:], strict=False))
    return f"CASE WHEN zoom <= {stops[0][0]} THEN {stops[0][1]} {inner} ELSE {stops[-1][1]} END"


@query("flt10_visible_streams", f"""WITH s AS (
  SELECT CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_size % 10 END AS o, p_retailprice::DOUBLE * (p_size % 10) * 5 AS a FROM part),
z AS (SELECT unnest([0.0, 4.5, 6.5, 8.5, 10.0])::DOUBLE AS zoom)
---
SELECT zoom, count(*) AS shown FROM (SELECT coalesce(o, 5) AS o, coalesce(a, 0) AS a, zoom FROM s, z)
WHERE (o >= 7 AND a >= {_interp_sql(L.MAJOR_AREA)}) OR (zoom >= 6 AND o >= 4 AND o < 7 AND a >= {_interp_sql(L.MEDIUM_AREA)}) OR (zoom >= 8 AND o < 4 AND a >= {_interp_sql(L.MINOR_AREA)})
GROUP BY zoom""")
def _(spark, d):
    rows = table(spark, d, "part").select(F.when(F.col("p_partkey") % 19 != 0, F.col("p_size") % 10).alias("strmOrder"), (F.col("p_retailprice").cast("double") * (F.col("p_size") % 10) * 5).alias("DSContArea"))
    rows = rows.withColumn("zoom", F.explode(F.array(*map(F.lit, (0.0, 4.5, 6.5, 8.5, 10.0)))))
    return L.visible_streams(rows, F.col("zoom")).groupBy("zoom").agg(F.count("*").alias("shown"))


# --- joins --------------------------------------------------------------------------------------


@query("jn1_join_reach_attributes", "SELECT cast(s_suppkey AS VARCHAR) AS reach_id, (s_suppkey % 90)::DOUBLE AS lat, s_acctbal::DOUBLE AS \"DSContArea\" FROM supplier WHERE s_suppkey % 4 <> 0", '"DSContArea"')
def _(spark, d):
    s = table(spark, d, "supplier")
    meta = s.select(F.col("s_suppkey").cast("double").alias("LINKNO"), (F.col("s_suppkey") % 90).cast("double").alias("lat"))
    link = F.when(F.col("s_suppkey") % 4 == 0, -F.col("s_suppkey") - 1).otherwise(F.col("s_suppkey"))  # of no reach
    attributes = s.select(link.alias("LINKNO"), F.col("s_acctbal").cast("double").alias("DSContArea"))
    return J.join_reach_attributes(meta, attributes)


@query("jn2_supported_only", BASE + "\n---\nSELECT * FROM ts WHERE provider_reach_id IN (SELECT provider_reach_id FROM fx_ladders)", FLOWS)
def _(spark, d):
    return J.supported_only(stats(spark, d), ladders(spark, d), "reach")


@query("jn3_dropped_unsupported", BASE + "\n---\nSELECT provider, count(*) AS dropped FROM ts WHERE provider_reach_id NOT IN (SELECT provider_reach_id FROM fx_ladders) GROUP BY provider")
def _(spark, d):
    return J.dropped_unsupported(stats(spark, d), ladders(spark, d))


@query("jn4_attach_thresholds", FULL + "\n---\nSELECT run_id, provider_reach_id, peak_mean_cms, rp_2, rp_100 FROM sums LEFT JOIN fx_ladders USING (provider, provider_reach_id)", "peak_mean_cms rp_2 rp_100")
def _(spark, d):
    return J.attach_thresholds(summaries(spark, d), ladders(spark, d)).select("run_id", "provider_reach_id", "peak_mean_cms", "rp_2", "rp_100")


STREAMS = """WITH f AS (SELECT s_suppkey, s_acctbal::DOUBLE AS own, s_suppkey % 9 AS o FROM supplier WHERE s_suppkey % 8 <> 0),
m AS (SELECT p_partkey AS link, p_size AS o, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice::DOUBLE END AS a FROM part WHERE p_partkey % 3 = 0),
e AS (SELECT s_suppkey::VARCHAR AS reach_id, CASE WHEN link IS NOT NULL THEN coalesce(m.o, 1) ELSE coalesce(f.o, 1) END::INTEGER AS "strmOrder", CASE WHEN link IS NOT NULL THEN coalesce(a, 0) ELSE coalesce(own, 0) END AS "DSContArea",
      concat('{"type":"Point","k":', s_suppkey, '}') AS geometry, link IS NOT NULL AS has_model FROM f LEFT JOIN m ON link = s_suppkey)"""


def stream_features(spark, d):
    k = F.col("s_suppkey")
    props = F.to_json(F.struct(F.lit(" ").alias("reach_id"), F.when(k % 8 != 0, k.cast("double").cast("string")).alias("LINKNO"), (k % 9).alias("strmOrder"), F.col("s_acctbal").cast("double").alias("DSContArea")))
    return table(spark, d, "supplier").select(props.alias("props"), F.concat(F.lit('{"type":"Point","k":'), k.cast("string"), F.lit("}")).alias("geometry"))


def stream_model(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.when(k % 3 == 0, k).otherwise(-k).cast("string").alias("LINKNO"), F.col("p_size").alias("strmOrder"), F.when(k % 5 != 0, F.col("p_retailprice").cast("double")).alias("DSContArea"))


@query("jn5_enrich_streams", STREAMS + "\n---\nSELECT * FROM e", '"DSContArea"')
def _(spark, d):
    return J.enrich_streams(stream_features(spark, d), stream_model(spark, d))


@query("jn5_enrich_counts", STREAMS + "\n---\nSELECT (SELECT count(*) FROM supplier) AS processed, count(*) AS written, (SELECT count(*) FROM supplier) - count(*) AS missing_id, count(*) FILTER (WHERE NOT has_model) AS missing_attributes FROM e")
def _(spark, d):
    features = stream_features(spark, d)
    return J.enrich_counts(features, J.enrich_streams(features, stream_model(spark, d)))


@query("jn7_snap_regular", ctes("fx_reaches") + "\n---\nSELECT reach_id, 10e0 + 0.25e0 * greatest(0, least(7, floor((lat - 10) / 0.25 + 0.5))) AS snapped FROM fx_reaches", "snapped")
def _(spark, d):
    return view(spark, d, "fx_reaches").select("reach_id", J.snap_regular("lat", 11.75, -0.25, 8).alias("snapped"))


@query("jn7_snap_irregular", ctes("fx_reaches") + ", axis AS (SELECT unnest([10.0, 10.1, 10.4, 11.0, 13.0])::DOUBLE AS a)\n---\nSELECT reach_id, arg_min(a, (round(abs(a - lat), 9), -a)) AS snapped FROM fx_reaches, axis GROUP BY reach_id", "snapped")
def _(spark, d):
    rows = view(spark, d, "fx_reaches")
    return J.snap_irregular(rows.withColumn("lat", F.round("lat", 9)), "lat", [13.0, 10.0, 10.4, 10.1, 11.0], "snapped").select("reach_id", "snapped")


def grid_matches(spark, d):
    return view(spark, d, "fx_reaches").select("reach_id", F.when(F.col("reach_id").cast("int") % 2 == 0, F.round(F.col("lat") / 0.05) * 0.05).otherwise(F.col("lat")).alias("grid_lat"), F.when(F.col("reach_id").cast("int") % 2 == 0, F.round(F.col("lon") / 0.05) * 0.05).otherwise(F.col("lon")).alias("grid_lon"))


@query(
    "jn8_thresholds_for_reaches",
    ctes("fx_reaches", "fx_cells") + """, x AS (
  SELECT reach_id, CASE WHEN reach_id::INTEGER % 2 = 0 THEN round(lat / 0.05e0) * 0.05e0 ELSE lat END AS y, CASE WHEN reach_id::INTEGER % 2 = 0 THEN round(lon / 0.05e0) * 0.05e0 ELSE lon END AS x FROM fx_reaches),
p AS (
  SELECT reach_id, grid_lat, grid_lon, rp_2, round(y * 10000) = round(grid_lat * 10000) AND round(x * 10000) = round(grid_lon * 10000) AS exact, abs(y - grid_lat) + abs(x - grid_lon) AS l1
  FROM x, fx_cells WHERE abs(y - grid_lat) + abs(x - grid_lon) < 0.06),
r AS (SELECT *, row_number() OVER (PARTITION BY reach_id ORDER BY exact DESC, round(l1, 9), grid_lat, grid_lon) AS n FROM p)
---
SELECT reach_id, grid_lat AS cell_lat, grid_lon AS cell_lon, rp_2, exact FROM r WHERE n = 1""",
    "cell_lat cell_lon rp_2",
)
def _(spark, d):
    grid = view(spark, d, "fx_cells").select(F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"), "rp_2")
    return J.thresholds_for_reaches(grid_matches(spark, d), grid)


@query(
    "jn9_threshold_grid_to_reaches",
    ctes("fx_reaches", "fx_cells") + """, x AS (
  SELECT reach_id, greatest(0, least(39, floor((y - 10) / 0.05 + 0.5)))::BIGINT AS iy, greatest(0, least(19, floor((x - 20) / 0.05 + 0.5)))::BIGINT AS ix
  FROM (SELECT reach_id, CASE WHEN reach_id::INTEGER % 2 = 0 THEN round(lat / 0.05e0) * 0.05e0 ELSE lat END AS y, CASE WHEN reach_id::INTEGER % 2 = 0 THEN round(lon / 0.05e0) * 0.05e0 ELSE lon END AS x FROM fx_reaches)),
c AS (SELECT round((grid_lat - 10) / 0.05)::BIGINT AS iy, round((grid_lon - 20) / 0.05)::BIGINT AS ix, rp_2 FROM fx_cells)
---
SELECT 'grid' AS provider, reach_id AS provider_reach_id, rp_2, rp_2 * 2 AS rp_5, NULL::DOUBLE AS rp_10, rp_2 * 3 AS rp_25, NULL::DOUBLE AS rp_50, NULL::DOUBLE AS rp_100 FROM x JOIN c USING (iy, ix)""",
    RUNGS,
)
def _(spark, d):
    periods = F.explode(F.array(*(F.struct(F.lit(p).alias("return_period"), F.lit(f).alias("f")) for p, f in ((2, 1.0), (5, 2.0), (10, -1.0), (20, 3.0)))))
    grid = view(spark, d, "fx_cells").select(F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"), "rp_2", periods.alias("p")).select("lat", "lon", "p.return_period", (F.col("rp_2") * F.col("p.f")).alias("threshold"))
    return J.threshold_grid_to_reaches(grid_matches(spark, d), grid, (10.0, 0.05, 40), (20.0, 0.05, 20), "grid")


CROSSWALK = ctes("fx_reaches", "fx_cells") + """, near AS (
  SELECT r.reach_id, r.reach_upstream_area_km2, c.grid_lat, c.grid_lon, c.grid_upstream_area_km2, 6371 * sqrt((radians(lat) - radians(grid_lat)) ** 2 + (radians(lon) - radians(grid_lon)) ** 2) AS distance_km
  FROM fx_reaches r, fx_cells c WHERE c.rp_2 >= 1),
k AS (
  SELECT *, greatest(reach_upstream_area_km2, grid_upstream_area_km2) / least(reach_upstream_area_km2, grid_upstream_area_km2) AS area_ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY reach_id ORDER BY round(distance_km, 9), grid_lat, grid_lon) AS n FROM near WHERE distance_km <= 20) WHERE n <= 16),
best AS (
  SELECT * FROM (SELECT *, distance_km + abs(ln(area_ratio)) * 20 AS match_score, row_number() OVER (PARTITION BY reach_id ORDER BY round(distance_km + abs(ln(area_ratio)) * 20, 9), round(distance_km, 9), grid_lat, grid_lon) AS m FROM k WHERE area_ratio <= 10) WHERE m = 1),
xw AS (
  SELECT r.reach_id, 'grid' AS target_provider, grid_lat, grid_lon, grid_upstream_area_km2 AS upstream_area_km2, r.reach_upstream_area_km2, grid_upstream_area_km2, area_ratio, distance_km, match_score, 'distance_plus_area_v1' AS match_method, m IS NOT NULL AS is_valid_match
  FROM fx_reaches r LEFT JOIN best b ON r.reach_id = b.reach_id)"""
XW = "grid_lat grid_lon upstream_area_km2 reach_upstream_area_km2 grid_upstream_area_km2 area_ratio distance_km match_score"


def crosswalk(spark, d):
    cells = L.river_cells(view(spark, d, "fx_cells")).where("rp_2 >= 1")
    return C.build_crosswalk(view(spark, d, "fx_reaches"), cells, "grid")


@query("jn10_knn_candidates", CROSSWALK + "\n---\nSELECT reach_id, grid_lat, grid_lon, distance_km, n::INTEGER AS nth FROM k", "grid_lat grid_lon distance_km")
def _(spark, d):
    return J.knn_candidates(view(spark, d, "fx_reaches"), view(spark, d, "fx_cells").where("rp_2 >= 1")).select("reach_id", "grid_lat", "grid_lon", "distance_km", "nth")


@query("cmp8_build_crosswalk", CROSSWALK + "\n---\nSELECT * FROM xw", XW)
def _(spark, d):
    return crosswalk(spark, d)


@query("flt5_valid_crosswalk", CROSSWALK + "\n---\nSELECT reach_id, grid_lat, grid_lon FROM xw WHERE is_valid_match", "grid_lat grid_lon")
def _(spark, d):
    return L.valid_crosswalk(crosswalk(spark, d), "grid").select("reach_id", "grid_lat", "grid_lon")


@query("agg10_crosswalk_report", CROSSWALK + """
---
SELECT count(*) AS reaches, count(*) FILTER (WHERE is_valid_match) AS matched, 100.0::DOUBLE * count(*) FILTER (WHERE is_valid_match) / count(*) AS matched_pct, 100.0::DOUBLE * count(*) FILTER (WHERE NOT is_valid_match) / count(*) AS rejected_pct,
""" + ",\n".join(f"quantile_cont({c}, {p / 100}) AS {c}_p{p}" for c in ("distance_km", "area_ratio", "match_score") for p in (50, 90, 99)) + ",\n" + ", ".join(f"count(*) FILTER (WHERE {c} > {n}) AS {name}_over_{n}" for name, c, ns in (("ratio", "area_ratio", (2, 5)), ("distance", "distance_km", (5, 10))) for n in ns) + " FROM xw", "matched_pct rejected_pct " + " ".join(f"{c}_p{p}" for c in ("distance_km", "area_ratio", "match_score") for p in (50, 90, 99)))
def _(spark, d):
    return A.crosswalk_report(crosswalk(spark, d))


@query("agg11_area_stats", ctes("fx_reaches") + "\n---\nSELECT min(reach_upstream_area_km2) AS min_area, median(reach_upstream_area_km2) AS median_area, max(reach_upstream_area_km2) AS max_area FROM fx_reaches", "min_area median_area max_area")
def _(spark, d):
    return A.area_stats(view(spark, d, "fx_reaches"), "reach_upstream_area_km2")


@query("prj7_backfill_reach_area", CROSSWALK + "\n---\nSELECT reach_id, CASE WHEN reach_id::INTEGER % 2 = 0 THEN upstream_area_km2 ELSE reach_upstream_area_km2 END AS reach_upstream_area_km2 FROM xw", "reach_upstream_area_km2")
def _(spark, d):
    rows = crosswalk(spark, d).withColumn("reach_upstream_area_km2", F.when(F.col("reach_id").cast("int") % 2 != 0, F.col("reach_upstream_area_km2")))
    return P.backfill_reach_area(rows).select("reach_id", "reach_upstream_area_km2")


@query("jn11_runs_with_data", FULL + COUNTS + OPS + "\n---\nSELECT * FROM fx_runs WHERE run_id IN (SELECT run_id FROM held WHERE provider = 'reach')")
def _(spark, d):
    return J.runs_with_data(runs(spark, d), some_summaries(spark, d))


@query("jn12_reach_detail", FULL + """, want AS (SELECT DISTINCT 'reach' AS provider, '1997010100' AS run_id, cast(s_suppkey AS VARCHAR) AS provider_reach_id FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY provider, run_id, provider_reach_id ORDER BY forecast_time_utc) AS n FROM ts)
---
SELECT w.provider_reach_id, count(n.n)::INTEGER AS points, min(n.forecast_time_utc) AS first_time, max(n.flow_max_cms) FILTER (WHERE n.n = 1) AS first_max, any_value(rp_2) AS rp_2, any_value(severity_score) AS severity_score
FROM want w LEFT JOIN n ON w.provider_reach_id = n.provider_reach_id AND w.run_id = n.run_id AND n.n <= 6 LEFT JOIN fx_ladders l ON w.provider_reach_id = l.provider_reach_id LEFT JOIN sums s ON s.provider_reach_id = w.provider_reach_id AND s.run_id = w.run_id GROUP BY w.provider_reach_id""", "first_max rp_2")
def _(spark, d):
    wanted = table(spark, d, "supplier").select(F.lit("reach").alias("provider"), F.lit("1997010100").alias("run_id"), F.col("s_suppkey").cast("string").alias("provider_reach_id"))
    rows = J.reach_detail(stats(spark, d), ladders(spark, d), summaries(spark, d), wanted, limit=6)
    first = F.try_element_at("timeseries", F.lit(1))
    return rows.select("provider_reach_id", F.size("timeseries").alias("points"), first["forecast_time_utc"].alias("first_time"), first["flow_max_cms"].alias("first_max"), F.col("return_periods.rp_2").alias("rp_2"), F.col("summary.severity_score").alias("severity_score"))


@query("jn13_detail_with_fallback", BASE + "\n---\nSELECT * FROM ts WHERE run_id = '1997010100'", FLOWS)
def _(spark, d):
    wanted = members(spark, d).where("run_id = '1997010100'").select(*S.REACH_KEYS)
    stored = stats(spark, d).withColumn("run_id", F.when(F.col("provider_reach_id").cast("int") % 2 == 0, F.col("run_id")).otherwise(F.lit("old")))
    return J.detail_with_fallback(stored, members(spark, d), wanted)


# --- windows, top lists, sets -------------------------------------------------------------------


@query("win2_latest_run", FULL + COUNTS + OPS + "\n---\nSELECT * FROM fx_runs WHERE run_id IN (SELECT run_id FROM held WHERE provider = 'reach') ORDER BY run_date_utc DESC LIMIT 1")
def _(spark, d):
    return N.latest_run(runs(spark, d), some_summaries(spark, d))


@query("win3_first_n_timesteps", BASE + "\n---\nSELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY provider, run_id, provider_reach_id ORDER BY forecast_time_utc) AS n FROM ts) WHERE n <= 3", FLOWS)
def _(spark, d):
    return N.first_n_timesteps(stats(spark, d), 3)


@query("win4_runs_to_retire", ctes("fx_runs") + "\n---\nSELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY run_date_utc DESC) AS n FROM fx_runs) WHERE n > 2")
def _(spark, d):
    return N.runs_to_retire(runs(spark, d), 2)


@query("win5_high_res_member", ctes("fx_members") + """, p AS (SELECT provider, run_id, coalesce(min(member) FILTER (WHERE contains(member::VARCHAR, '0')), min(member)) AS member FROM fx_members GROUP BY ALL)
---
SELECT provider, run_id, provider_reach_id, forecast_time_utc, flow_cms AS high_res_cms FROM fx_members JOIN p USING (provider, run_id, member)""", "high_res_cms")
def _(spark, d):
    return N.high_res_member(members(spark, d))


@query("srt1_worst_reaches", FULL + "\n---\nSELECT provider_reach_id, severity_score, return_period_band FROM sums WHERE run_id = '1997010100' AND severity_score >= 1 ORDER BY severity_score DESC, provider_reach_id LIMIT 20")
def _(spark, d):
    return N.worst_reaches(summaries(spark, d), "reach", "1997010100", min_severity=1, limit=20).select("provider_reach_id", "severity_score", "return_period_band")


@query("srt2_severity_map", FULL + "\n---\nSELECT provider_reach_id, severity_score FROM sums WHERE run_id = '1996010100' AND severity_score >= 1")
def _(spark, d):
    return N.severity_map(summaries(spark, d), "reach", "1996010100")


@query("srt3_reach_timeseries", BASE + "\n---\nSELECT * FROM ts WHERE run_id = '1996010100' AND provider_reach_id = '7' ORDER BY forecast_time_utc LIMIT 5", FLOWS)
def _(spark, d):
    return N.reach_timeseries(stats(spark, d), "reach", "1996010100", "7", 5)


@query("srt4_bounded_reaches", BASE + "\n---\nSELECT * FROM ts WHERE provider_reach_id IN (SELECT provider_reach_id FROM (SELECT DISTINCT provider_reach_id FROM fx_members) ORDER BY provider_reach_id::BIGINT LIMIT 40)", FLOWS)
def _(spark, d):
    rows = stats(spark, d).withColumn("reach_ordinal", F.col("provider_reach_id").cast("bigint"))
    return N.bounded_reaches(rows, 40).drop("reach_ordinal")


@query("srt5_supported_reach_ids", ctes("fx_ladders") + "\n---\nSELECT provider_reach_id FROM fx_ladders")
def _(spark, d):
    return N.supported_reach_ids(ladders(spark, d), "reach")


def held(spark, d):
    """Stored rows; one run has no name, as null keys are keys too."""
    return stats(spark, d).withColumn("run_id", F.when(F.col("run_id") != "1996010100", F.col("run_id")))


def updates(spark, d):
    """Two batches, flows times three, later times two: half of the reaches again, the other half under new ids."""
    batches = F.explode(F.array(*(F.struct(F.lit(b).alias("batch"), F.lit(f).alias("factor")) for b, f in ((1, 3), (2, 2))))).alias("b")
    again = F.col("provider_reach_id").cast("int") % 2 == 0
    rows = held(spark, d).select("*", batches).withColumn("provider_reach_id", F.when(again, F.col("provider_reach_id")).otherwise(F.concat(F.lit("n"), "provider_reach_id")))
    return rows.select(*S.TIME_KEYS, *((F.col(f) * F.col("b.factor")).alias(f) for f in S.FLOWS), "b.batch")


UPSERT = BASE + "\n---\nSELECT provider, CASE WHEN run_id <> '1996010100' THEN run_id END AS run_id, provider_reach_id, forecast_time_utc, " + ", ".join(f"{f} * CASE WHEN provider_reach_id::INTEGER % 2 = 0 THEN 2 ELSE 1 END AS {f}" for f in S.FLOWS) + """ FROM ts
UNION ALL SELECT provider, CASE WHEN run_id <> '1996010100' THEN run_id END AS run_id, concat('n', provider_reach_id) AS provider_reach_id, forecast_time_utc, """ + ", ".join(f"{f} * 2 AS {f}" for f in S.FLOWS) + " FROM ts WHERE provider_reach_id::INTEGER % 2 <> 0"


@query("set1_upsert", UPSERT, FLOWS)
def _(spark, d):
    return U.upsert(held(spark, d), updates(spark, d), S.TIME_KEYS, "batch")


@query("set1_upsert_twice", UPSERT, FLOWS)
def _(spark, d):
    return U.upsert(U.upsert(held(spark, d), updates(spark, d), S.TIME_KEYS, "batch"), updates(spark, d), S.TIME_KEYS, "batch")


@query("set1_upsert_of_repeated_rows", UPSERT, FLOWS)
def _(spark, d):
    twice = updates(spark, d).where("batch = 2").drop("batch").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return U.upsert(held(spark, d), twice, S.TIME_KEYS)


@query("set2_last_wins", "SELECT user_id, arg_max(value, (ts, event_id))::DOUBLE AS value, max(ts)::TIMESTAMP AS ts FROM events GROUP BY user_id", "value")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return U.last_wins(rows, ["user_id"], F.struct("ts", "event_id")).drop("event_id")


@query("set2_perturbed_wins", ctes("fx_members") + """, t AS (SELECT provider, run_id, provider_reach_id, forecast_time_utc, avg(flow_cms) FILTER (WHERE member % 3 = 0) AS c, avg(flow_cms) FILTER (WHERE member % 3 <> 0) AS p, count(*) FILTER (WHERE member % 3 <> 0) AS n FROM fx_members GROUP BY provider, run_id, provider_reach_id, forecast_time_utc)
---
SELECT provider, run_id, provider_reach_id, forecast_time_utc, CASE WHEN n > 0 THEN 'pf' ELSE 'cf' END AS product, CASE WHEN n > 0 THEN p ELSE c END AS flow_mean_cms FROM t""", "flow_mean_cms")
def _(spark, d):
    rows = members(spark, d).withColumn("product", F.when(F.col("member") % 3 == 0, "cf").otherwise("pf")).groupBy(*S.TIME_KEYS, "product").agg(F.avg("flow_cms").alias("flow_mean_cms"))
    return U.perturbed_wins(rows)


@query("set3_replace_run", FULL + "\n---\nSELECT run_id, provider_reach_id, severity_score FROM sums WHERE run_id <> '1997010100' UNION ALL SELECT run_id, provider_reach_id, 6 FROM sums WHERE run_id = '1997010100' AND is_flagged")
def _(spark, d):
    rows = summaries(spark, d).select("provider", "run_id", "provider_reach_id", "severity_score", "is_flagged")
    new = rows.where("run_id = '1997010100' and is_flagged").withColumn("severity_score", F.lit(6))
    return U.replace_run(rows, new, "reach", "1997010100").select("run_id", "provider_reach_id", "severity_score")


@query("set4_merge_severity", FULL + """, o AS (SELECT * FROM sums WHERE run_id = '1996010100' AND severity_score >= 1), n AS (SELECT * FROM sums WHERE run_id = '1997010100' AND severity_score >= 1)
---
SELECT provider_reach_id, coalesce(n.severity_score, o.severity_score) AS severity_score FROM o FULL JOIN n USING (provider_reach_id)""")
def _(spark, d):
    s = summaries(spark, d)
    return U.merge_severity(N.severity_map(s, "reach", "1996010100"), N.severity_map(s, "reach", "1997010100"))


@query("set5_union_providers", BASE + "\n---\nSELECT provider, count(*) AS n FROM (SELECT provider FROM ts UNION ALL SELECT 'grid' FROM ts) GROUP BY provider")
def _(spark, d):
    ts = stats(spark, d)
    return U.union_providers(ts, ts.withColumn("provider", F.lit("grid"))).groupBy("provider").agg(F.count("*").alias("n"))


RUN_ROWS = ctes("fx_runs") + """, r AS (SELECT *, CASE left(run_id, 4)::INTEGER % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'complete' ELSE 'partial' END AS ingest_status FROM fx_runs)"""


@query("set7_upsert_run", RUN_ROWS + "\n---\nSELECT provider, run_id, ingest_status FROM r WHERE ingest_status <> 'pending' UNION ALL SELECT provider, run_id, 'pending' FROM r WHERE ingest_status = 'pending' UNION ALL SELECT provider, '9999010100', 'pending' FROM r WHERE run_id = (SELECT max(run_id) FROM r)")
def _(spark, d):
    y = F.left("run_id", F.lit(4)).cast("int") % 3
    rows = runs(spark, d).withColumn("ingest_status", F.when(y == 0, "pending").when(y == 1, "complete").otherwise("partial")).withColumn("metadata_json", F.lit(None).cast("string"))
    last = rows.agg(F.max(F.struct("provider", "run_date_utc")).alias("m")).select("m.provider", F.lit("9999010100").alias("run_id"), "m.run_date_utc", F.lit("pending").alias("ingest_status"), F.lit(None).cast("string").alias("metadata_json"))
    again = rows.withColumn("ingest_status", F.lit("pending")).unionByName(last.select(*rows.columns))
    return U.upsert_run(rows, again).select("provider", "run_id", "ingest_status")


# --- scalar functions ---------------------------------------------------------------------------


@query("scl_parsing", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'Infinity'::DOUBLE ELSE CASE WHEN NOT isnan(value) THEN value::DOUBLE END END AS number,
       CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id >= 0 THEN user_id::VARCHAR ELSE user_id::VARCHAR || '.00' END WHEN 1 THEN NULL ELSE 'r' || user_id::VARCHAR END AS reach_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') END AS tile_date,
       date_trunc('hour', ts)::TIMESTAMP AS run_time, concat(strftime(ts, '%Y%m%d'), '00') AS grid_run, ts::TIMESTAMP + to_hours(event_id % 720) AS valid_time FROM events""")
def _(spark, d):
    e, day = F.col("event_id"), F.date_format("ts", "yyyyMMdd")
    number = F.when(e % 6 == 0, " NaN ").when(e % 6 == 1, "none").when(e % 6 == 2, "").when(e % 6 == 3, " inf").otherwise(F.col("value").cast("string"))
    reach = F.when(e % 3 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".00 "))).when(e % 3 == 1, "  ").otherwise(F.concat(F.lit("r"), F.col("user_id").cast("string")))
    tile = F.when(e % 3 == 0, day).when(e % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return table(spark, d, "events").select("event_id", X.safe_double(number).alias("number"), X.normalize_reach_id(reach).alias("reach_id"), X.flood_tile_date(tile).alias("tile_date"), X.run_id_to_time(X.time_to_run_id("ts")).alias("run_time"), X.time_to_run_id("ts", daily=True).alias("grid_run"), X.valid_time(F.col("ts").cast("timestamp"), e % 720).alias("valid_time"))


@query("scl5_classify", ctes("fx_ladders") + f""", p AS (SELECT *, unnest([NULL, 1e0, 40e0, 60e0, 80e0, 100e0, 200e0]) AS peak FROM fx_ladders)
---
SELECT provider_reach_id, peak, {classes()}, CASE s WHEN -1 THEN 'Unknown' WHEN 0 THEN 'Normal' WHEN 1 THEN '2-year' WHEN 2 THEN '5-year' WHEN 3 THEN '10-year' WHEN 4 THEN '25-year' WHEN 5 THEN '50-year' ELSE '100-year' END AS label
FROM (SELECT *, {score_sql('peak')} AS s FROM p)""")
def _(spark, d):
    rows = ladders(spark, d).withColumn("peak", F.explode(F.array(F.lit(None).cast("double"), *map(F.lit, (1.0, 40.0, 60.0, 80.0, 100.0, 200.0))))).withColumn("c", X.classify("peak"))
    return rows.select("provider_reach_id", "peak", "c.*", X.band_label("c.return_period_band").alias("label"))


@query("scl14_bbox_key", ctes("fx_reaches") + "\n---\nSELECT concat_ws(',', " + ", ".join(f"(floor(({c}) / 2 + 0.5) * 2)::BIGINT::VARCHAR" for c in ("lon - 3", "lat - 3", "lon + 3", "lat + 3")) + ") AS bbox, count(*) AS n FROM fx_reaches GROUP BY 1")
def _(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return view(spark, d, "fx_reaches").groupBy(X.bbox_key(lon - 3, lat - 3, lon + 3, lat + 3).alias("bbox")).agg(F.count("*").alias("n"))


@query("scl6_reach_id_fallback", "SELECT s_suppkey::BIGINT AS k, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey::VARCHAR WHEN 1 THEN (s_suppkey + 1)::VARCHAR WHEN 2 THEN NULL ELSE (s_suppkey * 2)::VARCHAR END AS reach_id FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    props = F.when(k % 4 == 0, F.concat(F.lit('{"reach_id": " ", "LINKNO": '), text(k), F.lit(".9}"))).when(k % 4 == 1, F.concat(F.lit('{"provider_reach_id": "'), text(k + 1), F.lit('"}'))).when(k % 4 == 2, F.lit('{"COMID": "nan"}')).otherwise(F.concat(F.lit('{"HYRIV_ID": '), text(k * 2), F.lit(', "reach_id": ""}')))
    return table(spark, d, "supplier").select(k.cast("bigint").alias("k"), X.reach_id_fallback(props).alias("reach_id"))


@query("win1_nearest_k", CROSSWALK + "\n---\nSELECT reach_id, grid_lat, grid_lon, n::INTEGER AS nth FROM k WHERE n <= 3", "grid_lat grid_lon")
def _(spark, d):
    near = J.knn_candidates(view(spark, d, "fx_reaches"), view(spark, d, "fx_cells").where("rp_2 >= 1")).drop("nth")
    return N.nearest_k(near, 3).select("reach_id", "grid_lat", "grid_lon", "nth")


@query("jn6_expand_cells_to_reaches", ctes("fx_members") + GRID + """
---
SELECT cast(s_suppkey AS VARCHAR) AS provider_reach_id, run_id, product, forecast_time_utc, flow_mean_cms FROM grid_stats, supplier
WHERE round(lat * 1000) = round((10 + 0.05 * (s_suppkey % 40)) * 1000) AND round(lon * 1000) = round((20 + 0.05 * (s_suppkey % 7)) * 1000)""", "flow_mean_cms")
def _(spark, d):
    key = F.col("s_suppkey")
    cells = table(spark, d, "supplier").select(key.cast("string").alias("provider_reach_id"), (F.lit(10.0) + F.lit(0.05) * (key % 40)).alias("lat"), (F.lit(20.0) + F.lit(0.05) * (key % 7)).alias("lon"))
    rows = J.expand_cells_to_reaches(A.grid_ensemble_stats(grid_members(spark, d)), cells)
    return rows.select("provider_reach_id", "run_id", "product", "forecast_time_utc", "flow_mean_cms")


@query("prj3_normalize_summary", "SELECT 'reach' AS provider, '2026010100' AS run_id, user_id::VARCHAR AS provider_reach_id, date_trunc('second', ts)::TIMESTAMP AS peak_time_utc, value::DOUBLE AS peak_mean_cms, CASE WHEN event_id % 4 <> 0 THEN value::DOUBLE * 2 END AS peak_max_cms FROM events WHERE event_id % 6 <> 0", "peak_mean_cms peak_max_cms")
def _(spark, d):
    e = F.col("event_id")
    raw = table(spark, d, "events").select(F.when(e % 6 == 0, "  ").otherwise(F.col("user_id").cast("string")).alias("river_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("peak_time_utc"), F.col("value").cast("string").alias("peak_mean_cms"), F.when(e % 4 == 0, "null").otherwise((F.col("value").cast("double") * 2).cast("string")).alias("peak_max_cms"))
    return P.normalize_summary(raw, "reach", "2026010100").select("provider", "run_id", "provider_reach_id", "peak_time_utc", "peak_mean_cms", "peak_max_cms")


@query("prj4_normalize_rest_stats", "SELECT date_trunc('second', ts)::TIMESTAMP AS forecast_time_utc, value::DOUBLE AS flow_mean_cms, (event_id / 2e0)::DOUBLE AS flow_min FROM events", "flow_mean_cms flow_min")
def _(spark, d):
    raw = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("value").cast("double").alias("flow_avg"), (F.col("event_id") / 2).alias("flow_min"), F.lit(None).cast("double").alias("high_res"))
    rows = P.normalize_rest_stats(raw, "reach", "2026010100", "760021611")
    return rows.select("forecast_time_utc", "flow_mean_cms", F.get_json_object("raw_payload_json", "$.flow_min").cast("double").alias("flow_min"))


# --- sources and sinks --------------------------------------------------------------------------


@query("src1_read_raw_forecast_jsonl", "WITH one AS (SELECT 1)" + RAW + "\n---\nSELECT provider_reach_id, forecast_time_utc, flow_mean_cms, flow_max_cms FROM norm", "flow_mean_cms flow_max_cms")
def _(spark, d):
    path = R.scratch_path(spark, "raw")
    raw_records(spark, d).drop("event_id").write.json(path)
    rows = P.normalize_timeseries(R.read_raw_forecast_jsonl(spark, path, "2026010100").drop("source_path"), "reach")
    return rows.select("provider_reach_id", "forecast_time_utc", "flow_mean_cms", "flow_max_cms")


@query("src2_snk1_timeseries_artifact", BASE + "\n---\nSELECT *, NULL::VARCHAR AS raw_payload_json FROM ts", FLOWS)
def _(spark, d):
    path = R.scratch_path(spark, "timeseries")
    R.write_timeseries_artifact(stats(spark, d).withColumn("raw_payload_json", F.lit(None).cast("string")), path)
    return R.read_timeseries_artifact(spark, path)


@query("src3_snk2_summary_artifact", FULL + "\n---\nSELECT * FROM sums", PEAKS)
def _(spark, d):
    path = R.scratch_path(spark, "summary")
    rows = summaries(spark, d)
    R.write_summary_artifact(rows, path)
    R.write_summary_artifact(rows.where("run_id = '1997010100'"), path)  # replaces that run only
    return R.read_summary_artifact(spark, path).drop("first_exceedance_time_utc", "metadata_json")


@query("src7_read_stream_features", "SELECT s_suppkey::VARCHAR AS link, concat('{\"type\":\"Point\",\"k\":', s_suppkey, '}') AS geometry FROM supplier WHERE s_suppkey % 5 <> 0")
def _(spark, d):
    path = R.scratch_path(spark, "features")
    k = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit('{"type":"Feature","properties":{"LINKNO":'), k, F.lit('},"geometry":{"type":"Point","k":'), k, F.lit("}}"))
    table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 5 == 0, "not json").otherwise(line).alias("value")).write.text(path)
    return R.read_stream_features(spark, path).select(F.get_json_object("props", "$.LINKNO").alias("link"), "geometry")


@query("snk4_artifact_stats", FULL + "\n---\nSELECT count(*) AS row_count, true AS has_bytes FROM sums")
def _(spark, d):
    path = R.scratch_path(spark, "stats")
    R.write_summary_artifact(summaries(spark, d), path)
    return R.artifact_stats(spark.read.schema(S.SUMMARY_ARTIFACT).parquet(path)).select("row_count", (F.col("size_bytes") > 0).alias("has_bytes"))


@query("src4_read_thresholds_file", ctes("fx_ladders") + ", kinds AS (SELECT unnest(['csv', 'pq']) AS kind)\n---\nSELECT kind, fx_ladders.* FROM fx_ladders, kinds", RUNGS)
def _(spark, d):
    rows = ladders(spark, d).withColumnsRenamed({"provider_reach_id": " River_ID ", "rp_2": "return_period_2", "rp_5": "Q5"}).drop("provider")
    text, binary = R.scratch_path(spark, "ladders") + ".csv", R.scratch_path(spark, "ladders") + ".pq"
    rows.write.option("header", True).csv(text)
    rows.write.parquet(binary)
    read = lambda path, kind: P.resolve_ladder(R.read_thresholds_file(spark, path), "reach").drop("metadata_json").withColumn("kind", F.lit(kind))
    return read(text, "csv").unionByName(read(binary, "pq"))


@query("src5_read_reach_tables", ctes("fx_reaches") + "\n---\nSELECT reach_id, lat, lon, reach_upstream_area_km2 * 1e6 AS \"DSContArea\" FROM fx_reaches", 'lat lon "DSContArea"')
def _(spark, d):
    rows = view(spark, d, "fx_reaches")
    meta, attributes = R.scratch_path(spark, "meta"), R.scratch_path(spark, "attributes")
    rows.select(F.col("reach_id").cast("bigint").alias("LINKNO"), "lat", "lon").write.parquet(meta)
    rows.select(F.col("reach_id").cast("bigint").alias("LINKNO"), (F.col("reach_upstream_area_km2") * 1e6).alias("DSContArea")).write.parquet(attributes)
    left, right = R.read_reach_tables(spark, meta, attributes)
    return left.join(right, "LINKNO").select(F.col("LINKNO").cast("string").alias("reach_id"), "lat", "lon", "DSContArea")


@query("src6_read_members", ctes("fx_members") + "\n---\nSELECT provider_reach_id, count(*) AS members, count(flow_cms) AS flows, sum(flow_cms) AS total FROM fx_members GROUP BY provider_reach_id", "total")
def _(spark, d):
    path = R.scratch_path(spark, "members")
    members(spark, d).withColumn("flow_cms", F.coalesce("flow_cms", F.lit(float("nan")))).write.parquet(path)
    return R.read_members(spark, path).groupBy("provider_reach_id").agg(F.count("*").alias("members"), F.count("flow_cms").alias("flows"), F.sum("flow_cms").alias("total"))


@query("src6_read_grid_members", ctes("fx_members") + GRID + "\n---\nSELECT run_id, product, lat, count(*) AS members, count(flow_cms) AS flows, sum(flow_cms) AS total FROM grid GROUP BY run_id, product, lat", "lat total")
def _(spark, d):
    path = R.scratch_path(spark, "grid")
    grid_members(spark, d).withColumn("flow_cms", F.coalesce("flow_cms", F.lit(float("nan")))).write.parquet(path)
    return R.read_grid_members(spark, path).groupBy("run_id", "product", "lat").agg(F.count("*").alias("members"), F.count("flow_cms").alias("flows"), F.sum("flow_cms").alias("total"))


@query("src6_read_threshold_grid", ctes("fx_cells") + "\n---\nSELECT grid_lat AS lat, grid_lon AS lon, 2::INTEGER AS return_period, rp_2 AS threshold FROM fx_cells", "lat lon threshold")
def _(spark, d):
    path = R.scratch_path(spark, "thresholds")
    view(spark, d, "fx_cells").select(F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"), F.lit(2).alias("return_period"), F.col("rp_2").alias("threshold")).write.parquet(path)
    return R.read_threshold_grid(spark, path)


@query("snk3_preview", BASE + "\n---\nSELECT least(7, count(*)) AS shown, least(7, count(*)) AS of_the_table FROM ts")
def _(spark, d):
    path = R.scratch_path(spark, "preview")
    stats(spark, d).write.parquet(path)
    rows = spark.read.schema(S.TIMESERIES).parquet(path)
    first = R.preview(rows, 7)
    held = first.join(rows.select(*S.TIME_KEYS), S.TIME_KEYS, "left_semi").agg(F.count("*").alias("of_the_table"))
    return R.preview(rows, 7).agg(F.count("*").alias("shown")).join(held)


@query("snk4_signature", FULL + "\n---\nSELECT true AS same_again, true AS other_after_a_change FROM sums LIMIT 1")
def _(spark, d):
    path = R.scratch_path(spark, "stats")
    rows = summaries(spark, d)
    R.write_summary_artifact(rows, path)
    read = lambda name: R.artifact_stats(spark.read.schema(S.SUMMARY_ARTIFACT).parquet(path)).select(F.col("signature").alias(name))
    kept = R.scratch_path(spark, "signature")
    read("before").join(read("again")).write.parquet(kept)
    R.write_summary_artifact(rows.where("run_id = '1997010100' and is_flagged"), path)
    return spark.read.parquet(kept).join(read("after")).select((F.col("before") == F.col("again")).alias("same_again"), (F.col("before") != F.col("after")).alias("other_after_a_change"))


@query("prj6_normalize_rest_ladders", """SELECT 'reach' AS provider, CASE WHEN c_custkey % 3 = 0 THEN concat('r', c_custkey) WHEN c_custkey % 3 = 1 THEN concat('v', c_custkey) ELSE c_custkey::VARCHAR END AS provider_reach_id,
       abs(c_acctbal::DOUBLE) AS rp_2, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey::DOUBLE END AS rp_100 FROM customer""", "rp_2 rp_100")
def _(spark, d):
    k = F.col("c_custkey")
    text = k.cast("string")
    frame = table(spark, d, "customer").select(k.alias("row"), F.when(k % 3 == 0, F.concat(F.lit("r"), text)).when(k % 3 == 1, " ").alias("rivid"), F.when(k % 3 != 2, F.concat(F.lit("v"), text)).alias("river_id"), F.abs(F.col("c_acctbal").cast("double")).alias("return_period_2"), F.when(k % 5 == 0, "nan").otherwise(text).alias("return_period_100"))
    return P.normalize_rest_ladders(frame, "reach", "row").select("provider", "provider_reach_id", "rp_2", "rp_100")


@query("scl10_first_not_null", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' WHEN event_id % 3 = 0 THEN 'b' ELSE event_type END AS found FROM events")
def _(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", X.first_not_null(F.when(e % 2 == 0, "a"), F.when(e % 3 == 0, "b"), "event_type").alias("found"))


@query("scl12_payload_json", """SELECT event_id, concat('{"kind":"', event_type, '"', CASE WHEN event_id % 3 <> 0 THEN concat(',"user":', user_id) ELSE '' END, ',"known":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '}') AS payload FROM events""")
def _(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", X.payload_json(kind="event_type", user=F.when(e % 3 != 0, F.col("user_id")), known=e % 2 == 0).alias("payload"))


# --- composite jobs -----------------------------------------------------------------------------


@query("cmp1_prepare_timeseries", BASE + "\n---\nSELECT * FROM ts WHERE provider_reach_id IN (SELECT provider_reach_id FROM fx_ladders) AND flow_max_cms IS NOT NULL", FLOWS)
def _(spark, d):
    return C.prepare_timeseries(members(spark, d), ladders(spark, d), "reach", from_members=True)


@query("cmp1_prepare_from_records", ctes("fx_ladders") + RAW + "\n---\nSELECT provider_reach_id, forecast_time_utc, flow_mean_cms, flow_max_cms FROM norm WHERE provider_reach_id IN (SELECT provider_reach_id FROM fx_ladders) AND coalesce(flow_mean_cms, flow_max_cms) IS NOT NULL", "flow_mean_cms flow_max_cms")
def _(spark, d):
    raw = raw_records(spark, d).drop("event_id").withColumn("run_id", F.lit("2026010100"))
    return C.prepare_timeseries(raw, ladders(spark, d), "reach").select("provider_reach_id", "forecast_time_utc", "flow_mean_cms", "flow_max_cms")


SUMS = FULL + "\n---\nSELECT * FROM sums WHERE provider_reach_id IN (SELECT provider_reach_id FROM fx_ladders)"


@query("cmp2_prepare_summaries", SUMS, PEAKS)
def _(spark, d):
    return C.prepare_summaries(members(spark, d), ladders(spark, d))


@query("cmp3_reclassify", BASE + BULK + f"\n---\nSELECT * EXCLUDE (s), {classes()} FROM (SELECT b.*, {score_sql('peak_mean_cms')} AS s FROM bulk b LEFT JOIN (SELECT provider, provider_reach_id, " + ", ".join(f"{r} * 0.8e0 AS {r}" for r in S.RUNGS) + " FROM fx_ladders) USING (provider, provider_reach_id))", PEAKS)
def _(spark, d):
    rp = ladders(spark, d)
    return C.reclassify(C.classified(A.bulk_summary(stats(spark, d)), rp), rp.withColumns({r: F.col(r) * 0.8 for r in S.RUNGS}))


@query("cmp4_ingest_summaries", FULL + """
---
SELECT run_id, provider_reach_id, CASE WHEN run_id = '1998010100' OR provider_reach_id::INTEGER % 2 = 0 THEN severity_score ELSE 9 END AS severity_score FROM sums
UNION ALL SELECT '2098010100', provider_reach_id, 9 FROM sums WHERE run_id = '1998010100'
UNION ALL SELECT run_id, concat('n', provider_reach_id), 0 FROM sums WHERE run_id <> '1998010100' AND provider_reach_id::INTEGER % 2 <> 0""")
def _(spark, d):
    s = summaries(spark, d)
    last = F.col("run_id") == "1998010100"
    target = s.withColumn("run_id", F.when(last, "2098010100").otherwise(F.col("run_id"))).withColumn("severity_score", F.lit(9)).withColumn("metadata_json", F.lit(None).cast("string"))
    known = last | (F.col("provider_reach_id").cast("int") % 2 == 0)
    artifact = s.withColumn("provider_reach_id", F.when(known, F.col("provider_reach_id")).otherwise(F.concat(F.lit("n"), "provider_reach_id")))  # new reaches, without a ladder
    return C.ingest_summaries(artifact, ladders(spark, d), target).select("run_id", "provider_reach_id", "severity_score")


@query("cmp5_ingest_timeseries", BASE + """, x AS (SELECT * FROM ts WHERE run_id <> '1998010100' AND provider_reach_id IN (SELECT provider_reach_id FROM fx_ladders))
---
SELECT provider, run_id, count(*) AS "rows", 'complete' AS ingest_status FROM x GROUP BY provider, run_id UNION ALL SELECT 'reach', '1998010100', 0, 'partial'""")
def _(spark, d):
    ts = stats(spark, d)
    artifact = ts.withColumn("provider_reach_id", F.when(F.col("run_id") == "1998010100", F.lit("none")).otherwise(F.col("provider_reach_id")))
    return C.ingest_timeseries(artifact, ladders(spark, d), ts, "reach")[1]


@query("cmp6_summarize_run", reach_summary_sql("return_period_band", "coalesce(peak_mean_cms, peak_median_cms, peak_max_cms)").replace("\n---\nSELECT *", "\n---\nSELECT provider, run_id, provider_reach_id, severity_score, first_exceedance_time_utc, points::VARCHAR AS points FROM (SELECT *") + ") WHERE points > 0")
def _(spark, d):
    target = spark.createDataFrame([], S.SUMMARIES)
    rows = C.summarize_run(stats(spark, d), ladders(spark, d), target)
    return rows.select(*S.REACH_KEYS, "severity_score", "first_exceedance_time_utc", F.get_json_object("metadata_json", "$.points").alias("points"))


@query("cmp7_import_thresholds", ctes("fx_ladders") + GUARD + "\n---\nSELECT provider, provider_reach_id, " + ", ".join(f"{r} * 1.5 AS {r}" for r in S.RUNGS) + " FROM guarded WHERE reason IS NULL", RUNGS)
def _(spark, d):
    target = L.sanitize_ladder(ladders(spark, d)).withColumn("metadata_json", F.lit(None).cast("string"))
    return C.import_thresholds(target, "reach", long=threshold_long(spark, d), method="logpearson3").drop("metadata_json")


@query("cmp7_import_thresholds_table", ctes("fx_ladders") + GUARD + "\n---\nSELECT provider, provider_reach_id, " + ", ".join(f"{r} * 2 AS {r}" for r in S.RUNGS) + " FROM guarded WHERE reason IS NULL", RUNGS)
def _(spark, d):
    target = L.sanitize_ladder(ladders(spark, d)).withColumn("metadata_json", F.lit(None).cast("string"))
    wide = ladders(spark, d).select(F.col("provider_reach_id").alias("rivid"), *((F.col(r) * 2).cast("string").alias(r.replace("rp_", "q")) for r in S.RUNGS))
    return C.import_thresholds(target, "reach", table=wide).drop("metadata_json")


@query("cmp7_import_thresholds_history", """WITH RECURSIVE s AS (SELECT l_suppkey::VARCHAR AS k, list(l_extendedprice::DOUBLE ORDER BY l_extendedprice) AS x, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_suppkey HAVING count(*) >= 10)""" + gumbel_sql("s") + f"""
---
SELECT 'grid' AS provider, k AS provider_reach_id, {quantile_sql(0.5)} AS rp_2, {quantile_sql(0.8)} AS rp_5, {quantile_sql(0.95)} AS rp_25, concat('{{"sample_count":', n, '}}') AS metadata_json FROM fits""")
def _(spark, d):
    history = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("l_extendedprice").cast("double").alias("flow_cms"))
    cells = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("provider_reach_id"), F.col("s_suppkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    old = spark.createDataFrame([], S.RETURN_PERIODS)
    rows = C.import_thresholds(old, "grid", reach_rows=T.reach_thresholds_from_history(cells, history, "grid"), require_all=False)
    return rows.select("provider", "provider_reach_id", *(F.round(F.col(r) + F.lit(1e-9), 2).alias(r) for r in ("rp_2", "rp_5", "rp_25")), "metadata_json")


@query("cmp9_hydrograph_series", BASE + """, l AS (SELECT provider, provider_reach_id, unnest(['rp_2','rp_5','rp_10','rp_25','rp_50','rp_100']) AS series, unnest([rp_2, rp_5, rp_10, rp_25, rp_50, rp_100]) AS value FROM fx_ladders),
h AS (SELECT *, bool_or(flow_p25_cms IS NOT NULL) OVER w AND bool_or(flow_p75_cms IS NOT NULL) OVER w AS spread, bool_or(flow_max_cms IS NOT NULL) OVER w AS top FROM ts WINDOW w AS (PARTITION BY provider, run_id, provider_reach_id)),
k AS (SELECT provider, run_id, provider_reach_id, forecast_time_utc, spread, top, unnest(['flow_mean_cms','flow_p25_cms','flow_p75_cms','flow_max_cms']) AS series, unnest([flow_mean_cms, flow_p25_cms, flow_p75_cms, flow_max_cms]) AS value FROM h)
---
SELECT provider, run_id, provider_reach_id, forecast_time_utc, series, value FROM k WHERE series = 'flow_mean_cms' OR (series IN ('flow_p25_cms', 'flow_p75_cms') AND spread) OR (series = 'flow_max_cms' AND top)
UNION ALL SELECT ts.provider, ts.run_id, ts.provider_reach_id, ts.forecast_time_utc, l.series, l.value FROM ts JOIN l USING (provider, provider_reach_id) WHERE l.value IS NOT NULL""", "value")
def _(spark, d):
    return C.hydrograph_series(stats(spark, d), ladders(spark, d))


# --- jobs and operators for groups of any size ---------------------------------------------------


@query("agg13_gumbel_thresholds_of_rows")
def _(spark, d):
    peaks = A_history(spark, d).where("flow_cms > 0").groupBy("provider_reach_id", F.year("time").alias("year")).agg(F.max("flow_cms").alias("top"))
    rows = T.gumbel_thresholds_of_rows(peaks, ["provider_reach_id"])
    return rows.withColumns({r: F.round(F.col(r) + F.lit(1e-9), 2) for r in ("rp_2", "rp_5", "rp_20")})


SQL["agg13_gumbel_thresholds_of_rows"] = SQL["agg13_gumbel_thresholds"]


@query("src1_line_numbers", """SELECT event_id::VARCHAR AS provider_reach_id, '2026010100' AS run_id,
       (row_number() OVER o + count(*) FILTER (WHERE event_id % 10 = 0) OVER o - (event_id % 10 = 0)::INTEGER)::BIGINT AS line_number
FROM events WINDOW o AS (PARTITION BY user_id % 8 ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    path = R.scratch_path(spark, "lines")
    blank = F.col("event_id") % 10 == 0
    lines = F.posexplode(F.when(blank, F.array(F.col("json"), F.lit(""))).otherwise(F.array("json"))).alias("nth", "value")
    rows = table(spark, d, "events").select((F.col("user_id") % 8).alias("file"), "event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("provider_reach_id"))).alias("json"))
    rows = rows.select("file", "event_id", lines).repartition("file").sortWithinPartitions("file", "event_id", "nth")
    rows.select("file", "value").write.partitionBy("file").text(path)
    return R.read_raw_forecast_jsonl(spark, path, "2026010100").select("provider_reach_id", "run_id", "line_number")


def clustered(spark, d):
    """Timeseries and ladders as clustered tables with buckets by reach."""
    ts, rp = R.scratch_path(spark, "timeseries"), R.scratch_path(spark, "ladders")
    K.write_clustered_timeseries(stats(spark, d).withColumn("raw_payload_json", F.lit(None).cast("string")), ts)
    K.write_clustered_ladders(ladders(spark, d), rp)
    return K.read_clustered(spark, ts), K.read_clustered(spark, rp)


@query("snk1_clustered_artifacts", BASE + "\n---\nSELECT ts.*, NULL::VARCHAR AS raw_payload_json, " + ", ".join(S.RUNGS) + " FROM ts LEFT JOIN fx_ladders USING (provider, provider_reach_id)", FLOWS + " " + RUNGS)
def _(spark, d):
    return J.attach_thresholds(*clustered(spark, d))


@query("srt3_clustered_timeseries", BASE + "\n---\nSELECT * FROM ts WHERE run_id = '1996010100' AND provider_reach_id = '7' ORDER BY forecast_time_utc LIMIT 5", FLOWS)
def _(spark, d):
    ts = clustered(spark, d)[0].drop("raw_payload_json")
    return N.reach_timeseries(ts, "reach", "1996010100", "7", 5)


@query("jn7_snap_to_axis", """WITH p AS (SELECT o_orderkey, o_totalprice::DOUBLE / 40 AS x FROM orders),
axis AS (SELECT DISTINCT c_acctbal::DOUBLE AS a FROM customer WHERE c_acctbal IS NOT NULL),
l AS (SELECT p.*, a AS low FROM p ASOF LEFT JOIN axis ON p.x >= axis.a),
h AS (SELECT l.*, axis.a AS high FROM l ASOF LEFT JOIN axis ON l.x <= axis.a)
---
SELECT o_orderkey, CASE WHEN low IS NULL THEN high WHEN high IS NULL OR x - low < high - x THEN low ELSE high END AS snapped FROM h""", "snapped")
def _(spark, d):
    points = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 40).alias("x"))
    return J.snap_to_axis(points, "x", table(spark, d, "customer"), "c_acctbal", "snapped").drop("x")


@query("cmp1_prepare_artifact", ctes("fx_ladders") + RAW + """
---
SELECT count(*) AS records_seen, count(*) FILTER (WHERE bad) AS invalid_dropped, count(*) FILTER (WHERE NOT bad AND NOT known) AS filtered_dropped, count(*) FILTER (WHERE NOT bad AND known) AS written,
       count(*) FILTER (WHERE NOT bad AND known) AS stored
FROM (SELECT event_id % 13 = 0 OR event_id % 17 = 0 OR value IS NULL OR (event_id % 7 = 0 AND event_id % 5 = 0) AS bad, trim(river_id) IN (SELECT provider_reach_id FROM fx_ladders) AS known FROM raw)""")
def _(spark, d):
    path = R.scratch_path(spark, "artifact")
    counters = C.prepare_artifact(raw_records(spark, d).drop("event_id"), ladders(spark, d), "reach", path, "2026010100")
    stored = R.read_timeseries_artifact(spark, path).agg(F.count("*").alias("stored"))
    return stored.select(*(F.lit(counters[c]).cast("bigint").alias(c) for c in ("records_seen", "invalid_dropped", "filtered_dropped", "written")), "stored")


@query("jn5_write_enriched_streams", STREAMS + "\n---\nSELECT (SELECT count(*) FROM supplier) AS processed, count(*) AS written, (SELECT count(*) FROM supplier) - count(*) AS missing_id, count(*) FILTER (WHERE NOT has_model) AS missing_attributes, count(*) AS stored FROM e")
def _(spark, d):
    path = R.scratch_path(spark, "streams")
    counters = C.write_enriched_streams(stream_features(spark, d), stream_model(spark, d), path)
    stored = spark.read.parquet(path).agg(F.count("*").alias("stored"))
    return stored.select(*(F.lit(n).cast("bigint").alias(c) for c, n in counters.items()), "stored")


@query("cmp5_ingest_counted", BASE + """, x AS (SELECT * FROM ts WHERE provider_reach_id IN (SELECT provider_reach_id FROM fx_ladders))
---
SELECT provider, run_id, provider_reach_id, count(*) AS n FROM x GROUP BY provider, run_id, provider_reach_id""")
def _(spark, d):
    ts = R.write_scratch(stats(spark, d), "timeseries")
    rp, counts, target = ladders(spark, d), ts.limit(0).select(*S.REACH_KEYS, F.lit(0).cast("bigint").alias("n")), ts.limit(0)
    # even months, then all: what came before adds nothing
    for batch in (ts.where(F.month("forecast_time_utc") % 2 == 0), ts):
        target, _, counts = C.ingest_counted(batch, rp, target, "reach", counts)
        target, counts = R.write_scratch(target, "target"), R.write_scratch(counts, "counts")
    return counts


def raw_crosswalk(spark, d):
    """Metadata, attributes, cell areas and 2-year flows as four raw tables."""
    r, c = view(spark, d, "fx_reaches"), view(spark, d, "fx_cells")
    link = F.col("reach_id").cast("double").alias("LINKNO")
    return r.select(link, "lat", "lon"), r.select(link, (F.col("reach_upstream_area_km2") * 1e6).alias("DSContArea")), c.drop("rp_2"), c.select("grid_lat", "grid_lon", "rp_2")


@query("cmp8_crosswalk_from_raw", CROSSWALK + "\n---\nSELECT * FROM xw", XW)
def _(spark, d):
    reaches, cells = C.crosswalk_inputs(*raw_crosswalk(spark, d))
    return C.refresh_crosswalk(spark.createDataFrame([], S.CROSSWALK), reaches, cells, "grid")[0]


@query("cmp8_refresh_crosswalk", CROSSWALK + "\n---\nSELECT * FROM xw", XW)
def _(spark, d):
    reaches, cells = C.crosswalk_inputs(*raw_crosswalk(spark, d))
    number = F.col("reach_id").cast("bigint")
    # as they were before: other places and areas, one reach more for each tenth, cells of other areas in the south
    old_reaches = reaches.withColumn("lat", F.when(number % 7 == 0, F.col("lat") + 0.3).otherwise(F.col("lat")))
    old_reaches = old_reaches.unionByName(reaches.where(number % 10 == 0).withColumn("reach_id", F.concat(F.lit("gone"), "reach_id")))
    old_cells = cells.withColumn("grid_upstream_area_km2", F.when(F.col("grid_lat") < 10.4, F.col("grid_upstream_area_km2") * 5).otherwise(F.col("grid_upstream_area_km2")))
    old = C.build_crosswalk(old_reaches, old_cells, "grid")
    return C.refresh_crosswalk(old, reaches, cells, "grid", before=(old_reaches, old_cells))[0]


GRID_LADDERS = CROSSWALK + "\n---\nSELECT 'grid' AS provider, x.reach_id AS provider_reach_id, rp_2, rp_2 * 2 AS rp_5, rp_2 * 3 AS rp_10, rp_2 * 4 AS rp_25, rp_2 * 5 AS rp_50, rp_2 * 6 AS rp_100 FROM xw x JOIN fx_cells USING (grid_lat, grid_lon) WHERE is_valid_match"


@query("cmp7_import_thresholds_grid", GRID_LADDERS, RUNGS)
def _(spark, d):
    grid = view(spark, d, "fx_cells").select(F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"), *((F.col("rp_2") * i).alias(r) for i, r in enumerate(S.RUNGS, 1)))
    return C.import_grid_thresholds(spark.createDataFrame([], S.RETURN_PERIODS), "grid", crosswalk(spark, d), grid).drop("metadata_json")


@query("cmp7_import_thresholds_long_grid", GRID_LADDERS, RUNGS)
def _(spark, d):
    # the provider's 20-year value fills the rung of 25 years
    periods = F.explode(F.array(*(F.struct(F.lit(20 if p == 25 else p).alias("return_period"), F.lit(float(i)).alias("f")) for i, p in enumerate(S.PERIODS, 1))))
    grid = view(spark, d, "fx_cells").select(F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"), "rp_2", periods.alias("p")).select("lat", "lon", "p.return_period", (F.col("rp_2") * F.col("p.f")).alias("threshold"))
    axes = ((10.0, 0.05, 40), (20.0, 0.05, 1_000_000))
    return C.import_grid_thresholds(spark.createDataFrame([], S.RETURN_PERIODS), "grid", crosswalk(spark, d), grid, axes).drop("metadata_json")


@query("agg7_run_counts_of_deltas", FULL + COUNTS + "\n---\nSELECT * FROM counts")
def _(spark, d):
    ts = R.write_scratch(stats(spark, d), "timeseries")
    batch = F.month("forecast_time_utc") % 3
    deltas, target = [], ts.limit(0)
    for i in (0, 1, 1, 2):  # one batch comes twice
        deltas.append(R.write_scratch(A.timeseries_delta(target, ts.where(batch == i)), "delta"))
        target = ts.where(batch <= i)
    return A.run_counts_of(A.merge_counts(*deltas), some_summaries(spark, d), ladders(spark, d))


@query("srt2_severity_map_pages", FULL + "\n---\nSELECT provider_reach_id, severity_score FROM sums WHERE run_id = '1996010100' AND severity_score >= 1")
def _(spark, d):
    return N.merge_pages(N.severity_map_pages(summaries(spark, d), "reach", "1996010100", page_reaches=16))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
