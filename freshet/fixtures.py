"""Forecast-shaped views over the given tables: one SQL text serves Spark and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()

VIEWS = {
    "fx_members": """
SELECT 'reach' AS provider, concat(cast(year(l_shipdate) AS STRING), '010100') AS run_id,
       cast(l_suppkey AS STRING) AS provider_reach_id, cast(date_trunc('month', l_shipdate) AS TIMESTAMP) AS forecast_time_utc,
       l_orderkey * 8 + l_linenumber AS member,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 1000e0 END AS flow_cms
FROM {lineitem}""",
    "fx_ladders": """
SELECT 'reach' AS provider, provider_reach_id,
       CASE WHEN k % 17 = 0 THEN 0.001e0 ELSE p50 * f END AS rp_2, p80 * f AS rp_5,
       CASE WHEN k % 13 = 0 THEN NULL ELSE p90 * f END AS rp_10, p96 * f AS rp_25, p98 * f AS rp_50, p99 * f AS rp_100
FROM (SELECT cast(l_suppkey + CASE WHEN l_suppkey % 11 = 0 THEN 1000000000 ELSE 0 END AS STRING) AS provider_reach_id, l_suppkey AS k, 1e0 + (l_suppkey % 5) * 0.25e0 AS f,
             percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice / 1000e0) AS p50,
             percentile_cont(0.8) WITHIN GROUP (ORDER BY l_extendedprice / 1000e0) AS p80,
             percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice / 1000e0) AS p90,
             percentile_cont(0.96) WITHIN GROUP (ORDER BY l_extendedprice / 1000e0) AS p96,
             percentile_cont(0.98) WITHIN GROUP (ORDER BY l_extendedprice / 1000e0) AS p98,
             percentile_cont(0.99) WITHIN GROUP (ORDER BY l_extendedprice / 1000e0) AS p99
      FROM {lineitem} GROUP BY l_suppkey) q""",
    "fx_runs": """
SELECT DISTINCT 'reach' AS provider, concat(cast(year(o_orderdate) AS STRING), '010100') AS run_id,
       cast(date_trunc('year', o_orderdate) AS TIMESTAMP) AS run_date_utc
FROM {orders}""",
    "fx_cells": """
SELECT 10e0 + 0.05e0 * (c_custkey % 40) AS grid_lat, 20e0 + 0.05e0 * floor(c_custkey / 40e0) AS grid_lon,
       1e0 + abs(cast(c_acctbal AS DOUBLE)) AS grid_upstream_area_km2,
       CASE WHEN c_custkey % 9 = 0 THEN 0.5e0 ELSE cast(1 + (c_custkey % 50) AS DOUBLE) END AS rp_2
FROM {customer}""",
    "fx_reaches": """
SELECT cast(s_suppkey AS STRING) AS reach_id,
       10e0 + 0.013e0 * (s_suppkey * 17 % 150) + CASE WHEN s_suppkey % 10 = 3 THEN 5e0 ELSE 0e0 END AS lat,
       20e0 + 0.017e0 * (s_suppkey * 29 % 110) AS lon, 1e0 + abs(cast(s_acctbal AS DOUBLE)) AS reach_upstream_area_km2
FROM {supplier}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if f"{{{t}}}" in VIEWS[name]]
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def ctes(*names: str) -> str:
    """The views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
