import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.operators import aggregations as A
from freshet.operators import filters as L
from freshet.operators import joins as J
from freshet.operators import projections as P
from freshet.operators import thresholds as T
from freshet.operators import upserts as U
from freshet.operators import windows as N
from freshet.plans import workflows as C

T0 = dt.datetime(2026, 3, 12)
LADDER = "provider string, provider_reach_id string, " + ", ".join(f"{r} double" for r in S.RUNGS)


def ladder(spark, *rows):
    return spark.createDataFrame([("reach", str(i), *map(lambda x: None if x is None else float(x), r)) for i, r in rows], LADDER)


def members(spark, flows, reach="760021611", steps=1):
    rows = [("reach", "2026031200", reach, T0 + dt.timedelta(hours=3 * s), m, f) for s in range(steps) for m, f in enumerate(flows)]
    return spark.createDataFrame(rows, S.MEMBERS)


def test_ensemble_stats(spark):
    row = A.ensemble_stats(members(spark, [10.0, 12.0, 14.0, None, float("nan")])).first()
    assert [row[f] for f in S.FLOWS] == [12.0, 12.0, 11.0, 13.0, 14.0]
    empty = A.ensemble_stats(members(spark, [None, float("nan")])).first()
    assert [empty[f] for f in S.FLOWS] == [None] * 5
    assert L.drop_empty_stats(A.ensemble_stats(members(spark, [None]))).count() == 0
    packed = members(spark, [10.0, 12.0, 14.0, float("nan")]).groupBy(*S.TIME_KEYS).agg(F.collect_list("flow_cms").alias("flows"))
    assert [A.packed_ensemble_stats(packed).first()[f] for f in S.FLOWS] == [12.0, 12.0, 11.0, 13.0, 14.0]


def test_supported_before_reduction(spark):
    both = members(spark, [1.0, 2.0], steps=2).unionByName(members(spark, [3.0], "760021612", steps=2))
    rp = ladder(spark, (" 760021611 ", [10, 20, 30, 40, 50, 60]))
    rows = C.prepare_timeseries(both, rp, "reach", from_members=True)
    assert rows.count() == 2 and {r.provider_reach_id for r in rows.collect()} == {"760021611"}
    assert J.dropped_unsupported(both, rp).first()["dropped"] == 2


def ts(spark, rows):
    return spark.createDataFrame([("reach", "r", i, T0 + dt.timedelta(hours=h), *f, None) for i, h, f in rows], S.TIMESERIES)


def test_bulk_summary_keeps_nulls_and_first_peak(spark):
    rows = ts(spark, [("1", 0, (None, 1.0, None, None, 2.0)), ("1", 3, (5.0, 1.0, None, None, 9.0)), ("1", 6, (4.0, 1.0, None, None, 9.0)), ("2", 0, (None,) * 5)])
    got = {r.provider_reach_id: r for r in A.bulk_summary(rows).collect()}
    assert got["1"].peak_time_utc == T0 + dt.timedelta(hours=3) and got["1"].now_mean_cms is None and got["1"].now_max_cms == 2.0
    assert got["2"].peak_max_cms is None and got["2"].peak_time_utc is None


def test_reach_summary_policies(spark):
    rows = ts(spark, [("1", 0, (11.1, None, None, None, 15.0)), ("1", 3, (None, None, None, None, 18.8))])
    rp = ladder(spark, ("1", [10, 20, 30, 40, 50, 60]), ("2", [1, 2, 3, 4, 5, 6]))
    wanted = spark.createDataFrame([("reach", "r", "1"), ("reach", "r", "2")], "provider string, run_id string, provider_reach_id string")
    mean = {r.provider_reach_id: r for r in A.reach_summary(rows, rp, "mean_first", wanted).collect()}
    top = {r.provider_reach_id: r for r in A.reach_summary(rows, rp, "max_first", wanted).collect()}
    assert (mean["1"].return_period_band, mean["1"].severity_score, mean["1"].points) == ("2", 1, 2)
    assert mean["1"].peak_time_utc == T0 + dt.timedelta(hours=3) and mean["1"].first_exceedance_time_utc == T0
    assert mean["2"].return_period_band == "unknown" and top["2"].return_period_band is None and top["2"].severity_score == 0


def test_ladder_guard(spark):
    bad = [[10, 20, None, 40, 50, 60], [10, 20, 30, float("inf"), 50, 60], [0.001, 20, 30, 40, 50, 60], [2, 2, 3, 4, 5, 6]]
    rows = ladder(spark, *enumerate([*bad, [10, 20, 30, 40, 50, 60]]))
    assert [r.provider_reach_id for r in L.sanitize_ladder(rows).collect()] == ["4"]
    assert sum(r.ladders for r in L.rejected_ladders(rows).collect()) == 4
    assert {r.provider_reach_id for r in L.sanitize_ladder(rows, require_all=False).collect()} == {"0", "4"}


def test_pivot_ladder(spark):
    rows = [(760021611, p, m, v * f, 99.0) for m, f in (("gumbel", 1.0), ("logpearson3", 2.0)) for p, v in zip(S.PERIODS, [10.0, 20, 30, 40, 50, 60], strict=True)]
    long = spark.createDataFrame(rows, S.THRESHOLD_LONG)
    assert [A.pivot_ladder(long, "reach").first()[r] for r in S.RUNGS] == [10, 20, 30, 40, 50, 60]
    assert A.pivot_ladder(long, "reach", "logpearson3").first()["rp_2"] == 20
    with pytest.raises(ValueError):
        A.pivot_ladder(long, "reach", "normal")
    with pytest.raises(Exception, match="return periods"):
        A.pivot_ladder(long.where("return_period <> 5"), "reach").collect()


def test_normalize_timeseries(spark):
    rows = spark.createDataFrame([("1", None, "2026-03-12T00:00:00", "11.1", "nan"), (None, " 2 ", "2026-03-12T03:00:00+02:00", "", "5"), (" ", None, "2026-03-12", "1", "1"), ("3", None, "soon", "1", "1")], "provider_reach_id string, river_id string, forecast_time_utc string, flow_avg string, flow_max_cms string")
    got = P.normalize_timeseries(rows, "reach", "2026031200").orderBy("provider_reach_id").collect()
    assert [(r.provider_reach_id, r.flow_mean_cms, r.flow_max_cms) for r in got] == [("1", 11.1, None), ("2", None, 5.0)]
    assert got[1].forecast_time_utc == dt.datetime(2026, 3, 12, 1)
    rp = ladder(spark, ("1", [10, 20, 30, 40, 50, 60]))
    counts = A.prepare_stats(P.normalize_timeseries(rows, "reach", "x", tag=True), rp, "reach").first()
    assert tuple(counts) == (4, 2, 1, 1)


def test_resolve_columns(spark):
    df = spark.createDataFrame([("5.0", "1.5", 9.0)], "` RivID ` string, Q2 string, return_period_100 double")
    row = P.resolve_ladder(df, "grid").first()
    assert (row.provider_reach_id, row.rp_2, row.rp_5, row.rp_100) == ("5", 1.5, None, 9.0)
    with pytest.raises(ValueError):
        P.resolve_ladder(df.select("Q2"), "grid")


def test_run_lists(spark):
    paths = spark.createDataFrame([("a/2026031200.zarr",), ("a/2026031400.zarr/",), ("a/not-a-run",), ("a/2026031400.zarr",)], "path string")
    assert sorted(r.run_id for r in L.parse_run_ids(paths).collect()) == ["2026031200", "2026031400"]
    assert L.latest_listed_run(paths).first()["run_id"] == "2026031400"
    with pytest.raises(Exception, match="no run ids"):
        L.latest_listed_run(paths.limit(0)).collect()


def test_runs(spark):
    runs = spark.createDataFrame([("reach", f"202603{d:02}00", dt.datetime(2026, 3, d)) for d in (10, 11, 12)], "provider string, run_id string, run_date_utc timestamp")
    data = runs.where("run_id < '2026031200'").select("provider", "run_id")
    assert N.latest_run(runs).first()["run_id"] == "2026031200" and N.latest_run(runs, data).first()["run_id"] == "2026031100"
    assert [r.run_id for r in N.runs_to_retire(runs, 2).collect()] == ["2026031000"] and N.runs_to_retire(runs, 0).count() == 0


def test_high_res_member(spark):
    labels = lambda *names: spark.createDataFrame([("reach", "r", "1", T0, n, float(i)) for i, n in enumerate(names)], "provider string, run_id string, provider_reach_id string, forecast_time_utc timestamp, member string, flow_cms double")
    assert N.high_res_member(labels("a", "m10", "b")).first()["high_res_cms"] == 1.0
    assert N.high_res_member(labels("a", "b")).first()["high_res_cms"] == 0.0


def test_snap(spark):
    df = spark.createDataFrame([(x,) for x in (9.0, 10.125, 10.12, 10.13, 99.0)], "x double")
    for step, first in ((0.25, 10.0), (-0.25, 11.0)):
        assert [r.y for r in df.select(J.snap_regular("x", first, step, 5).alias("y")).collect()] == [10.0, 10.25, 10.0, 10.25, 11.0]
    assert [r.y for r in J.snap_irregular(df, "x", [10.25, 10.0, 11.0], "y").collect()] == [10.0, 10.25, 10.0, 10.25, 11.0]


def test_nearest_joins_against_brute_force(spark):
    rng = random.Random(3)
    cells = [(round(10 + 0.05 * i, 6), round(20 + 0.05 * j, 6), rng.uniform(1, 50)) for i in range(20) for j in range(20)]
    reaches = [(str(i), rng.uniform(9.9, 11.1), rng.uniform(19.9, 21.1), rng.uniform(1, 50)) for i in range(60)]
    c = spark.createDataFrame(cells, "grid_lat double, grid_lon double, grid_upstream_area_km2 double")
    r = spark.createDataFrame(reaches, "reach_id string, lat double, lon double, reach_upstream_area_km2 double")
    got: dict = {}
    for x in J.knn_candidates(r, c, k=5).collect():
        got.setdefault(x.reach_id, []).append((x.nth, x.grid_lat, x.grid_lon))
    for i, la, lo, _ in reaches:
        d = sorted((round(6371 * np.hypot(np.radians(la - a), np.radians(lo - b)), 9), a, b) for a, b, _ in cells)
        assert [x[1:] for x in sorted(got.get(i, []))] == [(a, b) for k, a, b in d if k <= 20][:5]
    xw = C.build_crosswalk(r, c, "grid", k=5)
    assert xw.count() == 60 and A.crosswalk_report(xw).first()["reaches"] == 60
    with pytest.raises(ValueError):
        C.build_crosswalk(r, c, "grid", max_km=0)
    grid = c.select(F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon"), F.col("grid_upstream_area_km2").alias("rp_2"))
    found = {x.reach_id: (x.cell_lat, x.cell_lon) for x in J.thresholds_for_reaches(r.select("reach_id", F.col("lat").alias("grid_lat"), F.col("lon").alias("grid_lon")), grid).collect()}
    for i, la, lo, _ in reaches:
        d = min((round(abs(la - a) + abs(lo - b), 9), a, b) for a, b, _ in cells)
        assert found.get(i) == ((d[1], d[2]) if d[0] < 0.06 else None)


def test_gumbel_fit(spark):
    rng = np.random.default_rng(1)
    x = 100 - 20 * np.log(-np.log(rng.uniform(size=4000)))
    loc, scale = T.gumbel_fit(x)
    assert abs(loc - 100) < 1.5 and abs(scale - 20) < 1.5
    assert np.isnan(T.gumbel_fit(np.array([3.0, 3.0]))[0])
    rows = spark.createDataFrame([(1, [float(v) for v in x[:50]]), (2, [1.0, 2.0]), (3, [5.0] * 6)], "cell int, maxima array<double>")
    got = T.gumbel_thresholds(rows).collect()
    assert [r.cell for r in got] == [1] and got[0].rp_2 < got[0].rp_5 < got[0].rp_20
    history = spark.createDataFrame([(1.0, 1.0, float(v)) for v in (1, 2, 3, 4)] + [(2.0, 1.0, float(v)) for v in x[:12]], "lat double, lon double, flow_cms double")
    cells = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 9.0, 9.0)], "provider_reach_id string, lat double, lon double")
    out = {r.provider_reach_id: r for r in T.reach_thresholds_from_history(cells, history, "grid").collect()}
    assert set(out) == {"a", "b"} and out["a"].rp_2 == 2.5 and out["b"].rp_10 is None


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, o int, v double")
    new = spark.createDataFrame([("b", 1, 5.0), ("b", 2, 6.0), ("c", 1, None)], "k string, o int, v double")
    once = U.upsert(old, new, ["k"], "o")
    assert sorted((r.k, r.v) for r in once.collect()) == [("a", 1.0), ("b", 6.0), ("c", None)]
    assert sorted(map(tuple, U.upsert(once, new, ["k"], "o").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_upsert_run_keeps_status(spark):
    schema = "provider string, run_id string, ingest_status string, metadata_json string"
    runs = spark.createDataFrame([("reach", "1", "complete", "{}"), ("reach", "2", "pending", None)], schema)
    found = spark.createDataFrame([("reach", "1", "pending", None), ("reach", "2", "pending", None), ("reach", "3", "pending", None)], schema)
    got = {r.run_id: (r.ingest_status, r.metadata_json) for r in U.upsert_run(runs, found).collect()}
    assert got == {"1": ("complete", "{}"), "2": ("pending", None), "3": ("pending", None)}


def test_reclassify_and_replace(spark):
    rp = ladder(spark, ("1", [10, 20, 30, 40, 50, 60]))
    row = ("reach", "r", "1", None, None, 22.0, None, None, None, None, "x", 999, False, None)
    target = spark.createDataFrame([row], S.SUMMARIES)
    got = C.ingest_summaries(target, rp, target, replace=True).first()
    assert (got.return_period_band, got.severity_score, got.is_flagged) == ("5", 2, True)
    high = ladder(spark, ("1", [25, 50, 60, 70, 80, 90]))
    assert C.reclassify(target, high).first()["return_period_band"] == "below_2"
    assert C.reclassify(target, high, skip=True).first()["severity_score"] == 999


def test_limits(spark):
    s = spark.createDataFrame([("reach", "r", str(i), i % 7, i % 7 > 0) for i in range(20)], "provider string, run_id string, provider_reach_id string, severity_score int, is_flagged boolean")
    assert [r.severity_score for r in N.severity_map(s, "reach", "r", 5, 3).collect()] == [6, 6, 5]
    assert N.severity_map(s, "reach", "r").count() == 17
    with pytest.raises(ValueError):
        N.severity_map(s, "reach", "r", limit=0)
