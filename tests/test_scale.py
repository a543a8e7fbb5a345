"""Operators whose groups may be of any size: selection, grouped fits, dense tiles, clustered tables."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.operators import joins as J
from freshet.operators import thresholds as T
from freshet.operators.nearest import quadtree
from freshet.operators.selection import exact_percentiles
from freshet.sources import clustered as K


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# --- percentiles --------------------------------------------------------------------------------

ODD = [0.0, -0.0, 5e-324, -5e-324, 1e-300, 1e300, -1e300, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, -1.0, 1e308, 2.0, 4.0, 3.9999999999999996]


@pytest.mark.parametrize("kind", ["spread", "near", "one value", "odd", "hot"])
def test_percentiles_equal_a_sort(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.lognormal(0, 20, 3001) * rng.choice([-1, 1], 3001), "near": 1 + np.arange(2000) * 2**-52, "one value": np.full(500, 7.25), "odd": np.array(ODD * 3), "hot": np.r_[np.full(1500, 3.0), rng.normal(3, 1e-9, 1500)]}[kind]
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(x)] + [(None, float("nan"))], "a double, b double").repartition(5)
    ps = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = exact_percentiles(df, ["a", "b"], ps).first()
    for column, own in (("a", np.sort(x)), ("b", np.arange(float(len(x))))):
        for p in ps:
            at = (len(own) - 1) * p
            low, high = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            part = at - int(at)
            want = low * (1 - part) + (high * part if part else 0)
            assert got[f"{column}_p{round(100 * p)}"] == pytest.approx(want, rel=1e-12, abs=0), (column, p)


def test_percentiles_of_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), float(rng.randrange(50))) for _ in range(900)] + [("empty", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    got = {(r.g, r.h): (r.v_p25, r.v_p50) for r in exact_percentiles(df, ["v"], [0.25, 0.5], ["g", "h"]).collect()}
    for key in {(g, h) for g, h, v in rows if v is not None}:
        own = [v for g, h, v in rows if (g, h) == key and v is not None]
        assert got.pop(key) == (np.percentile(own, 25), np.percentile(own, 50))
    assert not got
    assert exact_percentiles(df.limit(0), ["v"], [0.5], ["g"]).count() == 0
    assert exact_percentiles(df.limit(0), ["v"], [0.5]).first()["v_p50"] is None


# --- Gumbel fits --------------------------------------------------------------------------------


def test_fits_by_rounds_equal_fits_of_lists(spark):
    rng = np.random.default_rng(5)
    samples = {k: 50 * k - (k + 1) * np.log(-np.log(rng.uniform(size=10 + 30 * k))) for k in range(8)}
    samples[20] = np.full(30, 4.0)
    samples[21] = np.array([1.0])
    samples[22] = np.array([1.0] * 50 + [1e6])
    samples[23] = np.array([1.0, 1.0 + 1e-12] * 6)
    df = spark.createDataFrame([(k, float(v)) for k, x in samples.items() for v in x], "cell int, v double").repartition(4)
    got = {r.cell: (r.n, r["loc"], r.scale) for r in T.gumbel_by_rounds(df, ["cell"], "v", part_rows=40).collect()}
    assert set(got) == {*range(8), 22, 23}
    for k, (n, loc, scale) in got.items():
        assert n == len(samples[k])
        if k == 23:  # values that differ in their last digits
            assert scale == pytest.approx(1e-12 * T.gumbel_fit(np.array([0.0, 1.0] * 6))[1], rel=1e-3)
        else:
            assert (loc, scale) == pytest.approx(T.gumbel_fit(samples[k]), rel=1e-6)
    assert T.gumbel_by_rounds(df.limit(0), ["cell"], "v").count() == 0


def test_fits_by_groups_equal_fits_of_lists(spark):
    """Groups of up to part_rows values are fitted where they lie, others in rounds; small groups come back as values."""
    rng = np.random.default_rng(6)
    samples = {k: 50 * k - (k + 1) * np.log(-np.log(rng.uniform(size=10 + 30 * k))) for k in range(8)}
    samples |= {20: np.full(30, 4.0), 21: np.array([1.0]), 22: np.array([1.0] * 50 + [1e6]), 24: rng.uniform(size=9)}
    rows = [(k, float(v)) for k, x in samples.items() for v in x] + [(None, float(v)) for v in range(20)]
    df = spark.createDataFrame(rows, "cell int, v double").repartition(4)
    for part_rows in (40, 100_000):
        fits, few = T.gumbel_by_groups(df, ["cell"], "v", least=10, part_rows=part_rows)
        got = {r.cell: (r.n, r["loc"], r.scale) for r in fits.collect()}
        assert set(got) == {*range(8), 22}
        for k, (n, loc, scale) in got.items():
            assert n == len(samples[k]) and (loc, scale) == pytest.approx(T.gumbel_fit(samples[k]), rel=1e-6)
        assert sorted((r.cell, r.v) for r in few.collect()) == sorted((k, float(v)) for k in (21, 24) for v in samples[k])
    assert T.gumbel_by_groups(df.limit(0), ["cell"], "v")[0].count() == 0


def test_history_is_shuffled_once(spark):
    """Fits and percentiles read one shuffle of the values."""
    history = spark.range(20_000).select((F.col("id") % 900).cast("double").alias("lat"), (F.col("id") % 7).cast("double").alias("lon"), F.sqrt("id").alias("flow_cms"))
    cells = history.select("lat", "lon").distinct().withColumn("provider_reach_id", F.concat_ws("-", "lat", "lon"))
    out = T.reach_thresholds_from_history(cells, history, "grid", gumbel_from=4)
    assert {json.loads(r.metadata_json)["sample_count"] for r in out.collect()} == {3, 4}
    text = plan(out).split("Initial Plan")[0]
    assert "ReusedExchange" in text and "SortMergeJoin [lat" not in text


def test_a_hot_cell(spark):
    """A cell of a million values, dealt to several tasks: no list of them anywhere in the plan."""
    hot = spark.range(1_000_000, numPartitions=8).select(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), (100 - 20 * F.log(-F.log((F.col("id") + 0.5) / 1_000_000))).alias("flow_cms"))
    few = spark.createDataFrame([(3.0, 2.0, float(v)) for v in range(1, 6)], "lat double, lon double, flow_cms double")
    cells = spark.createDataFrame([("hot", 1.0, 2.0), ("few", 3.0, 2.0), ("none", 9.0, 9.0)], "provider_reach_id string, lat double, lon double")
    out = T.reach_thresholds_from_history(cells, hot.unionByName(few), "grid")
    assert "collect_list" not in plan(out) and "EvalPython" not in plan(out)
    rows = {r.provider_reach_id: r for r in out.collect()}
    assert set(rows) == {"hot", "few"} and rows["few"].rp_2 == 3.0
    assert rows["hot"].rp_2 == pytest.approx(100 - 20 * np.log(np.log(2)), rel=1e-4)
    assert rows["hot"].metadata_json == '{"sample_count":1000000}'


def test_thresholds_of_rows(spark):
    rng = np.random.default_rng(1)
    x = [[float(v) for v in 100 - 20 * np.log(-np.log(rng.uniform(size=n)))] for n in (40, 12, 3)]
    lists = spark.createDataFrame(list(enumerate(x)), "cell int, maxima array<double>")
    want = {r.cell: r for r in T.gumbel_thresholds(lists).collect()}
    got = {r.cell: r for r in T.gumbel_thresholds_of_rows(lists.select("cell", F.explode("maxima").alias("top")), ["cell"]).collect()}
    assert set(got) == set(want) == {0, 1}
    for k in got:
        assert tuple(got[k]) == pytest.approx(tuple(want[k]), rel=1e-6)


# --- dense tiles --------------------------------------------------------------------------------


def brute_knn(reaches, cells, k):
    r, c = np.radians(np.array([(a, b) for _, a, b in reaches])), np.radians(np.array(cells))
    out = {}
    for (i, _, _), p in zip(reaches, r, strict=True):
        d = np.round(6371 * np.hypot(*(p - c).T), 9)
        near = np.flatnonzero(d <= 20)
        out[i] = [cells[j] for j in sorted(near, key=lambda j: (d[j], *cells[j]))[:k]]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("leaf", [1, 6, 10_000])
def test_quadtree_gives_the_same_neighbours(spark, leaf):
    rng = random.Random(2)
    cells = [(round(10 + 0.05 * i, 6), round(20 + 0.05 * j, 6)) for i in range(12) for j in range(12)]
    cells += [(10.2 + rng.gauss(0, 0.004), 20.2 + rng.gauss(0, 0.004)) for _ in range(700)]  # dense
    cells = sorted(set(cells))
    reaches = [(str(i), rng.uniform(9.8, 10.8), rng.uniform(19.8, 20.8)) for i in range(60)] + [(f"d{i}", 10.2 + rng.gauss(0, 0.003), 20.2 + rng.gauss(0, 0.003)) for i in range(60)] + [("south", -9.9, -20.0)]
    c = spark.createDataFrame([*cells, (-9.95, -20.01)], "grid_lat double, grid_lon double")
    r = spark.createDataFrame(reaches, "reach_id string, lat double, lon double")
    got: dict = {}
    for x in J.knn_candidates(r, c, k=5, leaf=leaf).collect():
        got.setdefault(x.reach_id, []).append((x.nth, x.grid_lat, x.grid_lon))
    assert {i: [x[1:] for x in sorted(v)] for i, v in got.items()} == brute_knn(reaches, [*cells, (-9.95, -20.01)], 5)


def test_a_hundred_thousand_cells_in_one_tile(spark):
    side = 317
    cells = spark.range(side * side).select((F.lit(10.0) + (F.col("id") / side).cast("int") * 0.0005).alias("grid_lat"), (F.lit(20.0) + (F.col("id") % side) * 0.0005).alias("grid_lon"))
    sites = cells.select(F.col("grid_lat").alias("y"), F.col("grid_lon").alias("x"), F.struct("grid_lat", "grid_lon").alias("site"))
    levels, placed = quadtree(sites, 0.18)
    assert placed.count() == side * side
    assert placed.groupBy("level", "ty", "tx").count().agg(F.max("count")).first()[0] <= 512
    rng = random.Random(1)
    reaches = [(str(i), 10 + rng.uniform(0, 0.158), 20 + rng.uniform(0, 0.158)) for i in range(300)]
    got = J.knn_candidates(spark.createDataFrame(reaches, "reach_id string, lat double, lon double"), cells, k=4).collect()
    assert len(got) == 1200
    first = {r.reach_id: (r.grid_lat, r.grid_lon) for r in got if r.nth == 1}
    for i, la, lo in reaches:
        assert first[i] == pytest.approx((10 + round((la - 10) / 0.0005) * 0.0005, 20 + round((lo - 20) / 0.0005) * 0.0005), abs=1e-9)


def test_many_cells_on_one_spot(spark):
    cells = spark.range(3000).select(F.lit(10.0).alias("grid_lat"), F.lit(20.0).alias("grid_lon"), F.col("id").alias("n"))
    r = spark.createDataFrame([("a", 10.0, 20.001), ("b", 30.0, 20.0), ("c", None, 1.0)], "reach_id string, lat double, lon double")
    got = J.knn_candidates(r, cells, k=4).orderBy("nth").collect()
    assert [(x.reach_id, x.n) for x in got] == [("a", 0), ("a", 1), ("a", 2), ("a", 3)]
    assert J.knn_candidates(r, cells.limit(0)).count() == 0 == J.knn_candidates(r.limit(0), cells).count()


def test_nearest_grid_value_of_dense_cells(spark):
    rng = random.Random(9)
    grid = sorted({(10 + rng.gauss(0, 0.01), 20 + rng.gauss(0, 0.01)) for _ in range(1500)})
    points = [(str(i), 10 + rng.gauss(0, 0.03), 20 + rng.gauss(0, 0.03)) for i in range(80)]
    found = J.thresholds_for_reaches(spark.createDataFrame(points, "reach_id string, grid_lat double, grid_lon double"), spark.createDataFrame([(*g, float(i)) for i, g in enumerate(grid)], "lat double, lon double, rp_2 double"), leaf=8)
    got = {r.reach_id: (r.cell_lat, r.cell_lon) for r in found.collect() if not r.exact}
    for i, la, lo in points:
        d, *cell = min((round(abs(la - a) + abs(lo - b), 9), a, b) for a, b in grid)
        if i in got:
            assert got[i] == tuple(cell)
        elif d >= 0.06:
            assert i not in got


# --- clustered tables ---------------------------------------------------------------------------


@pytest.fixture
def artifact(spark, tmp_path):
    ts = spark.range(4000).select(F.lit("reach").alias("provider"), F.concat(F.lit("202603"), F.lpad((F.col("id") % 3 + 1).cast("string"), 2, "0"), F.lit("00")).alias("run_id"), (F.col("id") % 50).cast("string").alias("provider_reach_id"), (F.lit("2026-03-01").cast("timestamp") + F.make_interval(hours=(F.col("id") / 50).cast("int"))).alias("forecast_time_utc"), *(F.col("id").cast("double").alias(f) for f in S.FLOWS), F.lit(None).cast("string").alias("raw_payload_json"))
    K.write_clustered_timeseries(ts, str(tmp_path / "ts"), 8)
    rp = spark.range(50).select(F.lit("reach").alias("provider"), F.col("id").cast("string").alias("provider_reach_id"), *(F.lit(float(i)).alias(r) for i, r in enumerate(S.RUNGS)))
    K.write_clustered_ladders(rp, str(tmp_path / "rp"), 8)
    return ts, rp, tmp_path


def test_clustered_artifacts_come_back_whole(spark, artifact):
    ts, rp, path = artifact
    known = {t.name for t in spark.catalog.listTables()}
    for want, name in ((ts, "ts"), (rp, "rp")):
        back = K.read_clustered(spark, str(path / name))
        assert back.schema.simpleString() == want.select(*back.columns).schema.simpleString()
        assert back.exceptAll(want.select(*back.columns)).count() == 0 and back.count() == want.count()
        K.forget_clustered(back)
    assert {t.name for t in spark.catalog.listTables()} == known


def test_joins_of_clustered_artifacts_do_not_shuffle(spark, artifact):
    from freshet.operators import windows as N

    *_, path = artifact
    ts, rp = (K.read_clustered(spark, str(path / n)) for n in ("ts", "rp"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    K.join_in_buckets(spark)
    try:
        both = J.attach_thresholds(ts, rp)
        assert "Exchange" not in plan(both) and "Join" in plan(both)
        assert both.where("rp_100 = 5").count() == 4000
        assert "Exchange" not in plan(J.supported_only(ts, rp, trimmed=True)) and "Join" in plan(J.supported_only(ts, rp, trimmed=True))
        assert J.supported_only(ts, rp, trimmed=True).count() == 4000
        per_reach = ts.groupBy(*S.REACH_KEYS).agg(F.max("flow_max_cms"))
        assert "Exchange" not in plan(per_reach)
        wanted = ts.select(*S.REACH_KEYS).where("provider_reach_id in ('3', '7')").distinct()
        detail = J.detail_with_fallback(ts, ts.limit(0).select(*S.TIME_KEYS, F.lit(0).alias("member"), F.col("flow_max_cms").alias("flow_cms")), wanted)
        assert detail.count() == 160
        one = N.reach_timeseries(ts, "reach", "2026030200", "7", 500)
        assert "PartitionFilters: [" in plan(one)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan names the buckets that are read
        assert "SelectedBucketsCount: 1 out of 8" in plan(N.reach_timeseries(ts, "reach", "2026030200", "7", 500))
        assert [r.provider_reach_id for r in one.collect()] == ["7"] * 27
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        K.forget_clustered(ts)
        K.forget_clustered(rp)


# --- line numbers, counters, axes, counts, pages ------------------------------------------------


def test_line_numbers_over_many_splits(spark, tmp_path):
    """As a sequential reader numbers them, over files that are cut into many splits."""
    from freshet.sources import tables as R

    rng = random.Random(3)
    want = {}
    for name in ("a", "b", "c"):
        lines = ["" if rng.random() < 0.2 else '{"provider_reach_id": "%s-%d", "flow_max": "%s"}' % (name, i, "1" * rng.randrange(1, 90)) for i in range(900)]
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\n")
        want |= {f"{name}-{i}": i + 1 for i, line in enumerate(lines) if line}
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = R.read_raw_forecast_jsonl(spark, str(tmp_path), "2026031200")
        assert rows.rdd.getNumPartitions() > 20
        assert {r.provider_reach_id: r.line_number for r in rows.collect()} == want
        (tmp_path / "bad.json").write_text('{"provider_reach_id": ')
        with pytest.raises(Exception, match="(?i)malformed"):
            R.read_raw_forecast_jsonl(spark, str(tmp_path), "2026031200").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_preparation_counts_in_the_pass_that_writes(spark, tmp_path):
    from freshet.plans import workflows as C
    from freshet.sources import tables as R

    rows = [("1", "2026-03-12T00:00:00", "11.1", "nan"), (" 2 ", "2026-03-12T03:00:00", "", "5"), (" ", "2026-03-12", "1", "1"), ("1", "soon", "1", "1"), ("1", "2026-03-12", "", None)]
    raw = spark.createDataFrame(rows, "river_id string, time string, flow_avg string, flow_max string")
    rp = spark.createDataFrame([("reach", "1", *map(float, S.PERIODS))], "provider string, provider_reach_id string, " + ", ".join(f"{r} double" for r in S.RUNGS))
    path = str(tmp_path / "artifact")
    counters = {"records_seen": 5, "invalid_dropped": 3, "filtered_dropped": 1, "written": 1}
    assert C.prepare_artifact(raw, rp, "reach", path, "2026031200") == counters
    assert C.prepare_artifact(raw, rp, "reach", path, "2026031200") is None
    assert C.prepare_artifact(raw, rp, "reach", path, "2026031200", expected_reaches=2) == counters
    back = R.read_timeseries_artifact(spark, path).collect()
    assert [(r.provider_reach_id, r.flow_mean_cms) for r in back] == [("1", 11.1)]
    assert C.prepare_artifact(raw.limit(0), rp, "reach", path, "2026031200", "overwrite") == dict.fromkeys(counters, 0)


def test_snap_to_a_long_axis(spark):
    axis = spark.range(1_000_000).select((F.col("id") * 0.5).alias("a"))
    points = spark.createDataFrame([(i, x) for i, x in enumerate([-5.0, 0.25, 0.2, 0.3, 1e9, None, float("nan"), 77.75, 499_999.5, 77.75])], "k long, x double")
    out = J.snap_to_axis(points, "x", axis, "a", "y")
    assert "EvalPython" not in plan(out) and "InArrow" not in plan(out)
    assert [r.y for r in out.orderBy("k").collect()] == [0.0, 0.5, 0.0, 0.5, 499_999.5, None, None, 78.0, 499_999.5, 78.0]
    assert [r.y for r in J.snap_to_axis(points, "x", axis.limit(0), "a", "y").collect()] == [None] * 10
    assert [r.x for r in J.snap_to_axis(points.select("x").limit(1), "x", axis, "a", "x").collect()] == [0.0]


def test_counts_of_deltas_equal_a_recount(spark):
    from freshet.operators import aggregations as A
    from freshet.operators import upserts as U

    rng = random.Random(6)
    schema = "provider string, run_id string, provider_reach_id string, forecast_time_utc timestamp, v int"
    batch = lambda n: spark.createDataFrame([("reach", f"r{rng.randrange(3)}", str(rng.randrange(4)), dt.datetime(2026, 1, 1, rng.randrange(24)), 0) for _ in range(n)], schema)
    target, deltas = batch(0), []
    first = batch(40).cache()
    for rows in (first, batch(60).cache(), first, batch(5).cache()):
        deltas.append(A.timeseries_delta(target, rows))
        target = U.upsert(target, rows, S.TIME_KEYS)
    whole = target.groupBy(*S.REACH_KEYS).count()
    assert sorted(map(tuple, A.merge_counts(*deltas).collect())) == sorted(map(tuple, whole.collect()))
    assert A.timeseries_delta(target, first).count() == 0


def test_severity_pages(spark):
    from freshet.operators import windows as N

    s = spark.createDataFrame([("reach", "r", f"{i:04d}", i % 7, i % 7 > 0) for i in range(700)] + [("reach", "r", "0001", 6, True)], "provider string, run_id string, provider_reach_id string, severity_score int, is_flagged boolean")
    pages = N.severity_map_pages(s, "reach", "r", page_reaches=50).orderBy("range", "page").collect()
    assert all(len(p.scores) <= 50 and min(p.scores) == p.first_reach and max(p.scores) == p.last_reach for p in pages)
    assert all(a.last_reach < b.first_reach for a, b in zip(pages, pages[1:], strict=False))
    merged = {k: v for p in pages for k, v in p.scores.items()}
    assert merged == {f"{i:04d}": i % 7 for i in range(700) if i % 7} | {"0001": 6}
    assert N.severity_map_pages(s.limit(0), "reach", "r").count() == 0


def test_crosswalk_refresh_equals_a_full_run(spark):
    from freshet.plans import workflows as C

    rng = random.Random(8)
    cells = [(10 + 0.05 * i, 20 + 0.05 * j, rng.uniform(1, 50)) for i in range(30) for j in range(30)]
    reaches = [(str(i), rng.uniform(9.9, 11.6), rng.uniform(19.9, 21.6), rng.uniform(1, 50)) for i in range(150)]
    frame = lambda r, c: (spark.createDataFrame(r, "reach_id string, lat double, lon double, reach_upstream_area_km2 double"), spark.createDataFrame(c, "grid_lat double, grid_lon double, grid_upstream_area_km2 double"))
    before = frame(reaches, cells)
    old = C.build_crosswalk(*before, "grid").unionByName(C.build_crosswalk(*before, "other").limit(3))
    changed = [*reaches[:-2], ("0", 11.0, 21.0, 3.0), ("new", 10.5, 20.5, 3.0)][1:]
    moved = [(a, b, s * 9 if a > 11.2 else s) for a, b, s in cells[5:]]
    after = frame(changed, moved)
    table, report = C.refresh_crosswalk(old, *after, "grid", before=before)
    key = lambda r: (r.reach_id, r.target_provider)
    want = sorted([*C.build_crosswalk(*after, "grid").collect(), *old.where("target_provider = 'other'").collect()], key=key)
    assert sorted(table.collect(), key=key) == want
    assert report.first()["reaches"] == len(changed)
    same, _ = C.refresh_crosswalk(table, *after, "grid", before=after)
    assert sorted(same.collect(), key=key) == want


def test_later_model_rows_win(spark):
    features = spark.createDataFrame([('{"LINKNO": 5}', "{}")], "props string, geometry string")
    model = spark.createDataFrame([("5", "9", "9.0", 1), ("5", "2", "1.0", 2)], "LINKNO string, strmOrder string, DSContArea string, at int")
    assert J.enrich_streams(features, model, "at").first()["strmOrder"] == 2
    assert J.enrich_streams(features, model).first()["strmOrder"] == 9


def test_enriched_streams_count_as_they_are_written(spark, tmp_path):
    from freshet.plans import workflows as C

    features = spark.createDataFrame([('{"LINKNO": %d}' % i if i else "{}", "{}") for i in range(5)], "props string, geometry string")
    model = spark.createDataFrame([("1", "2", "3.0"), ("2", None, "1.0")], "LINKNO string, strmOrder string, DSContArea string")
    path = str(tmp_path / "streams")
    assert C.write_enriched_streams(features, model, path) == {"processed": 5, "written": 4, "missing_id": 1, "missing_attributes": 2}
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="no stream"):
        C.write_enriched_streams(features.limit(0), model, path)
