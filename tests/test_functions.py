import math

import pytest
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.functions import scalars as X

UP = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "peak,rungs,want",
    [
        (None, [10.0], ("unknown", 0, False)),
        (20.0, [], ("unknown", 0, False)),
        (9.9, [10.0, 20.0], ("below_2", 0, False)),
        (10.0, [10.0, 20.0], ("2", 1, True)),
        (21.0, [10.0, 20.0, 30.0], ("5", 2, True)),
        (30.0, UP, ("10", 3, True)),
        (40.0, UP, ("25", 4, True)),
        (50.0, UP, ("50", 5, True)),
        (60.0, UP, ("100", 6, True)),
        (5.0, [0.0] * 6, ("unknown", 0, False)),
        (5.0, [1e-20, 1e-12, 1e-9, 1e-6, 1e-5, 1e-4], ("unknown", 0, False)),
        (0.015, [0.01, 0.02], ("2", 1, True)),
        (100.0, [10.0, 20.0, None, 40.0, 50.0, 60.0], ("5", 2, True)),
        (float("inf"), UP, ("100", 6, True)),
    ],
)
def test_classify(spark, peak, rungs, want):
    rungs = rungs + [None] * (6 - len(rungs))
    row = spark.createDataFrame([(peak, *rungs)], "peak double, " + ", ".join(f"{r} double" for r in S.RUNGS)).select(X.classify("peak").alias("c")).first()["c"]
    assert tuple(row) == want


def test_safe_double(spark):
    rows = spark.createDataFrame([(t,) for t in ["11.1", "nan", " ", "", "none", "NULL", " inf ", "x", None, "-3e2"]], "t string")
    got = [r.x for r in rows.select(X.safe_double("t").alias("x")).collect()]
    assert got == [11.1, None, None, None, None, None, math.inf, None, None, -300.0]


def test_identifiers(spark):
    rows = spark.createDataFrame([(" 760021611.0 ",), ("",), ("a1",), (None,), ("12.50",)], "t string")
    assert [r.x for r in rows.select(X.normalize_reach_id("t").alias("x")).collect()] == ["760021611", None, "a1", None, "12.50"]
    assert one(spark, X.normalize_reach_id("v", floating=True), v=760021611.0) == "760021611"
    props = ['{"reach_id": " ", "LINKNO": 12.7}', '{"reach_id": true}', '{"COMID": "nan"}', "{}", '{"HYRIV_ID": "9"}']
    rows = spark.createDataFrame([(p,) for p in props], "p string")
    assert [r.x for r in rows.select(X.reach_id_fallback("p").alias("x")).collect()] == ["12", None, None, None, "9"]


def test_interpolation_and_text(spark):
    stops = [(0, 120000), (3, 60000), (5, 15000), (6, 0)]
    rows = spark.createDataFrame([(z,) for z in [-1.0, 0.0, 1.5, 3.0, 4.0, 6.0, 9.0]], "z double")
    assert [r.x for r in rows.select(X.interp_linear("z", stops).alias("x")).collect()] == [120000, 120000, 90000, 60000, 37500, 0, 0]
    assert one(spark, X.flood_tile_date("v"), v="20260102") == "2026-01-02"
    assert one(spark, X.flood_tile_date("v"), v="2026/01/02") is None
    assert one(spark, X.band_label("v"), v="below_2") == "Normal"
    assert one(spark, X.band_label("v"), v="other") == "other"
    assert one(spark, X.bbox_key("a", "a", "b", "b"), a=-3.0, b=3.0) == "-2,-2,4,4"
    assert one(spark, X.time_to_run_id(X.run_id_to_time("v")), v="2026031200") == "2026031200"
