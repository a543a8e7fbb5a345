import datetime as dt

import pytest

from freshet import schemas as S
from freshet.sources import tables as R
from freshet.streaming.ingest import ingest_timeseries_stream, read_raw_stream


def test_summary_artifact_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/summary"
    row = ("reach", "2026031200", "1", dt.datetime(2026, 3, 12), None, 1.0, 2.0, 3.0, None, 5.0, "2", None, None, None)
    R.write_summary_artifact(spark.createDataFrame([row], S.SUMMARIES), path)
    R.write_summary_artifact(spark.createDataFrame([(*row[:1], "2026031300", *row[2:])], S.SUMMARIES), path)
    back = R.read_summary_artifact(spark, path)
    assert back.count() == 2 and dict(back.dtypes)["run_id"] == "string" and back.columns == S.SUMMARIES.names
    got = R.read_summary_artifact(spark, path, "reach", "2026031200").collect()
    assert len(got) == 1 and got[0].severity_score == 0 and got[0].is_flagged is False and got[0].metadata_json is None
    stats = R.artifact_stats(spark.read.parquet(path)).first()
    assert stats.row_count == 2 and stats.size_bytes > 0 and stats.signature


def test_timeseries_artifact(spark, tmp_path):
    path = f"file://{tmp_path}/ts"
    rows = spark.createDataFrame([("reach", "r", "1", dt.datetime(2026, 1, 1), 1.0, None, None, None, 2.0, None)], S.TIMESERIES)
    R.write_timeseries_artifact(rows, path)
    R.write_timeseries_artifact(rows.unionByName(rows), path, "skip")
    assert R.read_timeseries_artifact(spark, path).count() == 1
    R.write_timeseries_artifact(rows.unionByName(rows), path, "skip", expected_reaches=5)
    assert R.read_timeseries_artifact(spark, path).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        R.write_timeseries_artifact(rows, path, "error")
    (tmp_path / "bad.json").write_text('{"provider": "reach"}\n')
    with pytest.raises(Exception, match="without"):
        R.read_timeseries_artifact(spark, f"file://{tmp_path}/bad.json").collect()


def test_raw_and_features(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"river_id": "1", "time": "2026-01-01", "flow_avg": "2"}\n\n{"river_id": "2"}\n')
    rows = R.read_raw_forecast_jsonl(spark, f"file://{tmp_path}/raw.jsonl", "2026010100")
    assert rows.count() == 2 and rows.first()["source_path"].endswith("raw.jsonl")
    (tmp_path / "worse.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_raw_forecast_jsonl(spark, f"file://{tmp_path}/worse.jsonl", "x").collect()
    (tmp_path / "f.geojsonl").write_text('{"type":"Feature","properties":{"LINKNO":1},"geometry":{"type":"Point"}}\nbroken\n')
    got = R.read_stream_features(spark, f"file://{tmp_path}/f.geojsonl").collect()
    assert len(got) == 1 and got[0].geometry == '{"type":"Point"}'
    (tmp_path / "t.csv").write_text("rivid,rp2\n1,2.5\n")
    assert R.read_thresholds_file(spark, f"file://{tmp_path}/t.csv").first()["rp2"] == "2.5"
    with pytest.raises(ValueError):
        R.read_thresholds_file(spark, "x.xlsx")


def test_stream_ingest_is_idempotent(spark, tmp_path):
    rp = spark.createDataFrame([("reach", "1", *[1.0] * 6)], "provider string, provider_reach_id string, " + ", ".join(f"{r} double" for r in S.RUNGS))
    target = f"file://{tmp_path}/target"
    first = spark.createDataFrame([("reach", "2025010100", "1", dt.datetime(2025, 1, 1), *[9.0] * 5, None)], S.TIMESERIES)
    first.write.partitionBy(*S.RUN_KEYS).parquet(target)
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text('{"river_id":"1","time":"2026-01-01","flow_avg":"%d","run_id":"2026010100"}\n{"river_id":"7","time":"2026-01-01","flow_avg":"1","run_id":"2026010100"}\n' % i)
        raw = read_raw_stream(spark, f"file://{tmp_path}/in")
        ingest_timeseries_stream(raw, rp, "reach", target, f"file://{tmp_path}/scratch", f"file://{tmp_path}/check").awaitTermination()
    got = spark.read.schema(S.TIMESERIES).parquet(target).orderBy("run_id").collect()
    assert [(r.run_id, r.flow_mean_cms) for r in got] == [("2025010100", 9.0), ("2026010100", 1.0)]
