"""Structured Streaming ingest: the batch jobs, applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from freshet import schemas as S
from freshet.operators import filters as L
from freshet.operators import joins as J
from freshet.operators import projections as P
from freshet.plans.workflows import write_upsert


def read_raw_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw forecast records from JSON files as they arrive."""
    return spark.readStream.schema(T.StructType([*S.RAW_FORECAST, T.StructField("run_id", T.StringType())])).json(path)


def ingest_timeseries_stream(raw: DataFrame, rp: DataFrame, provider: str, target_path: str, scratch_path: str, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch's supported rows; a batch that is replayed gives the same table."""

    def one(batch: DataFrame, number: int) -> None:
        rows = J.supported_only(L.drop_empty_stats(P.normalize_timeseries(batch, provider)), rp, provider)
        write_upsert(target_path, rows.select(*S.TIMESERIES.names), S.TIME_KEYS, f"{scratch_path}/{number}")

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
