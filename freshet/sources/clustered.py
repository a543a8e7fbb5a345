"""Tables whose rows lie in buckets by key and sorted inside them: joins and aggregations on the key need no shuffle, and a
lookup of one key reads one bucket.

A clustered table is Parquet files in one folder. Its layout (columns, buckets, order) is kept beside them in
``_layout``, so that any session can read it without a shared catalog.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from freshet import schemas as S


def _quoted(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def write_clustered(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = (), partition_by: Sequence[str] = (), buckets: int | None = None) -> None:
    """Replace the table at ``path``: rows with equal ``by`` in one of ``buckets`` (the session's shuffle partitions if not given), ordered by
    ``by`` and ``sort`` inside; one file for each bucket of each partition."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, *(c for c in sort if c not in by)]
    name = f"freshet_write_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *by).write.mode("overwrite").format("parquet").option("path", path).option("compression", "zstd")
    writer = writer.bucketBy(buckets, *by).sortBy(*order)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog only: the files are external
    layout = {"by": list(by), "order": order, "partition_by": list(partition_by), "buckets": buckets, "schema": df.schema.json()}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_layout")


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with its buckets, as a temporary name of this session's catalog. See :func:`forget_clustered`."""
    from pyspark.sql import types as T

    layout = json.loads(spark.read.text(f"{path}/_layout").first()["value"])
    fields = {f.name: f for f in T.StructType.fromJson(json.loads(layout["schema"]))}
    columns = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in fields.items())
    parts = f"PARTITIONED BY ({_quoted(layout['partition_by'])})" if layout["partition_by"] else ""
    name = f"freshet_read_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} CLUSTERED BY ({_quoted(layout['by'])}) SORTED BY ({_quoted(layout['order'])}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    if layout["partition_by"]:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    out = spark.table(name).select(*fields)
    out._freshet_table = name
    return out


def forget_clustered(df: DataFrame) -> None:
    """Take a table of :func:`read_clustered` out of the catalog; its files stay."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._freshet_table}")


def join_in_buckets(spark: SparkSession) -> None:
    """Let this session join clustered tables on more columns than those of their buckets without a shuffle: (provider, reach) on buckets by reach."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def write_clustered_timeseries(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Normalized timeseries by run, in buckets by reach, ordered by time."""
    write_clustered(df.select(*S.TIMESERIES.names), path, ["provider_reach_id"], ["forecast_time_utc"], S.RUN_KEYS, buckets)


def write_clustered_summaries(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Summaries by run, in buckets by reach."""
    write_clustered(df.select(*(c for c in S.SUMMARIES.names if c in df.columns)), path, ["provider_reach_id"], (), S.RUN_KEYS, buckets)


def write_clustered_ladders(rp: DataFrame, path: str, buckets: int | None = None) -> None:
    """Ladders in buckets by reach; joins with clustered artifacts of as many buckets don't shuffle (see :func:`join_in_buckets`)."""
    write_clustered(rp, path, ["provider_reach_id"], ["provider"], (), buckets)
