"""Reading and writing of forecast tables: JSON lines, CSV and Parquet, always with an explicit schema."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import schemas as S
from freshet.functions import scalars as X

WRITE_MODES = {"skip": "ignore", "overwrite": "overwrite", "error": "errorifexists"}


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_path, line_number): every line of text files with its number from 1, blank lines counted.

    Two passes over the file splits: the first counts the lines of each split, prefix sums give where a split begins, and the second numbers
    the lines inside their split. A row for each split is all that is gathered; a file may have any number of them.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta.getField("file_path").alias("source_path"), meta.getField("file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("source_path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(W.partitionBy("source_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = splits.withColumn("before", F.coalesce(before, F.lit(0)))
    both = lines.join(starts, ["source_path", "block"])
    place = F.col("id") - F.col("first")  # lines of a split come one after the other; the second pass must have cut the files as the first did
    number = F.when((place >= 0) & (place < F.col("n")), F.col("before") + place + 1).otherwise(F.raise_error(F.lit("files changed while they were read")).cast("bigint"))
    return both.select("value", "source_path", number.alias("line_number"))


def read_raw_forecast_jsonl(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Raw records with run_id, source_path and line_number; blank lines are skipped but counted, a malformed line fails the read."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", S.RAW_FORECAST, {"mode": "FAILFAST"}).alias("r"), "source_path", "line_number")
    return rows.select("r.*", F.lit(run_id).alias("run_id"), "source_path", "line_number")


def read_timeseries_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Normalized rows; a row without one of its keys fails the read."""
    rows = _json(spark, path, S.TIMESERIES)
    for name in S.TIME_KEYS:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"timeseries row without {name}"))).otherwise(F.col(name)).cast(S.TIMESERIES[name].dataType))
    return rows


def read_summary_artifact(spark: SparkSession, path: str, provider: str | None = None, run_id: str | None = None) -> DataFrame:
    """Summary rows: run_id stays text, a null score is 0, a null flag false, metadata null."""
    rows = spark.read.schema(S.SUMMARY_ARTIFACT).parquet(path)
    if provider is not None:
        rows = rows.where(F.col("provider") == provider)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    rows = rows.withColumn("severity_score", F.coalesce(F.col("severity_score").cast("int"), F.lit(0))).withColumn("is_flagged", F.coalesce("is_flagged", F.lit(False)))
    return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.SUMMARIES))


def read_thresholds_file(spark: SparkSession, path: str) -> DataFrame:
    """CSV or text with a header, or Parquet, by suffix."""
    name = path.lower().rstrip("/")
    if name.endswith((".csv", ".txt")):
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"thresholds must be .csv, .txt, .parquet or .pq: {path}")


def read_reach_tables(spark: SparkSession, meta_path: str, attributes_path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(meta_path), spark.read.parquet(attributes_path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.MEMBERS).parquet(path).withColumn("flow_cms", F.nanvl("flow_cms", F.lit(None).cast("double")))


def read_grid_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.GRID_MEMBERS).parquet(path).withColumn("flow_cms", F.nanvl("flow_cms", F.lit(None).cast("double")))


def read_threshold_grid(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, return_period, threshold)."""
    return spark.read.schema("lat double, lon double, return_period int, threshold double").parquet(path)


def read_stream_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON lines as (props, geometry), both JSON text; lines that don't parse are skipped."""
    feature = F.from_json("value", T.StructType().add("type", "string").add("properties", T.MapType(T.StringType(), T.StringType())))
    rows = spark.read.text(path).withColumn("f", feature).where(F.col("f.properties").isNotNull())
    return rows.select(F.get_json_object("value", "$.properties").alias("props"), F.get_json_object("value", "$.geometry").alias("geometry"))


def write_timeseries_artifact(df: DataFrame, path: str, if_present: str = "skip", expected_reaches: int | None = None) -> None:
    """JSON lines. skip keeps a present artifact, unless it has fewer rows than ``expected_reaches``."""
    mode = _mode(df.sparkSession, path, if_present, expected_reaches)
    df.select(*S.TIMESERIES.names).write.mode(mode).json(path)


def _mode(spark: SparkSession, path: str, if_present: str, expected_reaches: int | None) -> str:
    if if_present == "skip" and expected_reaches is not None and _present(spark, path) and spark.read.text(path).count() < expected_reaches:
        return "overwrite"
    return WRITE_MODES[if_present]


def write_counted_artifact(tagged: DataFrame, path: str, if_present: str = "overwrite", expected_reaches: int | None = None) -> dict[str, int] | None:
    """Write the rows of ``tagged`` without a ``reason`` as JSON lines, and give the counters of that same pass: records_seen, invalid_dropped,
    filtered_dropped ('unsupported') and written. None if a present artifact is kept."""
    spark = tagged.sparkSession
    mode = _mode(spark, path, if_present, expected_reaches)
    if mode == "ignore" and _present(spark, path):
        return None
    why, seen = F.col("reason"), Observation()
    unsupported = F.coalesce(why == "unsupported", F.lit(False))
    counted = tagged.observe(seen, F.count(F.lit(1)).alias("records_seen"), F.count_if(why.isNotNull() & ~unsupported).alias("invalid_dropped"), F.count_if(unsupported).alias("filtered_dropped"), F.count_if(why.isNull()).alias("written"))
    counted.where("reason is null").select(*S.TIMESERIES.names).write.mode(mode).json(path)
    return {"records_seen": 0, "invalid_dropped": 0, "filtered_dropped": 0, "written": 0} | observed(seen)


def observed(seen: Observation) -> dict[str, int]:
    """The metrics of a pass that has run; none if its input was known to be empty, as then no observing step is left in its plan."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return {}


def write_summary_artifact(df: DataFrame, path: str, if_present: str = "overwrite") -> None:
    """Zstandard Parquet, one folder for each (provider, run_id); only the runs in ``df`` are replaced."""
    rows = df.select(*(F.col(f.name).cast(f.dataType) for f in S.SUMMARY_ARTIFACT))
    writer = rows.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*S.RUN_KEYS)
    writer.mode(WRITE_MODES[if_present]).parquet(path)


def _present(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def artifact_stats(rows: DataFrame) -> DataFrame:
    """row_count, size_bytes and a signature of the files behind a DataFrame read from files."""
    files = rows.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at")).groupBy("p", "size", "at").agg(F.count("*").alias("n"))
    mark = F.xxhash64("p", "size", "n", F.unix_micros("at"))
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"), F.hex(F.bit_xor(mark)).alias("signature"))


def numbers(df: DataFrame, *names: str) -> DataFrame:
    """Columns through safe_double."""
    return df.withColumns({n: X.safe_double(n) for n in names})


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Where that is unset a local master (tests) gets a
    temporary folder; a cluster's executors wouldn't share it, so there it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-freshet-")
    return f"{top}/freshet-{name}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder, and read it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._freshet_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read any more."""
    for table in tables:
        drop_path(table.sparkSession, table._freshet_path)
