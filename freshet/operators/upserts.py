"""Keyed set operations: last row wins, upsert, replacement of runs, merged maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet import schemas as S


def last_wins(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row for each key, the one with the greatest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order.alias("o"), *(F.col(c) for c, t in df.dtypes if c in rest and not t.startswith("map")))).alias("r"))
    return rows.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns))


def perturbed_wins(ts: DataFrame, product: str = "product") -> DataFrame:
    """Of the control and perturbed rows of one (reach, time) the perturbed one stays."""
    return last_wins(ts, S.TIME_KEYS, F.when(F.col(product) == "pf", 1).otherwise(0))


def only_version(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key; rows that repeat are one, and rows of one key that differ fail the job."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"), F.max(F.struct(*rest)).alias("s"))
    error = F.raise_error(F.lit(f"rows of one key ({', '.join(keys)}) differ; give an order"))
    one = rows.select(*keys, F.when(F.col("r").eqNullSafe(F.col("s")), F.col("r")).otherwise(error).alias("r"))
    return one.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: Column | str | None = None) -> DataFrame:
    """Rows of ``target`` with those of ``updates`` in place of equal keys; twice is as once.

    Of several updates of one key the one with the greatest ``order`` counts; without an order, updates of one key that
    differ are an error. Null keys are equal to each other. For a table partitioned by run, pass only the touched
    partitions: see plans.write_upsert.
    """
    columns = [c for c in updates.columns if c in target.columns]
    new = only_version(updates.select(*columns), keys) if order is None else last_wins(updates, keys, order)
    new = new.select(*target.columns)
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return target.alias("t").join(new.select(*keys).alias("n"), same, "left_anti").select(*(F.col(f"t.{c}").alias(c) for c in target.columns)).unionByName(new)


def upsert_run(runs: DataFrame, discovered: DataFrame) -> DataFrame:
    """Upsert of discovered runs that keeps an earlier ingest_status other than 'pending', and earlier metadata."""
    old = runs.select(*S.RUN_KEYS, F.col("ingest_status").alias("old_status"), F.col("metadata_json").alias("old_meta"))
    status = F.coalesce(F.when(F.col("old_status") != "pending", F.col("old_status")), F.col("ingest_status"))
    kept = discovered.join(old, S.RUN_KEYS, "left").withColumn("ingest_status", status).withColumn("metadata_json", F.coalesce("old_meta", "metadata_json"))
    return upsert(runs, kept.select(*runs.columns), S.RUN_KEYS)


def replace_run(target: DataFrame, new: DataFrame, provider: str, run_id: str) -> DataFrame:
    return target.where(~((F.col("provider") == provider) & (F.col("run_id") == run_id))).unionByName(new)


def merge_severity(index: DataFrame, update: DataFrame) -> DataFrame:
    """The newer (provider_reach_id, severity_score) map over the older."""
    rows = index.withColumn("age", F.lit(0)).unionByName(update.withColumn("age", F.lit(1)))
    return last_wins(rows, ["provider_reach_id"], "age").drop("age")


def union_providers(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)
