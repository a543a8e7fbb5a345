"""Ranked and ordered steps: latest runs, first steps, retention, the high-resolution member, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.operators.filters import filter_summaries

# Parts of a member label that mark the high-resolution member
HIGH_RES = ("high", "determin", "control", "member_0", "0")


def nearest_k(candidates: DataFrame, k: int, key: str = "reach_id", distance: str = "distance_km", ties: tuple[str, ...] = ("grid_lat", "grid_lon")) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.round(distance, 9), *ties))
    return candidates.withColumn("nth", nth).where(F.col("nth") <= k)


def latest_run(runs: DataFrame, with_data: DataFrame | None = None) -> DataFrame:
    """Newest run of each provider, of those in ``with_data`` if given; equal dates take the greater run id."""
    rows = runs if with_data is None else runs.join(with_data.select(*S.RUN_KEYS), S.RUN_KEYS, "left_semi")
    nth = F.row_number().over(W.partitionBy("provider").orderBy(F.desc("run_date_utc"), F.desc("run_id")))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def first_n_timesteps(ts: DataFrame, n: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(*S.REACH_KEYS).orderBy("forecast_time_utc"))
    return ts.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def runs_to_retire(runs: DataFrame, keep_latest: int) -> DataFrame:
    """All but the newest runs of each provider; none if keep_latest is below 1."""
    if keep_latest < 1:
        return runs.limit(0)
    nth = F.row_number().over(W.partitionBy("provider").orderBy(F.desc("run_date_utc"), F.desc("run_id")))
    return runs.withColumn("nth", nth).where(F.col("nth") > keep_latest).drop("nth")


def high_res_member(members: DataFrame, label: str = "member") -> DataFrame:
    """Rows of the high-resolution member with its flow: the first label that holds a mark, else the first label."""
    text = F.lower(F.col(label).cast("string"))
    marked = F.lit(False)
    for token in HIGH_RES:
        marked = marked | text.contains(token)
    pick = members.select(*S.RUN_KEYS, label).distinct().groupBy(*S.RUN_KEYS).agg(F.min_by(label, F.struct((~marked).alias("m"), label)).alias(label))
    return members.join(pick, [*S.RUN_KEYS, label]).select(*S.TIME_KEYS, F.col("flow_cms").alias("high_res_cms"))  # one row for each run


def worst_reaches(s: DataFrame, provider: str, run_id: str, flagged_only: bool = False, min_severity: int | None = None, limit: int | None = None) -> DataFrame:
    """Severity first, then reach id; limit None keeps all."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive, or None for all")
    rows = filter_summaries(s, provider, run_id, flagged_only, min_severity).orderBy(F.desc("severity_score"), "provider_reach_id")
    return rows if limit is None else rows.limit(limit)


def severity_map(s: DataFrame, provider: str, run_id: str, min_severity: int = 1, limit: int | None = None) -> DataFrame:
    return worst_reaches(s, provider, run_id, min_severity=min_severity, limit=limit).select("provider_reach_id", "severity_score")


def severity_map_pages(s: DataFrame, provider: str, run_id: str, min_severity: int = 1, page_reaches: int = 10_000) -> DataFrame:
    """The severity map as pages in order of reach: (range, page, first_reach, last_reach, scores: map of reach to score), with at most
    ``page_reaches`` entries each, so that no row holds all reaches. Of a reach's rows the highest score counts."""
    rows = filter_summaries(s, provider, run_id, False, min_severity).where("provider_reach_id is not null")
    one = rows.groupBy("provider_reach_id").agg(F.max("severity_score").alias("severity_score"))
    ranged = one.repartitionByRange("provider_reach_id").withColumn("range", F.spark_partition_id())
    nth = F.row_number().over(W.partitionBy("range").orderBy("provider_reach_id")) - 1
    paged = ranged.withColumn("page", F.floor(nth / page_reaches).cast("int"))
    entry = F.struct("provider_reach_id", "severity_score")
    ends = [F.min("provider_reach_id").alias("first_reach"), F.max("provider_reach_id").alias("last_reach")]
    return paged.groupBy("range", "page").agg(*ends, F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("scores"))


def merge_pages(pages: DataFrame) -> DataFrame:
    """(provider_reach_id, severity_score) of the pages of a severity map."""
    return pages.select(F.explode("scores").alias("provider_reach_id", "severity_score"))


def reach_timeseries(ts: DataFrame, provider: str, run_id: str, reach_id: str, limit: int) -> DataFrame:
    rows = ts.where((F.col("provider") == provider) & (F.col("run_id") == run_id) & (F.col("provider_reach_id") == reach_id))
    return rows.orderBy("forecast_time_utc").limit(limit)


def bounded_reaches(df: DataFrame, max_reaches: int, ordinal: str = "reach_ordinal") -> DataFrame:
    """Rows of the first reaches by their place in the source."""
    first = df.groupBy("provider_reach_id").agg(F.min(ordinal).alias("place")).orderBy("place", "provider_reach_id").limit(max_reaches)
    return df.join(first.select("provider_reach_id"), "provider_reach_id", "left_semi")


def supported_reach_ids(rp: DataFrame, provider: str) -> DataFrame:
    return rp.where(F.col("provider") == provider).select("provider_reach_id").distinct().orderBy("provider_reach_id")
