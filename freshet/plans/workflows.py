"""The jobs users run: prepare, ingest, summarize, reclassify, import thresholds, build the crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet import schemas as S
from freshet.functions import scalars as X
from freshet.operators import aggregations as A
from freshet.operators import filters as L
from freshet.operators import joins as J
from freshet.operators import projections as P
from freshet.operators import upserts as U
from freshet.sources import tables as R


def prepare_timeseries(source: DataFrame, rp: DataFrame, provider: str, run_id: str | None = None, from_members: bool = False) -> DataFrame:
    """Normalized rows of supported reaches, from raw records or from members (restricted before they are reduced)."""
    if from_members:
        return L.drop_empty_stats(A.ensemble_stats(J.supported_only(source, rp, provider)))
    return J.supported_only(L.drop_empty_stats(P.normalize_timeseries(source, provider, run_id)), rp, provider)


def prepare_artifact(source: DataFrame, rp: DataFrame, provider: str, path: str, run_id: str | None = None, if_present: str = "skip", expected_reaches: int | None = None) -> dict[str, int] | None:
    """The whole preparation of raw records: normalized, checked, restricted to supported reaches and written to ``path``, with the
    counters of the pass that writes. None if a present artifact is kept.

    A row without id, time or any flow is invalid; then an unsupported reach is filtered."""
    rows = P.normalize_timeseries(source, provider, run_id, tag=True)
    known = rp.where(F.col("provider") == provider).select(F.trim("provider_reach_id").alias("provider_reach_id"), F.lit(True).alias("known")).distinct()
    empty = F.coalesce(*S.FLOWS).isNull()
    reason = F.coalesce("reason", F.when(empty, "empty"), F.when(F.col("known").isNull(), "unsupported"))
    return R.write_counted_artifact(rows.join(known, "provider_reach_id", "left").withColumn("reason", reason), path, if_present, expected_reaches)


def classified(summaries: DataFrame, rp: DataFrame, peak: str = "peak_mean_cms") -> DataFrame:
    """Summaries with band, score and flag by their peak mean and the current ladders."""
    columns = [c for c in summaries.columns if c not in ("return_period_band", "severity_score", "is_flagged")]
    rows = J.attach_thresholds(summaries.select(*columns), rp).withColumn("c", X.classify(peak))
    return rows.select(*columns, "c.return_period_band", "c.severity_score", "c.is_flagged")


def prepare_summaries(members: DataFrame, rp: DataFrame, provider: str | None = None) -> DataFrame:
    """Members to one classified summary per (run, reach) of the supported reaches."""
    ts = A.ensemble_stats(J.supported_only(members, rp, provider))
    return classified(A.bulk_summary(ts), rp)


def reclassify(summaries: DataFrame, rp: DataFrame, skip: bool = False) -> DataFrame:
    return summaries if skip else classified(summaries, rp).select(*summaries.columns)


def ingest_summaries(artifact: DataFrame, rp: DataFrame, target: DataFrame, replace: bool = False, skip_reclassify: bool = False) -> DataFrame:
    """The target table after an artifact's rows are classified anew and upserted, or replace their runs."""
    rows = reclassify(artifact, rp, skip_reclassify)
    for field in target.schema:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    rows = rows.select(*target.columns)
    if not replace:
        return U.upsert(target, rows, S.REACH_KEYS)
    return target.join(rows.select(*S.RUN_KEYS).distinct(), S.RUN_KEYS, "left_anti").unionByName(U.only_version(rows, S.REACH_KEYS))


def ingest_timeseries(artifact: DataFrame, rp: DataFrame, target: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """The target after an upsert of supported rows, and (provider, run_id, rows, ingest_status) of the runs."""
    if rp.where(F.col("provider") == provider).limit(1).count() == 0:
        raise ValueError(f"no supported reaches for {provider}")
    rows = J.supported_only(artifact, rp, provider)
    merged = U.upsert(target, rows.select(*target.columns), S.TIME_KEYS)
    runs = artifact.select(*S.RUN_KEYS).distinct().join(rows.groupBy(*S.RUN_KEYS).agg(F.count("*").alias("rows")), S.RUN_KEYS, "left")
    done = F.coalesce("rows", F.lit(0).cast("bigint"))
    return merged, runs.select(*S.RUN_KEYS, done.alias("rows"), F.when(done > 0, "complete").otherwise("partial").alias("ingest_status"))


def ingest_counted(artifact: DataFrame, rp: DataFrame, target: DataFrame, provider: str, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`ingest_timeseries`, with the counts by reach after the batch: those before it and what the batch adds to its runs."""
    merged, runs = ingest_timeseries(artifact, rp, target, provider)
    return merged, runs, A.merge_counts(counts, A.timeseries_delta(target, J.supported_only(artifact, rp, provider)))


def write_enriched_streams(features: DataFrame, model: DataFrame, path: str, order: str | None = None, mode: str = "overwrite") -> dict[str, int]:
    """Enriched streams as Parquet, and processed, written, missing_id and missing_attributes counted in the pass that writes; an error if there
    was nothing to write."""
    read, done = Observation(), Observation()
    rows = J.enrich_streams(features.observe(read, F.count(F.lit(1)).alias("processed")), model, order)
    rows = rows.observe(done, F.count(F.lit(1)).alias("written"), F.count_if(~F.col("has_model")).alias("missing_attributes"))
    rows.write.mode(mode).option("compression", "zstd").parquet(path)
    processed, found = R.observed(read).get("processed", 0), R.observed(done)
    written = found.get("written", 0)
    if not written:
        raise ValueError("no stream was written")
    return {"processed": processed, "written": written, "missing_id": processed - written, "missing_attributes": found["missing_attributes"]}


def summarize_run(ts: DataFrame, rp: DataFrame, target: DataFrame, policy: str = "mean_first", reaches: DataFrame | None = None) -> DataFrame:
    """The summaries table after full summaries of the timeseries' reaches (or the given ones) are upserted."""
    rows = A.reach_summary(ts, rp, policy, reaches)
    for field in target.schema:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, X.payload_json(points=F.col("points")) if field.name == "metadata_json" else F.lit(None).cast(field.dataType))
    return U.upsert(target, rows.select(*target.columns), S.REACH_KEYS)


def import_thresholds(target: DataFrame, provider: str, table: DataFrame | None = None, long: DataFrame | None = None, reach_rows: DataFrame | None = None, method: str = "gumbel", require_all: bool = True) -> DataFrame:
    """The ladders after a guarded import from exactly one source: a wide table, a long one, or rows made for reaches
    from grids or history (see operators.joins and operators.thresholds)."""
    if sum(x is not None for x in (table, long, reach_rows)) != 1:
        raise ValueError("give exactly one source of thresholds")
    rows = P.resolve_ladder(table, provider) if table is not None else A.pivot_ladder(long, provider, method) if long is not None else reach_rows
    for field in target.schema:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return U.upsert(target, L.sanitize_ladder(rows, require_all).select(*target.columns), ["provider", "provider_reach_id"])


def build_crosswalk(reaches: DataFrame, cells: DataFrame, target_provider: str, k: int = 16, max_area_ratio: float = 10.0, area_weight: float = 20.0, max_km: float = 20.0) -> DataFrame:
    """Best grid cell for each reach; reaches and cells as valid_reaches and river_cells give them."""
    return J.score_crosswalk(reaches, J.knn_candidates(reaches, cells, k, max_km), target_provider, max_area_ratio, area_weight, max_km)


def crosswalk_inputs(meta: DataFrame, attributes: DataFrame, areas: DataFrame, rp_2: DataFrame, key: str = "LINKNO", area: str = "DSContArea", min_cms: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Usable reaches and river cells of the raw tables: metadata and attributes by reach, drained areas and 2-year flows by cell."""
    reaches = J.join_reach_attributes(meta, attributes, key)
    return L.valid_reaches(reaches, area), L.river_cells(areas, rp_2, min_cms)


def refresh_crosswalk(old: DataFrame, reaches: DataFrame, cells: DataFrame, target_provider: str, before: tuple[DataFrame, DataFrame] | None = None, **options: float) -> tuple[DataFrame, DataFrame]:
    """The crosswalk table after an upsert of the reaches whose match may have changed, and its report.

    before: the (reaches, cells) that ``old`` was built from; without them all reaches are matched. A reach is matched again if it is new or
    differs, or if a cell that is new, gone or different lies in one of the 3 x 3 tiles around its own, a little over
    ``max_km`` wide; reaches that are gone leave the table. Other targets' rows stay. The table is that of a full run.
    """
    due = reaches
    if before is not None:
        old_reaches, old_cells = before
        same = [c for c in reaches.columns if c in old_reaches.columns]
        changed = reaches.select(*same).exceptAll(old_reaches.select(*same)).select("reach_id")
        columns = [c for c in cells.columns if c in old_cells.columns]
        moved = cells.select(*columns).exceptAll(old_cells.select(*columns)).unionByName(old_cells.select(*columns).exceptAll(cells.select(*columns)))
        size = J.degrees(options.get("max_km", 20.0)) * 1.0001
        tile = lambda c: F.floor(F.col(c) / size).cast("bigint")
        around = lambda: F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        marked = moved.select(tile("grid_lat").alias("ty"), tile("grid_lon").alias("tx")).distinct().withColumn("dy", around()).withColumn("dx", around())
        marked = marked.select((F.col("ty") + F.col("dy")).alias("ty"), (F.col("tx") + F.col("dx")).alias("tx")).distinct()
        near = reaches.select("reach_id", tile("lat").alias("ty"), tile("lon").alias("tx")).join(marked, ["ty", "tx"], "left_semi").select("reach_id")
        due = reaches.join(changed.unionByName(near).distinct(), "reach_id", "left_semi")
    rows = build_crosswalk(due, cells, target_provider, **options)
    other = F.col("target_provider") != target_provider
    kept = old.where(other).unionByName(old.where(~other).join(reaches.select("reach_id"), "reach_id", "left_semi").select(*old.columns))
    table = R.write_scratch(U.upsert(kept, rows.select(*old.columns), ["reach_id", "target_provider"]), "crosswalk")
    return table, A.crosswalk_report(table.where(F.col("target_provider") == target_provider))


def import_grid_thresholds(target: DataFrame, provider: str, crosswalk: DataFrame, grid: DataFrame, axes: tuple[tuple[float, float, int], tuple[float, float, int]] | None = None, tolerance: float = 0.06, require_all: bool = False) -> DataFrame:
    """The ladders after a guarded import from a grid for the valid matches of a crosswalk: a long grid (lat, lon, return_period, threshold) on
    regular ``axes`` gives each reach its snapped cell's ladder; a wide one (lat, lon, rung columns) the cell equal at 4 decimals
    or the nearest within ``tolerance``."""
    matched = L.valid_crosswalk(crosswalk, provider).select("reach_id", "grid_lat", "grid_lon")
    if axes is not None:
        rows = J.threshold_grid_to_reaches(matched, grid, *axes, provider)
    else:
        found = J.thresholds_for_reaches(matched, grid.select("lat", "lon", *(c for c in grid.columns if c in S.RUNGS)))
        value = lambda r: F.when(X.finite(r) & (F.col(r) > 0), F.col(r)) if r in found.columns else F.lit(None).cast("double")
        rows = found.select(F.lit(provider).alias("provider"), F.col("reach_id").alias("provider_reach_id"), *(value(r).alias(r) for r in S.RUNGS))
    return import_thresholds(target, provider, reach_rows=rows, require_all=require_all)


def hydrograph_series(ts: DataFrame, rp: DataFrame) -> DataFrame:
    """Long (reach, series, time, value): quartiles where both occur, the maximum where any does, the mean, and a
    constant line for each rung. ``ts`` is read once: flags come from a window over each reach, all series from one explode."""
    whole = W.partitionBy(*S.REACH_KEYS)
    some = lambda c: F.max(F.col(c).isNotNull()).over(whole)
    base = ts.select(*S.TIME_KEYS, *S.FLOWS).withColumns({"spread": some("flow_p75_cms") & some("flow_p25_cms"), "top": some("flow_max_cms")})
    ladders = rp.select("provider", "provider_reach_id", F.struct(*S.RUNGS).alias("rungs"))
    both = base.join(ladders, ["provider", "provider_reach_id"], "left")
    one = lambda name, value, shown: F.when(shown, F.struct(F.lit(name).alias("series"), value.alias("value")))
    lines = [one("flow_mean_cms", F.col("flow_mean_cms"), F.lit(True)), one("flow_p25_cms", F.col("flow_p25_cms"), F.col("spread")), one("flow_p75_cms", F.col("flow_p75_cms"), F.col("spread")), one("flow_max_cms", F.col("flow_max_cms"), F.col("top"))]
    lines += [one(r, F.col("rungs").getField(r), F.col("rungs").getField(r).isNotNull()) for r in S.RUNGS]
    return both.select(*S.TIME_KEYS, F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("line")).select(*S.TIME_KEYS, "line.series", "line.value")


def write_upsert(target_path: str, updates: DataFrame, keys: list[str], scratch_path: str) -> None:
    """Upsert into a Parquet table partitioned by (provider, run_id); only touched partitions are read and rewritten.

    The merged partitions are staged in ``scratch_path`` first, as a table can't be overwritten while it is read.
    """
    spark = updates.sparkSession
    target = spark.read.schema(updates.schema).parquet(target_path)
    touched = target.join(updates.select(*S.RUN_KEYS).distinct(), S.RUN_KEYS, "left_semi")
    U.upsert(touched, updates, keys).write.mode("overwrite").parquet(scratch_path)
    staged = spark.read.schema(updates.schema).parquet(scratch_path)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*S.RUN_KEYS).parquet(target_path)
