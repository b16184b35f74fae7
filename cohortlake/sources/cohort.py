"""The pipeline's tables, cleaned once: the last delivery of each key, NaN as null, one spelling per kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.functions.scoring import kernel_key
from cohortlake.session import nan_to_null, table


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-null key: the one with the greatest ``order`` (nulls last)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with territory (of the vessel code) and flat centre; vessel and territory null if not normalised."""
    r = latest(table(spark, sf_dir, "rois"), "roi_id", "recorded_ts")
    r = nan_to_null(r, "area_cm2", "mean_hu", "max_hu", "min_hu", "total_hu", "z_mm")
    ref = table(spark, sf_dir, "vessel_ref").select(F.col("vessel_code").alias("vessel"), "territory")
    r = r.withColumns({"cx": F.col("centroid_xy_mm.x"), "cy": F.col("centroid_xy_mm.y")}).drop("centroid_xy_mm")
    return r.join(ref, "vessel", "left")


def lesions(spark: SparkSession, sf_dir: str) -> DataFrame:
    les = latest(table(spark, sf_dir, "lesions"), "lesion_id", "recorded_ts")
    return nan_to_null(les, "centroid_x_mm", "centroid_y_mm", "total_area_mm2", "volume_mm3", "mean_hu_weighted", "max_hu")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = latest(table(spark, sf_dir, "features"), "pid", "scored_ts")
    return nan_to_null(f, "max_hu_global", "agatston_lad", "agatston_rca", "agatston_lcx", "agatston_lm", "agatston_total").withColumn("kernel", kernel_key(F.col("kernel")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifest").withColumn("pid", F.trim("pid"))
    m = latest(m.where("pid <> ''"), "pid", "ingested_ts")
    return nan_to_null(m, "slice_thickness").withColumn("kernel", kernel_key(F.col("kernel")))


#: The same tables for SQL.
SQL_TABLES = r"""
r as (select r.*, v.territory, r.centroid_xy_mm.x cx, r.centroid_xy_mm.y cy from (
    select * exclude (area_cm2, mean_hu, max_hu, min_hu, z_mm), case when not isnan(area_cm2) then area_cm2 end area_cm2, case when not isnan(mean_hu) then mean_hu end mean_hu,
      case when not isnan(max_hu) then max_hu end max_hu, case when not isnan(min_hu) then min_hu end min_hu, case when not isnan(z_mm) then z_mm end z_mm
    from rois where roi_id is not null qualify row_number() over (partition by roi_id order by recorded_ts desc nulls last) = 1) r
  left join vessel_ref v on r.vessel = v.vessel_code),
l as (select * exclude (volume_mm3, mean_hu_weighted, max_hu, total_area_mm2, centroid_x_mm, centroid_y_mm), case when not isnan(volume_mm3) then volume_mm3 end volume_mm3,
    case when not isnan(mean_hu_weighted) then mean_hu_weighted end mean_hu_weighted, case when not isnan(max_hu) then max_hu end max_hu, case when not isnan(total_area_mm2) then total_area_mm2 end total_area_mm2,
    case when not isnan(centroid_x_mm) then centroid_x_mm end centroid_x_mm, case when not isnan(centroid_y_mm) then centroid_y_mm end centroid_y_mm
  from lesions where lesion_id is not null qualify row_number() over (partition by lesion_id order by recorded_ts desc nulls last) = 1),
f as (select * exclude (kernel, max_hu_global, agatston_lad, agatston_rca, agatston_lcx, agatston_lm, agatston_total), coalesce(nullif(regexp_replace(regexp_replace(lower(trim(regexp_replace(kernel, '[\[\]''"]', '', 'g'))), '\s*[\\,/]\s*', '/', 'g'), '\s+', '', 'g'), ''), 'none') kernel,
    case when not isnan(max_hu_global) then max_hu_global end max_hu_global, case when not isnan(agatston_lad) then agatston_lad end agatston_lad, case when not isnan(agatston_rca) then agatston_rca end agatston_rca,
    case when not isnan(agatston_lcx) then agatston_lcx end agatston_lcx, case when not isnan(agatston_lm) then agatston_lm end agatston_lm, case when not isnan(agatston_total) then agatston_total end agatston_total
  from features where pid is not null qualify row_number() over (partition by pid order by scored_ts desc nulls last) = 1),
m as (select * exclude (pid, kernel, slice_thickness), trim(pid) pid, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(regexp_replace(kernel, '[\[\]''"]', '', 'g'))), '\s*[\\,/]\s*', '/', 'g'), '\s+', '', 'g'), ''), 'none') kernel,
    case when not isnan(slice_thickness) then slice_thickness end slice_thickness
  from manifest where trim(pid) <> '' qualify row_number() over (partition by trim(pid) order by ingested_ts desc nulls last) = 1)
"""
