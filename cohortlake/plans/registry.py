"""Named queries of the core and their SQL; each query takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlake.operators import nested
from cohortlake.operators.imaging import mask_report
from cohortlake.plans import cohort_queries, model_queries, pipeline_queries, verdict_queries
from cohortlake.streaming import events

def region_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centre and pixels of each region's outline in the nested records."""
    from pyspark.sql import functions as F

    pts = nested.p3_points(spark, sf_dir).where("space = 'px'")
    # the points of one region, a number bounded by its record
    rings = pts.groupBy("record_id", "region_node").agg(F.array_sort(F.collect_list(F.struct("ordinal", "x", "y"))).alias("points"))
    return mask_report(rings, ["record_id", "region_node"])


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = cohort_queries.QUERIES | verdict_queries.QUERIES | pipeline_queries.QUERIES | model_queries.QUERIES | {
    "p3_found": nested.p3_found,
    "p3_points": nested.p3_points,
    "region_masks": region_masks,
    "event_windows": events.event_windows,
}
SQL: dict[str, str] = cohort_queries.SQL | verdict_queries.SQL | pipeline_queries.SQL | model_queries.SQL | {
    "event_windows": "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as begin, event_type, count(*) n, round(sum(value), 4) total from events where ts is not null group by 1, 2",
}
