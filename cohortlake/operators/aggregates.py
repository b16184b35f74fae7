"""Grouped summaries: burden scores, vessel aggregates, tiers, tables with margins, fractions and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import scoring as S
from cohortlake.operators.windows import null_safe_join, quantiles

QUARTILES = {"median": 0.5, "iqr_lower": 0.25, "iqr_upper": 0.75}


def burden(rois: DataFrame, thickness: DataFrame) -> DataFrame:
    """Score per patient and territory, wide with zeros, total and risk class.

    ``thickness``: pid, slice_thickness; patients without one, and regions without area, HU or
    territory, score nothing but keep their row. One shuffle on pid.
    """
    s = rois.join(thickness, "pid", "left").withColumn("s", F.coalesce(S.roi_score(F.col("area_cm2"), F.col("max_hu"), F.col("slice_thickness")), F.lit(0.0)))
    each = {t: F.coalesce(F.sum(F.when(F.col("territory") == t, F.col("s"))), F.lit(0.0)) for t in S.TERRITORIES}
    wide = s.groupBy("pid").agg(*[c.alias(t.lower()) for t, c in each.items()])
    total = sum((F.col(t.lower()) for t in S.TERRITORIES), F.lit(0.0))
    return wide.withColumn("total", total).withColumn("risk", S.risk_class(F.col("total")))


def vessel_aggregates(rois: DataFrame, thickness: DataFrame) -> DataFrame:
    """Per patient and territory: regions, area, volume and mass without an HU cut, area-weighted mean HU, max HU floored at 0."""
    j = rois.where("territory is not null").join(thickness, "pid", "left")
    area = F.coalesce(F.col("area_cm2"), F.lit(0.0)) * 100
    weighted = F.when(F.col("mean_hu").isNotNull(), area)
    return j.groupBy("pid", "territory").agg(
        F.count("*").alias("n_rois"),
        F.sum(area).alias("area_mm2"),
        F.sum(area * F.coalesce("slice_thickness", F.lit(0.0))).alias("volume_mm3"),
        F.sum(area * F.coalesce("slice_thickness", F.lit(0.0)) * F.coalesce("mean_hu", F.lit(0.0)) / 1000).alias("mass"),
        F.coalesce(F.try_divide(F.sum(weighted * F.col("mean_hu")), F.sum(weighted)), F.lit(0.0)).alias("mean_hu"),
        F.greatest(F.coalesce(F.max("max_hu"), F.lit(0.0)), F.lit(0.0)).alias("max_hu"),
    )


def tier_counts(rois: DataFrame, dense_hu: float = 1000.0) -> DataFrame:
    """Per patient and territory: regions per density tier, and those above ``dense_hu``."""
    tier = S.density_tier(F.col("max_hu"))
    return rois.where("territory is not null").groupBy("pid", "territory").agg(*[F.count_if(F.coalesce(tier == d, F.lit(False))).alias(d) for d in ("d1", "d2", "d3", "d4")], F.count_if(F.coalesce(F.col("max_hu") > dense_hu, F.lit(False))).alias("dense"))


def lesion_aggregate(members: DataFrame) -> DataFrame:
    """Lesions from their regions: ``members`` has pid, lesion, image_index, roi_idx, slice_idx, cx, cy, area_mm2, mean_hu, max_hu, slice_thickness.

    Area-weighted centre and HU, plain means where the lesion has no area; a lesion's regions are few.
    """
    a = F.coalesce("area_mm2", F.lit(0.0))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(a * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), a))), F.avg(c))
    return members.groupBy("pid", "lesion").agg(
        F.count("*").alias("n_rois"), mean("cx").alias("cx"), mean("cy").alias("cy"), F.sum(a).alias("area_mm2"), F.sum(a * F.col("slice_thickness")).alias("volume_mm3"), mean("mean_hu").alias("mean_hu"), F.max("max_hu").alias("max_hu"),
        F.sort_array(F.collect_list(F.struct("image_index", "roi_idx"))).alias("keys"), F.array_sort(F.collect_set("slice_idx")).alias("slices"),
    )


def profile(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Long table of n, n_used, n_nonzero, median and quartiles per group and column (linear percentiles)."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*by, "x.*")
    g = long.groupBy(*by, "feature").agg(F.count("*").alias("n"), F.count("value").alias("n_used"), F.count_if(F.coalesce(F.col("value") != 0, F.lit(False))).alias("n_nonzero"))
    return null_safe_join(g, quantiles(long, [*by, "feature"], "value", QUARTILES), [*by, "feature"], "left")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with one column per value, zero-filled; nulls are a row of their own."""
    return df.groupBy(row).agg(*[F.count_if(F.coalesce(F.col(column) == v, F.lit(False))).alias(str(v)) for v in values])


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-way counts with row, column and grand totals, named ``All``; nulls are named ``none``."""
    d = df.select(F.coalesce(F.col(a).cast("string"), F.lit("none")).alias(a), F.coalesce(F.col(b).cast("string"), F.lit("none")).alias(b))
    c = d.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("margin"))
    return c.select(F.coalesce(a, F.lit("All")).alias(a), F.coalesce(b, F.lit("All")).alias(b), F.col("n"), F.col("margin").cast("int").alias("margin"))


def fractions(df: DataFrame, by: str, label: str, labels: list) -> DataFrame:
    """Share of each label per group and the most frequent one (ties to the smallest)."""
    wide = crosstab(df, by, label, labels)
    total = sum((F.col(str(x)) for x in labels), F.lit(0))
    order = F.array_sort(F.array(*[F.struct((-F.col(str(x))).alias("k"), F.lit(str(x)).alias("label")) for x in labels]))
    return wide.select(by, *[F.coalesce(F.try_divide(F.col(str(x)).cast("double"), total), F.lit(0.0)).alias(f"f_{x}") for x in labels], F.when(total > 0, order[0]["label"]).alias("top"))


def category_table(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Per group: n, median, quartiles, and percentages of the closed score categories."""
    cat = S.score_category(F.col(score))
    share = lambda v: 100.0 * F.count_if(F.coalesce(cat == v, F.lit(False))) / F.count("*")
    g = df.groupBy(*by).agg(F.count("*").alias("n"), share("0").alias("pct_0"), share("1-99").alias("pct_1_99"), share("100-399").alias("pct_100_399"), share(">=400").alias("pct_400"))
    g = null_safe_join(g, quantiles(df, by, score, QUARTILES), by, "left")
    return g.select(*by, "n", "median", "iqr_lower", "iqr_upper", "pct_0", "pct_1_99", "pct_100_399", "pct_400")


def label_mapping(df: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """Which of two labels is ``low`` by the median of ``value``, then by the mean; equal in both stays null."""
    d = df.where(F.col(label).isNotNull())
    g = d.groupBy(*by, label).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    g = null_safe_join(g, quantiles(d, [*by, label], value, {"med": 0.5}), [*by, label])
    s = g.groupBy(*by).agg(F.count("*").alias("labels"), F.min(F.struct("med", "mean")).alias("lo"), F.max(F.struct("med", "mean")).alias("hi"), F.min_by(label, F.struct("med", "mean")).alias("low"), F.max_by(label, F.struct("med", "mean")).alias("high"), F.sum("n").alias("n"), F.min("n").alias("smallest"))
    clear = (F.col("labels") == 2) & (F.col("lo") < F.col("hi"))
    return s.select(*by, F.when(clear, F.col("low")).alias("low"), F.when(clear, F.col("high")).alias("high"), (F.col("smallest") / F.col("n")).alias("smallest_share"), ((F.col("labels") == 2) & (F.col("smallest") / F.col("n") > 0.15)).alias("balanced"))


def fingerprint(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """An order-free hash per group: sums and exclusive-ors of row hashes add up over partitions."""
    h = F.xxhash64(*columns)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("checksum"))


def audits(features: DataFrame, parts: list[str], total: str, tolerance: float = 0.11) -> DataFrame:
    """One row per audit (rows, repeated ids, null totals, totals that drift from their parts)."""
    drift = F.abs(F.col(total) - sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))) > tolerance
    one = features.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("pid")).alias("repeated_ids"), F.count_if(F.col(total).isNull()).alias("null_totals"), F.count_if(F.coalesce(drift, F.lit(False))).alias("drifting_totals"))
    return one.unpivot([], ["rows", "repeated_ids", "null_totals", "drifting_totals"], "audit", "n")


def pass_rates(df: DataFrame, by: list[str], passes: Column, dirty: Column) -> DataFrame:
    """Share and all-pass flag per group without dirty rows; a group of dirty rows only passes."""
    clean = F.when(~dirty, passes)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(dirty).alias("n_dirty"), F.coalesce(F.avg(clean.cast("double")), F.lit(1.0)).alias("pass_rate"), F.coalesce(F.bool_and(clean), F.lit(True)).alias("all_pass"))
