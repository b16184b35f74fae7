"""Percentiles of very large numeric columns: exact bisection over counts that parts can add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.session import Scratch, table

#: Bisection steps taken in one pass: 2**STEPS - 1 midpoints are counted at once.
STEPS = 6


def pass_counts(part: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over one part: for each target's interval, rows and extremes in each of its cells.

    ``part`` has keys and value; ``intervals`` has keys, target, low, high. The result of several parts
    (partitions, days) adds up: counts by sum, extremes by min and max.
    """
    cells = 2**STEPS
    j = part.join(intervals, keys).where("value >= low and value <= high")
    # low and high fall into different cells, so each pass narrows; quarters keep the range finite
    inf = F.lit(float("inf"))
    at = (F.col("value") / 4 - F.col("low") / 4) / F.nullif(F.col("high") / 4 - F.col("low") / 4, F.lit(0.0))
    cell = F.when((F.col("low") == -inf) | (F.col("high") == inf), F.when(F.col("value") == -inf, 0).when(F.col("value") == inf, 2).otherwise(1))
    cell = cell.when(F.col("value") >= F.col("high"), cells - 1).otherwise(F.least(F.lit(cells - 2), F.floor(at * cells))).cast("int")
    return j.groupBy(*keys, "target", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def combine(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Add up the counts of several parts."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*keys, "target", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def sizes(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, n, low, high) over all parts; nulls and NaN do not count."""
    each = [p.where("value is not null and not isnan(value)").groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")) for p in parts]
    both = reduce(DataFrame.unionByName, each)
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def ranked(parts: list[DataFrame], targets: DataFrame, keys: list[str], scratch: Scratch | None = None) -> DataFrame:
    """The value at each target rank of each group, by bisection.

    ``parts``: tables of keys and value (DOUBLE) whose rows together are the column. ``targets``: keys,
    target (a name), rank (BIGINT, from 1). Each target keeps an interval of values that holds its
    rank. A pass counts rows below 63 midpoints, which are six halvings at once, and narrows the
    interval to the extremes of the one cell that holds the rank, until these are equal. The answer is
    an exact order statistic. A rank outside 1..n, or a group without values, gives null. Null keys
    are groups of their own only if the caller names them; here they match nothing.

    Counts are aggregated map-side, so a group with a third of all rows costs no more than others.
    """
    spark = parts[0].sparkSession
    scratch = scratch or Scratch(spark, "percentiles")
    parts = [scratch.save(p.select(*keys, F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)"), "part") for p in parts]
    whole = sizes(parts, keys)
    state = targets.join(whole, keys, "left").withColumn("open", (F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
    state = state.select(*keys, "target", "rank", F.when(F.col("open"), F.col("low")).alias("low"), F.when(F.col("open"), F.col("high")).alias("high"), F.lit(0).cast("long").alias("below"))
    state = scratch.save(state, "state")
    while True:
        live = state.where("low < high")
        if live.isEmpty():
            break
        counts = combine([pass_counts(p, live.select(*keys, "target", "low", "high"), keys) for p in parts], keys)
        # a target has at most 64 cells, so this array is bounded
        cells = counts.groupBy(*keys, "target").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "least", "most"))).alias("cells"))
        j = live.join(cells, [*keys, "target"])
        start = F.struct(F.col("below").alias("seen"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
        step = lambda acc, c: F.when(acc["b"].isNotNull(), acc).when(acc["seen"] + c["n"] >= F.col("rank"), F.struct(acc["seen"].alias("seen"), c["least"].alias("a"), c["most"].alias("b"))).otherwise(F.struct((acc["seen"] + c["n"]).alias("seen"), acc["a"].alias("a"), acc["b"].alias("b")))
        j = j.withColumn("hit", F.aggregate("cells", start, step)).select(*keys, "target", "rank", F.col("hit.a").alias("low"), F.col("hit.b").alias("high"), F.col("hit.seen").alias("below"))
        old, state = state, scratch.save(state.where("low is null or low = high").unionByName(j), "state")
        scratch.drop(old)
    return state.select(*keys, "target", F.col("low").alias("value"))


def percentiles(parts: list[DataFrame], keys: list[str], qs: dict[str, float], scratch: Scratch | None = None) -> DataFrame:
    """Lower percentiles (smallest value with at least q of the group's values at or below it), wide."""
    scratch = scratch or Scratch(parts[0].sparkSession, "percentiles")
    whole = scratch.save(sizes([p.select(*keys, F.col("value").cast("double").alias("value")) for p in parts], keys), "sizes")
    targets = whole.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("target"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - 1e-9)).cast("long").alias("rank")) for name, q in qs.items()])).alias("t")).select(*keys, "t.*")
    long = ranked(parts, targets, keys, scratch)
    wide = long.groupBy(*keys).pivot("target", list(qs)).agg(F.first("value"))
    return whole.select(*keys, "n").join(wide, keys)


def outside(parts: list[DataFrame], published: DataFrame, keys: list[str], qs: dict[str, float], slack: float = 0.08) -> DataFrame:
    """Rows of ``published`` (keys and a column per percentile) with a value outside its band of ranks.

    A value v is wrong for q if fewer than q - slack of the values are <= v or fewer than 1 - q - slack
    are >= v; so v must lie between two order statistics, which bisection finds. A null value is not
    judged, NaN is wrong, and groups without values are not judged.
    """
    scratch = Scratch(published.sparkSession, "percentiles")
    whole = scratch.save(sizes([p.select(*keys, F.col("value").cast("double").alias("value")) for p in parts], keys), "sizes")
    n, rows = F.col("n"), []
    for name, q in qs.items():
        rows.append(F.struct(F.lit(f"{name}_lo").alias("target"), F.ceil(F.lit(round(q - slack, 6)) * n - 1e-6).cast("long").alias("rank")))
        rows.append(F.struct(F.lit(f"{name}_hi").alias("target"), (n + 1 - F.ceil(F.lit(round(1 - q - slack, 6)) * n - 1e-6)).cast("long").alias("rank")))
    # only the groups that are published are searched
    asked = published.select(*keys).distinct()
    targets = whole.join(asked, keys, "left_semi").select(*keys, F.explode(F.array(*rows)).alias("t")).select(*keys, "t.*")
    bounds = ranked(parts, targets, keys, scratch).groupBy(*keys).pivot("target", [f"{name}_{s}" for name in qs for s in ("lo", "hi")]).agg(F.first("value"))
    j = published.join(bounds, keys)
    bad = F.lit(False)
    for name in qs:
        bad = bad | F.coalesce(F.col(name) < F.col(f"{name}_lo"), F.lit(False)) | F.coalesce(F.col(name) > F.col(f"{name}_hi"), F.lit(False))
    return j.where(bad).select(*keys).distinct()


def focal_burden(features: DataFrame) -> DataFrame:
    """(cohort, value): agatston_total of each patient's latest scoring where it is focal."""
    f = features.where("pid is not null").select("pid", "scored_ts", "cohort", "phenotype", "agatston_total")
    last = f.groupBy("pid").agg(F.max(F.struct("scored_ts", "phenotype", "cohort", "agatston_total")).alias("r")).select("r.*")
    return last.where("phenotype = 'focal' and cohort is not null").select("cohort", F.col("agatston_total").alias("value"))


def lesion_volumes(lesions: DataFrame) -> DataFrame:
    """(cohort, vessel, value): volume_mm3 of each distinct lesion; redelivered rows count once."""
    one = lesions.where("lesion_id is not null").groupBy("lesion_id").agg(F.max(F.struct("recorded_ts", "cohort", "vessel", "volume_mm3")).alias("r")).select("r.*")
    return one.where("cohort is not null and vessel is not null").select("cohort", "vessel", F.col("volume_mm3").alias("value"))


_BURDEN = {"focal_median_agatston": 0.5, "focal_iqr_lower": 0.25, "focal_iqr_upper": 0.75}
_VOLUME = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def p6_found(spark, sf_dir: str) -> DataFrame:
    burden = outside([focal_burden(table(spark, sf_dir, "features"))], table(spark, sf_dir, "burden_orthogonality").select("cohort", *_BURDEN), ["cohort"], _BURDEN)
    volume = outside([lesion_volumes(table(spark, sf_dir, "lesions"))], table(spark, sf_dir, "volume_quantiles").select("cohort", "vessel", *_VOLUME), ["cohort", "vessel"], _VOLUME)
    return burden.select("cohort", F.lit("ALL").alias("vessel")).unionByName(volume.select("cohort", "vessel"))


def p6_percentiles(spark, sf_dir: str) -> DataFrame:
    """Exact percentiles of lesion volume per cohort and vessel, and of focal burden per cohort (vessel ``ALL``).

    Volumes come in a part per year of recording (lesions without a time in one of their own), the burden
    in one more; what each part counts is added up.
    """
    les = table(spark, sf_dir, "lesions").where("lesion_id is not null")
    one = les.groupBy("lesion_id").agg(F.max(F.struct("recorded_ts", "cohort", "vessel", "volume_mm3")).alias("r")).select("r.*")
    one = Scratch(spark, "volumes").save(one.where("cohort is not null and vessel is not null").select(F.year("recorded_ts").alias("year"), "cohort", "vessel", F.col("volume_mm3").alias("value")), "volumes")
    years = [r.year for r in one.select("year").distinct().orderBy("year").collect()]  # one row per calendar year
    parts = [one.where(F.col("year").eqNullSafe(y)).drop("year") for y in years]
    parts.append(focal_burden(table(spark, sf_dir, "features")).select("cohort", F.lit("ALL").alias("vessel"), "value"))
    return percentiles(parts, ["cohort", "vessel"], _VOLUME | {"p25": 0.25, "p75": 0.75})
