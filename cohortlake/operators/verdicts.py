"""Profiles of clusters against the rest, consistency over runs, and the rules that turn statistics into verdicts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import scoring as S
from cohortlake.functions import tails
from cohortlake.operators import statistics as T
from cohortlake.operators.aggregates import QUARTILES
from cohortlake.operators.windows import average_rank, null_safe_join, quantiles


def one_vs_rest(long: DataFrame, cluster: str, least: int = 5) -> DataFrame:
    """Per cluster and feature of a long table (cluster, feature, value): counts, quartiles, and the contrast with all other rows.

    Ranks are taken once per feature, so the work does not grow with the clusters. ``cliffs_delta`` and
    ``z`` (tie- and continuity-corrected) are null, and ``insufficient`` true, where the cluster or the
    rest has under ``least`` values. Rows without cluster are in no cluster and not in the rest.
    """
    d = long.where(F.col(cluster).isNotNull())
    g = d.groupBy(cluster, "feature").agg(F.count("*").alias("n"), F.count("value").alias("n_used"), F.count_if(F.coalesce(F.col("value") != 0, F.lit(False))).alias("n_nonzero"))
    g = g.join(quantiles(d, [cluster, "feature"], "value", QUARTILES), [cluster, "feature"])
    r = average_rank(d, ["feature"], "value", "_rank")
    per = r.groupBy(cluster, "feature").agg(F.sum("_rank").alias("_r"))
    whole = r.groupBy("feature").agg(F.count("*").cast("double").alias("_all"), F.sum((F.col("_rank_ties") ** 2 - 1).cast("double")).alias("_ties"))
    j = g.join(per, [cluster, "feature"], "left").join(whole, "feature", "left")
    a = F.col("n_used").cast("double")
    b = F.col("_all") - a
    u = F.col("_r") - a * (a + 1) / 2
    var = a * b / 12 * ((F.col("_all") + 1) - F.col("_ties") / F.nullif(F.col("_all") * (F.col("_all") - 1), F.lit(0.0)))
    off = u - a * b / 2
    z = F.when(var <= 0, 0.0).otherwise(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / F.sqrt(F.greatest(var, F.lit(1e-300))))
    enough = F.coalesce((a >= least) & (b >= least), F.lit(False))
    return j.select(cluster, "feature", "n", "n_used", "n_nonzero", *QUARTILES, F.when(enough, 2 * u / F.nullif(a * b, F.lit(0.0)) - 1).alias("cliffs_delta"), F.when(enough, z).alias("z"), (~enough).alias("insufficient"))


def consistency_rules(runs: DataFrame, keys: list[str], run: str, names: list[str], alpha: float = 0.05, least_delta: float = 0.2) -> DataFrame:
    """Three rules per key over named runs: ``runs`` has keys, run, delta, fdr.

    One non-zero sign of delta in all runs; fdr below ``alpha`` in two at least; an absolute delta of
    ``least_delta`` in all. A run that is missing or has no number fails; robust is all three.
    """
    wide = runs.where(F.col(run).isin(*names)).groupBy(*keys).agg(*[F.max(F.when(F.col(run) == n, F.struct("delta", "fdr"))).alias(n) for n in names])
    deltas = [F.col(f"{n}.delta") for n in names]
    every = lambda tests: F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False))
    sign = every([(F.signum(c) == F.signum(deltas[0])) & (c != 0) for c in deltas])
    hits = reduce(lambda x, y: x + y, [F.coalesce(F.col(f"{n}.fdr") < alpha, F.lit(False)).cast("int") for n in names])
    size = every([F.abs(c) >= least_delta for c in deltas])
    out = wide.select(*keys, *[c.alias(f"delta_{n}") for n, c in zip(names, deltas)], sign.alias("same_sign"), (hits >= 2).alias("significant"), size.alias("large"))
    return out.withColumn("robust", F.col("same_sign") & F.col("significant") & F.col("large"))


def rule_counts(rules: DataFrame, by: list[str]) -> DataFrame:
    """Rows and how many of them pass each rule, per group."""
    return rules.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in ("same_sign", "significant", "large", "robust")])


def monotonicity(df: DataFrame, columns: list[str], burden: str, other: str) -> DataFrame:
    """(feature, n, rho_burden, rho_other, axis): rank correlations of each column with two axes, and which dominates.

    Under five pairs a correlation is null, and null counts as neither, which gives mixed.
    """
    long = T.long_form(df, [burden, other], columns)
    a = T.spearman(long, ["feature"], "value", burden).select("feature", "n", F.col("rho").alias("rho_burden"))
    b = T.spearman(long, ["feature"], "value", other).select("feature", F.col("rho").alias("rho_other"))
    j = a.join(b, "feature", "full")
    return j.withColumn("axis", S.axis_class(F.col("rho_burden"), F.col("rho_other")))


def class_counts(df: DataFrame, by: list[str], label: str, labels: list[str]) -> DataFrame:
    """A column of counts per label, zero where there is none, and their total."""
    return df.groupBy(*by).agg(*[F.count_if(F.coalesce(F.col(label) == x, F.lit(False))).alias(x) for x in labels], F.count("*").alias("total"))


def orthogonality(df: DataFrame, by: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Location (rank test) and spread (Brown-Forsythe) of two groups, Cliff's delta, and the class that both p-values give."""
    two = df.where(F.col(group).isin(a, b))
    loc = T.with_normal_p(T.rank_contrast(two, by, group, a, b, value), out="location_p").select(*by, "n_a", "n_b", "cliffs_delta", "location_p")
    spread = T.with_f_p(T.brown_forsythe(two, by, group, value)).select(*by, "f", F.col("p").alias("spread_p"))
    return null_safe_join(loc, spread, by, "left").withColumn("class", S.orthogonality_class(F.col("location_p"), F.col("spread_p")))


def gate(df: DataFrame, by: list[str], label: str, case: str, value: str, least: float, low_ratio: float = 0.5, least_share: float = 0.15) -> DataFrame:
    """Per group: median of the case's values and whether it reaches ``least``; a warning where it is under ``low_ratio`` of the others'; balance of the classes."""
    d = df.where(F.col(label).isNotNull())
    med = quantiles(d, [*by, label], value, {"m": 0.5})
    n = d.groupBy(*by, label).agg(F.count("*").alias("n"))
    g = null_safe_join(n, med, [*by, label]).groupBy(*by).agg(F.max(F.when(F.col(label) == case, F.col("m"))).alias("case_median"), F.max(F.when(F.col(label) != case, F.col("m"))).alias("other_median"), (F.min("n") / F.sum("n")).alias("smallest_share"), F.count("*").alias("classes"))
    known = lambda c: F.coalesce(c, F.lit(False))
    return g.select(*by, "case_median", "other_median", "smallest_share", known(F.col("case_median") >= least).alias("passes"), known(F.col("case_median") < low_ratio * F.col("other_median")).alias("warns"), ((F.col("classes") > 1) & (F.col("smallest_share") > least_share)).alias("balanced"))


def canonical_labels(df: DataFrame, mapping: DataFrame, by: list[str], label: str, low: str, high: str) -> DataFrame:
    """``df`` with ``canonical`` (``low`` or ``high`` by the mapping's low and high columns) and ``code`` 0 or 1.

    A label that is canonical already stays, so doing it twice changes nothing; others, and groups whose
    mapping is not clear, give null.
    """
    j = null_safe_join(df, mapping.select(*by, F.col("low").alias("_low"), F.col("high").alias("_high")), by, "left")
    c = F.when(F.col(label) == F.col("_low"), low).when(F.col(label) == F.col("_high"), high).when(F.col(label).isin(low, high) & F.col("_low").isNull(), F.col(label))
    return j.withColumn("canonical", c).withColumn("code", F.when(c == low, 0).when(c == high, 1)).drop("_low", "_high")


def last_label(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """(key, label): of rows that repeat a key the label of the greatest ``order`` counts, ties to the greater label."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(label, F.struct(order, label)).alias(label))


def verdict(primary: Column, strata: Column, least: int = 4) -> Column:
    """supported if the matches and every stratum's reach ``least``, partial if one of these does, else refuted."""
    a, b = primary >= least, F.coalesce(strata >= least, F.lit(False))
    return F.when(a & b, "supported").when(a | b, "partial").otherwise("refuted")


def continuum(df: DataFrame, by: list[str], order: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Whether the values of a group's few rows never fall in their order: each step above -``tolerance``."""
    from pyspark.sql import Window

    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_s", step).groupBy(*by).agg(F.count("*").alias("n"), F.min("_s").alias("least_step"), F.coalesce(F.bool_and(F.col("_s") > -tolerance), F.lit(True)).alias("continuous"))


def normal_p(z: Column) -> Column:
    return tails.normal_p(z)


def match_checks(cases: int, matched: DataFrame, halves: DataFrame, value: str, most_smd: float = 0.1, least_yield: float = 0.5) -> DataFrame:
    """(test, n_cases, n_controls, effect, p) of matched rows (pid, side, value, agatston_lad, agatston_total, max_hu_global).

    ``cases`` is how many there were before matching, ``halves`` has (pid, lower). An unbalanced or scarce
    match has the row ``balance`` only, an empty one with a null effect.
    """
    spark = matched.sparkSession
    schema = "test string, n_cases long, n_controls long, effect double, p double"
    n = {r["side"]: r["count"] for r in matched.groupBy("side").count().collect()}
    na, nb = n.get("case", 0), n.get("control", 0)
    gap = T.standardised_difference(matched.withColumn("_one", F.lit(1)), ["_one"], F.col("side") == "case", value).first()
    smd = gap.smd if gap else None
    share = na / cases if cases else 0.0
    balance = spark.createDataFrame([("balance", na, nb, smd, share)], schema)
    if smd is None or abs(smd) >= most_smd or share < least_yield:
        return balance
    tests = matched.withColumns({"lad_share": F.coalesce("agatston_lad", F.lit(0.0)) / (F.greatest("agatston_total", F.lit(0.0)) + 1e-6), "max_hu": F.col("max_hu_global")})
    ranks = T.with_normal_p(T.rank_contrast(T.long_form(tests, ["side"], ["lad_share", "max_hu"]), ["feature"], "side", "case", "control", "value"))
    above = F.when(F.col("z") > 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2)
    ranks = ranks.select(F.col("feature").alias("test"), F.col("n_a").alias("n_cases"), F.col("n_b").alias("n_controls"), F.col("cliffs_delta").alias("effect"), above.alias("p"))
    side = lambda s, low: F.count_if((F.col("side") == s) & (F.col("lower") == low))
    t = halves.join(matched.select("pid", "side"), "pid").agg(side("case", True).alias("a"), side("case", False).alias("b"), side("control", True).alias("c"), side("control", False).alias("d")).first()
    x, y = t.a + t.b, t.c + t.d
    halves_row = ("lower_half", x, y, None, None)
    if x >= 5 and y >= 5:
        spread = float(x) * y * (t.a + t.c) * (t.b + t.d)
        off = max(abs(float(t.a) * t.d - float(t.b) * t.c) - (x + y) / 2, 0.0)
        # a 2 x 2 table has one degree of freedom: chi is a normal deviate
        p = tails.normal_two_sided(math.sqrt((x + y) * off * off / spread)) if spread else 1.0
        halves_row = ("lower_half", x, y, t.a / x - t.c / y, p)
    return balance.unionByName(ranks).unionByName(spark.createDataFrame([halves_row], schema))
