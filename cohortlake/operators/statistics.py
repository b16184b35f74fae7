"""Two-sample, correlation, contingency, reliability and scaling statistics from grouped sums.

Statistics are aggregated in Spark over any number of rows; tail probabilities are taken of the few
rows that are left. Nulls are dropped pairwise unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import tails
from cohortlake.operators.windows import average_rank, null_safe_join, quantiles


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, value) with one row per key and column."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def rank_contrast(df: DataFrame, by: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Mann-Whitney U of ``a`` over ``b``, Cliff's delta and the tie- and continuity-corrected z per family.

    An empty side gives null; two equal constants give z 0.
    """
    d = average_rank(df.where(F.col(group).isin(a, b)), by, value, "_rank")
    one = d.groupBy(*by).agg(
        F.count_if(F.col(group) == a).alias("n_a"), F.count_if(F.col(group) == b).alias("n_b"),
        F.sum(F.when(F.col(group) == a, F.col("_rank")).otherwise(0.0)).alias("r_a"),
        F.sum((F.col("_rank_ties") ** 2 - 1).cast("double")).alias("ties"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("r_a") - na * (na + 1) / 2
    var = na * nb / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    off = F.abs(F.col("u") - na * nb / 2) - 0.5
    z = F.when(var <= 0, 0.0).otherwise(F.signum(F.col("u") - na * nb / 2) * F.greatest(off, F.lit(0.0)) / F.sqrt(F.greatest(var, F.lit(1e-300))))
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return one.withColumn("u", F.when(both, u)).withColumns({"cliffs_delta": 2 * F.col("u") / F.nullif(na * nb, F.lit(0.0)) - 1, "z": F.when(both, z)}).drop("r_a", "ties")


def with_normal_p(df: DataFrame, z: str = "z", out: str = "p") -> DataFrame:
    return df.withColumn(out, tails.normal_p(F.col(z)))


def brown_forsythe(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """F of absolute deviations from the group medians, its degrees of freedom and p."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    med = quantiles(d, [*by, group], value, {"_med": 0.5})
    dev = null_safe_join(d, med, [*by, group]).withColumn("_d", F.abs(F.col(value) - F.col("_med")))
    per = dev.groupBy(*by, group).agg(F.count("*").alias("n"), F.avg("_d").alias("m"), F.var_pop("_d").alias("v"))
    s = per.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") ** 2).alias("sq"))
    between = F.col("sq") - F.col("n") * F.col("mean") ** 2
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    return s.select(*by, "k", "n", F.when((d1 > 0) & (d2 > 0) & (F.col("within") > 0), (between / d1) / (F.col("within") / d2)).alias("f"), d1.alias("df1"), d2.alias("df2"))


def with_f_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", tails.f_p(F.col("f"), F.col("df1"), F.col("df2")))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of pairs without nulls; fewer than 5 pairs or a constant side give null."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    d = average_rank(average_rank(d, by, "_x", "_rx"), by, "_y", "_ry")
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop("_rx").alias("vx"), F.var_pop("_ry").alias("vy"), F.covar_pop("_rx", "_ry").alias("c"))
    ok = (F.col("n") >= 5) & (F.col("vx") > 0) & (F.col("vy") > 0)
    return g.select(*by, "n", F.when(ok, F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("rho"))


def with_rho_p(df: DataFrame) -> DataFrame:
    n, r = F.col("n"), F.col("rho")
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    return df.withColumn("p", tails.t_p(t, (n - 2).cast("double")))


def kendall_tau_b(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Tau-b of two columns of few distinct values, from their table of counts.

    Concordant pairs are cumulative sums over the table's cells, so the work is the number of distinct
    pairs of values times the distinct values of ``x``, never the number of pairs of rows.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cell = d.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy(*by, "_x").orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    cells = cell.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0.0))).withColumn("row", F.sum("n").over(Window.partitionBy(*by, "_x")))
    rows = cells.groupBy(*by, "_x").agg(F.array_sort(F.collect_list(F.struct("_y", "n"))).alias("ys"), F.first("row").alias("row"))
    j = cells.alias("c").join(rows.select(*by, F.col("_x").alias("_x2"), "ys", F.col("row").alias("row2")), by).where(F.col("_x2") > F.col("_x"))
    more = F.aggregate("ys", F.lit(0.0), lambda a, t: a + F.when(t["_y"] > F.col("c._y"), t["n"]).otherwise(0.0))
    less = F.aggregate("ys", F.lit(0.0), lambda a, t: a + F.when(t["_y"] < F.col("c._y"), t["n"]).otherwise(0.0))
    pairs = j.groupBy(*by).agg(F.sum(F.col("n") * (more - less)).alias("s"))
    tie = lambda c: cell.groupBy(*by, c).agg(F.sum("n").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"), F.sum("t").alias(f"N{c}"))
    g = tie("_x").join(tie("_y").drop("N_y"), by).join(pairs, by, "left")
    n0 = F.col("N_x") * (F.col("N_x") - 1) / 2
    den = F.sqrt((n0 - F.col("t_x")) * (n0 - F.col("t_y")))
    return g.select(*by, F.col("N_x").cast("long").alias("n"), F.when(den > 0, F.coalesce("s", F.lit(0.0)) / F.nullif(den, F.lit(0.0))).alias("tau"))


def chi_square(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson chi-square of a contingency table, Yates-corrected when it has one degree of freedom."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").cast("double").alias("o"))
    row = c.groupBy(*by, a).agg(F.sum("o").alias("r"))
    col = c.groupBy(*by, b).agg(F.sum("o").alias("c"))
    tot = c.groupBy(*by).agg(F.sum("o").alias("n"))
    join = (lambda x, y: x.join(y, by)) if by else (lambda x, y: x.join(y, F.lit(True)))
    full = join(join(row, col), tot)  # as many rows as cells of the table
    full = full.join(c, [*by, a, b], "left").withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    g = full.groupBy(*by).agg(F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.first("n").alias("n"), F.sum((F.coalesce("o", F.lit(0.0)) - F.col("e")) ** 2 / F.col("e")).alias("plain"), F.sum(F.greatest(F.abs(F.coalesce("o", F.lit(0.0)) - F.col("e")) - 0.5, F.lit(0.0)) ** 2 / F.col("e")).alias("yates"))
    df_ = (F.col("ka") - 1) * (F.col("kb") - 1)
    return g.select(*by, F.col("n").cast("long").alias("n"), df_.alias("dof"), F.when(df_ == 1, F.col("yates")).when(df_ > 1, F.col("plain")).otherwise(0.0).alias("chi2"))


def goodness_of_fit(df: DataFrame, group: str, label: str) -> DataFrame:
    """Per group: chi-square of its labels against the base rate of all, and Cramer's V."""
    c = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").cast("double").alias("o"))
    base = c.groupBy(label).agg(F.sum("o").alias("b"))
    n = c.agg(F.sum("o").alias("n"))
    size = c.groupBy(group).agg(F.sum("o").alias("g"))
    full = size.join(base, F.lit(True)).join(n, F.lit(True)).join(c, [group, label], "left")  # groups times labels
    e = F.col("g") * F.col("b") / F.col("n")
    s = full.groupBy(group).agg(F.first("g").alias("g"), F.count("*").alias("k"), F.sum((F.coalesce("o", F.lit(0.0)) - e) ** 2 / e).alias("chi2"))
    return s.select(group, F.col("g").cast("long").alias("n"), (F.col("k") - 1).alias("dof"), "chi2", F.when(F.col("k") > 1, F.sqrt(F.col("chi2") / (F.col("g") * (F.col("k") - 1)))).alias("cramers_v"))


def jonckheere(df: DataFrame, by: list[str], order: str, value: str, groups: list) -> DataFrame:
    """J of ordered groups: pairs in order, ties by half; variance without tie correction; z."""
    d = df.where(F.col(value).isNotNull() & F.col(order).isin(*groups))
    parts = None
    for i, a in enumerate(groups):
        for b in groups[i + 1 :]:
            u = rank_contrast(d.withColumn("_o", F.col(order).cast("string")), by, "_o", str(b), str(a), value).select(*by, F.coalesce("u", F.lit(0.0)).alias("u"))
            parts = u if parts is None else parts.unionByName(u)
    j = parts.groupBy(*by).agg(F.sum("u").alias("j"))
    per = d.groupBy(*by, order).agg(F.count("*").cast("double").alias("g"))
    n = per.groupBy(*by).agg(F.sum("g").alias("n"), F.sum(F.col("g") ** 2).alias("s2"), F.sum(F.col("g") ** 2 * (2 * F.col("g") + 3)).alias("s3"))
    mean = (F.col("n") ** 2 - F.col("s2")) / 4
    var = (F.col("n") ** 2 * (2 * F.col("n") + 3) - F.col("s3")) / 72
    return j.join(n, by).select(*by, "j", F.col("n").cast("long").alias("n"), F.when(var > 0, (F.col("j") - mean) / F.sqrt(var)).alias("z"))


def standardised_difference(df: DataFrame, by: list[str], case: Column, value: str) -> DataFrame:
    """Mean difference over the pooled deviation sqrt((va + vb) / 2); no difference and no spread is 0."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(F.when(case, F.col(value))).alias("ma"), F.avg(F.when(~case, F.col(value))).alias("mb"), F.var_samp(F.when(case, F.col(value))).alias("va"), F.var_samp(F.when(~case, F.col(value))).alias("vb"))
    sd = F.sqrt((F.col("va") + F.col("vb")) / 2)
    diff = F.col("ma") - F.col("mb")
    return g.select(*by, F.when((sd == 0) & (diff == 0), 0.0).when(sd > 0, diff / F.nullif(sd, F.lit(0.0))).alias("smd"))


def icc(long: DataFrame, by: list[str], subject: str, rater: str, value: str) -> DataFrame:
    """Absolute-agreement intraclass correlation per family, subjects with all raters only.

    Under two subjects or raters, no total spread or a zero denominator gives null.
    """
    d = long.where(F.col(value).isNotNull()).groupBy(*by, subject, rater).agg(F.avg(value).alias("v"))
    raters = d.groupBy(*by).agg(F.countDistinct(rater).alias("k"))
    full = d.groupBy(*by, subject).agg(F.count("*").alias("c")).join(raters, by).where("c = k").select(*by, subject)
    d = d.join(full, [*by, subject], "left_semi")
    s = d.groupBy(*by, subject).agg(F.avg("v").alias("m")).groupBy(*by).agg(F.var_pop("m").alias("vs"), F.count("*").cast("double").alias("n"))
    r = d.groupBy(*by, rater).agg(F.avg("v").alias("m")).groupBy(*by).agg(F.var_pop("m").alias("vr"), F.count("*").cast("double").alias("k"))
    t = d.groupBy(*by).agg(F.var_pop("v").alias("vt"))
    g = s.join(r, by).join(t, by)
    n, k = F.col("n"), F.col("k")
    msr = k * n * F.col("vs") / F.nullif(n - 1, F.lit(0.0))
    msc = n * k * F.col("vr") / F.nullif(k - 1, F.lit(0.0))
    mse = n * k * (F.col("vt") - F.col("vs") - F.col("vr")) / F.nullif((n - 1) * (k - 1), F.lit(0.0))
    den = msr + (k - 1) * mse + k * (msc - mse) / n
    ok = (n >= 2) & (k >= 2) & (F.col("vt") > 0) & (den != 0)
    return g.select(*by, n.cast("long").alias("n_subjects"), k.cast("long").alias("n_raters"), F.when(ok, (msr - mse) / F.nullif(den, F.lit(0.0))).alias("icc"))


def icc_gate(report: DataFrame, bypass: list[str], threshold: float = 0.75) -> DataFrame:
    """Pass flag per feature: a known ICC of at least ``threshold``; bypassed features count as 1.0."""
    held = F.col("feature").isin(*bypass)
    value = F.when(held, 1.0).otherwise(F.round("icc", 6))
    return report.select("feature", value.alias("icc"), F.when(held, "bypass").otherwise("measured").alias("source"), F.coalesce(value >= threshold, F.lit(False)).alias("passes"))


def threshold_sweep(report: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.75, 0.85)) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.coalesce(F.col("icc") >= t, F.lit(False))).alias("n_pass")) for t in thresholds])
    return report.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def moments(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean, sample deviation, bias-corrected skewness and the variance filter's flag (at least 0.01)."""
    g = long.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("_s"))
    n = F.col("n").cast("double")
    g1 = F.when((F.col("n") > 2) & (F.col("sd") > 0), F.col("_s") * F.sqrt(n * (n - 1)) / (n - 2))
    return g.withColumns({"skewness": g1, "kept": F.coalesce(F.col("sd") >= 0.01, F.lit(False))}).drop("_s")


def z_scores(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Columns centred and scaled by the sample deviation; a column without spread is only centred."""
    stats = df.groupBy(*by).agg(*[a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    j = df.join(stats, by) if by else df.join(F.broadcast(stats), F.lit(True))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return j.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def r2_by_batch(long: DataFrame, by: list[str], batch: str, value: str = "value") -> DataFrame:
    """Share of the total sum of squares that lies between batches; no spread gives 0."""
    d = long.where(F.col(value).isNotNull() & F.col(batch).isNotNull())
    per = d.groupBy(*by, batch).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    g = per.groupBy(*by).agg((F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").cast("long").alias("n"))
    total = F.col("between") + F.col("within")
    return g.select(*by, "n", F.when(total > 0, F.col("between") / total).otherwise(0.0).alias("r2"))


def residualise(df: DataFrame, by: list[str], y: str, x: str, out: str = "residual") -> DataFrame:
    """Least-squares residuals of ``y`` on an intercept and ``x``; rows without either have null."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    fit = df.where(ok).groupBy(*by).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(y).alias("_m"))
    j = df.join(fit, by, "left")
    return j.withColumn(out, F.col(y) - F.coalesce(F.col("_a") + F.col("_b") * F.col(x), F.when(F.col(x).isNotNull(), F.col("_m")))).drop("_a", "_b", "_m")


def adjusted_rand(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows; no rows give 0."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    pairs = lambda d, o: d.groupBy(*by).agg(F.sum(two(F.col("n"))).alias(o))
    cell = c.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    ra, rb = pairs(c.groupBy(*by, a).agg(F.sum("n").alias("n")), "sa"), pairs(c.groupBy(*by, b).agg(F.sum("n").alias("n")), "sb")
    g = cell.join(ra, by).join(rb, by) if by else cell.join(ra, F.lit(True)).join(rb, F.lit(True))
    expected = F.col("sa") * F.col("sb") / F.nullif(two(F.col("t")), F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    return g.select(*by, F.col("t").cast("long").alias("n"), F.when(top == expected, 1.0).otherwise(F.coalesce((F.col("s") - expected) / F.nullif(top - expected, F.lit(0.0)), F.lit(0.0))).alias("ari"))


def dispersion(df: DataFrame, by: list[str], label: str, columns: list[str]) -> DataFrame:
    """Within-cluster sum of squares over the columns; clusters of one row count nothing."""
    sq = sum((F.coalesce(F.var_pop(c), F.lit(0.0)) for c in columns), F.lit(0.0)) * F.count("*")
    per = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"), sq.alias("w"))
    return per.groupBy(*by).agg(F.sum(F.when(F.col("n") >= 2, F.col("w")).otherwise(0.0)).alias("w"), F.count("*").alias("k"))


def ambiguous_share(pairs: DataFrame, by: list[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Share of pairs whose consensus lies strictly between two levels."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(((F.col(value) > low) & (F.col(value) < high)).cast("double")).alias("pac"))


def select_k(gaps: DataFrame, by: list[str]) -> DataFrame:
    """Smallest k whose gap reaches the largest gap less that one's standard error."""
    best = gaps.groupBy(*by).agg(F.max_by(F.struct("gap", "s"), F.struct("gap", -F.col("k"))).alias("b"))
    return gaps.join(best, by).where(F.col("gap") >= F.col("b.gap") - F.col("b.s")).groupBy(*by).agg(F.min("k").alias("k"))
