"""Ranks, bins, neighbours in an order, cumulative cuts and corrected p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.scoring import diffusivity
from cohortlake.session import blocked_cumsum


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls equal each other; the keys come from the left."""
    if not keys:
        return left.join(right, F.lit(True), how)
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"_k_{k}"])
    return left.join(r, cond, how).drop(*[f"_k_{k}" for k in keys])


def with_blocks(df: DataFrame, by: list[str], value: str, out: str = "_block", blocks: int = 32) -> DataFrame:
    """``df`` with the number of the block of values, between approximate percentiles of its group, that a row lies in.

    Blocks follow each other in the order of ``value`` and equal values share one, so a group with most
    of the rows is spread over tasks, and what a window gives is put together from its blocks.
    """
    marks = df.groupBy(*by).agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 1000).alias("_marks"))
    return null_safe_join(df, marks, by).withColumn(out, F.coalesce(F.size(F.filter("_marks", lambda x: x < F.col(value))), F.lit(0))).drop("_marks")


def counted(df: DataFrame, by: list[str], value: str, blocks: int = 32) -> DataFrame:
    """(by, value, _t, _before): each distinct non-null value of a group, its rows, and the rows below it."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_t"))
    per = with_blocks(per, by, value, "_at", blocks)
    return blocked_cumsum(per, by, [value], F.col("_at"), F.col("_t"), "_before", blocks).drop("_at")


def average_rank(df: DataFrame, by: list[str], value: str, out: str = "rank", blocks: int = 32) -> DataFrame:
    """Average-tie ranks of non-null values within groups, from distinct values and their counts."""
    per = counted(df, by, value, blocks).withColumn(out, F.col("_before") + (F.col("_t") + 1) / 2)
    return df.where(F.col(value).isNotNull()).join(per.select(*by, value, out, F.col("_t").alias(f"{out}_ties")), [*by, value])


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear percentiles, one row per group and a column per entry of ``qs``; groups of nulls have nulls.

    The two order statistics around each place come from counts of distinct values in blocks, so no
    buffer holds a group's values, however many there are.
    """
    per = counted(df.select(*by, F.col(value).cast("double").alias("_v")), by, "_v")
    n = per.groupBy(*by).agg(F.sum("_t").alias("_n"))
    j = null_safe_join(per, n, by)
    at = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_t")), F.col("_v")))
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ends = [e.alias(f"_{k}_{name}") for name, q in qs.items() for k, e in (("a", at(F.floor(place(q)))), ("b", at(F.ceil(place(q)))))]
    g = j.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    a, b = (lambda name: F.col(f"_a_{name}")), (lambda name: F.col(f"_b_{name}"))
    g = g.select(*by, *[(a(name) + (b(name) - a(name)) * (place(q) - F.floor(place(q)))).alias(name) for name, q in qs.items()])
    return null_safe_join(df.groupBy(*by).agg(F.lit(1).alias("_one")), g, by, "left").drop("_one")


def tertile(df: DataFrame, by: list[str], value: str, out: str = "tertile") -> DataFrame:
    """Right-closed bins 1 to 3 on linear percentiles; nulls stay null, equal edges drop a bin."""
    cuts = quantiles(df, by, value, {"_q1": 1 / 3, "_q2": 2 / 3})
    j = df.join(cuts, by) if by else df.join(cuts, F.lit(True))
    v = F.col(value)
    return j.withColumn(out, F.when(v.isNull(), None).when(v <= F.col("_q1"), 1).when(v <= F.col("_q2"), 2).otherwise(3)).drop("_q1", "_q2")


def top_n(df: DataFrame, by: list[str], order: list, n: int, out: str = "place") -> DataFrame:
    """The first ``n`` rows of each group; ``order`` should end in a unique key.

    Spark keeps the first ``n`` of each task's share before the shuffle (its window group limit), so a
    group with most of the rows sends few.
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= n)


def relative_position(df: DataFrame, by: list[str], value: str, out: str = "relative", descending: bool = False) -> DataFrame:
    """Place between the group's extremes, 0 to 1; groups of one row or without range are dropped."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_hi > _lo")
    d = df.where(F.col(value).isNotNull()).join(ends, by)
    span = F.col("_hi") - F.col("_lo")
    at = (F.col("_hi") - F.col(value)) if descending else (F.col(value) - F.col("_lo"))
    return d.withColumn(out, at / span).drop("_lo", "_hi")


def consecutive_distances(points: DataFrame, by: list[str], x: str, y: str, z: str, key: str) -> DataFrame:
    """Per group in the order z, x, y: mean and largest step between neighbours, first-to-last, diffusivity.

    Steps are taken within blocks of z; the step into a block starts at the last point of the one before.
    """
    d = points.where(" and ".join(f"{c} is not null" for c in (x, y, z))).select(*by, F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"), F.col(key).alias("k"))
    d = with_blocks(d, by, "z")
    far = lambda p, q: F.sqrt(sum(((p[c] - q[c]) ** 2 for c in "xyz"), F.lit(0.0)))
    d = d.withColumn("p", F.struct("z", "x", "y", "k"))
    d = d.withColumn("step", far(F.col("p"), F.lag("p").over(Window.partitionBy(*by, "_block").orderBy("p"))))
    b = d.groupBy(*by, "_block").agg(F.count("*").alias("n"), F.sum("step").alias("steps"), F.max("step").alias("longest"), F.min("p").alias("first"), F.max("p").alias("last"))
    into = far(F.col("first"), F.lag("last").over(Window.partitionBy(*by).orderBy("_block")))  # a row per block
    g = b.withColumn("into", into).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.coalesce("steps", F.lit(0.0)) + F.coalesce("into", F.lit(0.0))).alias("steps"), F.max(F.greatest("longest", "into")).alias("longest"), far(F.min("first"), F.max("last")).alias("span"))
    g = g.select(*by, "n", F.coalesce(F.col("steps") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)).alias("mean_step"), F.coalesce("longest", F.lit(0.0)).alias("max_step"), "span")
    return g.withColumn("diffusivity", diffusivity(F.col("n"), F.col("span")))


def cumulative_cut(df: DataFrame, by: list[str], value: str, key: str, share: float) -> DataFrame:
    """Per group, largest first: how many values reach ``share`` of the total (all if none does)."""
    d = df.where(F.col(value).isNotNull()).select(*by, (-F.col(value)).alias("_v"), F.col(key).alias("_key"))
    d = with_blocks(d, by, "_v", "_at")
    d = blocked_cumsum(d, by, ["_v", "_key"], F.col("_at"), F.lit(1), "_k")
    d = blocked_cumsum(d, by, ["_v", "_key"], F.col("_at"), -F.col("_v"), "_c")
    total = d.groupBy(*by).agg(F.sum(-F.col("_v")).alias("_s"))
    reach = F.when(F.col("_c") - F.col("_v") >= share * F.col("_s") - 1e-9, F.col("_k") + 1)
    return null_safe_join(d, total, by).groupBy(*by).agg(F.coalesce(F.min(reach), F.count("*")).alias("k"), F.count("*").alias("n"))


def ordered_place(df: DataFrame, by: list[str], value: str, key: str, out: str = "place") -> DataFrame:
    """Rows with a value, numbered from 1 within their group by value, then key; numbers run on from block to block."""
    d = with_blocks(df.where(F.col(value).isNotNull()), by, value, "_at")
    return blocked_cumsum(d, by, [value, key], F.col("_at"), F.lit(1), out).withColumn(out, F.col(out) + 1).drop("_at")


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, key: str, out: str = "p_adjusted") -> DataFrame:
    """Step-up adjusted p-values within each family; rows without p stay out of the family."""
    w = Window.partitionBy(*by).orderBy(p, key)
    d = df.where(F.col(p).isNotNull()).withColumns({"_r": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy(*by))})
    down = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")


def largest_gap(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The widest step between sorted values and where it begins (first of equals)."""
    d = with_blocks(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).distinct(), by, "_v")
    d = d.withColumn("_g", F.lead("_v").over(Window.partitionBy(*by, "_block").orderBy("_v")) - F.col("_v"))
    inner = d.where("_g is not null").select(*by, "_v", "_g")
    ends = d.groupBy(*by, "_block").agg(F.min("_v").alias("first"), F.max("_v").alias("_v"))  # a row per block
    edge = ends.withColumn("_g", F.lead("first").over(Window.partitionBy(*by).orderBy("_block")) - F.col("_v")).where("_g is not null").select(*by, "_v", "_g")
    return inner.unionByName(edge).groupBy(*by).agg(F.max("_g").alias("gap"), F.max_by("_v", F.struct("_g", -F.col("_v"))).alias("below"))


def rank_sample(df: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """(rank, value, key): ``n`` rows evenly spaced by rank (from 0), halves rounded to even."""
    d = df.where(F.col(value).isNotNull()).select(F.lit(1).alias("_one"), value, key)
    total = d.count()
    wanted = sorted({round(i * (total - 1) / max(1, n - 1)) for i in range(n)}) if total else []
    return ordered_place(d, ["_one"], value, key).select((F.col("place") - 1).alias("rank"), value, key).where(F.col("rank").isin(wanted))
