"""Joins by nearness, range, set membership and key comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, by: list[str], value: str, other: str, pick: str, tolerance: Column, key: str) -> DataFrame:
    """For each left row the right row of its group whose ``other`` lies nearest to ``value``.

    Within the tolerance, equality included; ties go to the smallest ``pick``. A left row finds its
    partners by a grid of tolerance-wide cells (its own and both neighbours), so a group with very many
    rows on both sides is not joined each with each. Rows without a partner have null. The cell width
    is fixed per join: the largest tolerance.
    """
    width = left.agg(F.max(tolerance)).first()[0]
    if not width or width <= 0:
        width = 1.0
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    a = left.where(F.col(value).isNotNull()).select(key, *by, value, tolerance.alias("_tol"), F.explode(F.array(cell(value) - 1, cell(value), cell(value) + 1)).alias("_cell"))
    b = right.where(F.col(other).isNotNull()).select(*by, other, pick, cell(other).alias("_cell")).distinct()
    d = F.abs(F.col(value) - F.col(other))
    near = a.join(b, [*by, "_cell"]).where(d <= F.col("_tol")).groupBy(key).agg(F.min(F.struct(F.round(d, 9).alias("d"), F.col(pick).alias("p"))).alias("_m"))
    return left.join(near.select(key, F.col("_m.p").alias("matched"), F.col("_m.d").alias("distance")), key, "left")


def range_edges(nodes: DataFrame, by: list[str], key: str, step: str, x: str, y: str, most_step: int, most_distance: float) -> DataFrame:
    """Pairs a < b of a group at most ``most_step`` apart in ``step`` and ``most_distance`` apart in x, y.

    An equi-join on blocks of four distances and eight steps: each right row is sent to its block, each
    left row to the blocks it reaches, fewer than three on average; the left one comes first by step, then key.
    """
    n = nodes.where(F.col(key).isNotNull() & F.col(step).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    steps, block, far = 8 * max(1, most_step), 4 * most_distance, most_distance * (1 + 1e-9)
    at = lambda c, width: F.floor(c / width).cast("long")
    n = n.select(*by, F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(step).cast("long").alias("s"))
    reach = lambda c: F.explode(F.sequence(at(F.col(c) - far, block), at(F.col(c) + far, block)))
    left = n.select(*by, F.col("k").alias("ak"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("s").alias("as_"), F.explode(F.sequence(at(F.col("s"), steps), at(F.col("s") + most_step, steps))).alias("bs"))
    left = left.withColumn("bx", reach("ax")).withColumn("by_", reach("ay"))
    right = n.select(*by, "s", at(F.col("s"), steps).alias("bs"), at(F.col("x"), block).alias("bx"), at(F.col("y"), block).alias("by_"), "k", "x", "y")
    near = (F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= most_distance**2
    near &= F.col("s").between(F.col("as_"), F.col("as_") + most_step) & ((F.col("as_") < F.col("s")) | (F.col("ak") < F.col("k")))
    return left.join(right, [*by, "bs", "bx", "by_"]).where(near).select(*by, F.least("ak", "k").alias("a"), F.greatest("ak", "k").alias("b"))


def discovery(left: DataFrame, right: DataFrame, key: str, excluded: list[str], reasons: list[tuple[Column, str]]) -> DataFrame:
    """(key, reason): ids of either side; reason is null for the included ones."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    attrs = left.dropDuplicates([key]).drop("_l")
    j = a.join(b, key, "full").join(attrs, key, "left")
    why = F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left").when(F.col(key).isin(*excluded), "config_excluded")
    for cond, name in reasons:
        why = why.when(cond, name)
    return j.select(key, why.alias("reason"))


def consistency(tables: list[tuple[str, DataFrame]], keys: list[str], value: str) -> DataFrame:
    """Full outer join of one value per table: per key the values, how many there are, and whether all have one non-zero sign."""
    out = None
    for name, t in tables:
        t = t.select(*keys, F.col(value).alias(name))
        out = t if out is None else out.join(t, keys, "full")
    names = [n for n, _ in tables]
    signs = F.array(*[F.signum(F.col(n)) for n in names])
    there = F.filter(signs, lambda s: s.isNotNull())
    same = (F.size(there) == len(names)) & F.forall(signs, lambda s: (s == signs[0]) & (s != 0))
    return out.withColumns({"n_present": F.size(there), "same_sign": F.coalesce(same, F.lit(False))})


def set_overlap(df: DataFrame, a: str, b: str, empty: float = 1.0) -> DataFrame:
    """Jaccard index of two array columns; two empty sets give ``empty``; null arrays count as empty."""
    x, y = F.coalesce(F.col(a), F.array().cast(dict(df.dtypes)[a])), F.coalesce(F.col(b), F.array().cast(dict(df.dtypes)[b]))
    union = F.size(F.array_union(x, y))
    return df.withColumn("jaccard", F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0))))
