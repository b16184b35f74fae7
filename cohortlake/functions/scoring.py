"""Column expressions: thresholds, classes, transforms and text clean-up. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TERRITORIES = ("LAD", "RCA", "LCx", "LM")


def steps(value: Column, cuts: list[tuple[float, object]], last: object, null=None) -> Column:
    """``value`` below each cut in turn gives that cut's result, else ``last``; null stays ``null``."""
    out = F.when(value.isNull(), F.lit(null))
    for cut, result in cuts:
        out = out.when(value < cut, F.lit(result))
    return out.otherwise(F.lit(last))


def density_factor(hu: Column) -> Column:
    return steps(hu, [(200, 1), (300, 2), (400, 3)], 4)


def density_tier(hu: Column) -> Column:
    """Null below 130, then d1 to d4 from 130, 200, 300 and 400 on."""
    return F.when(hu >= 130, steps(hu, [(200, "d1"), (300, "d2"), (400, "d3")], "d4"))


def roi_score(area_cm2: Column, hu: Column, thickness_mm: Column) -> Column:
    """0 below 130 HU or without area or thickness, else area in mm2 by density factor, scaled to 3 mm."""
    live = (hu >= 130) & (area_cm2 > 0) & (thickness_mm > 0)
    return F.when(live, area_cm2 * 100 * density_factor(hu) * thickness_mm / 3).otherwise(F.lit(0.0))


def risk_class(score: Column) -> Column:
    return F.when(score <= 0, "zero").otherwise(steps(score, [(100, "mild"), (400, "moderate")], "severe"))


def risk_level(score: Column) -> Column:
    return steps(score, [(10, "0-10"), (100, "10-100"), (400, "100-400"), (1000, "400-1000")], ">1000")


def score_category(score: Column) -> Column:
    """Closed ranges 0, 1 to 99, 100 to 399, 400 and more; scores between them have none."""
    return F.when(score == 0, "0").when(score.between(1, 99), "1-99").when(score.between(100, 399), "100-399").when(score >= 400, ">=400")


def intensity_band(hu: Column) -> Column:
    return F.when(hu >= 130, steps(hu, [(200, "W1"), (300, "W2"), (400, "W3")], "W4"))


def lesion_class(median_hu: Column, median_volume: Column) -> Column:
    return F.when(median_hu >= 500, "dense").when((median_hu <= 230) & (median_volume <= 15), "soft").otherwise("moderate")


def quality_label(pass_rate: Column) -> Column:
    return F.when(pass_rate >= 1.0, "ok").when(pass_rate >= 0.95, "partial").otherwise("poor")


def axis_class(rho_burden: Column, rho_other: Column) -> Column:
    """Which of two correlations dominates: at least 0.5 against under 0.3; NaN and null are mixed."""
    a, b = F.abs(F.nanvl(rho_burden, F.lit(None).cast("double"))), F.abs(F.nanvl(rho_other, F.lit(None).cast("double")))
    return F.when((a >= 0.5) & (b < 0.3), "burden").when((b >= 0.5) & (a < 0.3), "other").otherwise("mixed")


def orthogonality_class(location_p: Column, spread_p: Column, alpha: float = 0.05) -> Column:
    a, b = location_p < alpha, spread_p < alpha
    return F.when(a & b, "confounded").when(a | b, "marginal").otherwise("orthogonal")


def clip(value: Column, low: float, high: float) -> Column:
    if low >= high:
        raise ValueError("low must be below high")
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def first_prefix(name: Column, families: dict[str, str], other: str = "Other") -> Column:
    """The family of the first prefix, in the given order, that a name starts with."""
    return F.coalesce(*[F.when(name.startswith(p), F.lit(f)) for p, f in families.items()], F.lit(other))


def block_of(name: str, blocks: dict[str, dict]) -> str | None:
    """The one block whose exact names or prefixes hold ``name`` and whose exclusions do not; two are an error."""
    hits = [b for b, r in blocks.items() if (name in r.get("names", ()) or any(name.startswith(p) for p in r.get("prefixes", ()))) and name not in r.get("exclude", ())]
    if len(hits) > 1:
        raise ValueError(f"{name} is in blocks {hits}")
    return hits[0] if hits else None


def kernel_key(kernel: Column) -> Column:
    """One spelling per kernel: lower case, list brackets and quotes dropped, parts joined by a slash."""
    k = F.lower(F.trim(F.regexp_replace(kernel, r"[\[\]'\"]", "")))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(k, r"\s*[\\,/]\s*", "/"), r"\s+", ""), F.lit("")), F.lit("none"))


def join_values(values: Column) -> Column:
    """A multi-valued header field as one string: blanks dropped, parts joined by a slash."""
    return F.array_join(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), "/")


def natural_order(pid: Column) -> list[Column]:
    """Sort keys: ids of digits only first, by number, then the others as text."""
    digits = pid.rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, F.lpad(F.regexp_replace(pid, "^0+(?=.)", ""), 40, "0")), pid]


def point_numbers(text: Column) -> Column:
    """Coordinates of text such as ``(1.5, 2, 3)``; parts that are no numbers become null."""
    parts = F.split(F.regexp_replace(text, r"[()\[\]\s]", ""), ",")
    return F.transform(parts, lambda x: x.try_cast("double"))


def centre(text: Column) -> Column:
    """A struct x, y, z, or null unless the text holds exactly three numbers."""
    p = point_numbers(text)
    ok = (F.size(p) == 3) & F.forall(p, lambda x: x.isNotNull())
    return F.when(ok, F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z")))


def yeo_johnson(x: Column, lam: Column) -> Column:
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(F.greatest(x, F.lit(0.0)))).otherwise((F.pow(F.greatest(x, F.lit(0.0)) + 1, lam) - 1) / lam)
    two = 2 - lam
    neg = F.when(F.abs(two) < 1e-12, -F.log1p(F.greatest(-x, F.lit(0.0)))).otherwise(-(F.pow(F.greatest(-x, F.lit(0.0)) + 1, two) - 1) / two)
    return F.when(x >= 0, pos).otherwise(neg)


def centred_log_ratio(parts: Column, count: Column) -> Column:
    """Shares no lower than half a count, closed to one, logs less their mean; needs a total."""
    n = F.size(parts)
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    floored = F.transform(parts, lambda x: F.greatest(x / total, 1 / (2 * count)))
    closed = F.aggregate(floored, F.lit(0.0), lambda a, x: a + x)
    logs = F.transform(floored, lambda x: F.log(x / closed))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(total > 0, F.transform(logs, lambda x: x - mean))


def gini(values: Column) -> Column:
    """Gini index of an array; under two values or without a total 0. Nulls are dropped."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    ranked = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when((n < 2) | (total == 0), F.lit(0.0)).otherwise(2 * ranked / (n * total) - (n + 1) / n)


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """A struct low, high: the score interval of a share; null without trials."""
    p = successes / F.nullif(n, F.lit(0))
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.struct(((mid - half) / scale).alias("low"), ((mid + half) / scale).alias("high")))


def diffusivity(n: Column, span: Column) -> Column:
    """0 without lesions, 1 for one lesion or a span of nothing, else lesions per millimetre."""
    return F.when(n == 0, 0.0).when((n == 1) | (span < 1e-6), 1.0).otherwise(n / F.nullif(span, F.lit(0.0)))


def polygon_area_centroid(points: Column) -> Column:
    """Struct area, x, y of an array of structs x, y by the shoelace rule; the vertex mean if it has no area."""
    n = F.size(points)
    nxt = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("c"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    add = lambda f: F.aggregate(cross, F.lit(0.0), lambda a, t: a + f(t))
    a2 = add(lambda t: t["c"])
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / n
    flat = F.abs(a2) < 1e-12
    x = F.when(flat, mean("x")).otherwise(add(lambda t: t["sx"] * t["c"]) / F.nullif(3 * a2, F.lit(0.0)))
    y = F.when(flat, mean("y")).otherwise(add(lambda t: t["sy"] * t["c"]) / F.nullif(3 * a2, F.lit(0.0)))
    return F.when(n > 0, F.struct((F.abs(a2) / 2).alias("area"), x.alias("x"), y.alias("y")))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
