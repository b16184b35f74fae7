"""Pixels of outlines; one region is one row of work, bounded by the image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.scoring import polygon_area_centroid


def fill_polygon(xs: np.ndarray, ys: np.ndarray, width: int = 512, height: int = 512, fraction_bits: int = 4) -> np.ndarray:
    """(row, column) of an image's pixels whose centre lies in or on a polygon, vertices rounded to 1/16 pixel.

    Only rows and columns of the image are walked, however far a stray vertex lies outside.
    """
    unit = 1 << fraction_bits
    x, y = np.rint(np.asarray(xs, dtype=float) * unit), np.rint(np.asarray(ys, dtype=float) * unit)
    if len(x) < 3:
        return np.empty((0, 2), dtype=int)
    out = []
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    span = lambda a, b: range(max(0, int(np.ceil(a / unit - 1e-9))), min(width - 1, int(np.floor(b / unit + 1e-9))) + 1)
    for r in range(max(0, int(np.ceil(y.min() / unit))), min(height - 1, int(np.floor(y.max() / unit))) + 1):
        t = r * unit
        on = set()
        cut = (y <= t) != (y2 <= t)
        at = np.sort(x[cut] + (t - y[cut]) * (x2[cut] - x[cut]) / (y2[cut] - y[cut]))
        for a, b in zip(at[::2], at[1::2]):
            on.update(span(a, b))
        for a, b in zip(x[(y == t) & (y2 == t)], x2[(y == t) & (y2 == t)]):  # edges along the row belong to it
            on.update(span(min(a, b), max(a, b)))
        on.update(int(v // unit) for v in x[y == t] if v % unit == 0 and 0 <= v < width * unit)
        out += [(r, c) for c in sorted(on)]
    return np.array(out, dtype=int).reshape(-1, 2)


def masks(outlines: DataFrame, keys: list[str], width: int = 512, height: int = 512) -> DataFrame:
    """(keys, row, col) of the pixels of each outline: ``outlines`` has keys and points ARRAY<STRUCT<x, y>>.

    Outlines of fewer than three points, or with points that are null, give no pixels; pixels outside
    the image are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                pts = row[len(keys)]
                px = fill_polygon([p["x"] for p in pts], [p["y"] for p in pts], width, height)
                if len(px):
                    yield pd.DataFrame({**{k: row[i] for i, k in enumerate(keys)}, "row": px[:, 0].astype("int32"), "col": px[:, 1].astype("int32")})

    good = outlines.where(F.size("points") >= 3).where(F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    kinds = dict(outlines.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "row int", "col int"])
    return good.select(*keys, "points").mapInPandas(run, schema)


def mask_report(outlines: DataFrame, keys: list[str]) -> DataFrame:
    """Per outline: points, polygon area and centre, pixels, and why it has none."""
    area = polygon_area_centroid(F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    count = masks(outlines, keys).groupBy(*keys).agg(F.count("*").alias("n_pixels"))
    j = outlines.withColumn("g", area).join(count, keys, "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0)))
    why = F.when(F.size("points") < 3, "too_few_points").when(F.col("n_pixels") == 0, "outside_or_thin")
    return j.select(*keys, F.size("points").alias("n_points"), F.col("g.area").alias("area_px"), F.col("g.x").alias("cx"), F.col("g.y").alias("cy"), "n_pixels", why.alias("skipped"))
