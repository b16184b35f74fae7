"""Preparation of a feature matrix: sentinels out, counts to flags, redundant columns gated, then scaled; fitted on training rows alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.scoring import yeo_johnson
from cohortlake.operators.multivariate import fit_yeo_johnson, gram


def drop_sentinels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without the named columns; names that are not there change nothing."""
    return df.drop(*columns)


def binarise(df: DataFrame, columns: list[str], suffix: str = "_present") -> DataFrame:
    """Counts as 0 or 1, each new column in the place of its old one; null stays null."""
    return df.select(*[F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("int")).alias(c + suffix) if c in columns else F.col(c) for c in df.columns])


def require(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df``, failing at the first row without key or with a null or NaN among ``columns``."""
    bad = F.col(key).isNull()
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return df.withColumn(key, F.when(bad, F.raise_error(F.concat(F.lit("incomplete row "), F.coalesce(F.col(key).cast("string"), F.lit("without key")))).cast(dict(df.dtypes)[key])).otherwise(F.col(key)))


def r2_gate(df: DataFrame, base: list[str], candidates: list[str], most: float = 0.95) -> list[tuple[str, float, bool]]:
    """(candidate, R2, kept) in order: a candidate that the columns so far explain by ``most`` or more is left out.

    One kept becomes a regressor for the next. A constant candidate has R2 1. All moments come from one
    aggregation over complete rows; the solutions are as large as the number of columns.
    """
    names = [*base, *candidates]
    _, _, cov = gram(df, names)
    held, out = list(range(len(base))), []
    for i, name in enumerate(candidates, len(base)):
        var = cov[i, i]
        r2 = 1.0
        if var > 1e-12:
            live = [k for k in held if cov[k, k] > 1e-12]
            beta = np.linalg.lstsq(cov[np.ix_(live, live)], cov[live, i], rcond=None)[0] if live else np.zeros(0)
            r2 = float(np.clip(beta @ cov[live, i] / var, 0.0, 1.0)) if live else 0.0
        kept = r2 < most
        out.append((name, r2, kept))
        if kept:
            held.append(i)
    return out


class Preparation:
    """What training rows teach: kept columns, powers, means and deviations. ``transform`` never fits again."""

    def __init__(self, train: DataFrame, base: list[str], candidates: list[str], skewed: float = 1.0, least_sd: float = 0.01):
        self.gate = r2_gate(train, base, candidates)
        columns = [*base, *[c for c, _, kept in self.gate if kept]]
        row = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("s", F.stddev_samp), ("k", F.skewness))]).first()
        self.columns = [c for c in columns if (row[f"s_{c}"] or 0.0) >= least_sd]
        bent = [c for c in self.columns if abs(row[f"k_{c}"] or 0.0) > skewed]
        self.powers = fit_yeo_johnson(train, bent) if bent else {}
        t = train.select(*[self._bent(c).alias(c) for c in self.columns])
        row = t.agg(*[f(c).alias(f"{n}_{c}") for c in self.columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first() if self.columns else {}
        self.scale = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in self.columns}

    def _bent(self, c: str) -> Column:
        x = F.col(c).cast("double")
        return yeo_johnson(x, F.lit(self.powers[c])) if c in self.powers else x

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *[((self._bent(c) - self.scale[c][0]) / self.scale[c][1]).alias(c) for c in self.columns])
