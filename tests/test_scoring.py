import math

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import scoring as S
from cohortlake.functions import tails


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = {r.i: r.o for r in df.select("i", fn(F.col("v")).alias("o")).collect()}
    return [got[i] for i in range(len(values))]


def test_thresholds(spark):
    hu = [129.0, 130.0, 199.0, 200.0, 300.0, 400.0, 1000.0, None]
    assert column(spark, hu, "double", S.density_factor) == [1, 1, 1, 2, 3, 4, 4, None]
    assert column(spark, hu, "double", S.density_tier) == [None, "d1", "d1", "d2", "d3", "d4", "d4", None]
    assert column(spark, [0.0, 0.5, 99.9, 100.0, 399.9, 400.0], "double", S.risk_class) == ["zero", "mild", "mild", "moderate", "moderate", "severe"]
    assert column(spark, [0.0, 0.5, 1.0, 99.5, 100.0, 400.0], "double", S.score_category) == ["0", None, "1-99", None, "100-399", ">=400"]


def test_roi_score(spark):
    df = spark.createDataFrame([(0.1, 129.0, 3.0), (0.1, 130.0, 3.0), (0.1, 450.0, 1.5), (0.0, 500.0, 3.0), (0.1, 500.0, None), (None, 500.0, 3.0)], "a double, h double, t double")
    assert [round(r[0], 9) for r in df.select(S.roi_score(F.col("a"), F.col("h"), F.col("t"))).collect()] == [0, 10, 20, 0, 0, 0]


def test_gini(spark):
    got = column(spark, [[1.0, 2.0, 3.0, 10.0], [], [5.0], [0.0, 0.0], [1.0, None, 1.0]], "array<double>", S.gini)
    assert [round(g, 9) for g in got] == [0.4375, 0, 0, 0, 0]


def test_text_clean_up(spark):
    assert column(spark, ["Hr32d\\2", " J28F/3 ", "['J28f', '3']", "B33f", "", None], "string", S.kernel_key) == ["hr32d/2", "j28f/3", "j28f/3", "b33f", "none", "none"]
    assert column(spark, ["(1, 2.5, -3)", "(1, 2)", "(a, 2, 3)", "", None], "string", S.centre)[0].asDict() == {"x": 1.0, "y": 2.5, "z": -3.0}
    assert column(spark, ["(1, 2)", "(a, 2, 3)", "", None], "string", S.centre) == [None] * 4
    df = spark.createDataFrame([("10",), ("9",), ("X1",), ("0008",), ("A",)], "p string")
    assert [r.p for r in df.orderBy(*S.natural_order(F.col("p"))).collect()] == ["0008", "9", "10", "A", "X1"]


def test_prefix_families_and_blocks(spark):
    assert column(spark, ["glcm_a", "shape_b", "x"], "string", lambda c: S.first_prefix(c, {"glcm": "texture", "shape": "shape"})) == ["texture", "shape", "Other"]
    blocks = {"a": {"prefixes": ["t_"], "exclude": ["t_x"]}, "b": {"names": ["t_x", "y"]}}
    assert [S.block_of(n, blocks) for n in ("t_1", "t_x", "y", "z")] == ["a", "b", "b", None]
    with pytest.raises(ValueError):
        S.block_of("t_1", blocks | {"c": {"names": ["t_1"]}})


def test_transforms(spark):
    for lam in (0.0, 0.5, 1.0, 2.0):
        want = [((x + 1) ** lam - 1) / lam if x >= 0 and lam else math.log1p(x) if x >= 0 else -(((1 - x) ** (2 - lam)) - 1) / (2 - lam) if lam != 2 else -math.log1p(-x) for x in (-3.0, -0.5, 0.0, 2.0)]
        assert column(spark, [-3.0, -0.5, 0.0, 2.0], "double", lambda c, lam=lam: S.yeo_johnson(c, F.lit(lam))) == pytest.approx(want)
    (clr,) = column(spark, [[2.0, 2.0, 0.0]], "array<double>", lambda c: S.centred_log_ratio(c, F.lit(4.0)))
    assert sum(clr) == pytest.approx(0) and clr[0] == clr[1] > clr[2]
    assert column(spark, [[0.0, 0.0]], "array<double>", lambda c: S.centred_log_ratio(c, F.lit(1.0))) == [None]
    with pytest.raises(ValueError):
        S.clip(F.col("v"), 1, 1)


def test_polygon_centroid(spark):
    rows = [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], [(1.0, 1.0), (3.0, 3.0)], [(2.0, 5.0)], []]
    got = column(spark, rows, "array<struct<x:double,y:double>>", S.polygon_area_centroid)
    assert [tuple(g) if g else None for g in got] == [(8.0, 2.0, 1.0), (0.0, 2.0, 2.0), (0.0, 2.0, 5.0), None]


def test_wilson_and_tails(spark):
    assert spark.range(1).select(S.wilson(F.lit(5.0), F.lit(10.0))).first()[0].low == pytest.approx(0.236593, abs=1e-6)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9) and tails.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    df = spark.createDataFrame([(2.0, 10.0), (None, 1.0)], "a double, b double")
    assert [r[0] is None for r in df.select(tails.t_p("a", "b")).collect()] == [False, True]
