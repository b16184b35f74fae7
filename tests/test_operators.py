import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import aggregates as A
from cohortlake.operators import graph as G
from cohortlake.operators import joins as J
from cohortlake.operators import multivariate as M
from cohortlake.operators import statistics as T
from cohortlake.operators import windows as W
from cohortlake.plans import registry
from cohortlake.session import Scratch, blocked_cumsum


def test_blocked_cumsum(spark):
    random.seed(0)
    rows = [(random.choice(["a", "b", None]), i, random.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): r.c for r in blocked_cumsum(df, ["k"], ["i"], F.floor(F.col("i") / 40).cast("int"), F.col("v"), "c", 8).collect()}
    for k in ("a", "b", None):
        total = 0
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            assert got[k, i] == total
            total += v


def test_average_rank_ties_nulls_and_clashing_names(spark):
    rows = [("a", 3.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("a", None, 4), ("b", 7.0, 5)]
    df = spark.createDataFrame(rows, "g string, v double, extra int")
    got = {r.extra: r["rank"] for r in W.average_rank(df, ["g"], "v").collect()}
    assert got == {2: 1.0, 1: 2.5, 3: 2.5, 5: 1.0}
    assert W.average_rank(df.limit(0), ["g"], "v").count() == 0


def test_tertile_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 1, 1, 2, 3, 4)] + [("a", None)], "g string, v double")
    got = sorted((r.v, r.tertile) for r in W.tertile(df, ["g"], "v").where("v is not null").collect())
    assert got == [(1.0, 1), (1.0, 1), (1.0, 1), (2.0, 2), (3.0, 3), (4.0, 3)]


def test_rank_contrast_matches_brute_force(spark):
    random.seed(1)
    a, b = [random.randint(0, 6) for _ in range(25)], [random.randint(2, 9) for _ in range(40)]
    df = spark.createDataFrame([("f", "a", float(v)) for v in a] + [("f", "b", float(v)) for v in b] + [("f", "a", None), ("only", "a", 1.0)], "feature string, g string, v double")
    got = {r.feature: r for r in T.rank_contrast(df, ["feature"], "g", "a", "b", "v").collect()}
    delta = sum((x > y) - (x < y) for x, y in itertools.product(a, b)) / (len(a) * len(b))
    assert got["f"].cliffs_delta == pytest.approx(delta) and got["only"].u is None
    p = T.with_normal_p(T.rank_contrast(df, ["feature"], "g", "a", "b", "v")).where("feature = 'f'").first().p
    assert 0 < p < 0.01


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.5])], "f string, i int, p double")
    got = {r.i: r.p_adjusted for r in W.benjamini_hochberg(df, ["f"], "p", "i").collect()}
    assert got == pytest.approx({0: 0.04, 2: 0.04 * 4 / 3, 1: 0.04 * 4 / 3, 4: 0.5})


def test_nearest_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, "p", 1.0), (2, "p", 1.5), (3, "p", 9.0), (4, "q", 0.0), (5, "p", None)], "id int, pid string, z double")
    right = spark.createDataFrame([("p", 7, 1.0), ("p", 8, 2.0), ("p", 9, 7.5)], "pid string, s int, sz double")
    got = {r.id: (r.matched, r.distance) for r in J.nearest(left, right, ["pid"], "z", "sz", "s", F.lit(1.5), "id").collect()}
    assert got == {1: (7, 0.0), 2: (7, 0.5), 3: (9, 1.5), 4: (None, None), 5: (None, None)}


def test_range_edges_match_brute_force(spark):
    random.seed(2)
    rows = [(i, random.choice("pq"), random.randint(0, 4), random.uniform(0, 20), random.uniform(0, 20)) for i in range(120)]
    df = spark.createDataFrame(rows + [(999, "p", None, 1.0, 1.0)], "id int, pid string, s int, x double, y double")
    got = {(r.a, r.b) for r in J.range_edges(df, ["pid"], "id", "s", "x", "y", 1, 5.0).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and abs(a[2] - b[2]) <= 1 and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 25}
    assert got == want


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], []), (None, [1])], "a array<int>, b array<int>")
    assert [round(r.jaccard, 6) for r in J.set_overlap(df, "a", "b").collect()] == [0.333333, 1.0, 0.0]


def test_icc_perfect_shift_and_noise(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=200)
    fam = {"same": [base, base, base], "shift": [base, base + 10], "noise": [rng.normal(size=200) for _ in range(3)], "constant": [np.ones(5), np.ones(5)]}
    rows = [(f, i, k, float(v)) for f, cols in fam.items() for k, c in enumerate(cols) for i, v in enumerate(c)] + [("same", 777, 0, 1.0)]
    got = {r.f: r.icc for r in T.icc(spark.createDataFrame(rows, "f string, s int, k int, v double"), ["f"], "s", "k", "v").collect()}
    assert got["same"] == pytest.approx(1) and got["shift"] < 0.1 and abs(got["noise"]) < 0.15 and got["constant"] is None


def test_chi_square_yates_and_ari(spark):
    df = spark.createDataFrame([("g", a, b) for a, b, n in (("x", "u", 10), ("x", "v", 20), ("y", "u", 30), ("y", "v", 5)) for _ in range(n)], "g string, a string, b string")
    r = T.chi_square(df, ["g"], "a", "b").first()
    o, e = np.array([[10, 20], [30, 5]]), None
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert r.dof == 1 and r.chi2 == pytest.approx(((abs(o - e) - 0.5) ** 2 / e).sum())
    assert T.adjusted_rand(df.withColumn("c", F.concat(F.lit("_"), "a")), ["g"], "a", "c").first().ari == pytest.approx(1)


def test_kendall_matches_brute_force(spark):
    random.seed(3)
    xy = [(random.randint(0, 4), random.randint(0, 3)) for _ in range(60)]
    df = spark.createDataFrame([("g", *p) for p in xy] + [("g", None, 1)], "g string, x int, y int")
    s = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for a, b in itertools.combinations(xy, 2))
    tx = sum(a[0] == b[0] for a, b in itertools.combinations(xy, 2))
    ty = sum(a[1] == b[1] for a, b in itertools.combinations(xy, 2))
    n0 = len(xy) * (len(xy) - 1) / 2
    assert T.kendall_tau_b(df, ["g"], "x", "y").first().tau == pytest.approx(s / np.sqrt((n0 - tx) * (n0 - ty)))


def test_burden_of_nothing_and_nulls(spark):
    rois = spark.createDataFrame([("p", "LAD", 0.1, 450.0), ("p", None, 0.5, 450.0), ("q", "RCA", None, 300.0)], "pid string, territory string, area_cm2 double, max_hu double")
    th = spark.createDataFrame([("p", 3.0)], "pid string, slice_thickness double")
    got = {r.pid: (r.lad, r.total, r.risk) for r in A.burden(rois, th).collect()}
    assert got == {"p": (40.0, 40.0, "mild"), "q": (0.0, 0.0, "zero")}
    assert A.burden(rois.limit(0), th).count() == 0


def test_label_mapping_ties(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 1), ("c", "x", 1)], "g string, l string, v int")
    got = {r.g: (r.low, r.high, r.balanced) for r in A.label_mapping(df, ["g"], "l", "v").collect()}
    assert got == {"a": ("x", "y", True), "b": (None, None, True), "c": (None, None, False)}


def matrix(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))


def test_components_are_orthonormal_signed_and_ordered(spark):
    x = np.random.default_rng(1).normal(size=(200, 4)) @ np.diag([3, 2, 1, 0.5])
    load, share = M.components(matrix(spark, x), ["c0", "c1", "c2", "c3"], 3)
    assert np.allclose(load @ load.T, np.eye(3), atol=1e-9) and (np.diff(share) <= 0).all()
    assert (load[np.arange(3), np.abs(load).argmax(1)] > 0).all()


def test_hopkins_clustered_against_uniform(spark):
    rng = np.random.default_rng(2)
    tight = np.vstack([rng.normal(size=(150, 2)) * 0.02 + c for c in ((0, 0), (5, 5), (0, 5))])
    high = M.hopkins(matrix(spark, tight), ["c0", "c1"], "id").first().hopkins
    flat = M.hopkins(matrix(spark, rng.uniform(size=(450, 2))), ["c0", "c1"], "id").first().hopkins
    assert high > 0.9 and 0.35 < flat < 0.65


def test_hopkins_equals_brute_force_in_any_cells(spark):
    x = np.random.default_rng(4).normal(size=(180, 3))
    x = np.vstack([x, x[:20]])  # repeated rows
    df, cols = matrix(spark, x), ["c0", "c1", "c2"]
    h = np.array([r.h for r in df.select(F.xxhash64(F.lit(42), "id").alias("h")).collect()])
    pick, low, high = M._unit(h, 42) < 0.5, x.min(0), x.max(0)
    box = np.column_stack([low[c] + M._unit(h[pick], 43 + c) * (high[c] - low[c]) for c in range(3)])
    second = lambda q: np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 1].sum()
    u, w = second(box), second(x[pick])
    for size in ({}, {"cells": 2}, {"cells": 40, "chunk": 7}):
        assert abs(M.hopkins(df, cols, "id", least=100, **size).first().hopkins - u / (u + w)) < 1e-9
    assert M.hopkins(df.limit(2), cols, "id").first().hopkins is None
    assert M.hopkins(df.withColumns({c: F.lit(1.0) for c in cols}), cols, "id").first().hopkins == 0.5


def test_two_nearest_measures_few_rows_and_misses_none(monkeypatch):
    rng = np.random.default_rng(12)
    centre = rng.uniform(-3, 3, (40, 6))
    rows = 1e4 + centre[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 6)) * 0.05
    rows[:600] = rows[0]  # copies fill leaves
    points = np.vstack([rows[rng.integers(0, 20_000, 150)], rows[:3], 1e4 + rng.uniform(-4, 4, (150, 6))])
    want = np.array([np.sort(np.sqrt(((rows - q) ** 2).sum(1)))[:2] for q in points])
    got = M._two_nearest(points, rows, np.full(len(points), np.inf))
    assert np.abs(got - want).max() < 1e-6
    most = want[:, 1] * np.where(np.arange(len(points)) % 2, 1.0, 0.5)
    some = M._two_nearest(points, rows, most, leaf=16)
    inside = want <= most[:, None]
    assert np.abs(some[inside] - want[inside]).max() < 1e-6 and (some >= want - 1e-6).all()
    assert np.isinf(M._two_nearest(points[:2], rows[:1], np.full(2, np.inf))[:, 1]).all()
    measured = []
    monkeypatch.setattr(M, "_products", lambda a, b: measured.append(len(a) * b.shape[1]) or a @ b)
    M._two_nearest(points, rows, np.full(len(points), np.inf))
    assert sum(measured) < len(points) * len(rows) / 5


def test_consensus_counts_all_pairs(spark):
    rng = np.random.default_rng(5)
    df = matrix(spark, np.vstack([rng.normal(size=(40, 2)) * 0.1 + c for c in ((0, 0), (5, 5), (0, 5))]))
    got = {r.k: (int(r.n_pairs), r.pac) for r in M.consensus(df, ["c0", "c1"], "id", ks=(2, 3), replicates=10).collect()}
    assert got[3] == (120 * 119 // 2, 0.0) and got[2][0] == got[3][0]
    small = {r.k: (int(r.n_pairs), r.pac) for r in M.consensus(df.repartition(5), ["c0", "c1"], "id", ks=(2, 3), replicates=10, block=3).collect()}
    assert small == got
    assert M.consensus(df.limit(1), ["c0", "c1"], "id").count() == 0


def test_gap_and_stability_find_three_clusters(spark):
    rng = np.random.default_rng(3)
    df = matrix(spark, np.vstack([rng.normal(size=(60, 2)) * 0.1 + c for c in ((0, 0), (5, 5), (0, 5))]))
    gaps = M.gap_statistic(df, ["c0", "c1"], "id", ks=(1, 2, 3, 4), replicates=6).withColumn("s_", F.lit(1))
    assert T.select_k(Scratch(spark, "t").save(gaps, "g"), ["s_"]).first().k == 3
    assert all(r.stable for r in M.cluster_stability(df, ["c0", "c1"], "id", 3, replicates=8).collect())
    one = {r.k: r.gap for r in M.gap_statistic(df.repartition(5), ["c0", "c1"], "id", ks=(1, 2, 3, 4), replicates=6).collect()}
    assert one == {r.k: r.gap for r in gaps.collect()}


def test_gap_and_stability_see_a_cluster_of_a_thousandth_of_the_rows(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(6000, 2)) * 0.01, rng.normal(size=(6, 2)) * 0.01 + 50])
    df = matrix(spark, x)
    got = {r.k: r.log_w for r in M.gap_statistic(df, ["c0", "c1"], "id", ks=(1, 2), replicates=2).collect()}
    want = [((x - x.mean(0)) ** 2).sum(), sum(((y - y.mean(0)) ** 2).sum() for y in (x[:6000], x[6000:]))]
    assert np.allclose([got[1], got[2]], np.log(want), atol=1e-4)
    assert len(M.cluster_stability(df, ["c0", "c1"], "id", 2, replicates=4).collect()) == 2


def test_combat_removes_batch_shift(spark):
    rng = np.random.default_rng(4)
    rows = [(b, float(v + 5 * i), float(w)) for i, b in enumerate("xyz") for v, w in rng.normal(size=(80, 2))]
    df = spark.createDataFrame(rows, "b string, c0 double, c1 double")
    fixed = M.combat(df, "b", ["c0", "c1"])
    long = T.long_form(fixed, ["b"], ["c0"])
    assert T.r2_by_batch(long, ["feature"], "b").first().r2 < 0.02
    with pytest.raises(ValueError):
        M.combat(df.unionByName(spark.createDataFrame([("w", 1.0, 1.0)], df.schema)), "b", ["c0"])


def test_yeo_johnson_fit_and_redundancy(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=400)
    df = matrix(spark, np.column_stack([np.exp(z) - 1, z, z + rng.normal(size=400) * 0.01, rng.normal(size=400), np.ones(400)]))
    fit = M.fit_yeo_johnson(df, ["c0", "c1", "c4"])
    assert fit["c0"] < 0.2 and abs(fit["c1"] - 1) < 0.3 and fit["c4"] == 1.0
    got = {r.feature: (r.cluster, r.representative) for r in M.redundancy(df, ["c0", "c1", "c2", "c3"], "id").collect()}
    assert got["c0"][0] == got["c1"][0] == got["c2"][0] != got["c3"][0] and got["c0"][1] and not got["c1"][1]


def test_caliper_match_takes_turns(spark):
    random.seed(6)
    cases = [(f"a{i:02d}", round(random.uniform(0, 5), 3)) for i in range(15)]
    controls = [(f"k{i:02d}", round(random.uniform(0, 5), 3)) for i in range(30)]
    free, want = dict(controls), set()
    for c, v in sorted(cases):
        near = sorted((abs(v - w), k) for k, w in free.items() if abs(v - w) <= 0.4)[:2]
        for _, k in near:
            want.add((c, k))
            del free[k]
    mk = lambda rows: spark.createDataFrame([("s", *r) for r in rows] + [("s", "null" + rows[0][0], None)], "g string, pid string, v double")
    got = {tuple(r) for r in M.caliper_match(mk(cases), mk(controls), ["g"], "pid", "v", 0.4, 2, Scratch(spark, "t")).collect()}
    assert got == want


def test_touch_edges_of_a_dense_patient_have_the_components_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [("QA-PHANTOM-1", i, rng.randint(0, 1), rng.gauss(60, 3), rng.gauss(60, 3)) for i in range(250)]
    rows += [("QA-PHANTOM-1", 250 + i, rng.randint(0, 9), rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(150)]
    rows += [("P1", 400 + i, rng.randint(0, 5), rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(60)] + [("P2", 460, 3, 1.0, 1.0), ("P2", 461, 4, 4.0, 5.0), ("P2", 462, 5, 7.0, 9.1), ("P2", 463, None, 4.0, 5.0)]
    touch = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 1 and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 25]
    root = {r[1]: r[1] for r in rows}
    find = lambda k: k if root[k] == k else find(root[k])
    for a, b in touch:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(rows, "pid string, id int, s int, x double, y double")
    edges = G.touch_edges(df, ["pid"], "id", "s", "x", "y", 1, 5.0)
    assert edges.count() < len(touch) / 5
    ends = {k for e in touch for k in e}
    assert {(r.node, r.root) for r in G.components(edges, scratch=Scratch(spark, "t")).collect()} == {(k, find(k)) for k in ends}


def test_queries_over_all_patients_have_the_phantom(spark, sf):
    edges, groups = (registry.QUERIES[n](spark, sf).where("pid = 'QA-PHANTOM-1'").collect() for n in ("region_edges_all", "lesion_groups_all"))
    assert len(edges) > 0 and sum(r.n_rois for r in groups) == 136  # its normalised and placed regions
