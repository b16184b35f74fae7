import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import joins as J
from cohortlake.operators import multivariate as M
from cohortlake.operators import preparation as P
from cohortlake.operators import verdicts as V
from cohortlake.operators import windows as W


def test_quantiles_equal_linear_percentiles_with_ties_nulls_and_one_row(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=301).round(1).tolist(), "b": [2.0], "c": [1.0, 1.0, 5.0], None: [3.0, 4.0], "z": [None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None)]
    qs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: [r[n] for n in qs] for r in W.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs).collect()}
    assert set(got) == set(groups) and got["z"] == [None] * 5
    for g, vs in groups.items():
        if g != "z":
            assert got[g] == pytest.approx([np.quantile(vs, q) for q in qs.values()])
    whole = W.quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_steps_gaps_and_cuts_run_over_block_edges(spark):
    rng = np.random.default_rng(1)
    pts = [("g", int(i), *map(float, p)) for i, p in enumerate(rng.normal(size=(400, 3)))] + [("one", 900, 1.0, 2.0, 3.0), ("g", 901, None, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "g string, k long, x double, y double, z double")
    got = {r.g: r for r in W.consecutive_distances(df, ["g"], "x", "y", "z", "k").collect()}
    p = np.array(sorted((z, x, y) for g, _, x, y, z in pts if g == "g" and x is not None))
    steps = np.linalg.norm(np.diff(p, axis=0), axis=1)
    assert got["g"].n == 400 and got["g"].mean_step == pytest.approx(steps.mean()) and got["g"].max_step == pytest.approx(steps.max())
    assert got["g"].span == pytest.approx(np.linalg.norm(p[-1] - p[0])) and (got["one"].n, got["one"].mean_step) == (1, 0.0)
    v = np.array(sorted(x for g, _, x, _, _ in pts if g == "g" and x is not None))
    gap = {r.g: r for r in W.largest_gap(df, ["g"], "x").collect()}
    assert gap["g"].gap == pytest.approx(np.diff(v).max()) and gap["g"].below == pytest.approx(v[np.diff(v).argmax()]) and "one" not in gap
    w = df.withColumn("w", F.abs("x"))
    big = np.sort(np.abs(v))[::-1]
    cut = {r.g: r.k for r in W.cumulative_cut(w, ["g"], "w", "k", 0.8).collect()}
    assert cut["g"] == int(np.flatnonzero(np.cumsum(big) >= 0.8 * big.sum() - 1e-9)[0]) + 1 and cut["one"] == 1
    assert [r.rank for r in W.rank_sample(df, "x", "k", 3).orderBy("rank").collect()] == [0, 200, 400]


def test_edges_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    pts = [(i, "p" if i % 9 else None, int(rng.integers(0, 30)), *map(float, rng.uniform(-30, 30, 2))) for i in range(300)] + [(900, "p", None, 0.0, 0.0), (901, "p", 1, None, 0.0)]
    got = {(r.a, r.b) for r in J.range_edges(spark.createDataFrame(pts, "k long, g string, s int, x double, y double"), ["g"], "k", "s", "x", "y", 1, 5.0).collect()}
    ok = [p for p in pts if p[1] and None not in p]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and abs(a[2] - b[2]) <= 1 and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 25}
    assert got == want and len(want) > 20


def test_gate_of_explained_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    c = np.c_[x, x @ [1, 2], x[:, 0] + rng.normal(size=400), np.ones(400)]
    df = spark.createDataFrame(c.tolist(), "a double, b double, both double, noisy double, flat double")
    got = {n: (r, k) for n, r, k in P.r2_gate(df, ["a", "b"], ["both", "noisy", "flat"])}
    a = np.c_[x, np.ones(400)]
    res = c[:, 3] - a @ np.linalg.lstsq(a, c[:, 3], rcond=None)[0]
    assert got["both"] == (pytest.approx(1.0), False) and got["flat"] == (1.0, False) and got["noisy"] == (pytest.approx(1 - res.var() / c[:, 3].var()), True)


def test_preparation_learns_from_training_rows_alone(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(v), float(np.exp(2 * w))) for i, (v, w) in enumerate(rng.normal(size=(500, 2)))], "id long, a double, b double")
    train, rest = df.where("id < 400"), df.where("id >= 400")
    p = P.Preparation(train, ["a"], ["b"])
    t = p.transform(train, ["id"]).toPandas()
    assert np.allclose(t[p.columns].mean(), 0, atol=1e-9) and np.allclose(t[p.columns].std(), 1) and "b" in p.powers
    far = p.transform(rest.withColumn("a", F.col("a") + 100), ["id"]).toPandas()
    assert far["a"].mean() > 50 and len(far) == 100


def test_binarise_keeps_places_and_require_fails(spark):
    df = spark.createDataFrame([("x", 2, 0.5), ("y", 0, 1.5), ("z", None, 2.0)], "k string, n int, v double")
    b = P.binarise(df, ["n"])
    assert b.columns == ["k", "n_present", "v"] and [r.n_present for r in b.orderBy("k").collect()] == [1, 0, None]
    assert P.drop_sentinels(P.drop_sentinels(df, ["n"]), ["n"]).columns == ["k", "v"]
    assert P.require(df, "k", ["v"]).count() == 3
    with pytest.raises(Exception, match="incomplete row"):
        P.require(df, "k", ["n"]).collect()


def test_frozen_model_is_not_fitted_again(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=3) + (6 if i % 2 else 0))) for i in range(300)] + [(999, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    m = M.Frozen(df.where("id < 200"), ["a", "b", "c"])
    got = m.predict(df).toPandas().set_index("id")
    assert len(got) == 300 and len({(i % 2, v) for i, v in got.label.items()}) == 2
    alone = m.predict(df.where("id = 250")).first()
    assert alone.label == got.label[250] and alone.distance_0 == pytest.approx(got.distance_0[250])


def test_rules_gates_and_labels(spark):
    runs = spark.createDataFrame([("f", "a", 0.5, 0.01), ("f", "b", 0.3, 0.02), ("g", "a", 0.5, 0.01), ("g", "b", -0.3, 0.9), ("h", "a", 0.5, 0.01)], "feature string, run string, delta double, fdr double")
    got = {r.feature: (r.same_sign, r.significant, r.large, r.robust) for r in V.consistency_rules(runs, ["feature"], "run", ["a", "b"]).collect()}
    assert got == {"f": (True, True, True, True), "g": (False, False, True, False), "h": (False, False, False, False)}
    df = spark.createDataFrame([("c", "x", 1.0), ("c", "x", 2.0), ("c", "y", 5.0), ("d", "x", 1.0), (None, None, 3.0)], "g string, label string, v double")
    gate = {r.g: (r.passes, r.warns, r.balanced) for r in V.gate(df, ["g"], "label", "x", "v", 1.2).collect()}
    assert gate == {"c": (True, True, True), "d": (False, False, False)}
    mapping = spark.createDataFrame([("c", "x", "y"), ("d", None, None)], "g string, low string, high string")
    once = V.canonical_labels(df, mapping, ["g"], "label", "small", "large")
    assert sorted(r.canonical or "-" for r in once.collect()) == ["-", "-", "large", "small", "small"]
    again = V.canonical_labels(once.select("g", F.col("canonical").alias("label"), "v"), mapping.where("g = 'd'"), ["g"], "label", "small", "large")
    assert sorted(r.canonical or "-" for r in again.collect()) == ["-", "-", "large", "small", "small"]
    last = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 2, "c"), (None, 3, "d")], "k string, t int, label string")
    assert [tuple(r) for r in V.last_label(last, "k", "label", "t").collect()] == [("p", "c")]
    assert V.gate(df.limit(0), ["g"], "label", "x", "v", 1.0).count() == 0
    flat = V.continuum(spark.createDataFrame([("g", 1, 1.0), ("g", 2, 1.0), ("h", 1, 2.0), ("h", 2, 1.0), ("i", 1, 1.0)], "g string, o int, v double"), ["g"], "o", "v")
    assert {r.g: r.continuous for r in flat.collect()} == {"g": True, "h": False, "i": True}


def test_one_against_the_rest(spark):
    rows = [("a", "f", float(i)) for i in range(10)] + [("b", "f", float(i + 5)) for i in range(10)] + [("c", "f", 3.0), (None, "f", 99.0), ("a", "f", None)]
    got = {r.g: r for r in V.one_vs_rest(spark.createDataFrame(rows, "g string, feature string, value double"), "g").collect()}
    rest = [float(i + 5) for i in range(10)] + [3.0]
    delta = np.mean([np.sign(x - y) for x in range(10) for y in rest])
    assert set(got) == {"a", "b", "c"} and got["a"].cliffs_delta == pytest.approx(delta) and got["a"].n == 11 and got["a"].n_used == 10
    assert got["c"].insufficient and got["c"].cliffs_delta is None


def test_matching_in_drawn_order_takes_turns_in_few_rounds(spark):
    from cohortlake.session import Scratch

    rng = np.random.default_rng(6)
    cases, controls = [(f"a{i}", float(v)) for i, v in enumerate(rng.uniform(0, 3, 120))], [(f"b{i}", float(v)) for i, v in enumerate(rng.uniform(0, 3, 300))]
    mk = lambda rows: spark.createDataFrame([("k", *r) for r in rows], "g string, pid string, v double")
    s = Scratch(spark, "t")
    got = {tuple(r) for r in M.caliper_match(mk(cases), mk(controls), ["g"], "pid", "v", 0.1, 2, s, drawn=True).collect()}
    order = [r.pid for r in mk(cases).orderBy(F.xxhash64(F.lit(42), "pid"), "pid").collect()]
    free, want = dict(controls), set()
    for c in order:
        near = sorted((abs(free[k] - dict(cases)[c]), k) for k in free if abs(free[k] - dict(cases)[c]) <= 0.1)[:2]
        want |= {(c, k) for _, k in near}
        for _, k in near:
            del free[k]
    assert got == want and s.count < 40


@pytest.mark.parametrize("drawn", [True, False])
def test_matching_of_a_dense_group_with_ties_takes_one_pass(spark, drawn):
    from cohortlake.session import Scratch

    rng = np.random.default_rng(8)
    level = rng.uniform(0, 1, 40).round(2)  # of many rows each, some as far from a case on either side
    cases = [(g, f"a{g}{i}", float(rng.choice(level))) for g in "kl" for i in range(300)]
    controls = [(g, f"b{g}{i}", float(rng.choice(level))) for g in "kl" for i in range(700)] + [("k", f"c{i}", v) for i, v in enumerate((-0.0, 0.0, 1e-17, 5e-18))]
    odd = [("k", None, 0.5), ("k", "n", None), ("k", "nan", float("nan")), ("k", "inf", float("inf")), (None, "g", 0.5), ("m", "alone", 0.5)]
    mk = lambda rows: spark.createDataFrame(rows, "g string, pid string, v double")
    s = Scratch(spark, "t")
    got = M.caliper_match(mk(cases + odd), mk(controls + odd[:5]), ["g"], "pid", "v", 0.15, 3, s, drawn=drawn)
    want = set()
    at = {(g, k): v for g, k, v in cases}
    free = {(g, k): v for g, k, v in controls}
    order = mk(cases).orderBy(*([F.xxhash64(F.lit(42), "pid")] if drawn else []), "pid")
    for r in order.collect():
        near = sorted((abs(v - at[r.g, r.pid]), k) for (g, k), v in free.items() if g == r.g and abs(v - at[r.g, r.pid]) <= 0.15)[:3]
        want |= {(r.pid, k) for _, k in near}
        for _, k in near:
            del free[r.g, k]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and s.count == 1
    assert M.caliper_match(mk(cases[:3]).limit(0), mk(controls), ["g"], "pid", "v", 0.1, 2, s).count() == 0


def test_followup_of_the_match_takes_few_jobs(spark):
    from cohortlake.plans import registry

    spark.sparkContext.setJobGroup("followup", "t")
    try:
        row = registry.QUERIES["match_followup"](spark, "/root/testdata/sf0.01").where("test = 'balance'").first()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("followup"))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert (row.n_cases, row.n_controls) == (133, 361) and jobs < 100, jobs


def test_null_agreement_equals_simulated_flips():
    rng = np.random.default_rng(3)
    for ones, zeros in ((30, 70), (5, 95), (400, 500)):
        ref = np.r_[np.ones(ones, int), np.zeros(zeros, int)]
        n, pair, got = ones + zeros, lambda v: v * (v - 1) / 2, []
        for _ in range(4000):
            other = ref.copy()
            flip = rng.choice(n, n // 10, replace=False)
            other[flip] = 1 - other[flip]
            cells = np.bincount(ref * 2 + other, minlength=4)
            a, b = pair(np.bincount(ref)).sum(), pair(np.bincount(other)).sum()
            by_chance = a * b / pair(n)
            got.append((pair(cells).sum() - by_chance) / ((a + b) / 2 - by_chance))
        assert M.null_agreement(ones, zeros) == pytest.approx(np.percentile(got, 5), abs=0.02)
    assert M.null_agreement(4, 5) is None and M.null_agreement(0, 0) is None
    assert M.null_agreement(0, 50) is not None and M.null_agreement(50, 0) is not None


def test_match_checks_stop_or_go_on(spark):
    schema = "pid string, side string, burden double, agatston_lad double, agatston_total double, max_hu_global double"
    rows = [(f"a{i}", "case", float(i), 8.0, 10.0, 500.0 + i) for i in range(20)] + [(f"b{i}", "control", float(i), 2.0, 10.0, 300.0 + i) for i in range(20)]
    m = spark.createDataFrame(rows, schema)
    halves = spark.createDataFrame([(f"{s}{i}", (i % 4 > 0) == (s == "a")) for s in "ab" for i in range(20)], "pid string, lower boolean")
    got = {r.test: r for r in V.match_checks(25, m, halves, "burden").collect()}
    assert set(got) == {"balance", "lad_share", "max_hu", "lower_half"}
    assert got["balance"].p == 0.8 and got["balance"].effect == 0 and got["lad_share"].effect == 1 and got["max_hu"].p < 1e-6
    assert got["lower_half"].effect == pytest.approx(0.5) and got["lower_half"].p == pytest.approx(0.00444, abs=1e-4)
    assert [r.test for r in V.match_checks(100, m, halves, "burden").collect()] == ["balance"]  # too few
    assert [r.test for r in V.match_checks(25, m.withColumn("burden", F.when(F.col("side") == "case", F.col("burden") + 9).otherwise(F.col("burden"))), halves, "burden").collect()] == ["balance"]
    assert V.match_checks(25, m, halves.limit(0), "burden").where("test = 'lower_half'").first().p is None
    assert V.match_checks(0, m.limit(0), halves, "burden").first().effect is None
