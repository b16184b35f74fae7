import random

import numpy as np

from cohortlake.llm.components import connected_components, region_edges, union_find
from cohortlake.llm.splits import assign, contract, leaks, persons, person_number


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_union_find_matches_brute_force():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    ids, roots = union_find(u, v)
    want = brute(zip(u.tolist(), v.tolist()))
    assert all(want.get(int(i), int(i)) == r for i, r in zip(ids, roots))


def test_components_over_many_levels_chains_hubs_nulls_and_repeats(spark):
    random.seed(1)
    ids = list(range(1, 400))
    random.shuffle(ids)
    pairs = list(zip(ids[:150], ids[1:151]))  # a long chain
    pairs += [(900, x) for x in range(1000, 1150)]  # a hub
    pairs += [(a, b) for a, b in zip(ids[200:260:2], ids[201:260:2])] + [(5, 5), (None, 7), (8, None), pairs[0], pairs[0][::-1]]
    df = spark.createDataFrame([(a, b, "p") for a, b in pairs], "u long, v long, near string")
    want = brute(pairs)
    for bound in (60, 10_000):
        got = {r.vertex: r.root for r in connected_components(df, near="near", bound=bound).collect()}
        assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_region_edges_ignore_strangers_and_false_matches(spark):
    rois = spark.createDataFrame([(1, "a", 0, 0, "x"), (2, "a", 0, 1, "x"), (3, "a", 1, 0, "x"), (3, "a", 1, 0, "x")], "roi_id long, pid string, image_index int, roi_idx_in_slice int, near string")
    links = spark.createDataFrame([("a", 1, 2, True), ("a", 2, 3, False), ("a", 3, 99, True), ("a", 1, 3, None)], "pid string, roi_a long, roi_b long, is_match boolean")
    les = spark.createDataFrame([("a", [(0, 1), (1, 0), (7, 7)]), ("a", None), ("b", [(0, 0), (0, 1)])], "pid string, roi_keys array<struct<image_index:int,roi_idx:int>>")
    got = {(r.u, r.v) for r in region_edges(rois, links, les).collect()}
    assert got == {(1, 2), (2, 3)}


def test_contraction_matches_brute_force(spark):
    random.seed(2)
    pairs = [(f"k{random.randrange(120)}", f"k{random.randrange(120)}") for _ in range(90)] + [("hub", f"h{i}") for i in range(60)] + [("z", "z"), (None, "y")]
    got = contract(spark.createDataFrame(pairs, "a string, b string")).collect()
    comp = {r.vertex: r.component for r in got}
    want = brute(pairs)
    assert len(got) == len(comp) and set(comp) == set(want)
    assert len({(want[x], comp[x]) for x in comp}) == len(set(want.values())) == len(set(comp.values()))
    assert contract(spark.createDataFrame([], "a string, b string")).count() == 0


def test_person_numbers(spark):
    cases = [("S000500201", "500201"), ("s-13", "13"), ("subj 88 ", "88"), ("S502288.0", "502288"), ("000000000088", "88"), ("S000000000", None), ("N/A", None), ("anonymous", None), (None, None), ("", None), ("UNKNOWN", None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    got = {r.i: r.p for r in df.select("i", person_number(df.s).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_leaks_follow_persons(spark):
    man = spark.createDataFrame([("1", "S0001", None, "u1"), ("2", "subj 1", None, "u2"), ("3", None, "2 ", "u3"), ("4", "N/A", None, "u4"), ("5", "N/A", "77", "u4"), ("6", None, None, None), ("7", None, None, None)], "pid string, subject_id string, prior_pid string, series_uid string")
    splits = spark.createDataFrame([("s", 0, ["1", "4", None], [" 3", "5", "6", "6", "9"]), ("s", 1, None, ["1"]), ("t", 0, ["9 "], ["9", "7"])], "split_id string, fold int, train_pids array<string>, test_pids array<string>")
    got = {tuple(r) for r in leaks(splits, persons(man)).collect()}
    assert got == {("s", 0, "3"), ("s", 0, "5"), ("t", 0, "9")}


def test_assign_keeps_persons_and_shares(spark):
    rows = [(f"p{i}", f"q{i // 3}", "ab"[i % 2]) for i in range(900)] + [(f"x{i}", "giant", None) for i in range(300)]
    got = assign(spark.createDataFrame(rows, "pid string, person string, stratum string")).toPandas()
    assert len(got) == 1200 and got.groupby("person").side.nunique().max() == 1
    share = got[got.person != "giant"].side.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.06 and share["validation"] > 0.05 and share["test"] > 0.05
