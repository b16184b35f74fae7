import math
import random

import numpy as np

from cohortlake.llm.mixing import mix, poisson_count
from cohortlake.llm.packing import CLASSES, WINDOWS, combinations, pack, pack_documents, pieces, solve_repeats
from cohortlake.llm.percentiles import outside, percentiles
from cohortlake.llm.tokens import count_tokens, with_tokens
from pyspark.sql import functions as F


def test_percentiles_are_order_statistics_of_all_parts(spark):
    random.seed(3)
    inf, nan = float("inf"), float("nan")
    groups = {"a": [random.gauss(0, 1) for _ in range(501)], "ties": [2.0] * 40 + [3.0] * 2, "wide": [10.0**k for k in range(-300, 300, 7)], "one": [5.0], "inf": [-inf, -1.0, 0.0, 1.0, inf], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", nan), ("none", None)]
    random.shuffle(rows)
    parts = [spark.createDataFrame(rows[i::3], "g string, value double") for i in range(3)]
    qs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = {r.g: (r.n, r.p10, r.p50, r.p90) for r in percentiles(parts, ["g"], qs).collect()}
    want = {g: (len(v), *[sorted(v)[max(1, math.ceil(q * len(v) - 1e-9)) - 1] for q in qs.values()]) for g, v in groups.items() if v}
    assert got == want


def test_outside_follows_its_definition(spark):
    vals = [float(v) for v in range(1, 51)]
    pub = [(i, v) for i, v in enumerate([float(m) for m in range(0, 52)] + [float("nan"), None])]
    part = spark.createDataFrame([(i, v) for i, _ in pub for v in vals], "g int, value double")
    got = {r.g for r in outside([part], spark.createDataFrame([*pub, (999, 1.0)], "g int, p50 double"), ["g"], {"p50": 0.5}).collect()}
    want = {i for i, v in pub if v is not None and (v != v or sum(x <= v for x in vals) / 50 < 0.42 - 1e-9 or sum(x >= v for x in vals) / 50 < 0.42 - 1e-9)}
    assert got == want and 0 < len(want) < len(pub)


def test_tokens_null_empty_long(spark):
    text = "The quick brown fox. " * 12_000
    assert count_tokens(None) == count_tokens("") == 0
    from cohortlake.llm.tokens import RANKS, encoding

    assert count_tokens(text) == len(encoding(RANKS).encode_ordinary(text))
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "hello <|endoftext|>", None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_tokens for r in with_tokens(df).collect()}.keys() == {1, 2, 3}


def test_combinations_fill_the_window_and_repeats_are_feasible():
    c = combinations()
    assert set(c.sum(1)) == set(range(CLASSES - WINDOWS[-1], CLASSES + 1)) and len({tuple(x) for x in c.tolist()}) == len(c)
    h = np.zeros(CLASSES + 1)
    h[[40, 44, 88, 128]] = [50, 40, 30, 3]
    r = solve_repeats(c, h)
    used = sum(np.bincount(c[:, k], weights=r, minlength=CLASSES + 1) for k in range(3))
    assert (used[1:] <= h[1:]).all() and r.sum() > 30


def test_packing_places_every_item_once_within_capacity(spark):
    random.seed(4)
    sizes = [random.choice([3, 17, 60, 60, 60, 200, 300, 511, 512]) for _ in range(700)] + [0, None, 600]
    items = spark.createDataFrame([(f"i{n}", s) for n, s in enumerate(sizes)], "item string, size int")
    for capacity in (512, 4096):
        got = pack(items.where("size <= 512"), capacity, block_items=150).toPandas()
        assert len(got) == 700 and got.item.is_unique
        fill = got.groupby("container")["size"].sum()
        assert fill.max() <= capacity and len(fill) <= 1.1 * math.ceil(fill.sum() / capacity) + 1
    assert pack(items.limit(0), 512).count() == 0


def test_short_items_are_placed_by_combinations_of_bundles(spark):
    random.seed(7)
    items = spark.createDataFrame([(f"i{n}", min(8000, int(random.lognormvariate(5, 0.8)) + 1)) for n in range(6000)], "item string, size int")
    got = pack(items, 8192).toPandas()
    solved = got[got.container.str.startswith("c")]["size"].sum() / got["size"].sum()
    fill = got.groupby("container")["size"].sum()
    assert len(got) == 6000 and fill.max() <= 8192 and solved > 0.9 and fill.sum() / (len(fill) * 8192) > 0.97


def test_long_texts_are_counted_as_a_whole():
    from cohortlake.llm.tokens import RANKS, encoding

    for text in ("x" * 250_000, ("word" * 300 + "  ") * 150, " " * 120_000 + "a " * 70_000, "ab\n" * 60_000):
        assert count_tokens(text) == len(encoding(RANKS).encode_ordinary(text))


def test_only_long_documents_are_cut(spark):
    d = spark.createDataFrame([(1, 100), (2, 1025), (3, 0), (4, None), (5, 512), (1, 100)], "doc_id long, n_tokens long")
    got = sorted((r.doc_id, r.piece, r.size) for r in pieces(d, 512).collect())
    assert got == [(1, 0, 100), (2, 0, 512), (2, 1, 512), (2, 2, 1), (5, 0, 512)]
    packs = pack_documents(d, [("a", 512), ("b", 2048)]).toPandas()
    assert packs.groupby("pack_name")["size"].sum().to_dict() == {"a": 1637, "b": 1637}


def test_poisson_inverse(spark):
    us = [0.01, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(u, r, c) for u in us for r in (0.2, 1.0, 3.0) for c in (1, 2, 50)], "u double, r double, c int")
    for row in df.withColumn("k", poisson_count(F.col("u"), F.col("r"), F.col("c"))).collect():
        k, cdf = 0, math.exp(-row.r)
        while cdf < row.u:
            k += 1
            cdf += math.exp(-row.r) * row.r**k / math.factorial(k)
        assert row.k == min(k, row.c)


def test_mix_reaches_shares_within_caps(spark):
    random.seed(5)
    docs = [(i, s, random.randint(1, 60)) for i, s in enumerate(["big"] * 1500 + ["mid"] * 600 + ["small"] * 80 + ["stray"] * 30)] + [(9999, None, 5), (9998, "big", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 2), ("off", None, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mix(sized, targets)
    m, s = mixed.toPandas(), shares.toPandas().set_index("source")
    assert (m.groupby("doc_id").copy.max() <= m.groupby("doc_id").source.first().map({"big": 1, "mid": 2, "small": 4})).all()
    assert set(m.source) == {"big", "mid", "small"}
    for name in ("big", "mid", "small"):
        assert abs(s.actual_share[name] - s.target_share[name]) < 0.02
    assert s.tokens_used["absent"] == 0
    again, _ = mix(sized.repartition(7), targets)
    assert again.toPandas()[["doc_id", "copy"]].equals(m[["doc_id", "copy"]])
