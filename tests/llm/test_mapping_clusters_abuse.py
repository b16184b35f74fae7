import numpy as np
import pandas as pd

from cohortlake.llm.abuse import CATEGORIES, DECIDE, Bags, OrdinalModel, Reader, Scorer, fit, fit_models, grade, score, segments
from cohortlake.llm.clusters import communities, families, neighbour_graph, valley
from cohortlake.llm.mapping import UNMATCHED, match, repair, words_of
from cohortlake.session import Scratch, table
from pyspark.sql import functions as F


def test_words_undo_disguises():
    assert words_of("Lef7 Circumf1ex Art3ry")[0] == "left"
    assert words_of("L.A.D.") == ["lad"]
    assert words_of("RightCoronaryArtery ") == ["right", "coronary", "artery"]
    assert words_of("ROI 53 - Léft Сoronary") == ["left", "coronary"]
    assert words_of(None) == words_of("") == words_of(" ? ") == []


def test_matching_names(spark, sf):
    ref = table(spark, sf, "vessel_ref").select(F.col("vessel_code").alias("code"), F.col("vessel_name").alias("name"), "short_forms")
    cases = {
        "left anterior descending artery": "LAD", "Artery, Left Anterior Descending": "LAD", "LAD-p": "LAD_P", "pRCA": "RCA_P", "RCA (mid)": "RCA_M", "Cx": "LCX", "Left Ciircumflex Aretery": "LCX",
        "1st Diagonal Br.": "D1", "diagonal #2": "D2", "Lt Main": "LM", "LCA": "LM", "OM 1 #6": "OM1", "post desc": "PDA", "A-V nodal artery": "AVN", "Right_Coronary_Artery": "RCA", "Left Coronary Artery #3": "LM",
        "Noname 2": UNMATCHED, "2": UNMATCHED, "": UNMATCHED, "Left Ventricle": UNMATCHED, "Descending Aorta": UNMATCHED, "x" * 5000: UNMATCHED,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,), ("LCA",)], "value string")
    got = {r.value: r.code for r in match(df, ref).collect()}
    assert got == cases
    assert match(df.limit(0), ref).count() == 0


def test_repair_finds_all_words_within_distance(spark):
    import itertools
    import random

    random.seed(6)
    vocab = ["anterior", "artery", "left", "conus", "circumflex"]
    toks = {"".join(random.choices("aerty", k=random.randint(2, 8))) for _ in range(300)} | {"atrery", "lef", "anteriro", "cnus"}
    got = {(r.token, r.word) for r in repair(spark.createDataFrame([(t,) for t in toks], "token string"), spark.createDataFrame([(v,) for v in vocab], "word string")).collect()}

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            p, d = d, [i + 1]
            for j, y in enumerate(b):
                d.append(min(d[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
        return d[-1]

    want = {(t, v) for t, v in itertools.product(toks, vocab) if lev(t, v) <= (0 if len(v) <= 3 else 1 if len(v) <= 5 else 2) or (len(t) >= 3 and v.startswith(t) and t != v and len(v) > 3)}
    assert got == want


def blobs(seed=0):
    rng = np.random.default_rng(seed)
    x, y = [], []
    for c, (n, s) in enumerate([(300, 0.1), (120, 0.3), (40, 0.05), (6, 0.05)]):
        x.append(rng.normal(size=(n, 9)) * s + rng.uniform(-8, 8, 9))
        y += [c] * n
    x.append(np.repeat(rng.uniform(-8, 8, (1, 9)), 5, axis=0))  # five exact copies
    x.append(rng.uniform(-8, 8, (40, 9)))
    return np.vstack(x), np.array(y + [4] * 5 + [-1] * 40)


def test_families_find_planted_groups_and_leave_out_strays(spark):
    x, y = blobs()
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "lesion_id long, f array<double>")
    got, typical = families(df)
    g = got.toPandas()
    lab = dict(zip(g.lesion_id, g.cluster_id))
    want = {i: int(np.flatnonzero(y == c)[0]) for i, c in enumerate(y) if c >= 0}
    assert lab == want
    assert typical.count() == len(want)
    assert families(df.limit(0))[0].count() == 0
    again = families(df.repartition(3))[0].toPandas()
    assert dict(zip(again.lesion_id, again.cluster_id)) == lab


def test_neighbour_graph_recall(spark):
    x = np.random.default_rng(1).normal(size=(1500, 9))
    pts = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    got = {r.v: {e.u for e in r.near} for r in neighbour_graph(pts, Scratch(spark, "t")).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, 1)[:, :8]
    assert np.mean([len(got[i] & set(true[i].tolist())) / 8 for i in range(len(x))]) > 0.9


def test_neighbours_meet_across_many_cells(spark, monkeypatch):
    """One broad cloud in nine dimensions, so that borders of cells part most points from some neighbour; then a few points."""
    monkeypatch.setattr("cohortlake.llm.clusters.CELL", 512)
    x = np.random.default_rng(7).normal(size=(5000, 9))
    pts = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    near = {r.v: r.near for r in neighbour_graph(pts, Scratch(spark, "t")).collect()}
    x = x.astype(np.float32).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    true = np.argpartition(d, 8, axis=1)[:, :8]
    assert np.mean([len({e.u for e in near[i]} & set(true[i].tolist())) / 8 for i in range(len(x))]) > 0.97
    for i, got in near.items():
        far = [e.d for e in got]
        assert far == sorted(far) and len({e.u for e in got}) == 8 and np.allclose(far, d[i, [e.u for e in got]])
    few = neighbour_graph(pts.where("id < 3"), Scratch(spark, "t")).collect()
    assert {r.v: sorted(e.u for e in r.near) for r in few} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}


def test_communities_in_rounds_equal_those_in_one_task(spark):
    rng = np.random.default_rng(2)
    e = [(int(min(a, b) + 50 * c), int(max(a, b) + 50 * c), 1.0) for c in range(4) for a, b in rng.integers(0, 50, (300, 2)) if a != b]
    df = spark.createDataFrame(e, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
    for gamma in (0.02, 1.0):
        one = {r.node: r.community for r in communities(df, Scratch(spark, "a"), gamma).collect()}
        many = {r.node: r.community for r in communities(df, Scratch(spark, "b"), gamma, small=0).collect()}
        assert one == many and all(one[one[n]] == one[n] <= n for n in one)
    assert {n // 50 == c // 50 for n, c in one.items()} == {True}


def test_modularity_parts_touching_families_that_linkage_joins(spark):
    """Two dense groups joined by a few edges, in a graph with others: one component, two communities, at two sizes."""
    for size, others in ((40, 6), (160, 6)):
        rng = np.random.default_rng(size)
        groups = [(int(min(a, b) + size * c), int(max(a, b) + size * c), 1.0) for c in range(2 + others) for a, b in rng.integers(0, size, (size * 6, 2)) if a != b]
        bridge = [(int(i), int(size + i), 0.6) for i in range(4)]
        df = spark.createDataFrame(groups + bridge, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
        got = {r.node: r.community for r in communities(df, Scratch(spark, "t")).collect()}
        linked = {r.node: r.community for r in communities(df, Scratch(spark, "t"), gamma=0.0).collect()}
        assert {got[i] for i in range(size)}.isdisjoint({got[i] for i in range(size, 2 * size)})
        assert len({linked[i] for i in range(2 * size)}) == 1


def test_valley_between_two_modes():
    v = np.concatenate([np.random.default_rng(3).normal(-2, 0.2, 5000), np.random.default_rng(4).normal(0.5, 0.2, 300)])
    c, e = np.histogram(v, bins=200)
    assert -1.5 < valley(c, e) < 0


def test_segments_undo_disguises_mark_quotes_and_drop_struck_words():
    assert list(segments("You are p-a-t-h-e-t-i-c")) == [["you", "are", "pathetic"]]
    assert list(segments('He said "go now. Leave" twice')) == [["he", "said", '"go', '"now', '"leave', "twice"]]
    assert list(segments("«Va» et „komm“ 12 und “x”")) == [['"va', "et", '"kom', "#", "und", '"x']]
    long = "word " * 500
    assert all(w[0] == '"' for w in next(iter(segments(f'"{long}"'))))  # a quotation has no longest length
    assert list(segments('An open " mark')) == [["an", "open", "mark"]]
    assert list(segments("")) == [] and list(segments("[words struck from the record]")) == [] and list(segments("~~gone~~ here")) == [["here"]]


def test_masked_words_are_read_by_a_vocabulary():
    read = Reader({"weather": 5, "whether": 2, "ilot": 1, "list": 3}).read
    assert read("we*ther") == "weather" and read("w***ther") in ("weather", "whether") and read("1i5t") == "list"
    assert read("*") == "*" or read("*") in ("ilot", "list") and read('"we*ther') == '"weather'


def test_grades():
    assert grade({"none": 2}, "abuse") == 0 and grade({"abuse": 1, "none": 2}, "abuse") == 1
    assert grade({"abuse": 2}, "abuse") == 3 and grade({"hate": 1}, "abuse") is None


def test_ordinal_fit_learns_ordered_grades():
    rng = np.random.default_rng(5)
    docs, grades = [], []
    for _ in range(600):
        k = int(rng.integers(0, 4))
        docs.append([["zq"] * k + [f"w{rng.integers(0, 50)}"]])
        grades.append(k)
    b = Bags(docs)
    w, cuts = fit(b, np.arange(b.n), np.array(grades), steps=400)
    m = OrdinalModel({int(n): float(x) for names, v in zip(b.names, w) for n, x in zip(names, v)}, cuts)
    s = [m.severity(np.array(m.score(["zq"] * k))) for k in range(4)]
    assert s == sorted(s) and s[3] > s[0] + 1 and list(m.cuts) == sorted(m.cuts)
    assert np.allclose(b.scores(w), [m.score(d[0]) for d in docs])


def speeches(n: int, seed: int, share: float = 0.25):
    """Documents of invented words: one foul sentence of a category among plain ones, foul words cited or apart in others."""
    rng = np.random.default_rng(seed)
    foul = {c: [f"{c[0]}{x} grol {c[0]}{y} vant" for x in ("ulk", "onde", "irm") for y in ("apt", "esk")] for c in CATEGORIES}
    plain = [f"the {a} {b} {c} today" for a in ("grol", "harbour", "vant", "tariff") for b in ("rises", "falls", "waits") for c in ("slowly", "again", "soon")]
    out = []
    for i in range(n):
        d = list(rng.choice(plain, int(rng.integers(0, 12))))
        label = "none"
        if rng.random() < share:
            label = str(rng.choice(CATEGORIES))
            d.insert(int(rng.integers(0, len(d) + 1)), "Hear this: " + str(rng.choice(foul[label])))
        elif rng.random() < 0.3:
            c = str(rng.choice(CATEGORIES))
            d.append(f'They wrote "{rng.choice(foul[c])}" and we reject it')
        out.append((". ".join(d), label))
    return out


def test_models_learn_foul_sentences_from_document_labels_alone():
    """Held-out accuracy on words that no list could hold; without reviewed cases nothing is found."""
    rng = np.random.default_rng(8)
    wrong = lambda label: str(rng.choice(CATEGORIES)) if rng.random() < 0.04 else label  # reviewers err
    models, vocabulary = fit_models([(t, {wrong(label): 1}) for t, label in speeches(1500, 1)])
    s = Scorer(models, vocabulary)
    right = total = found = there = 0
    for t, label in speeches(600, 2):
        eta = s.worst(t)
        for i, c in enumerate(CATEGORIES):
            hit = models[c].chances(eta[i])[1] >= DECIDE
            right, total = right + (hit == (label == c)), total + 1
            found, there = found + (hit and label == c), there + (label == c)
    assert right / total > 0.97 and found / there > 0.9
    none, _ = fit_models([(t, {"none": 1}) for t, _ in speeches(50, 3)])
    assert not any(m.weights for m in none.values())


def test_scores_of_documents(spark):
    train = [(i, t, label) for i, (t, label) in enumerate(speeches(600, 4))]
    odd = [(9001, None, "a"), (9002, "", None), (9003, "Hear this: aulk grol aapt vant. " * 20_000, "b"), (9003, "Hear this: aulk grol aapt vant", "b"), (9004, "The grol rises slowly today", "b")]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in train] + odd, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "r", label) for i, _, label in train] + [(99_999, "r", "hate"), (2, None, None), (3, "r", "odd"), (None, "r", "hate")], "doc_id long, reviewer string, label string")
    got = score(docs, labels).where("doc_id > 9000").toPandas()
    assert len(got) == 5 and got[got.doc_id == 9003].has_abuse.all() and not got[got.doc_id != 9003].has_abuse.any()
    assert (got[got.doc_id == 9001].abuse == 0).all() and not got.has_hate.any()
    assert not score(docs, labels.limit(0)).where("has_abuse or has_hate or has_sexual or abuse + hate + sexual > 0").count()


def test_reviewed_cases_of_the_tables_rank_first():
    """Of reviewed documents, each scored by a model of the other four fifths, cases stand above most others."""
    d = "/root/testdata/sf0.1"
    labels, docs = pd.read_parquet(f"{d}/speech_labels.parquet"), pd.read_parquet(f"{d}/documents.parquet").set_index("doc_id").text
    votes = {i: g.label.value_counts().to_dict() for i, g in labels.dropna().groupby("doc_id")}
    ids = sorted(votes)
    eta = {}
    for k in range(5):
        s = Scorer(*fit_models([(docs[i], votes[i]) for n, i in enumerate(ids) if n % 5 != k]))
        eta |= {i: s.worst(docs[i])[0] for i in ids[k::5]}
    yes = [eta[i] for i in eta if (grade(votes[i], "abuse") or 0) >= 2]
    no = np.array([eta[i] for i in eta if grade(votes[i], "abuse") == 0])
    assert len(yes) > 30 and np.mean([np.mean(no < y) for y in yes]) > 0.65
