"""Queries of components, clusters, stability and matching; iterative, so checked by tests instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import multivariate as M
from cohortlake.operators import statistics as T
from cohortlake.operators import verdicts as V
from cohortlake.operators.windows import average_rank
from cohortlake.session import Scratch, blocked_cumsum
from cohortlake.sources import cohort as C

COLUMNS = ["volume_mm3", "mean_hu_weighted", "max_hu", "total_area_mm2", "s0", "s1", "s2", "s3", "s4", "s5"]


def lesion_matrix(spark, d):
    """Complete lesions as z-scores: size on a log scale, intensities, six score components."""
    les = C.lesions(spark, d).where("size(scores) = 6")
    les = les.select("lesion_id", "pid", "cohort", "vessel", F.log1p(F.greatest("volume_mm3", F.lit(0.0))).alias("volume_mm3"), F.log1p(F.greatest("total_area_mm2", F.lit(0.0))).alias("total_area_mm2"), "mean_hu_weighted", "max_hu", *[F.when(~F.isnan(F.col("scores")[i]), F.col("scores")[i]).alias(f"s{i}") for i in range(6)])
    return T.z_scores(les.na.drop(subset=COLUMNS), [], COLUMNS)


def pca_scores(spark, d):
    x = lesion_matrix(spark, d)
    load, _ = M.components(x, COLUMNS, 3)
    return M.project(x, COLUMNS, load).select("lesion_id", *[F.round(f"pc{i}", 6).alias(f"pc{i}") for i in (1, 2, 3)])


def pca_loadings(spark, d):
    load, share = M.components(lesion_matrix(spark, d), COLUMNS, 3)
    return M.loadings_table(spark, COLUMNS, load, share)


def kmeans_labels(spark, d):
    model, rows = M.kmeans(lesion_matrix(spark, d), COLUMNS, 4)
    return model.transform(rows).select("lesion_id", F.col("prediction").alias("label"))


def gaussian_labels(spark, d):
    """Hard labels and the larger membership of a two-component mixture over the first two components."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = lesion_matrix(spark, d)
    load, _ = M.components(x, COLUMNS, 2)
    rows = VectorAssembler(inputCols=["pc1", "pc2"], outputCol="features").transform(M.project(x, COLUMNS, load))
    out = GaussianMixture(k=2, seed=42, maxIter=30).fit(rows).transform(rows)
    return out.select("lesion_id", F.col("prediction").alias("label"), F.array_max(vector_to_array("probability")).alias("membership"))


def hopkins(spark, d):
    return M.hopkins(lesion_matrix(spark, d), COLUMNS, "lesion_id")


def gap_statistic(spark, d):
    return M.gap_statistic(lesion_matrix(spark, d), COLUMNS, "lesion_id", replicates=8)


def gap_selected_k(spark, d):
    g = M.gap_statistic(lesion_matrix(spark, d), COLUMNS, "lesion_id", replicates=8).withColumn("space", F.lit("lesions"))
    return T.select_k(Scratch(spark, "gap").save(g, "gap"), ["space"])


def hennig_jaccard(spark, d):
    return M.cluster_stability(lesion_matrix(spark, d), COLUMNS, "lesion_id", 4)


def consensus_pac(spark, d):
    return M.consensus(lesion_matrix(spark, d), COLUMNS, "lesion_id", replicates=15)


def combat_kernels(spark, d):
    """Lesion intensities harmonised over kernels; kernels of one lesion are left out first."""
    j = lesion_matrix(spark, d).join(C.manifest(spark, d).select("pid", "kernel"), "pid")
    j = Scratch(spark, "combat").save(j, "rows")
    enough = j.groupBy("kernel").count().where("count > 1").select("kernel")
    cols = ["mean_hu_weighted", "max_hu", "volume_mm3"]
    return M.combat(j.join(enough, "kernel", "left_semi"), "kernel", cols).select("lesion_id", "kernel", *cols)


def yeo_johnson_fit(spark, d):
    les = C.lesions(spark, d)
    cols = ["volume_mm3", "mean_hu_weighted", "max_hu", "total_area_mm2"]
    fit = M.fit_yeo_johnson(les, cols)
    return spark.createDataFrame(list(fit.items()), "feature string, power double")


def rank_fallback(spark, d):
    """Columns that stay skewed are replaced by their rank over n."""
    les = C.lesions(spark, d).where("volume_mm3 is not null").withColumn("one", F.lit(1))
    n = les.agg(F.count("*").alias("n"))
    return average_rank(les, ["one"], "volume_mm3").join(n, F.lit(True)).select("lesion_id", (F.col("rank") / F.col("n")).alias("ecdf"))


def redundancy_representatives(spark, d):
    return M.redundancy(lesion_matrix(spark, d), COLUMNS, "lesion_id")


def caliper_match(spark, d):
    """Up to three diffuse controls per focal case of the same kernel, 0.2 deviations apart at most."""
    f = C.features(spark, d).where("agatston_total is not null").select("pid", "kernel", "phenotype", F.log1p("agatston_total").alias("burden"))
    f = Scratch(spark, "match").save(f, "burden")
    sd = f.agg(F.stddev_samp("burden")).first()[0] or 1.0
    return M.caliper_match(f.where("phenotype = 'focal'"), f.where("phenotype = 'diffuse'"), ["kernel"], "pid", "burden", 0.2 * sd, 3, Scratch(spark, "match"), drawn=True)


def match_followup(spark, d):
    """(test, n_cases, n_controls, effect, p): what is left between matched focal cases and their diffuse controls.

    ``balance`` has the share of matched cases as p and the standardised difference of burden as effect.
    A difference of 0.1 or more, or under half of the cases matched, ends it there. Otherwise the share of
    the LAD and the largest intensity are contrasted by rank (one-sided p), and the share of regions in
    the lower half of each LAD by a 2 x 2 table, null with under five regions on a side.
    """
    s = Scratch(spark, "followup")
    f = C.features(spark, d).where("agatston_total is not null").select("pid", "kernel", "phenotype", "max_hu_global", "agatston_lad", "agatston_total", F.log1p("agatston_total").alias("burden"))
    f = s.save(f, "burden")
    sd = f.agg(F.stddev_samp("burden")).first()[0] or 1.0
    pairs = M.caliper_match(f.where("phenotype = 'focal'"), f.where("phenotype = 'diffuse'"), ["kernel"], "pid", "burden", 0.2 * sd, 3, s, drawn=True)
    side = lambda c, name: pairs.select(F.col(c).alias("pid")).distinct().withColumn("side", F.lit(name))
    m = s.save(f.join(side("case", "case").unionByName(side("control", "control")), "pid"), "matched")
    return V.match_checks(f.where("phenotype = 'focal'").count(), m, lad_halves(spark, d), "burden")


def lad_halves(spark, d):
    """(pid, lower): regions of the LAD, and whether they lie in the lower half of the patient's LAD."""
    from cohortlake.operators.windows import relative_position

    r = C.rois(spark, d).where("territory = 'LAD' and z_mm is not null").select("pid", "roi_id", "z_mm")
    return relative_position(r, ["pid"], "z_mm").select("pid", (F.col("relative") < 0.5).alias("lower"))


def folds(spark, d, k: int = 10, blocks: int = 64):
    """(pid, kernel, fold): stratified by kernel in a hashed order; the order runs in blocks."""
    m = C.manifest(spark, d).select("pid", "kernel").withColumn("draw", F.xxhash64(F.lit(42), "pid"))
    block = F.least(F.lit(blocks - 1), F.floor((F.col("draw").cast("double") / F.lit(2.0**64) + 0.5) * blocks)).cast("int")
    return blocked_cumsum(m, ["kernel"], ["draw", "pid"], block, F.lit(1), "place", blocks).select("pid", "kernel", (F.col("place") % k).cast("int").alias("fold"))


RAW = ["volume_mm3", "total_area_mm2", "mean_hu_weighted", "max_hu"]


def _raw_lesions(spark, d):
    """Lesions with sizes on a log scale and intensities as they are; nothing is fitted here."""
    les = C.lesions(spark, d)
    return les.select("lesion_id", "pid", *[F.log1p(F.greatest(c, F.lit(0.0))).alias(c) for c in RAW[:2]], *RAW[2:]).na.drop()


def leave_k_out(spark, d, k: int = 5):
    """Agreement, per kernel-stratified fold, of labels from scaling, components and mixture fitted without the fold with those fitted on all rows.

    A fold passes at the agreement that a tenth of flipped labels would keep (``M.null_agreement``); fold -1 has the medians.
    """
    s = Scratch(spark, "folds")
    x = s.save(_raw_lesions(spark, d).join(folds(spark, d, k).select("pid", "fold"), "pid"), "rows")
    full = s.save(M.Frozen(x, RAW).predict(x).select("lesion_id", "fold", F.col("label").alias("a")), "full")
    out = None
    for i in range(k):
        held = M.Frozen(x.where(F.col("fold") != i), RAW).predict(x.where(F.col("fold") == i)).select("lesion_id", F.col("label").alias("b"))
        t = T.adjusted_rand(full.where(F.col("fold") == i).join(held, "lesion_id"), ["fold"], "a", "b")
        out = t if out is None else out.unionByName(t)
    out = s.save(out, "agreement")
    count = full.groupBy("fold").agg(F.count_if(F.col("a") == 1).alias("ones"), F.count_if(F.col("a") == 0).alias("zeros")).collect()  # k rows
    least = spark.createDataFrame([(r.fold, M.null_agreement(r.ones, r.zeros)) for r in count], "fold int, threshold double")
    out = out.join(least, "fold").select("fold", "n", "ari", "threshold")
    whole = out.agg(F.lit(-1).alias("fold"), F.sum("n").alias("n"), F.median("ari").alias("ari"), F.median("threshold").alias("threshold"))  # of k rows
    return out.unionByName(whole).withColumn("passes", F.coalesce(F.col("ari") >= F.col("threshold"), F.lit(False)))


def holdout_report(spark, d):
    """Lesions of kernels with under a tenth of the scans, scored and labelled by what was fitted on the others, with the distance to each mean."""
    s = Scratch(spark, "holdout")
    m = C.manifest(spark, d).select("pid", "kernel")
    n = m.groupBy("kernel").count()
    common = n.join(n.agg(F.sum("count").alias("all")), F.lit(True)).select("kernel", (F.col("count") >= 0.1 * F.col("all")).alias("inside"))
    x = s.save(_raw_lesions(spark, d).join(m, "pid").join(common, "kernel"), "rows")
    fit = M.Frozen(x.where("inside"), RAW)
    out = fit.predict(x.where("not inside"))
    return out.select("lesion_id", "kernel", *[F.round(c, 6).alias(c) for c in (*fit.names, "distance_0", "distance_1")], "label")


def holdout_projection(spark, d):
    """The scores and labels of ``holdout_report``."""
    h = holdout_report(spark, d)
    return h.select("lesion_id", "kernel", *[c for c in h.columns if c.startswith("pc")], "label")


def top_loadings(spark, d, top: int = 3):
    """The columns with the largest absolute loadings of each component, ties by name."""
    from cohortlake.operators.windows import top_n

    return top_n(pca_loadings(spark, d), ["pc"], [F.desc(F.abs("loading")), "feature"], top)


def contrast_with_p(spark, d):
    """Rank contrasts of the phenotypes with their p-values and step-up adjustment."""
    from cohortlake.operators.windows import benjamini_hochberg
    from cohortlake.plans.cohort_queries import PARTS, rounded

    long = T.long_form(C.features(spark, d).where("cohort is not null"), ["cohort", "phenotype"], PARTS)
    c = T.with_normal_p(T.rank_contrast(long, ["cohort", "feature"], "phenotype", "focal", "diffuse", "value"))
    return rounded(benjamini_hochberg(c, ["cohort"], "p", "feature"), z=5)


QUERIES = {f.__name__: f for f in (pca_scores, pca_loadings, kmeans_labels, gaussian_labels, hopkins, gap_statistic, gap_selected_k, hennig_jaccard, consensus_pac, combat_kernels, yeo_johnson_fit, rank_fallback, redundancy_representatives, caliper_match, match_followup, folds, leave_k_out, holdout_report, holdout_projection, top_loadings, contrast_with_p)}

SQL = {
    "rank_fallback": "with" + C.SQL_TABLES + """select lesion_id, (rank() over (order by volume_mm3) + (count(*) over (partition by volume_mm3) - 1) / 2) / count(*) over () ecdf from l where volume_mm3 is not null""",
}
