"""Queries of lesion grouping, audits, summaries and verdicts, each with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import scoring as S
from cohortlake.operators import aggregates as A
from cohortlake.operators import graph, statistics as T, windows as W
from cohortlake.plans.cohort_queries import BURDEN, LONG, PARTS, median_difference, rounded, thickness
from cohortlake.session import Scratch
from cohortlake.sources import cohort as C

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, head: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = f"with{head}" + C.SQL_TABLES + sql
        return fn

    return add


EDGES = """
, q as (select pid, territory, roi_id, slice_idx, cx, cy from r where territory is not null and slice_idx is not null and cx is not null and cy is not null),
e as (select a.roi_id a, b.roi_id b from q a join q b on a.pid = b.pid and a.territory = b.territory and a.roi_id <> b.roi_id and abs(a.slice_idx - b.slice_idx) <= 1 and (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= 25),
reach as (select roi_id node, roi_id root from q union select e.b, reach.root from reach join e on reach.node = e.a),
comp as (select node, min(root) root from reach group by 1)"""


@query("lesion_groups", EDGES + """
, j as (select q.pid, q.territory, root, roi_id, q.cx, q.cy, coalesce(r.area_cm2, 0) * 100 a, r.max_hu, r.slice_idx, coalesce(t.slice_thickness, 0) th from comp join q on q.roi_id = comp.node join r using (roi_id) left join (select pid, slice_thickness from m) t on t.pid = q.pid)
select pid, territory, root lesion, count(*) n_rois, round(sum(a), 5) area_mm2, round(sum(a * th), 5) volume_mm3, max(max_hu) max_hu, count(distinct slice_idx) n_slices,
  round(coalesce(sum(a * cx) / nullif(sum(a), 0), avg(cx)), 5) cx, round(coalesce(sum(a * cy) / nullif(sum(a), 0), avg(cy)), 5) cy from j group by 1, 2, 3""", " recursive")  # fmt: skip
def lesion_groups(spark, d):
    """Regions that touch, directly or through others, as lesions with their centre, area and volume; a lesion may hold most of a dense patient, so none is a list."""
    q = C.rois(spark, d).where("territory is not null and slice_idx is not null and cx is not null and cy is not null")
    q = Scratch(spark, "lesions").save(q.select("pid", "territory", "roi_id", "slice_idx", "cx", "cy", "area_cm2", "max_hu"), "regions")
    comp = graph.components(graph.touch_edges(q, ["pid", "territory"], "roi_id", "slice_idx", "cx", "cy", 1, 5.0))
    j = q.join(comp, q["roi_id"] == comp["node"], "left").withColumn("lesion", F.coalesce("root", "roi_id")).join(thickness(spark, d), "pid", "left")
    a = F.coalesce("area_cm2", F.lit(0.0)) * 100
    centre = lambda c: F.coalesce(F.try_divide(F.sum(a * F.col(c)), F.sum(a)), F.avg(c)).alias(c)
    g = j.groupBy("pid", "territory", "lesion").agg(F.count("*").alias("n_rois"), F.sum(a).alias("area_mm2"), F.sum(a * F.coalesce("slice_thickness", F.lit(0.0))).alias("volume_mm3"), F.max("max_hu").alias("max_hu"), F.countDistinct("slice_idx").alias("n_slices"), centre("cx"), centre("cy"))
    return rounded(g, area_mm2=5, volume_mm3=5, cx=5, cy=5)


QUERIES["lesion_groups_all"], SQL["lesion_groups_all"] = lesion_groups, SQL["lesion_groups"]  # the name under which all patients were asked for before


@query("sentinel_audit", LONG + """
select feature, count(v) n, round(avg((v = 0)::int), 6) zero_rate, round(avg((v = 1)::int), 6) one_rate, round(stddev_pop(v), 5) sd, round(stddev_pop(v) filter (v <> 0), 5) sd_nonzero, round(avg(((v > 0) = (n_art > 0))::int), 6) agreement
from (select x.*, f.n_calcified_arteries n_art from x join f using (pid)) group by 1""")  # fmt: skip
def sentinel_audit(spark, d):
    x = T.long_form(C.features(spark, d), ["n_calcified_arteries"], PARTS)
    v = F.col("value")
    share = lambda c: F.avg(c.cast("double"))
    return rounded(x.groupBy("feature").agg(F.count(v).alias("n"), share(v == 0).alias("zero_rate"), share(v == 1).alias("one_rate"), F.stddev_pop(v).alias("sd"), F.stddev_pop(F.when(v != 0, v)).alias("sd_nonzero"), share((v > 0) == (F.col("n_calcified_arteries") > 0)).alias("agreement")), sd=5, sd_nonzero=5)


@query("sparsity_audit", """
, t as (select pid, (agatston_lad > 0)::int + (agatston_rca > 0)::int + (agatston_lcx > 0)::int + (agatston_lm > 0)::int k from f), c as (select k, count(*) n from t where k is not null group by 1)
select k, n, round(sum(n) over (order by k) / sum(n) over (), 6) cumulative from c""")  # fmt: skip
def sparsity_audit(spark, d):
    k = reduce(lambda a, b: a + b, [(F.col(f"agatston_{v}") > 0).cast("int") for v in ("lad", "rca", "lcx", "lm")])
    c = C.features(spark, d).select(k.alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    run = F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))  # at most five rows
    return rounded(c.join(total, F.lit(True)).select("k", "n", (run / F.col("t")).alias("cumulative")))


@query("icc_family_summary", """
, e as (select pid, vessel, n_rois, i k, scores[i] v from l, range(1, 7) t(i) where len(scores) = 6), d as (select vessel, k, v from e where v is not null and not isnan(v)),
s as (select vessel, k, stddev_samp(v) sd from d group by 1, 2)
select vessel, count(*) n, round(avg((sd >= 4)::int), 6) pass_rate, round(min(sd), 6) least, round(quantile_cont(sd, 0.5), 6) median, round(max(sd), 6) most from s group by 1""")  # fmt: skip
def icc_family_summary(spark, d):
    """Summary of a per-component statistic by family: pass rate, extremes and median."""
    e = C.lesions(spark, d).where("size(scores) = 6").select("vessel", F.posexplode("scores").alias("k", "v")).where("v is not null and not isnan(v)")
    s = e.groupBy("vessel", "k").agg(F.stddev_samp("v").alias("sd"))
    return rounded(s.groupBy("vessel").agg(F.count("*").alias("n"), F.avg((F.col("sd") >= 4).cast("double")).alias("pass_rate"), F.min("sd").alias("least"), F.percentile("sd", F.lit(0.5)).alias("median"), F.max("sd").alias("most")))


@query("icc_threshold_sweep", """
, e as (select pid, cohort, lesion_id s, i k, scores[i] v from l, range(1, 4) t(i) where cohort is not null and len(scores) = 6), d as (select * from e where v is not null and not isnan(v)),
full_ as (select cohort, s from d group by 1, 2 having count(*) = 3), c as (select d.* from d join full_ using (cohort, s)),
a as (select cohort, var_pop(m) vs, count(*)::double n from (select cohort, s, avg(v) m from c group by 1, 2) group by 1), b as (select cohort, var_pop(m) vr, count(*)::double k from (select cohort, k, avg(v) m from c group by 1, 2) group by 1),
t as (select cohort, var_pop(v) vt from c group by 1), g as (select *, k * n * vs / (n - 1) msr, n * k * vr / (k - 1) msc, n * k * (vt - vs - vr) / ((n - 1) * (k - 1)) mse from a join b using (cohort) join t using (cohort)),
i as (select (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n) icc from g)
select threshold, count(*) filter (icc >= threshold) n_pass from i cross join (select unnest([-0.5, -0.2, 0.0, 0.2]) threshold) group by 1""")  # fmt: skip
def icc_threshold_sweep(spark, d):
    from cohortlake.plans.cohort_queries import QUERIES as base

    return T.threshold_sweep(base["icc_absolute"](spark, d), (-0.5, -0.2, 0.0, 0.2))


@query("cohort_fingerprint", """select cohort, count(*) n, count(distinct pid) n_pids, min(pid) first_pid, max(pid) last_pid from f group by 1""")
def cohort_fingerprint(spark, d):
    """Rows, ids and ends per cohort; the order-free hash of ``fingerprint`` guards the same rows in tests."""
    return C.features(spark, d).groupBy("cohort").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("n_pids"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"))


@query("class_by_tertile", BURDEN + """
, c as (select quantile_cont(total, 1.0 / 3) x, quantile_cont(total, 2.0 / 3) y from b), t as (select pid, case when total <= x then 1 when total <= y then 2 else 3 end tertile from b, c)
select tertile, territory, count(*) n, round(avg(mean_hu), 5) mean_hu, round(quantile_cont(area_cm2, 0.5), 6) median_area from r join t using (pid) where territory is not null group by 1, 2""")  # fmt: skip
def class_by_tertile(spark, d):
    b = A.burden(C.rois(spark, d), thickness(spark, d)).withColumn("all", F.lit(1))
    s = Scratch(spark, "tertiles")
    t = W.tertile(s.save(b, "burden"), ["all"], "total").select("pid", "tertile")
    j, by = s.save(C.rois(spark, d).where("territory is not null").join(t, "pid").select("tertile", "territory", "mean_hu", "area_cm2"), "regions"), ["tertile", "territory"]
    g = j.groupBy(*by).agg(F.count("*").alias("n"), F.avg("mean_hu").alias("mean_hu"))
    return rounded(W.null_safe_join(g, W.quantiles(j, by, "area_cm2", {"median_area": 0.5}), by), mean_hu=5)


@query("signed_effect_pivot", LONG + """
, g as (select cohort, feature, quantile_cont(v, 0.5) filter (phenotype = 'diffuse') - quantile_cont(v, 0.5) filter (phenotype = 'focal') s from x group by 1, 2)
select feature, round(avg(sign(s)), 6) mean_sign, round(avg(abs(s)), 5) mean_abs, count(s) n from g group by 1""")  # fmt: skip
def signed_effect_pivot(spark, d):
    x = T.long_form(C.features(spark, d), ["cohort", "phenotype"], PARTS)
    g = median_difference(x, ["cohort", "feature"], "value", "s")
    return rounded(g.groupBy("feature").agg(F.avg(F.signum("s")).alias("mean_sign"), F.avg(F.abs("s")).alias("mean_abs"), F.count("s").alias("n")), mean_abs=5)


@query("modal_vote", """
, c as (select cohort, n_calcified_arteries k, count(*) n from f where n_calcified_arteries is not null group by 1, 2) select cohort, arg_max(k, (n, -k)) k, max(n) votes from c group by 1""")
def modal_vote(spark, d):
    c = C.features(spark, d).where("n_calcified_arteries is not null").groupBy("cohort", F.col("n_calcified_arteries").alias("k")).agg(F.count("*").alias("n"))
    return c.groupBy("cohort").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"), F.max("n").alias("votes"))


@query("empirical_distribution", """
, x as (select cohort, agatston_total v, pid, row_number() over (partition by cohort order by agatston_total, pid) i, count(*) over (partition by cohort) n from f where agatston_total is not null) select pid, round(i / n, 6) ecdf from x""")
def empirical_distribution(spark, d):
    f = C.features(spark, d).where("agatston_total is not null")
    n = f.groupBy("cohort").agg(F.count("*").alias("n"))
    return rounded(W.ordered_place(f, ["cohort"], "agatston_total", "pid").join(n, "cohort").select("pid", (F.col("place") / F.col("n")).alias("ecdf")))


@query("displacement_flag", """
, c as (select cohort, quantile_cont(agatston_total, 1.0 / 3) a from f group by 1) select pid, coalesce(agatston_total <= a and (agatston_lm > 0 or max_hu_global > 800), false) displaced from f left join c on f.cohort is not distinct from c.cohort""")
def displacement_flag(spark, d):
    t = W.tertile(C.features(spark, d).withColumn("cohort", F.coalesce("cohort", F.lit("?"))), ["cohort"], "agatston_total")
    hit = (F.col("tertile") == 1) & ((F.col("agatston_lm") > 0) | (F.col("max_hu_global") > 800))
    return t.select("pid", F.coalesce(hit, F.lit(False)).alias("displaced"))


@query("fisher_tables", """
select cohort, count(*) filter (agatston_lm > 0 and phenotype = 'diffuse') a, count(*) filter (agatston_lm > 0 and phenotype = 'focal') b, count(*) filter (agatston_lm = 0 and phenotype = 'diffuse') c, count(*) filter (agatston_lm = 0 and phenotype = 'focal') d from f group by 1""")
def fisher_tables(spark, d):
    """The 2 x 2 tables behind one-sided exact tests; ``fisher_tests`` adds the p-values."""
    n = lambda lm, p: F.count_if(F.coalesce(lm & (F.col("phenotype") == p), F.lit(False)))
    hi, lo = F.col("agatston_lm") > 0, F.col("agatston_lm") == 0
    return C.features(spark, d).groupBy("cohort").agg(n(hi, "diffuse").alias("a"), n(hi, "focal").alias("b"), n(lo, "diffuse").alias("c"), n(lo, "focal").alias("d"))


@query("fisher_tests")
def fisher_tests(spark, d):
    from cohortlake.functions.tails import fisher_p

    return fisher_tables(spark, d).withColumn("p", F.round(fisher_p(*[F.col(c).cast("double") for c in "abcd"]), 9))


@query("singleton_batches", """, k as (select kernel, count(*) n from f group by 1) select f.pid, f.kernel from f join k using (kernel) where n >= 2""")
def singleton_batches(spark, d):
    """Scans whose kernel has at least two."""
    f = C.features(spark, d)
    return f.join(f.groupBy("kernel").count().where("count >= 2").select("kernel"), "kernel", "left_semi").select("pid", "kernel")


@query("representative_pick", LONG + """
, s as (select feature, round(stddev_samp(v), 6) sd, count(v) n from x group by 1), b as (select *, case when feature like 'agatston%' then 'burden' else 'intensity' end family from s)
select family, feature, sd from b qualify row_number() over (partition by family order by sd is null, -sd, feature) = 1""")  # fmt: skip
def representative_pick(spark, d):
    m = T.moments(T.long_form(C.features(spark, d), [], PARTS), ["feature"]).withColumn("family", S.first_prefix(F.col("feature"), {"agatston": "burden"}, "intensity"))
    return W.top_n(rounded(m.select("family", "feature", "sd")), ["family"], [F.col("sd").isNull(), -F.col("sd"), "feature"], 1).drop("place")


@query("run_compare", """
, a as (select cohort, vessel, median(volume_mm3) x from l where lesion_id % 2 = 0 group by 1, 2), b as (select cohort, vessel, median(volume_mm3) y from l where lesion_id % 2 = 1 group by 1, 2)
select coalesce(a.cohort, b.cohort) cohort, coalesce(a.vessel, b.vessel) vessel, round(y - x, 6) shift, coalesce(abs(y - x) <= 0.1 * x, false) replicated from a full join b on a.cohort is not distinct from b.cohort and a.vessel is not distinct from b.vessel""")  # fmt: skip
def run_compare(spark, d):
    """Two halves of the lesions as two runs: shift of medians and whether they agree within a tenth."""
    half = lambda i: C.lesions(spark, d).where(f"lesion_id % 2 = {i}")
    a, b = (W.quantiles(half(i), ["cohort", "vessel"], "volume_mm3", {n: 0.5}) for i, n in ((0, "x"), (1, "y")))
    same = a["cohort"].eqNullSafe(b["cohort"]) & a["vessel"].eqNullSafe(b["vessel"])
    j = a.join(b, same, "full")
    return rounded(j.select(F.coalesce(a["cohort"], b["cohort"]).alias("cohort"), F.coalesce(a["vessel"], b["vessel"]).alias("vessel"), (F.col("y") - F.col("x")).alias("shift"), F.coalesce(F.abs(F.col("y") - F.col("x")) <= 0.1 * F.col("x"), F.lit(False)).alias("replicated")))
