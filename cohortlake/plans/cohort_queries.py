"""Queries of the core operators over the cohort tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import scoring as S
from cohortlake.operators import aggregates as A
from cohortlake.operators import joins as J
from cohortlake.operators import statistics as T
from cohortlake.operators import windows as W
from cohortlake.session import Scratch
from cohortlake.sources import cohort as C

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: bool = True):
    """Register a query; its SQL starts after the cleaned tables r, l, f and m."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = ("with" + C.SQL_TABLES + sql) if tables else sql
        return fn

    return add


def rounded(df, **places):
    """Doubles rounded for comparison, other columns as they are."""
    return df.select(*[F.round(c, places.get(c, 6)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def median_difference(df, by, value, out):
    """Median of the diffuse rows less that of the focal ones per group; null where a side is missing."""
    med = W.quantiles(df.where(F.col("phenotype").isin("focal", "diffuse")), [*by, "phenotype"], value, {"m": 0.5})
    of = lambda p: F.max(F.when(F.col("phenotype") == p, F.col("m")))
    return W.null_safe_join(df.groupBy(*by).agg(F.lit(1).alias("_one")), med.groupBy(*by).agg((of("diffuse") - of("focal")).alias(out)), by, "left").drop("_one")


def thickness(spark, d):
    return C.manifest(spark, d).select("pid", "slice_thickness")


ROI_SCORE = "case when max_hu >= 130 and area_cm2 > 0 and slice_thickness > 0 then area_cm2 * 100 * (case when max_hu < 200 then 1 when max_hu < 300 then 2 when max_hu < 400 then 3 else 4 end) * slice_thickness / 3 else 0 end"
RISK = "case when total <= 0 then 'zero' when total < 100 then 'mild' when total < 400 then 'moderate' else 'severe' end"
BURDEN = f"""
, s as (select r.pid, territory, {ROI_SCORE} s from r left join (select pid, slice_thickness from m) m using (pid)),
w as (select pid, coalesce(sum(s) filter (territory = 'LAD'), 0) lad, coalesce(sum(s) filter (territory = 'RCA'), 0) rca, coalesce(sum(s) filter (territory = 'LCx'), 0) lcx, coalesce(sum(s) filter (territory = 'LM'), 0) lm from s group by 1),
b as (select *, lad + rca + lcx + lm total from w)"""


@query("agatston_burden", BURDEN + f" select pid, round(lad, 6) lad, round(rca, 6) rca, round(lcx, 6) lcx, round(lm, 6) lm, round(total, 6) total, {RISK} risk from b")
def agatston_burden(spark, d):
    return rounded(A.burden(C.rois(spark, d), thickness(spark, d)))


@query("risk_class_counts", BURDEN + f" select {RISK} risk, count(*) n, round(sum(total), 4) total, round(quantile_cont(total, 0.5), 6) median from b group by 1")
def risk_class_counts(spark, d):
    b = A.burden(C.rois(spark, d), thickness(spark, d))
    b = Scratch(spark, "burden").save(b.select("risk", "total"), "burden")
    g = b.groupBy("risk").agg(F.count("*").alias("n"), F.round(F.sum("total"), 4).alias("total"))
    return rounded(W.null_safe_join(g, W.quantiles(b, ["risk"], "total", {"median": 0.5}), ["risk"]), total=4)


@query("vessel_aggregates", """
select r.pid, territory, count(*) n_rois, round(sum(coalesce(area_cm2, 0) * 100), 6) area_mm2, round(sum(coalesce(area_cm2, 0) * 100 * coalesce(slice_thickness, 0)), 6) volume_mm3,
  round(sum(coalesce(area_cm2, 0) * 100 * coalesce(slice_thickness, 0) * coalesce(mean_hu, 0) / 1000), 8) mass,
  round(coalesce(sum(coalesce(area_cm2, 0) * 100 * mean_hu) / nullif(sum(case when mean_hu is not null then coalesce(area_cm2, 0) * 100 end), 0), 0), 5) mean_hu,
  greatest(coalesce(max(max_hu), 0), 0) max_hu
from r left join (select pid, slice_thickness from m) m using (pid) where territory is not null group by 1, 2""")  # fmt: skip
def vessel_aggregates(spark, d):
    return rounded(A.vessel_aggregates(C.rois(spark, d), thickness(spark, d)), mean_hu=5, mass=8)


@query("tier_counts", """
select pid, territory, count(*) filter (max_hu >= 130 and max_hu < 200) d1, count(*) filter (max_hu >= 200 and max_hu < 300) d2, count(*) filter (max_hu >= 300 and max_hu < 400) d3,
  count(*) filter (max_hu >= 400) d4, count(*) filter (max_hu > 1000) dense from r where territory is not null group by 1, 2""")  # fmt: skip
def tier_counts(spark, d):
    return A.tier_counts(C.rois(spark, d))


@query("high_density_fraction", """
, t as (select pid, count(*) filter (max_hu >= 300) hi, count(*) filter (max_hu >= 130) n from r where territory is not null group by 1)
select pid, round(case when n = 0 then 0 else hi / n end, 6) high_fraction from t""")  # fmt: skip
def high_density_fraction(spark, d):
    t = A.tier_counts(C.rois(spark, d)).groupBy("pid").agg(*[F.sum(c).alias(c) for c in ("d1", "d2", "d3", "d4")])
    n = F.col("d1") + F.col("d2") + F.col("d3") + F.col("d4")
    return t.select("pid", F.round(F.coalesce(F.try_divide(F.col("d3") + F.col("d4"), n), F.lit(0.0)), 6).alias("high_fraction"))


@query("vessel_gini", """
, v as (select pid, unnest([agatston_lad, agatston_rca, agatston_lcx, agatston_lm]) x from f), p as (select pid, x, row_number() over (partition by pid order by x) i, count(*) over (partition by pid) n from v where x > 0),
g as (select pid, n, 2 * sum(i * x) / (n * sum(x)) - (n + 1) / n g from p group by pid, n)
select f.pid, round(case when n >= 2 then g else 0 end, 6) gini from f left join g using (pid)""")  # fmt: skip
def vessel_gini(spark, d):
    parts = F.array(*[F.col(c) for c in ("agatston_lad", "agatston_rca", "agatston_lcx", "agatston_lm")])
    return C.features(spark, d).select("pid", F.round(S.gini(F.filter(parts, lambda x: x > 0)), 6).alias("gini"))


PARTS = ["agatston_lad", "agatston_rca", "agatston_lcx", "agatston_lm", "agatston_total", "max_hu_global"]
LONG = ", x as (select pid, cohort, kernel, phenotype, unnest(['agatston_lad', 'agatston_rca', 'agatston_lcx', 'agatston_lm', 'agatston_total', 'max_hu_global']) feature, unnest([agatston_lad, agatston_rca, agatston_lcx, agatston_lm, agatston_total, max_hu_global]) v from f)"


@query("median_iqr_profile", LONG + """
select phenotype, feature, count(*) n, count(v) n_used, count(*) filter (v <> 0) n_nonzero, round(quantile_cont(v, 0.5), 6) median, round(quantile_cont(v, 0.25), 6) iqr_lower, round(quantile_cont(v, 0.75), 6) iqr_upper
from x group by 1, 2""")  # fmt: skip
def median_iqr_profile(spark, d):
    return rounded(A.profile(C.features(spark, d), ["phenotype"], PARTS))


CONTRAST = LONG + """
, d as (select feature, phenotype g, v from x where v is not null and phenotype in ('focal', 'diffuse')),
k as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2 r, count(*) over (partition by feature, v) t from d),
a as (select feature, count(*) filter (g = 'focal') n_a, count(*) filter (g = 'diffuse') n_b, sum(r) filter (g = 'focal') ra, sum(t * t - 1.0) ties from k group by 1),
u as (select feature, n_a, n_b, ra - n_a * (n_a + 1) / 2 u, n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0))) var from a),
c as (select feature, n_a, n_b, u, 2 * u / (n_a * n_b) - 1 cliffs_delta, case when var <= 0 then 0 else sign(u - n_a * n_b / 2) * greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(var) end z from u)"""


@query("rank_contrast", CONTRAST + " select feature, n_a, n_b, u, round(cliffs_delta, 6) cliffs_delta, round(z, 5) z from c")
def rank_contrast(spark, d):
    long = T.long_form(C.features(spark, d), ["phenotype"], PARTS)
    return rounded(T.rank_contrast(long, ["feature"], "phenotype", "focal", "diffuse", "value"), z=5)


@query("bh_adjust", CONTRAST + """
, p as (select feature, exp(-z * z / 8) p from c), q as (select *, row_number() over (order by p, feature) r, count(*) over () n from p)
select feature, round(p, 6) p, round(least(1, min(p * n / r) over (order by r desc)), 6) p_adjusted from q""")  # fmt: skip
def bh_adjust(spark, d):
    long = T.long_form(C.features(spark, d), ["phenotype"], PARTS)
    c = T.rank_contrast(long, ["feature"], "phenotype", "focal", "diffuse", "value").withColumn("p", F.exp(-F.col("z") ** 2 / 8)).withColumn("family", F.lit(1))
    return rounded(W.benjamini_hochberg(c, ["family"], "p", "feature").select("feature", "p", "p_adjusted"))


@query("average_rank", """
select lesion_id, pid, round(rank() over (partition by pid order by volume_mm3) + (count(*) over (partition by pid, volume_mm3) - 1) / 2, 6) rank
from l where volume_mm3 is not null and pid is not null""")  # fmt: skip
def average_rank(spark, d):
    return rounded(W.average_rank(C.lesions(spark, d).where("pid is not null"), ["pid"], "volume_mm3").select("lesion_id", "pid", "rank"))


@query("burden_tertiles", """
, c as (select cohort, quantile_cont(agatston_total, 1.0 / 3) a, quantile_cont(agatston_total, 2.0 / 3) b from f group by 1),
t as (select cohort, case when agatston_total is null then null when agatston_total <= a then 1 when agatston_total <= b then 2 else 3 end tertile, agatston_total v from f join c using (cohort))
select cohort, tertile, count(*) n, round(avg(v), 6) mean from t group by 1, 2""")  # fmt: skip
def burden_tertiles(spark, d):
    t = W.tertile(C.features(spark, d), ["cohort"], "agatston_total")
    return t.groupBy("cohort", "tertile").agg(F.count("*").alias("n"), F.round(F.avg("agatston_total"), 6).alias("mean"))


@query("top_lesions", """
select pid, lesion_id, volume_mm3, row_number() over (partition by pid order by volume_mm3 desc, lesion_id) place from l where pid is not null and volume_mm3 is not null qualify place <= 3""")
def top_lesions(spark, d):
    les = C.lesions(spark, d).where("pid is not null and volume_mm3 is not null").select("pid", "lesion_id", "volume_mm3")
    return W.top_n(les, ["pid"], [F.desc("volume_mm3"), "lesion_id"], 3).select("pid", "lesion_id", "volume_mm3", "place")


@query("relative_position", """
, w as (select lesion_id, pid, centroid_x_mm x, min(centroid_x_mm) over (partition by pid) lo, max(centroid_x_mm) over (partition by pid) hi from l where pid is not null and centroid_x_mm is not null)
select lesion_id, round((x - lo) / (hi - lo), 6) relative from w where hi > lo""")  # fmt: skip
def relative_position(spark, d):
    return rounded(W.relative_position(C.lesions(spark, d).where("pid is not null"), ["pid"], "centroid_x_mm").select("lesion_id", "relative"))


@query("consecutive_distance", """
, q as (select pid, territory, roi_id, cx x, cy y, z_mm z from r where territory is not null and cx is not null and cy is not null and z_mm is not null),
s as (select pid, territory, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 + (z - lag(z) over w) ** 2) step,
  sqrt((last(x) over v - first(x) over v) ** 2 + (last(y) over v - first(y) over v) ** 2 + (last(z) over v - first(z) over v) ** 2) span
  from q window w as (partition by pid, territory order by z, x, y, roi_id), v as (partition by pid, territory order by z, x, y, roi_id rows between unbounded preceding and unbounded following)),
g as (select pid, territory, count(*) n, coalesce(avg(step), 0) mean_step, coalesce(max(step), 0) max_step, max(span) span from s group by 1, 2)
select pid, territory, n, round(mean_step, 5) mean_step, round(max_step, 5) max_step, round(span, 5) span, round(case when n = 1 or span < 1e-6 then 1 else n / span end, 5) diffusivity from g""")  # fmt: skip
def consecutive_distance(spark, d):
    q = W.consecutive_distances(C.rois(spark, d).where("territory is not null"), ["pid", "territory"], "cx", "cy", "z_mm", "roi_id")
    return rounded(q, mean_step=5, max_step=5, span=5, diffusivity=5)


@query("cumulative_share_cut", """
, w as (select pid, volume_mm3 v, row_number() over o k, sum(volume_mm3) over (partition by pid order by volume_mm3 desc, lesion_id rows unbounded preceding) c, sum(volume_mm3) over (partition by pid) s from l
  where pid is not null and volume_mm3 is not null window o as (partition by pid order by volume_mm3 desc, lesion_id))
select pid, coalesce(min(k) filter (c >= 0.8 * s - 1e-9), count(*)) k, count(*) n from w group by 1""")  # fmt: skip
def cumulative_share_cut(spark, d):
    return W.cumulative_cut(C.lesions(spark, d).where("pid is not null"), ["pid"], "volume_mm3", "lesion_id", 0.8)


@query("largest_gap", """
, x as (select distinct cohort, agatston_total v from f where agatston_total is not null), g as (select cohort, v, lead(v) over (partition by cohort order by v) - v gap from x)
select cohort, round(max(gap), 6) gap, round(arg_max(v, (gap, -v)), 6) below from g where gap is not null group by 1""")  # fmt: skip
def largest_gap(spark, d):
    return rounded(W.largest_gap(C.features(spark, d), ["cohort"], "agatston_total"))


@query("nearest_slice", """
, s as (select distinct pid, slice_idx, z_mm sz from r where z_mm is not null and slice_idx is not null),
q as (select roi_id, r.pid, z_mm + 0.4 z, slice_thickness / 2 tol from r join (select pid, slice_thickness from m) m using (pid)),
j as (select roi_id, min((round(abs(z - sz), 9), slice_idx)) b from q join s using (pid) where abs(z - sz) <= tol group by 1)
select q.roi_id, struct_extract_at(b, 2) matched, round(struct_extract_at(b, 1), 6) distance from q left join j using (roi_id)""")  # fmt: skip
def nearest_slice(spark, d):
    r = C.rois(spark, d).select("roi_id", "pid", "slice_idx", "z_mm")
    q = r.join(thickness(spark, d), "pid").select("roi_id", "pid", (F.col("z_mm") + 0.4).alias("z"), (F.col("slice_thickness") / 2).alias("tol"))
    s = r.where("slice_idx is not null").select("pid", "slice_idx", F.col("z_mm").alias("sz"))
    return rounded(J.nearest(q, s, ["pid"], "z", "sz", "slice_idx", F.col("tol"), "roi_id").select("roi_id", "matched", "distance"))


EDGES = """
, q as (select pid, territory, roi_id, slice_idx, cx, cy from r where territory is not null and slice_idx is not null and cx is not null and cy is not null)
select a.pid, a.territory, a.roi_id a, b.roi_id b from q a join q b on a.pid = b.pid and a.territory = b.territory and a.roi_id < b.roi_id and abs(a.slice_idx - b.slice_idx) <= 1 and (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= 25"""


@query("region_edges", EDGES)
def region_edges(spark, d):
    """Regions that touch, of all patients: one slice and five millimetres apart at most."""
    return J.range_edges(C.rois(spark, d).where("territory is not null"), ["pid", "territory"], "roi_id", "slice_idx", "cx", "cy", 1, 5.0)


query("region_edges_all", EDGES)(region_edges)  # the name under which all patients were asked for before


@query("excluded_regions", """
select r.roi_id, r.pid from r where vessel is not null and not exists (select 1 from l, unnest(l.roi_keys) u(k) where l.pid = r.pid and k.image_index = r.image_index and k.roi_idx = r.roi_idx_in_slice)""")
def excluded_regions(spark, d):
    """Normalised regions that no lesion lists."""
    keys = C.lesions(spark, d).select("pid", F.explode("roi_keys").alias("k")).select("pid", F.col("k.image_index").alias("image_index"), F.col("k.roi_idx").alias("roi_idx_in_slice")).distinct()
    return C.rois(spark, d).where("vessel is not null").join(keys, ["pid", "image_index", "roi_idx_in_slice"], "left_anti").select("roi_id", "pid")


@query("cohort_discovery", """
select coalesce(m.pid, g.pid) pid, case when m.pid is null then 'only_right' when g.pid is null then 'only_left' when m.pid = 'QA-PHANTOM-1' then 'config_excluded' when kernel = 'standard' then 'other_kernel' end reason
from m full join (select distinct pid from f) g on m.pid = g.pid""")  # fmt: skip
def cohort_discovery(spark, d):
    m = C.manifest(spark, d).select("pid", "kernel")
    return J.discovery(m, C.features(spark, d).select("pid"), "pid", ["QA-PHANTOM-1"], [(F.col("kernel") == "standard", "other_kernel")])


@query("set_operations", """
, a as (select distinct pid from f where phenotype = 'focal'), b as (select distinct pid from l where vessel = 'LAD'), c as (select distinct pid from r where territory = 'RCA')
select 'intersect' op, count(*) n from (select * from b intersect select * from c) union all select 'except', count(*) from (select * from b except select * from c) union all select 'union', count(*) from (select * from b union select * from c)
union all select 'union_all', count(*) from (select * from a union all select * from b) union all select 'symmetric', count(*) from ((select * from b except select * from c) union all (select * from c except select * from b))""")  # fmt: skip
def set_operations(spark, d):
    a = C.features(spark, d).where("phenotype = 'focal'").select("pid").distinct()
    b = C.lesions(spark, d).where("vessel = 'LAD'").select("pid").distinct()
    c = C.rois(spark, d).where("territory = 'RCA'").select("pid").distinct()
    ops = {"intersect": b.intersect(c), "except": b.subtract(c), "union": b.union(c).distinct(), "union_all": a.unionByName(b), "symmetric": b.subtract(c).union(c.subtract(b))}
    out = None
    for name, t in ops.items():
        n = t.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("jaccard_slices", """
, x as (select pid, vessel, list(distinct s) a from (select pid, vessel, unnest(slice_indices) s from l) group by 1, 2), y as (select pid, territory vessel, list(distinct slice_idx) b from r where territory is not null and slice_idx is not null group by 1, 2),
j as (select coalesce(x.pid, y.pid) pid, coalesce(x.vessel, y.vessel) vessel, coalesce(a, []) a, coalesce(b, []) b from x full join y on x.pid = y.pid and x.vessel = y.vessel)
select pid, vessel, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) jaccard from j""")  # fmt: skip
def jaccard_slices(spark, d):
    a = C.lesions(spark, d).select("pid", "vessel", F.explode("slice_indices").alias("s")).groupBy("pid", "vessel").agg(F.collect_set("s").alias("a"))
    b = C.rois(spark, d).where("territory is not null and slice_idx is not null").groupBy("pid", F.col("territory").alias("vessel")).agg(F.collect_set("slice_idx").alias("b"))
    j = a.join(b, ["pid", "vessel"], "full")
    return rounded(J.set_overlap(j, "a", "b").select("pid", "vessel", "jaccard"))


@query("outer_consistency", """
, k as (select cohort, kernel, vessel, median(volume_mm3) - 30 v from l join (select pid, kernel from m) m using (pid) where cohort is not null and kernel in ('j28f/3', 'hr32d/2', 'b33f') group by 1, 2, 3),
p as (select cohort, vessel, max(v) filter (kernel = 'j28f/3') j, max(v) filter (kernel = 'hr32d/2') h, max(v) filter (kernel = 'b33f') b from k group by 1, 2)
select cohort, vessel, round(j, 6) j, round(h, 6) h, round(b, 6) b, ((j is not null)::int + (h is not null)::int + (b is not null)::int)::int n_present, coalesce(j <> 0 and sign(j) = sign(h) and sign(j) = sign(b), false) same_sign from p""")  # fmt: skip
def outer_consistency(spark, d):
    j = C.lesions(spark, d).where("cohort is not null").join(C.manifest(spark, d).select("pid", "kernel"), "pid")
    j = j.where(F.col("kernel").isin("j28f/3", "hr32d/2", "b33f"))
    g = W.quantiles(j, ["cohort", "kernel", "vessel"], "volume_mm3", {"v": 0.5}).withColumn("v", F.col("v") - 30)
    t = [(n, g.where(F.col("kernel") == k)) for n, k in (("j", "j28f/3"), ("h", "hr32d/2"), ("b", "b33f"))]
    return rounded(J.consistency(t, ["cohort", "vessel"], "v"))


@query("kernel_phenotype_crosstab", """
select kernel, count(*) filter (phenotype = 'focal') focal, count(*) filter (phenotype = 'diffuse') diffuse from f group by 1""")
def kernel_phenotype_crosstab(spark, d):
    return A.crosstab(C.features(spark, d), "kernel", "phenotype", ["focal", "diffuse"])


@query("crosstab_margins", """
select coalesce(kernel, 'All') kernel, coalesce(p, 'All') phenotype, count(*) n, (grouping(kernel) * 2 + grouping(p))::int margin from (select kernel, coalesce(phenotype, 'none') p from f) group by cube (kernel, p)""")
def crosstab_margins(spark, d):
    return A.crosstab_margins(C.features(spark, d), "kernel", "phenotype")


@query("vessel_fractions", """
, c as (select pid, count(*) filter (vessel = 'LAD') a, count(*) filter (vessel = 'RCA') b, count(*) filter (vessel = 'LCx') x, count(*) filter (vessel = 'LM') y from l group by 1)
select pid, round(a / (a + b + x + y), 6) "f_LAD", round(b / (a + b + x + y), 6) "f_RCA", round(x / (a + b + x + y), 6) "f_LCx", round(y / (a + b + x + y), 6) "f_LM",
  (list_sort([(-a, 'LAD'), (-b, 'RCA'), (-x, 'LCx'), (-y, 'LM')])[1])[2] top from c""")  # fmt: skip
def vessel_fractions(spark, d):
    return rounded(A.fractions(C.lesions(spark, d), "pid", "vessel", ["LAD", "RCA", "LCx", "LM"]))


@query("paper_table", """
, t as (select *, case when agatston_total = 0 then '0' when agatston_total between 1 and 99 then '1' when agatston_total between 100 and 399 then '2' when agatston_total >= 400 then '3' end c from f)
select cohort, phenotype, count(*) n, round(quantile_cont(agatston_total, 0.5), 6) median, round(quantile_cont(agatston_total, 0.25), 6) iqr_lower, round(quantile_cont(agatston_total, 0.75), 6) iqr_upper,
  round(100.0 * count(*) filter (c = '0') / count(*), 6) pct_0, round(100.0 * count(*) filter (c = '1') / count(*), 6) pct_1_99, round(100.0 * count(*) filter (c = '2') / count(*), 6) pct_100_399, round(100.0 * count(*) filter (c = '3') / count(*), 6) pct_400
from t group by 1, 2""")  # fmt: skip
def paper_table(spark, d):
    return rounded(A.category_table(C.features(spark, d), ["cohort", "phenotype"], "agatston_total"))


@query("label_mapping", """
, g as (select cohort, phenotype, quantile_cont(n_calcified_arteries, 0.5) md, avg(n_calcified_arteries) mean, count(*) n from f where phenotype is not null group by 1, 2),
s as (select cohort, count(*) k, min((md, mean)) lo, max((md, mean)) hi, arg_min(phenotype, (md, mean)) a, arg_max(phenotype, (md, mean)) b, sum(n) n, min(n) sm from g group by 1)
select cohort, case when k = 2 and lo < hi then a end low, case when k = 2 and lo < hi then b end high, round(sm / n, 6) smallest_share, k = 2 and sm / n > 0.15 balanced from s""")  # fmt: skip
def label_mapping(spark, d):
    return rounded(A.label_mapping(C.features(spark, d), ["cohort"], "phenotype", "n_calcified_arteries"))


@query("feature_audits", """
, a as (select count(*) "rows", count(*) - count(distinct pid) repeated_ids, count(*) filter (agatston_total is null) null_totals,
  count(*) filter (abs(agatston_total - (coalesce(agatston_lad, 0) + coalesce(agatston_rca, 0) + coalesce(agatston_lcx, 0) + coalesce(agatston_lm, 0))) > 0.11) drifting_totals from f)
select * from (unpivot a on "rows", repeated_ids, null_totals, drifting_totals into name audit value n)""")  # fmt: skip
def feature_audits(spark, d):
    return A.audits(C.features(spark, d), ["agatston_lad", "agatston_rca", "agatston_lcx", "agatston_lm"], "agatston_total")


@query("roundtrip_pass_rate", """
select pid, count(*) n, count(*) filter (vessel is null) n_dirty, round(coalesce(avg(case when vessel is not null then (coalesce(max_hu >= mean_hu, false))::int end), 1), 6) pass_rate,
  coalesce(bool_and(case when vessel is not null then coalesce(max_hu >= mean_hu, false) end), true) all_pass from r group by 1""")  # fmt: skip
def roundtrip_pass_rate(spark, d):
    ok = F.coalesce(F.col("max_hu") >= F.col("mean_hu"), F.lit(False))
    return rounded(A.pass_rates(C.rois(spark, d), ["pid"], ok, F.col("vessel").isNull()))


@query("levene_spread", LONG + """
, d as (select feature, phenotype g, v from x where v is not null and phenotype is not null), md as (select feature, g, quantile_cont(v, 0.5) c from d group by 1, 2),
e as (select feature, g, abs(v - c) a from d join md using (feature, g)), p as (select feature, g, count(*) n, avg(a) m, var_pop(a) vp from e group by 1, 2),
s as (select feature, count(*) k, sum(n) n, sum(n * m) / sum(n) mean, sum(n * vp) within_, sum(n * m * m) sq from p group by 1)
select feature, k, n::bigint n, round(case when within_ > 0 then ((sq - n * mean * mean) / (k - 1)) / (within_ / (n - k)) end, 4) f from s""")  # fmt: skip
def levene_spread(spark, d):
    long = T.long_form(C.features(spark, d), ["phenotype"], PARTS)
    return T.brown_forsythe(long, ["feature"], "phenotype", "value").select("feature", "k", "n", F.round("f", 4).alias("f"))


@query("spearman_rho", """
, d as (select cohort, agatston_total x, max_hu_global y from f where agatston_total is not null and max_hu_global is not null),
k as (select cohort, rank() over (partition by cohort order by x) + (count(*) over (partition by cohort, x) - 1) / 2 rx, rank() over (partition by cohort order by y) + (count(*) over (partition by cohort, y) - 1) / 2 ry from d)
select cohort, count(*) n, round(case when count(*) >= 5 and var_pop(rx) > 0 and var_pop(ry) > 0 then corr(rx, ry) end, 6) rho from k group by 1""")  # fmt: skip
def spearman_rho(spark, d):
    return rounded(T.spearman(C.features(spark, d), ["cohort"], "agatston_total", "max_hu_global"))


@query("kendall_tau_b", """
, d as (select phenotype g, n_calcified_arteries x, case when agatston_total < 10 then 0 when agatston_total < 100 then 1 when agatston_total < 400 then 2 else 3 end y from f where n_calcified_arteries is not null and agatston_total is not null),
c as (select g, x, y, count(*) n from d group by all),
p as (select a.g, sum(a.n * b.n * sign(b.y - a.y)) s from c a join c b on a.g is not distinct from b.g and b.x > a.x group by 1),
tx as (select g, sum(t * (t - 1) / 2) t, sum(t) n from (select g, x, sum(n) t from c group by 1, 2) group by 1), ty as (select g, sum(t * (t - 1) / 2) t from (select g, y, sum(n) t from c group by 1, 2) group by 1)
select tx.g phenotype, tx.n::bigint n, round(coalesce(s, 0) / nullif(sqrt((tx.n * (tx.n - 1) / 2 - tx.t) * (tx.n * (tx.n - 1) / 2 - ty.t)), 0), 6) tau
from tx join ty on tx.g = ty.g left join p on tx.g = p.g where tx.g is not null""")  # fmt: skip
def kendall_tau_b(spark, d):
    f = C.features(spark, d).where("phenotype is not null and agatston_total is not null").withColumn("level", S.steps(F.col("agatston_total"), [(10, 0), (100, 1), (400, 2)], 3))
    return rounded(T.kendall_tau_b(f, ["phenotype"], "n_calcified_arteries", "level"))


@query("chi_square_stat", """
, c as (select cohort, phenotype a, n_calcified_arteries b, count(*) o from f where phenotype is not null and n_calcified_arteries is not null group by all),
ra as (select cohort, a, sum(o) r from c group by 1, 2), cb as (select cohort, b, sum(o) c from c group by 1, 2), t as (select cohort, sum(o) n from c group by 1),
e as (select ra.cohort, ra.a, cb.b, coalesce(o, 0) o, r * cb.c / n e, n from ra join cb on ra.cohort = cb.cohort join t on t.cohort = ra.cohort left join c on c.cohort = ra.cohort and c.a = ra.a and c.b = cb.b),
s as (select cohort, any_value(n) n, (count(distinct a) - 1) * (count(distinct b) - 1) dof, sum((o - e) ** 2 / e) p, sum(greatest(abs(o - e) - 0.5, 0) ** 2 / e) y from e group by 1)
select cohort, n::bigint n, dof, round(case when dof = 1 then y when dof > 1 then p else 0 end, 5) chi2 from s""")  # fmt: skip
def chi_square_stat(spark, d):
    return rounded(T.chi_square(C.features(spark, d), ["cohort"], "phenotype", "n_calcified_arteries"), chi2=5)


@query("gof_cramers_v", """
, c as (select cohort g, vessel b, count(*) o from l where cohort is not null and vessel is not null group by all), bs as (select b, sum(o) bb from c group by 1), n as (select sum(o) n from c), sz as (select g, sum(o) gg from c group by 1),
e as (select sz.g, gg, coalesce(o, 0) o, gg * bb / n e from sz cross join bs cross join n left join c on c.g = sz.g and c.b = bs.b),
s as (select g, any_value(gg) gg, count(*) k, sum((o - e) ** 2 / e) x from e group by 1)
select g cohort, gg::bigint n, k - 1 dof, round(x, 5) chi2, round(sqrt(x / (gg * (k - 1))), 6) cramers_v from s""")  # fmt: skip
def gof_cramers_v(spark, d):
    return rounded(T.goodness_of_fit(C.lesions(spark, d), "cohort", "vessel"), chi2=5)


@query("jonckheere_j", """
, d as (select phenotype p, n_calcified_arteries g, agatston_total v from f where phenotype is not null and n_calcified_arteries in (1, 2, 3, 4) and agatston_total is not null),
u as (select a.p, sum(case when b.v > a.v then 1 when b.v = a.v then 0.5 else 0 end) j from d a join d b on a.p = b.p and a.g < b.g group by 1),
n as (select p, sum(c) n, sum(c * c) s2, sum(c * c * (2 * c + 3)) s3 from (select p, g, count(*)::double c from d group by 1, 2) group by 1)
select p phenotype, j::double j, n::bigint n, round((j - (n * n - s2) / 4) / sqrt((n * n * (2 * n + 3) - s3) / 72), 5) z from u join n using (p)""")  # fmt: skip
def jonckheere_j(spark, d):
    f = C.features(spark, d).where("phenotype is not null and agatston_total is not null")
    return rounded(T.jonckheere(f, ["phenotype"], "n_calcified_arteries", "agatston_total", [1, 2, 3, 4]), z=5)


@query("smd_by_cohort", """
select cohort, round(case when sqrt((va + vb) / 2) > 0 then (a - b) / sqrt((va + vb) / 2) when sqrt((va + vb) / 2) = 0 and a = b then 0 end, 6) smd from (
  select cohort, avg(max_hu_global) filter (phenotype = 'focal') a, avg(max_hu_global) filter (phenotype <> 'focal') b, var_samp(max_hu_global) filter (phenotype = 'focal') va, var_samp(max_hu_global) filter (phenotype <> 'focal') vb
  from f where max_hu_global is not null and phenotype is not null group by 1)""")  # fmt: skip
def smd_by_cohort(spark, d):
    return rounded(T.standardised_difference(C.features(spark, d).where("phenotype is not null"), ["cohort"], F.col("phenotype") == "focal", "max_hu_global"))


@query("icc_absolute", """
, e as (select cohort, lesion_id s, i k, scores[i] v from l, range(1, 4) t(i) where cohort is not null and len(scores) = 6), d as (select * from e where v is not null and not isnan(v)),
full_ as (select cohort, s from d group by 1, 2 having count(*) = 3), c as (select d.* from d join full_ using (cohort, s)),
a as (select cohort, var_pop(m) vs, count(*)::double n from (select cohort, s, avg(v) m from c group by 1, 2) group by 1), b as (select cohort, var_pop(m) vr, count(*)::double k from (select cohort, k, avg(v) m from c group by 1, 2) group by 1),
t as (select cohort, var_pop(v) vt from c group by 1), g as (select *, k * n * vs / (n - 1) msr, n * k * vr / (k - 1) msc, n * k * (vt - vs - vr) / ((n - 1) * (k - 1)) mse from a join b using (cohort) join t using (cohort))
select cohort, n::bigint n_subjects, k::bigint n_raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) icc from g""")  # fmt: skip
def icc_absolute(spark, d):
    e = C.lesions(spark, d).where("cohort is not null and size(scores) = 6").select("cohort", "lesion_id", F.posexplode(F.slice("scores", 1, 3)).alias("rater", "v"))
    e = e.where("v is not null and not isnan(v)")
    return rounded(T.icc(e, ["cohort"], "lesion_id", "rater", "v"))


@query("feature_moments", LONG + """
select cohort, feature, count(v) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) sd, round(case when count(v) > 2 and stddev_samp(v) > 0 then skewness(v) end, 5) skewness, coalesce(stddev_samp(v) >= 0.01, false) kept
from x where v is not null group by 1, 2""")  # fmt: skip
def feature_moments(spark, d):
    return rounded(T.moments(T.long_form(C.features(spark, d), ["cohort"], PARTS).where("value is not null"), ["cohort", "feature"]), skewness=5)


@query("zscore", """
select pid, round((max_hu_global - avg(max_hu_global) over (partition by cohort)) / coalesce(nullif(stddev_samp(max_hu_global) over (partition by cohort), 0), 1), 6) max_hu_global from f where cohort is not null""")
def zscore(spark, d):
    return rounded(T.z_scores(C.features(spark, d).where("cohort is not null"), ["cohort"], ["max_hu_global"]).select("pid", "max_hu_global"))


@query("r2_by_kernel", LONG + """
, p as (select feature, kernel, count(*) n, avg(v) m, var_pop(v) vp from x where v is not null group by 1, 2)
, s as (select feature, sum(n * m * m) - sum(n * m) ** 2 / sum(n) b, sum(n * vp) w, sum(n)::bigint n from p group by 1)
select feature, n, round(case when b + w > 0 then b / (b + w) else 0 end, 6) r2 from s""")  # fmt: skip
def r2_by_kernel(spark, d):
    return rounded(T.r2_by_batch(T.long_form(C.features(spark, d), ["kernel"], PARTS), ["feature"], "kernel"))


@query("residualise_burden", """
, g as (select cohort, regr_slope(max_hu_global, ln(1 + agatston_total)) b, regr_intercept(max_hu_global, ln(1 + agatston_total)) a, avg(max_hu_global) mm, var_pop(ln(1 + agatston_total)) vx from f where max_hu_global is not null and agatston_total is not null group by 1)
select pid, round(max_hu_global - case when vx > 0 then a + b * ln(1 + agatston_total) when agatston_total is not null then mm end, 5) residual from f left join g using (cohort)""")  # fmt: skip
def residualise_burden(spark, d):
    f = C.features(spark, d).withColumn("burden", F.log1p("agatston_total"))
    return rounded(T.residualise(f, ["cohort"], "max_hu_global", "burden").select("pid", "residual"), residual=5)


@query("yeo_johnson_fixed", """
select lesion_id, round(((mean_hu_weighted / 100 + 1) ** 0.3 - 1) / 0.3, 6) a, round(case when scores[1] >= 0 then ((scores[1] + 1) ** 0.3 - 1) / 0.3 else -((1 - scores[1]) ** 1.7 - 1) / 1.7 end, 6) b
from l where mean_hu_weighted is not null and len(scores) = 6 and scores[1] is not null and not isnan(scores[1])""")  # fmt: skip
def yeo_johnson_fixed(spark, d):
    les = C.lesions(spark, d).where("mean_hu_weighted is not null and size(scores) = 6").withColumn("s", F.col("scores")[0]).where("s is not null and not isnan(s)")
    return rounded(les.select("lesion_id", S.yeo_johnson(F.col("mean_hu_weighted") / 100, F.lit(0.3)).alias("a"), S.yeo_johnson(F.col("s"), F.lit(0.3)).alias("b")))


@query("clr_transform", """
, c as (select pid, [count(*) filter (vessel = 'LAD'), count(*) filter (vessel = 'RCA'), count(*) filter (vessel = 'LCx'), count(*) filter (vessel = 'LM')] p from l group by 1),
q as (select pid, list_transform(p, lambda x: greatest(x / list_sum(p), 1 / (2 * list_sum(p)))) p from c where list_sum(p) > 0), k as (select pid, list_transform(p, lambda x: ln(x / list_sum(p))) p from q)
select pid, round(p[1] - list_avg(p), 6) lad, round(p[2] - list_avg(p), 6) rca, round(p[3] - list_avg(p), 6) lcx, round(p[4] - list_avg(p), 6) lm from k""")  # fmt: skip
def clr_transform(spark, d):
    c = A.crosstab(C.lesions(spark, d), "pid", "vessel", ["LAD", "RCA", "LCx", "LM"])
    parts = F.array(*[F.col(x).cast("double") for x in ("LAD", "RCA", "LCx", "LM")])
    c = c.withColumn("p", S.centred_log_ratio(parts, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))).where("p is not null")
    return rounded(c.select("pid", *[F.col("p")[i].alias(n) for i, n in enumerate(("lad", "rca", "lcx", "lm"))]))


@query("ari_contingency", """
, d as (select cohort, n_calcified_arteries a, phenotype b, count(*)::double n from f where n_calcified_arteries is not null and phenotype is not null group by all),
s as (select cohort, sum(n * (n - 1) / 2) s, sum(n) t from d group by 1), a as (select cohort, sum(n * (n - 1) / 2) sa from (select cohort, a, sum(n) n from d group by 1, 2) group by 1), b as (select cohort, sum(n * (n - 1) / 2) sb from (select cohort, b, sum(n) n from d group by 1, 2) group by 1)
select cohort, t::bigint n, round(case when (sa + sb) / 2 = sa * sb / (t * (t - 1) / 2) then 1 else (s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)) end, 6) ari from s join a using (cohort) join b using (cohort)""")  # fmt: skip
def ari_contingency(spark, d):
    return rounded(T.adjusted_rand(C.features(spark, d), ["cohort"], "n_calcified_arteries", "phenotype"))


@query("within_dispersion", """
, p as (select cohort, vessel, count(*) n, (var_pop(volume_mm3) + var_pop(mean_hu_weighted) + var_pop(max_hu)) * count(*) w from l where vessel is not null and volume_mm3 is not null and mean_hu_weighted is not null and max_hu is not null group by 1, 2)
select cohort, round(sum(case when n >= 2 then w else 0 end), 2) w, count(*) k from p group by 1""")  # fmt: skip
def within_dispersion(spark, d):
    les = C.lesions(spark, d).where("volume_mm3 is not null and mean_hu_weighted is not null and max_hu is not null")
    return rounded(T.dispersion(les, ["cohort"], "vessel", ["volume_mm3", "mean_hu_weighted", "max_hu"]), w=2)


@query("pac_score", """
, p as (select reader, roi_a, roi_b, avg(is_match::int) v from roi_links where is_match is not null group by 1, 2, 3) select reader, count(*) n, round(avg((v > 0.1 and v < 0.9)::int), 6) pac from p group by 1""")
def pac_score(spark, d):
    from cohortlake.session import table

    p = table(spark, d, "roi_links").where("is_match is not null").groupBy("reader", "roi_a", "roi_b").agg(F.avg(F.col("is_match").cast("double")).alias("v"))
    return rounded(T.ambiguous_share(p, ["reader"], "v"))


@query("wilson_interval", """
, c as (select cohort, count(*) n, count(*) filter (phenotype = 'focal') k from f group by 1), q as (select *, k / n p, 1.959963984540054 z from c)
select cohort, n, k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) high from q""")  # fmt: skip
def wilson_interval(spark, d):
    c = C.features(spark, d).groupBy("cohort").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("phenotype") == "focal", F.lit(False))).alias("k"))
    w = S.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return rounded(c.select("cohort", "n", "k", w["low"].alias("low"), w["high"].alias("high")))


@query("directional_table", LONG + """
, d as (select feature, quantile_cont(v, 0.5) filter (phenotype = 'diffuse') - quantile_cont(v, 0.5) filter (phenotype = 'focal') diff from x group by 1)
select feature, round(diff, 6) diff, sign(diff)::int observed, case when feature = 'max_hu_global' then 0 else 1 end predicted, coalesce(sign(diff)::int = case when feature = 'max_hu_global' then 0 else 1 end, false) matches from d""")  # fmt: skip
def directional_table(spark, d):
    long = T.long_form(C.features(spark, d), ["phenotype"], PARTS)
    g = median_difference(long, ["feature"], "value", "diff")
    predicted = F.when(F.col("feature") == "max_hu_global", 0).otherwise(1)
    return rounded(g.select("feature", "diff", F.signum("diff").cast("int").alias("observed"), predicted.alias("predicted"), F.coalesce(F.signum("diff").cast("int") == predicted, F.lit(False)).alias("matches")))


@query("stratified_replication", """
, c as (select cohort, quantile_cont(max_hu_global, 1.0 / 3) a, quantile_cont(max_hu_global, 2.0 / 3) b from f group by 1),
t as (select f.*, case when max_hu_global is null then null when max_hu_global <= a then 1 when max_hu_global <= b then 2 else 3 end tertile from f join c using (cohort)),
s as (select cohort, tertile, quantile_cont(agatston_total, 0.5) filter (phenotype = 'diffuse') > quantile_cont(agatston_total, 0.5) filter (phenotype = 'focal') hit from t where tertile is not null group by 1, 2)
select cohort, count(*) n_tertiles, count(*) filter (hit) n_match, count(*) filter (hit) >= 2 replicated from s group by 1""")  # fmt: skip
def stratified_replication(spark, d):
    t = W.tertile(C.features(spark, d), ["cohort"], "max_hu_global").where("tertile is not null")
    s = median_difference(t, ["cohort", "tertile"], "agatston_total", "diff").withColumn("hit", F.col("diff") > 0)
    n = F.count_if(F.coalesce("hit", F.lit(False)))
    return s.groupBy("cohort").agg(F.count("*").alias("n_tertiles"), n.alias("n_match"), (n >= 2).alias("replicated"))


@query("phenotype_carriers", """
, c as (select pid, bool_or(vessel = 'LM') lm, count(*) n from l where pid is not null group by 1)
select cohort, count(*) n, count(*) filter (lm) carriers, round(avg(agatston_total) filter (lm), 6) mean_carrier, round(avg(agatston_total) filter (not lm), 6) mean_other from f join c using (pid) group by 1""")  # fmt: skip
def phenotype_carriers(spark, d):
    c = C.lesions(spark, d).where("pid is not null").groupBy("pid").agg(F.bool_or(F.col("vessel") == "LM").alias("lm"))
    j = C.features(spark, d).join(c, "pid")
    return rounded(j.groupBy("cohort").agg(F.count("*").alias("n"), F.count_if("lm").alias("carriers"), F.avg(F.when(F.col("lm"), F.col("agatston_total"))).alias("mean_carrier"), F.avg(F.when(~F.col("lm"), F.col("agatston_total"))).alias("mean_other")))


@query("acquisition_summary", """
select kernel, count(slice_thickness) n, min(slice_thickness) min, round(quantile_cont(slice_thickness, 0.25), 6) q1, round(quantile_cont(slice_thickness, 0.5), 6) median, round(quantile_cont(slice_thickness, 0.75), 6) q3, max(slice_thickness) max from m group by 1""")
def acquisition_summary(spark, d):
    m = C.manifest(spark, d)
    g = m.groupBy("kernel").agg(F.count("slice_thickness").alias("n"), F.min("slice_thickness").alias("min"), F.max("slice_thickness").alias("max"))
    return rounded(W.null_safe_join(g, W.quantiles(m, ["kernel"], "slice_thickness", {"q1": 0.25, "median": 0.5, "q3": 0.75}), ["kernel"]))


@query("lesion_class_rollup", """
, g as (select cohort, vessel, median(mean_hu_weighted) h, median(volume_mm3) v, count(*) n from l where cohort is not null group by 1, 2), k as (select *, case when h >= 500 then 'dense' when h <= 230 and v <= 15 then 'soft' else 'moderate' end c from g)
select cohort, c as class, sum(n)::bigint n, round(log10(max(v) / greatest(min(v), 1e-9)), 6) log_range from k group by 1, 2""")  # fmt: skip
def lesion_class_rollup(spark, d):
    les, by = C.lesions(spark, d).where("cohort is not null"), ["cohort", "vessel"]
    g = les.groupBy(*by).agg(F.count("*").alias("n"))
    for c, name in (("mean_hu_weighted", "h"), ("volume_mm3", "v")):
        g = W.null_safe_join(g, W.quantiles(les, by, c, {name: 0.5}), by)
    k = g.withColumn("class", S.lesion_class(F.col("h"), F.col("v")))
    return rounded(k.groupBy("cohort", "class").agg(F.sum("n").alias("n"), F.log10(F.max("v") / F.greatest(F.min("v"), F.lit(1e-9))).alias("log_range")))
