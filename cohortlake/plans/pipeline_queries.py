"""Queries of preparation, profiles, consistency, gates and verdicts, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import scoring as S
from cohortlake.operators import aggregates as A
from cohortlake.operators import joins as J
from cohortlake.operators import preparation as P
from cohortlake.operators import statistics as T
from cohortlake.operators import verdicts as V
from cohortlake.operators import windows as W
from cohortlake.plans.cohort_queries import BURDEN, CONTRAST, LONG, PARTS, median_difference, rounded, thickness
from cohortlake.session import Scratch, table
from cohortlake.sources import cohort as C

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = "with" + C.SQL_TABLES + sql
        return fn

    return add


def _simpson(density: str, upto: str) -> str:
    """SQL of the integral of a density of x from 0 to ``upto``, by 800 parabolas."""
    return f"(list_sum(list_transform(range(0, 1601), lambda i: (case when i = 0 or i = 1600 then 1 when i % 2 = 1 then 4 else 2 end) * ({density.replace('{x}', f'({upto} * i / 1600)')}))) * {upto} / 1600 / 3)"


#: Two-sided tails in SQL, from the columns z, and f with one and df2 degrees of freedom.
NORMAL_P = "greatest(0, 1 - 2 * " + _simpson("exp(-({x} ** 2) / 2) / sqrt(2 * pi())", "least(abs(z), 12.0)") + ")"
T_P = "greatest(0, 1 - 2 * " + _simpson("exp(lgamma((df2 + 1) / 2) - lgamma(df2 / 2) - ln(df2 * pi()) / 2 - (df2 + 1) / 2 * ln(1 + {x} ** 2 / df2))", "least(sqrt(f), 40.0)") + ")"
RULES_BY_KERNEL = """
, x0 as (select pid, kernel, phenotype g, unnest(['agatston_lad', 'agatston_rca', 'agatston_lcx', 'agatston_lm', 'agatston_total', 'max_hu_global']) feature, unnest([agatston_lad, agatston_rca, agatston_lcx, agatston_lm, agatston_total, max_hu_global]) v from f),
d as (select kernel, feature, g, v from x0 where v is not null and g in ('focal', 'diffuse') and kernel in ('j28f/3', 'hr32d/2', 'b33f')),
k as (select *, rank() over (partition by kernel, feature order by v) + (count(*) over (partition by kernel, feature, v) - 1) / 2 r, count(*) over (partition by kernel, feature, v) t from d),
a as (select kernel, feature, count(*) filter (g = 'focal') n_a, count(*) filter (g = 'diffuse') n_b, sum(r) filter (g = 'focal') ra, sum(t * t - 1.0) ties from k group by 1, 2 having count(*) filter (g = 'focal') > 0 and count(*) filter (g = 'diffuse') > 0),
u as (select kernel, feature, n_a, n_b, ra - n_a * (n_a + 1) / 2 u, n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0))) var from a),
c as (select kernel, feature, 2 * u / (n_a * n_b) - 1 delta, case when var <= 0 then 0 else sign(u - n_a * n_b / 2) * greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(var) end z from u),
p as (select kernel, feature, delta, """ + NORMAL_P + """ p from c),
q as (select *, row_number() over (partition by kernel order by p, feature) r, count(*) over (partition by kernel) n from p),
h as (select kernel, feature, delta, least(1, min(p * n / r) over (partition by kernel order by r desc)) fdr from q),
w as (select feature, max(delta) filter (kernel = 'j28f/3') dj, max(delta) filter (kernel = 'hr32d/2') dh, max(delta) filter (kernel = 'b33f') db, max(fdr) filter (kernel = 'j28f/3') fj, max(fdr) filter (kernel = 'hr32d/2') fh, max(fdr) filter (kernel = 'b33f') fb from h group by 1),
rules as (select feature, dj, dh, db, coalesce(dj <> 0 and sign(dj) = sign(dh) and sign(dj) = sign(db), false) same_sign, coalesce((fj < 0.05)::int, 0) + coalesce((fh < 0.05)::int, 0) + coalesce((fb < 0.05)::int, 0) >= 2 significant,
  coalesce(abs(dj) >= 0.05 and abs(dh) >= 0.05 and abs(db) >= 0.05, false) large from w)"""  # fmt: skip


def _rules(spark, d):
    long = T.long_form(C.features(spark, d).where(F.col("kernel").isin("j28f/3", "hr32d/2", "b33f")), ["kernel", "phenotype"], PARTS)
    c = T.with_normal_p(T.rank_contrast(long, ["kernel", "feature"], "phenotype", "focal", "diffuse", "value").where("cliffs_delta is not null"))
    c = W.benjamini_hochberg(c, ["kernel"], "p", "feature", "fdr").withColumnRenamed("cliffs_delta", "delta")
    c = c.withColumn("run", F.when(F.col("kernel") == "j28f/3", "j").when(F.col("kernel") == "hr32d/2", "h").otherwise("b"))
    return V.consistency_rules(c, ["feature"], "run", ["j", "h", "b"], least_delta=0.05)


@query("consistency_rules", RULES_BY_KERNEL + " select feature, round(dj, 6) delta_j, round(dh, 6) delta_h, round(db, 6) delta_b, same_sign, significant, large, same_sign and significant and large robust from rules")
def consistency_rules(spark, d):
    """Do the phenotypes differ alike under three kernels: sign, adjusted significance, size."""
    return rounded(_rules(spark, d))


@query("robust_counts", RULES_BY_KERNEL + """ select case when feature like 'agatston%' then 'burden' else 'intensity' end family, count(*) n, count(*) filter (same_sign) n_same_sign, count(*) filter (significant) n_significant, count(*) filter (large) n_large,
  count(*) filter (same_sign and significant and large) n_robust from rules group by 1""")  # fmt: skip
def robust_counts(spark, d):
    r = _rules(spark, d).withColumn("family", S.first_prefix(F.col("feature"), {"agatston": "burden"}, "intensity"))
    return V.rule_counts(r, ["family"])


@query("contrast_p_values", CONTRAST + ", p as (select feature, z, " + NORMAL_P + """ p from c), q as (select *, row_number() over (order by p, feature) r, count(*) over () n from p)
select feature, round(p, 6) p, round(least(1, min(p * n / r) over (order by r desc)), 6) p_adjusted from q""")  # fmt: skip
def contrast_p_values(spark, d):
    """Rank contrasts of the phenotypes with p and its step-up adjustment."""
    long = T.long_form(C.features(spark, d), ["phenotype"], PARTS)
    c = T.with_normal_p(T.rank_contrast(long, ["feature"], "phenotype", "focal", "diffuse", "value")).withColumn("family", F.lit(1))
    return rounded(W.benjamini_hochberg(c, ["family"], "p", "feature").select("feature", "p", "p_adjusted"))


@query("cluster_profiles", LONG + """
, y as (select cohort, feature, v from x where cohort is not null),
k as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2 r, count(*) over (partition by feature, v) t, count(*) over (partition by feature) m from y where v is not null),
w as (select feature, max(m) m, sum(t * t - 1.0) ties from k group by 1), s as (select cohort, feature, sum(r) r from k group by 1, 2),
g as (select cohort, feature, count(*) n, count(v) n_used, count(*) filter (v <> 0) n_nonzero, quantile_cont(v, 0.5) median, quantile_cont(v, 0.25) lo, quantile_cont(v, 0.75) hi from y group by 1, 2),
j as (select g.*, s.r - n_used * (n_used + 1) / 2 u, m - n_used b, n_used * (m - n_used) / 12.0 * ((m + 1) - ties / (m * (m - 1.0))) var, coalesce(n_used >= 5 and m - n_used >= 5, false) ok from g left join s using (cohort, feature) left join w using (feature))
select cohort, feature, n, n_used, n_nonzero, round(median, 6) median, round(lo, 6) iqr_lower, round(hi, 6) iqr_upper, round(case when ok then 2 * u / (n_used * b) - 1 end, 6) cliffs_delta,
  round(case when ok then case when var <= 0 then 0 else sign(u - n_used * b / 2) * greatest(abs(u - n_used * b / 2) - 0.5, 0) / sqrt(var) end end, 4) z, not ok insufficient from j""")  # fmt: skip
def cluster_profiles(spark, d):
    """Every cohort against all others, feature by feature."""
    return rounded(V.one_vs_rest(T.long_form(C.features(spark, d), ["cohort"], PARTS), "cohort"), z=4)


@query("monotonicity_table", LONG + """
, y as (select x.feature, x.v, f.agatston_total b, f.n_calcified_arteries o from x join f using (pid) where x.feature <> 'agatston_total'),
kb as (select feature, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2 rv, rank() over (partition by feature order by b) + (count(*) over (partition by feature, b) - 1) / 2 rb from y where v is not null and b is not null),
ko as (select feature, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2 rv, rank() over (partition by feature order by o) + (count(*) over (partition by feature, o) - 1) / 2 ro from y where v is not null and o is not null),
a as (select feature, count(*) n, corr(rv, rb) rho_burden from kb group by 1), c as (select feature, corr(rv, ro) rho_other from ko group by 1)
select feature, n, round(rho_burden, 6) rho_burden, round(rho_other, 6) rho_other, case when abs(rho_burden) >= 0.5 and abs(rho_other) < 0.3 then 'burden' when abs(rho_other) >= 0.5 and abs(rho_burden) < 0.3 then 'other' else 'mixed' end axis from a join c using (feature)""")  # fmt: skip
def monotonicity_table(spark, d):
    """Which axis each feature follows: the burden, or the number of calcified arteries."""
    f = C.features(spark, d).withColumn("_arteries", F.col("n_calcified_arteries").cast("double")).withColumn("_burden", F.col("agatston_total"))
    return rounded(V.monotonicity(f, [c for c in PARTS if c != "agatston_total"], "_burden", "_arteries"))


@query("classification_summary", BURDEN + """
, t as (select territory, case when max_hu >= 130 then case when max_hu < 200 then 'd1' when max_hu < 300 then 'd2' when max_hu < 400 then 'd3' else 'd4' end end c from r where territory is not null)
select territory, count(*) filter (c = 'd1') d1, count(*) filter (c = 'd2') d2, count(*) filter (c = 'd3') d3, count(*) filter (c = 'd4') d4, count(*) total from t group by 1""")  # fmt: skip
def classification_summary(spark, d):
    r = C.rois(spark, d).where("territory is not null").select("territory", S.density_tier(F.col("max_hu")).alias("tier"))
    return V.class_counts(r, ["territory"], "tier", ["d1", "d2", "d3", "d4"])


@query("orthogonality_table", LONG + """
, d as (select feature, phenotype g, v from x where v is not null and phenotype in ('focal', 'diffuse')),
k as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2 r, count(*) over (partition by feature, v) t from d),
a as (select feature, count(*) filter (g = 'focal') n_a, count(*) filter (g = 'diffuse') n_b, sum(r) filter (g = 'focal') ra, sum(t * t - 1.0) ties from k group by 1),
u as (select feature, n_a, n_b, ra - n_a * (n_a + 1) / 2 u, n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0))) var from a),
c as (select feature, n_a, n_b, 2 * u / (n_a * n_b) - 1 delta, case when var <= 0 then 0 else sign(u - n_a * n_b / 2) * greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(var) end z from u),
md as (select feature, g, quantile_cont(v, 0.5) c from d group by 1, 2), e as (select feature, g, abs(v - c) a from d join md using (feature, g)), p as (select feature, g, count(*) n, avg(a) m, var_pop(a) vp from e group by 1, 2),
s as (select feature, count(*) kk, sum(n) n, sum(n * m) / sum(n) mean, sum(n * vp) within_, sum(n * m * m) sq from p group by 1),
fs as (select feature, ((sq - n * mean * mean) / (kk - 1)) / (within_ / (n - kk)) f, (n - kk)::double df2 from s),
t as (select feature, n_a, n_b, delta, """ + NORMAL_P + " location_p, f, " + T_P + """ spread_p from c join fs using (feature))
select feature, n_a, n_b, round(delta, 6) cliffs_delta, round(location_p, 6) location_p, round(f, 4) f, round(spread_p, 6) spread_p, case when location_p < 0.05 and spread_p < 0.05 then 'confounded' when location_p < 0.05 or spread_p < 0.05 then 'marginal' else 'orthogonal' end as class from t""")  # fmt: skip
def orthogonality_table(spark, d):
    """Location and spread of the phenotypes, and whether either follows the feature."""
    long = T.long_form(C.features(spark, d), ["phenotype"], PARTS).where("value is not null")
    return rounded(V.orthogonality(long, ["feature"], "phenotype", "focal", "diffuse", "value"), f=4)


@query("phenotype_gate", """
, g as (select cohort, phenotype, quantile_cont(max_hu_global, 0.5) m, count(*) n from f where phenotype is not null group by 1, 2),
s as (select cohort, max(m) filter (phenotype = 'focal') a, max(m) filter (phenotype <> 'focal') b, min(n) / sum(n) share, count(*) k from g group by 1)
select cohort, round(a, 6) case_median, round(b, 6) other_median, round(share, 6) smallest_share, coalesce(a >= 130, false) passes, coalesce(a < 0.5 * b, false) warns, k > 1 and share > 0.15 balanced from s""")  # fmt: skip
def phenotype_gate(spark, d):
    """Is the focal phenotype calcified enough to be one, and are the classes balanced."""
    return rounded(V.gate(C.features(spark, d), ["cohort"], "phenotype", "focal", "max_hu_global", 130.0))


@query("canonical_labels", """
, g as (select cohort, phenotype, quantile_cont(n_calcified_arteries, 0.5) md, avg(n_calcified_arteries) mean from f where phenotype is not null group by 1, 2),
s as (select cohort, count(*) k, min((md, mean)) lo, max((md, mean)) hi, arg_min(phenotype, (md, mean)) a, arg_max(phenotype, (md, mean)) b from g group by 1),
t as (select f.pid, case when k = 2 and lo < hi and phenotype = a then 'few' when k = 2 and lo < hi and phenotype = b then 'many' end canonical from f left join s on f.cohort is not distinct from s.cohort)
select pid, canonical, case canonical when 'few' then 0 when 'many' then 1 end code from t""")  # fmt: skip
def canonical_labels(spark, d):
    """Phenotypes renamed by the number of calcified arteries that they go with in their cohort."""
    f = C.features(spark, d)
    return V.canonical_labels(f, A.label_mapping(f, ["cohort"], "phenotype", "n_calcified_arteries"), ["cohort"], "phenotype", "few", "many").select("pid", "canonical", "code")


@query("rescoring_agreement", """
, o as (select pid, scored_ts, phenotype from features where pid is not null and scored_ts is not null and phenotype is not null),
e as (select pid, struct_extract_at(min((scored_ts, phenotype)), 2) x, struct_extract_at(max((scored_ts, phenotype)), 2) y from o group by 1),
d as (select coalesce(f.cohort, 'none') cohort, x, y, count(*)::double n from e join f using (pid) group by all),
sc as (select cohort, sum(n * (n - 1) / 2) s, sum(n) t from d group by 1), sa as (select cohort, sum(n * (n - 1) / 2) sa from (select cohort, x, sum(n) n from d group by 1, 2) group by 1), sb as (select cohort, sum(n * (n - 1) / 2) sb from (select cohort, y, sum(n) n from d group by 1, 2) group by 1),
ri as (select cohort, t::bigint n, case when (sa + sb) / 2 = sa * sb / (t * (t - 1) / 2) then 1 else coalesce((s - sa * sb / nullif(t * (t - 1) / 2, 0)) / ((sa + sb) / 2 - sa * sb / nullif(t * (t - 1) / 2, 0)), 0) end ari from sc join sa using (cohort) join sb using (cohort))
select cohort, n, round(ari, 6) ari, ari >= 0.8 agrees from ri""")  # fmt: skip
def rescoring_agreement(spark, d):
    """First against last label of patients that were scored more than once or once: adjusted Rand index and verdict per cohort."""
    o = table(spark, d, "features").where("pid is not null and scored_ts is not null and phenotype is not null").select("pid", "scored_ts", "phenotype")
    first = o.groupBy("pid").agg(F.min(F.struct("scored_ts", "phenotype"))["phenotype"].alias("x"))
    last = V.last_label(o, "pid", "phenotype", "scored_ts").withColumnRenamed("phenotype", "y")
    j = first.join(last, "pid").join(C.features(spark, d).select("pid", F.coalesce("cohort", F.lit("none")).alias("cohort")), "pid")
    return rounded(T.adjusted_rand(j, ["cohort"], "x", "y").withColumn("agrees", F.col("ari") >= 0.8))


DIRECTION = LONG + """
, g as (select cohort, feature, quantile_cont(v, 0.5) filter (phenotype = 'diffuse') - quantile_cont(v, 0.5) filter (phenotype = 'focal') diff from x where cohort is not null group by 1, 2), prim as (select cohort, count(*) filter (sign(diff) = case when feature = 'max_hu_global' then 0 else 1 end) k from g group by 1),
gs as (select x.cohort, f.n_calcified_arteries > 1 s, feature, quantile_cont(v, 0.5) filter (x.phenotype = 'diffuse') - quantile_cont(v, 0.5) filter (x.phenotype = 'focal') diff from x join f using (pid) where x.cohort is not null and f.n_calcified_arteries is not null group by 1, 2, 3),
st as (select cohort, min(k) k from (select cohort, s, count(*) filter (sign(diff) = case when feature = 'max_hu_global' then 0 else 1 end) k from gs group by 1, 2) group by 1)"""


@query("hypothesis_verdict", DIRECTION + """
select cohort, prim.k primary_matches, st.k least_stratum_matches, case when prim.k >= 4 and coalesce(st.k >= 4, false) then 'supported' when prim.k >= 4 or coalesce(st.k >= 4, false) then 'partial' else 'refuted' end verdict from prim left join st using (cohort)""")
def hypothesis_verdict(spark, d):
    """Six predicted directions per cohort, as a whole and by one or several calcified arteries."""
    f = C.features(spark, d).where("cohort is not null")
    long = Scratch(spark, "verdict").save(T.long_form(f, ["cohort", "phenotype", "n_calcified_arteries"], PARTS).withColumn("stratum", F.col("n_calcified_arteries") > 1), "long")
    match = F.count_if(F.coalesce(F.signum("diff") == F.when(F.col("feature") == "max_hu_global", 0.0).otherwise(1.0), F.lit(False)))
    prim = median_difference(long, ["cohort", "feature"], "value", "diff").groupBy("cohort").agg(match.alias("primary_matches"))
    strata = median_difference(long.where("stratum is not null"), ["cohort", "stratum", "feature"], "value", "diff").groupBy("cohort", "stratum").agg(match.alias("k")).groupBy("cohort").agg(F.min("k").alias("least_stratum_matches"))
    j = prim.join(strata, "cohort", "left")
    return j.withColumn("verdict", V.verdict(F.col("primary_matches"), F.col("least_stratum_matches")))


@query("burden_continuum", BURDEN + """
, c as (select quantile_cont(total, 1.0 / 3) x, quantile_cont(total, 2.0 / 3) y from b), t as (select case when total <= x then 1 when total <= y then 2 else 3 end tertile, lad, rca, lcx, lm from b, c),
u as (select tertile, unnest(['lad', 'rca', 'lcx', 'lm']) territory, unnest([lad, rca, lcx, lm]) v from t), g as (select territory, tertile, avg(v) m from u group by 1, 2), st as (select territory, m - lag(m) over (partition by territory order by tertile) step from g)
select territory, count(*) n, round(min(step), 5) least_step, coalesce(bool_and(step > -1e-6), true) continuous from st group by 1""")  # fmt: skip
def burden_continuum(spark, d):
    """Does each territory's mean score rise over the tertiles of the total."""
    b = Scratch(spark, "continuum").save(A.burden(C.rois(spark, d), thickness(spark, d)), "burden")
    t = W.tertile(b, [], "total")
    g = T.long_form(t, ["tertile"], ["lad", "rca", "lcx", "lm"]).groupBy(F.col("feature").alias("territory"), "tertile").agg(F.avg("value").alias("m"))
    return rounded(V.continuum(g, ["territory"], "tertile", "m"), least_step=5)


@query("patient_flags", BURDEN + """
, k as (select pid, count(*) n_rois, avg((vessel is not null)::int) named, coalesce(bool_or(max_hu > 2500), false) metal from r where pid is not null group by 1)
select pid, n_rois, case when named >= 1 then 'ok' when named >= 0.95 then 'partial' else 'poor' end quality, metal, n_rois < 20 low_burden,
  case when total < 10 then '0-10' when total < 100 then '10-100' when total < 400 then '100-400' when total < 1000 then '400-1000' else '>1000' end risk_level from k join b using (pid)""")  # fmt: skip
def patient_flags(spark, d):
    """Quality by the share of named regions, metal, low burden, and the five-level risk."""
    r, t = C.rois(spark, d), thickness(spark, d)
    k = r.where("pid is not null").groupBy("pid").agg(F.count("*").alias("n_rois"), F.avg(F.col("vessel").isNotNull().cast("double")).alias("named"), F.coalesce(F.bool_or(F.col("max_hu") > 2500), F.lit(False)).alias("metal"))
    j = k.join(A.burden(r, t).select("pid", "total"), "pid")
    return j.select("pid", "n_rois", S.quality_label(F.col("named")).alias("quality"), "metal", (F.col("n_rois") < 20).alias("low_burden"), S.risk_level(F.col("total")).alias("risk_level"))


@query("region_bands", """
select roi_id, case when max_hu >= 130 then case when max_hu < 200 then 'W1' when max_hu < 300 then 'W2' when max_hu < 400 then 'W3' else 'W4' end end band, round(least(greatest(mean_hu, -100), 1500), 6) clipped from r""")
def region_bands(spark, d):
    return rounded(C.rois(spark, d).select("roi_id", S.intensity_band(F.col("max_hu")).alias("band"), S.clip(F.col("mean_hu"), -100.0, 1500.0).alias("clipped")))


@query("slice_fallback", """
, s as (select pid, slice_idx, min(z_mm) sz from r where z_mm is not null and slice_idx is not null and pid is not null group by 1, 2), n as (select pid, max(slice_idx) + 1 n from r where slice_idx is not null group by 1),
q as (select roi_id, r.pid, z_mm z, image_index, slice_thickness / 2 tol from r join (select pid, slice_thickness from m) m using (pid)),
j as (select roi_id, min((round(abs(z - sz), 9), slice_idx)) b from q join s using (pid) where abs(z - sz) <= tol group by 1)
select q.roi_id, coalesce(struct_extract_at(b, 2), case when image_index >= 0 and image_index < n then image_index end) matched, case when b is not null then 'position' when image_index >= 0 and image_index < n then 'index' end matched_via from q left join j using (roi_id) left join n using (pid)""")  # fmt: skip
def slice_fallback(spark, d):
    """The slice of each region by its position, else by the index that its image had, if there is such a slice."""
    r = C.rois(spark, d).select("roi_id", "pid", "slice_idx", "image_index", "z_mm")
    q = r.join(thickness(spark, d), "pid").select("roi_id", "pid", "image_index", F.col("z_mm").alias("z"), (F.col("slice_thickness") / 2).alias("tol"))
    s = r.where("slice_idx is not null and z_mm is not null").groupBy("pid", "slice_idx").agg(F.min("z_mm").alias("sz"))
    n = r.where("slice_idx is not null").groupBy("pid").agg((F.max("slice_idx") + 1).alias("n"))
    j = J.nearest(q, s, ["pid"], "z", "sz", "slice_idx", F.col("tol"), "roi_id").select("roi_id", "pid", "image_index", "matched").join(n, "pid", "left")
    index = F.when((F.col("image_index") >= 0) & (F.col("image_index") < F.col("n")), F.col("image_index"))
    return j.select("roi_id", F.coalesce("matched", index).alias("matched"), F.when(F.col("matched").isNotNull(), "position").when(index.isNotNull(), "index").alias("matched_via"))


@query("lesion_labels", """
, k as (select pid, vessel, lesion_idx, max(case when mean_hu_weighted >= 500 then 'dense' when mean_hu_weighted <= 230 and volume_mm3 <= 15 then 'soft' else 'moderate' end) as class, count(*) c from l where n_rois >= 2 and pid is not null and vessel is not null and lesion_idx is not null group by 1, 2, 3)
select l.lesion_id, k.class as class from l left join k on l.pid = k.pid and l.vessel = k.vessel and l.lesion_idx = k.lesion_idx""")  # fmt: skip
def lesion_labels(spark, d):
    """Each lesion with the class that the lesions of several regions have under its patient, vessel and number."""
    les, keys = C.lesions(spark, d), ["pid", "vessel", "lesion_idx"]
    labelled = les.where("n_rois >= 2").na.drop(subset=keys).groupBy(*keys).agg(F.max(S.lesion_class(F.col("mean_hu_weighted"), F.col("volume_mm3"))).alias("class"))
    return les.select("lesion_id", *keys).join(labelled, keys, "left").select("lesion_id", "class")


@query("lesion_profiles", """
, g as (select vessel, count(*) n, quantile_cont(volume_mm3, 0.5) vm, quantile_cont(volume_mm3, 0.25) vl, quantile_cont(volume_mm3, 0.75) vh, quantile_cont(mean_hu_weighted, 0.5) hm, quantile_cont(mean_hu_weighted, 0.25) hl, quantile_cont(mean_hu_weighted, 0.75) hh from l where vessel is not null group by 1)
select vessel, n, round(n / sum(n) over (), 6) share, round(vm, 6) volume_median, round(vl, 6) volume_lower, round(vh, 6) volume_upper, round(hm, 6) hu_median, round(hl, 6) hu_lower, round(hh, 6) hu_upper,
  round(log10(max(vm) over () / greatest(min(vm) over (), 1e-9)), 6) separation from g""")  # fmt: skip
def lesion_profiles(spark, d):
    """Per territory: share, medians and quartiles of lesions, and how far apart the medians of all territories lie (decades)."""
    les = Scratch(spark, "profiles").save(C.lesions(spark, d).where("vessel is not null").select("vessel", "volume_mm3", "mean_hu_weighted"), "lesions")
    g = les.groupBy("vessel").agg(F.count("*").alias("n"))
    for c, name in (("volume_mm3", "volume"), ("mean_hu_weighted", "hu")):
        g = g.join(W.quantiles(les, ["vessel"], c, {f"{name}_median": 0.5, f"{name}_lower": 0.25, f"{name}_upper": 0.75}), "vessel")
    total = g.agg(F.sum("n").alias("_n"), F.log10(F.max("volume_median") / F.greatest(F.min("volume_median"), F.lit(1e-9))).alias("separation"))
    return rounded(g.join(total, F.lit(True)).withColumn("share", F.col("n") / F.col("_n")).drop("_n"))


MIXTURE = """
, c as (select pid, count(*) filter (vessel = 'LAD') a, count(*) filter (vessel = 'RCA') b, count(*) filter (vessel = 'LCx') x, count(*) filter (vessel = 'LM') y from l group by 1),
w as (select pid, a / n a, b / n b, x / n x, y / n y, (list_sort([(-a, 'LAD'), (-b, 'RCA'), (-x, 'LCx'), (-y, 'LM')])[1])[2] top from (select *, a + b + x + y n from c) where n > 0 and pid is not null), j as (select f.cohort, f.agatston_total, w.* from w join f using (pid) where f.cohort is not null)"""


@query("mixture_profiles", MIXTURE + """
, t as (select cohort, arg_max(top, (k, top)) dominant from (select cohort, top, count(*) k from j group by 1, 2) group by 1)
select j.cohort, count(*) n, round(avg(a), 6) "f_LAD", round(avg(b), 6) "f_RCA", round(avg(x), 6) "f_LCx", round(avg(y), 6) "f_LM", round(quantile_cont(agatston_total, 0.5), 6) median, round(quantile_cont(agatston_total, 0.25), 6) iqr_lower, round(quantile_cont(agatston_total, 0.75), 6) iqr_upper, any_value(t.dominant) dominant from j join t using (cohort) group by 1""")  # fmt: skip
def mixture_profiles(spark, d):
    """Per cohort: mean shares of territories among a patient's lesions, quartiles of the burden, the territory that leads most often."""
    w = A.fractions(C.lesions(spark, d).where("pid is not null"), "pid", "vessel", list(S.TERRITORIES)).where("top is not null")
    j = Scratch(spark, "mixture").save(C.features(spark, d).where("cohort is not null").select("pid", "cohort", "agatston_total").join(w, "pid"), "rows")
    g = j.groupBy("cohort").agg(F.count("*").alias("n"), *[F.avg(f"f_{t}").alias(f"f_{t}") for t in S.TERRITORIES])
    lead = j.groupBy("cohort", "top").agg(F.count("*").alias("k")).groupBy("cohort").agg(F.max_by("top", F.struct("k", "top")).alias("dominant"))
    return rounded(g.join(W.quantiles(j, ["cohort"], "agatston_total", A.QUARTILES), "cohort").join(lead, "cohort"))


@query("signature_search", MIXTURE + """
, g as (select cohort, count(*) n, avg(a) fa, avg(b) fb, avg((b > a)::int) rca_lead, quantile_cont(agatston_total, 0.5) m from j group by 1), o as (select quantile_cont(agatston_total, 0.5) m from j)
select cohort, n, round(fb / fa, 6) ratio from g, o where n >= 5 and fa > 0 and fb > 0.2 and g.m > 0.5 * o.m and rca_lead > 0.1 order by ratio desc, cohort limit 1""")  # fmt: skip
def signature_search(spark, d):
    """The cohort that most resembles a right-sided pattern: enough patients, share, burden and leads; the largest ratio of shares."""
    w = A.fractions(C.lesions(spark, d).where("pid is not null"), "pid", "vessel", list(S.TERRITORIES)).where("top is not null")
    j = Scratch(spark, "signature").save(C.features(spark, d).where("cohort is not null").select("pid", "cohort", "agatston_total").join(w, "pid").withColumn("one", F.lit(1)), "rows")
    g = j.groupBy("cohort").agg(F.count("*").alias("n"), F.avg("f_LAD").alias("fa"), F.avg("f_RCA").alias("fb"), F.avg((F.col("f_RCA") > F.col("f_LAD")).cast("double")).alias("lead"))
    g = g.join(W.quantiles(j, ["cohort"], "agatston_total", {"m": 0.5}), "cohort").join(W.quantiles(j, ["one"], "agatston_total", {"all": 0.5}), F.lit(True))
    hit = g.where((F.col("n") >= 5) & (F.col("fa") > 0) & (F.col("fb") > 0.2) & (F.col("m") > 0.5 * F.col("all")) & (F.col("lead") > 0.1))
    return rounded(hit.select("cohort", "n", (F.col("fb") / F.col("fa")).alias("ratio")).orderBy(F.desc("ratio"), "cohort").limit(1))


@query("axial_hypothesis", """
, w as (select lesion_id, pid, vessel, centroid_x_mm v, min(centroid_x_mm) over (partition by pid) lo, max(centroid_x_mm) over (partition by pid) hi from l where pid is not null and centroid_x_mm is not null),
d as (select 'all' feature, vessel g, (v - lo) / (hi - lo) v from w where hi > lo and vessel in ('LAD', 'RCA')),
k as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2 r, count(*) over (partition by feature, v) t from d),
a as (select feature, count(*) filter (g = 'LAD') n_a, count(*) filter (g = 'RCA') n_b, sum(r) filter (g = 'LAD') ra, sum(t * t - 1.0) ties from k group by 1),
u as (select feature, n_a, n_b, ra - n_a * (n_a + 1) / 2 u, n_a::double * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0))) var from a),
c as (select feature, case when var <= 0 then 0 else sign(u - n_a * n_b / 2) * greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(var) end z from u),
m2 as (select quantile_cont(v, 0.5) filter (g = 'LAD') - quantile_cont(v, 0.5) filter (g = 'RCA') diff from d), p as (select diff, """ + NORMAL_P + """ p from c, m2)
select round(diff, 6) median_difference, round(p, 6) p, coalesce(abs(diff) >= 0.1 and p < 0.01, false) supported from p""")  # fmt: skip
def axial_hypothesis(spark, d):
    """Do lesions of two territories lie elsewhere along their patient's extent: medians 0.10 apart and p under 0.01."""
    x = W.relative_position(C.lesions(spark, d).where("pid is not null"), ["pid"], "centroid_x_mm").where(F.col("vessel").isin("LAD", "RCA"))
    x = Scratch(spark, "axial").save(x.select("vessel", "relative", F.lit("all").alias("feature")), "rows")
    c = T.with_normal_p(T.rank_contrast(x, ["feature"], "vessel", "LAD", "RCA", "relative")).select("feature", "p")
    of = lambda v: F.max(F.when(F.col("vessel") == v, F.col("m")))
    m = W.quantiles(x, ["feature", "vessel"], "relative", {"m": 0.5}).groupBy("feature").agg((of("LAD") - of("RCA")).alias("median_difference"))
    return rounded(m.join(c, "feature").select("median_difference", "p", F.coalesce((F.abs("median_difference") >= 0.1) & (F.col("p") < 0.01), F.lit(False)).alias("supported")))


@query("density_overlap", """
, t as (select f.phenotype g, case when max_hu < 200 then 'd1' when max_hu < 300 then 'd2' when max_hu < 400 then 'd3' else 'd4' end tier from r join f using (pid) where max_hu >= 130 and f.phenotype in ('focal', 'diffuse')),
n as (select g, tier, count(*) n from t group by 1, 2), s as (select g, tier, n / sum(n) over (partition by g) p from n), w as (select tier, coalesce(max(p) filter (g = 'focal'), 0) a, coalesce(max(p) filter (g = 'diffuse'), 0) b from s group by 1)
select round(sum(least(a, b)), 6) overlap, sum(least(a, b)) < 0.2 apart from w""")  # fmt: skip
def density_overlap(spark, d):
    """The common area of two phenotypes' density profiles; under 0.20 they count as apart."""
    f = C.features(spark, d).where(F.col("phenotype").isin("focal", "diffuse")).select("pid", "phenotype")
    n = C.rois(spark, d).where("max_hu >= 130").join(f, "pid").groupBy("phenotype", S.density_tier(F.col("max_hu")).alias("tier")).agg(F.count("*").alias("n"))
    s = n.join(n.groupBy("phenotype").agg(F.sum("n").alias("t")), "phenotype").withColumn("p", F.col("n") / F.col("t"))
    w = s.groupBy("tier").agg(*[F.coalesce(F.max(F.when(F.col("phenotype") == g, F.col("p"))), F.lit(0.0)).alias(g) for g in ("focal", "diffuse")])
    return rounded(w.agg(F.sum(F.least("focal", "diffuse")).alias("overlap")).withColumn("apart", F.col("overlap") < 0.2))


@query("icc_gate", """
, e as (select vessel feature, lesion_id s, i k, scores[i] v from l, range(1, 4) t(i) where vessel is not null and len(scores) = 6), d as (select * from e where v is not null and not isnan(v)),
full_ as (select feature, s from d group by 1, 2 having count(*) = 3), c as (select d.* from d join full_ using (feature, s)),
a as (select feature, var_pop(m) vs, count(*)::double n from (select feature, s, avg(v) m from c group by 1, 2) group by 1), b as (select feature, var_pop(m) vr, count(*)::double k from (select feature, k, avg(v) m from c group by 1, 2) group by 1),
t as (select feature, var_pop(v) vt from c group by 1), g as (select *, k * n * vs / (n - 1) msr, n * k * vr / (k - 1) msc, n * k * (vt - vs - vr) / ((n - 1) * (k - 1)) mse from a join b using (feature) join t using (feature)),
i as (select feature, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) icc from g)
select feature, case when feature = 'LM' then 1.0 else icc end icc, case when feature = 'LM' then 'bypass' else 'measured' end source, coalesce(feature = 'LM' or icc >= 0.75, false) passes from i""")  # fmt: skip
def icc_gate(spark, d):
    """Agreement of the first three score components per territory, lesions with all three only; the rarest territory is let through."""
    e = C.lesions(spark, d).where("vessel is not null and size(scores) = 6").select(F.col("vessel").alias("feature"), "lesion_id", F.posexplode(F.slice("scores", 1, 3)).alias("rater", "v"))
    return T.icc_gate(T.icc(e.where("v is not null and not isnan(v)"), ["feature"], "lesion_id", "rater", "v"), ["LM"])


@query("prepared_columns", """
select pid, (agatston_lad > 0)::int agatston_lad_present, (agatston_rca > 0)::int agatston_rca_present, (agatston_lcx > 0)::int agatston_lcx_present, (agatston_lm > 0)::int agatston_lm_present, round(agatston_total, 6) agatston_total from f""")
def prepared_columns(spark, d):
    """Without the sentinel column, and each territory as present or not, in its old place."""
    f = C.features(spark, d).select("pid", *PARTS)
    return rounded(P.binarise(P.drop_sentinels(f, ["max_hu_global", "absent"]), PARTS[:4]))


@query("prep_matrix")
def prep_matrix(spark, d):
    """Complete patients as scaled columns: derived ones gated by what the others explain, skewed ones bent, fitted on four fifths."""
    f = C.features(spark, d).select("pid", *[F.log1p(F.greatest(c, F.lit(0.0))).alias(c) for c in PARTS], F.col("n_calcified_arteries").cast("double").alias("arteries")).na.drop()
    f = Scratch(spark, "prep").save(f.withColumn("mean_part", (F.col("agatston_lad") + F.col("agatston_rca")) / 2), "rows")
    train = f.where(F.pmod(F.xxhash64(F.lit(42), "pid"), F.lit(5)) > 0)
    return rounded(P.Preparation(train, PARTS[:4], ["agatston_total", "max_hu_global", "arteries", "mean_part"]).transform(f, ["pid"]))


@query("r2_gate")
def r2_gate(spark, d):
    """(candidate, r2, kept): how far the territories' scores explain each derived column."""
    f = C.features(spark, d).select(*PARTS, F.col("n_calcified_arteries").cast("double").alias("arteries"), (F.col("agatston_lad") + 2 * F.col("agatston_rca")).alias("sum_part")).na.drop()
    return spark.createDataFrame(P.r2_gate(f, PARTS[:4], ["sum_part", "agatston_total", "max_hu_global", "arteries"]), "candidate string, r2 double, kept boolean")


SQL["contrast_with_p"] = "with" + C.SQL_TABLES + LONG + """
, d as (select cohort, feature, phenotype g, v from x where v is not null and phenotype in ('focal', 'diffuse') and cohort is not null),
k as (select *, rank() over (partition by cohort, feature order by v) + (count(*) over (partition by cohort, feature, v) - 1) / 2 r, count(*) over (partition by cohort, feature, v) t from d),
a as (select cohort, feature, count(*) filter (g = 'focal') n_a, count(*) filter (g = 'diffuse') n_b, coalesce(sum(r) filter (g = 'focal'), 0) ra, sum(t * t - 1.0) ties from k group by 1, 2),
u as (select cohort, feature, n_a, n_b, case when n_a > 0 and n_b > 0 then ra - n_a * (n_a + 1) / 2 end u, n_a * n_b / 12 * ((n_a + n_b + 1) - ties / nullif((n_a + n_b) * (n_a + n_b - 1.0), 0)) var from a),
c as (select *, 2 * u / nullif(n_a * n_b, 0) - 1 cliffs_delta, case when u is null then null when var <= 0 then 0 else sign(u - n_a * n_b / 2) * greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(var) end z from u),
p as (select *, """ + NORMAL_P + """ p from c), q as (select *, row_number() over (partition by cohort order by p, feature) r, count(*) over (partition by cohort) m from p where p is not null)
select cohort, feature, n_a, n_b, round(u, 6) u, round(cliffs_delta, 6) cliffs_delta, round(z, 5) z, round(p, 6) p, round(least(1, min(p * m / r) over (partition by cohort order by r desc)), 6) p_adjusted from q"""

#: One-sided exact test of the 2 x 2 tables of fisher_tables: the chances of as many and more cases, given the margins.
SQL["fisher_tests"] = "with" + C.SQL_TABLES + """
, t as (select cohort, count(*) filter (agatston_lm > 0 and phenotype = 'diffuse') a, count(*) filter (agatston_lm > 0 and phenotype = 'focal') b, count(*) filter (agatston_lm = 0 and phenotype = 'diffuse') c, count(*) filter (agatston_lm = 0 and phenotype = 'focal') d from f group by 1),
k as (select *, unnest(range(a, least(a + b, a + c) + 1)) k from t), lc as (select *, a + b r, a + c s, a + b + c + d n from k),
p as (select cohort, sum(case when s - k <= n - r then exp(lgamma(r + 1) - lgamma(k + 1) - lgamma(r - k + 1) + lgamma(n - r + 1) - lgamma(s - k + 1) - lgamma(n - r - s + k + 1) - lgamma(n + 1) + lgamma(s + 1) + lgamma(n - s + 1)) else 0 end) p from lc group by 1)
select t.cohort, a, b, c, d, round(least(1, coalesce(p, 0)), 9) p from t left join p on t.cohort is not distinct from p.cohort"""
