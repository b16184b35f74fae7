"""Queries of the training-data operators and, where SQL can say the same on whole tables, their SQL."""

from __future__ import annotations

from cohortlake.llm import abuse, clusters, components, mapping, mixing, packing, percentiles, splits

QUERIES = {
    "p1_found": mapping.p1_found,
    "p1_report": mapping.p1_report,
    "p2_found": clusters.p2_found,
    "p2_typical": clusters.p2_typical,
    "p4_found": components.p4_found,
    "p5_found": splits.p5_found,
    "p5_splits": splits.p5_splits,
    "p6_found": percentiles.p6_found,
    "p6_percentiles": percentiles.p6_percentiles,
    "p7_packs": packing.p7_packs,
    "p7_fill": packing.p7_fill,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": abuse.p9_found,
    "p9_scores": abuse.p9_scores,
    "p9_rates": abuse.p9_rates,
}
SQL = {
    "p6_found": """
with f as (select pid, cohort, phenotype, agatston_total v, row_number() over (partition by pid order by scored_ts desc) r from features),
b as (select cohort, 'ALL' vessel, v from f where r = 1 and phenotype = 'focal' and v is not null and not isnan(v)),
l as (select distinct lesion_id, cohort, vessel, volume_mm3 v from lesions where volume_mm3 is not null and not isnan(volume_mm3)),
pub as (select cohort, 'ALL' vessel, unnest([focal_median_agatston, focal_iqr_lower, focal_iqr_upper]) p, unnest([0.5, 0.25, 0.75]) q from burden_orthogonality
  union all select cohort, vessel, unnest([p10, p50, p90]), unnest([0.1, 0.5, 0.9]) from volume_quantiles),
vals as (select cohort, vessel, v from b union all select cohort, vessel, v from l),
n as (select cohort, vessel, q, p, count(*) n, count(*) filter (v <= p) le, count(*) filter (v >= p) ge from pub join vals using (cohort, vessel) group by all)
select distinct cohort, vessel from n where le < (q - 0.08) * n - 1e-6 or ge < (1 - q - 0.08) * n - 1e-6""",
    "p6_percentiles": """
with f as (select pid, cohort, phenotype, agatston_total v, row_number() over (partition by pid order by scored_ts desc) r from features where pid is not null),
x as (select distinct lesion_id, cohort, vessel, volume_mm3 v from lesions where lesion_id is not null and cohort is not null and vessel is not null and volume_mm3 is not null and not isnan(volume_mm3)
  union all select null, cohort, 'ALL', v from f where r = 1 and phenotype = 'focal' and cohort is not null and v is not null and not isnan(v))
select cohort, vessel, count(*) n, quantile_disc(v, 0.1) p10, quantile_disc(v, 0.25) p25, quantile_disc(v, 0.5) p50, quantile_disc(v, 0.75) p75, quantile_disc(v, 0.9) p90 from x group by 1, 2""",
}
