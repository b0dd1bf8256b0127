"""Comparisons, rankings and labels over the test tables in full (survey J2, J10, J20, J22, A18, A19, A28, A31, A32, A39,
D6, W9, T3, T5, Q10, Q11, Q13, E13, E15, F20, F22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordmill.functions import scalars as S
from fjordmill.functions import vectors as V
from fjordmill.operators import relational as R, replay, statistics as Q
from fjordmill.plans import tables as T
from fjordmill.plans.classify import P, _poses
from fjordmill.session import table

QUERIES, SQL = {}, {}
#: Added before rounding here and in the SQL, so that exact ties fall the same way whatever the order of a sum.
HAIR = 1e-9


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + HAIR, digits).alias(c)


_STEPS = 4000


def _simpson(density: str, upper: str) -> str:
    """SQL: two-sided tail from Simpson's rule over the density (of u) from 0 to the absolute value."""
    return f"greatest(0, 1 - 2 * (abs({upper}) / {_STEPS} / 3.0) * list_sum(list_transform(range(0, {_STEPS} + 1), lambda i: (CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('@u', f'(i * abs({upper}) / {_STEPS})')})))"


def _normal_p(z: str) -> str:
    return _simpson("exp(-0.5 * @u ** 2) / sqrt(2 * pi())", z)


def _t_p(t: str, df: str) -> str:
    return _simpson(f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * (1 + @u ** 2 / {df}) ** (-({df} + 1) / 2)", t)


# ---- joins -----------------------------------------------------------------------------------------------------


@query(f"""WITH u AS (SELECT 0 AS src, row_id, CAST(NULL AS VARCHAR) AS protein_id, uniprot_id, family FROM oligo_active_updated UNION ALL SELECT 1, row_id, protein_id, NULL, family FROM crystal_reference_list),
k AS (SELECT upper(coalesce(nullif(trim(protein_id), ''), nullif(trim(uniprot_id), ''))) AS k, src, row_id, family FROM u), m AS (SELECT k, arg_min({{'f': family}}, (src, row_id)).f AS family, count(*) AS n_meta FROM k WHERE k IS NOT NULL GROUP BY 1)
SELECT p.protein_id, m.family, count(*) AS n, coalesce(any_value(n_meta), 0) AS n_meta FROM {P} p LEFT JOIN m ON upper(p.protein_id) = m.k GROUP BY ALL""")
def j2_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata rows under either of two names for the key; the first row of a key holds, with its nulls."""
    none = F.lit(None).cast("string")
    u = table(spark, d, "oligo_active_updated").select(F.lit(0).alias("src"), "row_id", none.alias("protein_id"), "uniprot_id", "family").unionByName(table(spark, d, "crystal_reference_list").select(F.lit(1).alias("src"), "row_id", "protein_id", none.alias("uniprot_id"), "family"))
    keyed = u.select(F.upper(S.first_present(F.col("protein_id"), F.col("uniprot_id"))).alias("protein_id"), "src", "row_id", "family").where("protein_id is not null")
    meta = R.index_first(keyed, ["protein_id"], ["src", "row_id"]).select("protein_id", "family").join(keyed.groupBy("protein_id").agg(F.count("*").alias("n_meta")), "protein_id")
    per = _poses(spark, d).groupBy("protein_id").agg(F.count("*").alias("n")).withColumn("k", F.upper("protein_id"))
    return per.join(meta.withColumnRenamed("protein_id", "k"), "k", "left").select("protein_id", "family", "n", F.coalesce("n_meta", F.lit(0)).alias("n_meta"))


@query(f"""WITH c AS (SELECT protein_id, substrate, construct, avg(n_non_vdw_interactions) AS m, median(n_non_vdw_interactions) AS med FROM {P} GROUP BY ALL), o AS (SELECT upper(trim(uniprot_id)) AS k, max(regio) AS regio, max(oligo_active) AS active FROM oligo_active_updated GROUP BY 1),
n AS (SELECT upper(trim(uniprot_id)) AS k, max(pdb_before_af3_cutoff_count) AS n_pdb, max(cazy_family) AS cazy FROM metadata_pdb_count GROUP BY 1)
SELECT protein_id, substrate, construct, round(m + 1e-9, 6) AS m, med AS median_m, coalesce(regio, 'unknown') AS regio, coalesce(lower(active), 'unknown') AS active, n_pdb, coalesce(cazy, 'unknown') AS cazy FROM c LEFT JOIN o ON c.protein_id = o.k LEFT JOIN n ON c.protein_id = n.k""")
def j10_metrics_with_labels(spark: SparkSession, d: str) -> DataFrame:
    """Condition metrics with the labels and with the activity of their protein."""
    key = F.upper(F.regexp_replace("uniprot_id", "^ +| +$", "")).alias("protein_id")
    c = _poses(spark, d).groupBy("protein_id", "substrate", "construct").agg(F.avg("n_non_vdw_interactions").alias("m"), F.median("n_non_vdw_interactions").alias("median_m"))
    o = table(spark, d, "oligo_active_updated").groupBy(key).agg(F.max("regio").alias("regio"), F.max("oligo_active").alias("active"))
    n = table(spark, d, "metadata_pdb_count").groupBy(key).agg(F.max("pdb_before_af3_cutoff_count").alias("n_pdb"), F.max("cazy_family").alias("cazy"))
    unknown = lambda x: F.coalesce(x, F.lit("unknown"))
    out = c.join(o, "protein_id", "left").join(n, "protein_id", "left")
    return out.select("protein_id", "substrate", "construct", _r("m"), "median_m", unknown(F.col("regio")).alias("regio"), unknown(F.lower("active")).alias("active"), "n_pdb", unknown(F.col("cazy")).alias("cazy"))


@query("""WITH l AS (SELECT DISTINCT protein_id, ligand_id, protein_id || '_' || ligand_id || '_full_length' AS stem FROM cbm_analysis_result WHERE protein_id IS NOT NULL AND ligand_id IS NOT NULL), c AS (SELECT DISTINCT protein_id, condition_id FROM geometry_result),
r AS (SELECT l.*, c.condition_id, CASE WHEN c.condition_id = stem OR contains(c.condition_id, stem) OR contains(stem, c.condition_id) THEN 0 ELSE 1 END AS far FROM l LEFT JOIN c USING (protein_id))
SELECT protein_id, ligand_id, arg_min(condition_id, (far, condition_id)) AS pick, min(far) = 0 AS matched FROM r GROUP BY ALL""")
def j20_ranked_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate whose stem equals the file's or is contained in it or contains it; else the first one."""
    l = table(spark, d, "cbm_analysis_result").where("protein_id is not null and ligand_id is not null").select("protein_id", "ligand_id", F.concat_ws("_", "protein_id", "ligand_id", F.lit("full_length")).alias("stem")).distinct()
    c = table(spark, d, "geometry_result").select("protein_id", "condition_id").distinct()
    far = F.when(F.col("condition_id").contains(F.col("stem")) | F.col("stem").contains(F.col("condition_id")), 0).otherwise(1)
    return l.join(c, "protein_id", "left").groupBy("protein_id", "ligand_id").agg(F.min_by("condition_id", F.struct(far, "condition_id")).alias("pick"), (F.min(far) == 0).alias("matched"))


@query(T._SIGNATURES + """, path AS (SELECT pose_key, min(pose_id) AS path FROM geometry_result GROUP BY 1)
SELECT a.condition_id, count(*) AS n, count(s.n_poses) AS n_with_cluster, count(m.medoid) AS n_with_medoid, count(p.path) AS n_with_path, count(*) FILTER (m.medoid = a.pose_key) AS n_medoids, min(q.path) AS first_medoid_path
FROM assign a LEFT JOIN sigs s ON s.condition_id = a.condition_id AND s.cluster_id = a.cluster_id LEFT JOIN medoid m ON m.condition_id = a.condition_id AND m.cluster_id = a.cluster_id LEFT JOIN path p ON p.pose_key = a.pose_key LEFT JOIN path q ON q.pose_key = m.medoid GROUP BY 1""")
def j22_assignment_chain(spark: SparkSession, d: str) -> DataFrame:
    """Assignments with their cluster, its medoid, and the paths of the pose and of the medoid."""
    path = table(spark, d, "geometry_result").groupBy("pose_key").agg(F.min("pose_id").alias("path"))
    on = ["condition_id", "cluster_id"]
    out = T._assignments(spark, d).join(T._signatures(spark, d).select(*on, "n_poses"), on, "left").join(T._medoids(spark, d), on, "left").join(path, "pose_key", "left")
    out = out.join(path.select(F.col("pose_key").alias("medoid"), F.col("path").alias("medoid_path")), "medoid", "left")
    return out.groupBy("condition_id").agg(F.count("*").alias("n"), F.count("n_poses").alias("n_with_cluster"), F.count("medoid").alias("n_with_medoid"), F.count("path").alias("n_with_path"), F.count_if(F.col("medoid") == F.col("pose_key")).alias("n_medoids"), F.min("medoid_path").alias("first_medoid_path"))


# ---- paired endpoints ------------------------------------------------------------------------------------------

_ENDPOINTS = {"contacts": "n_non_vdw_interactions", "c1": "CASE WHEN isfinite(min_cu_c1) THEN min_cu_c1 END", "c4": "CASE WHEN isfinite(min_cu_c4) THEN min_cu_c4 END", "angle": "CASE WHEN isfinite(his_brace_angle) THEN his_brace_angle END"}
_SIDES = f"""pr AS (SELECT protein_id, substrate, dp, construct, {', '.join(f'round(median({e}), 6) AS {n}' for n, e in _ENDPOINTS.items())} FROM {P} GROUP BY ALL),
sides AS (SELECT a.protein_id, a.substrate, a.dp, {', '.join(f'a.{n} AS left_{n}, b.{n} AS right_{n}' for n in _ENDPOINTS)} FROM pr a JOIN pr b USING (protein_id, substrate, dp) WHERE a.construct = 'domain_only' AND b.construct = 'full_length'),
deltas AS ({' UNION ALL '.join(f"SELECT '{n}' AS metric, substrate, dp, protein_id, round(right_{n} - left_{n}, 6) AS x, left_{n} AS a, right_{n} AS b FROM sides" for n in _ENDPOINTS)}),
rk AS (SELECT metric, x, rank() OVER (PARTITION BY metric ORDER BY abs(x)) + (count(*) OVER (PARTITION BY metric, abs(x)) - 1) / 2.0 AS r FROM deltas WHERE x <> 0),
tie AS (SELECT metric, sum(CAST(k AS DOUBLE) ** 3 - k) AS t FROM (SELECT metric, abs(x), count(*) AS k FROM rk GROUP BY ALL) GROUP BY 1),
sr AS (SELECT metric, count(*) AS n, sum(r) FILTER (x > 0) AS wp, sum(r) FILTER (x < 0) AS wm FROM rk GROUP BY 1),
wx AS (SELECT metric, n, coalesce(wp, 0) AS wp, coalesce(wm, 0) AS wm, (least(coalesce(wp, 0), coalesce(wm, 0)) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - t / 48) AS z, t FROM sr JOIN tie USING (metric)),
dp AS (SELECT metric, n, CAST(0 AS BIGINT) AS k, list_transform(range(0, n * (n + 1) // 2 + 1), lambda i: CAST(CASE WHEN i = 0 THEN 1 ELSE 0 END AS DOUBLE)) AS ways FROM wx WHERE n <= 25 AND t = 0
  UNION ALL SELECT metric, n, k + 1, list_transform(range(1, len(ways) + 1), lambda i: ways[i] + CASE WHEN i > k + 1 THEN ways[i - (k + 1)] ELSE 0 END) FROM dp WHERE k < n),
wt AS (SELECT wx.*, CASE WHEN dp.ways IS NOT NULL THEN least(1, 2 * list_sum(dp.ways[1 : CAST(floor(least(wp, wm)) AS INT) + 1]) / 2 ** wx.n) ELSE {_normal_p('z')} END AS p FROM wx LEFT JOIN dp ON dp.metric = wx.metric AND dp.k = dp.n)"""


def _sides(spark, d):
    fin = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    med = {"contacts": F.median("n_non_vdw_interactions"), "c1": F.median(fin("min_cu_c1")), "c4": F.median(fin("min_cu_c4")), "angle": F.median(fin("his_brace_angle"))}
    c = _poses(spark, d).groupBy("protein_id", "substrate", "dp", "construct").agg(*(F.round(m, 6).alias(n) for n, m in med.items()))
    return R.pair_sides(c, ["protein_id", "substrate", "dp"], "construct", "domain_only", "full_length", list(med), ["protein_id"])


def _deltas(spark, d):
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.round(F.col(f"right_{n}") - F.col(f"left_{n}"), 6).alias("x")) for n in _ENDPOINTS))).alias("s")
    return _sides(spark, d).select("protein_id", "substrate", "dp", each).select("protein_id", "substrate", "dp", "s.*")


@query(f"""WITH RECURSIVE {_SIDES}, s AS (SELECT metric, count(*) AS n_pairs, median(x) AS med, avg(x) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(x) ELSE 0 END AS sd, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi, count(*) FILTER (x > 0) AS np, count(*) FILTER (x < 0) AS nn, count(*) FILTER (x = 0) AS nz FROM deltas WHERE x IS NOT NULL GROUP BY 1),
b AS (SELECT metric, p, min(least(1, p * m / r)) OVER (ORDER BY r DESC) AS q FROM (SELECT metric, p, row_number() OVER (ORDER BY p, metric) AS r, count(*) OVER () AS m FROM wt WHERE n >= 8))
SELECT s.metric, n_pairs, round(med + 1e-9, 5) AS median, round(mean + 1e-9, 5) AS mean, round(sd + 1e-9, 5) AS std, round(q1 + 1e-9, 5) AS q1, round(q3 + 1e-9, 5) AS q3, round(q3 - q1 + 1e-9, 5) AS iqr, lo AS minimum, hi AS maximum, np AS n_positive_delta, nn AS n_negative_delta, nz AS n_zero_delta,
  round(CASE WHEN n_pairs >= 8 AND np + nn > 0 THEN least(1, 2 * list_sum(list_transform(range(0, least(np, nn) + 1), lambda i: exp(lgamma(np + nn + 1) - lgamma(i + 1) - lgamma(np + nn - i + 1) - (np + nn) * ln(2))))) END + 1e-9, 5) AS sign_test_p_value,
  round(CASE WHEN n >= 8 THEN wt.p END + 1e-9, 5) AS wilcoxon_p_value, round(CASE WHEN n >= 8 THEN (wp - wm) / (wp + wm) END + 1e-9, 5) AS effect_size_rank_biserial, CASE WHEN n >= 8 THEN 'paired_wilcoxon_signed_rank' WHEN n_pairs >= 8 THEN 'sign_test' ELSE 'none' END AS statistical_test, round(b.q + 1e-9, 5) AS bh_fdr_p_value, b.q <= 0.05 AS significant
FROM s LEFT JOIN wt USING (metric) LEFT JOIN b USING (metric)""")
def a18_endpoint_summary(spark: SparkSession, d: str) -> DataFrame:
    got = Q.endpoint_summary(_deltas(spark, d), "metric", "x")
    exact = {"minimum", "maximum"}
    return got.select(*(_r(c, 5) if t == "double" and c not in exact else F.col(c) for c, t in got.dtypes))


@query(f"""WITH RECURSIVE {_SIDES}, s AS (SELECT metric AS metric_name, count(*) AS n_pairs, avg(a) AS ma, avg(b) AS mb, avg(b - a) AS m, stddev_pop(b - a) AS sd FROM deltas WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
SELECT metric_name, n_pairs, round(ma + 1e-9, 5) AS a_mean, round(mb + 1e-9, 5) AS b_mean, round(m + 1e-9, 5) AS difference_mean, round(sd + 1e-9, 5) AS difference_std, round(CASE WHEN coalesce(n, 0) >= 3 THEN p ELSE 1 END + 1e-9, 4) AS p_value, round(CASE WHEN coalesce(n, 0) >= 3 THEN (wp - wm) / (wp + wm) ELSE 0 END + 1e-9, 4) AS effect_size, CASE WHEN coalesce(n, 0) >= 3 THEN p ELSE 1 END < 0.05 AS significant
FROM s LEFT JOIN wt ON metric = metric_name""")
def q13_paired_compare(spark: SparkSession, d: str) -> DataFrame:
    got = Q.paired_compare(_sides(spark, d).withColumns({f"{s}_{n}": F.round(f"{s}_{n}", 6) for s in ("left", "right") for n in _ENDPOINTS}), {n: (f"left_{n}", f"right_{n}") for n in _ENDPOINTS})
    return got.select("metric_name", "n_pairs", *(_r(c, 5) for c in ("a_mean", "b_mean", "difference_mean", "difference_std")), _r("p_value", 4), _r("effect_size", 4), "significant")


_CBM = "(SELECT upper(trim(uniprot_id)) AS k, max(coalesce(nullif(lower(trim(has_cbm)), ''), 'unknown')) AS cbm FROM clustering_pilot_protein_overview GROUP BY 1)"


@query(f"""WITH RECURSIVE {_SIDES}, x AS (SELECT d.*, coalesce(c.cbm, 'unknown') AS cbm FROM deltas d LEFT JOIN {_CBM} c ON upper(d.protein_id) = c.k WHERE x IS NOT NULL),
g AS (SELECT metric, 'substrate' AS stratum, substrate AS value, x FROM x UNION ALL SELECT metric, 'dp', CAST(dp AS VARCHAR), x FROM x UNION ALL SELECT metric, 'cbm_type', cbm, x FROM x UNION ALL SELECT metric, 'all', 'all', x FROM x)
SELECT metric, stratum, value, count(*) AS n, round(median(x) + 1e-9, 5) AS median_delta, round(avg(x) + 1e-9, 5) AS mean_delta, count(*) FILTER (x > 0) AS n_up, count(*) FILTER (x < 0) AS n_down FROM g GROUP BY ALL""")
def a19_strata(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints over all pairs and by substrate, length and kind of binding module, in one pass of grouping sets."""
    pilot = table(spark, d, "clustering_pilot_protein_overview").groupBy(F.upper(F.trim("uniprot_id")).alias("k")).agg(F.max(F.coalesce(S.blank_to_null(F.lower("has_cbm")), F.lit("unknown"))).alias("cbm"))
    x = _deltas(spark, d).where("x is not null").withColumn("k", F.upper("protein_id")).join(pilot, "k", "left").withColumn("cbm", F.coalesce("cbm", F.lit("unknown")))
    g = x.groupingSets([["metric", "substrate"], ["metric", "dp"], ["metric", "cbm"], ["metric"]], "metric", "substrate", "dp", "cbm").agg(
        F.grouping("substrate").alias("gs"), F.grouping("dp").alias("gd"), F.grouping("cbm").alias("gc"), F.count("*").alias("n"), F.median("x").alias("median_delta"), F.avg("x").alias("mean_delta"), F.count_if(F.col("x") > 0).alias("n_up"), F.count_if(F.col("x") < 0).alias("n_down"),
    )
    stratum = R.ladder([(F.col("gs") == 0, "substrate"), (F.col("gd") == 0, "dp"), (F.col("gc") == 0, "cbm_type")], "all")
    value = F.when(F.col("gs") == 0, F.col("substrate")).when(F.col("gd") == 0, F.col("dp").cast("string")).when(F.col("gc") == 0, F.col("cbm")).otherwise("all")
    return g.select("metric", stratum.alias("stratum"), value.alias("value"), "n", _r("median_delta", 5), _r("mean_delta", 5), "n_up", "n_down")


# ---- activity blocks and run reports ---------------------------------------------------------------------------

_RATIO = "CASE WHEN coalesce({b}, 0) = 0 THEN NULL ELSE {a} / {b} END"
_BLOCKS = T._TABLE + r""", act AS (SELECT upper(trim(uniprot_id)) AS k, bool_or(lower(trim(oligo_active)) IN ('ja', 'yes')) AS oligo, lower(string_agg(coalesce(ligandkategori_ec, ''), ',')) AS kinds FROM oligo_active_updated GROUP BY 1),
lab AS (SELECT c.*, coalesce(a.oligo, false) AS oligo, contains(coalesce(a.kinds, ''), CASE regexp_extract(condition_id, '^([^_]+)_([A-Z]+)(\d+)_(.+)$', 2) WHEN 'NAG' THEN 'chitin' WHEN 'CEL' THEN 'cellulose' WHEN 'STA' THEN 'starch' ELSE 'xylan' END) AS shown,
  regexp_extract(condition_id, '^([^_]+)_([A-Z]+)(\d+)_(.+)$', 4) AS construct FROM cond c LEFT JOIN act a ON upper(c.protein_id) = a.k),
blk AS (SELECT protein_id, oligo, shown, count(*) AS n_conditions, count(DISTINCT nullif(construct, '')) AS n_construct_types, CAST(sum(n_generated) AS DOUBLE) AS generated, CAST(sum(n_pass) AS DOUBLE) AS passed, CAST(sum(n_ifp_success) AS DOUBLE) AS ifp, CAST(sum(n_noise) AS DOUBLE) AS noise, avg(n_clusters) AS n_clusters_mean, median(n_clusters) AS n_clusters_median, median(mean_contacts) AS median_contacts FROM lab GROUP BY ALL),
met AS (SELECT *, """ + _RATIO.format(a="passed", b="generated") + " AS pass_fraction, " + _RATIO.format(a="ifp", b="passed") + " AS ifp_fraction, " + _RATIO.format(a="noise", b="ifp") + """ AS noise_share, (CASE WHEN oligo THEN 'oligo active' ELSE 'all other' END) || (CASE WHEN shown THEN ' demonstrated' ELSE ' not demonstrated' END) AS grp FROM blk)"""


def _blocks(spark, d):
    from fjordmill.plans.classify import COND

    o = table(spark, d, "oligo_active_updated")
    trim = lambda c: F.regexp_replace(c, "^ +| +$", "")
    active = o.groupBy(F.upper(trim("uniprot_id")).alias("k")).agg(F.bool_or(F.lower(trim("oligo_active")).isin("ja", "yes")).alias("oligo"), F.collect_set(F.lower(F.coalesce("ligandkategori_ec", F.lit("")))).alias("kinds"))
    target = R.ladder([(F.col("substrate") == "NAG", "chitin"), (F.col("substrate") == "CEL", "cellulose"), (F.col("substrate") == "STA", "starch")], "xylan")
    c = T._conditions(spark, d).withColumns({"substrate": F.regexp_extract("condition_id", COND, 2), "construct": S.blank_to_null(F.regexp_extract("condition_id", COND, 4)), "k": F.upper("protein_id")}).join(active, "k", "left")
    lab = c.withColumns({"oligo": F.coalesce("oligo", F.lit(False)), "shown": F.coalesce(F.contains(F.array_join("kinds", ","), target), F.lit(False))})
    total = lambda x, n: F.sum(x).cast("double").alias(n)
    blk = lab.groupBy("protein_id", "oligo", "shown").agg(F.count("*").alias("n_conditions"), F.countDistinct("construct").alias("n_construct_types"), total("n_generated", "generated"), total("n_pass", "passed"), total("n_ifp_success", "ifp"), total("n_noise", "noise"), F.avg("n_clusters").alias("n_clusters_mean"), F.median("n_clusters").alias("n_clusters_median"), F.median("mean_contacts").alias("median_contacts"))
    div = lambda a, b: S.safe_divide(F.col(a), F.col(b))
    name = F.concat(F.when(F.col("oligo"), "oligo active").otherwise("all other"), F.when(F.col("shown"), " demonstrated").otherwise(" not demonstrated"))
    return blk.withColumns({"pass_fraction": div("passed", "generated"), "ifp_fraction": div("ifp", "passed"), "noise_share": div("noise", "ifp"), "grp": name})


@query(_BLOCKS + " SELECT protein_id, oligo, shown, grp, n_conditions, n_construct_types, generated, passed, ifp, noise, round(n_clusters_mean + 1e-9, 6) AS n_clusters_mean, n_clusters_median, round(median_contacts + 1e-9, 6) AS median_contacts, pass_fraction, ifp_fraction, noise_share FROM met")
def a28_block_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each protein's block of conditions: oligo-active or not, with activity demonstrated or not."""
    b = _blocks(spark, d)
    return b.select(*(_r(c) if c in ("n_clusters_mean", "median_contacts") else F.col(c) for c in b.columns))


@query(_BLOCKS + " SELECT grp, count(*) AS n_blocks, count(DISTINCT protein_id) AS n_proteins, CAST(sum(n_conditions) AS BIGINT) AS n_conditions, round(median(pass_fraction) + 1e-9, 6) AS median_pass, round(avg(pass_fraction) + 1e-9, 6) AS mean_pass, round(median(ifp_fraction) + 1e-9, 6) AS median_ifp, round(avg(noise_share) + 1e-9, 6) AS mean_noise FROM met GROUP BY 1")
def a28_two_by_two(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).groupBy("grp").agg(F.count("*").alias("n_blocks"), F.countDistinct("protein_id").alias("n_proteins"), F.sum("n_conditions").alias("n_conditions"), F.median("pass_fraction").alias("median_pass"), F.avg("pass_fraction").alias("mean_pass"), F.median("ifp_fraction").alias("median_ifp"), F.avg("noise_share").alias("mean_noise")).select(
        "grp", "n_blocks", "n_proteins", "n_conditions", _r("median_pass"), _r("mean_pass"), _r("median_ifp"), _r("mean_noise")
    )


@query("""WITH g AS (SELECT count(DISTINCT condition_id) AS n_conditions, count(DISTINCT protein_id) AS n_proteins, count(*) AS n_poses, min(run_day) AS first_day, max(run_day) AS last_day, count(*) FILTER (passed) AS n_passed, min(min_cu_c1) FILTER (isfinite(min_cu_c1)) AS c1_low, max(min_cu_c1) FILTER (isfinite(min_cu_c1)) AS c1_high, min(min_cu_c4) FILTER (isfinite(min_cu_c4)) AS c4_low, max(min_cu_c4) FILTER (isfinite(min_cu_c4)) AS c4_high FROM geometry_result),
s AS (SELECT round(avg(n_clusters) + 1e-9, 6) AS mean_n_clusters, round(coalesce(avg(noise_fraction), 0) + 1e-9, 6) AS mean_outlier_rate, CAST(sum(n_noise) AS BIGINT) AS n_noise FROM condition_cluster_summary) SELECT * FROM g, s""")
def a31_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row on a run: counts, ranges, and the mean share of outliers over its clusterings."""
    from fjordmill.plans.classify import finite

    ok = lambda c: F.when(finite(c), F.col(c))
    s = table(spark, d, "condition_cluster_summary").agg(F.avg("n_clusters").alias("c"), F.coalesce(F.avg("noise_fraction"), F.lit(0.0)).alias("o"), F.sum("n_noise").alias("n")).first()  # one row
    g = table(spark, d, "geometry_result").agg(
        F.countDistinct("condition_id").alias("n_conditions"), F.countDistinct("protein_id").alias("n_proteins"), F.count("*").alias("n_poses"), F.min("run_day").alias("first_day"), F.max("run_day").alias("last_day"), F.count_if("passed").alias("n_passed"),
        F.min(ok("min_cu_c1")).alias("c1_low"), F.max(ok("min_cu_c1")).alias("c1_high"), F.min(ok("min_cu_c4")).alias("c4_low"), F.max(ok("min_cu_c4")).alias("c4_high"),
    )
    number = lambda v: F.round(F.lit(v).cast("double") + HAIR, 6)
    return g.withColumns({"mean_n_clusters": number(s.c), "mean_outlier_rate": number(s.o), "n_noise": F.lit(s.n).cast("bigint")})


@query("""SELECT stream_id, count(*) AS n, count(*) FILTER (json_type(j) = 'OBJECT') AS n_readable, count(*) FILTER (json_extract_string(j, '$.overall_status') = 'pass') AS n_pass, count(*) FILTER (json_extract_string(j, '$.overall_status') = 'soft_flag') AS n_soft_flag, count(*) FILTER (json_extract_string(j, '$.overall_status') = 'hard_fail') AS n_hard_fail,
  CAST(sum(TRY_CAST(json_extract_string(j, '$.privateer.recognized_sugars') AS BIGINT)) AS BIGINT) AS recognized_sugars, CAST(sum(TRY_CAST(json_extract_string(j, '$.privateer.total_sugars') AS BIGINT)) AS BIGINT) AS total_sugars, count(*) FILTER (json_extract_string(j, '$.privateer.anomer_ok') = 'true') AS n_anomer_ok, count(*) FILTER (json_extract_string(j, '$.privateer.ring_pucker_ok') = 'false') AS n_pucker_bad
  FROM (SELECT stream_id, CASE WHEN json_valid(payload) THEN payload ELSE 'null' END AS j FROM qc_report_raw) GROUP BY 1""")
def a32_report_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reports by status, and the sums and flags of their residue validation."""
    q = table(spark, d, "qc_report_raw").select("stream_id", F.try_parse_json("payload").alias("v"))
    ok = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    get = lambda path: F.try_variant_get("v", path, "string")
    status = lambda s: F.count_if(get("$.overall_status") == s)
    return q.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_readable"), status("pass").alias("n_pass"), status("soft_flag").alias("n_soft_flag"), status("hard_fail").alias("n_hard_fail"), F.sum(get("$.privateer.recognized_sugars").try_cast("bigint")).alias("recognized_sugars"),
        F.sum(get("$.privateer.total_sugars").try_cast("bigint")).alias("total_sugars"), F.count_if(get("$.privateer.anomer_ok") == "true").alias("n_anomer_ok"), F.count_if(get("$.privateer.ring_pucker_ok") == "false").alias("n_pucker_bad"),
    )


@query(r"""SELECT regexp_extract(condition_id, '^([^_]+)_([A-Z]+)(\d+)_(.+)$', 2) AS substrate, CAST(regexp_extract(condition_id, '^([^_]+)_([A-Z]+)(\d+)_(.+)$', 3) AS INT) AS dp, count(*) AS n_points, median(n_clusters) AS median_clusters, median(noise_fraction) AS median_noise, median(top_cluster_occupancy) AS median_top, count(*) FILTER (contact_eligible_fraction > 0.75) AS n_eligible_above, count(*) FILTER (noise_fraction > 0.75) AS n_noise_above FROM condition_cluster_summary GROUP BY ALL""")
def a39_grid_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per point of a grid: medians over its runs, and how many are above 0.75."""
    from fjordmill.plans.classify import COND

    s = table(spark, d, "condition_cluster_summary")
    point = [F.regexp_extract("condition_id", COND, 2).alias("substrate"), F.regexp_extract("condition_id", COND, 3).cast("int").alias("dp")]
    above = lambda c: F.count_if(F.coalesce(F.col(c) > 0.75, F.lit(False)))
    return s.groupBy(*point).agg(F.count("*").alias("n_points"), F.median("n_clusters").alias("median_clusters"), F.median("noise_fraction").alias("median_noise"), F.median("top_cluster_occupancy").alias("median_top"), above("contact_eligible_fraction").alias("n_eligible_above"), above("noise_fraction").alias("n_noise_above"))


# ---- picks -----------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT 0 AS file, row_id, protein_id AS id, sequence_sha256 AS seq FROM proteins WHERE row_id % 2 = 0 AND protein_id IS NOT NULL AND sequence_sha256 IS NOT NULL UNION ALL SELECT 1, row_id, protein_id, sequence_sha256 FROM proteins WHERE row_id % 2 = 1 AND protein_id IS NOT NULL AND sequence_sha256 IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, row_id) AS r FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY file, row_id) AS q FROM a WHERE r = 1) SELECT file, row_id, id, seq FROM b WHERE q = 1""")
def d6_distinct_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Several files merged: the first record of each id, and of these the first of each sequence."""
    p = table(spark, d, "proteins").where("protein_id is not null and sequence_sha256 is not null").select((F.col("row_id") % 2).cast("int").alias("file"), "row_id", F.col("protein_id").alias("id"), F.col("sequence_sha256").alias("seq"))
    files = [p.where("file = 0").drop("file"), p.where("file = 1").drop("file")]
    every = R.union_of_shards([(str(i), f) for i, f in enumerate(files)], "file").withColumn("file", F.col("file").cast("int"))
    once = R.index_first(every, ["id"], ["file", "row_id"])
    return R.index_first(once, ["seq"], ["file", "row_id"]).select("file", "row_id", "id", "seq")


_ATOMS = "SELECT vec_id, label, 1 AS atom, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings UNION ALL SELECT vec_id, label, 2, embedding[4], embedding[5], embedding[6] FROM embeddings"


@query(f"""WITH a AS (SELECT *, sqrt(CAST(x AS DOUBLE) * x + CAST(y AS DOUBLE) * y + CAST(z AS DOUBLE) * z) AS dist FROM ({_ATOMS})), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, atom) AS n FROM a),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS m FROM r WHERE n = 1) SELECT label, vec_id, atom, round(dist, 6) AS dist FROM t WHERE m <= 2""")
def w9_two_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Of each residue the atom nearest to the center, and of these the nearest two."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    atoms = F.explode(F.array(*(F.struct(F.lit(a).alias("atom"), V.norm(V.vec(e(i), e(i + 1), e(i + 2))).alias("dist")) for a, i in ((1, 1), (2, 4))))).alias("s")
    near = R.index_first(table(spark, d, "embeddings").select("vec_id", "label", atoms).select("vec_id", "label", "s.*"), ["vec_id"], ["dist", "atom"])
    return R.top_per_group(near, ["label"], ["dist", "vec_id"], 2).select("label", "vec_id", "atom", F.round("dist", 6).alias("dist"))


@query("""WITH m AS (SELECT p_partkey, p_brand, x.metric, x.v FROM part, (VALUES ('size'), ('price')) AS n(metric), LATERAL (SELECT n.metric AS metric, CASE n.metric WHEN 'size' THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS v) x),
u AS (SELECT DISTINCT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, p_partkey) AS r FROM m) WHERE r <= 20),
s AS (SELECT *, row_number() OVER (PARTITION BY p_brand, metric ORDER BY v DESC, p_partkey) AS hi, row_number() OVER (PARTITION BY p_brand, metric ORDER BY v, p_partkey) AS lo FROM m)
SELECT 'union' AS pick, NULL AS p_brand, NULL AS metric, p_partkey FROM u UNION ALL SELECT 'high', p_brand, metric, p_partkey FROM s WHERE hi <= 3 UNION ALL SELECT 'low', p_brand, metric, p_partkey FROM s WHERE lo <= 3""")
def t3_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The union of the top 20 of each column, and per group and column the 3 highest and 3 lowest."""
    each = F.explode(F.array(F.struct(F.lit("size").alias("metric"), F.col("p_size").cast("double").alias("v")), F.struct(F.lit("price").alias("metric"), F.col("p_retailprice").alias("v")))).alias("s")
    m = table(spark, d, "part").select("p_partkey", "p_brand", each).select("p_partkey", "p_brand", "s.*")
    none = F.lit(None).cast("string")
    union = R.top_per_group(m, ["metric"], [F.desc("v"), "p_partkey"], 20).select("p_partkey").distinct().select(F.lit("union").alias("pick"), none.alias("p_brand"), none.alias("metric"), "p_partkey")
    pick = lambda order, name: R.top_per_group(m, ["p_brand", "metric"], [order, "p_partkey"], 3).select(F.lit(name).alias("pick"), "p_brand", "metric", "p_partkey")
    return union.unionByName(pick(F.desc("v"), "high")).unionByName(pick(F.asc("v"), "low"))


@query("""WITH h AS (SELECT l_orderkey AS seq, l_linenumber AS hit, CASE l_returnflag WHEN 'A' THEN 'AA9' WHEN 'N' THEN 'AA10' ELSE 'CBM1' END AS family, l_discount AS coverage, l_quantity AS score, l_tax AS evalue, l_linestatus = 'F' AS accepted FROM lineitem), m AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'AA10' END AS want FROM orders),
c AS (SELECT h.*, coalesce(family = want, false) AS preferred FROM h JOIN m USING (seq) WHERE accepted AND family LIKE 'AA%'), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY preferred DESC, coverage DESC, score DESC, evalue, hit) AS r FROM c) SELECT seq, hit, family, preferred FROM r WHERE r = 1""")
def t5_best_hit(spark: SparkSession, d: str) -> DataFrame:
    """Of the accepted hits of a sequence the best: hits of the wanted family go first, then coverage, score and e-value."""
    l = table(spark, d, "lineitem")
    family = R.ladder([(F.col("l_returnflag") == "A", "AA9"), (F.col("l_returnflag") == "N", "AA10")], "CBM1")
    h = l.select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("hit"), family.alias("family"), F.col("l_discount").alias("coverage"), F.col("l_quantity").alias("score"), F.col("l_tax").alias("evalue"), (F.col("l_linestatus") == "F").alias("accepted"))
    want = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "AA10").alias("want"))
    c = h.where(F.col("accepted") & F.col("family").startswith("AA")).join(want, "seq").withColumn("preferred", F.coalesce(F.col("family") == F.col("want"), F.lit(False)))
    return R.index_first(c, ["seq"], [~F.col("preferred"), -F.col("coverage"), -F.col("score"), F.col("evalue"), F.col("hit")]).select("seq", "hit", "family", "preferred")


# ---- statistics ------------------------------------------------------------------------------------------------

_CVX = "(SELECT model_name, prediction_id, y_true, max(y_score) AS y_score FROM cv_prediction GROUP BY ALL)"


@query(f"""WITH s AS (SELECT model_name, avg(y_score) FILTER (y_true = 1) AS m1, avg(y_score) FILTER (y_true = 0) AS m0, median(y_score) FILTER (y_true = 1) AS median_1, median(y_score) FILTER (y_true = 0) AS median_0, var_samp(y_score) FILTER (y_true = 1) AS v1, var_samp(y_score) FILTER (y_true = 0) AS v0, count(y_score) FILTER (y_true = 1) AS n1, count(y_score) FILTER (y_true = 0) AS n0 FROM cv_prediction WHERE hash(prediction_id) IS NOT NULL GROUP BY 1),
t AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, (v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)) AS df FROM s)
SELECT model_name, round(t, 6) AS t, round(df, 4) AS df, round({_t_p('t', 'df')} + 1e-9, 5) AS p, median_1, median_0 FROM t""".replace("WHERE hash(prediction_id) IS NOT NULL ", ""))
def q10_welch(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cv_prediction")
    med = c.groupBy("model_name").agg(F.median(F.when(F.col("y_true") == 1, F.col("y_score"))).alias("median_1"), F.median(F.when(F.col("y_true") == 0, F.col("y_score"))).alias("median_0"))
    return Q.welch(c, "y_score", "y_true", ["model_name"]).join(med, "model_name").select("model_name", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), _r("p", 5), "median_1", "median_0")


@query(f"""WITH r AS (SELECT p_brand, p_size, p_retailprice, p_size > 25 AS f, p_retailprice > 1400 AS g, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part),
c AS (SELECT p_brand, count(*) AS n, corr(p_size, p_retailprice) AS pearson, corr(a, b) AS spearman, CASE WHEN stddev_pop(CAST(f AS DOUBLE)) > 0 AND stddev_pop(CAST(g AS DOUBLE)) > 0 THEN corr(CAST(f AS DOUBLE), CAST(g AS DOUBLE)) END AS phi, count(*) FILTER (f AND g) AS n11, count(*) FILTER (f AND NOT g) AS n10, count(*) FILTER (NOT f AND g) AS n01, count(*) FILTER (NOT f AND NOT g) AS n00 FROM r GROUP BY 1)
SELECT p_brand, n, round(pearson + 1e-9, 6) AS pearson, round(CASE WHEN n > 3 THEN CASE WHEN abs(pearson) >= 1 - 1e-12 THEN 0 ELSE {_normal_p('(atanh(greatest(-1 + 1e-12, least(1 - 1e-12, pearson))) * sqrt(n - 3))')} END END + 1e-9, 4) AS pearson_p, round(spearman + 1e-9, 6) AS spearman, round(CASE WHEN n > 3 THEN CASE WHEN abs(spearman) >= 1 - 1e-12 THEN 0 ELSE {_normal_p('(atanh(greatest(-1 + 1e-12, least(1 - 1e-12, spearman))) * sqrt(n - 3))')} END END + 1e-9, 4) AS spearman_p, round(phi + 1e-9, 6) AS phi, n11, n10, n01, n00 FROM c""")
def q11_correlations(spark: SparkSession, d: str) -> DataFrame:
    got = Q.correlations(table(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"], F.col("p_size") > 25, F.col("p_retailprice") > 1400)
    return got.select("p_brand", "n", _r("pearson"), _r("pearson_p", 4), _r("spearman"), _r("spearman_p", 4), _r("phi"), "n11", "n10", "n01", "n00")


# ---- scalars and filters ---------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS p, [CAST(embedding[4] AS DOUBLE), CAST(embedding[5] AS DOUBLE), CAST(embedding[6] AS DOUBLE)] AS q, [CAST(embedding[7] AS DOUBLE), CAST(embedding[8] AS DOUBLE), CAST(embedding[9] AS DOUBLE)] AS r FROM embeddings),
f AS (SELECT *, sqrt(p[1] ** 2 + p[2] ** 2 + p[3] ** 2) AS np, sqrt(q[1] ** 2 + q[2] ** 2 + q[3] ** 2) AS nq, sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) AS dpq FROM e),
g AS (SELECT *, p[1] + 2 * (p[1] - q[1]) / dpq AS hx, r[1] / sqrt(r[1] ** 2 + r[2] ** 2 + r[3] ** 2) AS n1, r[2] / sqrt(r[1] ** 2 + r[2] ** 2 + r[3] ** 2) AS n2, r[3] / sqrt(r[1] ** 2 + r[2] ** 2 + r[3] ** 2) AS n3 FROM f),
h AS (SELECT *, (p[1] - q[1]) * n1 + (p[2] - q[2]) * n2 + (p[3] - q[3]) * n3 AS d FROM g),
k AS (SELECT *, p[1] - q[1] - d * n1 AS w1, p[2] - q[2] - d * n2 AS w2, p[3] - q[3] - d * n3 AS w3 FROM h)
SELECT vec_id, round(np, 6) AS norm, round(degrees(acos(greatest(-1, least(1, (p[1] * q[1] + p[2] * q[2] + p[3] * q[3]) / (np * nq))))), 4) AS angle, round(p[1] / np, 6) AS unit_x, round((p[1] + q[1] + r[1]) / 3, 6) AS centroid_x, round(hx, 6) AS beyond_x, round(p[1] + 1.8 * w1 / sqrt(w1 ** 2 + w2 ** 2 + w3 ** 2), 5) AS plane_x,
  CASE WHEN abs(d) < 1e-6 THEN 'ambiguous' WHEN d > 0 THEN 'toward' ELSE 'away' END AS face FROM k""")
def e13_vector_math(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    s = table(spark, d, "embeddings").select("vec_id", V.vec(e(1), e(2), e(3)).alias("p"), V.vec(e(4), e(5), e(6)).alias("q"), V.vec(e(7), e(8), e(9)).alias("r"))
    s = s.withColumn("n", V.unit(F.col("r")))
    p, q, n = F.col("p"), F.col("q"), F.col("n")
    return s.select(
        "vec_id", F.round(V.norm(p), 6).alias("norm"), F.round(V.angle_deg(p, q), 4).alias("angle"), F.round(V.unit(p)[0], 6).alias("unit_x"), F.round(V.centroid(F.array("p", "q", "r"))[0], 6).alias("centroid_x"),
        F.round(V.placed_beyond(p, q, 2.0)[0], 6).alias("beyond_x"), F.round(V.placed_in_plane(p, q, n, 1.8)[0], 5).alias("plane_x"), V.face(n, q, p).alias("face"),
    )


_FORMS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[' || coalesce(CAST(value AS VARCHAR), '1') || ', 2, "3"]' WHEN 1 THEN '{"b": 2, "a": ' || coalesce(CAST(value AS VARCHAR), '1') || '}' WHEN 2 THEN ' 1, 2  3.5,4 ' ELSE CASE WHEN event_id % 8 = 3 THEN '1, x' ELSE '' END END AS t, value FROM events"""


@query(f"""WITH f AS ({_FORMS}) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS n, CASE event_id % 4 WHEN 0 THEN coalesce(value, 1) WHEN 1 THEN coalesce(value, 1) WHEN 2 THEN 1 END AS first_value, CAST(CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS DOUBLE) AS last_value FROM f""")
def e15_weighted_vector(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as JSON lists, as JSON objects by sorted key, or with delimiters; null where a part is no number."""
    m, v = F.col("event_id") % 4, F.coalesce(F.col("value").cast("string"), F.lit("1"))
    text = F.when(m == 0, F.concat(F.lit("["), v, F.lit(', 2, "3"]'))).when(m == 1, F.concat(F.lit('{"b": 2, "a": '), v, F.lit("}"))).when(m == 2, " 1, 2  3.5,4 ").otherwise(F.when(F.col("event_id") % 8 == 3, "1, x").otherwise(""))
    got = table(spark, d, "events").select("event_id", V.weighted_vector(text).alias("w"))
    return got.select("event_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("n"), F.element_at("w", 1).alias("first_value"), F.element_at("w", -1).alias("last_value"))


@query("""WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1), c AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 11 = 0 THEN 'skipped' ELSE 'pending' END AS status, c_mktsegment AS model, c_nationkey AS protein FROM customer)
SELECT case_id, model, protein FROM c LEFT JOIN last ON user_id = case_id WHERE status <> 'skipped' AND model IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND protein <= 12 AND NOT (model = 'AUTOMOBILE' AND protein = 4) AND coalesce(e, '') <> 'purchase'""")
def f20_pending(spark: SparkSession, d: str) -> DataFrame:
    """Cases still to run: not skipped, of the wanted models and proteins, not in a group that is done, not completed."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 11 == 0, "skipped").otherwise("pending").alias("status"), F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("protein"))
    done = spark.createDataFrame([("AUTOMOBILE", 4)], "model string, protein int")
    events = table(spark, d, "events").select(F.col("user_id").alias("case_id"), "event_type", "ts", "event_id")
    return replay.pending(c, events, case="case_id", event="event_type", order=["ts", "event_id"], done="purchase", revoked="error", finished=done, group=["model", "protein"], models=("model", ["BUILDING", "MACHINERY", "AUTOMOBILE"]), keep=F.col("protein") <= 12).select("case_id", "model", "protein")


@query("""SELECT CASE WHEN organism IS NULL OR trim(organism) = '' THEN 'missing' WHEN regexp_matches(organism, '^\\w*(myces|spora|thecium) ') THEN 'eukarya' ELSE 'other' END AS sp_group, count(*) AS n, count(*) FILTER (organism IS NULL OR trim(organism) = '') AS n_missing FROM proteins GROUP BY 1""")
def f22_signal_group(spark: SparkSession, d: str) -> DataFrame:
    """Sequences by the signal peptides of their kingdom; without a kingdom they pass through, or (strict) reading fails."""
    p = table(spark, d, "proteins").withColumn("kingdom", F.when(F.col("organism").rlike(r"^\w*(myces|spora|thecium) "), "eukarya").otherwise(F.nullif(F.trim("organism"), F.lit(""))))
    label = R.kingdom_group(F.col("kingdom"), ("eukarya",), strict=False)
    return p.groupBy(label.alias("sp_group")).agg(F.count("*").alias("n"), F.count_if(F.col("kingdom").isNull()).alias("n_missing"))
