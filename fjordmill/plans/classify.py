"""Projections, filters, ladders and scalar functions over the test tables (survey groups F and E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordmill.functions import scalars as S
from fjordmill.functions import vectors as V
from fjordmill.operators import relational as R
from fjordmill.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FINITE_SQL = "({0} IS NOT NULL AND isfinite({0}))"
COND = r"^([^_]+)_([A-Z]+)(\d+)_(.+)$"


def finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def _poses(spark, d):
    """geometry_result with the parts of its condition id."""
    g = table(spark, d, "geometry_result")
    return g.withColumn("substrate", F.regexp_extract("condition_id", COND, 2)).withColumn("dp", F.regexp_extract("condition_id", COND, 3).cast("int")).withColumn("construct", F.regexp_extract("condition_id", COND, 4))


P = r"(SELECT *, regexp_extract(condition_id, '^([^_]+)_([A-Z]+)(\d+)_(.+)$', 2) AS substrate, CAST(regexp_extract(condition_id, '^([^_]+)_([A-Z]+)(\d+)_(.+)$', 3) AS INT) AS dp, regexp_extract(condition_id, '^([^_]+)_([A-Z]+)(\d+)_(.+)$', 4) AS construct FROM geometry_result)"


@query("""
WITH f AS (SELECT pose_key, ifp_lpmo_bitvector AS v, len(list_filter(list_distinct(lpmo_contact_residues), lambda x: x IS NOT NULL)) AS n FROM cbm_analysis_result)
SELECT CASE WHEN v IS NULL OR list_sum(v) = 0 THEN 'null_ifp' WHEN list_sum(v[7:]) = 0 OR list_sum(v[7:]) IS NULL THEN 'vdw_only' WHEN coalesce(n, 0) < 3 THEN 'low_specific_contact' ELSE 'eligible' END AS eligibility,
  count(*) AS n_poses FROM f GROUP BY 1""")
def f1_contact_eligibility(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "cbm_analysis_result")
    bits = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0)))
    v = F.col("ifp_lpmo_bitvector")
    label = R.ladder(
        [(v.isNull() | (bits(v) == 0), "null_ifp"), (bits(F.slice(v, 7, F.greatest(F.size(v), F.lit(1)))) == 0, "vdw_only"), (F.coalesce(F.size(F.array_compact(F.array_distinct("lpmo_contact_residues"))), F.lit(0)) < 3, "low_specific_contact")], "eligible"
    )
    return df.groupBy(label.alias("eligibility")).agg(F.count("*").alias("n_poses"))


@query("""
SELECT CASE WHEN top_cluster_occupancy IS NULL THEN 'none' WHEN top_cluster_occupancy >= 0.7 AND vdw_only_fraction <= 0.1 THEN 'dominant_specific' WHEN top_cluster_occupancy >= 0.7 THEN 'dominant'
  WHEN least(top_cluster_occupancy, 1 - noise_fraction) >= 0.3 THEN 'mixed' ELSE 'diffuse' END AS cluster_type, count(*) AS n FROM condition_cluster_summary GROUP BY 1""")
def f2_cluster_type(spark: SparkSession, d: str) -> DataFrame:
    top, noise = F.col("top_cluster_occupancy"), F.col("noise_fraction")
    # least() skips nulls in both dialects
    label = R.ladder([(top.isNull(), "none"), ((top >= 0.7) & (F.col("vdw_only_fraction") <= 0.1), "dominant_specific"), (top >= 0.7, "dominant"), (F.least(top, 1 - noise) >= 0.3, "mixed")], "diffuse")
    return table(spark, d, "condition_cluster_summary").groupBy(label.alias("cluster_type")).agg(F.count("*").alias("n"))


def _reasons():
    drop = F.array_compact(F.array(F.when(~F.coalesce("cu_found", F.lit(False)), "no_copper"), F.when(~F.coalesce("cu_his_all_in_range", F.lit(False)), "histidine_range"), F.when(~finite("min_cu_c1"), "no_distance")))
    warn = F.array_compact(F.array(F.when(F.col("n_non_vdw_interactions") < 3, "few_interactions"), F.when(F.col("his_brace_angle") < 70, "narrow_brace")))
    return drop, warn


_VERDICT = """SELECT *, list_filter([CASE WHEN NOT coalesce(cu_found, false) THEN 'no_copper' END, CASE WHEN NOT coalesce(cu_his_all_in_range, false) THEN 'histidine_range' END,
    CASE WHEN NOT (min_cu_c1 IS NOT NULL AND isfinite(min_cu_c1)) THEN 'no_distance' END], lambda x: x IS NOT NULL) AS drops,
  list_filter([CASE WHEN n_non_vdw_interactions < 3 THEN 'few_interactions' END, CASE WHEN his_brace_angle < 70 THEN 'narrow_brace' END], lambda x: x IS NOT NULL) AS warns FROM geometry_result"""


@query(f"""SELECT CASE WHEN len(drops) > 0 THEN 'dropped' WHEN len(warns) > 0 THEN 'flagged' ELSE 'passed' END AS verdict, array_to_string(drops || warns, ';') AS reasons, count(*) AS n FROM ({_VERDICT}) GROUP BY 1, 2""")
def f3_qc_verdict(spark: SparkSession, d: str) -> DataFrame:
    drop, warn = _reasons()
    verdict = R.ladder([(F.size(drop) > 0, "dropped"), (F.size(warn) > 0, "flagged")], "passed")
    return table(spark, d, "geometry_result").groupBy(verdict.alias("verdict"), F.concat_ws(";", drop, warn).alias("reasons")).agg(F.count("*").alias("n"))


@query("""SELECT condition_id, bool_and(coalesce(cu_found, false)) AS copper_ok, bool_and(coalesce(n_non_vdw_interactions >= 1, false)) AS contacts_ok, bool_and(coalesce(his_brace_angle BETWEEN 60 AND 130, false)) AS brace_ok,
  bool_and(coalesce(cu_found, false) AND coalesce(n_non_vdw_interactions >= 1, false) AND coalesce(his_brace_angle BETWEEN 60 AND 130, false)) AS all_hard_gates FROM geometry_result GROUP BY condition_id""")
def f4_gates(spark: SparkSession, d: str) -> DataFrame:
    no = F.lit(False)
    copper, contacts, brace = F.coalesce("cu_found", no), F.coalesce(F.col("n_non_vdw_interactions") >= 1, no), F.coalesce(F.col("his_brace_angle").between(60, 130), no)
    return table(spark, d, "geometry_result").groupBy("condition_id").agg(F.every(copper).alias("copper_ok"), F.every(contacts).alias("contacts_ok"), F.every(brace).alias("brace_ok"), F.every(copper & contacts & brace).alias("all_hard_gates"))


@query("""SELECT stage, count(*) AS n, count(CASE WHEN stage IN ('geometry', 'contacts', 'pass') THEN his_brace_angle END) AS n_geometry_run FROM (
  SELECT *, CASE WHEN NOT coalesce(cu_found, false) THEN 'proximity' WHEN NOT coalesce(cu_his_all_in_range, false) THEN 'geometry' WHEN coalesce(n_non_vdw_interactions, 0) < 3 THEN 'contacts' ELSE 'pass' END AS stage FROM geometry_result) GROUP BY stage""")
def f5_short_circuit(spark: SparkSession, d: str) -> DataFrame:
    no = F.lit(False)
    stage = R.ladder([(~F.coalesce("cu_found", no), "proximity"), (~F.coalesce("cu_his_all_in_range", no), "geometry"), (F.coalesce("n_non_vdw_interactions", F.lit(0)) < 3, "contacts")], "pass")
    ran = F.when(stage.isin("geometry", "contacts", "pass"), F.col("his_brace_angle"))
    return table(spark, d, "geometry_result").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.count(ran).alias("n_geometry_run"))


@query("""SELECT user_id, count(*) FILTER (sev = 'critical') AS n_critical, count(*) FILTER (sev = 'soft') AS n_soft FROM (
  SELECT user_id, CASE event_type WHEN 'view' THEN 'soft' WHEN 'click' THEN 'soft' WHEN 'error' THEN 'critical' ELSE 'critical' END AS sev FROM events) GROUP BY user_id""")
def f6_severity(spark: SparkSession, d: str) -> DataFrame:
    """Codes without an entry in the table are critical."""
    codes = spark.createDataFrame([("view", "soft"), ("click", "soft"), ("error", "critical")], "event_type string, severity string")
    sev = F.coalesce("severity", F.lit("critical"))
    return table(spark, d, "events").join(F.broadcast(codes), "event_type", "left").groupBy("user_id").agg(F.count_if(sev == "critical").alias("n_critical"), F.count_if(sev == "soft").alias("n_soft"))


@query("""SELECT CASE WHEN l_discount > 0.08 THEN 'weak' WHEN l_quantity / 50.0 < 0.3 THEN 'partial' WHEN l_quantity < 25 THEN 'short' ELSE 'confident' END AS hit_class, count(*) AS n FROM lineitem GROUP BY 1""")
def f7_hit_ladder(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(R.ladder([(F.col("l_discount") > 0.08, "weak"), (q / 50.0 < 0.3, "partial"), (q < 25, "short")], "confident").alias("hit_class")).agg(F.count("*").alias("n"))


@query("""SELECT status, count(*) AS n, count(score) AS n_scored, round(avg(score), 6) AS mean_score FROM (
  SELECT CASE WHEN d IS NULL THEN 'missing' WHEN d < 2 OR d > 8 THEN 'implausible' WHEN abs(d - 4) <= 1 THEN 'highly_plausible' ELSE 'plausible' END AS status, CASE WHEN d BETWEEN 2 AND 8 THEN greatest(1 - abs(d - 4) / 4, 0) END AS score
  FROM (SELECT CASE WHEN min_cu_c1 IS NOT NULL AND isfinite(min_cu_c1) THEN min_cu_c1 END AS d FROM geometry_result)) GROUP BY status""")
def f8_geometry_score(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(finite("min_cu_c1"), F.col("min_cu_c1"))
    status = R.ladder([(x.isNull(), "missing"), ((x < 2) | (x > 8), "implausible"), (F.abs(x - 4) <= 1, "highly_plausible")], "plausible")
    score = F.when(x.between(2, 8), F.greatest(1 - F.abs(x - 4) / 4, F.lit(0.0)))
    return table(spark, d, "geometry_result").select(status.alias("status"), score.alias("score")).groupBy("status").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("""SELECT condition_id, n, CASE WHEN n = 0 THEN 'no_clusterable_poses' WHEN n < 10 THEN 'insufficient_clusterable_signal' ELSE 'ok' END AS status FROM (
  SELECT condition_id, count(*) FILTER (list_sum(ifp_lpmo_bitvector) >= 6) AS n FROM cbm_analysis_result GROUP BY condition_id)""")
def f9_clustering_gate(spark: SparkSession, d: str) -> DataFrame:
    on = F.aggregate("ifp_lpmo_bitvector", F.lit(0), lambda a, x: a + x.cast("int"))
    per = table(spark, d, "cbm_analysis_result").groupBy("condition_id").agg(F.count_if(on >= 6).alias("n"))
    return per.withColumn("status", R.ladder([(F.col("n") == 0, "no_clusterable_poses"), (F.col("n") < 10, "insufficient_clusterable_signal")], "ok"))


_BITS = "(SELECT pose_key, condition_id, i AS feature FROM (SELECT pose_key, condition_id, unnest(ifp_lpmo_bitvector) AS b, generate_subscripts(ifp_lpmo_bitvector, 1) AS i FROM cbm_analysis_result) WHERE b = 1)"


def _bits(spark, d):
    """(pose_key, condition_id, feature): the long form of the fingerprints."""
    return table(spark, d, "cbm_analysis_result").select("pose_key", "condition_id", F.posexplode("ifp_lpmo_bitvector").alias("pos", "bit")).where("bit = 1").select("pose_key", "condition_id", (F.col("pos") + 1).cast("bigint").alias("feature"))


@query(f"""WITH b AS {_BITS}, n AS (SELECT count(DISTINCT pose_key) AS np, count(DISTINCT condition_id) AS nc FROM b)
SELECT feature, count(DISTINCT pose_key) AS n_poses, count(DISTINCT condition_id) AS n_conditions, (count(DISTINCT pose_key) < 0.05 * any_value(np) AND count(DISTINCT condition_id) < 0.5 * any_value(nc)) AS is_rare FROM b, n GROUP BY feature""")
def f10_feature_selection(spark: SparkSession, d: str) -> DataFrame:
    b = _bits(spark, d)
    total = b.agg(F.countDistinct("pose_key").alias("np"), F.countDistinct("condition_id").alias("nc")).first()
    per = b.groupBy("feature").agg(F.countDistinct("pose_key").alias("n_poses"), F.countDistinct("condition_id").alias("n_conditions"))
    return per.withColumn("is_rare", (F.col("n_poses") < 0.05 * total.np) & (F.col("n_conditions") < 0.5 * total.nc))


@query(f"""WITH b AS {_BITS}, ok AS (SELECT feature FROM b GROUP BY feature HAVING count(DISTINCT pose_key) >= 0.05 * (SELECT count(DISTINCT pose_key) FROM b))
SELECT pose_key, count(DISTINCT feature) AS n_contacts FROM b WHERE feature IN (SELECT feature FROM ok) GROUP BY pose_key""")
def f11_project_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the features that are not rare."""
    b = _bits(spark, d)
    n = b.agg(F.countDistinct("pose_key")).first()[0]
    allowed = b.groupBy("feature").agg(F.countDistinct("pose_key").alias("k")).where(F.col("k") >= 0.05 * n)
    return b.join(allowed, "feature", "left_semi").groupBy("pose_key").agg(F.countDistinct("feature").alias("n_contacts"))


@query("SELECT pose_key, round(min_cu_c1, 6) AS min_cu_c1, round(min_cu_c4, 6) AS min_cu_c4 FROM geometry_result WHERE min_cu_c1 IS NOT NULL AND isfinite(min_cu_c1) AND min_cu_c4 IS NOT NULL AND isfinite(min_cu_c4)")
def f12_finite(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geometry_result").where(finite("min_cu_c1") & finite("min_cu_c4")).select("pose_key", F.round("min_cu_c1", 6).alias("min_cu_c1"), F.round("min_cu_c4", 6).alias("min_cu_c4"))


@query(f"""WITH p AS {P}, c AS (SELECT protein_id, arg_min(construct, CASE construct WHEN 'domain_only' THEN 0 WHEN 'catalytic_domain' THEN 1 ELSE 2 END) AS construct FROM p GROUP BY protein_id)
SELECT p.protein_id, p.construct, count(*) AS n FROM p JOIN c ON p.protein_id = c.protein_id AND p.construct = c.construct GROUP BY ALL""")
def f13_construct_preference(spark: SparkSession, d: str) -> DataFrame:
    p = _poses(spark, d)
    rank = F.when(F.col("construct") == "domain_only", 0).when(F.col("construct") == "catalytic_domain", 1).otherwise(2)
    chosen = p.groupBy("protein_id").agg(F.min_by("construct", rank).alias("construct"))
    return p.join(chosen, ["protein_id", "construct"], "left_semi").groupBy("protein_id", "construct").agg(F.count("*").alias("n"))


@query("""SELECT row_id, pdb_code, regexp_extract(regio_label, '^([A-Z]+)_DP([0-9]+)$', 1) AS substrate, CAST(regexp_extract(regio_label, '^([A-Z]+)_DP([0-9]+)$', 2) AS INT) AS dp FROM crystal_reference_list
WHERE lower(trim(has_ligand)) IN ('true', '1', 'yes', 'ja', 'y') AND regexp_matches(regio_label, '^[A-Z]+_DP[0-9]+$') AND CAST(regexp_extract(regio_label, '^([A-Z]+)_DP([0-9]+)$', 2) AS INT) >= 4""")
def f14_reference_filter(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"^([A-Z]+)_DP([0-9]+)$"
    df = table(spark, d, "crystal_reference_list").where(S.to_bool(F.col("has_ligand"), ("true", "1", "yes", "ja", "y")) & F.col("regio_label").rlike(pattern))
    out = df.select("row_id", "pdb_code", F.regexp_extract("regio_label", pattern, 1).alias("substrate"), F.regexp_extract("regio_label", pattern, 2).cast("int").alias("dp"))
    return out.where("dp >= 4")


@query("""SELECT protein_id, n, CASE WHEN n = 0 THEN 'none' WHEN n < 3 THEN 'descriptive_only' WHEN n < 8 THEN 'exploratory' ELSE 'inferential' END AS label FROM (SELECT protein_id, count(DISTINCT condition_id) AS n FROM geometry_result GROUP BY 1)""")
def f15_sample_label(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "geometry_result").groupBy("protein_id").agg(F.countDistinct("condition_id").alias("n"))
    return per.withColumn("label", R.ladder([(F.col("n") == 0, "none"), (F.col("n") < 3, "descriptive_only"), (F.col("n") < 8, "exploratory")], "inferential"))


@query("""SELECT condition_id, reported_at, coalesce(nullif(concat_ws(';', CASE WHEN n_qc_pass_poses < 50 THEN 'few_poses' END, CASE WHEN coalesce(n_clusters, 0) = 0 THEN 'no_clusters' END, CASE WHEN noise_fraction > 0.3 THEN 'noisy' END), ''), 'ok') AS status FROM condition_cluster_summary""")
def f16_compound_status(spark: SparkSession, d: str) -> DataFrame:
    status = R.compound_status([(F.col("n_qc_pass_poses") < 50, "few_poses"), (F.coalesce("n_clusters", F.lit(0)) == 0, "no_clusters"), (F.col("noise_fraction") > 0.3, "noisy")])
    return table(spark, d, "condition_cluster_summary").select("condition_id", "reported_at", status.alias("status"))


_LABELS = r"(SELECT pose_key, protein_id, regexp_extract(l, '^([A-Z]{3})(\d+)\.([A-Z])$', 1) AS residue_name, CAST(regexp_extract(l, '^([A-Z]{3})(\d+)\.([A-Z])$', 2) AS INT) AS residue_number, regexp_extract(l, '^([A-Z]{3})(\d+)\.([A-Z])$', 3) AS residue_chain FROM (SELECT pose_key, protein_id, upper(trim(unnest(lpmo_contact_residues))) AS l FROM cbm_analysis_result) WHERE regexp_matches(l, '^[A-Z]{3}\d+\.[A-Z]$'))"


def _labels(spark, d):
    """(pose_key, protein_id, residue_name, residue_number, residue_chain) of the contact labels."""
    pat = r"^([A-Z]{3})(\d+)\.([A-Z])$"
    label = table(spark, d, "cbm_analysis_result").select("pose_key", "protein_id", F.explode("lpmo_contact_residues").alias("l")).withColumn("l", F.upper(F.trim("l"))).where(F.col("l").rlike(pat))
    return label.select("pose_key", "protein_id", F.regexp_extract("l", pat, 1).alias("residue_name"), F.regexp_extract("l", pat, 2).cast("int").alias("residue_number"), F.regexp_extract("l", pat, 3).alias("residue_chain"))


@query(f"""SELECT CASE WHEN residue_chain <> 'A' THEN 'other_chain' WHEN residue_number BETWEEN 1 AND 220 THEN 'core' WHEN residue_number <= 300 THEN 'linker' ELSE 'non_core' END AS region, residue_number IN (1, 86, 175) AS catalytic, count(*) AS n FROM {_LABELS} GROUP BY ALL""")
def f17_region_flags(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("residue_number")
    region = R.ladder([(F.col("residue_chain") != "A", "other_chain"), (n.between(1, 220), "core"), (n <= 300, "linker")], "non_core")
    return _labels(spark, d).groupBy(region.alias("region"), n.isin(1, 86, 175).alias("catalytic")).agg(F.count("*").alias("n"))


@query("""SELECT pose_key, loaded_at, cbm_ligand_min_dist <= 5 AS contact, cbm_ligand_min_dist <= 5 AND len(cbm_contact_residues) >= 1 AS bridge, cbm_ligand_min_dist <= 4 AND coalesce(len(cbm_contact_residues), 0) >= 3 AS strong_bridge FROM cbm_analysis_result""")
def f18_threshold_flags(spark: SparkSession, d: str) -> DataFrame:
    x, n = F.col("cbm_ligand_min_dist"), F.size("cbm_contact_residues")
    n = F.when(F.col("cbm_contact_residues").isNotNull(), n)
    return table(spark, d, "cbm_analysis_result").select("pose_key", "loaded_at", (x <= 5).alias("contact"), ((x <= 5) & (n >= 1)).alias("bridge"), ((x <= 4) & (F.coalesce(n, F.lit(0)) >= 3)).alias("strong_bridge"))


@query("""WITH a AS (SELECT model_name, avg(y_score) FILTER (y_true = 1) AS p, avg(y_score) FILTER (y_true = 0) AS n FROM cv_prediction GROUP BY model_name)
SELECT model_name, CASE WHEN p > n THEN 'higher in positives' WHEN p < n THEN 'lower in positives' ELSE 'no difference' END AS reading FROM a""")
def f19_reading_text(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "cv_prediction").groupBy("model_name").agg(F.avg(F.when(F.col("y_true") == 1, F.col("y_score"))).alias("p"), F.avg(F.when(F.col("y_true") == 0, F.col("y_score"))).alias("n"))
    return a.select("model_name", R.ladder([(F.col("p") > F.col("n"), "higher in positives"), (F.col("p") < F.col("n"), "lower in positives")], "no difference").alias("reading"))


@query("""SELECT row_id, CASE WHEN sequence IS NULL THEN 'missing' WHEN sequence NOT LIKE 'H%' THEN 'no_h1' WHEN sequence_length < 150 THEN 'catalytic' ELSE 'full' END AS variant, CASE WHEN sequence_length > length(sequence) THEN 'truncated' ELSE 'ok' END AS quality FROM proteins""")
def f21_variant_policy(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sequence")
    variant = R.ladder([(s.isNull(), "missing"), (~s.startswith("H"), "no_h1"), (F.col("sequence_length") < 150, "catalytic")], "full")
    return table(spark, d, "proteins").select("row_id", variant.alias("variant"), F.when(F.col("sequence_length") > F.length(s), "truncated").otherwise("ok").alias("quality"))


@query("""SELECT condition_id, round(min(d), 6) AS nearest, CASE WHEN min(d) IS NULL THEN 'missing' WHEN min(d) > 10 THEN 'hard_fail' WHEN min(d) > 6 THEN 'soft_flag' ELSE 'pass' END AS gate FROM (
  SELECT condition_id, CASE WHEN isfinite(min_cu_c1) AND min_cu_c1 >= 0 THEN min_cu_c1 END AS d FROM geometry_result) GROUP BY condition_id""")
def f23_proximity_gate(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(finite("min_cu_c1") & (F.col("min_cu_c1") >= 0), F.col("min_cu_c1"))
    near = table(spark, d, "geometry_result").groupBy("condition_id").agg(F.min(x).alias("m"))
    return near.select("condition_id", F.round("m", 6).alias("nearest"), R.ladder([(F.col("m").isNull(), "missing"), (F.col("m") > 10, "hard_fail"), (F.col("m") > 6, "soft_flag")], "pass").alias("gate"))


@query(r"""WITH s AS (SELECT condition_id, CAST(regexp_extract(pose_id, '_s(\d+)_s(\d+)$', 1) AS INT) AS seed, count(*) AS k FROM geometry_result GROUP BY ALL)
SELECT condition_id, max(k) / sum(k) AS top_share, max(k) / sum(k) > 0.7 AS seed_artifact FROM s GROUP BY condition_id""")
def f24_seed_artifact(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "geometry_result").groupBy("condition_id", F.regexp_extract("pose_id", r"_s(\d+)_s(\d+)$", 1).try_cast("int").alias("seed")).agg(F.count("*").alias("k"))
    return per.groupBy("condition_id").agg((F.max("k") / F.sum("k")).alias("top_share")).withColumn("seed_artifact", F.col("top_share") > 0.7)


# ---- scalar functions ------------------------------------------------------------------------------------------


@query(r"""SELECT row_id, regexp_extract(fasta_header_raw, '\|([^|]*)\|', 1) AS accession_cell, array_to_string(split(trim(regexp_replace(organism, '\(.*$', '')), ' ')[1:2], ' ') AS organism_2 FROM proteins""")
def e1_header_tokens(spark: SparkSession, d: str) -> DataFrame:
    organism = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("organism", r"\(.*$", "")), " "), 1, 2), " ")
    return table(spark, d, "proteins").select("row_id", F.regexp_extract("fasta_header_raw", r"\|([^|]*)\|", 1).alias("accession_cell"), organism.alias("organism_2"))


@query(r"""SELECT row_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(ec_number, ''), '1\.14\.99\.[0-9-]+'), lambda t: CASE t WHEN '1.14.99.53' THEN 'chitin' WHEN '1.14.99.54' THEN 'cellulose' WHEN '1.14.99.55' THEN 'starch' WHEN '1.14.99.56' THEN 'cellulose' ELSE 'unknown' END))), ',') AS substrates,
  CASE WHEN ec_number LIKE '%1.14.99.54%' AND ec_number LIKE '%1.14.99.56%' THEN 'C1/C4' WHEN ec_number LIKE '%1.14.99.54%' THEN 'C1' WHEN ec_number LIKE '%1.14.99.56%' THEN 'C4' ELSE 'unknown' END AS regio FROM oligo_active_updated""")
def e2_ec_map(spark: SparkSession, d: str) -> DataFrame:
    """Activity classes and their substrates."""
    label = lambda t: F.when(t == "1.14.99.53", "chitin").when(t.isin("1.14.99.54", "1.14.99.56"), "cellulose").when(t == "1.14.99.55", "starch").otherwise("unknown")
    tokens = F.regexp_extract_all(F.coalesce("ec_number", F.lit("")), F.lit(r"1\.14\.99\.[0-9-]+"), F.lit(0))
    has = lambda t: F.coalesce(F.col("ec_number").contains(t), F.lit(False))
    regio = R.ladder([(has("1.14.99.54") & has("1.14.99.56"), "C1/C4"), (has("1.14.99.54"), "C1"), (has("1.14.99.56"), "C4")], "unknown")
    return table(spark, d, "oligo_active_updated").select("row_id", F.array_join(F.array_sort(F.array_distinct(F.transform(tokens, label))), ",").alias("substrates"), regio.alias("regio"))


@query("""SELECT row_id, array_to_string(list_filter([CASE WHEN lower(t) LIKE '%cello%' OR lower(t) LIKE '%cellulose%' THEN 'cellulose' END, CASE WHEN lower(t) LIKE '%chito%' OR lower(t) LIKE '%chitin%' THEN 'chitin' END, CASE WHEN lower(t) LIKE '%malto%' OR lower(t) LIKE '%starch%' THEN 'starch' END, CASE WHEN lower(t) LIKE '%xyl%' THEN 'xylan' END], lambda x: x IS NOT NULL), ',') AS active
FROM (SELECT row_id, concat_ws(' ', oligo_active_classes, ligandkategori_ec) AS t FROM oligo_active_updated)""")
def e3_substrates_from_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.concat_ws(" ", "oligo_active_classes", "ligandkategori_ec"))
    hits = F.array(*(F.when(t.rlike(p), n) for n, p in (("cellulose", "cello|cellulose"), ("chitin", "chito|chitin"), ("starch", "malto|starch"), ("xylan", "xyl"))))
    return table(spark, d, "oligo_active_updated").select("row_id", F.array_join(F.array_compact(hits), ",").alias("active"))


@query("""SELECT row_id, regexp_matches(lower(concat_ws(' ', protein_name, family)), 'lpmo|monooxygenase|\\baa(9|1[0-7])\\b') AS is_domain FROM oligo_active_updated""".replace("\\\\", "\\"))
def e4_domain_patterns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "oligo_active_updated").select("row_id", F.lower(F.concat_ws(" ", "protein_name", "family")).rlike(r"lpmo|monooxygenase|\baa(9|1[0-7])\b").alias("is_domain"))


@query(f"SELECT residue_name, residue_chain, count(*) AS n, min(residue_number) AS lowest, max(residue_number) AS highest FROM {_LABELS} GROUP BY ALL")
def e6_residue_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).groupBy("residue_name", "residue_chain").agg(F.count("*").alias("n"), F.min("residue_number").alias("lowest"), F.max("residue_number").alias("highest"))


@query(f"""SELECT substrate, dp, construct, CASE substrate WHEN 'NAG' THEN 'chitin' WHEN 'CEL' THEN 'cellulose' WHEN 'STA' THEN 'starch' WHEN 'XYL' THEN 'xylan' ELSE 'unknown' END AS substrate_class, count(*) AS n FROM {P} GROUP BY ALL""")
def e7_condition_parts(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in (("NAG", "chitin"), ("CEL", "cellulose"), ("STA", "starch"), ("XYL", "xylan")) for x in p)), F.col("substrate")), F.lit("unknown"))
    return _poses(spark, d).groupBy("substrate", "dp", "construct", name.alias("substrate_class")).agg(F.count("*").alias("n"))


@query(r"""SELECT row_id, regexp_extract(family, '(AA\d+|CBM\d+)', 1) AS family_label, trim(regexp_replace(lower(coalesce(protein_name, '')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM oligo_active_updated""")
def e8_family_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "oligo_active_updated").select("row_id", F.regexp_extract("family", r"(AA\d+|CBM\d+)", 1).alias("family_label"), F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("protein_name", F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "").alias("slug"))


@query("""SELECT o_orderkey, left(sha256(concat_ws(':', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 12) AS case_id FROM orders""")
def e9_case_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.left(F.sha2(F.concat_ws(":", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 256), F.lit(12)).alias("case_id"))


@query("""SELECT row_id, coalesce(nullif(trim(regio), ''), nullif(trim(ligandkategori_ec), ''), 'none') AS first_present, lower(trim(coalesce(oligo_active, ''))) IN ('ja', 'yes', 'true', '1') AS active, try_cast(nullif(trim(regexp_extract(coalesce(ec_number, ''), '([0-9]+)$', 1)), '') AS DOUBLE) AS ec_last FROM oligo_active_updated""")
def e10_coerce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "oligo_active_updated").select(
        "row_id", F.coalesce(S.first_present(F.col("regio"), F.col("ligandkategori_ec")), F.lit("none")).alias("first_present"), S.to_bool(F.col("oligo_active"), ("ja", "yes", "true", "1")).alias("active"),
        S.to_number(F.regexp_extract(F.coalesce("ec_number", F.lit("")), "([0-9]+)$", 1)).alias("ec_last"),
    )


@query("""SELECT condition_id, reported_at, coalesce(n_contact_eligible / nullif(n_ifp_success, 0), 0.0) AS zero_ratio, CASE WHEN coalesce(n_ifp_success, 0) <> 0 THEN n_contact_eligible / n_ifp_success END AS null_ratio, coalesce(nullif(vdw_only_fraction, 0), nullif(noise_fraction, 0), 0.0) AS first_nonzero FROM condition_cluster_summary""")
def e11_safe_divide(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("n_contact_eligible"), F.col("n_ifp_success")
    return table(spark, d, "condition_cluster_summary").select("condition_id", "reported_at", F.coalesce(S.safe_divide(a, b), F.lit(0.0)).alias("zero_ratio"), S.safe_divide(a, b).alias("null_ratio"), S.nonzero_first(F.col("vdw_only_fraction"), F.col("noise_fraction")).alias("first_nonzero"))


@query("""WITH v AS (SELECT label, vec_id, embedding AS e, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
b AS (SELECT vec_id, list_count(list_filter(range(1, 65), lambda i: e[i] > 0.1 AND f[i] > 0.1)) AS c, list_count(list_filter(range(1, 65), lambda i: e[i] > 0.1 OR f[i] > 0.1)) AS u FROM v WHERE f IS NOT NULL)
SELECT vec_id, CASE WHEN u = 0 THEN 0.0 ELSE 1 - c / u END AS jaccard_distance, CASE WHEN u = 0 THEN 0.0 ELSE c / u END AS tanimoto FROM b""")
def e12_set_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Distance of two empty sets is 0, and their similarity is 0 too: the two operators stay separate."""
    from pyspark.sql import Window

    v = table(spark, d, "embeddings").withColumn("f", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("f is not null")
    return v.select("vec_id", V.jaccard_distance(F.col("embedding"), F.col("f"), 0.1).alias("jaccard_distance"), V.tanimoto(F.col("embedding"), F.col("f"), 0.1).alias("tanimoto"))


@query("""SELECT condition_id, reported_at, array_to_string(list_sort(list_distinct(list_filter(cluster_labels, lambda x: x >= 0))), ',') AS labels, len(cluster_labels) AS n FROM condition_cluster_summary WHERE cluster_labels IS NOT NULL""")
def e18_set_to_string(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array_sort(F.array_distinct(F.filter("cluster_labels", lambda x: x >= 0)))
    return table(spark, d, "condition_cluster_summary").where("cluster_labels is not null").select("condition_id", "reported_at", F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"), F.size("cluster_labels").cast("bigint").alias("n"))


@query("""SELECT p.row_id, substr(sequence, 1, 20) AS mature_start, substr(sequence, 21) AS catalytic, sequence LIKE 'H%' AS h1, greatest(sequence_length - 20, 1) AS mature_length FROM proteins p WHERE sequence IS NOT NULL""")
def e20_mature_sequence(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sequence")
    return table(spark, d, "proteins").where(s.isNotNull()).select("row_id", F.substring(s, 1, 20).alias("mature_start"), F.expr("substring(sequence, 21)").alias("catalytic"), s.startswith("H").alias("h1"), F.greatest(F.col("sequence_length") - 20, F.lit(1)).alias("mature_length"))


@query(f"""SELECT CASE WHEN residue_name IN ('PHE', 'TYR', 'TRP', 'HIS') THEN 'aromatic' WHEN residue_name IN ('ARG', 'LYS', 'ASP', 'GLU') THEN 'charged' WHEN residue_name IN ('SER', 'THR', 'ASN', 'GLN', 'CYS') THEN 'polar' ELSE 'nonpolar' END AS residue_class, count(*) AS n, count(DISTINCT pose_key) AS n_poses FROM {_LABELS} GROUP BY 1""")
def e23_residue_class(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("residue_name")
    cls = R.ladder([(r.isin("PHE", "TYR", "TRP", "HIS"), "aromatic"), (r.isin("ARG", "LYS", "ASP", "GLU"), "charged"), (r.isin("SER", "THR", "ASN", "GLN", "CYS"), "polar")], "nonpolar")
    return _labels(spark, d).groupBy(cls.alias("residue_class")).agg(F.count("*").alias("n"), F.countDistinct("pose_key").alias("n_poses"))
