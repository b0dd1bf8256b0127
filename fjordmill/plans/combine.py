"""Joins, aggregations, de-duplication, windows, top-k and set operations (survey groups J, A, D, W, T and U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordmill.functions import scalars as S
from fjordmill.operators import intervals, manifest, relational as R, replay
from fjordmill.plans.classify import _BITS, _LABELS, P, _bits, _labels, _poses, finite
from fjordmill.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- joins -----------------------------------------------------------------------------------------------------

_FIRST = "(SELECT condition_id, arg_min(n_clusters, (reported_at, n_ifp_success)) AS n_clusters, arg_min(noise_fraction, (reported_at, n_ifp_success)) AS noise_fraction FROM condition_cluster_summary GROUP BY condition_id)"


_PAIR = f"""(WITH c AS (SELECT condition_id, protein_id, substrate, dp, construct, median(n_non_vdw_interactions) AS m, count(*) AS n FROM {P} GROUP BY ALL)
SELECT a.protein_id, a.substrate, a.dp, a.m AS left_m, b.m AS right_m, a.n AS left_n, b.n AS right_n FROM c a JOIN c b USING (protein_id, substrate, dp) WHERE a.construct = 'domain_only' AND b.construct = 'full_length')"""


def _pairs(spark, d):
    c = _poses(spark, d).groupBy("condition_id", "protein_id", "substrate", "dp", "construct").agg(F.median("n_non_vdw_interactions").alias("m"), F.count("*").alias("n"))
    return R.pair_sides(c, ["protein_id", "substrate", "dp"], "construct", "domain_only", "full_length", ["m", "n"], ["condition_id"])


@query(f"SELECT *, right_m - left_m AS delta FROM {_PAIR}")
def j3_construct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("delta", F.col("right_m") - F.col("left_m"))


@query("""SELECT s_suppkey, n_name, r_name, count(l_orderkey) AS n_lines FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def j5_left_chain(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    out = table(spark, d, "supplier").join(lines, "s_suppkey", "left").join(n, F.col("s_nationkey") == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.select("s_suppkey", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query(f"""WITH r AS (SELECT * FROM (VALUES ('core', 1, 220), ('linker', 221, 300), ('cbm', 301, 600)) AS t(region, lo, hi))
SELECT region, count(*) AS n, count(DISTINCT protein_id) AS n_proteins FROM {_LABELS} l LEFT JOIN r ON l.residue_number BETWEEN r.lo AND r.hi AND l.residue_chain = 'A' GROUP BY region""")
def j7_region_range(spark: SparkSession, d: str) -> DataFrame:
    regions = spark.createDataFrame([("core", 1, 220), ("linker", 221, 300), ("cbm", 301, 600)], "region string, lo int, hi int")
    on = F.col("residue_number").between(F.col("lo"), F.col("hi")) & (F.col("residue_chain") == "A")
    return _labels(spark, d).join(F.broadcast(regions), on, "left").groupBy("region").agg(F.count("*").alias("n"), F.countDistinct("protein_id").alias("n_proteins"))


@query("""WITH pdb AS (SELECT upper(trim(uniprot_id)) AS k, max(pdb_before_af3_cutoff_count) AS n_pdb FROM metadata_pdb_count GROUP BY 1), o AS (SELECT upper(trim(uniprot_id)) AS k, max(oligo_active) AS oligo FROM oligo_active_updated GROUP BY 1),
p AS (SELECT protein_id, count(*) AS n_rows FROM proteins WHERE protein_id IS NOT NULL GROUP BY 1)
SELECT protein_id, n_rows, n_pdb, oligo, CASE WHEN lower(oligo) IN ('ja', 'yes') THEN 'active' WHEN oligo IS NULL THEN 'unknown' ELSE 'inactive' END AS label FROM p LEFT JOIN pdb ON p.protein_id = pdb.k LEFT JOIN o ON p.protein_id = o.k""")
def j9_protein_labels(spark: SparkSession, d: str) -> DataFrame:
    key = F.upper(F.trim("uniprot_id")).alias("protein_id")
    pdb = table(spark, d, "metadata_pdb_count").groupBy(key).agg(F.max("pdb_before_af3_cutoff_count").alias("n_pdb"))
    o = table(spark, d, "oligo_active_updated").groupBy(key).agg(F.max("oligo_active").alias("oligo"))
    p = table(spark, d, "proteins").where("protein_id is not null").groupBy("protein_id").agg(F.count("*").alias("n_rows"))
    label = R.ladder([(F.lower("oligo").isin("ja", "yes"), "active"), (F.col("oligo").isNull(), "unknown")], "inactive")
    return p.join(pdb, "protein_id", "left").join(o, "protein_id", "left").withColumn("label", label)


@query("""WITH a AS (SELECT upper(trim(uniprot_id)) AS k, string_split(lower(string_agg(DISTINCT coalesce(ligandkategori_ec, ''), ',')), ',') AS active FROM oligo_active_updated GROUP BY 1), n AS (SELECT protein_id, condition_id, split_part(condition_id, '_', 2)[1:3] AS lig FROM geometry_result GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (list_contains(active, CASE lig WHEN 'NAG' THEN 'chitin' WHEN 'CEL' THEN 'cellulose' WHEN 'STA' THEN 'starch' ELSE 'xylan' END)) AS n_right FROM n JOIN a ON n.protein_id = a.k""")
def j11_set_membership(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "oligo_active_updated").groupBy(F.upper(F.trim("uniprot_id")).alias("protein_id")).agg(F.collect_set(F.lower(F.coalesce("ligandkategori_ec", F.lit("")))).alias("active"))
    n = _poses(spark, d).groupBy("protein_id", "condition_id").agg(F.first("substrate").alias("lig"))
    name = R.ladder([(F.col("lig") == "NAG", "chitin"), (F.col("lig") == "CEL", "cellulose"), (F.col("lig") == "STA", "starch")], "xylan")
    return n.join(a, "protein_id").agg(F.count("*").alias("n"), F.count_if(F.array_contains("active", name)).alias("n_right"))


@query("SELECT condition_id, count(*) AS n FROM geometry_result WHERE condition_id IN (SELECT condition_id FROM condition_cluster_summary WHERE n_clusters > 2) AND condition_id NOT IN (SELECT condition_id FROM condition_cluster_summary WHERE noise_fraction > 0.2 AND condition_id IS NOT NULL) GROUP BY 1")
def j12_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "condition_cluster_summary")
    g = table(spark, d, "geometry_result")
    return g.join(s.where("n_clusters > 2"), "condition_id", "left_semi").join(s.where("noise_fraction > 0.2"), "condition_id", "left_anti").groupBy("condition_id").agg(F.count("*").alias("n"))


_CAND = "(SELECT row_id, unnest(string_split(cat_group_accessions_used, ';')) AS acc, generate_subscripts(string_split(cat_group_accessions_used, ';'), 1) AS pos FROM metadata_pdb_count)"


@query(f"""WITH s AS (SELECT protein_id, max(sequence_sha256) AS sha FROM proteins GROUP BY 1)
SELECT m.row_id, arg_min(c.acc, c.pos) FILTER (s.sha IS NOT NULL) AS accession, arg_min(s.sha, c.pos) FILTER (s.sha IS NOT NULL) AS sha FROM metadata_pdb_count m LEFT JOIN {_CAND} c USING (row_id) LEFT JOIN s ON upper(trim(c.acc)) = s.protein_id GROUP BY m.row_id""")
def j13_first_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved rows come out with nulls."""
    m = table(spark, d, "metadata_pdb_count")
    s = table(spark, d, "proteins").where("protein_id is not null").groupBy("protein_id").agg(F.max("sequence_sha256").alias("sha"))
    c = m.select("row_id", F.posexplode_outer(F.split("cat_group_accessions_used", ";")).alias("pos", "acc"))
    hit = c.join(s, F.upper(F.trim("acc")) == F.col("protein_id"), "left")
    first = F.when(F.col("sha").isNotNull(), F.col("pos"))
    return hit.groupBy("row_id").agg(F.min_by("acc", first).alias("accession"), F.min_by("sha", first).alias("sha"))


@query("""SELECT protein_id, count(DISTINCT sequence_sha256) AS n_sequences, count(DISTINCT sequence_sha256) > 1 AS conflict FROM proteins WHERE protein_id IS NOT NULL GROUP BY 1""")
def j14_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "proteins").where("protein_id is not null").groupBy("protein_id").agg(F.countDistinct("sequence_sha256").alias("n_sequences")).withColumn("conflict", F.col("n_sequences") > 1)


@query("""WITH m AS (SELECT unnest(['af3', 'boltz', 'rf3']) AS model), c AS (SELECT s_suppkey, n_nationkey, model, CASE WHEN s_nationkey = n_nationkey THEN 'ready' WHEN model = 'rf3' THEN 'skipped' ELSE 'pending' END AS status FROM supplier, nation, m)
SELECT model, status, count(*) AS n FROM c GROUP BY ALL""")
def j15_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = manifest.cases(table(spark, d, "supplier"), table(spark, d, "nation"), ["af3", "boltz", "rf3"], ready=F.col("s_nationkey") == F.col("n_nationkey"), skipped=F.col("model") == "rf3")
    return cases.groupBy("model", "status").agg(F.count("*").alias("n"))


@query("""SELECT a, b, c, a * 100 + b * 10 + c AS point FROM (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([4, 5]) AS b), (SELECT unnest([6, 7]) AS c)""")
def j16_grid(spark: SparkSession, d: str) -> DataFrame:
    return manifest.grid(spark, {"a": [1, 2, 3], "b": [4, 5], "c": [6, 7]}).withColumn("point", F.col("a") * 100 + F.col("b") * 10 + F.col("c"))


@query("""WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT a.vec_id, count(*) AS n_near FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.01 GROUP BY 1""")
def j17_within_distance(spark: SparkSession, d: str) -> DataFrame:
    """Points within a cutoff meet through the cells of a grid of that width, not by comparing all with all."""
    e = table(spark, d, "embeddings").select("vec_id", "label", *(F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")))
    return intervals.within_distance(e, "vec_id", ["x", "y", "z"], 0.1, ["label"]).groupBy(F.col("a").alias("vec_id")).agg(F.count("*").alias("n_near"))


@query("""WITH v AS (SELECT vec_id, label, embedding AS e, first_value(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
u AS (SELECT vec_id, list_count(list_filter(range(1, 65), lambda i: e[i] > 0 AND f[i] > 0)) AS c, list_count(list_filter(range(1, 65), lambda i: e[i] > 0 OR f[i] > 0)) AS t FROM v) SELECT vec_id, c AS shared, t AS total, CASE WHEN t = 0 THEN 0.0 ELSE c / t END AS tanimoto FROM u""")
def j19_feature_union(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints against the first of their group, on the union of features in long form."""
    e = table(spark, d, "embeddings")
    on = e.select("vec_id", "label", F.posexplode("embedding").alias("f", "v")).where("v > 0").select("vec_id", "label", "f")
    ref = e.groupBy("label").agg(F.min("vec_id").alias("r"))
    ref_on = ref.join(on.select(F.col("vec_id").alias("r"), "f"), "r").select("label", "f", F.lit(1).alias("hit"))
    ref_n = ref_on.groupBy("label").agg(F.count("*").alias("nr"))
    mine = on.join(ref_on, ["label", "f"], "left").groupBy("vec_id", "label").agg(F.count("*").alias("n"), F.count("hit").alias("shared"))
    out = e.select("vec_id", "label").join(mine, ["vec_id", "label"], "left").join(ref_n, "label", "left").fillna(0, ["n", "shared", "nr"])
    total = F.col("n") + F.col("nr") - F.col("shared")
    return out.select("vec_id", "shared", total.alias("total"), F.when(total == 0, 0.0).otherwise(F.col("shared") / total).alias("tanimoto"))


@query("""WITH c AS (SELECT upper(trim(uniprot_id)) AS k, first(family ORDER BY row_id) FILTER (family IS NOT NULL) AS family, first(regio ORDER BY row_id) FILTER (regio IS NOT NULL) AS regio FROM oligo_active_updated GROUP BY 1)
SELECT k AS accession, family, regio, CASE WHEN family IS NULL THEN 'no_family' WHEN regio IS NULL THEN 'no_regio' ELSE 'resolved' END AS reason FROM c""")
def j21_catalog(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "oligo_active_updated")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_id"))).alias(c)
    c = o.groupBy(F.upper(F.trim("uniprot_id")).alias("accession")).agg(first("family"), first("regio"))
    return c.withColumn("reason", R.ladder([(F.col("family").isNull(), "no_family"), (F.col("regio").isNull(), "no_regio")], "resolved"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_totalprice AS x FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_totalprice AS y FROM orders WHERE o_orderstatus = 'O') SELECT i, x, y, y - x AS delta FROM a JOIN b USING (i)""")
def j23_zip_lists(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = lambda s, c: manifest.ordinals(o.where(F.col("o_orderstatus") == s).select("o_orderkey", F.col("o_totalprice").alias(c)), ["o_orderkey"], "i").drop("o_orderkey")
    return side("F", "x").join(side("O", "y"), "i").withColumn("delta", F.col("y") - F.col("x"))


@query("""WITH a AS (SELECT upper(trim(uniprot_id)) AS k, min(row_id) AS v FROM oligo_active_updated GROUP BY 1), b AS (SELECT upper(trim(uniprot_id)) AS k, min(row_id) AS v FROM metadata_pdb_count GROUP BY 1), p AS (SELECT DISTINCT protein_id FROM proteins WHERE protein_id IS NOT NULL)
SELECT protein_id, coalesce(a.v, b.v) AS hit FROM p LEFT JOIN a ON p.protein_id = a.k LEFT JOIN b ON p.protein_id = b.k""")
def j25_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t: table(spark, d, t).groupBy(F.upper(F.trim("uniprot_id")).alias("k")).agg(F.min("row_id").alias("v"))
    keys = table(spark, d, "proteins").where("protein_id is not null").select("protein_id").distinct()
    return R.fallback_join(keys, "protein_id", [(part("oligo_active_updated"), "k", "v"), (part("metadata_pdb_count"), "k", "v")], "hit")


# ---- aggregations ----------------------------------------------------------------------------------------------


@query(f"""WITH b AS {_BITS}, n AS (SELECT condition_id, count(DISTINCT pose_key) AS k FROM cbm_analysis_result GROUP BY 1), f AS (SELECT DISTINCT feature FROM b)
SELECT n.condition_id, f.feature, count(DISTINCT b.pose_key) / any_value(n.k) AS frequency FROM n CROSS JOIN f LEFT JOIN b ON b.condition_id = n.condition_id AND b.feature = f.feature GROUP BY ALL""")
def a6_feature_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Features that no pose of a condition has come out with 0; the feature list is the catalogue of vector positions."""
    b = _bits(spark, d)
    n = table(spark, d, "cbm_analysis_result").groupBy("condition_id").agg(F.countDistinct("pose_key").alias("k"))
    per = b.groupBy("condition_id", "feature").agg(F.countDistinct("pose_key").alias("h"))
    names = [r.feature for r in b.select("feature").distinct().collect()]  # the width of the vectors
    keys = n.select("condition_id", "k", F.explode(F.array(*(F.lit(x).cast("bigint") for x in sorted(names)))).alias("feature"))
    return R.densify(keys, per, ["condition_id", "feature"], {"h": 0}).select("condition_id", "feature", (F.col("h") / F.col("k")).alias("frequency"))


@query(f"""SELECT protein_id, residue_name, residue_number, count(DISTINCT pose_key) AS n_poses, bool_or(residue_number IN (1, 86, 175)) AS catalytic, coalesce(nullif(array_to_string(list_sort(list(DISTINCT residue_chain)), ','), ''), 'none') AS chains FROM {_LABELS} GROUP BY ALL""")
def a7_residue_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).groupBy("protein_id", "residue_name", "residue_number").agg(F.countDistinct("pose_key").alias("n_poses"), F.bool_or(F.col("residue_number").isin(1, 86, 175)).alias("catalytic"), F.coalesce(F.nullif(S.sorted_join(F.col("residue_chain")), F.lit("")), F.lit("none")).alias("chains"))


@query(f"""WITH c AS (SELECT protein_id, condition_id, avg(min_cu_c1) AS c1, avg(min_cu_c4) AS c4 FROM {P} WHERE isfinite(min_cu_c1) AND isfinite(min_cu_c4) GROUP BY ALL) SELECT protein_id, round(avg(c1), 6) AS c1, round(avg(c4), 6) AS c4, round(avg(c1) - avg(c4), 5) AS delta FROM c GROUP BY 1""")
def a10_regio_delta(spark: SparkSession, d: str) -> DataFrame:
    c = _poses(spark, d).where(finite("min_cu_c1") & finite("min_cu_c4")).groupBy("protein_id", "condition_id").agg(F.avg("min_cu_c1").alias("c1"), F.avg("min_cu_c4").alias("c4"))
    return c.groupBy("protein_id").agg(F.round(F.avg("c1"), 6).alias("c1"), F.round(F.avg("c4"), 6).alias("c4"), F.round(F.avg("c1") - F.avg("c4"), 5).alias("delta"))


@query(f"""WITH b AS (SELECT pose_key, condition_id, feature % 6 AS kind, count(*) AS k FROM {_BITS} GROUP BY ALL), n AS (SELECT count(DISTINCT pose_key) AS np, count(DISTINCT condition_id) AS nc FROM cbm_analysis_result)
SELECT kind, count(DISTINCT pose_key) / any_value(np) AS pose_prevalence, count(DISTINCT condition_id) / any_value(nc) AS condition_prevalence, median(k) AS median_when_present FROM b, n GROUP BY kind""")
def a13_type_prevalence(spark: SparkSession, d: str) -> DataFrame:
    b = _bits(spark, d).groupBy("pose_key", "condition_id", (F.col("feature") % 6).alias("kind")).agg(F.count("*").alias("k"))
    n = table(spark, d, "cbm_analysis_result").agg(F.countDistinct("pose_key").alias("np"), F.countDistinct("condition_id").alias("nc")).first()
    return b.groupBy("kind").agg((F.countDistinct("pose_key") / n.np).alias("pose_prevalence"), (F.countDistinct("condition_id") / n.nc).alias("condition_prevalence"), F.median("k").alias("median_when_present"))


@query(f"""WITH b AS {_BITS}, n AS (SELECT condition_id, count(DISTINCT pose_key) AS k FROM cbm_analysis_result GROUP BY 1), f AS (SELECT DISTINCT feature FROM b),
p AS (SELECT n.condition_id, f.feature, count(DISTINCT b.pose_key) / any_value(n.k) AS v FROM n CROSS JOIN f LEFT JOIN b ON b.condition_id = n.condition_id AND b.feature = f.feature GROUP BY ALL)
SELECT feature, max(v) AS max_prevalence, round(var_pop(v), 8) AS var_prevalence FROM p GROUP BY feature""")
def a14_feature_prevalence(spark: SparkSession, d: str) -> DataFrame:
    """Conditions without a feature count as 0: they enter through the number of conditions, not as rows."""
    n = table(spark, d, "cbm_analysis_result").groupBy("condition_id").agg(F.countDistinct("pose_key").alias("k"))
    nc = n.count()
    v = _bits(spark, d).groupBy("condition_id", "feature").agg(F.countDistinct("pose_key").alias("h")).join(n, "condition_id").withColumn("v", F.col("h") / F.col("k"))
    s = v.groupBy("feature").agg(F.max("v").alias("max_prevalence"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return s.select("feature", "max_prevalence", F.round(F.col("q") / nc - (F.col("s") / nc) ** 2, 8).alias("var_prevalence"))


@query("""SELECT condition_id, count(*) FILTER (passed) / count(*) AS convergence, median(his_brace_angle) AS median_angle, quantile_cont(his_brace_angle, 0.75) - quantile_cont(his_brace_angle, 0.25) AS iqr, count(*) FILTER (passed) / count(*) < 0.5 AS low FROM geometry_result GROUP BY 1""")
def a15_convergence(spark: SparkSession, d: str) -> DataFrame:
    a = "his_brace_angle"
    share = F.count_if("passed") / F.count("*")
    return table(spark, d, "geometry_result").groupBy("condition_id").agg(share.alias("convergence"), F.median(a).alias("median_angle"), (F.percentile(a, 0.75) - F.percentile(a, 0.25)).alias("iqr"), (share < 0.5).alias("low"))


@query(f"""SELECT protein_id, construct, coalesce(sum(n) FILTER (share >= 0.5) / nullif(sum(n), 0), 0) AS plausible_fraction, max(share) AS best FROM (SELECT protein_id, construct, condition_id, count(*) AS n, count(*) FILTER (least(min_cu_c1, min_cu_c4) < 6) / count(*) AS share FROM {P} GROUP BY ALL) GROUP BY ALL""")
def a16_construct_fractions(spark: SparkSession, d: str) -> DataFrame:
    c = _poses(spark, d).groupBy("protein_id", "construct", "condition_id").agg(F.count("*").alias("n"), (F.count_if(F.least("min_cu_c1", "min_cu_c4") < 6) / F.count("*")).alias("share"))
    return c.groupBy("protein_id", "construct").agg(F.coalesce(F.sum(F.when(F.col("share") >= 0.5, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("plausible_fraction"), F.max("share").alias("best"))


@query("""SELECT p_brand, count(v) AS n, median(v) AS median_v, round(avg(v), 6) AS mean_v, round(CASE WHEN count(v) > 1 THEN stddev_samp(v) ELSE 0.0 END, 6) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS lo, max(v) AS hi, count(*) FILTER (v > 1500) AS n_high FROM (SELECT p_brand, p_retailprice AS v FROM part) GROUP BY 1""")
def a17_descriptives(spark: SparkSession, d: str) -> DataFrame:
    v = "p_retailprice"
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.count(v).alias("n"), F.median(v).alias("median_v"), F.round(F.avg(v), 6).alias("mean_v"), F.round(F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0), 6).alias("sd"),
        F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(F.col(v) > 1500).alias("n_high"),
    )


@query(f"""WITH u AS (SELECT protein_id, residue_number, count(*) AS k FROM {_LABELS} GROUP BY ALL), g AS (SELECT residue_number, substr(protein_id, 1, 2) AS grp, avg(k) AS m FROM u GROUP BY ALL) SELECT residue_number, round(avg(m), 6) AS mean_of_means, round(max(m), 6) AS max_of_means, count(*) AS n_groups FROM g GROUP BY 1""")
def a20_two_level_means(spark: SparkSession, d: str) -> DataFrame:
    u = _labels(spark, d).groupBy("protein_id", "residue_number").agg(F.count("*").alias("k"))
    g = u.groupBy("residue_number", F.substring("protein_id", 1, 2).alias("grp")).agg(F.avg("k").alias("m"))
    return g.groupBy("residue_number").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.max("m"), 6).alias("max_of_means"), F.count("*").alias("n_groups"))


@query(f"""WITH u AS (SELECT protein_id, substrate, avg(n_non_vdw_interactions) AS v FROM {P} GROUP BY ALL), s AS (SELECT DISTINCT substrate FROM u)
SELECT s.substrate, round(avg(v) FILTER (u.substrate = s.substrate), 6) AS target_mean, round(avg(v) FILTER (u.substrate <> s.substrate), 6) AS other_mean, count(v) FILTER (u.substrate = s.substrate) AS n_target FROM s, u GROUP BY s.substrate""")
def a21_target_vs_other(spark: SparkSession, d: str) -> DataFrame:
    """The others' mean comes from the totals, so nothing is compared with everything."""
    u = _poses(spark, d).groupBy("protein_id", "substrate").agg(F.avg("n_non_vdw_interactions").alias("v"))
    per = u.groupBy("substrate").agg(F.sum("v").alias("s"), F.count("v").alias("n_target"))
    w = Window.partitionBy()
    both = per.withColumn("ts", F.sum("s").over(w)).withColumn("tn", F.sum("n_target").over(w))
    return both.select("substrate", F.round(F.col("s") / F.col("n_target"), 6).alias("target_mean"), F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n_target")), 6).alias("other_mean"), "n_target")


@query(f"""SELECT protein_id, coalesce(construct, 'All constructs') AS construct, count(*) AS n, count(DISTINCT condition_id) AS n_conditions, sum(CASE WHEN passed THEN 1 ELSE 0 END) / count(*) AS pass_ratio, median(n_non_vdw_interactions) AS median_contacts FROM {P} GROUP BY GROUPING SETS ((protein_id, construct), (protein_id))""")
def a26_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    p = _poses(spark, d)
    g = p.groupingSets([["protein_id", "construct"], ["protein_id"]], "protein_id", "construct").agg(F.count("*").alias("n"), F.countDistinct("condition_id").alias("n_conditions"), (F.count_if("passed") / F.count("*")).alias("pass_ratio"), F.median("n_non_vdw_interactions").alias("median_contacts"))
    return g.withColumn("construct", F.coalesce("construct", F.lit("All constructs")))


@query("""WITH x AS (SELECT DISTINCT protein_id, pdb_code, has_ligand FROM crystal_reference_list) SELECT 'distinct' AS scope, count(*) AS n, count(DISTINCT pdb_code) AS n_codes FROM x UNION ALL SELECT 'raw', count(*), count(DISTINCT pdb_code) FROM crystal_reference_list""")
def a30_two_scopes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "crystal_reference_list").select("protein_id", "pdb_code", "has_ligand")
    agg = lambda df, s: df.agg(F.count("*").alias("n"), F.countDistinct("pdb_code").alias("n_codes")).select(F.lit(s).alias("scope"), "n", "n_codes")
    return agg(x.distinct(), "distinct").unionByName(agg(x, "raw"))


@query("""SELECT sequence_sha256, min(protein_id) AS primary_id, array_to_string(list_sort(list(DISTINCT protein_id)), ';') AS members, count(DISTINCT protein_id) AS n FROM proteins WHERE protein_id IS NOT NULL GROUP BY 1""")
def a35_same_sequence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "proteins").where("protein_id is not null").groupBy("sequence_sha256").agg(F.min("protein_id").alias("primary_id"), S.sorted_join(F.col("protein_id"), ";").alias("members"), F.countDistinct("protein_id").alias("n"))


@query("""SELECT o_custkey, o_orderpriority, count(*) AS n, array_to_string(list_sort(list(o_orderkey)), ',') AS cases FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def a38_case_groups(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("cases"))


@query("""SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms, round(avg(abs(value)), 6) AS mae, median(value) AS med FROM events GROUP BY 1""")
def a44_rms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sqrt(F.avg(v * v)), 6).alias("rms"), F.round(F.avg(F.abs(v)), 6).alias("mae"), F.median(v).alias("med"))


# ---- de-duplication, windows, top-k, set operations ------------------------------------------------------------


@query("SELECT pose_key, first(loaded_at ORDER BY loaded_at) AS loaded_at, first(n_non_vdw_interactions ORDER BY loaded_at) AS n FROM geometry_result GROUP BY pose_key")
def d1_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return R.index_first(table(spark, d, "geometry_result").select("pose_key", "loaded_at", F.col("n_non_vdw_interactions").alias("n")), ["pose_key"], ["loaded_at"])


@query("""SELECT row_id, array_to_string(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda x: x[1] <> '' AND list_position(t, x[1]) = x[2]), lambda x: x[1]), ';') AS tokens FROM (SELECT row_id, list_transform(string_split(oligo_active_classes, ';'), lambda x: trim(x)) AS t FROM oligo_active_updated WHERE oligo_active_classes IS NOT NULL)""")
def d2_unique_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.array_distinct(F.filter(F.transform(F.split("oligo_active_classes", ";"), lambda x: F.regexp_replace(x, "^ +| +$", "")), lambda x: x != ""))
    return table(spark, d, "oligo_active_updated").where("oligo_active_classes is not null").select("row_id", F.array_join(t, ";").alias("tokens"))


_GREEDY = """
WITH RECURSIVE i AS (SELECT l_suppkey AS grp, l_orderkey || '-' || l_linenumber AS id, CAST(l_partkey % 1000 AS INT) AS "start", CAST(trunc(l_partkey % 1000 + l_quantity) AS INT) AS "end", CAST(trunc(l_tax * 100) AS INT) AS priority, -l_extendedprice AS score FROM lineitem),
o AS (SELECT *, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY grp ORDER BY {order}) AS r FROM i),
step AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(s INT, e INT)[]) AS kept, CAST(NULL AS VARCHAR) AS took FROM i
  UNION ALL SELECT grp, r, CASE WHEN fits THEN list_append(kept, {{'s': s, 'e': e}}) ELSE kept END, CASE WHEN fits THEN id END FROM (
    SELECT o.*, st.kept, len(list_filter(st.kept, lambda k: CASE WHEN least(k.e - k.s, o.e - o.s) + {plus} > 0 THEN greatest(0, least(k.e, o.e) - greatest(k.s, o.s) + {plus}) / (least(k.e - k.s, o.e - o.s) + {plus}) ELSE 0 END > {limit})) = 0 AS fits
    FROM step st JOIN o ON o.grp = st.grp AND o.r = st.r + 1))
SELECT o.grp, o.id, o."start", o."end", o.priority, o.score FROM o JOIN step ON step.grp = o.grp AND step.r = o.r AND step.took IS NOT NULL"""


@query(_GREEDY.format(order="priority, \"start\", id, \"end\", score", plus=0, limit=0.5))
def d4_interval_priority(spark: SparkSession, d: str) -> DataFrame:
    """Greedy de-duplication by priority: intervals of documents' modules, overlap above half of the shorter."""
    return intervals.greedy(_intervals(spark, d), ["grp"], order=["priority", "start", "id", "end", "score"], inclusive=False, limit=0.5)


@query(_GREEDY.format(order="score, \"start\", id, \"end\", priority", plus=1, limit=0.3))
def d5_interval_pruning(spark: SparkSession, d: str) -> DataFrame:
    return intervals.greedy(_intervals(spark, d), ["grp"], order=["score", "start", "id", "end", "priority"], inclusive=True, limit=0.3)


def _intervals(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_suppkey").alias("grp"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.pmod("l_partkey", F.lit(1000)).cast("int").alias("start"), (F.pmod("l_partkey", F.lit(1000)) + F.col("l_quantity")).cast("int").alias("end"), (F.col("l_tax") * 100).cast("int").alias("priority"), (-F.col("l_extendedprice")).alias("score"))


@query("""SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS avg_rank FROM part""")
def w1_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", R.average_rank("p_size", ["p_brand"]).alias("avg_rank"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_shipdate, (l_extendedprice % 1000 + 1) / 1001 AS p FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', l_shipdate) ORDER BY p, l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY date_trunc('month', l_shipdate)) AS m FROM p)
SELECT l_orderkey, l_linenumber, round(least(1.0, min(p * m / r) OVER (PARTITION BY date_trunc('month', l_shipdate) ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def w2_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), F.date_trunc("month", "l_shipdate").alias("month"), ((F.col("l_extendedprice") % 1000 + 1) / 1001).alias("p"))
    return R.benjamini_hochberg(p, "p", "q", ["month"]).select("k.l_orderkey", "k.l_linenumber", F.round("q", 9).alias("q"))


@query("""SELECT condition_id, pose_key FROM (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY CASE WHEN contains(pose_id, '_s1_') THEN 0 ELSE 1 END, n_non_vdw_interactions DESC NULLS LAST, pose_key, loaded_at) AS r FROM geometry_result) WHERE r = 1""")
def w3_reference_pose(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "geometry_result").withColumn("seed1", F.when(F.col("pose_id").contains("_s1_"), 0).otherwise(1))
    return R.top_per_group(g, ["condition_id"], ["seed1", F.desc_nulls_last("n_non_vdw_interactions"), "pose_key", "loaded_at"], 1).select("condition_id", "pose_key")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 1 ELSE 0 END) AS b FROM embeddings),
d AS (SELECT a.label, a.vec_id, sum(CASE WHEN list_sum(list_transform(range(1, 65), lambda i: greatest(a.b[i], c.b[i]))) = 0 THEN 0.0 ELSE 1 - list_sum(list_transform(range(1, 65), lambda i: a.b[i] * c.b[i])) / list_sum(list_transform(range(1, 65), lambda i: greatest(a.b[i], c.b[i]))) END) AS s FROM v a JOIN v c ON a.label = c.label GROUP BY ALL)
SELECT label, arg_min(vec_id, (round(s, 9), vec_id)) AS medoid, round(min(s), 6) AS distance_sum FROM d GROUP BY label""")
def w4_medoid(spark: SparkSession, d: str) -> DataFrame:
    from fjordmill.operators import fingerprints

    sets = table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.array_compact(F.transform("embedding", lambda x, i: F.when(x > 0.1, i))).alias("tokens"))
    return fingerprints.medoids(sets).select(F.col("grp").alias("label"), F.col("id").alias("medoid"), F.round("distance_sum", 6).alias("distance_sum"))


@query("""WITH f AS (SELECT p_brand, min(p_partkey) AS m FROM part GROUP BY 1), k AS (SELECT p_brand, dense_rank() OVER (ORDER BY m) AS label FROM f), n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n < 85 THEN -1 ELSE CAST(label AS INT) END AS label FROM part JOIN k USING (p_brand) JOIN n USING (p_brand)""")
def w5_renumber_w6_noise(spark: SparkSession, d: str) -> DataFrame:
    """Labels renumbered by first appearance; small clusters become noise."""
    p = table(spark, d, "part")
    f = p.groupBy("p_brand").agg(F.min("p_partkey").alias("m"), F.count("*").alias("n")).withColumn("label", F.dense_rank().over(Window.orderBy("m")))
    return p.join(f, "p_brand").select("p_partkey", F.when(F.col("n") < 85, -1).otherwise(F.col("label")).cast("int").alias("label"))


@query("""SELECT p_size, p_brand, avg_price FROM (SELECT p_size, p_brand, round(avg(p_retailprice), 6) AS avg_price, count(*) AS n FROM part GROUP BY ALL) ORDER BY n DESC, avg_price, p_size, p_brand LIMIT 1""")
def w7_best_point(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").groupBy("p_size", "p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("avg_price"), F.count("*").alias("n"))
    return a.orderBy(F.desc("n"), "avg_price", "p_size", "p_brand").limit(1).select("p_size", "p_brand", "avg_price")


@query("""SELECT row_id, pos, residue, CASE WHEN residue <> 'A' THEN sum(CASE WHEN residue <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) END AS column_index FROM (SELECT row_id, unnest(string_split(sequence, '')) AS residue, generate_subscripts(string_split(sequence, ''), 1) AS pos FROM proteins WHERE sequence IS NOT NULL)""".replace("sum(CASE WHEN residue <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos)", "CAST(sum(CASE WHEN residue <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) AS BIGINT)"))
def w10_column_index(spark: SparkSession, d: str) -> DataFrame:
    """Running count of the marks that are no gap (here: no A) in an aligned sequence."""
    s = table(spark, d, "proteins").where("sequence is not null").select("row_id", F.posexplode(F.split("sequence", "(?!^)(?!$)")).alias("p", "residue"))
    n = F.sum(F.when(F.col("residue") != "A", 1).otherwise(0)).over(Window.partitionBy("row_id").orderBy("p"))
    return s.select("row_id", (F.col("p") + 1).cast("bigint").alias("pos"), "residue", F.when(F.col("residue") != "A", n).alias("column_index"))


@query(f"""WITH p AS (SELECT *, right_m - left_m AS delta FROM {_PAIR}) SELECT 'largest_gain' AS criterion, protein_id, substrate, dp, delta FROM (SELECT * FROM p ORDER BY delta DESC NULLS LAST, protein_id, substrate, dp LIMIT 5) UNION ALL SELECT 'largest_change', protein_id, substrate, dp, delta FROM (SELECT * FROM p ORDER BY abs(delta) DESC NULLS LAST, protein_id, substrate, dp LIMIT 5)""")
def t1_examples(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("delta", F.col("right_m") - F.col("left_m"))
    top = lambda name, key: p.orderBy(F.desc_nulls_last(key), "protein_id", "substrate", "dp").limit(5).select(F.lit(name).alias("criterion"), "protein_id", "substrate", "dp", "delta")
    return top("largest_gain", F.col("delta")).unionByName(top("largest_change", F.abs("delta")))


@query("""SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) ORDER BY r, p_brand LIMIT 40""")
def t6_round_robin(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return p.orderBy("r", "p_brand").limit(40).select("p_partkey", "p_brand")


@query("""SELECT 'customer' AS shard, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier""")
def u1_union_of_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return R.union_of_shards([("customer", c), ("supplier", s)])


@query("""SELECT pose_key, loaded_at, len(list_intersect(list_distinct(a), list_distinct(b))) AS shared, len(list_distinct(a || b)) AS total, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS only_first FROM (SELECT pose_key, loaded_at, list_filter(lpmo_contact_residues, lambda x: x IS NOT NULL) AS a, list_filter(coalesce(cbm_contact_residues, []), lambda x: x IS NOT NULL) AS b FROM cbm_analysis_result WHERE lpmo_contact_residues IS NOT NULL)""")
def u2_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cbm_analysis_result").where("lpmo_contact_residues is not null")
    a, b = F.array_compact("lpmo_contact_residues"), F.array_compact(F.coalesce("cbm_contact_residues", F.array().cast("array<string>")))
    n = lambda x: F.size(x).cast("bigint")
    return c.select("pose_key", "loaded_at", n(F.array_intersect(a, b)).alias("shared"), n(F.array_union(a, b)).alias("total"), n(F.array_except(a, b)).alias("only_first"))


@query("""SELECT condition_id, reported_at, metric, value FROM condition_cluster_summary UNPIVOT INCLUDE NULLS (value FOR metric IN (contact_eligible_fraction, null_ifp_fraction, vdw_only_fraction))""")
def u3_melt(spark: SparkSession, d: str) -> DataFrame:
    m = ["contact_eligible_fraction", "null_ifp_fraction", "vdw_only_fraction"]
    return table(spark, d, "condition_cluster_summary").unpivot(["condition_id", "reported_at"], m, "metric", "value")


@query("""SELECT p_brand, round(avg(p_retailprice) FILTER (p_size <= 10), 6) AS small, round(avg(p_retailprice) FILTER (p_size > 10 AND p_size <= 30), 6) AS medium, round(avg(p_retailprice) FILTER (p_size > 30), 6) AS large FROM part GROUP BY 1""")
def u4_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("s", R.ladder([(F.col("p_size") <= 10, "small"), (F.col("p_size") <= 30, "medium")], "large"))
    return p.groupBy("p_brand").pivot("s", ["small", "medium", "large"]).agg(F.round(F.avg("p_retailprice"), 6))


@query("""SELECT DISTINCT upper(trim(uniprot_id)) AS accession FROM oligo_active_updated WHERE uniprot_id IS NOT NULL EXCEPT SELECT protein_id FROM proteins""")
def u6_missing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "oligo_active_updated").where("uniprot_id is not null").select(F.upper(F.regexp_replace("uniprot_id", "^ +| +$", "")).alias("accession")).distinct()
    return o.join(table(spark, d, "proteins"), F.col("accession") == F.col("protein_id"), "left_anti")


# ---- event log -------------------------------------------------------------------------------------------------


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) = 'purchase' AS completed, count(*) AS n_events FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id""")
def s9_event_replay(spark: SparkSession, d: str) -> DataFrame:
    return replay.last_state(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], done="purchase", revoked="error")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def a33_status_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
