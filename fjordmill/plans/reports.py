"""Reporting tables and the remaining joins, windows and scalars over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordmill.functions import scalars as S
from fjordmill.functions import vectors as V
from fjordmill.operators import fingerprints, relational as R
from fjordmill.plans.classify import _BITS, _LABELS, P, _bits, _labels, _poses, finite
from fjordmill.plans.combine import _PAIR, _pairs
from fjordmill.session import Workspace, table
from fjordmill.sources import readers, writers

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- joins -----------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), o AS (SELECT label, vec_id, i FROM v WHERE x > 0.15), n AS (SELECT label, vec_id, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, count(*) AS c FROM o a JOIN o b ON a.label = b.label AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY ALL)
SELECT c.label, a, b, round(1 - c / (x.n + y.n - c), 9) AS distance FROM c JOIN n x ON x.vec_id = a JOIN n y ON y.vec_id = b WHERE c / (x.n + y.n - c) >= 0.5""")
def j8_group_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances below a threshold inside groups: pairs meet through shared features, never as a product."""
    sets = table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.array_compact(F.transform("embedding", lambda x, i: F.when(x > 0.15, i))).alias("tokens"))
    n = sets.select("id", F.size("tokens").alias("n"))
    c = fingerprints.shared_counts(sets).where("a < b").join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    s = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    return c.where(s >= 0.5).select(F.col("grp").alias("label"), "a", "b", F.round(1 - s, 9).alias("distance"))


@query()
def j18_sequence_match(spark: SparkSession, d: str) -> DataFrame:
    """Positions of each sequence and the one before it in its accession group, paired by matching blocks."""
    from difflib import SequenceMatcher

    w = Window.partitionBy(F.substring("protein_id", 1, 3)).orderBy("row_id")
    p = table(spark, d, "proteins").where("protein_id is not null and sequence is not null").select("protein_id", F.col("sequence").alias("a"), F.lag("sequence").over(w).alias("b")).where("a <> b")

    @F.pandas_udf("array<struct<i: int, j: int, n: int>>")
    def blocks(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"i": m.a + 1, "j": m.b + 1, "n": m.size} for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size] for x, y in zip(a, b)])

    return p.select("protein_id", F.explode(blocks("a", "b")).alias("m")).select("protein_id", "m.i", "m.j", "m.n")


@query()
def j24_greedy_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Points of one label matched to those of the next by coordinates, nearest first, each once."""
    import numpy as np

    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("vec_id"), right.sort_values("vec_id")
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        x, y = (np.stack(v["embedding"])[:, :3].astype(float) for v in (left, right))
        dist = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        out, used_a, used_b = [], set(), set()
        for k in np.argsort(dist, axis=None, kind="stable"):
            i, j = divmod(int(k), len(y))
            if dist[i, j] > 0.2:
                break
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((left["vec_id"].iloc[i], right["vec_id"].iloc[j], dist[i, j]))
        return pd.DataFrame(out, columns=["a", "b", "distance"])

    shifted = e.withColumn("label", F.pmod(F.col("label") - 1, F.lit(10)).cast("int"))
    return e.groupBy("label").cogroup(shifted.groupBy("label")).applyInPandas(match, "a long, b long, distance double")


# ---- aggregations ----------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT protein_id, pose_key, count(*) FILTER (residue_name IN ('PHE', 'TYR', 'TRP', 'HIS')) / count(*) AS aromatic FROM {_LABELS} GROUP BY ALL) SELECT protein_id, count(*) AS n_poses, count(*) FILTER (aromatic > 0.3) AS n_aromatic, round(avg(aromatic), 6) AS mean_aromatic FROM r GROUP BY 1""")
def a11_protein_patch(spark: SparkSession, d: str) -> DataFrame:
    r = _labels(spark, d).groupBy("protein_id", "pose_key").agg((F.count_if(F.col("residue_name").isin("PHE", "TYR", "TRP", "HIS")) / F.count("*")).alias("aromatic"))
    return r.groupBy("protein_id").agg(F.count("*").alias("n_poses"), F.count_if(F.col("aromatic") > 0.3).alias("n_aromatic"), F.round(F.avg("aromatic"), 6).alias("mean_aromatic"))


_ACTIVE = "(SELECT upper(trim(uniprot_id)) AS k, list_distinct(list(lower(ligandkategori_ec)) FILTER (ligandkategori_ec IS NOT NULL)) AS active FROM oligo_active_updated GROUP BY 1)"
_CLASS = "CASE substrate WHEN 'NAG' THEN 'chitin' WHEN 'CEL' THEN 'cellulose' WHEN 'STA' THEN 'starch' ELSE 'xylan' END"


@query(f"""WITH u AS (SELECT protein_id, {_CLASS} AS substrate, avg(n_non_vdw_interactions) AS v FROM {P} GROUP BY ALL), j AS (SELECT u.*, list_contains(active, substrate) AS ok FROM u JOIN {_ACTIVE} a ON u.protein_id = a.k WHERE len(active) = 1)
SELECT protein_id, round(avg(v) FILTER (ok), 6) AS right_mean, round(avg(v) FILTER (NOT ok), 6) AS wrong_mean FROM j GROUP BY 1 HAVING count(*) FILTER (ok) > 0 AND count(*) FILTER (NOT ok) > 0""")
def a22_right_vs_wrong(spark: SparkSession, d: str) -> DataFrame:
    """Proteins active on one class only; dual and unknown ones are left out."""
    s = F.col("substrate")
    name = R.ladder([(s == "NAG", "chitin"), (s == "CEL", "cellulose"), (s == "STA", "starch")], "xylan")
    u = _poses(spark, d).groupBy("protein_id", name.alias("substrate")).agg(F.avg("n_non_vdw_interactions").alias("v"))
    a = table(spark, d, "oligo_active_updated").groupBy(F.upper(F.regexp_replace("uniprot_id", "^ +| +$", "")).alias("protein_id")).agg(F.collect_set(F.lower("ligandkategori_ec")).alias("active"))
    j = u.join(a.where(F.size("active") == 1), "protein_id").withColumn("ok", F.array_contains("active", F.col("substrate")))
    return j.groupBy("protein_id").agg(F.round(F.avg(F.when(F.col("ok"), F.col("v"))), 6).alias("right_mean"), F.round(F.avg(F.when(~F.col("ok"), F.col("v"))), 6).alias("wrong_mean")).where("right_mean is not null and wrong_mean is not null")


@query("""SELECT condition_id, round(sum(CASE WHEN min_cu_c1 < min_cu_c4 - 0.5 THEN 1.0 WHEN min_cu_c4 < min_cu_c1 - 0.5 THEN 0.0 ELSE 0.5 END) / count(*), 9) AS c1_share, count(*) AS n FROM geometry_result WHERE isfinite(min_cu_c1) AND isfinite(min_cu_c4) GROUP BY 1""")
def a24_activity_split(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("min_cu_c1"), F.col("min_cu_c4")
    share = F.when(a < b - 0.5, 1.0).when(b < a - 0.5, 0.0).otherwise(0.5)
    return table(spark, d, "geometry_result").where(finite("min_cu_c1") & finite("min_cu_c4")).groupBy("condition_id").agg(F.round(F.sum(share) / F.count("*"), 9).alias("c1_share"), F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT condition_id, feature, count(*) AS k FROM {_BITS} GROUP BY ALL) SELECT condition_id, feature, k, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY k DESC, feature) AS r FROM f) WHERE r <= 5""")
def a25_top_interactions(spark: SparkSession, d: str) -> DataFrame:
    f = _bits(spark, d).groupBy("condition_id", "feature").agg(F.count("*").alias("k"))
    r = f.withColumn("place", F.row_number().over(Window.partitionBy("condition_id").orderBy(F.desc("k"), "feature")))
    return r.where("place <= 5").withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH p AS (SELECT protein_id, construct, median(n_non_vdw_interactions) AS m FROM {P} GROUP BY ALL) SELECT construct, count(*) AS n_proteins, median(m) AS group_median, round(avg(m), 6) AS group_mean, count(m) FILTER (m > 10) AS n_high FROM p GROUP BY 1""")
def a27_group_tables(spark: SparkSession, d: str) -> DataFrame:
    p = _poses(spark, d).groupBy("protein_id", "construct").agg(F.median("n_non_vdw_interactions").alias("m"))
    return p.groupBy("construct").agg(F.count("*").alias("n_proteins"), F.median("m").alias("group_median"), F.round(F.avg("m"), 6).alias("group_mean"), F.count_if(F.col("m") > 10).alias("n_high"))


@query("""WITH r AS (SELECT upper(trim(uniprot_id)) AS k, max(regio) AS regio FROM oligo_active_updated GROUP BY 1), m AS (SELECT protein_id, median(min_cu_c1 - min_cu_c4) AS diff FROM geometry_result WHERE isfinite(min_cu_c1) AND isfinite(min_cu_c4) GROUP BY 1)
SELECT coalesce(regio, 'unknown') AS regio, count(*) AS n, round(median(diff), 6) AS median_diff FROM m LEFT JOIN r ON m.protein_id = r.k GROUP BY 1""")
def a29_regio_geometry(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "oligo_active_updated").groupBy(F.upper(F.regexp_replace("uniprot_id", "^ +| +$", "")).alias("protein_id")).agg(F.max("regio").alias("regio"))
    m = table(spark, d, "geometry_result").where(finite("min_cu_c1") & finite("min_cu_c4")).groupBy("protein_id").agg(F.median(F.col("min_cu_c1") - F.col("min_cu_c4")).alias("diff"))
    return m.join(r, "protein_id", "left").groupBy(F.coalesce("regio", F.lit("unknown")).alias("regio")).agg(F.count("*").alias("n"), F.round(F.median("diff"), 6).alias("median_diff"))


@query("""SELECT family, count(*) AS n_rows, count(DISTINCT upper(trim(uniprot_id))) AS n_sequences, count(*) FILTER (coalesce(trim(oligo_active_classes), '') <> '') AS n_annotated FROM oligo_active_updated GROUP BY 1""")
def a34_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    t = lambda c: F.regexp_replace(c, "^ +| +$", "")
    return table(spark, d, "oligo_active_updated").groupBy("family").agg(F.count("*").alias("n_rows"), F.countDistinct(F.upper(t("uniprot_id"))).alias("n_sequences"), F.count_if(F.coalesce(t("oligo_active_classes"), F.lit("")) != "").alias("n_annotated"))


@query("""WITH c AS (SELECT row_id, unnest(regexp_extract_all(upper(coalesce(uniprot_ids_all, '')), '[A-Z][0-9][A-Z][A-Z0-9]{2}[0-9][A-Z][A-Z0-9]{2}[0-9]')) AS acc FROM proteins), s AS (SELECT protein_id, min(sequence_sha256) AS sha FROM proteins WHERE protein_id IS NOT NULL GROUP BY 1)
SELECT row_id, count(DISTINCT sha) AS n_sequences, count(DISTINCT sha) > 1 AS is_split FROM c LEFT JOIN s ON c.acc = s.protein_id GROUP BY 1""")
def a36_row_splits(spark: SparkSession, d: str) -> DataFrame:
    from fjordmill.operators.orphans import accessions

    p = table(spark, d, "proteins")
    c = p.select("row_id", F.explode(accessions(F.coalesce("uniprot_ids_all", F.lit("")))).alias("protein_id"))
    s = p.where("protein_id is not null").groupBy("protein_id").agg(F.min("sequence_sha256").alias("sha"))
    return c.join(s, "protein_id", "left").groupBy("row_id").agg(F.countDistinct("sha").alias("n_sequences")).withColumn("is_split", F.col("n_sequences") > 1)


@query("""WITH r AS (SELECT condition_id, count(*) FILTER (NOT coalesce(passed, false)) AS fails, count(*) FILTER (NOT coalesce(cu_found, false)) AS a, count(*) FILTER (NOT coalesce(cu_his_all_in_range, false)) AS b, count(*) FILTER (n_non_vdw_interactions < 3) AS c FROM geometry_result GROUP BY 1)
SELECT condition_id, CASE WHEN a + b + c > 0 THEN fails * a / (a + b + c) ELSE 0.0 END AS copper, CASE WHEN a + b + c > 0 THEN fails * b / (a + b + c) ELSE 0.0 END AS histidine, CASE WHEN a + b + c > 0 THEN fails * c / (a + b + c) ELSE 0.0 END AS contacts FROM r""")
def a41_apportioned(spark: SparkSession, d: str) -> DataFrame:
    """Reason counts scaled to the number of failures."""
    no = F.lit(False)
    r = table(spark, d, "geometry_result").groupBy("condition_id").agg(F.count_if(~F.coalesce("passed", no)).alias("f"), F.count_if(~F.coalesce("cu_found", no)).alias("a"), F.count_if(~F.coalesce("cu_his_all_in_range", no)).alias("b"), F.count_if(F.col("n_non_vdw_interactions") < 3).alias("c"))
    total = F.col("a") + F.col("b") + F.col("c")
    part = lambda x, n: F.when(total > 0, F.col("f") * F.col(x) / total).otherwise(0.0).alias(n)
    return r.select("condition_id", part("a", "copper"), part("b", "histidine"), part("c", "contacts"))


@query(f"""WITH p AS (SELECT substrate, CAST(right_m - left_m AS DOUBLE) AS x FROM {_PAIR}) SELECT coalesce(substrate, 'All') AS substrate, count(x) AS n, round(avg(x), 6) AS mean_x, round(stddev_samp(x), 6) AS sd_x FROM p GROUP BY GROUPING SETS ((substrate), ())""")
def a42_difference_by_substrate(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("x", F.col("right_m") - F.col("left_m"))
    sd = F.when(F.count("x") > 1, F.stddev_samp("x"))
    return p.groupingSets([["substrate"], []], "substrate").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(sd, 6).alias("sd_x")).withColumn("substrate", F.coalesce("substrate", F.lit("All")))


@query(f"""WITH t AS (SELECT residue_number FROM {_LABELS} GROUP BY 1 ORDER BY count(*) DESC, residue_number LIMIT 20) SELECT residue_number, count(*) FILTER (residue_chain = 'A') AS a, count(*) FILTER (residue_chain = 'B') AS b FROM {_LABELS} WHERE residue_number IN (SELECT residue_number FROM t) GROUP BY 1""")
def a43_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most contacted residues by chain; the top-k is the feature."""
    l = _labels(spark, d)
    top = l.groupBy("residue_number").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "residue_number").limit(20)
    return l.join(top, "residue_number", "left_semi").groupBy("residue_number").pivot("residue_chain", ["A", "B"]).agg(F.count(F.lit(1))).select("residue_number", F.coalesce("A", F.lit(0)).alias("a"), F.coalesce("B", F.lit(0)).alias("b"))


@query("""SELECT count(*) AS n, round(avg(noise_fraction), 6) AS mean_noise, median(noise_fraction) AS median_noise, count(*) FILTER (noise_fraction > 0.3) AS n_noisy FROM condition_cluster_summary""")
def a45_noise_summary(spark: SparkSession, d: str) -> DataFrame:
    x = "noise_fraction"
    return table(spark, d, "condition_cluster_summary").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean_noise"), F.median(x).alias("median_noise"), F.count_if(F.col(x) > 0.3).alias("n_noisy"))


@query("""SELECT family, count(*) AS n, count(*) FILTER (lower(trim(has_ligand)) IN ('true', '1', 'yes', 'ja')) / count(*) AS ligand_rate, count(DISTINCT pdb_code) AS n_codes FROM crystal_reference_list GROUP BY 1""")
def a46_curated_anchor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crystal_reference_list").groupBy("family").agg(F.count("*").alias("n"), (F.count_if(S.to_bool(F.col("has_ligand"), ("true", "1", "yes", "ja"))) / F.count("*")).alias("ligand_rate"), F.countDistinct("pdb_code").alias("n_codes"))


@query(f"""SELECT construct, substrate, dp, count(*) FILTER (passed) AS n_pass, count(*) FILTER (NOT coalesce(passed, false)) AS n_fail FROM {P} GROUP BY ALL""")
def a47_stacked_counts(spark: SparkSession, d: str) -> DataFrame:
    return _poses(spark, d).groupBy("construct", "substrate", "dp").agg(F.count_if("passed").alias("n_pass"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("n_fail"))


# ---- windows, top-k, sets --------------------------------------------------------------------------------------


@query(f"""SELECT protein_id, substrate, dp, first(condition_id ORDER BY pose_key, loaded_at) AS condition_id FROM {P} GROUP BY ALL""")
def d3_first_by_three_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.index_first(_poses(spark, d).select("protein_id", "substrate", "dp", "condition_id", "pose_key", "loaded_at"), ["protein_id", "substrate", "dp"], ["pose_key", "loaded_at"]).select("protein_id", "substrate", "dp", "condition_id")


@query("""SELECT condition_id, arg_min(pose_key, (min_cu_c1, pose_key)) AS nearest FROM geometry_result WHERE isfinite(min_cu_c1) GROUP BY 1""")
def w11_nearest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geometry_result").where(finite("min_cu_c1")).groupBy("condition_id").agg(F.min_by("pose_key", F.struct("min_cu_c1", "pose_key")).alias("nearest"))


@query("""SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS m FROM part GROUP BY ALL ORDER BY avg(p_retailprice) DESC, p_brand, p_type LIMIT 35""")
def t2_top_by_mean(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("m"))
    return m.orderBy(F.desc("m"), "p_brand", "p_type").limit(35).withColumn("m", F.round("m", 6))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def t4_case_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred cases in manifest order; the cap is the feature."""
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").orderBy("o_orderpriority", "o_orderkey").limit(100).select("o_orderkey", "o_custkey")


@query("SELECT protein_id, max(n_non_vdw_interactions) AS best_contacts, min(CASE WHEN isfinite(min_cu_c1) THEN min_cu_c1 END) AS best_distance FROM geometry_result GROUP BY 1")
def t7_best_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geometry_result").groupBy("protein_id").agg(F.max("n_non_vdw_interactions").alias("best_contacts"), F.min(F.when(finite("min_cu_c1"), F.col("min_cu_c1"))).alias("best_distance"))


@query("""SELECT coalesce(p_brand, 'All') AS brand, count(*) AS n, median(p_retailprice) AS med FROM part GROUP BY GROUPING SETS ((p_brand), ())""")
def u5_all_level(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").rollup("p_brand").agg(F.count("*").alias("n"), F.median("p_retailprice").alias("med"))
    return g.select(F.coalesce("p_brand", F.lit("All")).alias("brand"), "n", "med")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def u7_normal_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


# ---- scalars ---------------------------------------------------------------------------------------------------


@query(r"""WITH m AS (SELECT row_id, unnest(regexp_extract_all(coalesce(binding_modules, ''), '\(([0-9]+)-[0-9]+\)', 1)) AS a, unnest(regexp_extract_all(coalesce(binding_modules, ''), '\([0-9]+-([0-9]+)\)', 1)) AS b FROM clustering_pilot_protein_overview)
SELECT row_id, count(*) AS n_modules, min(CAST(a AS INT)) AS first_start, max(CAST(b AS INT)) AS last_end, min(CAST(a AS INT)) - 1 AS core_end FROM m GROUP BY 1""")
def e5_feature_spans(spark: SparkSession, d: str) -> DataFrame:
    """Module spans from text: number, first start, last end, and where the core ends."""
    t = F.coalesce("binding_modules", F.lit(""))
    nums = lambda p: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda x: x.cast("int"))
    a, b = nums(r"\(([0-9]+)-[0-9]+\)"), nums(r"\([0-9]+-([0-9]+)\)")
    return table(spark, d, "clustering_pilot_protein_overview").where(F.size(a) > 0).select("row_id", F.size(a).cast("bigint").alias("n_modules"), F.array_min(a).alias("first_start"), F.array_max(b).alias("last_end"), (F.array_min(a) - 1).alias("core_end"))


@query(f"SELECT pose_key, condition_id, feature FROM {_BITS}")
def e16_long_form(spark: SparkSession, d: str) -> DataFrame:
    return _bits(spark, d)


@query("""SELECT record_id, CAST(json_extract(payload, '$.privateer.recognition_rate') AS DOUBLE) AS rate, len(json_keys(payload, '$.posebusters.errors')) AS n_errors FROM qc_report_raw WHERE json_valid(payload) AND json_type(payload, '$.posebusters.errors') = 'OBJECT' AND json_type(payload, '$.privateer.recognition_rate') IN ('DOUBLE', 'UBIGINT', 'BIGINT')""")
def e17_json_scalars(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("payload")
    q = table(spark, d, "qc_report_raw").select("record_id", v.alias("v"))
    errors, rate = F.try_variant_get("v", "$.posebusters.errors", "map<string,variant>"), F.try_variant_get("v", "$.privateer.recognition_rate", "variant")
    number = F.schema_of_variant(rate).rlike("^(DECIMAL|DOUBLE|BIGINT)")
    return q.where(errors.isNotNull() & number).select("record_id", F.try_variant_get("v", "$.privateer.recognition_rate", "double").alias("rate"), F.size(errors).cast("bigint").alias("n_errors"))


@query("SELECT pose_key, loaded_at, CAST(date_trunc('month', run_day) AS DATE) AS month, date_diff('day', run_day, CAST(loaded_at AT TIME ZONE 'UTC' AS DATE)) AS days_late FROM geometry_result WHERE run_day IS NOT NULL")
def e19_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geometry_result").where("run_day is not null").select("pose_key", "loaded_at", F.trunc("run_day", "month").alias("month"), F.date_diff(F.to_date("loaded_at"), "run_day").cast("bigint").alias("days_late"))


@query(f"SELECT pose_key, residue_name, residue_number, greatest(residue_number - 20, 1) AS mature_number, residue_chain FROM {_LABELS}")
def e21_mature_numbering(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("pose_key", "residue_name", "residue_number", F.greatest(F.col("residue_number") - 20, F.lit(1)).alias("mature_number"), "residue_chain")


@query(f"SELECT protein_id, substrate, dp, right_m - left_m AS delta_contacts, right_n - left_n AS delta_n FROM {_PAIR}")
def e22_paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("protein_id", "substrate", "dp", (F.col("right_m") - F.col("left_m")).alias("delta_contacts"), (F.col("right_n") - F.col("left_n")).alias("delta_n"))


@query("""WITH v AS (SELECT vec_id, label, embedding AS e, first_value(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(e[i] AS DOUBLE) - f[i]) ** 2)) / 64), 6) AS rmsd FROM v""")
def e14_plain_rmsd(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    first = e.groupBy("label").agg(F.min_by("e", "vec_id").alias("f"))
    return e.join(first, "label").select("vec_id", F.round(V.rmsd(F.col("e"), F.col("f")), 6).alias("rmsd"))


# ---- sources ---------------------------------------------------------------------------------------------------


@query("SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS protein_id FROM orders")
def s21_case_manifest_k10(spark: SparkSession, d: str) -> DataFrame:
    cols = ["case_id", "status", "protein_id"]
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("protein_id"))
    writers.write_tsv(o, p := Workspace(spark, "cases").root + "/cases", cols, strict=True, sep=",")
    return readers.read_tsv(spark, p, cols, sep=",")


