"""Condition, cluster and residue tables over the test tables (survey J1, J4, J6, A1 to A5, A8, A9, A12, A40, A37).

Clusters are those that condition_cluster_summary reports: cluster_labels follows a condition's poses by pose_key.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordmill.operators import conditions as C
from fjordmill.operators import family, relational as R, signatures as G
from fjordmill.plans.classify import _LABELS, _labels, finite
from fjordmill.session import Workspace, table

QUERIES, SQL = {}, {}
#: Added before rounding here and in the SQL, so that exact ties fall the same way whatever the order of a sum.
HAIR = 1e-9


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _fin(c: str) -> str:
    return f"max(CASE WHEN isfinite({c}) THEN {c} END)"


_BASE = f"""WITH once AS (SELECT pose_key, min(condition_id) AS condition_id, min(protein_id) AS protein_id, max(n_non_vdw_interactions) AS contacts, {_fin('min_cu_c1')} AS c1, {_fin('min_cu_c4')} AS c4, {_fin('his_brace_angle')} AS angle,
  bool_or(passed) AS passed, bool_or(cu_found) AS cu, bool_or(cu_his_all_in_range) AS his FROM geometry_result GROUP BY pose_key),
status AS (SELECT *, CASE WHEN c1 IS NULL THEN 'missing' WHEN c1 BETWEEN 2 AND 4 THEN 'highly_plausible' WHEN c1 BETWEEN 2 AND 6 THEN 'plausible' ELSE 'computable' END AS s1,
  CASE WHEN c4 IS NULL THEN 'missing' WHEN c4 BETWEEN 2 AND 4 THEN 'highly_plausible' WHEN c4 BETWEEN 2 AND 6 THEN 'plausible' ELSE 'computable' END AS s4 FROM once),
ifp AS (SELECT pose_key, min(condition_id) AS condition_id, max(cbm_ligand_min_dist) AS rmsd, max(list_sum(ifp_lpmo_bitvector)) AS n_on, max(len(list_distinct(list_filter(lpmo_contact_residues, lambda x: x IS NOT NULL)))) AS n_res FROM cbm_analysis_result GROUP BY pose_key),
elig AS (SELECT *, CASE WHEN coalesce(n_on, 0) = 0 THEN 'null_ifp' WHEN n_on < 8 THEN 'vdw_only' WHEN coalesce(n_res, 0) < 3 THEN 'low_specific_contact' ELSE 'eligible' END AS eligibility FROM ifp),
picked AS (SELECT condition_id, arg_max(cluster_labels, reported_at) FILTER (cluster_labels IS NOT NULL) AS labels, arg_max(medoids, reported_at) FILTER (medoids IS NOT NULL) AS med FROM condition_cluster_summary GROUP BY 1),
ranked AS (SELECT pose_key, condition_id, row_number() OVER (PARTITION BY condition_id ORDER BY pose_key) AS r FROM ifp),
assign AS (SELECT r.condition_id, r.pose_key, p.labels[r.r] AS cluster_id FROM ranked r JOIN picked p USING (condition_id) WHERE r.r <= len(p.labels)),
medoid AS (SELECT condition_id, unnest(map_keys(med)) AS cluster_id, unnest(map_values(med)) AS medoid FROM picked),
conv AS (SELECT pose_key, rmsd, rmsd < 10 AS convergent FROM ifp WHERE rmsd IS NOT NULL),
members AS (SELECT a.condition_id, a.cluster_id, a.pose_key, s.c1, s.c4, s.angle, s.s1, s.s4, s.pose_key AS g_key, v.rmsd, v.convergent, v.pose_key AS v_key, m.medoid FROM assign a LEFT JOIN status s USING (pose_key) LEFT JOIN conv v USING (pose_key)
  LEFT JOIN medoid m ON m.condition_id = a.condition_id AND m.cluster_id = a.cluster_id WHERE a.cluster_id >= 0),
"""
_SHARE = "count(*) FILTER ({0}) / count(*)"
_SIGNATURES = _BASE + """sigs AS (SELECT condition_id, cluster_id, count(*) AS n_poses, count(*) / sum(count(*)) OVER (PARTITION BY condition_id) AS occupancy, any_value(medoid) AS medoid,
  """ + ", ".join(
    f"{_SHARE.format(f'{s} IN ({values})')} AS {c}_geometry_{name}_fraction"
    for c, s in (("c1", "s1"), ("c4", "s4"))
    for name, values in (("computable", "'computable', 'plausible', 'highly_plausible'"), ("plausible", "'plausible', 'highly_plausible'"), ("highly_plausible", "'highly_plausible'"))
) + """,
  round(median(c1) + 1e-9, 6) AS c1_median, round(quantile_cont(c1, 0.75) - quantile_cont(c1, 0.25) + 1e-9, 6) AS c1_iqr, round(median(c4) + 1e-9, 6) AS c4_median, round(quantile_cont(c4, 0.75) - quantile_cont(c4, 0.25) + 1e-9, 6) AS c4_iqr,
  round(avg(angle) + 1e-9, 6) AS mean_angle, round(median(angle) + 1e-9, 6) AS median_angle, max(angle) FILTER (pose_key = medoid) AS medoid_angle,
  round(avg(rmsd) + 1e-9, 6) AS mean_rmsd, round(median(rmsd) + 1e-9, 6) AS median_rmsd, max(rmsd) FILTER (pose_key = medoid) AS medoid_rmsd, count(*) FILTER (convergent) / nullif(count(v_key), 0) AS convergent_fraction
  FROM members GROUP BY condition_id, cluster_id)"""


#: What is shared by the parts of one query: None, or (workspace, tables that were written for it so far).
_SHARED: ContextVar = ContextVar("shared", default=None)


def shared(f):
    """A building block that a query with many parts computes once (see sharing)."""

    def run(spark, d):
        kept = _SHARED.get()
        if kept is None:
            return f(spark, d)
        work, tables = kept
        if f.__name__ not in tables:
            tables[f.__name__] = work.put(f(spark, d), f.__name__.strip("_"))
        return tables[f.__name__]

    return run


@contextmanager
def sharing(spark):
    """Within it each building block is written once and read by all parts."""
    if _SHARED.get() is not None:
        yield
        return
    token = _SHARED.set((Workspace(spark, "tables"), {}))
    try:
        yield
    finally:
        _SHARED.reset(token)


@shared
def _once(spark, d):
    g = table(spark, d, "geometry_result")
    fin = lambda c: F.max(F.when(finite(c), F.col(c)))
    return g.groupBy("pose_key").agg(
        F.min("condition_id").alias("condition_id"), F.min("protein_id").alias("protein_id"), F.max("n_non_vdw_interactions").alias("contacts"), fin("min_cu_c1").alias("c1"), fin("min_cu_c4").alias("c4"), fin("his_brace_angle").alias("angle"),
        F.bool_or("passed").alias("passed"), F.bool_or("cu_found").alias("cu"), F.bool_or("cu_his_all_in_range").alias("his"),
    )


def _status(spark, d):
    kind = lambda c: R.ladder([(F.col(c).isNull(), "missing"), (F.col(c).between(2, 4), "highly_plausible"), (F.col(c).between(2, 6), "plausible")], "computable")
    return _once(spark, d).withColumn("s1", kind("c1")).withColumn("s4", kind("c4"))


@shared
def _ifp(spark, d):
    on = F.aggregate("ifp_lpmo_bitvector", F.lit(0), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0)))
    n_res = F.size(F.array_distinct(F.array_compact("lpmo_contact_residues")))
    rows = table(spark, d, "cbm_analysis_result").groupBy("pose_key").agg(F.min("condition_id").alias("condition_id"), F.max("cbm_ligand_min_dist").alias("rmsd"), F.max(on).alias("n_on"), F.max(F.when(F.col("lpmo_contact_residues").isNotNull(), n_res)).alias("n_res"))
    kind = R.ladder([(F.coalesce("n_on", F.lit(0)) == 0, "null_ifp"), (F.col("n_on") < 8, "vdw_only"), (F.coalesce("n_res", F.lit(0)) < 3, "low_specific_contact")], "eligible")
    return rows.withColumn("eligibility", kind)


def _reported(spark, d, column):
    return table(spark, d, "condition_cluster_summary").where(F.col(column).isNotNull()).groupBy("condition_id").agg(F.max_by(column, "reported_at").alias("v"))


@shared
def _assignments(spark, d):
    labels = _reported(spark, d, "cluster_labels").select("condition_id", F.posexplode("v").alias("r", "cluster_id")).withColumn("r", F.col("r") + 1)
    # at most as many poses as there are labels (200) are ranked in a condition: the rest is cut off before the sort
    ranked = _ifp(spark, d).select("condition_id", "pose_key").withColumn("r", F.row_number().over(Window.partitionBy("condition_id").orderBy("pose_key"))).where("r <= 200")
    return ranked.join(labels, ["condition_id", "r"]).select("condition_id", "pose_key", "cluster_id")


def _medoids(spark, d):
    return _reported(spark, d, "medoids").select("condition_id", F.explode("v").alias("cluster_id", "medoid"))


def _convergence(spark, d):
    return _ifp(spark, d).where("rmsd is not null").select("pose_key", "rmsd", (F.col("rmsd") < 10).alias("convergent"))


PLAUSIBLE = {"computable": ("computable", "plausible", "highly_plausible"), "plausible": ("plausible", "highly_plausible"), "highly_plausible": ("highly_plausible",)}


@shared
def _signatures(spark, d):
    s = _status(spark, d)
    statuses = {c: {f"{k}_geometry_{n}_fraction": v for n, v in PLAUSIBLE.items()} for c, k in (("s1", "c1"), ("s4", "c4"))}
    return G.cluster_signatures(
        _assignments(spark, d), condition="condition_id", cluster="cluster_id", pose="pose_key", medoids=_medoids(spark, d), geometry=s.select("pose_key", "s1", "s4", "c1", "c4"), statuses=statuses, geometry_fields=["c1", "c4"],
        confidence=s.select("pose_key", "angle"), confidence_fields=["angle"], convergence=_convergence(spark, d), rmsd="rmsd", convergent="convergent",
    )


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    keep = ("_fraction", "occupancy", "medoid_")
    return df.select(*(F.round(F.col(c) + HAIR, digits).alias(c) if t == "double" and not c.endswith(keep[:2]) and not c.startswith(keep[2]) else F.col(c) for c, t in df.dtypes))


@query(_SIGNATURES + " SELECT * FROM sigs")
def a5_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_signatures(spark, d))


@query(_BASE + "x AS (SELECT 1) SELECT condition_id, count(*) AS n_members, count(g_key) AS n_geometry, count(v_key) AS n_convergence, round(avg(angle) + 1e-9, 6) AS mean_angle FROM members GROUP BY 1")
def j6_members_with_geometry(spark: SparkSession, d: str) -> DataFrame:
    told = G.member_table(_assignments(spark, d).where("cluster_id >= 0"), "pose_key", [(_status(spark, d), ["angle"]), (_convergence(spark, d), ["rmsd", "convergent"])])
    return told.groupBy("condition_id").agg(F.count("*").alias("n_members"), F.count("has_0").alias("n_geometry"), F.count("has_1").alias("n_convergence"), F.round(F.avg("angle") + HAIR, 6).alias("mean_angle"))


_ATTRITION = """r AS (SELECT condition_id, unnest(list_filter([CASE WHEN NOT coalesce(cu, false) THEN 'no_copper' END, CASE WHEN NOT coalesce(his, false) THEN 'histidine_range' END, CASE WHEN contacts < 3 THEN 'few' END], lambda x: x IS NOT NULL)) AS reason FROM once),
reas AS (SELECT condition_id, '{' || string_agg('"' || reason || '":' || k, ',' ORDER BY reason) || '}' AS reasons FROM (SELECT condition_id, reason, count(*) AS k FROM r GROUP BY ALL) GROUP BY 1),
att AS (SELECT o.condition_id, min(protein_id) AS protein_id, count(*) AS n_generated, count(*) FILTER (coalesce(passed, false)) AS n_pass, count(*) FILTER (NOT coalesce(passed, false)) AS n_fail, count(*) FILTER (NOT coalesce(passed, false)) / count(*) AS hard_fail_rate, any_value(reasons) AS reasons
  FROM once o LEFT JOIN reas USING (condition_id) GROUP BY 1)"""


def _attrition(spark, d):
    o, no = _once(spark, d), F.lit(False)
    reasons = {"no_copper": ~F.coalesce("cu", no), "histidine_range": ~F.coalesce("his", no), "few": F.col("contacts") < 3}
    return C.attrition(o, ["condition_id"], F.col("passed"), reasons, {"protein_id": F.min("protein_id")})


@query(_BASE + _ATTRITION + " SELECT * FROM att")
def a1_attrition(spark: SparkSession, d: str) -> DataFrame:
    return _attrition(spark, d)


_CONFIDENCE = ["angle", "contacts", "c1", "c4", "rmsd", "n_on"]
_CONF = """conf AS (SELECT o.condition_id, count(*) AS n_confidence_rows, count(*) FILTER (o.angle IS NOT NULL) AS n_confidence_available, """ + ", ".join(f"round(avg({c}) + 1e-9, 6) AS mean_{c}, round(median({c}) + 1e-9, 6) AS median_{c}" for c in _CONFIDENCE) + " FROM once o LEFT JOIN ifp i USING (pose_key) GROUP BY 1)"


def _confidence(spark, d):
    rows = _once(spark, d).join(_ifp(spark, d).select("pose_key", "rmsd", "n_on"), "pose_key", "left")
    return C.confidence(rows, ["condition_id"], _CONFIDENCE, F.col("angle").isNotNull())


@query(_BASE + _CONF + " SELECT * FROM conf")
def a2_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_confidence(spark, d))


_WEIGHTED = ["c1_geometry_plausible_fraction", "c4_geometry_plausible_fraction", "c1_geometry_highly_plausible_fraction", "c4_geometry_highly_plausible_fraction", "c1_median", "c4_median", "c1_iqr", "c4_iqr", "mean_angle", "median_angle", "mean_rmsd", "convergent_fraction"]
_AGG = """agg AS (SELECT condition_id, count(*) AS n_cluster_rows, round(sum(occupancy) + 1e-9, 6) AS cluster_total_occupancy, round(avg(n_poses) + 1e-9, 6) AS mean_cluster_size, """ + ", ".join(
    f"round(CASE WHEN coalesce(sum(occupancy) FILTER ({c} IS NOT NULL), 0) <> 0 THEN sum({c} * occupancy) / sum(occupancy) FILTER ({c} IS NOT NULL) ELSE avg({c}) END + 1e-9, 5) AS occupancy_weighted_{c}" for c in _WEIGHTED
) + " FROM sigs GROUP BY 1)"


@query(_SIGNATURES + ", " + _AGG + " SELECT * FROM agg")
def a3_weighted(spark: SparkSession, d: str) -> DataFrame:
    got = C.cluster_aggregates(_rounded(_signatures(spark, d)), ["condition_id"], _WEIGHTED)
    return got.select(*(F.round(F.col(c) + HAIR, 5).alias(c) if c.startswith("occupancy_") else F.round(F.col(c) + HAIR, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes))


_FIRST = ["n_ifp_success", "n_clusters", "n_noise", "noise_fraction", "top_cluster_occupancy", "cluster_entropy", "contact_eligible_fraction", "vdw_only_fraction", "median_n_non_vdw_interactions"]
_TABLE = _SIGNATURES + ", " + _ATTRITION + ", " + _CONF + ", " + _AGG + f""",
frst AS (SELECT condition_id, arg_min({{{', '.join(f"'{c}': {c}" for c in _FIRST)}}}, reported_at) AS f FROM condition_cluster_summary GROUP BY 1),
cvg AS (SELECT condition_id, count(*) FILTER (convergent) / count(*) AS convergence_fraction, round(median(rmsd) + 1e-9, 6) AS median_ligand_rmsd FROM (SELECT i.condition_id, v.* FROM conv v JOIN ifp i USING (pose_key)) GROUP BY 1),
cond AS (SELECT a.condition_id, a.protein_id, a.n_generated, a.n_pass, a.n_fail, a.hard_fail_rate, a.reasons, {', '.join(f"CASE WHEN f.f IS NULL THEN 0 ELSE f.f.{c} END AS {c}" if c.startswith('n_') else f"f.f.{c} AS {c}" for c in _FIRST)},
  g.convergence_fraction, g.median_ligand_rmsd, c.* EXCLUDE (condition_id), coalesce(k.n_cluster_rows, 0) AS n_cluster_rows, k.* EXCLUDE (condition_id, n_cluster_rows)
  FROM att a LEFT JOIN frst f USING (condition_id) LEFT JOIN cvg g USING (condition_id) LEFT JOIN conf c USING (condition_id) LEFT JOIN agg k USING (condition_id))"""


def _conditions(spark, d):
    with sharing(spark):
        return _condition_rows(spark, d)


def _condition_rows(spark, d):
    summary = table(spark, d, "condition_cluster_summary")
    conv = _convergence(spark, d).join(_ifp(spark, d).select("pose_key", "condition_id"), "pose_key")
    converged = conv.groupBy("condition_id").agg((F.count_if("convergent") / F.count("*")).alias("convergence_fraction"), F.round(F.median("rmsd") + HAIR, 6).alias("median_ligand_rmsd"))
    return C.condition_table(_attrition(spark, d), "condition_id", [(summary, _FIRST, ["reported_at"])], [converged, a2_confidence(spark, d), a3_weighted(spark, d)])


@query(_TABLE + " SELECT * FROM cond")
def j1_condition_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per condition of the quality control, from five further tables."""
    return _conditions(spark, d)


_PARTS = r"regexp_extract(condition_id, '^([^_]+)_([A-Z]+)(\d+)_(.+)$', {0})"
_MEANS = ["noise_fraction", "n_clusters", "top_cluster_occupancy", "cluster_entropy", "contact_eligible_fraction", "vdw_only_fraction", "convergence_fraction", "median_ligand_rmsd", "mean_angle", "mean_contacts", "mean_c1", "mean_c4", "mean_rmsd", "occupancy_weighted_c1_median", "occupancy_weighted_c4_median", "occupancy_weighted_c1_geometry_plausible_fraction", "occupancy_weighted_c4_geometry_plausible_fraction", "occupancy_weighted_convergent_fraction", "cluster_total_occupancy", "mean_cluster_size"]


@query(_TABLE + f""", named AS (SELECT *, {_PARTS.format(2)} AS substrate, {_PARTS.format(4)} AS construct, {_PARTS.format(3)} AS dp FROM cond)
SELECT protein_id, count(*) AS n_conditions, count(DISTINCT nullif(substrate, '')) AS n_substrates, array_to_string(list_sort(list(DISTINCT nullif(substrate, ''))), ',') AS substrates, count(DISTINCT nullif(construct, '')) AS n_constructs, array_to_string(list_sort(list(DISTINCT nullif(construct, ''))), ',') AS constructs,
  count(DISTINCT nullif(dp, '')) AS n_lengths, CAST(sum(n_generated) AS BIGINT) AS n_generated, CAST(sum(n_pass) AS BIGINT) AS n_pass, CAST(sum(n_fail) AS BIGINT) AS n_fail, count(*) FILTER (n_ifp_success > 0) AS n_conditions_with_ifp_success, count(*) FILTER (n_clusters > 0) AS n_conditions_with_clusters,
  {', '.join(f"round(avg({c}) + 1e-9, 5) AS rollup_{c}" for c in _MEANS)}, sum(n_fail) / sum(n_generated) AS hard_fail_rate FROM named GROUP BY 1""")
def a4_protein_rollup(spark: SparkSession, d: str) -> DataFrame:
    from fjordmill.plans.classify import COND

    part = lambda i: F.regexp_extract("condition_id", COND, i)
    named = _conditions(spark, d).withColumns({"substrate": part(2), "construct": part(4), "dp": part(3)})
    got = C.protein_rollup(named, "protein_id", sets={"substrates": "substrate", "constructs": "construct"}, distinct={"n_lengths": "dp"}, sums=["n_generated", "n_pass", "n_fail"], positive={"n_conditions_with_ifp_success": "n_ifp_success", "n_conditions_with_clusters": "n_clusters"}, means={f"rollup_{c}": c for c in _MEANS})
    return got.select(*(F.round(F.col(c) + HAIR, 5).alias(c) if c.startswith("rollup_") else F.col(c) for c in got.columns))


@query(_BASE + """e AS (SELECT a.condition_id, a.cluster_id, l.eligibility FROM assign a JOIN elig l USING (pose_key)),
s AS (SELECT condition_id, cluster_id, count(*) AS n FROM e WHERE coalesce(cluster_id, -1) <> -1 GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY condition_id) AS p, row_number() OVER (PARTITION BY condition_id ORDER BY n) AS r FROM s),
k AS (SELECT condition_id, count(*) AS n_clusters, max(p) AS top_cluster_occupancy, round(-sum(p * log2(p)) + 1e-9, 6) AS cluster_entropy, round(2 * sum(r * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) + 1e-9, 6) AS occupancy_gini FROM t GROUP BY 1)
SELECT e.condition_id, count(*) AS n_ifp_clustered, count(*) FILTER (coalesce(cluster_id, -1) = -1) AS n_noise, count(*) FILTER (coalesce(cluster_id, -1) = -1) / count(*) AS noise_fraction, """ + ", ".join(f"count(*) FILTER (eligibility = '{k}') / count(*) AS {n}" for k, n in (("eligible", "contact_eligible_fraction"), ("null_ifp", "null_ifp_fraction"), ("vdw_only", "vdw_only_fraction"), ("low_specific_contact", "low_specific_contact_fraction"))) + """,
  coalesce(any_value(k.n_clusters), 0) AS n_clusters, any_value(k.top_cluster_occupancy) AS top_cluster_occupancy, any_value(k.cluster_entropy) AS cluster_entropy, any_value(k.occupancy_gini) AS occupancy_gini FROM e LEFT JOIN k USING (condition_id) GROUP BY e.condition_id""")
def a12_entropy_gini(spark: SparkSession, d: str) -> DataFrame:
    rows = _assignments(spark, d).join(_ifp(spark, d).select("pose_key", "eligibility"), "pose_key")
    got = C.cluster_summary(rows, "condition_id", "cluster_id", "eligibility")
    return got.withColumns({c: F.round(F.col(c) + HAIR, 6) for c in ("cluster_entropy", "occupancy_gini")})


_RESIDUES = _SIGNATURES + f""", lab AS (SELECT DISTINCT l.pose_key, i.condition_id, residue_name, residue_number, residue_chain FROM {_LABELS} l JOIN ifp i USING (pose_key)),
freq AS (SELECT a.condition_id, a.cluster_id, l.residue_name, l.residue_number, l.residue_chain, count(*) / any_value(s.n_poses) AS frequency, any_value(s.occupancy) AS occupancy, any_value(s.c1_geometry_plausible_fraction) AS f1, any_value(s.c4_geometry_plausible_fraction) AS f4
  FROM assign a JOIN lab l USING (pose_key) JOIN sigs s ON s.condition_id = a.condition_id AND s.cluster_id = a.cluster_id GROUP BY ALL),
score AS (SELECT condition_id, residue_name, residue_number, residue_chain, sum(occupancy * frequency) AS s, sum(occupancy * frequency * f1) AS s1, sum(occupancy * frequency * f4) AS s4, count(*) AS n, sum(occupancy) AS o, max(frequency) AS m FROM freq GROUP BY ALL
  UNION ALL SELECT DISTINCT condition_id, residue_name, residue_number, residue_chain, 0, 0, 0, 0, 0, 0 FROM lab WHERE condition_id NOT IN (SELECT condition_id FROM sigs))"""


def _residues(spark, d):
    """(frequency rows, clusters, observed contacts), all with the flag of a catalytic residue."""
    clusters = _signatures(spark, d)
    lab = _labels(spark, d).select("pose_key", "residue_name", "residue_number", "residue_chain").distinct().withColumn("is_catalytic", F.col("residue_number").isin(1, 86, 175))
    res = ["residue_name", "residue_number", "residue_chain"]
    own = _assignments(spark, d).where("cluster_id >= 0")
    hits = own.join(lab, "pose_key").groupBy("condition_id", "cluster_id", *res, "is_catalytic").agg(F.count("*").alias("h"))
    rows = hits.join(clusters.select("condition_id", "cluster_id", "n_poses"), ["condition_id", "cluster_id"]).withColumn("frequency", F.col("h") / F.col("n_poses")).drop("n_poses")
    observed = lab.join(_ifp(spark, d).select("pose_key", "condition_id"), "pose_key").withColumn("contact_present", F.lit(True))
    return rows, clusters, observed, res


@query(_RESIDUES + """ SELECT condition_id, residue_name, residue_number, residue_chain, round(s + 1e-9, 6) AS residue_contact_score, round(s1 + 1e-9, 6) AS c1_weighted_residue_score, round(s4 + 1e-9, 6) AS c4_weighted_residue_score, CAST(n AS BIGINT) AS cluster_support_count, round(o + 1e-9, 6) AS total_cluster_occupancy_with_contact, m AS max_cluster_residue_frequency,
  residue_number IN (1, 86, 175) AS is_catalytic, round(s1 - s4 + 1e-9, 5) AS c1_minus_c4_weighted_delta FROM score""")
def a8_residue_importance(spark: SparkSession, d: str) -> DataFrame:
    with sharing(spark):
        rows, clusters, observed, res = _residues(spark, d)
    got = G.residue_importance(rows, clusters, observed, condition="condition_id", cluster="cluster_id", residue=res, frequency="frequency", c1="c1_geometry_plausible_fraction", c4="c4_geometry_plausible_fraction", flags=["is_catalytic"])
    six = ("residue_contact_score", "c1_weighted_residue_score", "c4_weighted_residue_score", "total_cluster_occupancy_with_contact")
    return got.withColumns({**{c: F.round(F.col(c) + HAIR, 6) for c in six}, "c1_minus_c4_weighted_delta": F.round(F.col("c1_minus_c4_weighted_delta") + HAIR, 5)})


_REGIONS = {"catalytic_surface_contact_fraction": "residue_number IN (1, 86, 175)", "non_core_contact_fraction": "residue_number > 220", "cbm_contact_fraction": "residue_number > 300", "linker_contact_fraction": "residue_number BETWEEN 221 AND 300"}


@query(_RESIDUES + """, w AS (SELECT condition_id, residue_name, residue_number, occupancy * frequency AS v FROM freq), t AS (SELECT condition_id, sum(v) AS total, sum(v) FILTER (residue_name IN ('PHE', 'TRP', 'TYR', 'HIS')) AS a, sum(v) FILTER (residue_name IN ('SER', 'THR', 'ASN', 'GLN', 'CYS')) AS p, sum(v) FILTER (residue_name IN ('ASP', 'GLU', 'LYS', 'ARG')) AS c, """
    + ", ".join(f"sum(v) FILTER ({rule}) AS r{i}" for i, rule in enumerate(_REGIONS.values())) + """ FROM w GROUP BY 1)
SELECT i.condition_id, round(coalesce(total, 0) + 1e-9, 6) AS weighted_contact_feature_mass, round(coalesce(a / total, 0) + 1e-9, 6) AS aromatic_contact_fraction, round(coalesce(p / total, 0) + 1e-9, 6) AS polar_contact_fraction, round(coalesce(c / total, 0) + 1e-9, 6) AS charged_contact_fraction, """
    + ", ".join(f"round(coalesce(r{i} / total, 0) + 1e-9, 6) AS {n}" for i, n in enumerate(_REGIONS)) + " FROM (SELECT DISTINCT condition_id FROM ifp) i LEFT JOIN t USING (condition_id)")
def a9_patch_fractions(spark: SparkSession, d: str) -> DataFrame:
    with sharing(spark):
        rows, clusters, observed, res = _residues(spark, d)
    mass = rows.join(clusters.select("condition_id", "cluster_id", "occupancy"), ["condition_id", "cluster_id"]).withColumn("w", F.col("occupancy") * F.col("frequency"))
    kinds = {**G.residue_kinds(F.col("residue_name")), **{n: F.expr(rule) for n, rule in _REGIONS.items()}}
    got = G.patches(mass, ["condition_id"], "w", kinds, _ifp(spark, d).select("condition_id"))
    return got.select("condition_id", *(F.round(F.col(c) + HAIR, 6).alias(c) for c in got.columns if c != "condition_id"))


# ---- families --------------------------------------------------------------------------------------------------

_FAM = "(SELECT DISTINCT upper(trim(uniprot_id)) AS protein_id, trim(family) AS family FROM oligo_active_updated WHERE trim(family) <> '')"


def _families(spark, d):
    trim = lambda c: F.regexp_replace(c, "^ +| +$", "")
    return table(spark, d, "oligo_active_updated").select(F.upper(trim("uniprot_id")).alias("protein_id"), trim("family").alias("family")).where("family <> ''").distinct()


@query(f"""WITH m AS (SELECT DISTINCT f.family, p.sequence_sha256 AS agg, p.sequence, p.protein_id FROM proteins p JOIN {_FAM} f USING (protein_id) WHERE p.sequence IS NOT NULL AND p.sequence_sha256 IS NOT NULL)
SELECT family, agg AS sequence_sha256, min(sequence) AS sequence, count(DISTINCT sequence) AS n_sequences, array_to_string(list_sort(list(DISTINCT protein_id)), ',') AS protein_ids FROM m GROUP BY family, agg""")
def a37_family_groups(spark: SparkSession, d: str) -> DataFrame:
    """Members of a family with one sequence as one group; where a group has several sequences it says so."""
    members = table(spark, d, "proteins").where("sequence is not null and sequence_sha256 is not null").join(_families(spark, d), "protein_id")
    return family.collapse(members, ["family", "sequence_sha256"], "sequence", {"protein_ids": "protein_id"}, on_conflict="report")


_ENRICH = f"""c AS (SELECT f.family, l.residue_name, l.residue_number, count(*) AS n FROM {_LABELS} l JOIN {_FAM} f USING (protein_id) GROUP BY ALL)"""


@query(f"""WITH {_ENRICH}, t AS (SELECT *, n / sum(n) OVER (PARTITION BY family) AS share FROM c), b AS (SELECT residue_name, residue_number, sum(n) / sum(sum(n)) OVER () AS base FROM c GROUP BY ALL),
k AS (SELECT family, residue_number, arg_max(residue_name, (n, [-ord(residue_name[1]), -ord(residue_name[2]), -ord(residue_name[3])])) AS consensus FROM c GROUP BY ALL)
SELECT t.family, t.residue_name, t.residue_number, t.n, round(100 * share + 1e-9, 6) AS share_percent, round(log2((share + 1e-9) / (base + 1e-9)) + 1e-9, 6) AS log2_enrichment, k.consensus FROM t JOIN b USING (residue_name, residue_number) JOIN k ON k.family = t.family AND k.residue_number = t.residue_number""")
def a40_enrichment(spark: SparkSession, d: str) -> DataFrame:
    c = _labels(spark, d).join(_families(spark, d), "protein_id").groupBy("family", "residue_name", "residue_number").agg(F.count("*").alias("n"))
    got = family.enrichment(c, "family", ["residue_name", "residue_number"], "n").join(family.consensus(c, ["family", "residue_number"], "residue_name", "n"), ["family", "residue_number"])
    return got.select("family", "residue_name", "residue_number", "n", F.round(F.col("share_percent") + HAIR, 6).alias("share_percent"), F.round(F.col("log2_enrichment") + HAIR, 6).alias("log2_enrichment"), "consensus")


@query(f"""WITH al AS (SELECT f.family, l.protein_id, l.residue_number, min(l.residue_name) AS residue_name FROM {_LABELS} l JOIN {_FAM} f USING (protein_id) WHERE residue_chain = 'A' GROUP BY ALL), alc AS (SELECT *, row_number() OVER (PARTITION BY family, protein_id ORDER BY residue_number) AS alignment_column FROM al),
sc AS (SELECT protein_id, residue_number, count(*) AS contacts FROM {_LABELS} WHERE residue_chain = 'A' AND residue_number <= 220 GROUP BY ALL), rg AS (SELECT protein_id, round(avg(c1 - c4) + 1e-9, 6) AS delta FROM (SELECT protein_id, min_cu_c1 AS c1, min_cu_c4 AS c4 FROM geometry_result WHERE isfinite(min_cu_c1) AND isfinite(min_cu_c4)) GROUP BY 1)
SELECT al.family, al.alignment_column, count(*) AS n_proteins, CAST(coalesce(sum(contacts), 0) AS BIGINT) AS contacts, round(avg(delta) + 1e-9, 5) AS mean_delta FROM alc al LEFT JOIN sc USING (protein_id, residue_number) LEFT JOIN rg USING (protein_id) WHERE contacts IS NOT NULL OR delta IS NOT NULL GROUP BY ALL""")
def j4_aligned_scores(spark: SparkSession, d: str) -> DataFrame:
    """Alignment rows with condition scores and regioselectivity; rows that have neither are dropped."""
    lab = _labels(spark, d).where("residue_chain = 'A'")
    rows = lab.join(_families(spark, d), "protein_id").groupBy("family", "protein_id", "residue_number").agg(F.min("residue_name").alias("residue_name"))
    rows = rows.withColumn("alignment_column", F.row_number().over(Window.partitionBy("family", "protein_id").orderBy("residue_number")))
    scores = lab.where("residue_number <= 220").groupBy("protein_id", "residue_number").agg(F.count("*").alias("contacts"))
    regio = table(spark, d, "geometry_result").where(finite("min_cu_c1") & finite("min_cu_c4")).groupBy("protein_id").agg(F.round(F.avg(F.col("min_cu_c1") - F.col("min_cu_c4")) + HAIR, 6).alias("delta"))
    told = family.aligned(rows, [(scores, ["protein_id", "residue_number"]), (regio, ["protein_id"])], ["contacts", "delta"])
    return told.groupBy("family", "alignment_column").agg(F.count("*").alias("n_proteins"), F.coalesce(F.sum("contacts"), F.lit(0)).alias("contacts"), F.round(F.avg("delta") + HAIR, 5).alias("mean_delta"))
