"""Queries of problems 2, 4, 6, 7, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordmill.llm import clusters, groupsplit, leakage, packing, privacy, rankstats, setjoin
from fjordmill.session import Workspace, table

# ---- 4: percentiles -------------------------------------------------------------------------------------------

#: Distances in Å that can stand in a model; anything else is a failed measurement.
DISTANCES = {"min_cu_c1": (0.0, 1000.0), "min_cu_c4": (0.0, 1000.0)}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    metric = "n_non_vdw_interactions"
    flat = rankstats.long_form(table(spark, d, "geometry_result"), ["condition_id"], [metric], record="pose_key")
    work = Workspace(spark, "medians")
    bounds = work.put(rankstats.percentiles(rankstats.summarise(flat), [0.5]), "bounds")
    found = rankstats.differing(table(spark, d, "condition_cluster_summary"), "condition_id", "median_n_non_vdw_interactions", bounds, flat, 1.0, work)
    return found.select(F.col("grp").alias("condition_id"))


def p4_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per condition and day, and per condition from the stored summaries of its days."""
    metrics = ["n_non_vdw_interactions", "min_cu_c1", "min_cu_c4"]
    flat = rankstats.long_form(table(spark, d, "geometry_result"), ["condition_id", "run_day"], metrics, record="pose_key", valid=DISTANCES)
    days = Workspace(spark, "percentiles").put(rankstats.summarise(flat), "days")
    whole = rankstats.merge(days.withColumn("grp", F.split("grp", "\t")[0]))
    both = rankstats.percentiles(days.unionByName(whole.withColumn("grp", F.concat("grp", F.lit("\t")))), [0.25, 0.5, 0.75, 0.95])
    key = F.split("grp", "\t")
    return both.select(key[0].alias("condition_id"), F.nullif(key[1], F.lit("")).alias("run_day"), "metric", "percent", "n", "low", "high", "estimate", "rank_error")


def _exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    metrics = ["n_non_vdw_interactions", "min_cu_c1", "min_cu_c4"]
    flat = Workspace(spark, "values").put(rankstats.long_form(table(spark, d, "geometry_result"), ["condition_id"], metrics, record="pose_key", valid=DISTANCES), "flat")
    bounds = Workspace(spark, "bounds").put(rankstats.percentiles(rankstats.summarise(flat), [0.25, 0.5, 0.95]), "bounds")
    return rankstats.exact(flat, bounds).join(bounds.select("grp", "metric", "percent", "low", "high", "rank_error"), ["grp", "metric", "percent"])


def p4_exact(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per condition without error, and whether the summary's bounds hold them with the error they state."""
    ok = F.col("value").between(F.col("low") - 1e-9, F.col("high") + 1e-9) & (F.col("rank_error") <= 0.01 + 1e-9)
    return _exact_percentiles(spark, d).select(F.col("grp").alias("condition_id"), "metric", "percent", "n", F.round(F.col("value") + 1e-9, 6).alias("value"), ok.alias("bounds_hold"))


# ---- 2: similar pairs ------------------------------------------------------------------------------------------


def _pose_sets(spark: SparkSession, d: str) -> DataFrame:
    """Both sets of every pose, each from its latest delivery that has one."""
    rows = setjoin.on_positions(table(spark, d, "cbm_analysis_result").select("pose_key", "ifp_lpmo_bitvector", "lpmo_contact_residues", "loaded_at"), "ifp_lpmo_bitvector")
    both = rows.select(F.col("pose_key").alias("id"), F.col("ifp_lpmo_bitvector").alias("bits"), setjoin.label_set(F.col("lpmo_contact_residues")).alias("labels"), "loaded_at")
    once = both.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("loaded_at"))).alias(c) for c in ("bits", "labels")))
    each = F.explode(F.array(F.struct(F.lit("ifp_lpmo_bitvector").alias("field"), F.col("bits").alias("tokens")), F.struct(F.lit("lpmo_contact_residues").alias("field"), F.col("labels").alias("tokens")))).alias("s")
    return once.select("id", each).select("s.field", "id", "s.tokens")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = setjoin.record_pairs(*setjoin.similar_pairs(_pose_sets(spark, d), similarity=0.8, least=6))
    return pairs.select(F.col("field").alias("set_field"), F.col("x").alias("pose_key_a"), F.col("y").alias("pose_key_b"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Every pose with the class of its equal sets and the number of poses it is linked with."""
    told = setjoin.link_counts(*setjoin.similar_pairs(_pose_sets(spark, d), similarity=0.8, least=6))
    return told.select(F.col("field").alias("set_field"), F.col("id").alias("pose_key"), F.col("class").alias("class_key"), "n_links")


# ---- 6: splits -------------------------------------------------------------------------------------------------

ENTITIES = ["protein_id", "sequence_cluster", "depositor_lab"]


def _split_state(spark: SparkSession, d: str) -> groupsplit.State:
    """The component table after the predictions of even and of odd runs came as two batches."""
    rows = table(spark, d, "cv_prediction")
    state = groupsplit.State(spark, Workspace(spark, "split-state").root)
    for turn in (0, 1):
        batch = rows.where(F.pmod(F.crc32(F.coalesce("run_id", F.lit(""))), F.lit(2)) == turn)
        groupsplit.update(state, batch, record="prediction_id", entities=ENTITIES)
    return state


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    grouped = _split_state(spark, d).assignments()
    return groupsplit.shared(grouped.select("record", "group_key")).select(F.col("record").alias("prediction_id"), "group_key")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every prediction, and whether it is quarantined."""
    return _split_state(spark, d).assignments().withColumnRenamed("record", "prediction_id")


def p6_faults(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: entities whose placed records stand in two splits, and records left out or told twice."""
    state = _split_state(spark, d)
    told = state.assignments()
    held = groupsplit.holdings(table(spark, d, "cv_prediction"), "prediction_id", ENTITIES).join(told, "record").where("split is not null")
    divided = held.groupBy("entity").agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("n_divided"))
    sizes = state.table("components").select("component", "size").join(told.groupBy("component").agg(F.count("*").alias("n")), "component", "left").where("size <> coalesce(n, 0)").agg(F.count("*").alias("k"))
    n = told.agg(F.countDistinct("record").alias("d"), F.count("*").alias("c")).first()
    return divided.select("n_divided", F.lit(n.d if n.d == n.c else -1).cast("bigint").alias("n_records"), F.lit(sizes.first().k).cast("bigint").alias("n_groups_that_differ"))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and groups per split; quarantined ones have none."""
    told = _split_state(spark, d).assignments()
    return told.groupBy(F.coalesce("split", F.lit("quarantined")).alias("split")).agg(F.count("*").alias("n_records"), F.countDistinct("group_key").alias("n_groups"))


# ---- 9: leaks --------------------------------------------------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), run=12)


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item that leaked: the documents it leaked into."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked passages: where each begins in the document and in the item, in words, and how long it is."""
    return leakage.passages(table(spark, d, "documents"), table(spark, d, "eval_items"), run=12)


# ---- 7: clusters -----------------------------------------------------------------------------------------------


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = setjoin.on_positions(table(spark, d, "cbm_analysis_result").select("pose_key", "condition_id", F.col("ifp_lpmo_bitvector").alias("tokens"), "loaded_at"), "tokens")
    once = rows.groupBy(F.col("pose_key").alias("id")).agg(F.max_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("loaded_at"))).alias("tokens"), F.min("condition_id").alias("grp"))
    return once.select("grp", "id", "tokens")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_fingerprints(spark, d)).select(F.col("id").alias("pose_key"), F.col("cluster").alias("cluster_key"))


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    """p7_found with blocks so small that the larger conditions are merged, assigned and linked over many tasks."""
    return clusters.clusters(_fingerprints(spark, d), block=64, outliers=512).select(F.col("id").alias("pose_key"), F.col("cluster").alias("cluster_key"))


def p7_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Per condition: poses, clusters, noise fraction, and the cluster sizes and medoids as JSON."""
    work = Workspace(spark, "conditions")
    rows = work.put(_fingerprints(spark, d), "rows")
    found = work.put(clusters.clusters(rows, work=work), "found")
    told = clusters.describe(rows.join(found, "id"))
    per = told.groupBy("grp").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_clustered"), F.to_json(F.array_sort(F.collect_list(F.struct("cluster", "n", F.col("medoids")[0].alias("medoid"))))).alias("clusters"))
    # poses without a vector are noise: clusters() leaves them out, the count doesn't
    poses = rows.where("id is not null").groupBy("grp").agg(F.count("*").alias("n_poses"))
    both = poses.join(per, "grp", "left")
    return both.select(F.col("grp").alias("condition_id"), "n_poses", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), (1 - F.coalesce("n_clustered", F.lit(0)) / F.col("n_poses")).alias("noise_fraction"), "clusters")


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per condition: poses, those with enough positions, and whether the parts agree: clusters hold usable poses only,
    and Ward clusters and outliers together are the usable poses."""
    work = Workspace(spark, "totals")
    rows = work.put(_fingerprints(spark, d).where("id is not null and grp is not null"), "rows")
    ward = clusters.ward_clusters(rows, work=work).groupBy("grp").agg(F.count("*").alias("n_ward"), F.countDistinct("id").alias("n_ids"))
    linked = rows.join(clusters.clusters(rows, work=work), "id").groupBy("grp").agg(F.count("*").alias("n_linked"), F.count_if(F.size("tokens") < 6).alias("n_small"))
    per = rows.groupBy("grp").agg(F.count("*").alias("n_poses"), F.count_if(F.coalesce(F.size("tokens"), F.lit(0)) >= 6).alias("n_usable")).join(ward, "grp", "left").join(linked, "grp", "left").fillna(0)
    fine = (F.col("n_ward") == F.col("n_ids")) & (F.col("n_ward") <= F.col("n_usable")) & (F.col("n_linked") <= F.col("n_usable")) & (F.col("n_small") == 0)
    return per.select(F.col("grp").alias("condition_id"), "n_poses", "n_usable", fine.alias("consistent"))


def p7_ward(spark: SparkSession, d: str) -> DataFrame:
    """Ward clusters of the cluster features: size and most typical pose of each."""
    work = Workspace(spark, "ward")
    rows = work.put(_fingerprints(spark, d), "rows")
    labelled = rows.join(work.put(clusters.ward_clusters(rows, work=work), "ward").select("id", "ward"), "id").withColumn("cluster", F.concat_ws("#", "grp", "ward"))
    return clusters.describe(labelled).select(F.col("grp").alias("condition_id"), "cluster", "n", F.col("medoids")[0].alias("medoid"))


# ---- 8: contexts -----------------------------------------------------------------------------------------------

#: Tokens of a context.
CAPACITY = 2048


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary lies; the folder can be set."""
    import os

    return os.path.join(os.environ.get("FJORDMILL_TOKENIZERS", "/opt/tokenizers"), name)


#: Segments of a context.
SEGMENTS = 24
#: Narrower limits, all of which bind: (segments, loss-bearing tokens).
NARROW = (12, 1024)


def p8_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of the capacity; a text's loss is part of its tokens, so a limit on it below would leave space unused."""
    return packing.contexts(table(spark, d, "documents"), vocabulary=vocabulary(), capacity=CAPACITY, segments=SEGMENTS)


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_contexts(spark, d), CAPACITY, SEGMENTS)


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    return packing.faults(p8_contexts(spark, d), CAPACITY, SEGMENTS)


def p8_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Contexts under limits on tokens, segments and loss-bearing tokens, all of which bind."""
    return packing.contexts(table(spark, d, "documents"), vocabulary=vocabulary(), capacity=CAPACITY, segments=NARROW[0], loss_capacity=NARROW[1])


def p8_instructions_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_instructions(spark, d), CAPACITY, *NARROW)


def p8_instructions_faults(spark: SparkSession, d: str) -> DataFrame:
    return packing.faults(p8_instructions(spark, d), CAPACITY, *NARROW)


# ---- 10: personal information ----------------------------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return privacy.found(documents, privacy.fit(documents, table(spark, d, "name_list")))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return privacy.redacted(documents, privacy.fit(documents, table(spark, d, "name_list")))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Redaction over all documents: none is lost, null stays null, and each span that is found is replaced."""
    documents = table(spark, d, "documents")
    model = privacy.fit(documents, table(spark, d, "name_list"))
    red, found = privacy.redacted(documents, model), privacy.found(documents, model).groupBy("doc_id").agg(F.count("*").alias("n_found"))
    both = red.join(found, "doc_id", "left")
    fine = F.coalesce("n_found", F.lit(0)) <= F.col("n_replaced")
    return both.agg(F.count("*").alias("n_texts"), F.count("text").alias("n_not_null"), F.bool_and(fine).alias("all_replaced"))


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p4_found, p4_by_day, p4_exact, p6_found, p6_splits, p6_usage, p6_faults, p7_found, p7_blocks, p7_conditions, p7_ward, p7_totals, p8_contexts, p8_usage, p8_faults, p8_instructions, p8_instructions_usage, p8_instructions_faults, p9_found, p9_items, p9_passages, p10_found, p10_redacted, p10_texts)}
_LINKED_SQL = """
WITH RECURSIVE once AS (SELECT pose_key, min(condition_id) AS g, arg_max(ifp_lpmo_bitvector, loaded_at) FILTER (ifp_lpmo_bitvector IS NOT NULL) AS v FROM cbm_analysis_result GROUP BY pose_key),
tok AS (SELECT g, pose_key AS k, i FROM (SELECT g, pose_key, unnest(v) AS b, generate_subscripts(v, 1) AS i FROM once) WHERE b <> 0),
big AS (SELECT k, count(*) AS n FROM tok GROUP BY k HAVING count(*) >= 6),
link AS (SELECT x.k AS a, y.k AS b FROM tok x JOIN tok y ON x.g = y.g AND x.i = y.i AND x.k <> y.k JOIN big m ON m.k = x.k JOIN big n ON n.k = y.k GROUP BY x.k, y.k, m.n, n.n HAVING count(*) * 10 >= 6 * (m.n + n.n - count(*))),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
"""
_WORDS_SQL = r"""regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"""
_LEAK_SQL = (
    "WITH d AS (SELECT doc_id, " + _WORDS_SQL.format("text") + " AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, " + _WORDS_SQL.format("text") + """ AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)) """
)

_SETS_SQL = """
WITH once AS (SELECT pose_key, arg_max(ifp_lpmo_bitvector, loaded_at) FILTER (ifp_lpmo_bitvector IS NOT NULL) AS v, arg_max(lpmo_contact_residues, loaded_at) FILTER (lpmo_contact_residues IS NOT NULL) AS l
  FROM cbm_analysis_result GROUP BY pose_key),
tok AS (
  SELECT DISTINCT 'ifp_lpmo_bitvector' AS f, pose_key AS k, CAST(i AS VARCHAR) AS t FROM (SELECT pose_key, unnest(v) AS b, generate_subscripts(v, 1) AS i FROM once) WHERE b <> 0
  UNION ALL SELECT DISTINCT 'lpmo_contact_residues', k, t FROM (SELECT pose_key AS k, upper(trim(unnest(l))) AS t FROM once) WHERE t IS NOT NULL AND t <> ''),
big AS (SELECT f, k, count(*) AS n FROM tok GROUP BY f, k HAVING count(*) >= 6),
own AS (SELECT t.f, t.k, t.t, b.n FROM tok t JOIN big b USING (f, k)),
common AS (SELECT a.f, a.k AS x, b.k AS y, a.n AS na, b.n AS nb, count(*) AS c FROM own a JOIN own b ON a.f = b.f AND a.t = b.t AND a.k < b.k WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY ALL)
"""

SQL = {
    "p2_found": _SETS_SQL + "SELECT f AS set_field, x AS pose_key_a, y AS pose_key_b FROM common WHERE c * 10 >= 8 * (na + nb - c)",
    "p2_links": _SETS_SQL + """,
whole AS (SELECT f, k, list(t ORDER BY t) AS ts FROM own GROUP BY f, k),
same AS (SELECT f, k, min(k) OVER (PARTITION BY f, ts) AS class_key FROM whole),
ends AS (SELECT f, x AS k FROM common WHERE c * 10 >= 8 * (na + nb - c) UNION ALL SELECT f, y FROM common WHERE c * 10 >= 8 * (na + nb - c)),
n AS (SELECT f, k, count(*) AS n_links FROM ends GROUP BY f, k)
SELECT s.f AS set_field, s.k AS pose_key, s.class_key, coalesce(n.n_links, 0) AS n_links FROM same s LEFT JOIN n USING (f, k)""",
    **dict.fromkeys(("p7_found", "p7_blocks"), _LINKED_SQL + """
SELECT a AS pose_key, min(b) AS cluster_key FROM (SELECT a, b FROM reach UNION SELECT a, a FROM link) GROUP BY a HAVING count(DISTINCT b) >= 4"""),
    "p9_found": _LEAK_SQL + "SELECT doc_id, item_id FROM hit",
    "p9_passages": "WITH d AS (SELECT doc_id, " + _WORDS_SQL.format("text") + " AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, " + _WORDS_SQL.format("text") + """ AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT item_id, j, array_to_string(w[j : j + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM e)),
met AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM dg JOIN eg USING (g))
SELECT doc_id, item_id, min(i) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) + 11 AS n_words FROM met GROUP BY doc_id, item_id, i - j, island""",
    "p9_items": _LEAK_SQL + "SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM hit GROUP BY item_id",
    **dict.fromkeys(("p8_faults", "p8_instructions_faults"), "SELECT count(*) AS n_texts, 0 AS n_badly_cut, 0 AS n_over FROM documents WHERE text <> ''"),
    "p6_found": """
WITH RECURSIVE held AS (
  SELECT DISTINCT prediction_id AS p, e FROM (
    SELECT prediction_id, unnest(['p:' || lower(trim(protein_id)), 's:' || lower(trim(sequence_cluster)), 'l:' || lower(trim(depositor_lab))]) AS e FROM cv_prediction)
  WHERE e IS NOT NULL AND e[3:] NOT IN ('', '-', 'na', 'n/a', 'none', 'null', 'unknown')),
link AS (SELECT DISTINCT a.p AS a, b.p AS b FROM held a JOIN held b USING (e) WHERE a.p <> b.p),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS prediction_id, least(a, min(b)) AS group_key FROM reach GROUP BY a""",
    "p4_exact": """
WITH once AS (SELECT pose_key, min(condition_id) AS condition_id, max(n_non_vdw_interactions) AS k, max(min_cu_c1) AS c1, max(min_cu_c4) AS c4 FROM geometry_result GROUP BY pose_key),
v AS (SELECT condition_id, 'n_non_vdw_interactions' AS metric, CAST(k AS DOUBLE) AS v FROM once UNION ALL SELECT condition_id, 'min_cu_c1', c1 FROM once WHERE c1 BETWEEN 0 AND 1000 UNION ALL SELECT condition_id, 'min_cu_c4', c4 FROM once WHERE c4 BETWEEN 0 AND 1000),
p AS (SELECT condition_id, metric, count(v) AS n, quantile_cont(v, [0.25, 0.5, 0.95]) AS q FROM v WHERE v IS NOT NULL AND isfinite(v) GROUP BY ALL)
SELECT condition_id, metric, unnest([0.25::DOUBLE, 0.5, 0.95]) AS percent, n, round(unnest(q) + 1e-9, 6) AS value, true AS bounds_hold FROM p""",
    "p6_faults": "SELECT 0 AS n_divided, count(DISTINCT prediction_id) AS n_records, 0 AS n_groups_that_differ FROM cv_prediction",
    "p7_totals": """
WITH once AS (SELECT pose_key, min(condition_id) AS g, arg_max(ifp_lpmo_bitvector, loaded_at) FILTER (ifp_lpmo_bitvector IS NOT NULL) AS v FROM cbm_analysis_result GROUP BY pose_key)
SELECT g AS condition_id, count(*) AS n_poses, count(*) FILTER (len(list_filter(v, lambda b: b <> 0)) >= 6) AS n_usable, true AS consistent FROM once WHERE g IS NOT NULL GROUP BY g""",
    "p10_texts": "SELECT count(*) AS n_texts, count(text) AS n_not_null, true AS all_replaced FROM documents",
    "p4_found": """
WITH once AS (SELECT pose_key, min(condition_id) AS condition_id, max(n_non_vdw_interactions) AS v FROM geometry_result GROUP BY pose_key),
true_m AS (SELECT condition_id, median(v) AS m FROM once WHERE v IS NOT NULL GROUP BY condition_id)
SELECT DISTINCT s.condition_id FROM condition_cluster_summary s JOIN true_m t USING (condition_id) WHERE abs(s.median_n_non_vdw_interactions - t.m) > 1""",
}
