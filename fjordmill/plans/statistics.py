"""Statistics, clustering and cross-validation over the test tables (survey groups Q and M)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordmill.operators import learning as L
from fjordmill.operators import statistics as Q
from fjordmill.plans.classify import _poses, P
from fjordmill.plans.combine import _pairs, _PAIR
from fjordmill.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cv(spark, d):
    return table(spark, d, "cv_prediction")


@query("SELECT model_name, count(*) FILTER (y_true = 1) AS n1, count(*) FILTER (y_true = 0) AS n0 FROM cv_prediction WHERE y_score IS NOT NULL AND y_true IN (0, 1) GROUP BY 1")
def q0_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.two_sample(_cv(spark, d), "y_score", "y_true", ["model_name"]).select("model_name", "n1", "n0")


_AUC = """WITH s AS (SELECT model_name, target_column, y_true, rank() OVER w + (count(*) OVER (PARTITION BY model_name, target_column, y_score) - 1) / 2.0 AS r FROM cv_prediction WHERE y_score IS NOT NULL AND y_true IN (0, 1) WINDOW w AS (PARTITION BY model_name, target_column ORDER BY y_score)),
a AS (SELECT model_name, target_column, count(*) FILTER (y_true = 1) AS n1, count(*) FILTER (y_true = 0) AS n0, sum(r) FILTER (y_true = 1) AS r1 FROM s GROUP BY ALL)"""


@query(_AUC + " SELECT model_name, target_column, round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) - 1, 9) AS cliffs_delta FROM a")
def q4_cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    return Q.two_sample(_cv(spark, d), "y_score", "y_true", ["model_name", "target_column"]).select("model_name", "target_column", F.round("cliffs_delta", 9).alias("cliffs_delta"))


@query(_AUC + """, t AS (SELECT model_name, target_column, y_score, sum(y_true) AS p, count(*) AS n FROM cv_prediction WHERE y_score IS NOT NULL AND y_true IN (0, 1) GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM t WINDOW w AS (PARTITION BY model_name, target_column ORDER BY y_score DESC)), ap AS (SELECT model_name, target_column, sum(p * tp / al) / sum(p) AS average_precision FROM c GROUP BY ALL)
SELECT model_name, target_column, round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9) AS roc_auc, round(average_precision, 9) AS average_precision FROM a JOIN ap USING (model_name, target_column)""")
def q6_auc(spark: SparkSession, d: str) -> DataFrame:
    df, g = _cv(spark, d).where(F.col("y_true").isin(0, 1)), ["model_name", "target_column"]
    both = Q.two_sample(df, "y_score", "y_true", g).join(Q.average_precision(df, "y_score", "y_true", g), g)
    return both.select(*g, F.round("auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


@query("""WITH s AS (SELECT p_type, p_brand, p_size, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 AS r FROM part),
n AS (SELECT p_type, count(*) AS n FROM s GROUP BY 1), t AS (SELECT p_type, sum(CAST(k AS DOUBLE) ** 3 - k) AS t FROM (SELECT p_type, p_size, count(*) AS k FROM s GROUP BY ALL) GROUP BY 1), q AS (SELECT p_type, sum(s * s / k) AS q FROM (SELECT p_type, p_brand, sum(r) AS s, count(*) AS k FROM s GROUP BY ALL) GROUP BY 1)
SELECT p_type, round((12.0 / (n.n * (n.n + 1.0)) * q - 3 * (n.n + 1)) / (1 - t / (CAST(n.n AS DOUBLE) ** 3 - n.n)), 6) AS h FROM n JOIN t USING (p_type) JOIN q USING (p_type)""")
def q7_kruskal(spark: SparkSession, d: str) -> DataFrame:
    return Q.kruskal(table(spark, d, "part"), "p_size", "p_brand", ["p_type"]).withColumn("h", F.round("h", 6))


@query(f"""WITH p AS (SELECT substrate, right_m - left_m AS x FROM {_PAIR} WHERE right_m <> left_m), r AS (SELECT substrate, sign(x) AS s, rank() OVER (PARTITION BY substrate ORDER BY abs(x)) + (count(*) OVER (PARTITION BY substrate, abs(x)) - 1) / 2.0 AS r FROM p)
SELECT substrate, count(*) AS n, round(sum(s * r) / sum(r), 9) AS effect FROM r GROUP BY 1""")
def q2_rank_biserial(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("x", F.col("right_m") - F.col("left_m"))
    return Q.rank_biserial(p, "x", ["substrate"]).withColumn("effect", F.round("effect", 9))


@query("""WITH s AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer)
SELECT a.g AS a, b.g AS b, round(avg(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END), 9) AS auc FROM s a JOIN s b ON a.g <> b.g GROUP BY ALL""")
def q8_pairwise_auc(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    names = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())  # the segments, a catalogue
    return Q.pairwise_auc(c, "c_acctbal", "c_mktsegment", names).withColumn("auc", F.round("auc", 9))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def q12_linear_fit(spark: SparkSession, d: str) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"))


@query()
def q1_q3_paired_tests(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("x", F.col("right_m") - F.col("left_m"))
    return Q.paired_tests(p, "x", ["substrate"])


@query()
def q5_permutation(spark: SparkSession, d: str) -> DataFrame:
    c = _cv(spark, d).groupBy("model_name", "prediction_id").agg(F.max("y_score").alias("x"), F.max("y_true").alias("y"))
    return Q.permutation_tests(c, "x", "y", ["model_name"], permutations=10_000)


@query()
def q9_anova(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(Q.two_way_anova(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus"))


@query(f"""SELECT protein_id, substrate, round(avg(n_non_vdw_interactions), 6) AS contacts, round(avg(CASE WHEN isfinite(min_cu_c1) THEN min_cu_c1 END), 6) AS c1, CAST(max(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS label FROM {P} GROUP BY ALL""")
def a23_modeling_rows(spark: SparkSession, d: str) -> DataFrame:
    return _model_rows(spark, d).select("protein_id", "substrate", F.round("contacts", 6).alias("contacts"), F.round("c1", 6).alias("c1"), "label")


def _model_rows(spark, d):
    from fjordmill.plans.classify import finite

    x = F.when(finite("min_cu_c1"), F.col("min_cu_c1"))
    return _poses(spark, d).groupBy("protein_id", "substrate").agg(F.avg("n_non_vdw_interactions").alias("contacts"), F.avg(x).alias("c1"), F.max(F.when(F.col("passed"), 1).otherwise(0)).cast("bigint").alias("label"))


def _bit_groups(spark, d):
    e = table(spark, d, "embeddings").withColumn("bits", F.transform("embedding", lambda x: F.when(x > 0.1, 1).otherwise(0)))
    return e.select("label", "vec_id", "bits").withColumnRenamed("label", "grp")


@query()
def m1_density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.cluster_groups(_bit_groups(spark, d), "grp", "vec_id", "bits", "density", min_size=5)


@query()
def m2_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    return L.cluster_groups(_bit_groups(spark, d), "grp", "vec_id", "bits", "average", threshold=0.75, least=3)


@query()
def m3_cluster_tables(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, medoids and noise per group of the average-linkage clusters."""
    c = L.cluster_groups(_bit_groups(spark, d), "grp", "vec_id", "bits", "average", threshold=0.75, least=3)
    return c.groupBy("grp", "label").agg(F.count("*").alias("n"), F.first("medoid").alias("medoid"), F.round(F.sum("distance"), 6).alias("distance_sum"))


@query()
def m4_grouped_cv(spark: SparkSession, d: str) -> DataFrame:
    c = _cv(spark, d).withColumn("x2", F.col("y_score") * F.col("y_score"))
    once = c.groupBy("prediction_id").agg(*(F.max(k).alias(k) for k in ("run_id", "protein_id", "y_score", "x2")), F.max("y_true").cast("bigint").alias("y"))
    scored = L.grouped_cv(once, "run_id", "prediction_id", "protein_id", ["y_score", "x2"], "y")
    return scored.withColumnRenamed("y_score", "oof_score")


@query()
def m4_fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of m4_grouped_cv per run and fold, and their mean and deviation over the folds of the run."""
    return L.fold_metrics(m4_grouped_cv(spark, d), "run_id", "prediction_id", "y_true", "oof_score")


def _baseline(spark, d, kind):
    features = ["contacts", "c1"]
    told = L.baseline_cv(_model_rows(spark, d), "protein_id", features, "label", kind=kind)
    per = told.where("prediction is not null").groupBy("fold").agg(L.balanced_accuracy("label", "prediction").alias("fold_score"), *(F.first(F.col("importances")[i]).alias(f"importance_{c}") for i, c in enumerate(features)))
    every = Window.partitionBy()  # one row per fold
    per = per.select("*", F.avg("fold_score").over(every).alias("mean_score"), F.stddev_pop("fold_score").over(every).alias("std_score"), *(F.avg(f"importance_{c}").over(every).alias(f"mean_importance_{c}") for c in features))
    return told.select("protein_id", "substrate", F.col("label").cast("double").alias("label"), "fold", "prediction", "probability").join(F.broadcast(per), "fold", "left")


@query()
def m5_tree_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Trees of depth 3 on the modeling rows, trained in the cluster: each row as judged by the tree of the fold that
    holds its protein out, with the fold's balanced accuracy and importances, and their mean over the folds."""
    return _baseline(spark, d, "tree")


@query()
def m5_logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    """As m5_tree_baseline, with balanced logistic regressions and the sizes of their coefficients."""
    return _baseline(spark, d, "logistic")


@query("""SELECT 'y_score' AS field, count(*) FILTER (y_score IS NULL) AS n_null, count(*) FILTER (NOT coalesce(y_score BETWEEN 0 AND 1, true)) AS n_bad FROM cv_prediction UNION ALL SELECT 'y_true', count(*) FILTER (y_true IS NULL), count(*) FILTER (y_true NOT IN (0, 1)) FROM cv_prediction""")
def m6_validation(spark: SparkSession, d: str) -> DataFrame:
    c = _cv(spark, d)
    one = c.agg(F.count_if(F.col("y_score").isNull()).alias("n_null"), F.count_if(~F.coalesce(F.col("y_score").between(0, 1), F.lit(True))).alias("n_bad")).select(F.lit("y_score").alias("field"), "n_null", "n_bad")
    two = c.agg(F.count_if(F.col("y_true").isNull()).alias("n_null"), F.count_if(~F.col("y_true").isin(0, 1)).alias("n_bad")).select(F.lit("y_true").alias("field"), "n_null", "n_bad")
    return one.unionByName(two)


def _folds(spark, d):
    return L.balanced_folds(_cv(spark, d), "run_id", "protein_id", "y_true")


@query()
def w8_balanced_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d)


@query("""SELECT run_id, count(DISTINCT protein_id) AS n_units, 0 AS n_in_several_folds, least(5, count(DISTINCT protein_id)) AS n_folds FROM cv_prediction WHERE protein_id IS NOT NULL AND y_true IS NOT NULL AND run_id IS NOT NULL GROUP BY 1""")
def w8_fold_faults(spark: SparkSession, d: str) -> DataFrame:
    """Units per run, units that stand in several folds, and the number of folds."""
    per = _folds(spark, d).where("run_id is not null").groupBy("run_id", "protein_id").agg(F.countDistinct("fold").alias("k"), F.min("fold").alias("fold"))
    return per.groupBy("run_id").agg(F.count("*").alias("n_units"), F.count_if(F.col("k") > 1).alias("n_in_several_folds"), F.countDistinct("fold").alias("n_folds"))


@query("""SELECT run_id, fold_id, len(test_protein_ids) AS n_test, len(list_intersect(list_distinct(train_protein_ids), list_distinct(test_protein_ids))) AS n_leaked FROM cv_fold""")
def m7_fold_leakage(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.size(c).cast("bigint")
    return table(spark, d, "cv_fold").select("run_id", "fold_id", n("test_protein_ids").alias("n_test"), n(F.array_intersect("train_protein_ids", "test_protein_ids")).alias("n_leaked"))


@query()
def e14_kabsch(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of each embedding, read as 32 points of two coordinates, from the first of its label, after the best
    rotation."""

    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))

    @F.pandas_udf("double")
    def deviation(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([L.kabsch_rmsd(np.asarray(x, float).reshape(-1, 2), np.asarray(y, float).reshape(-1, 2)) for x, y in zip(a, b)])

    return e.join(first, "label").select("vec_id", "label", deviation("embedding", "ref").alias("rmsd"))


@query("""WITH l AS (SELECT l_shipmonth, l_suppkey, count(*) AS n FROM (SELECT date_trunc('month', l_shipdate) AS l_shipmonth, l_suppkey FROM lineitem) GROUP BY ALL) SELECT CAST(l_shipmonth AS DATE) AS month, l_suppkey, n, n / sum(n) OVER (PARTITION BY l_shipmonth) AS share FROM l""")
def a39_shares(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month"), "l_suppkey").agg(F.count("*").alias("n"))
    return l.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("month")))
