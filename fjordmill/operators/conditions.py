"""Condition tables: attrition, confidence, cluster aggregates, cluster summaries, and their roll-up per protein.

Every function takes DataFrames and column names and returns a DataFrame with one row per key. All of them are partial
aggregates followed by joins of one row per key; nothing is collected. Nulls: a mean, median or weighted mean is over
the values that are there and null where there are none; counts are 0; not-a-number counts as no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordmill.functions import scalars as S
from fjordmill.operators.relational import entropy, gini


def number(c: str | Column) -> Column:
    """A double; null for not-a-number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def attrition(poses: DataFrame, key: list[str], passed: Column, reasons: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, n_generated, n_pass, n_fail, hard_fail_rate, reasons, extra): counts, the share of failures (0 without rows)
    and the counts of the reasons that hold as JSON with sorted names; null where none holds."""
    ok = F.coalesce(passed, F.lit(False))
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in reasons.items())))
    per = poses.groupBy(*key).agg(F.count("*").alias("n_generated"), F.count_if(ok).alias("n_pass"), F.count_if(~ok).alias("n_fail"), *(c.alias(n) for n, c in (extra or {}).items()))
    each = poses.select(*key, F.explode(named).alias("_reason")).groupBy(*key, "_reason").agg(F.count("*").alias("_k"))
    told = each.groupBy(*key).agg(S.reason_map(F.struct("_reason", "_k")).alias("reasons"))
    return per.join(told, key, "left").withColumn("hard_fail_rate", S.safe_divide(F.col("n_fail"), F.col("n_generated"), 0.0))


def confidence(rows: DataFrame, key: list[str], fields: list[str], available: Column) -> DataFrame:
    """(key, n_confidence_rows, n_confidence_available, mean_F and median_F of every field)."""
    aggs = [F.count("*").alias("n_confidence_rows"), F.count_if(F.coalesce(available, F.lit(False))).alias("n_confidence_available")]
    for f in fields:
        aggs += [F.avg(number(f)).alias(f"mean_{f}"), F.median(number(f)).alias(f"median_{f}")]
    return rows.groupBy(*key).agg(*aggs)


def cluster_aggregates(clusters: DataFrame, key: list[str], fields: list[str], weight: str = "occupancy", size: str = "n_poses") -> DataFrame:
    """(key, n_cluster_rows, cluster_total_occupancy, mean_cluster_size, occupancy_weighted_F): means weighted by the
    occupancy over the rows that have the field, and plain means where these weigh nothing."""
    aggs = [F.count("*").alias("n_cluster_rows"), F.coalesce(F.sum(number(weight)), F.lit(0.0)).alias("cluster_total_occupancy"), F.avg(number(size)).alias("mean_cluster_size")]
    return clusters.groupBy(*key).agg(*aggs, *(S.weighted_mean(number(f), number(weight)).alias(f"occupancy_weighted_{f}") for f in fields))


def condition_table(master: DataFrame, key: str, first: list[tuple[DataFrame, list[str], list]], grouped: list[DataFrame]) -> DataFrame:
    """One row per master row: left joins of tables of which the first row of a key counts, (rows, columns, order), and
    of tables that have one row per key. Counts (columns that begin with n_) are 0 where there is no row, all else null;
    a row that is there keeps its nulls."""
    out = master
    for rows, columns, order in first:
        one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
        out = out.join(one, key, "left")
        out = out.select(*(c for c in out.columns if c != "_row"), *((F.when(F.col("_row").isNull(), F.lit(0)).otherwise(F.col("_row")[c]) if c.startswith("n_") else F.col("_row")[c]).alias(c) for c in columns))
    for rows in grouped:
        out = out.join(rows, key, "left").fillna(0, [c for c in rows.columns if c.startswith("n_")])
    return out


def protein_rollup(conditions: DataFrame, key: str, *, sets: dict[str, str], distinct: dict[str, str], sums: list[str], positive: dict[str, str], means: dict[str, str], failed: str = "n_fail", total: str = "n_generated") -> DataFrame:
    """(key, n_conditions, ...) over condition rows: sets and their sizes (name -> column), distinct counts, sums,
    numbers of conditions with a positive count, means, and the failure rate over all of them. Blanks are no value."""
    value = lambda c: S.blank_to_null(F.col(c).cast("string"))
    aggs = [F.count("*").alias("n_conditions")]
    for name, c in sets.items():
        aggs += [F.countDistinct(value(c)).alias(f"n_{name}"), S.sorted_join(value(c)).alias(name)]
    aggs += [F.countDistinct(value(c)).alias(name) for name, c in distinct.items()]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    aggs += [F.count_if(F.coalesce(F.col(c), F.lit(0)) > 0).alias(name) for name, c in positive.items()]
    aggs += [F.avg(number(c)).alias(name) for name, c in means.items()]
    return conditions.groupBy(key).agg(*aggs).withColumn("hard_fail_rate", S.safe_divide(F.col(failed), F.col(total), 0.0))


def cluster_summary(assignments: DataFrame, key: str, cluster: str, eligibility: str | None = None, noise: int = -1) -> DataFrame:
    """(key, n_ifp_clustered, n_noise, noise_fraction, n_clusters, top_cluster_occupancy, cluster_entropy,
    occupancy_gini and the share of each kind of eligibility) from one row per assigned record. Occupancy is the share of
    the clustered records; entropy is in bits."""
    is_noise = F.coalesce(F.col(cluster), F.lit(noise)) == noise
    aggs = [F.count("*").alias("n_ifp_clustered"), F.count_if(is_noise).alias("n_noise")]
    if eligibility:
        for kind, name in (("eligible", "contact_eligible_fraction"), ("null_ifp", "null_ifp_fraction"), ("vdw_only", "vdw_only_fraction"), ("low_specific_contact", "low_specific_contact_fraction")):
            aggs.append((F.count_if(F.col(eligibility) == kind) / F.count("*")).alias(name))
    per = assignments.groupBy(key).agg(*aggs).withColumn("noise_fraction", F.col("n_noise") / F.col("n_ifp_clustered"))
    sizes = assignments.where(~is_noise).groupBy(key, cluster).agg(F.count("*").alias("_n"))
    # the total of a key comes by a join of one row per key, not by a window over its clusters
    shares = sizes.join(per.select(key, (F.col("n_ifp_clustered") - F.col("n_noise")).alias("_all")), key).withColumn("_p", F.col("_n") / F.col("_all"))
    told = shares.groupBy(key).agg(F.count("*").alias("n_clusters"), F.max("_p").alias("top_cluster_occupancy"), entropy(F.col("_p")).alias("cluster_entropy"))
    out = per.join(told, key, "left").join(gini("_n", [key], sizes).withColumnRenamed("gini", "occupancy_gini"), key, "left")
    return out.fillna(0, ["n_clusters"])
