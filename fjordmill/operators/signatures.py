"""What clusters consist of: summaries of their members, the residues they touch, and the patches these make up.

Rows are given in long form and columns by name. A member that has no row in a table that is joined stays a member: it
counts in the denominators and has no value. Sums are partial aggregates; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordmill.operators.conditions import number

#: Residues by the chemistry of their side chains.
AROMATIC = ("PHE", "TRP", "TYR", "HIS")
POLAR = ("SER", "THR", "ASN", "GLN", "CYS")
CHARGED = ("ASP", "GLU", "LYS", "ARG")


def _one(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key (the least of its rows)."""
    return rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in columns))


def member_table(assignments: DataFrame, pose: str, parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Members with the columns of each table, by left joins; ``has_N`` tells whether the N-th table has the pose."""
    out = assignments
    for i, (rows, columns) in enumerate(parts):
        out = out.join(_one(rows, pose, columns).withColumn(f"has_{i}", F.lit(True)), pose, "left")
    return out


def cluster_signatures(assignments: DataFrame, *, condition: str, cluster: str, pose: str, medoids: DataFrame, geometry: DataFrame, statuses: dict[str, dict[str, tuple[str, ...]]], geometry_fields: list[str], confidence: DataFrame, confidence_fields: list[str], convergence: DataFrame, rmsd: str, convergent: str, noise: int = -1) -> DataFrame:
    """One row per condition and cluster (noise left out): size, occupancy (share of the clustered poses), the share of
    members in each group of statuses, medians and interquartile ranges of the geometry, mean, median and the medoid's
    value of the confidence, and convergence.

    medoids: (condition, cluster, medoid). statuses: column -> {name of the share: statuses}.
    """
    columns = sorted({*statuses, *geometry_fields})
    told = member_table(assignments.where(F.coalesce(F.col(cluster), F.lit(noise)) != noise), pose, [(geometry, columns), (confidence, confidence_fields), (convergence, [rmsd, convergent])])
    told = told.join(medoids.select(condition, cluster, "medoid"), [condition, cluster], "left")
    is_medoid = F.col(pose) == F.col("medoid")
    aggs = [F.count("*").alias("n_poses"), F.first("medoid").alias("medoid")]
    for column, shares in statuses.items():
        aggs += [(F.count_if(F.coalesce(F.col(column).isin(*values), F.lit(False))) / F.count("*")).alias(name) for name, values in shares.items()]
    for f in geometry_fields:
        aggs += [F.median(number(f)).alias(f"{f}_median"), (F.percentile(number(f), 0.75) - F.percentile(number(f), 0.25)).alias(f"{f}_iqr")]
    for f in confidence_fields:
        aggs += [F.avg(number(f)).alias(f"mean_{f}"), F.median(number(f)).alias(f"median_{f}"), F.max(F.when(is_medoid, F.col(f))).alias(f"medoid_{f}")]
    aggs += [F.avg(number(rmsd)).alias(f"mean_{rmsd}"), F.median(number(rmsd)).alias(f"median_{rmsd}"), F.max(F.when(is_medoid, F.col(rmsd))).alias(f"medoid_{rmsd}")]
    # of the members that the convergence table has; null where it has none
    aggs += [(F.count_if(F.coalesce(F.col(convergent), F.lit(False))) / F.nullif(F.count("has_2"), F.lit(0))).alias("convergent_fraction")]
    out = told.groupBy(condition, cluster).agg(*aggs)
    total = out.groupBy(condition).agg(F.sum("n_poses").alias("_all"))
    return out.join(total, condition).withColumn("occupancy", F.col("n_poses") / F.col("_all")).drop("_all")


def residue_importance(signatures: DataFrame, clusters: DataFrame, observed: DataFrame, *, condition: str, cluster: str, residue: list[str], frequency: str, c1: str, c4: str, flags: list[str] = (), contact: str = "contact_present") -> DataFrame:
    """(condition, residue, scores): the sum of occupancy times frequency over a condition's clusters, weighted by the
    clusters' C1 and C4 shares too, with the number of clusters, their occupancy and the greatest frequency.

    signatures: a row per condition, cluster and residue with its frequency. clusters: occupancy and shares of the
    clusters. Residues that poses of a condition without any cluster touch come out with zeros (observed: rows with
    ``contact``); flags are true if they are in any row.
    """
    shares = clusters.select(condition, cluster, F.col("occupancy").alias("_o"), F.coalesce(F.col(c1), F.lit(0.0)).alias("_c1"), F.coalesce(F.col(c4), F.lit(0.0)).alias("_c4"))
    rows = signatures.where(F.col(cluster) >= 0).join(shares, [condition, cluster], "left")
    weight = F.coalesce(F.col("_o"), F.lit(0.0)) * F.coalesce(F.col(frequency), F.lit(0.0))
    own = lambda f: F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f)
    scores = rows.groupBy(condition, *residue).agg(
        F.sum(weight).alias("residue_contact_score"), F.sum(weight * F.coalesce("_c1", F.lit(0.0))).alias("c1_weighted_residue_score"), F.sum(weight * F.coalesce("_c4", F.lit(0.0))).alias("c4_weighted_residue_score"),
        F.count("*").alias("cluster_support_count"), F.sum(F.coalesce("_o", F.lit(0.0))).alias("total_cluster_occupancy_with_contact"), F.max(F.coalesce(F.col(frequency), F.lit(0.0))).alias("max_cluster_residue_frequency"), *(own(f) for f in flags),
    )
    seen = observed.where(F.coalesce(F.col(contact).cast("boolean"), F.lit(False))).join(clusters.select(condition).distinct(), condition, "left_anti")
    seen = seen.groupBy(condition, *residue).agg(F.lit(0).alias("_z"), *(own(f) for f in flags)).drop("_z").join(scores.select(condition, *residue), [condition, *residue], "left_anti")
    zeros = {"residue_contact_score": 0.0, "c1_weighted_residue_score": 0.0, "c4_weighted_residue_score": 0.0, "cluster_support_count": 0, "total_cluster_occupancy_with_contact": 0.0, "max_cluster_residue_frequency": 0.0}
    kinds = dict(scores.dtypes)
    filled = seen.select(condition, *residue, *(F.lit(v).cast(kinds[n]).alias(n) for n, v in zeros.items()), *flags)
    return scores.select(filled.columns).unionByName(filled).withColumn("c1_minus_c4_weighted_delta", F.col("c1_weighted_residue_score") - F.col("c4_weighted_residue_score"))


def patches(mass: DataFrame, key: list[str], weight: str, kinds: dict[str, Column], keys: DataFrame | None = None) -> DataFrame:
    """(key, weighted_contact_feature_mass, a share per kind): shares of the positive weight that falls on rows of a kind;
    0 where there is no weight. Kinds may overlap. Keys that have no row come from ``keys``."""
    rows = mass.where(F.col(weight) > 0)
    per = rows.groupBy(*key).agg(F.sum(weight).alias("weighted_contact_feature_mass"), *(F.sum(F.when(c, F.col(weight)).otherwise(0.0)).alias(n) for n, c in kinds.items()))
    out = keys.select(*key).distinct().join(per, key, "left") if keys is not None else per
    total = F.coalesce("weighted_contact_feature_mass", F.lit(0.0))
    return out.select(*key, total.alias("weighted_contact_feature_mass"), *(F.when(total > 0, F.col(n) / total).otherwise(0.0).alias(n) for n in kinds))


def residue_kinds(name: Column, interaction: Column | None = None, hbonds: tuple[str, ...] = ()) -> dict[str, Column]:
    """Shares by residue chemistry, and of hydrogen bonds where the interaction is known."""
    upper = F.upper(name)
    out = {"aromatic_contact_fraction": upper.isin(*AROMATIC), "polar_contact_fraction": upper.isin(*POLAR), "charged_contact_fraction": upper.isin(*CHARGED)}
    return {**out, "hbond_contact_fraction": interaction.isin(*hbonds)} if interaction is not None else out
