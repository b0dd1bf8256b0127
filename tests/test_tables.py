"""Condition, cluster, residue and family tables on small fixtures, with rows that are missing on one side."""

import pytest
from pyspark.sql import functions as F

from fjordmill.operators import conditions as C
from fjordmill.operators import family, signatures as G


def _by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_attrition_and_confidence(spark):
    df = spark.createDataFrame([("a", True, 1.0, "ok"), ("a", False, None, "missing"), ("a", None, float("nan"), ""), ("b", True, 2.0, "ok")], "k string, p boolean, v double, s string")
    got = _by(C.attrition(df, ["k"], F.col("p"), {"low": F.col("v") < 2, "none": F.col("v").isNull()}), "k")
    assert (got["a"].n_generated, got["a"].n_pass, got["a"].n_fail) == (3, 1, 2) and got["a"].reasons == '{"low":1,"none":1}' and got["b"].reasons is None and got["b"].hard_fail_rate == 0
    conf = _by(C.confidence(df, ["k"], ["v"], ~F.col("s").isin("missing", "")), "k")
    assert (conf["a"].n_confidence_rows, conf["a"].n_confidence_available, conf["a"].mean_v, conf["a"].median_v) == (3, 1, 1.0, 1.0)


def test_cluster_aggregates_fall_back_to_plain_means(spark):
    df = spark.createDataFrame([("a", 0.75, 3, 1.0), ("a", 0.25, 1, 5.0), ("a", 0.5, 2, None), ("b", 0.0, 1, 2.0), ("b", None, 1, 4.0)], "k string, occupancy double, n_poses int, v double")
    got = _by(C.cluster_aggregates(df, ["k"], ["v"]), "k")
    assert got["a"].occupancy_weighted_v == 2.0 and got["b"].occupancy_weighted_v == 3.0 and got["a"].mean_cluster_size == 2.0 and got["b"].cluster_total_occupancy == 0.0


def test_condition_table_keeps_conditions_without_clusters(spark):
    master = spark.createDataFrame([("a", 5), ("b", 7)], "c string, n_generated int")
    first = spark.createDataFrame([("a", 2, 9, 0.5), ("a", 1, None, 0.25), (None, 1, 1, 1.0)], "c string, o int, n_clusters int, e double")
    one = spark.createDataFrame([("a", 3, 0.1)], "c string, n_rows int, m double")
    got = _by(C.condition_table(master, "c", [(first, ["n_clusters", "e"], ["o"])], [one]), "c")
    assert (got["a"].n_clusters, got["a"].e, got["a"].n_rows) == (None, 0.25, 3)  # the first row, with its nulls
    assert (got["b"].n_clusters, got["b"].e, got["b"].n_rows, got["b"].m) == (0, None, 0, None)


def test_rollup_and_cluster_summary(spark):
    df = spark.createDataFrame([("p", "x", 2, 1, 1, 0.5), ("p", " ", 3, 0, 3, None), ("q", None, 0, 0, 0, None)], "p string, s string, n_generated int, n_clusters int, n_fail int, m double")
    got = _by(C.protein_rollup(df, "p", sets={"subs": "s"}, distinct={}, sums=["n_generated", "n_fail"], positive={"n_with": "n_clusters"}, means={"mean_m": "m"}), "p")
    assert (got["p"].subs, got["p"].n_subs, got["p"].n_with, got["p"].mean_m, got["p"].hard_fail_rate) == ("x", 1, 1, 0.5, 0.8) and got["q"].hard_fail_rate == 0.0
    a = spark.createDataFrame([("c", 0, "eligible")] * 3 + [("c", 1, "vdw_only"), ("c", -1, "null_ifp"), ("d", None, None)], "c string, k int, e string")
    s = _by(C.cluster_summary(a, "c", "k", "e"), "c")
    assert (s["c"].n_clusters, s["c"].n_noise, s["c"].top_cluster_occupancy, s["c"].contact_eligible_fraction) == (2, 1, 0.75, 0.6) and abs(s["c"].cluster_entropy - 0.811278) < 1e-5
    assert (s["d"].n_clusters, s["d"].noise_fraction, s["d"].top_cluster_occupancy) == (0, 1.0, None)


def test_signatures_keep_members_without_rows(spark):
    a = spark.createDataFrame([("c", 0, 1), ("c", 0, 2), ("c", 0, 3), ("c", 1, 4), ("c", -1, 5)], "c string, k int, p int")
    geo = spark.createDataFrame([(1, "good", 2.0), (2, "bad", 4.0), (4, "good", None)], "p int, s string, x double")
    conf = spark.createDataFrame([(1, 0.5), (2, 0.7)], "p int, z double")
    conv = spark.createDataFrame([(2, 1.5, True), (2, 1.5, True)], "p int, r double, ok boolean")
    med = spark.createDataFrame([("c", 0, 2)], "c string, k int, medoid int")
    got = _by(G.cluster_signatures(a, condition="c", cluster="k", pose="p", medoids=med, geometry=geo, statuses={"s": {"good_share": ("good",)}}, geometry_fields=["x"], confidence=conf, confidence_fields=["z"], convergence=conv, rmsd="r", convergent="ok"), "c", "k")
    r = got[("c", 0)]
    assert (r.n_poses, r.occupancy, round(r.good_share, 6), r.x_median, r.x_iqr, r.mean_z, r.medoid_z, r.convergent_fraction) == (3, 0.75, round(1 / 3, 6), 3.0, 1.0, 0.6, 0.7, 1.0)
    assert got[("c", 1)].convergent_fraction is None and got[("c", 1)].medoid is None and len(got) == 2


def test_residue_importance_fills_zeros_and_patches(spark):
    sig = spark.createDataFrame([("c", 0, "TRP", 1, 0.5, True), ("c", 1, "TRP", 1, 1.0, False), ("c", 0, "SER", 2, 0.25, False), ("c", -1, "SER", 2, 9.0, False)], "c string, k int, r string, n int, f double, cat boolean")
    clusters = spark.createDataFrame([("c", 0, 0.75, 0.4, None), ("c", 1, 0.25, 0.0, 1.0)], "c string, k int, occupancy double, a double, b double")
    seen = spark.createDataFrame([("c", "ALA", 9, 1, True), ("d", "ALA", 9, 1, True), ("d", "ALA", 9, 0, False), ("d", "GLY", 8, 0, False)], "c string, r string, n int, contact_present int, cat boolean")
    got = _by(G.residue_importance(sig, clusters, seen, condition="c", cluster="k", residue=["r", "n"], frequency="f", c1="a", c4="b", flags=["cat"]), "c", "r", "n")
    t = got[("c", "TRP", 1)]
    assert (t.residue_contact_score, round(t.c1_weighted_residue_score, 9), t.c4_weighted_residue_score, t.cluster_support_count, t.max_cluster_residue_frequency, t.cat) == (0.625, 0.15, 0.25, 2, 1.0, True)
    assert set(got) == {("c", "TRP", 1), ("c", "SER", 2), ("d", "ALA", 9)} and got[("d", "ALA", 9)].residue_contact_score == 0.0 and got[("d", "ALA", 9)].cat
    mass = spark.createDataFrame([("c", "TRP", 0.6), ("c", "SER", 0.2), ("c", "ARG", 0.2), ("c", "ARG", -1.0), ("d", "ARG", 0.0)], "c string, r string, w double")
    p = _by(G.patches(mass, ["c"], "w", G.residue_kinds(F.col("r")), mass.select("c")), "c")
    assert round(p["c"].aromatic_contact_fraction, 9) == 0.6 and round(p["c"].charged_contact_fraction, 9) == 0.2 and p["d"].polar_contact_fraction == 0.0 and p["d"].weighted_contact_feature_mass == 0.0


def test_families(spark):
    m = spark.createDataFrame([("f", "g", "AA", "p1"), ("f", "g", "AA", "p0"), ("f", "h", "AB", "p2"), ("f", "h", "AC", "p3")], "f string, g string, s string, p string")
    got = _by(family.collapse(m, ["f", "g"], "s", {"ids": "p"}, on_conflict="report"), "g")
    assert got["g"].ids == "p0,p1" and got["h"].n_sequences == 2
    assert family.collapse(m.where("g = 'g'"), ["f", "g"], "s", {"ids": "p"}).count() == 1
    with pytest.raises(Exception, match="inconsistent sequences for f:h"):
        family.collapse(m, ["f", "g"], "s", {"ids": "p"}).collect()
    n = spark.createDataFrame([("f", "A", 1, 3), ("f", "C", 1, 3), ("g", "A", 1, 2)], "f string, r string, c int, n long")
    assert {r.consensus for r in family.consensus(n, ["f", "c"], "r", "n").collect()} == {"A"}
    e = _by(family.enrichment(n, "f", ["r"], "n"), "f", "r")
    assert e[("f", "A")].share_percent == 50.0 and abs(e[("g", "A")].log2_enrichment - 0.678072) < 1e-5
