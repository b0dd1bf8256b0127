"""Readers, writers, statistics and functions on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordmill.functions import vectors as V
from fjordmill.functions.parallel import parallel_map
from fjordmill.operators import relational as R, replay, statistics as Q
from fjordmill.sources import readers, writers


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def test_checked_reader(spark, tmp_path):
    p = _write(tmp_path, "a.csv", "UniProt ;Protein name;GenBank\n A1.1, b2; x\n;;\n\nC3;y;-;extra\n")
    got = readers.token_arrays(readers.read_checked(spark, p, ["uniprot", "genbank"]), {"ids": "uniprot", "gb": "genbank"}).orderBy("line_no").collect()
    assert [(r.line_no, r["protein name"], r.ids, r.gb) for r in got] == [(2, "x", ["A1", "B2"], []), (5, "y", ["C3"], [])]
    for text, told in (("a;b\n1;2\n", "missing columns"), ("uniprot,genbank\n", "between its columns"), ("uniprot;gen,bank\n", "between its columns"), ("", "empty")):
        with pytest.raises(ValueError, match=told):
            readers.read_checked(spark, _write(tmp_path, "b.csv", text), ["uniprot", "genbank"])


def test_family_export_and_domains(spark, tmp_path):
    p = _write(tmp_path, "e.tsv", "AA9\tEuk\tAur ano clone v1.2\tJ2\tJGI\nAA9\tEuk\tAur ano\tJ1\tjgi\nAA9\tEuk\tx\tN1\tGenBank\nAA9\tshort\nAA9\tEuk\tSolo\tJ3\tjgi\n")
    plain, groups = readers.read_family_export(spark, p)
    assert [r.accession for r in plain.collect()] == ["N1"] and {r.organism: r.accessions for r in groups.collect()} == {"Aur ano": ["J1", "J2"], "Solo": ["J3"]}
    line = "dom - 40 q1 - 300 1e-5 9 8 1 2 0.1 0.2 7.5 0.3 1 9 11 30 10 31 0.9 two  words"
    got = readers.read_domtblout(spark, _write(tmp_path, "d.txt", f"# c\n{line}\nshort line\n"), "s").collect()
    assert len(got) == 1 and (got[0].evalue, got[0].score, got[0].seq_start, got[0].env_to, got[0].alignment_length, got[0].coverage, got[0].description, got[0].source) == (1e-5, 7.5, 11, 31, 20, 0.5, "two words", "s")
    assert readers.read_domtblout(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_discovery_and_inputs(spark, tmp_path):
    for name in ("t1/run_2/seed-1_sample-0", "t1/run_10/seed-1_sample-0", "t1/run_10/seed-2_sample-1", "t2/latest/seed-1_sample-0", "t2/run_99/seed-1_sample-0", "t3/other"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "m.cif").write_text("x")
    files = readers.list_files(spark, f"file://{tmp_path}", "*.cif")
    assert {(r.target, r.run, r.seed) for r in readers.discover(files).collect()} == {("t1", 10, 1), ("t1", 10, 2), ("t2", 2147483647, 1)}
    assert readers.discover(files, latest_only=False, targets=["t1"]).count() == 3 and readers.list_files(spark, f"file://{tmp_path}/no").count() == 0
    poses = spark.createDataFrame([("a", 2), ("a", 1), ("a", 3), ("b", 9)], "c string, k int")
    top = spark.createDataFrame([("a", 0), ("b", 0), ("d", 0)], "c string, k int")
    got = [tuple(r) for r in readers.pose_inputs(poses, top, "c", ["k"], keep=F.col("k") < 9, cap=2).collect()]
    assert got == [("a", 1, "pose"), ("a", 2, "pose"), ("b", 0, "top_model"), ("d", 0, "top_model")]
    assert readers.read_selection("x:\n - id: 'a'  # c\n   n: 3\n   ok: true\n - id: b\n") == [{"id": "a", "n": 3, "ok": True}, {"id": "b"}]


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1.23456), (None, None), ("<i>", 2.0)], "k string, v double")
    assert writers.markdown_table(df) == "| k | v |\n| --- | --- |\n| a\\|b | 1.235 |\n|  |  |\n| <i> | 2 |\n"
    page = writers.html_report("t", {"one": df})
    assert "&lt;i&gt;" in page and page.count("<tr>") == 4
    with pytest.raises(ValueError):
        writers.markdown_table(df, most=2)


def test_signed_rank_against_the_arrays(spark):
    rng = np.random.default_rng(4)
    groups = {"exact": rng.normal(0.4, 1, 12), "ties": np.round(rng.normal(0.4, 1, 80), 1), "one": np.array([1.0]), "zero": np.zeros(3)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double")
    got = {r.g: r for r in Q.signed_rank(df, "x", ["g"]).collect()}
    for g in ("exact", "ties", "one"):
        w, p = Q.wilcoxon(groups[g])
        assert got[g].w == w and math.isclose(got[g].wilcoxon_p, p, rel_tol=1e-9)
    assert "zero" not in got
    told = {r.g: r for r in Q.endpoint_summary(df, "g", "x").collect()}
    assert told["zero"].statistical_test == "none" and told["zero"].bh_fdr_p_value is None and told["exact"].statistical_test == "paired_wilcoxon_signed_rank"
    pos, neg = (groups["ties"] > 0).sum(), (groups["ties"] < 0).sum()
    assert math.isclose(told["ties"].sign_test_p_value, Q.sign_test(int(pos), int(neg)), rel_tol=1e-9)


def test_paired_compare_and_correlations(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 60)
    b = a + rng.normal(0.5, 1, 60)
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b)] + [("g", None, 1.0), ("h", 1.0, 1.0)], "g string, a double, b double")
    got = {r.metric_name: r for r in Q.paired_compare(df, {"m": ("a", "b")}).collect()}["m"]
    assert got.n_pairs == 61 and math.isclose(got.p_value, Q.wilcoxon(np.append(b - a, 0.0))[1], rel_tol=1e-6)
    c = {r.g: r for r in Q.correlations(df, "a", "b", ["g"], F.col("a") > 0, F.col("b") > 0).collect()}
    r = np.corrcoef(a, b)[0, 1]
    assert math.isclose(c["g"].pearson, r, rel_tol=1e-9) and math.isclose(c["g"].pearson_p, Q.normal_sf2(math.atanh(r) * math.sqrt(57)), rel_tol=1e-9)
    assert c["g"].n11 + c["g"].n10 + c["g"].n01 + c["g"].n00 == 60 and c["h"].pearson is None and c["h"].pearson_p is None


def test_vectors(spark):
    p = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    r = spark.range(1).select(
        V.unit(p(3, 0, 4)).alias("u"), V.unit(p(0, 0, 0)).alias("none"), V.centroid(F.array(p(0, 0, 0), p(2, 4, 6))).alias("c"), V.placed_beyond(p(1, 0, 0), p(0, 0, 0), 2.0).alias("b"), V.placed_in_plane(p(1, 0, 1), p(0, 0, 0), p(0, 0, 1), 2.0).alias("q"),
        V.face(p(0, 0, 1), p(0, 0, 0), p(5, 5, 2)).alias("f1"), V.face(p(0, 0, 1), p(0, 0, 0), p(5, 5, 0)).alias("f2"), V.face(p(0, 0, 1), p(0, 0, 0), p(0, 0, -2)).alias("f3"),
    ).first()
    assert np.allclose(r.u, [0.6, 0.0, 0.8]) and r.none is None and r.c == [1.0, 2.0, 3.0] and r.b == [3.0, 0.0, 0.0] and r.q == [3.0, 0.0, 1.0] and (r.f1, r.f2, r.f3) == ("toward", "ambiguous", "away")
    texts = ["[1, 2.5]", '{"b": 1, "a": "2"}', "1 2,3", "1,x", "", None, "[]", '[1, "nan"]', "{bad"]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.weighted_vector(F.col("t")).alias("w")).collect()]
    assert got == [[1.0, 2.5], [2.0, 1.0], [1.0, 2.0, 3.0], None, None, None, None, None, None]


def test_parallel_map_keeps_failures_apart(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 1)], "a int, b int")
    got = {(r.a, r.b): (r.q, r.error) for r in parallel_map(df, lambda a, b: a / b, ["a", "b"], "q", "double").collect()}
    assert got[(1, 2)] == (0.5, None) and got[(1, 0)][0] is None and got[(1, 0)][1].startswith("ZeroDivisionError") and got[(None, 1)][1].startswith("TypeError")


def test_pending_cases_and_kingdoms(spark):
    cases = spark.createDataFrame([(1, "pending", "m", 1), (2, "skipped", "m", 1), (3, None, "m", 1), (4, "pending", "n", 1), (5, "pending", "m", 2), (6, "pending", "m", 1)], "c int, status string, model string, l int")
    log = spark.createDataFrame([(1, "completed", 1), (6, "completed", 1), (6, "failed", 2)], "c int, e string, o int")
    done = spark.createDataFrame([("m", 2)], "model string, l int")
    args = dict(case="c", event="e", order=["o"], done="completed", revoked="failed", finished=done, group=["model", "l"])
    assert {r.c for r in replay.pending(cases, log, **args).collect()} == {3, 4, 6}
    assert {r.c for r in replay.pending(cases, log, **args, models=("model", ["m"]), resume=False).collect()} == {1, 3, 5, 6}
    k = spark.createDataFrame([("Eukarya",), ("Bacteria",), (" ",)], "k string")
    assert [r.g for r in k.select(R.kingdom_group(F.col("k"), ("eukarya",), False).alias("g")).collect()] == ["eukarya", "other", "missing"]
    with pytest.raises(Exception, match="missing kingdom"):
        k.select(R.kingdom_group(F.col("k"), ("eukarya",), True)).collect()
