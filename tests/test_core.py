"""Relational helpers, statistics, clustering, readers and streams on small literal tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordmill.functions import scalars as S
from fjordmill.operators import components, fingerprints, intervals, learning as L, manifest, relational as R, replay, statistics as Q
from fjordmill.session import Workspace
from fjordmill.sources import readers, writers


def test_index_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(map(tuple, R.index_first(df, ["k"], ["o"]).collect())) == [("a", 1, None), ("b", 5, "z")]
    assert sorted(map(tuple, R.index_first(df, ["k"], ["o"], last=True).collect())) == [("a", 2, "x"), ("b", 5, "z")]


def test_assemble_keeps_every_master_row(spark):
    m = spark.createDataFrame([("a",), ("b",)], "k string")
    p = spark.createDataFrame([("a", 3, 1.5)], "k string, n int, x double")
    assert sorted(map(tuple, R.assemble(m, "k", [(p, {"n": 0, "x": None})]).collect())) == [("a", 3, 1.5), ("b", 0, None)]


def test_pair_sides_last_row_wins(spark):
    df = spark.createDataFrame([("p", "l", 1.0, 1), ("p", "l", 2.0, 2), ("p", "r", 5.0, 1), ("q", "l", 1.0, 1)], "k string, side string, v double, o int")
    assert [tuple(r) for r in R.pair_sides(df, ["k"], "side", "l", "r", ["v"], ["o"]).collect()] == [("p", 2.0, 5.0)]


def test_weighted_mean_falls_back(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, None), ("b", 1.0, 1.0), ("b", 4.0, 3.0), ("b", None, 9.0)], "k string, v double, w double")
    assert {r.k: r.m for r in df.groupBy("k").agg(S.weighted_mean(F.col("v"), F.col("w")).alias("m")).collect()} == {"a": 2.0, "b": 3.25}


def test_benjamini_hochberg_against_numpy(spark):
    p = np.random.default_rng(2).random(40)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double")
    got = {r.i: r.q for r in R.benjamini_hochberg(df, "p").collect()}
    o = np.argsort(p)
    want = np.minimum(1, np.minimum.accumulate((p[o] * 40 / np.arange(1, 41))[::-1])[::-1])
    assert np.allclose([got[int(i)] for i in o], want)


@pytest.mark.parametrize("block", [4096, 7])
def test_medoids_of_groups_of_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = np.random.default_rng(block)
    sets = [(g, i, sorted(set(rng.integers(0, 12, rng.integers(0, 6)).tolist()))) for i, g in enumerate(rng.integers(0, 3, 120).tolist())]
    want = {}
    for g in {s[0] for s in sets}:
        own = [(i, set(t)) for h, i, t in sets if h == g]
        far = {i: sum(1 - (len(a & b) / len(a | b) if a | b else 1) for j, b in own if j != i) for i, a in own}
        want[g] = min(far, key=lambda i: (round(far[i], 9), i)), far
    got = {r.grp: r for r in fingerprints.medoids(spark.createDataFrame(sets, "grp long, id long, tokens array<long>")).collect()}
    assert all(got[g].id == i and abs(got[g].distance_sum - far[i]) < 1e-6 for g, (i, far) in want.items())


@pytest.mark.parametrize("small", [components.SMALL, 70, 0])
def test_components_path_hub_and_empty(spark, small):
    path = [(i, i + 1) for i in range(64)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7, 7), (None, 3), (5000, 5000)]
    df = spark.createDataFrame(path, "a long, b long")
    got = {r.node: r.root for r in components.roots(df.repartition(7), Workspace(spark, "t"), small=small).collect()}
    assert {got[i] for i in range(65)} == {0} and {got[1000 + k] for k in range(200)} == {1000} and got[5000] == 5000
    assert len(got) == 65 + 200 + 1
    assert components.roots(df.limit(0), Workspace(spark, "t"), small=small).count() == 0


def test_replay_revokes(spark):
    df = spark.createDataFrame([("a", "done", 1), ("a", "fail", 2), ("b", "fail", 1), ("b", "done", 3), ("c", "other", 1)], "k string, e string, o int")
    assert {r.k: r.completed for r in replay.last_state(df, "k", "e", ["o"], "done", "fail").collect()} == {"a": False, "b": True}


def test_stream_equals_batch(spark, tmp_path):
    from fjordmill.streaming.replay import replay_stream

    rows = [(i, f"u{i % 5}", ["done", "fail", "other"][i * 7 % 3], i * 31 % 40) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, u string, e string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    q = replay_stream(stream, "u", "e", "ts", "id", "done", "fail").writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r.case: r.completed for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.u: r.completed for r in replay.last_state(df, "u", "e", ["ts", "id"], "done", "fail").collect()}
    assert seen == want


def test_windowed_counts_close_behind_the_watermark(spark, tmp_path):
    from fjordmill.streaming.replay import windowed_counts

    df = spark.createDataFrame([(i * 600, "ab"[i % 2]) for i in range(48)], "s long, kind string").select(F.timestamp_seconds("s").alias("ts"), "kind")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind")
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("windows").collect()
    assert {(r.start.hour, r.kind, r.n) for r in rows} == {(h, k, 3) for h in range(5) for k in "ab"}


def test_overlap_arithmetic():
    assert intervals.overlap_share(1, 11, 6, 16, False) == 0.5
    assert intervals.overlap_share(1, 10, 10, 19, True) == 0.1
    assert intervals.overlap_share(1, 5, 6, 9, False) == 0.0


def test_greedy_intervals(spark):
    df = spark.createDataFrame([("s", "a", 1, 100, 2), ("s", "b", 10, 60, 1), ("s", "c", 90, 140, 3), ("t", "d", 1, 5, 1)], "g string, id string, start int, end int, pr int")
    assert {r.id for r in intervals.greedy(df, ["g"], ["pr", "start"], False, 0.5).collect()} == {"b", "c", "d"}


def test_within_distance_brute(spark):
    x = np.random.default_rng(1).random((60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, x double, y double")
    got = {(r.a, r.b) for r in intervals.within_distance(df, "i", ["x", "y"], 0.15).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if i != j and ((x[i] - x[j]) ** 2).sum() <= 0.15**2}


def test_medoid_ties_and_empty_sets(spark):
    df = spark.createDataFrame([("g", 3, [1, 2]), ("g", 1, [1, 2]), ("g", 2, [9]), ("h", 5, []), ("h", 6, [])], "grp string, id long, tokens array<long>")
    assert {r.grp: (r.id, r.distance_sum) for r in fingerprints.medoids(df).collect()} == {"g": (1, 1.0), "h": (5, 0.0)}


def test_ordinals(spark):
    df = spark.range(500).select((F.lit(1000) - F.col("id")).alias("k"))
    rows = manifest.ordinals(df, ["k"], "n").collect()
    assert sorted(r.n for r in rows) == list(range(1, 501)) and all(r.n == r.k - 500 for r in rows)


def test_two_sample_and_precision(spark):
    rng = np.random.default_rng(4)
    y, x = rng.integers(0, 2, 200), rng.integers(0, 20, 200).astype(float)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y)] + [("g", None, 1)], "g string, s double, y int")
    r = Q.two_sample(df, "s", "y", ["g"]).first()
    pairs = np.sign(x[y == 1][:, None] - x[y == 0][None])
    assert math.isclose(r.cliffs_delta, pairs.mean(), abs_tol=1e-12)
    h = Q.kruskal(df.where("s is not null"), "s", "y", ["g"]).first().h
    assert math.isclose(h, Q.kruskal_h(x, y), rel_tol=1e-9)
    assert Q.average_precision(df.where("y = 0"), "s", "y", ["g"]).first().average_precision is None


def test_tails():
    assert math.isclose(Q.t_sf2(2.0, 10), 0.07338803, abs_tol=1e-7)
    assert math.isclose(Q.f_sf(4.0, 2, 20), 1.4**-10, rel_tol=1e-9)
    assert math.isclose(Q.normal_sf2(1.959963984540054), 0.05, abs_tol=1e-12)
    assert Q.sign_test(9, 1) == pytest.approx(0.021484375)
    assert Q.wilcoxon(np.array([1.0, 2, 3, 4, 5]))[1] == pytest.approx(0.0625)
    lo, hi = Q.bootstrap_median(np.arange(20.0), 500)
    assert lo < 9.5 < hi and math.isnan(Q.bootstrap_median(np.arange(3.0))[0])


def test_permutation_pair_equals_the_single_tests():
    rng = np.random.default_rng(8)
    for n, top in ((30, 6), (41, 1000), (12, 1)):
        x, y = rng.integers(0, top, n).astype(float), np.append(rng.integers(0, 2, n - 2), [0, 1])
        want = Q.permutation_p(x[(o := np.lexsort((y, x)))], y[o], Q.median_difference, 300), Q.permutation_p(x[o], y[o], Q.kruskal_h, 300)
        assert Q.permutation_pair(x[o], y[o], 300) == pytest.approx(want, abs=1e-12)


def test_permutation_query_takes_ten_thousand(spark, tmp_path):
    from fjordmill.plans.statistics import q5_permutation

    rows = [("m", i, float(i), int(i >= 20)) for i in range(40)]
    spark.createDataFrame(rows, "model_name string, prediction_id long, y_score double, y_true int").write.parquet(str(tmp_path / "cv_prediction.parquet"))
    r = q5_permutation(spark, str(tmp_path)).first()
    assert r.n == 40 and r.median_p == r.kruskal_p == pytest.approx(1 / 10_001)


def test_linkage_and_density():
    bits = np.array([[1, 1, 1, 0, 0, 0]] * 4 + [[0, 0, 0, 1, 1, 1]] * 4 + [[0, 0, 0, 0, 0, 0]])
    d = L.jaccard(bits)
    assert L.average_linkage(d, 0.55, least=2).tolist() == [0] * 4 + [1] * 4 + [-1]
    assert L.density_clusters(L.jaccard(np.ones((20, 5))), 5).tolist() == [0] * 20
    assert L.density_clusters(d[:3, :3], 5).tolist() == [-1] * 3
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), [[2.5, 9]]])
    labels = L.density_clusters(np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)), 5)
    assert len(set(labels[:20].tolist()) - {-1}) == 1 and len(set(labels[20:40].tolist()) - {-1}) == 1 and labels[0] != labels[25]
    assert L.medoids(d, L.average_linkage(d, 0.55))[0] == (0, 0.0)


def test_grouped_cv_keeps_units_apart(spark):
    rng = np.random.default_rng(1)
    rows = [("r", i, f"u{i // 4}", float(rng.normal() + (i // 4 % 2) * 3), i // 4 % 2) for i in range(120)] + [("r", 999, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "run string, key long, unit string, x double, y long")
    out = L.grouped_cv(df, "run", "key", "unit", ["x"], "y").toPandas().merge(df.toPandas(), on="key")
    assert (out.groupby("unit")["fold"].nunique() == 1).all() and len(out) == 120
    assert ((out["y_score"] > 0.5) == (out["y"] == 1)).mean() > 0.85


def test_fold_metrics_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{i % 2}", i, i // 2 % 5, int(rng.random() < 0.4), float(rng.integers(0, 12)) / 11) for i in range(300)] + [("r2", 900 + i, 0, 0, 0.4 + i / 10) for i in range(4)] + [("r2", 990, 1, 1, None), ("r2", 991, 2, 1, 0.9)]
    told = L.fold_metrics(spark.createDataFrame(rows, "run string, key long, fold long, y long, s double"), "run", "key", "y", "s").toPandas().set_index(["run", "fold"])
    assert len(told) == 12
    for (run, fold), r in told.iterrows():
        own = sorted((x for x in rows if x[0] == run and x[2] == fold), key=lambda x: (-x[4], x[1]))
        y, s = np.array([x[3] for x in own]), np.array([x[4] for x in own])
        k = y.sum()
        area = sum(((y == 1) & (s == v)).sum() * y[s >= v].mean() for v in np.unique(s)) / k if k else 0.0
        both = [((s > 0.5) == v)[y == v].mean() for v in (0, 1) if (y == v).any()]
        assert (r.n_test, r.n_test_positive) == (len(y), k)
        assert (r.pr_auc, r.balanced_accuracy, r.recall_at_k) == pytest.approx((area, np.mean(both), y[:k].sum() / k if k else 0.0))
    for run, own in told.groupby("run"):
        for c in ("pr_auc", "balanced_accuracy", "recall_at_k"):
            assert own[f"mean_{c}"].iloc[0] == pytest.approx(own[c].mean()) and own[f"std_{c}"].iloc[0] == pytest.approx(own[c].std(ddof=0))


def test_fold_metrics_are_registered():
    import __spark_entry__ as e

    assert "m4_fold_metrics" in e.queries()


def test_tree_baseline_judges_held_out_proteins(spark, tmp_path):
    from fjordmill.plans import statistics as plans

    # a protein far from all others, whose label only a tree that saw it can know; a protein of two rows; one without c1
    rows = [(f"P{i:02d}", "x_NAG6_full", i < 20, i, 3.0 if i != 5 else float("nan")) for i in range(40)] + [("P00", "x_CEL4_full", True, 1, 3.0), ("FAR", "x_NAG6_full", True, 1000, 3.0), (None, "x_NAG6_full", True, 1, 3.0)]
    spark.createDataFrame(rows, "protein_id string, condition_id string, passed boolean, n_non_vdw_interactions int, min_cu_c1 double").write.parquet(str(tmp_path / "geometry_result.parquet"))
    got = plans.m5_tree_baseline(spark, str(tmp_path)).toPandas()
    far = got[got.protein_id == "FAR"].iloc[0]
    assert far.label == 1 and far.prediction == 0
    assert len(got) == 42 and sorted(got.fold.unique()) == [0, 1, 2, 3, 4] and (got.groupby("protein_id").fold.nunique() == 1).all()
    assert (got.prediction == got.label).mean() > 0.9
    scores = []
    for _, own in got.groupby("fold"):
        scores.append(np.mean([(own[own.label == v].prediction == v).mean() for v in own.label.unique()]))
        assert own.fold_score.tolist() == pytest.approx([scores[-1]] * len(own))
    assert (got.importance_contacts == 1).all() and (got.mean_importance_c1 == 0).all()
    assert got.mean_score[0] == pytest.approx(np.mean(scores)) and got.std_score[0] == pytest.approx(np.std(scores))


def test_baselines_weigh_classes_and_survives_one_label(spark):
    # one in ten is positive, one in five where x is 1: balanced weights make that side positive
    rows = [(f"u{i}", float(i % 2), int(i % 2 and i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "u string, x double, y int")
    assert {(r.x, r.prediction) for k in ("tree", "logistic") for r in L.baseline_cv(df, "u", ["x"], "y", kind=k).collect()} == {(0.0, 0.0), (1.0, 1.0)}
    one = L.baseline_cv(df.where("y = 0"), "u", ["x"], "y").collect()
    assert len(one) == 180 and all(r.prediction is None and r.fold is not None for r in one)


def test_kabsch_ignores_rotation():
    a = np.random.default_rng(3).normal(size=(8, 3))
    c, s = math.cos(1), math.sin(1)
    assert L.kabsch_rmsd(a, a @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) + 4) < 1e-7


def test_readers_edge_cases(spark, tmp_path):
    assert readers.read_tsv(spark, str(tmp_path / "none"), ["a"]).count() == 0
    (tmp_path / "x.csv").write_text("a;b\n1;2\n3\n")
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "x.csv"), ["a"]).orderBy("a").collect()] == [("1", "2"), ("3", None)]
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path / "x.csv"), ["zzz"])
    (tmp_path / "f.fa").write_text(">a|x y\nAC\nGT\n>b\nTT\n")
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "f.fa")).collect())) == [("a|x y", "ACGT"), ("b", "TT")]
    with pytest.raises(ValueError):
        writers.write_tsv(spark.range(1), str(tmp_path / "o"), ["other"], strict=True)


def test_discover_latest_run(spark):
    p = [f"/w/{t}/{r}/seed-1_sample-{s}/m.cif" for t, r, s in (("a", "run_2", 0), ("a", "run_10", 1), ("b", "run_3", 0), ("b", "latest", 2))] + ["/w/junk"]
    got = {(r.target, r.sample) for r in readers.discover(spark.createDataFrame([(x,) for x in p], "path string")).collect()}
    assert got == {("a", 1), ("b", 2)}


def test_every_query_is_listed_once():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
