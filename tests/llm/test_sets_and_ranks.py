"""Similar pairs, percentiles, splits and clusters against brute force, with their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordmill.llm import clusters, groupsplit, rankstats, setjoin

SETS = "field string, id long, tokens array<long>, key long, a long"


def _sets(spark, rows):
    return spark.createDataFrame([("f", i, t, 1, 2) for i, t in rows], SETS)


def _brute(rows, s, least):
    sets = {i: set(t) for i, t in rows if t is not None and i is not None and len(set(t)) >= least}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= s - 1e-9}


def _random_rows(rnd, n, sizes, vocabulary):
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            t = set(rnd.choice(rows)[1])
            for _ in range(rnd.randint(0, 3)):
                t.discard(rnd.choice(sorted(t)))
                t.add(rnd.randint(0, vocabulary))
        else:
            t = set(rnd.sample(range(vocabulary), rnd.choice(sizes)))
        rows.append((i, sorted(t)))
    return rows


@pytest.mark.parametrize("similarity,sizes", [(0.8, [6, 7, 12, 30]), (0.6, [6, 9, 40]), (0.8, [60, 80, 100]), (0.5, [4, 70])])
@pytest.mark.parametrize("block", [4096, 6])
def test_similar_pairs_small_and_large_sets(spark, similarity, sizes, block, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", block)  # 6: subsets are extended, and cut into blocks at the deepest
    rows = _random_rows(random.Random(len(sizes)), 150, sizes, 400)
    member, links = setjoin.similar_pairs(_sets(spark, rows), similarity=similarity, least=4)
    got = [(r.x, r.y) for r in setjoin.record_pairs(member, links).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute(rows, similarity, 4)
    n = {i: 0 for i, t in rows if len(set(t)) >= 4}
    for a, b in got:
        n[a] += 1
        n[b] += 1
    assert {r.id: r.n_links for r in setjoin.link_counts(member, links).collect()} == n


@pytest.mark.parametrize("deepest", [1, 2, 4])
def test_similar_pairs_hot_key_in_blocks(spark, monkeypatch, deepest):
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    base = list(range(10))
    rows = [(i, base + [100 + i]) for i in range(60)] + [(60, base), (61, base), (62, None), (63, []), (64, [1, 2])]
    member, links = setjoin.similar_pairs(_sets(spark, rows), similarity=0.8, least=6, deepest=deepest)
    assert {(r.x, r.y) for r in setjoin.record_pairs(member, links).collect()} == _brute(rows, 0.8, 6)


def test_pairs_leave_the_task_in_turns(monkeypatch):
    base = list(range(40))
    rows = [(i, sorted(set(base) - {i % 40} | {100 + i})) for i in range(300)]
    import pyarrow as pa

    keyed = pa.RecordBatch.from_arrays(
        [pa.array([9] * 300), pa.array([5] * 300), pa.array([i for i, _ in rows]), pa.array([np.array(t, np.int64).tobytes() for _, t in rows], pa.binary()), pa.array([0] * 300, pa.int32()), pa.array([9] * 300)], names=["key", "f", "id", "tokens", "side", "meet"]
    )
    turns = []
    for most in (1 << 19, 1000):
        monkeypatch.setattr(setjoin, "MOST_HITS", most)
        monkeypatch.setattr(setjoin, "_key", lambda sums, field, level: np.full(len(sums), 9, np.uint64))  # every pair belongs to the one key
        turns.append([r.num_rows for r in setjoin._pairs(0.8)([keyed])])
    assert len(turns[0]) == 1 and len(turns[1]) == 3 and sum(turns[0]) == sum(turns[1]) == 300 * 299 // 2


def test_very_long_sets(spark):
    rows = [(i, list(range(i, 3000 + i))) for i in range(4)] + [(9, list(range(5000, 7000)))]
    member, links = setjoin.similar_pairs(_sets(spark, rows))
    assert {(r.a, r.b) for r in links.collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}


def test_similar_pairs_copies_and_empty(spark):
    rows = [(i, [1, 2, 3, 4, 5, 6]) for i in range(5)]
    member, links = setjoin.similar_pairs(_sets(spark, rows))
    assert links.count() == 0 and setjoin.record_pairs(member, links).count() == 10
    member, links = setjoin.similar_pairs(_sets(spark, rows).limit(0))
    assert setjoin.record_pairs(member, links).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([([1, 0, None, 1], ["A ", " a", None, "b", ""]), (None, None), ([], [])], "v array<tinyint>, l array<string>")
    r = setjoin.on_positions(df, "v").select("v", F.size(setjoin.label_set(F.col("l"))).alias("n")).collect()
    assert [x.v for x in r] == [[0, 3], None, []] and r[0].n == 2 and r[2].n == 0
    assert [x.v for x in setjoin.on_positions(df.union(df).coalesce(1), "v").collect()] == [[0, 3], None, []] * 2


GEO = "condition_id string, pose_key long, day string, v double, n int, value double"


def _geo(spark, rows):
    return spark.createDataFrame([(*r, 0.0) for r in rows], GEO)


def test_percentiles_exact_when_small(spark):
    rnd = random.Random(1)
    rows = [(f"c{rnd.randint(0, 3)}", i, f"d{rnd.randint(0, 2)}", rnd.choice([1.0, 2.5, float("nan"), float("inf"), None, rnd.random() * 9]), rnd.randint(0, 9)) for i in range(400)]
    rows += rows[:50] + [(None, 1000, None, 1.0, 1)]
    flat = rankstats.long_form(_geo(spark, rows), ["condition_id"], ["v", "n"], record="pose_key")
    got = {(r.grp, r.metric, r.percent): r for r in rankstats.percentiles(rankstats.summarise(flat), [0.1, 0.5, 0.9]).collect()}
    once = {r[1]: r for r in rows}.values()
    for c in ("c0", "c1", "c2", "c3", ""):
        for m, k in (("v", 3), ("n", 4)):
            x = [r[k] for r in once if (r[0] or "") == c and r[k] is not None and np.isfinite(r[k])]
            for p in (0.1, 0.5, 0.9):
                r = got[(c, m, p)]
                assert r.low <= np.percentile(x, p * 100) + 1e-9 and r.high >= np.percentile(x, p * 100) - 1e-9
                assert r.n == len(x) and (r.rank_error > 0 or abs(r.estimate - np.percentile(x, p * 100)) < 1e-9)


@pytest.mark.parametrize("hot", [0.0, 0.7])
def test_percentiles_bound_error_and_combine(spark, hot):
    rng = np.random.default_rng(5)
    x = rng.lognormal(0, 2, 30_000)
    rows = [("hot" if rng.random() < hot else f"c{i % 3}", i, f"d{i % 7}", float(v), int(v) % 50) for i, v in enumerate(x)]
    flat = rankstats.long_form(_geo(spark, rows), ["condition_id", "day"], ["v"], record="pose_key")
    days = rankstats.summarise(flat, 0.01)
    whole = rankstats.merge(days.withColumn("grp", F.split("grp", "\t")[0]), 0.01)
    for r in rankstats.percentiles(whole, [0.01, 0.5, 0.99]).collect():
        own = np.sort([q[3] for q in rows if q[0] == r.grp])
        true = np.percentile(own, r.percent * 100)
        assert r.low <= true <= r.high and r.n == len(own) and r.rank_error <= 0.02 + 1e-9
        assert abs(np.searchsorted(own, r.estimate) - r.percent * len(own)) <= 0.025 * len(own) + 1
    assert whole.count() < 0.1 * len(rows)


def test_compress_keeps_counts():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 9, 5000)
    g = np.sort(rng.integers(0, 4, 5000))
    g2, at, up, down = rankstats.compress(g, np.arange(5000), n, n, 0.01)
    for k in range(4):
        assert up[g2 == k].sum() == down[g2 == k].sum() == n[g == k].sum()
    assert len(g2) < 800


def test_percentiles_empty_and_differing(spark):
    empty = rankstats.long_form(_geo(spark, []), ["condition_id"], ["n"], record="pose_key")
    assert rankstats.percentiles(rankstats.summarise(empty), [0.5]).count() == 0
    rows = [("a", i, "d", 0.0, v) for i, v in enumerate([1, 2, 3, 4])] + [("b", 10 + i, "d", 0.0, v) for i, v in enumerate([5, 5, 9])]
    flat = rankstats.long_form(_geo(spark, rows), ["condition_id"], ["n"], record="pose_key")
    told = spark.createDataFrame([("a", 3.5), ("a", 3.6), ("b", None), ("b", 3.9), ("c", 1.0)], "c string, m double")
    bounds = rankstats.percentiles(rankstats.summarise(flat), [0.5])
    from fjordmill.session import Workspace

    assert {r.grp for r in rankstats.differing(told, "c", "m", bounds, flat, 1.0, Workspace(spark, "t")).collect()} == {"a", "b"}


def test_exact_percentiles_from_wide_bounds(spark):
    rnd = np.random.default_rng(6)
    groups = {"a": rnd.integers(0, 40, 3001).astype(float), "b": rnd.normal(0, 1, 2000), "c": np.array([5.0]), "d": np.repeat(1.5, 700)}
    flat = spark.createDataFrame([(g, "m", float(v)) for g, vs in groups.items() for v in vs], "grp string, metric string, value double").repartition(5)
    bounds = rankstats.percentiles(rankstats.summarise(flat, error=0.05), [0.0, 0.1, 0.5, 0.999, 1.0])
    got = {(r.grp, r.percent): r.value for r in rankstats.exact(flat, bounds).collect()}
    assert len(got) == 20 and all(abs(v - np.percentile(groups[g], 100 * p)) < 1e-9 for (g, p), v in got.items())


PRED = "prediction_id long, protein_id string, lab string, record long, component long"


def _union_find(rows):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for p, *es in rows:
        find(("r", p))
        for k, e in enumerate(es):
            if e and e.strip().lower() not in ("", "-", "unknown"):
                top[find((k, e.strip().lower()))] = find(("r", p))
    out = {}
    for p, *_ in rows:
        out.setdefault(find(("r", p)), set()).add(p)
    return {p: min(g) for g in out.values() for p in g}


def _pred(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], PRED)


E = ["protein_id", "lab"]


def _state(spark, tmp_path):
    return groupsplit.State(spark, f"file://{tmp_path}/state")


def _bring(spark, state, rows):
    return {r.record: r for r in groupsplit.update(state, _pred(spark, rows), record="prediction_id", entities=E).collect()}


@pytest.mark.parametrize("batches", [1, 3])
def test_groups_chain_hub_and_placeholders(spark, tmp_path, batches):
    rows = [(i, f"P{i // 2}", f"L{(i + 1) // 2}") for i in range(60)] + [(100 + i, " hub ", None) for i in range(40)] + [(200, "HUB", "-"), (201, None, "unknown"), (202, "", None), (201, "late", None), (203, "LATE", None), (None, "hub", None)]
    for k in range(batches):
        _bring(spark, _state(spark, tmp_path), rows[k::batches])  # read again before every batch
    state = _state(spark, tmp_path)
    told = {r.record: r for r in state.assignments().collect()}
    assert {k: r.group_key for k, r in told.items()} == _union_find([r for r in rows if r[0] is not None]) and state.version == batches
    assert state.table("components").agg(F.sum("size")).first()[0] == len(told)
    split = {}
    for r in told.values():
        assert r.quarantined == (r.split is None)
    for p, *es in rows:
        for k, e in enumerate(es):
            if e and e.strip().lower() not in ("", "-", "unknown") and p is not None and told[p].split:
                assert split.setdefault((k, e.strip().lower()), told[p].split) == told[p].split
    assert _bring(spark, state, []) == {} and state.assignments().count() == len(told)


def test_splits_grow_and_quarantine(spark, tmp_path):
    state = _state(spark, tmp_path)
    got = _bring(spark, state, [(i, f"P{i}", None) for i in range(3000)] + [(5000 + i, "big", None) for i in range(300)])
    share = {s: sum(r.split == s for r in got.values()) / len(got) for s in groupsplit.SPLITS}
    assert len(got) == 3300 and abs(share["train"] - 0.8) < 0.05 and len({got[5000 + i].split for i in range(300)}) == 1
    a, c = [i for i in range(3000) if got[i].split == "train"][:2]
    b = next(i for i in range(3000) if got[i].split == "test")
    new = _bring(spark, state, [(9001, f"P{a}", "new"), (9002, None, "new"), (9003, f"p{a}", "x"), (9004, f"P{b}", "x"), (9005, None, None), (9006, f"P{b}", None), (9007, f"P{c}", "far"), (9008, None, "far")])
    # x joins train with test, so both that hold it are quarantined; 9001 and 9002 hang on P_a alone once these are out
    assert all(new[k].quarantined and new[k].split is None for k in (9003, 9004))
    assert {new[k].split for k in (9001, 9002, 9007, 9008)} == {"train"} and new[9006].split == "test"
    assert new[9005].split in groupsplit.SPLITS and not new[9005].quarantined
    assert new[9001].group_key == new[9004].group_key == new[9006].group_key == min(a, b)
    # a record that itself holds entities of two splits
    again = _bring(spark, state, [(9101, f"P{a}", None), (9101, f"P{b}", None), (a, f"P{b}", None), (c, f"P{c}", None)])
    assert again[9101].quarantined and again[a].quarantined and again[c].split == "train"
    told = {r.record: r for r in state.assignments().collect()}
    assert told[a].split is None and len(told) == 3300 + 8 + 1
    assert state.table("components").agg(F.sum("size")).first()[0] == len(told)


def test_sizes_count_a_record_once(spark, tmp_path):
    state = _state(spark, tmp_path)
    _bring(spark, state, [(1, "A", None), (2, "A", None), (1, "A", None)])
    _bring(spark, state, [(2, "A", "L"), (3, None, "l"), (3, "a", None), (1, "A", None)])
    assert [(r.size, r.grp) for r in state.table("components").collect()] == [(3, 1)]


def test_restart_within_a_batch_and_compaction(spark, tmp_path, monkeypatch):
    rows = [(i, f"P{i // 3}", f"L{i // 40}") for i in range(400)]
    one, two = _state(spark, tmp_path / "one"), tmp_path / "two"
    _bring(spark, one, rows[::2])
    _bring(spark, _state(spark, two), rows[::2])
    (two / "state" / "v2" / "components").mkdir(parents=True)  # what a batch left that was interrupted
    monkeypatch.setattr(groupsplit, "COMPACT", 1)
    _bring(spark, one, rows[1::2])
    _bring(spark, _state(spark, two), rows[1::2])
    a, b = ({(r.record, r.component, r.split) for r in s.assignments().collect()} for s in (one, _state(spark, two)))
    assert a == b and len(a) == 400 and _state(spark, two).base == 3


def test_proportions(spark, tmp_path):
    state = _state(spark, tmp_path)
    for turn in (0, 1):
        _bring(spark, state, [(i, f"P{i // 2}", None) for i in range(turn, 8000, 2)])
    got = [r.split for r in state.assignments().collect()]
    assert all(abs(got.count(s) / 8000 - share) < 0.02 for s, share in groupsplit.SPLITS.items())


VEC = "grp string, id long, tokens array<long>, leaf int, block int"


def _cluster_brute(rows, s, smallest, least):
    top = {i: i for _, i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ok = [(g, i, set(t)) for g, i, t in rows if g is not None and t is not None and len(t) >= smallest]
    for x, (g, i, a) in enumerate(ok):
        for h, j, b in ok[x + 1 :]:
            if g == h and len(a & b) / len(a | b) >= s - 1e-9:
                top[find(i)] = find(j)
    groups = {}
    for _, i, _ in ok:
        groups.setdefault(find(i), set()).add(i)
    return {(i, min(m)) for m in groups.values() if len(m) >= least for i in m}


@pytest.mark.parametrize("block", [2048, 40])
def test_clusters_match_single_linkage(spark, block):
    rnd = random.Random(block)
    rows = []
    for i in range(260):
        g = "hot" if i % 2 else f"g{i % 5}"
        rows.append((g, i, _random_rows(random.Random(rnd.randint(0, 9)), 3, [12], 60)[rnd.randint(0, 2)][1][: rnd.randint(7, 12)]))
    rows += [(None, 900, [1, 2, 3, 4, 5, 6]), ("hot", 901, None), ("hot", 902, [1, 2])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VEC)
    got = {(r.id, r.cluster) for r in clusters.clusters(df, block=block).collect()}
    assert got == _cluster_brute(rows, 0.6, 6, 4)
    assert clusters.clusters(df.limit(0)).count() == 0


def test_links_hold_at_the_very_threshold():
    # unions of 5 to 500 positions of which exactly three in five are common, and one position less
    for union in range(5, 501, 5):
        for common, found in ((3 * union // 5, True), (3 * union // 5 - 1, False)):
            x = np.ones((2, union), np.float32)
            x[0, common:] = 0
            assert (clusters.connect(x, np.zeros(2, int), 0.6)[1] == 0) == found, (union, common)
            size = x.sum(axis=1)
            near = clusters.may_reach(x[:1], size[:1], x[1:], np.zeros(1), x[1:], np.zeros(1, np.float32), size[1:].astype(float), size[1:].astype(float), 0.6)
            assert near[0, 0] or not found


def test_tree_keeps_sums_and_splits():
    rng = np.random.default_rng(3)
    x = (rng.random((3000, 40)) < 0.3).astype(np.float32)
    tree = clusters.Tree(40, 1.5, branch=8)
    where = tree.insert(np.ones(3000), x, x.sum(axis=1))
    n, ls, ss = tree.entries()
    assert tree.root.kids is not None and len(n) == tree.count and where.min() >= 0
    assert np.array_equal(np.bincount(where, minlength=len(n)), n) and np.allclose(ls.sum(axis=0), x.sum(axis=0)) and np.isclose(ss.sum(), x.sum())
    n, ls, ss = clusters.condense(np.ones(3000), x, x.sum(axis=1), 1.0, 50)
    assert len(n) <= 50 and np.isclose(ls.sum(), ss.sum())
    assert (clusters.condense(np.ones(3000), x, x.sum(axis=1), 1.0, 50, last=True)[0] > 1).all()


def _many_clusters(n, kinds, seed=5):
    rng = np.random.default_rng(seed)
    base = [rng.choice(384, 14, replace=False) for _ in range(kinds)]
    out = []
    for i in range(n):
        t = set(base[int(rng.integers(kinds))].tolist() if rng.random() < 0.7 else rng.choice(384, 12, replace=False).tolist())
        for _ in range(int(rng.integers(0, 3))):
            t ^= {int(rng.integers(384))}
        out.append(("hot", i, sorted(t), 0, 0))
    return out


@pytest.mark.parametrize("kinds,outliers", [(1, 8192), (30, 100)])
def test_clusters_of_a_group_of_many_blocks(spark, kinds, outliers):
    rows = _many_clusters(1500, kinds)
    got = {(r.id, r.cluster) for r in clusters.clusters(spark.createDataFrame(rows, VEC), block=50, outliers=outliers).collect()}
    assert got == _cluster_brute([r[:3] for r in rows], 0.6, 6, 4)


def test_visits_grow_with_the_rows(spark):
    """A group of 50,000 records in blocks of 512: what is shuffled is about proportional to the records."""
    per_row = []
    for n in (12_500, 50_000):
        df = spark.createDataFrame(_many_clusters(n, 200), VEC)
        made = clusters.Clustering(df, similarity=0.6, block=512, radius=1.2, ward_radius=1.6)
        per_row.append(made.visits().count() / n)
    assert per_row[1] < 3 and per_row[1] < 1.5 * per_row[0]


def test_clusters_of_dense_vectors_at_the_threshold(spark):
    rows = [("g", i, list(range(51 if i else 85))) for i in range(4)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VEC)
    assert {(r.id, r.cluster) for r in clusters.clusters(df).collect()} == {(i, 0) for i in range(4)}


def test_conditions_count_poses_without_a_vector(spark, tmp_path):
    from fjordmill.llm import queries

    bits = [1] * 8
    rows = [(i, "a", bits, i) for i in range(4)] + [(3, "a", None, 9), (4, "a", None, 1), (4, "a", None, 2), (5, "a", [], 1), (6, "a", [1, 0], 1), (7, "b", None, 1)]
    spark.createDataFrame(rows, "pose_key long, condition_id string, ifp_lpmo_bitvector array<tinyint>, loaded_at long").write.parquet(str(tmp_path / "cbm_analysis_result.parquet"))
    got = {r.condition_id: (r.n_poses, r.n_clusters, round(r.noise_fraction, 9)) for r in queries.p7_conditions(spark, str(tmp_path)).collect()}
    assert got == {"a": (7, 1, round(3 / 7, 9)), "b": (1, 0, 1.0)}


def test_ward_and_medoids(spark):
    rows = [("g", i, [1, 2, 3, 4, 5, 6, 10 + i % 3]) for i in range(9)] + [("g", 20 + i, [50, 51, 52, 53, 54, 55, 60 + i % 2]) for i in range(8)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VEC)
    w = clusters.ward_clusters(df, radius=1.0, ward_radius=1.2).join(df.select("id", "tokens"), "id")
    label = {r.id: r.ward for r in w.collect()}
    assert len({label[i] for i in range(9)}) == 1 and len({label[20 + i] for i in range(8)}) == 1 and label[0] != label[20]
    told = clusters.describe(w.withColumn("cluster", F.col("ward").cast("long"))).collect()
    assert sorted(r.n for r in told) == [8, 9] and all(len(r.medoids) == 1 for r in told)


def test_ward_merges_nearest_first():
    n, ls = np.ones(4), np.array([[0.0, 0], [0, 1], [9, 9], [9, 10]])
    label = clusters.ward(n, ls, (ls * ls).sum(axis=1), 2.0)
    assert label[0] == label[1] and label[2] == label[3] and label[0] != label[2]
