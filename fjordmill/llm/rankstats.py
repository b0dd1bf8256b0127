"""Percentiles per group over very large columns, with a bounded and tracked rank error.

A summary of a group is a sorted list of tuples (value, up, down). For a kept value v, ``le(v)``, the sum of ``up``
over kept values at or below v, is a lower bound of the number of values <= v; ``lt(v)``, the sum of ``down`` over
kept values below v, is an upper bound of the number of values < v. Together they are the rank interval of v. In an
uncompressed summary both are exact. Between neighbours v < w at most ``lt(w) - le(v)`` values are hidden; the
largest such gap, as a share of the count, is the rank error, and it is carried with the result.

- Merging adds the tuples of equal value, so it is a sum by (group, value): associative, combinable over partitions,
  days or stored tables, and its gaps add up to the same share of the count.
- Compressing drops values as long as the gaps stay within the permitted share: ``up`` of a dropped value moves to
  the next kept value above, ``down`` to the one below. First and last values stay, so no row is ever lost.

Where a percentile is wanted without error, exact() takes a second look at the values: those below its bounds are only
counted, those within are counted per value, so no group is sorted as a whole.

Each partition is summarised with half the permitted error, partial summaries of one group are merged by salted
sub-groups, compressed, and merged again. Groups that hold more rows than a partition should are found by counting
and spread by a hash of the record key; every other group stays in one place.

Edge cases: null, not-a-number and infinite values are left out; values outside ``valid`` are too; groups with a null
key form one group; a group without values has no row; ties share one tuple; repeated records (equal record key) count
once; an empty table gives no rows; extra columns of any name are ignored. The same rows give the same summary in any
order of arrival up to compression, whose error bound always holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordmill.session import Workspace

TUPLES = "grp string, metric string, value double, up long, down long"
#: Rows that are summarised at once; a partition of any size takes this much memory.
CHUNK = 1 << 20


def _ranges(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])


def kept(up: np.ndarray, down: np.ndarray, error: float) -> np.ndarray:
    """Indices of the values of one sorted summary that compression leaves."""
    n, m = int(down.sum()), len(up)
    allowed = 2 * error * n
    if allowed < 1 or m < 3:
        return np.arange(m)
    le, lt = np.cumsum(up), np.cumsum(down) - down
    keep, i = [0], 0
    while i < m - 1:
        i = max(i + 1, int(np.searchsorted(lt, le[i] + allowed, "right")) - 1)
        keep.append(i)
    return np.array(keep)


def compress(group: np.ndarray, value: np.ndarray, up: np.ndarray, down: np.ndarray, error: float):
    """Compress many summaries that lie one after the other, sorted by group and value."""
    bounds = _ranges(group)
    totals = np.add.reduceat(down, bounds[:-1]) if len(group) else down
    picks = np.ones(len(group), bool)
    for g in np.nonzero((totals * 2 * error >= 1) & (np.diff(bounds) > 2))[0]:
        a, b = bounds[g], bounds[g + 1]
        picks[a:b] = False
        picks[a + kept(up[a:b], down[a:b], error)] = True
    at = np.nonzero(picks)[0]
    if len(at) == len(group):
        return group, value, up, down
    low = np.add.reduceat(down, at)  # dropped values above a kept one, up to the next; the first of a group is kept
    up_to = np.concatenate([[0], np.cumsum(up)])
    high = up_to[at + 1] - np.concatenate([[0], up_to[at[:-1] + 1]])
    return group[at], value[at], high, low


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """One integer per distinct combination of the text columns, and the columns of the distinct combinations."""
    code, uniques = None, []
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode") if not pa.types.is_dictionary(c.type) else c
        i = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        uniques.append((d.dictionary, i))
        code = i if code is None else code * (len(d.dictionary) + 1) + i
    distinct, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return inverse, [dic.take(pa.array(i[first])) for dic, i in uniques]


def _summarise(error: float):
    """(grp, metric, value) batches, in any order -> tuples; one summary per CHUNK rows and group."""

    def flush(rows):
        t = pa.Table.from_batches(rows).combine_chunks()
        g, keys = _codes([t.column(0).combine_chunks(), t.column(1).combine_chunks()])
        v = t.column(2).to_numpy()
        order = np.lexsort((v, g))
        g, v = g[order], v[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        at = np.nonzero(new)[0]
        n = np.diff(np.concatenate([at, [len(v)]]))
        g, v, up, down = compress(g[at], v[at], n, n, error)
        take = pa.array(g)
        return pa.RecordBatch.from_arrays([keys[0].take(take), keys[1].take(take), pa.array(v), pa.array(up), pa.array(down)], names=["grp", "metric", "value", "up", "down"])

    def run(batches):
        rows, n = [], 0
        for b in batches:
            rows.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield flush(rows)
                rows, n = [], 0
        if n:
            yield flush(rows)

    return run


def _by_group(batches, n_keys: int):
    """Batches sorted by the leading key columns, cut so that no group is divided. A group here is a set of
    compressed summaries, whose size is bounded by the error, not by the data."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        last = [t.column(i)[t.num_rows - 1].as_py() for i in range(n_keys)]
        lo, hi = 0, t.num_rows - 1
        while lo < hi:  # the first row of the last group
            mid = (lo + hi) // 2
            if [t.column(i)[mid].as_py() for i in range(n_keys)] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield t.slice(0, lo).combine_chunks()
        held = t.slice(lo)
    if held is not None:
        yield held.combine_chunks()


def _runs(t: pa.Table, n_keys: int) -> np.ndarray:
    """A number per row that changes where a key column changes."""
    new = np.zeros(t.num_rows, bool)
    for i in range(n_keys):
        c = t.column(i).combine_chunks()
        d = (c if pa.types.is_integer(c.type) else c.dictionary_encode(null_encoding="encode").indices).to_numpy(zero_copy_only=False)
        new[1:] |= d[1:] != d[:-1]
    return np.cumsum(new)


def _recompress(error: float):
    """Tuples sorted by grp, metric, salt, value -> compressed tuples per grp, metric."""

    def run(batches):
        for t in _by_group(batches, 3):
            g = _runs(t, 3)
            row = np.arange(t.num_rows)
            v, up, down = (t.column(i).to_numpy() for i in (3, 4, 5))
            _, at, up2, down2 = compress(g, row, up, down, error)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(take), t.column(1).combine_chunks().take(take), pa.array(v[at]), pa.array(up2), pa.array(down2)], names=["grp", "metric", "value", "up", "down"])

    return run


def bounds_of(value: np.ndarray, up: np.ndarray, down: np.ndarray, rank: int) -> tuple[float, float]:
    """Values between which the rank-th smallest lies (equal where it is known)."""
    le, lt = np.cumsum(up), np.cumsum(down) - down
    return value[np.searchsorted(lt, rank, "left") - 1], value[np.searchsorted(le, rank, "left")]


def _query(percents: list[float]):
    def run(batches):
        for t in _by_group(batches, 2):
            g = _runs(t, 2)
            v, up, down = (t.column(i).to_numpy() for i in (2, 3, 4))
            cut = _ranges(g)
            rows = []
            for a, b in zip(cut[:-1], cut[1:]):
                n = int(down[a:b].sum())
                le, lt = np.cumsum(up[a:b]), np.cumsum(down[a:b]) - down[a:b]
                gap = int((lt[1:] - le[:-1]).max(initial=0))
                for p in percents:
                    # linear interpolation between the two middle ranks; each is known within its bounds
                    at = p * (n - 1)
                    k = int(np.floor(at)) + 1
                    w = at - (k - 1)
                    ks = (k, min(k + 1, n)) if w > 0 else (k, k)
                    lo = [v[a + np.searchsorted(lt, r, "left") - 1] for r in ks]
                    hi = [v[a + np.searchsorted(le, r, "left")] for r in ks]
                    low, high = lo[0] + (lo[1] - lo[0]) * w, hi[0] + (hi[1] - hi[0]) * w
                    rows.append((a, p, n, low, high, (low + high) / 2, gap / n, lo[0], hi[1]))
            cols = list(zip(*rows)) or [()] * 9
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [t.column(0).combine_chunks().take(take), t.column(1).combine_chunks().take(take), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:])],
                names=["grp", "metric", "percent", "n", "low", "high", "estimate", "rank_error", "least", "most"],
            )

    return run


def long_form(df: DataFrame, group: list, metrics: list[str], *, record: str, valid: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(grp, metric, value), one row per record and metric with a usable value. group: columns, joined by a tab.

    Records that come repeatedly count once; the shuffle that brings them together also places the groups.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grp = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group))
    rows = df.select(grp.alias("grp"), F.col(record).alias("record"), *(F.col(m).cast("double").alias(m) for m in metrics))
    # groups above a fair share of the rows: fewer than the number of partitions, so small enough to broadcast
    counts = Workspace(spark, "groups").put(rows.groupBy("grp").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * parts > total).select("grp", F.lit(True).alias("hot"))
    salted = rows.join(F.broadcast(hot), "grp", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("record"), F.lit(parts))).otherwise(F.lit(0)))
    placed = salted.repartition(parts, "grp", "salt")
    once = placed.groupBy("grp", "salt", "record").agg(*(F.max(m).alias(m) for m in metrics))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("p")
    flat = once.select("grp", pairs).select("grp", "p.metric", "p.value").where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    for m, (lo, hi) in (valid or {}).items():
        flat = flat.where((F.col("metric") != m) | F.col("value").between(lo, hi))
    return flat


def summarise(flat: DataFrame, error: float = 0.005, fan: int = 16) -> DataFrame:
    """(grp, metric, value, up, down): a summary per group whose rank error is at most ``2 * error`` of its count."""
    local = flat.select("grp", "metric", "value").mapInArrow(_summarise(error / 2), TUPLES)
    return merge(local, error, fan)


def merge(tuples: DataFrame, error: float = 0.005, fan: int = 16) -> DataFrame:
    """Merge summaries of any origin: by salted sub-groups, compressed with three quarters of the permitted error,
    then by group with all of it."""
    salted = tuples.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan)))
    first = salted.groupBy("grp", "metric", "salt", "value").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    level = _level(first, ["grp", "metric", "salt"], error * 0.75)
    return _level(level.groupBy("grp", "metric", "value").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).withColumn("salt", F.lit(0)), ["grp", "metric"], error)


def _level(df: DataFrame, keys: list[str], error: float) -> DataFrame:
    ordered = df.select("grp", "metric", "salt", "value", "up", "down").repartition(*keys).sortWithinPartitions("grp", "metric", "salt", "value")
    return ordered.mapInArrow(_recompress(error), TUPLES)


def percentiles(summary: DataFrame, percents: list[float]) -> DataFrame:
    """(grp, metric, percent, n, low, high, estimate, rank_error, least, most): the true percentile lies between low and
    high, and the values on both sides of its rank between least and most."""
    ordered = summary.repartition("grp", "metric").sortWithinPartitions("grp", "metric", "value")
    return ordered.mapInArrow(_query(percents), "grp string, metric string, percent double, n long, low double, high double, estimate double, rank_error double, least double, most double")


def exact(flat: DataFrame, bounds: DataFrame) -> DataFrame:
    """(grp, metric, percent, n, value) without error: flat is what the bounds (from percentiles) were made of."""
    keys = ["grp", "metric", "percent"]
    rows = flat.join(bounds.select(*keys, "least", "most"), ["grp", "metric"]).where(F.col("value") <= F.col("most"))
    inside = F.col("value") >= F.col("least")
    # one row per value within the bounds, and one for all below them
    steps = rows.groupBy(*keys, F.when(inside, F.col("value")).alias("value")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = steps.withColumn("upto", upto).where("value is not null").join(bounds.select(*keys, "n"), keys)
    at = F.col("percent") * (F.col("n") - 1)
    k = F.floor(at) + 1
    told = ranked.groupBy(*keys, "n").agg(F.min(F.when(F.col("upto") >= k, F.col("value"))).alias("a"), F.min(F.when(F.col("upto") >= F.least(k + 1, F.col("n")), F.col("value"))).alias("b"))
    w = at - F.floor(at)
    return told.select(*keys, "n", F.when(w > 0, F.col("a") + (F.col("b") - F.col("a")) * w).otherwise(F.col("a")).alias("value"))


def differing(reported: DataFrame, key: str, column: str, bounds: DataFrame, exact_rows: DataFrame, tolerance: float, work: Workspace) -> DataFrame:
    """Keys whose reported value differs from the true one by more than the tolerance.

    bounds: of one percentile and metric. Where they decide, they do; the keys they leave open are looked up exactly in
    exact_rows, what the bounds were made of. If they leave none open, the rows aren't read again."""
    told = reported.where(F.col(column).isNotNull()).select(F.col(key).alias("grp"), F.col(column).cast("double").alias("told")).distinct()
    near = told.join(bounds, "grp")
    surely = (F.col("told") < F.col("low") - tolerance) | (F.col("told") > F.col("high") + tolerance)
    surely_not = (F.col("told") >= F.col("high") - tolerance) & (F.col("told") <= F.col("low") + tolerance)
    near = work.put(near.where(~surely_not).withColumn("sure", surely), "near")
    sure, open_ = near.where("sure").select("grp"), near.where("not sure")
    if open_.isEmpty():
        return sure.distinct()
    groups = open_.select("grp").distinct()
    true = exact(exact_rows.join(groups, "grp", "left_semi"), bounds.join(groups, "grp", "left_semi"))
    return sure.unionByName(open_.select("grp", "told").join(true.select("grp", "value"), "grp").where(F.abs(F.col("told") - F.col("value")) > tolerance).select("grp")).distinct()
