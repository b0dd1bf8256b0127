"""Rank statistics as plans, and the numerics that need arrays as grouped functions.

Sums over ranks are exact aggregations; tails of distributions (normal, t, binomial, signed ranks) are computed with
numpy and math alone. Resampling uses numpy's default generator with a seed per group, so runs repeat.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordmill.operators.relational import average_rank


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def sign_test(pos: int, neg: int) -> float:
    """Exact two-sided binomial test of equal signs."""
    n, k = pos + neg, min(pos, neg)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2.0)[inverse]


def wilcoxon(values: np.ndarray) -> tuple[float, float]:
    """(W, p) of the signed-rank test, zeros left out: exact below 26 values without ties, else normal with ties."""
    x = values[values != 0]
    n = len(x)
    if not n:
        return 0.0, 1.0
    r = ranks(np.abs(x))
    w = min(r[x > 0].sum(), r[x < 0].sum())
    _, ties = np.unique(np.abs(x), return_counts=True)
    if n <= 25 and (ties == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return float(w), float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return float(w), normal_sf2((w - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else 1.0


def bootstrap_median(values: np.ndarray, resamples: int = 10_000, seed: int = 42, least: int = 8) -> tuple[float, float]:
    """95 % interval of the median; nan below ``least`` values."""
    if len(values) < least:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    medians = np.concatenate([np.median(values[rng.integers(0, len(values), (min(1000, resamples - i), len(values)))], axis=1) for i in range(0, resamples, 1000)])
    return float(np.percentile(medians, 2.5)), float(np.percentile(medians, 97.5))


def permutation_p(values: np.ndarray, labels: np.ndarray, statistic, permutations: int = 10_000, seed: int = 42) -> float:
    """Share of label permutations whose statistic is at least as large as the observed one (with the observed)."""
    rng, seen = np.random.default_rng(seed), abs(statistic(values, labels))
    return (1 + sum(abs(statistic(values, rng.permutation(labels))) >= seen - 1e-12 for _ in range(permutations))) / (permutations + 1)


def median_difference(values: np.ndarray, labels: np.ndarray) -> float:
    return float(np.median(values[labels == 1]) - np.median(values[labels == 0]))


def kruskal_h(values: np.ndarray, labels: np.ndarray) -> float:
    r, n = ranks(values), len(values)
    h = 12 / (n * (n + 1)) * sum(r[labels == g].sum() ** 2 / (labels == g).sum() for g in np.unique(labels)) - 3 * (n + 1)
    _, ties = np.unique(values, return_counts=True)
    c = 1 - (ties**3 - ties).sum() / (n**3 - n)
    return h / c if c > 0 else 0.0


def permutation_pair(values: np.ndarray, labels: np.ndarray, permutations: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """permutation_p of median_difference and of kruskal_h over the same permutations. Values are sorted and ranked
    once: a permutation only moves labels over the sorted values, so it costs one shuffle and sums of ranks."""
    order = np.argsort(values, kind="stable")
    x, y = values[order], labels[order]
    r, n, (kinds, at) = ranks(x), len(x), np.unique(y, return_inverse=True)
    size = np.bincount(at)
    _, ties = np.unique(x, return_counts=True)
    c = 1 - (ties**3 - ties).sum() / (n**3 - n)

    def middle(own: np.ndarray) -> float:
        return (x[own[(len(own) - 1) // 2]] + x[own[len(own) // 2]]) / 2

    def statistics(a: np.ndarray) -> tuple[float, float]:
        one, two = np.flatnonzero(kinds[a] == 1), np.flatnonzero(kinds[a] == 0)
        h = 12 / (n * (n + 1)) * sum(np.bincount(a, weights=r) ** 2 / size) - 3 * (n + 1)
        return abs(middle(one) - middle(two)) if len(one) and len(two) else np.nan, abs(h / c if c > 0 else 0.0)

    rng, seen, hits = np.random.default_rng(seed), np.array(statistics(at)) - 1e-12, np.zeros(2)
    for _ in range(permutations):
        hits += np.array(statistics(rng.permutation(at))) >= seen
    median_p, kruskal_p = ((1 + hits) / (permutations + 1)).tolist()
    return (median_p if seen[0] == seen[0] else math.nan), kruskal_p


# ---- plans -----------------------------------------------------------------------------------------------------


def ranked(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Average ranks from counts per distinct value: the window runs over values, not rows."""
    n = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("_n").over(w), F.lit(0))
    return n.withColumn("_rank", low + (F.col("_n") + 1) / 2.0).select(*group, value, "_rank", F.col("_n").alias("_ties"))


def two_sample(df: DataFrame, value: str, label: str, group: list[str]) -> DataFrame:
    """(group, n1, n0, auc, cliffs_delta) of the values with label 1 against those with label 0."""
    sub = df.where(F.col(value).isNotNull() & F.col(label).isin(0, 1))
    r = sub.groupBy(*group, value, label).agg(F.count("*").alias("_k")).join(ranked(sub, value, group), [*group, value])
    s = r.groupBy(*group).agg(F.sum(F.when(F.col(label) == 1, F.col("_k") * F.col("_rank"))).alias("_r1"), F.sum(F.when(F.col(label) == 1, F.col("_k")).otherwise(0)).alias("n1"), F.sum(F.when(F.col(label) == 0, F.col("_k")).otherwise(0)).alias("n0"))
    auc = (F.col("_r1") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1") * F.col("n0"))
    return s.where("n1 > 0 and n0 > 0").select(*group, "n1", "n0", auc.alias("auc"), (2 * auc - 1).alias("cliffs_delta"))


def average_precision(df: DataFrame, score: str, label: str, group: list[str]) -> DataFrame:
    """Area under precision-recall steps, tied scores at once."""
    per = df.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy(F.desc(score))
    t = per.withColumn("_tp", F.sum("_p").over(w)).withColumn("_all", F.sum("_n").over(w))
    return t.groupBy(*group).agg(F.try_divide(F.sum(F.col("_p") * F.col("_tp") / F.col("_all")), F.sum("_p")).alias("average_precision"))


def kruskal(df: DataFrame, value: str, label: str, group: list[str]) -> DataFrame:
    """(group, h): Kruskal-Wallis with correction for ties."""
    sub = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    r = ranked(sub, value, group)
    ties = r.groupBy(*group).agg(F.sum(F.pow(F.col("_ties").cast("double"), 3) - F.col("_ties")).alias("_t"), F.sum("_ties").alias("_n"))
    per = sub.join(r, [*group, value]).groupBy(*group, label).agg(F.sum("_rank").alias("_s"), F.count("*").alias("_k"))
    h = per.groupBy(*group).agg(F.sum(F.col("_s") * F.col("_s") / F.col("_k")).alias("_q")).join(ties, group)
    n = F.col("_n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    c = 1 - F.coalesce(F.try_divide(F.col("_t"), n * n * n - n), F.lit(1.0))
    return h.select(*group, F.when(c > 0, raw / c).otherwise(0.0).alias("h"))


def correlation(x, y):
    """Aggregate: Pearson's r over rows with both values; null where either doesn't vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(a, b) / (sx * sy))


def rank_biserial(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, n, effect): signed rank sums over their total, zeros left out."""
    x = df.where((F.col(value) != 0)).select(*group, F.abs(value).alias("_a"), F.signum(value).alias("_s"))
    r = x.join(ranked(x, "_a", group), [*group, "_a"])
    return r.groupBy(*group).agg(F.count("*").alias("n"), (F.sum(F.col("_s") * F.col("_rank")) / F.sum("_rank")).alias("effect"))


def pairwise_auc(df: DataFrame, value: str, label: str, names: list) -> DataFrame:
    """(a, b, auc) for every two groups: how often a value of a exceeds one of b. Counts per distinct value are run
    up once per group b, so rows of two groups are never paired."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v"), F.col(label).alias("a")).agg(F.count("*").alias("k"))
    each = c.withColumn("b", F.explode(F.array(*(F.lit(n) for n in names))))
    w = Window.partitionBy("b").orderBy("v")
    mine = F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0)
    below = F.coalesce(F.sum(mine).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))
    same = F.sum(mine).over(Window.partitionBy("b", "v"))
    t = each.withColumn("u", F.col("k") * (below - same / 2.0))
    n = c.groupBy("a").agg(F.sum("k").alias("n"))
    return t.where("a <> b").groupBy("a", "b").agg(F.sum("u").alias("u")).join(n.select("a", F.col("n").alias("na")), "a").join(n.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("u") / (F.col("na") * F.col("nb"))).alias("auc"))


def paired_tests(df: DataFrame, value: str, group: list[str], resamples: int = 10_000) -> DataFrame:
    """Per group the Wilcoxon and sign tests, and the bootstrap interval of the median. A group is a study's set of
    pairs; its differences are the work of one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].dropna().to_numpy(float))
        w, p = wilcoxon(x)
        lo, hi = bootstrap_median(x, resamples)
        return pd.DataFrame([[*pdf[group].iloc[0], len(x), w, p, sign_test(int((x > 0).sum()), int((x < 0).sum())), lo, hi]])

    fields = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group)
    return df.select(*group, value).groupBy(*group).applyInPandas(run, f"{fields}, n long, w double, wilcoxon_p double, sign_p double, median_low double, median_high double")


def permutation_tests(df: DataFrame, value: str, label: str, group: list[str], permutations: int = 10_000) -> DataFrame:
    """Per group the permutation p of the median difference and of Kruskal-Wallis H."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value, label]).sort_values([value, label])
        x, y = pdf[value].to_numpy(float), pdf[label].to_numpy(int)
        if len(np.unique(y)) < 2:
            return pd.DataFrame([], columns=["a"] * 0)
        return pd.DataFrame([[*pdf[group].iloc[0], len(x), *permutation_pair(x, y, permutations)]])

    fields = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group)
    return df.select(*group, value, label).groupBy(*group).applyInPandas(run, f"{fields}, n long, median_p double, kruskal_p double")


def welch(df: DataFrame, value: str, label: str, group: list[str]) -> DataFrame:
    """(group, t, df, p): Welch's t of label 1 against label 0; the sums are an aggregation, only the tail is Python."""
    one, two = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    s = df.groupBy(*group).agg(F.avg(one).alias("m1"), F.avg(two).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v0"), F.count(one).alias("n1"), F.count(two).alias("n0"))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    s = s.where("n1 > 1 and n0 > 1 and v1 + v0 > 0").select(*group, ((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), ((a + b) ** 2 / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("df"))

    @F.pandas_udf("double")
    def tail(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([t_sf2(x, y) for x, y in zip(t, d)])

    return s.withColumn("p", tail("t", "df"))


def two_way_anova(df: DataFrame, value: str, a: str, b: str) -> pd.DataFrame:
    """Partial F of two factors and their interaction, from cell counts, sums and squares (one small row per cell)."""
    c = df.where(F.col(value).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).orderBy(a, b).toPandas()
    la, lb = sorted(c[a].unique()), sorted(c[b].unique())
    da = np.array([[float(x == v) for v in la[1:]] for x in c[a]])
    db = np.array([[float(x == v) for v in lb[1:]] for x in c[b]])
    one = np.ones((len(c), 1))
    cross = (da[:, :, None] * db[:, None, :]).reshape(len(c), -1)

    def sse(x: np.ndarray) -> tuple[float, int]:
        w = np.sqrt(c["n"].to_numpy(float))
        coef, *_ = np.linalg.lstsq(x * w[:, None], c["s"].to_numpy() / c["n"].to_numpy() * w, rcond=None)
        fit = x @ coef
        return float((c["q"] - 2 * fit * c["s"] + c["n"] * fit**2).sum()), int(np.linalg.matrix_rank(x * w[:, None]))

    full, main = sse(np.hstack([one, da, db, cross])), sse(np.hstack([one, da, db]))
    n, out = int(c["n"].sum()), []
    for term, (small, large) in {a: (sse(np.hstack([one, db])), main), b: (sse(np.hstack([one, da])), main), f"{a}:{b}": (main, full)}.items():
        d1, d2 = large[1] - small[1], n - large[1]
        f = (small[0] - large[0]) / d1 / (large[0] / d2) if d1 and d2 and large[0] > 0 else math.nan
        out.append((term, f, d1, d2, f_sf(f, d1, d2) if f == f else math.nan))
    return pd.DataFrame(out, columns=["term", "f", "df1", "df2", "p"])


# ---- tests over any number of rows -----------------------------------------------------------------------------


def _udf(f):
    """Tails of distributions: one value per group, computed in batches."""
    return F.pandas_udf(f, "double")


def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: normal_sf2(v) if v == v else math.nan)


def _sign_tail(pos: pd.Series, neg: pd.Series) -> pd.Series:
    """Exact two-sided binomial test, by the incomplete beta function."""
    tail = lambda k, n: min(1.0, 2 * beta_inc(n - k, k + 1, 0.5)) if n else 1.0
    return pd.Series([1.0 if a == b else tail(min(a, b), a + b) for a, b in zip(pos, neg)])


def _signed_rank_tail(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    out = []
    for x, m, t in zip(w, n, ties):
        if not m or m != m:
            out.append(1.0)
        elif m <= 25 and not t:
            ways = np.zeros(int(m * (m + 1) // 2) + 1)
            ways[0] = 1
            for k in range(1, int(m) + 1):
                ways[k:] += ways[:-k].copy()
            out.append(min(1.0, 2 * ways[: int(x) + 1].sum() / 2**m))
        else:
            var = m * (m + 1) * (2 * m + 1) / 24 - t / 48
            out.append(normal_sf2((x - m * (m + 1) / 4) / math.sqrt(var)) if var > 0 else 1.0)
    return pd.Series(out)


def signed_rank(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, n_nonzero, w, wilcoxon_p, effect): Wilcoxon's signed ranks, zeros left out. Ranks come from counts per
    distinct value, so only the tail is Python: exact up to 25 values without ties, else normal with ties."""
    x = df.where(F.col(value) != 0).select(*group, F.abs(value).alias("_a"), F.signum(value).alias("_s"))
    r = ranked(x, "_a", group)
    side = x.groupBy(*group, "_a", "_s").agg(F.count("*").alias("_k")).join(r, [*group, "_a"])
    sums = side.groupBy(*group).agg(F.sum(F.when(F.col("_s") > 0, F.col("_k") * F.col("_rank")).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col("_s") < 0, F.col("_k") * F.col("_rank")).otherwise(0.0)).alias("_m"), F.sum("_k").alias("n_nonzero"))
    ties = r.groupBy(*group).agg(F.sum(F.pow(F.col("_ties").cast("double"), 3) - F.col("_ties")).alias("_t"))
    got = sums.join(ties, group).withColumn("w", F.least("_p", "_m"))
    return got.select(*group, "n_nonzero", "w", _udf(_signed_rank_tail)("w", F.col("n_nonzero").cast("double"), "_t").alias("wilcoxon_p"), ((F.col("_p") - F.col("_m")) / (F.col("_p") + F.col("_m"))).alias("effect"))


def endpoint_summary(df: DataFrame, metric: str, value: str, alpha: float = 0.05, least: int = 8) -> DataFrame:
    """One row per endpoint of paired differences: n, median, mean, std, quartiles, range, signs, the sign test (from
    ``least`` pairs), the signed-rank test (from ``least`` differences that are not 0) with its effect, which test counts,
    and false-discovery rates over the endpoints."""
    from fjordmill.operators.relational import benjamini_hochberg

    v = F.col(value)
    s = df.where(v.isNotNull()).groupBy(metric).agg(
        F.count("*").alias("n_pairs"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.when(F.count("*") > 1, F.stddev_samp(v)).otherwise(0.0).alias("std"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.count_if(v > 0).alias("n_positive_delta"), F.count_if(v < 0).alias("n_negative_delta"), F.count_if(v == 0).alias("n_zero_delta"),
    )
    sign = F.when((F.col("n_pairs") >= least) & (F.col("n_positive_delta") + F.col("n_negative_delta") > 0), _udf(_sign_tail)(F.col("n_positive_delta").cast("double"), F.col("n_negative_delta").cast("double")))
    got = s.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("sign_test_p_value", sign).join(signed_rank(df, value, [metric]), metric, "left")
    enough = F.coalesce("n_nonzero", F.lit(0)) >= least
    got = got.withColumns({"wilcoxon_p_value": F.when(enough, F.col("wilcoxon_p")), "effect_size_rank_biserial": F.when(enough, F.col("effect"))}).drop("n_nonzero", "w", "wilcoxon_p", "effect")
    test = F.when(F.col("wilcoxon_p_value").isNotNull(), "paired_wilcoxon_signed_rank").when(F.col("n_pairs") >= least, "sign_test").otherwise("none")
    told = benjamini_hochberg(got.where("wilcoxon_p_value is not null").select(metric, "wilcoxon_p_value"), "wilcoxon_p_value", "bh_fdr_p_value")  # one row per endpoint
    return got.withColumn("statistical_test", test).join(told.select(metric, "bh_fdr_p_value"), metric, "left").withColumn("significant", F.col("bh_fdr_p_value") <= alpha)


def paired_compare(df: DataFrame, metrics: dict[str, tuple[str, str]], alpha: float = 0.05, least: int = 3) -> DataFrame:
    """One row per metric with ``least`` pairs or more: means of both sides and of their difference, its standard
    deviation, the signed-rank test (1 and no effect below ``least`` differences that are not 0) and whether it is
    significant. metrics: name -> (column of side a, column of side b)."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_name"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for m, (a, b) in metrics.items()))).alias("s")
    rows = df.select(each).select("s.*").where("a is not null and b is not null").withColumn("d", F.round(F.col("b") - F.col("a"), 9))  # equal differences are ties, whatever the arithmetic
    s = rows.groupBy("metric_name").agg(F.count("*").alias("n_pairs"), F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"), F.avg("d").alias("difference_mean"), F.stddev_pop("d").alias("difference_std")).where(F.col("n_pairs") >= least)
    got = s.join(signed_rank(rows, "d", ["metric_name"]), "metric_name", "left")
    enough = F.coalesce("n_nonzero", F.lit(0)) >= 3
    got = got.withColumns({"p_value": F.when(enough, F.col("wilcoxon_p")).otherwise(1.0), "effect_size": F.when(enough, F.col("effect")).otherwise(0.0)})
    return got.select(*s.columns, "p_value", "effect_size", (F.col("p_value") < alpha).alias("significant"))


def correlations(df: DataFrame, x: str, y: str, group: list[str], flag_x=None, flag_y=None) -> DataFrame:
    """(group, n, pearson, pearson_p, spearman, spearman_p) with p by Fisher's z, and for two flags phi and the four
    counts. Null where a side doesn't vary; p needs four rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    told = rows.join(ranked(rows, x, group).select(*group, x, F.col("_rank").alias("_rx")), [*group, x]).join(ranked(rows, y, group).select(*group, y, F.col("_rank").alias("_ry")), [*group, y])
    aggs = [F.count("*").alias("n"), correlation(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"), correlation(F.col("_rx"), F.col("_ry")).alias("spearman")]
    if flag_x is not None:
        num = lambda c: F.when(c, 1.0).otherwise(0.0)
        aggs.append(correlation(num(flag_x), num(flag_y)).alias("phi"))
        aggs += [F.count_if(a & b).alias(n) for n, a, b in (("n11", flag_x, flag_y), ("n10", flag_x, ~flag_y), ("n01", ~flag_x, flag_y), ("n00", ~flag_x, ~flag_y))]
    got = told.groupBy(*group).agg(*aggs)
    z = lambda r: F.when((F.col("n") > 3) & (F.abs(r) < 1 - 1e-12), F.atanh(r) * F.sqrt(F.col("n") - 3))
    p = lambda r: F.when(F.abs(F.col(r)) >= 1 - 1e-12, F.when(F.col("n") > 3, 0.0)).when(z(F.col(r)).isNotNull(), _udf(_normal_tail)(F.coalesce(z(F.col(r)), F.lit(0.0))))
    return got.withColumns({"pearson_p": p("pearson"), "spearman_p": p("spearman")})
