"""Clustering of distance matrices and grouped cross-validation, one group at a time.

A group is a condition's or a run's records: these algorithms need all distances of a group at once, so they are
grouped functions over one task's arrays and meant for groups of a few thousand at most; for larger ones there are
summary-based clusters. Labels are renumbered by first appearance, -1 is noise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordmill.operators.statistics import average_precision
from fjordmill.session import Workspace


def jaccard(bits: np.ndarray) -> np.ndarray:
    """Pairwise Jaccard distances of rows of 0 and 1; two empty rows are 0 apart."""
    x = bits.astype(np.float64)
    common, size = x @ x.T, x.sum(axis=1)
    either = size[:, None] + size[None] - common
    return np.where(either > 0, 1 - common / np.maximum(either, 1), 0.0)


def renumber(labels: np.ndarray) -> np.ndarray:
    """Labels from 0 by first appearance; -1 stays."""
    seen: dict[int, int] = {}
    return np.array([-1 if v < 0 else seen.setdefault(int(v), len(seen)) for v in labels], np.int64)


def small_as_noise(labels: np.ndarray, least: int) -> np.ndarray:
    kinds, counts = np.unique(labels, return_counts=True)
    return np.where(np.isin(labels, kinds[counts < least]), -1, labels)


def average_linkage(distance: np.ndarray, threshold: float, least: int = 2) -> np.ndarray:
    """Average-linkage agglomeration up to a distance, then clusters below ``least`` become noise."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, size = np.arange(n), np.ones(n)
    while n > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
    return renumber(small_as_noise(label, least))


def density_clusters(distance: np.ndarray, min_size: int = 5) -> np.ndarray:
    """Hierarchical density clustering: mutual reachability, minimum spanning tree, condensed tree, excess of mass;
    one cluster may be all. Below ``min_size`` records all are noise; equal records are one cluster."""
    n = len(distance)
    if n < min_size:
        return np.full(n, -1)
    if not distance.any():
        return np.zeros(n, np.int64)
    core = np.sort(distance, axis=1)[:, min(min_size, n) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), distance)
    # Prim's tree
    near, parent, inside = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    edges = []
    for _ in range(n - 1):
        near[inside] = np.inf
        j = int(near.argmin())
        edges.append((near[j], parent[j], j))
        inside[j] = True
        closer = (reach[j] < near) & ~inside
        near[closer], parent[closer] = reach[j][closer], j
    # single-linkage tree: node n + k joins two at a distance
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    left, right, height, size = {}, {}, {}, {i: 1 for i in range(n)}
    for k, (h, a, b) in enumerate(sorted(edges, key=lambda e: (e[0], e[1], e[2]))):
        a, b, new = find(a), find(b), n + k
        top.append(new)
        top[a] = top[b] = new
        left[new], right[new], height[new], size[new] = a, b, h, size[a] + size[b]

    def leaves(x):
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += [left[y], right[y]]
        return out

    # condensed tree: clusters with the density at which they begin, members with the density at which they leave
    begin, stability, children, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            continue
        lam = 1 / height[node] if height[node] > 0 else 1e12
        big = [c for c in (left[node], right[node]) if size[c] >= min_size]
        for c in (left[node], right[node]):
            if size[c] < min_size:
                own = leaves(c)
                stability[cluster] += len(own) * (lam - begin[cluster])
                members[cluster] += own
        if len(big) == 2:
            for c in big:
                new = len(begin)
                begin[new], stability[new], children[new], members[new] = lam, 0.0, [], []
                children[cluster].append(new)
                stability[cluster] += size[c] * (lam - begin[cluster])
                todo.append((c, new))
        elif big:
            todo.append((big[0], cluster))
    chosen = {}
    for c in sorted(begin, reverse=True):
        below = sum(stability[k] for k in children[c])
        chosen[c] = not children[c] or stability[c] >= below
        stability[c] = max(stability[c], below)
    labels = np.full(n, -1, np.int64)

    def paint(c, label):
        todo = [c]
        while todo:
            x = todo.pop()
            labels[members[x]] = label
            todo += children[x]

    todo = [0]
    while todo:
        c = todo.pop()
        if chosen[c]:
            paint(c, c)
        else:
            todo += children[c]
    return renumber(labels)


def medoids(distance: np.ndarray, labels: np.ndarray) -> dict[int, tuple[int, float]]:
    """Per label the member with the least sum of distances within it, and the sum; ties go to the lowest index."""
    out = {}
    for v in np.unique(labels[labels >= 0]):
        own = np.nonzero(labels == v)[0]
        s = distance[np.ix_(own, own)].sum(axis=1)
        out[int(v)] = int(own[s.argmin()]), float(s.min())
    return out


def cluster_groups(df: DataFrame, group: str, key: str, vector: str, method: str, **options) -> DataFrame:
    """(group, key, label, medoid, distance): labels of each group's records by the named method."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        d = jaccard(np.stack([np.asarray(v) > 0 for v in pdf[vector]]))
        labels = average_linkage(d, **options) if method == "average" else density_clusters(d, **options)
        center = medoids(d, labels)
        keys = pdf[key].to_numpy()
        far = [float(d[i, center[int(v)][0]]) if v >= 0 else np.nan for i, v in enumerate(labels)]
        medoid = pd.array([keys[center[int(v)][0]] if v >= 0 else None for v in labels], dtype="Int64")
        return pd.DataFrame({group: pdf[group].to_numpy(), key: keys, "label": labels, "medoid": medoid, "distance": far})

    g, k = (df.schema[c].dataType.simpleString() for c in (group, key))
    return df.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {g}, {key} {k}, label long, medoid long, distance double")


def greedy_folds(pdf: pd.DataFrame, unit: str, label: str, folds: int) -> dict:
    """Unit -> fold. A unit is positive, negative or mixed by its rows; of each kind the largest units go first, each to
    the fold that has least of its kind, then least of all."""
    per = pdf.groupby(unit)[label].agg(["size", "min", "max"]).reset_index()
    per["kind"] = np.where(per["min"] == per["max"], per["max"].astype(int), 2)
    load, out = np.zeros((3, folds)), {}
    for u, n, kind in per.sort_values(["kind", "size", unit], ascending=[False, False, True])[[unit, "size", "kind"]].itertuples(index=False):
        f = int(np.lexsort((load.sum(axis=0), load[kind]))[0])
        load[kind][f] += n
        out[u] = f
    return out


def balanced_folds(df: DataFrame, run: str, unit: str, label: str, folds: int = 5) -> DataFrame:
    """(run, unit, fold): see greedy_folds. A run's units are the work of one task."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        made = greedy_folds(pdf, unit, label, folds)
        return pd.DataFrame([(pdf[run].iloc[0], u, f) for u, f in made.items()], columns=[run, unit, "fold"])

    return df.where(f"{unit} is not null and {label} is not null").select(run, unit, label).groupBy(run).applyInPandas(assign, f"{run} string, {unit} string, fold long")


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Balanced L2 logistic regression by Newton steps; the last weight is the intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) / c
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def grouped_cv(df: DataFrame, run: str, key: str, unit: str, features: list[str], label: str, folds: int = 5) -> DataFrame:
    """(run, key, fold, y_true, y_score): out-of-fold scores; medians, means and scales come from the training part of
    each fold, and no unit stands on both sides."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[label]).sort_values(key)
        fold_of = greedy_folds(pdf, unit, label, folds)
        fold = pdf[unit].map(fold_of).to_numpy()
        x, y = pdf[features].to_numpy(float), pdf[label].to_numpy(int)
        score = np.full(len(y), np.nan)
        for f in range(folds):
            test, train = fold == f, fold != f
            if not test.any() or len(np.unique(y[train])) < 2:
                continue
            mid = np.nan_to_num(np.nanmedian(x[train], axis=0))
            a, b = (np.where(np.isnan(v), mid, v) for v in (x[train], x[test]))
            mean, sd = a.mean(axis=0), np.where(a.std(axis=0) > 0, a.std(axis=0), 1)
            w = logistic((a - mean) / sd, y[train])
            score[test] = 1 / (1 + np.exp(-(np.hstack([(b - mean) / sd, np.ones((len(b), 1))]) @ w)))
        return pd.DataFrame({run: pdf[run].to_numpy(), key: pdf[key].to_numpy(), "fold": fold, "y_true": y, "y_score": score})

    return df.where(f"{unit} is not null").select(run, key, unit, label, *features).groupBy(run).applyInPandas(fit, f"{run} string, {key} long, fold long, y_true long, y_score double")


def balanced_accuracy(label: str, predicted: str) -> Column:
    """Aggregate: the mean of the recalls of the labels 0 and 1, or the one of the only label there is."""
    zero, one = (F.avg(F.when(F.col(label) == v, (F.col(predicted) == v).cast("double"))) for v in (0, 1))
    return F.coalesce((zero + one) / 2, zero, one)


def fold_metrics(scored: DataFrame, run: str, key: str, label: str, score: str) -> DataFrame:
    """Per run and fold of out-of-fold scores: rows, positives, area under precision-recall steps, balanced accuracy at
    0.5 and recall among the k best, k being the positives (ties in order of the key); and the mean and deviation of
    each over the run's folds. Without positives the area and the recall are 0. Folds without scores are left out."""
    fold = [run, "fold"]
    sub = scored.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*fold, key, F.col(label).alias("_y"), F.col(score).alias("_s"), (F.col(score) > 0.5).cast("int").alias("_p"))
    best = sub.withColumns({"_r": F.row_number().over(Window.partitionBy(*fold).orderBy(F.desc("_s"), key)), "_k": F.sum("_y").over(Window.partitionBy(*fold))})
    per = best.groupBy(*fold).agg(F.count("*").alias("n_test"), F.sum("_y").alias("n_test_positive"), balanced_accuracy("_y", "_p").alias("balanced_accuracy"), F.coalesce(F.try_divide(F.sum(F.when(F.col("_r") <= F.col("_k"), F.col("_y"))), F.sum("_y")), F.lit(0.0)).alias("recall_at_k"))
    area = average_precision(sub, "_s", "_y", fold).select(*fold, F.coalesce("average_precision", F.lit(0.0)).alias("pr_auc"))
    names, every = ("pr_auc", "balanced_accuracy", "recall_at_k"), Window.partitionBy(run)
    told = per.join(area, fold).select(*fold, "n_test", "n_test_positive", *names)
    return told.select("*", *(F.avg(c).over(every).alias(f"mean_{c}") for c in names), *(F.stddev_pop(c).over(every).alias(f"std_{c}") for c in names))


def baseline_cv(df: DataFrame, unit: str, features: list[str], label: str, *, kind: str = "tree", folds: int = 5, depth: int = 3, c: float = 1.0, seed: int = 42) -> DataFrame:
    """(df's columns, fold, prediction, probability, importances): every row as the model of its fold judges it (a tree,
    or a logistic regression, whose importances are the sizes of its coefficients), which has seen no row of the row's unit. Medians for what is missing and balanced class weights come from the training
    part of each fold. Rows without a unit or label are left out; where training rows are of one label, no model is
    fitted and the held-out rows have nulls."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    own, work = df.columns, Workspace(df.sparkSession, "trees")
    known = df.where(F.col(label).isNotNull() & F.col(unit).isNotNull()).withColumns({f"_{c}": F.when(~F.isnan(c), F.col(c).cast("double")) for c in features})
    known = work.put(known, "known")
    of = balanced_folds(known.withColumn("_run", F.lit("")), "_run", unit, label, folds).select(unit, "fold")
    rows = work.put(known.join(of, unit).select(*own, *(f"_{c}" for c in features), "fold"), "rows")
    held = rows.withColumn("_held", F.explode(F.array(*(F.lit(f) for f in range(folds))))).where("_held <> fold")
    parts = held.groupBy("_held").agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"), *(F.median(f"_{c}").alias(f"_{c}") for c in features)).collect()
    grown, out = [p for p in parts if 0 < p.pos < p.n], None
    for p in grown:
        weight = F.when(F.col(label) == 1, p.n / (2 * p.pos)).otherwise(p.n / (2 * (p.n - p.pos)))
        filled = rows.withColumns({f"_{c}": F.coalesce(f"_{c}", F.lit(float(p[f"_{c}"] or 0.0))) for c in features}).withColumns({"_weight": weight, "_label": F.col(label).cast("double")})
        data = VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_features").transform(filled)
        names = {"featuresCol": "_features", "labelCol": "_label", "weightCol": "_weight", "predictionCol": "prediction", "probabilityCol": "_probability"}
        made = DecisionTreeClassifier(maxDepth=depth, seed=seed, **names) if kind == "tree" else LogisticRegression(maxIter=1000, regParam=1 / (c * p.n), standardization=False, **names)
        model = made.fit(data.where(F.col("fold") != p["_held"]))
        weights = model.featureImportances.toArray() if kind == "tree" else np.abs(model.coefficients.toArray())
        share = F.array(*(F.lit(float(v)) for v in weights))
        told = model.transform(data.where(F.col("fold") == p["_held"])).select(*own, "fold", "prediction", vector_to_array("_probability")[1].alias("probability"), share.alias("importances"))
        out = told if out is None else out.unionByName(told)
    none = rows.where(~F.col("fold").isin([p["_held"] for p in grown])).select(*own, "fold", *(F.lit(None).cast(t).alias(c) for c, t in (("prediction", "double"), ("probability", "double"), ("importances", "array<double>"))))
    return none if out is None else out.unionByName(none)


def kabsch_rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Root mean square deviation after the best rotation and translation."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return float(np.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))))


def plane_normal(points: np.ndarray) -> np.ndarray:
    """Unit normal of the best plane through points."""
    return np.linalg.svd(points - points.mean(axis=0))[2][-1]
