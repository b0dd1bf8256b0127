"""Sets of features: pairwise distances inside groups and medoids, in long form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordmill.operators.blocks import column, runs


def shared_counts(sets: DataFrame) -> DataFrame:
    """(grp, a, b, c): features that two records of a group share, a and b differing; pairs that share none don't
    come up. sets: (grp, id, tokens)."""
    long_ = sets.select("grp", "id", F.explode("tokens").alias("t"))
    a, b = long_.select("grp", "t", F.col("id").alias("a")), long_.select("grp", "t", F.col("id").alias("b"))
    return a.join(b, ["grp", "t"]).where("a <> b").groupBy("grp", "a", "b").agg(F.count("*").alias("c"))


#: Rows of a group that one task compares with each other, or with another such block.
BLOCK = 4096


def _sums():
    """Rows sorted by (grp, ba, bb) -> (grp, id, s): the sum of each row's similarities to the rows of the other side, or
    of its own block. No pair leaves the task."""

    def run(batches):
        for t, cut in runs(batches, ["grp", "ba", "bb"]):
            lists = column(t, "tokens")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            side = t.column("side").to_numpy()
            out = np.zeros(t.num_rows)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                kinds, at = np.unique(flat[off[a] : off[b]], return_inverse=True)
                x = np.zeros((b - a, max(1, len(kinds))), np.float32)
                x[np.repeat(np.arange(b - a), np.diff(off[a : b + 1])), at] = 1
                n, own = x.sum(axis=1), side[a:b]
                for one, two in [(own == 1, own == 2), (own == 2, own == 1)] if own.any() else [(own == 0, own == 0)]:
                    rows, y, m = np.nonzero(one)[0], x[two], n[two]
                    for c in range(0, len(rows), 512):
                        r = rows[c : c + 512]
                        common = (x[r] @ y.T).astype(np.float64)
                        either = n[r][:, None] + m[None] - common
                        out[a + r] = np.where(either > 0, common / np.maximum(either, 1), 1.0).sum(axis=1)
                if not own.any():
                    out[a:b] -= 1  # a row with itself
            yield pa.RecordBatch.from_arrays([column(t, "grp"), column(t, "id"), pa.array(out)], names=["grp", "id", "s"])

    return run


def medoids(sets: DataFrame) -> DataFrame:
    """(grp, id, distance_sum): the member of each group with the least sum of Jaccard distances; ties go to the least
    id. Two empty sets are 0 apart. A group above BLOCK rows is cut into blocks by a hash of the id and every two blocks
    meet in a task, which gives one sum per row: rows are copied per block, pairs are never made."""
    sizes = sets.groupBy("grp").agg(F.count("*").alias("m"))
    placed = sets.select("grp", "id", "tokens").join(sizes, "grp").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("ba"), F.greatest(F.col("block"), o).alias("bb")))).alias("p")
    side = F.when(F.col("p.ba") == F.col("p.bb"), 0).when(F.col("block") == F.col("p.ba"), 1).otherwise(2)
    rows = placed.select("*", meet).select("grp", "p.ba", "p.bb", side.alias("side"), "id", "tokens").repartition("grp", "ba", "bb").sortWithinPartitions("grp", "ba", "bb")
    kinds = dict(sets.dtypes)
    total = rows.mapInArrow(_sums(), f"grp {kinds['grp']}, id {kinds['id']}, s double").groupBy("grp", "id").agg(F.sum("s").alias("s"))
    best = total.join(sizes, "grp").withColumn("distance_sum", F.col("m") - 1 - F.col("s"))
    return best.groupBy("grp").agg(F.min_by(F.struct("id", "distance_sum"), F.struct(F.round("distance_sum", 9), "id")).alias("x")).select("grp", "x.id", "x.distance_sum")
