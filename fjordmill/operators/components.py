"""Connected components by hooking and pointer jumping.

Nodes are longs. First each partition replaces the edges it holds by a forest of stars, so a hub with a third of all
edges is combined before any shuffle. Then, in each round, every node hooks to its least neighbour, the pointers are
jumped (twice per job) until each leads to a root, and the edges are rewritten to roots and made distinct. Every node
with an edge hooks or is hooked to, so the nodes at least halve per round. Once ``small`` edges or fewer are left they
are finished by one task: its memory is bounded by that number, and the result is the same. The pointers of a round
are written tables: no lineage builds up, and nothing is collected to the driver but counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordmill.session import Workspace

#: Edges that one task finishes (two longs each).
SMALL = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges, for every node that they name."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        m = np.minimum(low[p], low[q])
        for x in (p, q, low[p], low[q]):
            np.minimum.at(new, x, m)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _forests(most: int = 1 << 21):
    """Edges -> stars (node, least node), of ``most`` edges at a time."""

    def run(batches):
        held, rows = [], 0

        def flush():
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(t.column(i).to_numpy() for i in (0, 1)))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def _finish(edges: DataFrame, small: int) -> DataFrame:
    return edges.select("a", "b").repartition(1).mapInArrow(_forests(2 * small + 1), "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("to"))


def roots(edges: DataFrame, work: Workspace, name: str = "components", small: int = SMALL) -> DataFrame:
    """(node, root) for every node of the edges (a, b long); root is the least node of the component.

    Null ends and loops are ignored apart from naming their node; repeated edges and either direction are the same.
    """
    proper = edges.where("a is not null and b is not null").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    left = work.put(proper.mapInArrow(_forests(), "a long, b long"), f"{name}_edges")
    n = left.count()
    if n <= small:
        return work.put(_finish(left, small).withColumnRenamed("to", "root"), f"{name}_roots")
    known = work.put(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), f"{name}_roots")
    left = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    n = left.count()
    while n:
        if n <= small:
            hooks = work.put(_finish(left, small).where("node <> to"), f"{name}_hooks")
        else:
            hooks = work.put(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), f"{name}_hooks")
            while True:  # jump: to becomes the to of to, until all lead to nodes that hook to none
                jumped = hooks
                for k in ("one", "two"):
                    jumped = jumped.join(hooks.select(F.col("node").alias("to"), F.col("to").alias(k)), "to", "left").select("node", F.coalesce(k, "to").alias("to"), F.col(k).isNotNull().alias("moved"))
                jumped = work.put(jumped, f"{name}_hooks")
                moved = not jumped.where("moved").isEmpty()
                hooks = jumped.select("node", "to")
                work.drop(f"{name}_hooks")
                if not moved:
                    break
        lead = hooks.select(F.col("node").alias("root"), F.col("to").alias("lead"))
        known = work.put(known.join(lead, "root", "left").select("node", F.coalesce("lead", "root").alias("root")), f"{name}_roots")
        work.drop(f"{name}_roots")
        if n <= small:
            break
        ends = left.join(lead.select(F.col("root").alias("a"), F.col("lead").alias("la")), "a", "left").join(lead.select(F.col("root").alias("b"), F.col("lead").alias("lb")), "b", "left")
        ends = ends.select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")).where("x <> y")
        left = work.put(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}_edges")
        work.drop(f"{name}_edges")
        n = left.count()
    return known
