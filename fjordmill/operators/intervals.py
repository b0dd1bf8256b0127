"""Intervals and distances: greedy de-duplication, overlap fractions, neighbours within a cutoff."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_share(a_start: int, a_end: int, b_start: int, b_end: int, inclusive: bool) -> float:
    """Overlap as a share of the shorter interval; ends belong to it or not."""
    plus = 1 if inclusive else 0
    shared = min(a_end, b_end) - max(a_start, b_start) + plus
    shorter = min(a_end - a_start, b_end - b_start) + plus
    return max(0, shared) / shorter if shorter > 0 else 0.0


def _pick(order: list[str], inclusive: bool, limit: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        rows = []
        for i, (s, e) in zip(pdf.sort_values(order, kind="stable").index, pdf.sort_values(order, kind="stable")[["start", "end"]].itertuples(index=False)):
            if all(overlap_share(s, e, a, b, inclusive) <= limit for a, b in kept):
                kept.append((s, e))
                rows.append(i)
        return pdf.loc[rows]

    return run


def greedy(df: DataFrame, group: list[str], order: list[str], inclusive: bool, limit: float) -> DataFrame:
    """Keep intervals (id, start, end) in order unless they overlap a kept one of their group by more than the limit.

    The rule is sequential within a group (a sequence's domains), so a group is one task's work; groups are
    independent. What is compared is each interval with the kept ones, which can't crowd one sequence."""
    return df.groupBy(*group).applyInPandas(_pick(order, inclusive, limit), df.schema)


def within_distance(df: DataFrame, key: str, axes: list[str], cutoff: float, group: list[str] | None = None) -> DataFrame:
    """(a, b) of points at most cutoff apart, both ways. Points meet through grid cells of the cutoff's width: each
    point is sent to its own cell and the neighbouring ones, once."""
    group = group or []
    cell = [F.floor(F.col(a) / cutoff).cast("int").alias(f"_c{i}") for i, a in enumerate(axes)]
    own = df.select(*group, F.col(key).alias("a"), *(F.col(x).alias(f"_a{i}") for i, x in enumerate(axes)), *cell)
    other = df.select(*group, F.col(key).alias("b"), *(F.col(x).alias(f"_b{i}") for i, x in enumerate(axes)), *cell)
    for i in range(len(axes)):
        other = other.withColumn(f"_c{i}", F.explode(F.sequence(F.col(f"_c{i}") - 1, F.col(f"_c{i}") + 1)))
    near = sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) ** 2 for i in range(len(axes))), F.lit(0.0)) <= cutoff * cutoff
    return own.join(other, [*group, *(f"_c{i}" for i in range(len(axes)))]).where(near & (F.col("a") != F.col("b"))).select("a", "b")
