"""Families of sequences: groups of equal sequences, alignment rows with scores, enrichment and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordmill.functions import scalars as S


def collapse(members: DataFrame, keys: list[str], sequence: str, sets: dict[str, str], on_conflict: str = "raise") -> DataFrame:
    """(keys, sequence, n_sequences, sorted sets joined by commas): one row per group. The members of a group must have
    one sequence: where they don't, reading the result fails (``raise``), or the least is kept and n_sequences tells how
    many there are (``report``). Null sequences are no sequence."""
    got = members.groupBy(*keys).agg(F.min(sequence).alias(sequence), F.countDistinct(sequence).alias("n_sequences"), *(S.sorted_join(F.col(c)).alias(n) for n, c in sets.items()))
    if on_conflict == "report":
        return got
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    checked = F.when(F.col("n_sequences") > 1, F.raise_error(F.concat(F.lit("inconsistent sequences for "), name)).cast("string")).otherwise(F.col(sequence))
    return got.withColumn(sequence, checked)


def aligned(rows: DataFrame, parts: list[tuple[DataFrame, list[str]]], values: list[str]) -> DataFrame:
    """Alignment rows with the columns of each part (rows, keys) by left joins; rows without any of the values are
    dropped."""
    out = rows
    for part, keys in parts:
        out = out.join(part, keys, "left")
    return out.where(F.coalesce(*(F.col(v).cast("string") for v in values)).isNotNull())


def enrichment(counts: DataFrame, group: str, item: list[str], n: str, small: float = 1e-9) -> DataFrame:
    """(group, item, n, share_percent, log2_enrichment): the share of an item in its group, and against its share over
    all groups. Totals come by joins of one row per group and item."""
    per = counts.groupBy(group).agg(F.sum(n).alias("_g"))
    base = counts.groupBy(*item).agg(F.sum(n).alias("_i"))
    total = counts.agg(F.sum(n)).first()[0]
    told = counts.join(per, group).join(base, item)
    share, all_ = F.col(n) / F.col("_g"), F.col("_i") / F.lit(total)
    return told.select(*counts.columns, (100 * share).alias("share_percent"), F.log2((share + small) / (all_ + small)).alias("log2_enrichment"))


def consensus(counts: DataFrame, keys: list[str], item: str, n: str) -> DataFrame:
    """(keys, consensus): the most frequent item; ties go to the least."""
    most = counts.groupBy(*keys).agg(F.max(n).alias("_m"))
    return counts.join(most, keys).where(F.col(n) == F.col("_m")).groupBy(*keys).agg(F.min(item).alias("consensus"))
