"""Joins, first-wins indexing, rollups and ladders as DataFrame-to-DataFrame functions.

Column names are parameters; nothing here collects. Order-dependent rules take an explicit order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_first(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the given order. An aggregate, so no sort of the whole table."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return got.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def assemble(master: DataFrame, key: str, parts: list[tuple[DataFrame, dict[str, object]]]) -> DataFrame:
    """Left joins of one-row-per-key parts to a master table; each part names its columns and their defaults."""
    out = master
    for part, columns in parts:
        out = out.join(part.select(key, *columns), key, "left").fillna({c: v for c, v in columns.items() if v is not None})
    return out


def pair_sides(df: DataFrame, keys: list[str], side: str, left: str, right: str, values: list[str], order: list) -> DataFrame:
    """Rows of two sides matched on the keys, as one row with ``left_`` and ``right_`` values; the last row of a side
    wins. One aggregation instead of a self-join."""
    picks = [F.max_by(F.struct(*values), F.when(F.col(side) == s, F.struct(*order))).alias(n) for n, s in (("_l", left), ("_r", right))]
    seen = [F.count_if(F.col(side) == s).alias(n) for n, s in (("_nl", left), ("_nr", right))]
    got = df.where(F.col(side).isin(left, right)).groupBy(*keys).agg(*picks, *seen).where("_nl > 0 and _nr > 0")
    return got.select(*keys, *(F.col("_l")[v].alias(f"left_{v}") for v in values), *(F.col("_r")[v].alias(f"right_{v}") for v in values))


def fallback_join(df: DataFrame, key: str, parts: list[tuple[DataFrame, str, str]], name: str) -> DataFrame:
    """The first hit in a chain of left joins: (table, key column, value column) in order of preference."""
    out = df
    for i, (t, k, v) in enumerate(parts):
        out = out.join(t.select(F.col(k).alias(f"_k{i}"), F.col(v).alias(f"_v{i}")).dropDuplicates([f"_k{i}"]), F.col(key) == F.col(f"_k{i}"), "left")
    return out.select(*df.columns, F.coalesce(*(F.col(f"_v{i}") for i in range(len(parts)))).alias(name))


def ladder(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The label of the first rule that holds."""
    c = F
    for cond, label in rules:
        c = c.when(cond, label)
    return c.otherwise(otherwise) if otherwise is not None else c


def compound_status(parts: list[tuple[Column, str]], ok: str = "ok") -> Column:
    """The labels of all rules that hold, joined by semicolons, or ok."""
    return F.coalesce(F.nullif(F.concat_ws(";", *(F.when(c, l) for c, l in parts)), F.lit("")), F.lit(ok))


def densify(keys: DataFrame, found: DataFrame, on: list[str], zero: dict[str, object]) -> DataFrame:
    """Every key with its row, or with zeros where it has none."""
    return keys.join(found, on, "left").fillna(zero)


def average_rank(value: str, partition: list[str] | None = None) -> Column:
    """Rank with ties sharing their mean rank."""
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(value)
    peers = Window.partitionBy(*(partition or []), value)
    return F.rank().over(w) + (F.count("*").over(peers) - 1) / 2.0


def benjamini_hochberg(df: DataFrame, p: str, name: str = "q", partition: list[str] | None = None) -> DataFrame:
    """False-discovery rates: running minimum of p * m / rank from the largest p down."""
    part = partition or []
    w = Window.partitionBy(*part)
    asc = w.orderBy(p, *[c for c in df.columns if c != p][:1])
    ranked = df.withColumn("_r", F.row_number().over(asc)).withColumn("_m", F.count(p).over(w))
    desc = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(desc))).drop("_r", "_m")


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def union_of_shards(parts: list[tuple[str, DataFrame]], column: str = "shard") -> DataFrame:
    """Union by name with the union of all columns, and where each row came from."""
    out = None
    for name, df in parts:
        one = df.withColumn(column, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def gini(size: str, group: list[str], df: DataFrame) -> DataFrame:
    """Gini coefficient of sizes per group from ranks: 2 * sum(r * x) / (n * sum(x)) - (n + 1) / n."""
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(size)))
    return r.groupBy(*group).agg((2 * F.sum(F.col("_r") * F.col(size)) / (F.count("*") * F.sum(size)) - (F.count("*") + 1) / F.count("*")).alias("gini"))


def entropy(share: Column) -> Column:
    """Aggregate: Shannon entropy in bits."""
    return -F.sum(F.when(share > 0, share * F.log2(share)).otherwise(0.0))


def kingdom_group(kingdom: Column, eukarya: tuple[str, ...], strict: bool) -> Column:
    """eukarya or other by the kingdom; without one ``missing``, or, where that is not allowed, reading fails."""
    blank = F.coalesce(F.trim(kingdom), F.lit("")) == ""
    missing = F.raise_error(F.lit("missing kingdom")).cast("string") if strict else F.lit("missing")
    return F.when(blank, missing).when(F.lower(kingdom).isin(*eukarya), "eukarya").otherwise("other")
