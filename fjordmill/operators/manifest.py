"""Manifests: cases as products of small lists, parameter grids, ordinals."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cases(left: DataFrame, right: DataFrame, models: list[str], ready: Column, skipped: Column) -> DataFrame:
    """Every left row with every right row and model, and a status. A manifest is a product by definition: its size
    is what the caller asks for."""
    model = F.explode(F.array(*(F.lit(m) for m in models))).alias("model")
    both = left.crossJoin(right).select("*", model)
    return both.withColumn("status", F.when(ready, "ready").when(skipped, "skipped").otherwise("pending"))


def grid(spark: SparkSession, axes: dict[str, list[int]]) -> DataFrame:
    """All points of a parameter grid."""
    return spark.createDataFrame(list(product(*axes.values())), ", ".join(f"{a} int" for a in axes))


def ordinals(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers from 1 in the given order. The rows are range-partitioned and counted per partition, so no task
    sees more than its part; the counts (one per partition) come to the driver."""
    from fjordmill.session import Workspace

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    kept = Workspace(spark, "ordinals").put(sorted_, "sorted")
    counts = {r["_p"]: r["count"] for r in kept.groupBy("_p").count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    start = F.element_at(F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n))), F.col("_p")) if before else F.lit(0)
    return kept.withColumn(name, (start + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).cast("bigint")).drop("_p")
