"""References to records that do not exist.

Parent records carry a key and a span of time in which they exist. A key is turned into an integer, and a parent
record covers the integers (key, instant) from its start to its end. Sorted, these integers are compressed into
contiguous runs: spans of one key that overlap, repeat or follow each other become one run (keys that exist without
time, see missing(), are such integers themselves: a stretch of neighbouring keys is one run). A reference is the integer
(key, instant of the reference); it is matched as-of to the run with the greatest start at or before it and is an
orphan if it lies beyond that run's end.

Spans are range-partitioned and sorted to find the runs, and runs and references again to match them, so a key that
holds a third of all rows is spread over several partitions like any other stretch of integers. A run that reaches over
the border of a partition stays in two parts, which changes no match. What a partition of the match has to know of the
ones before it is one row per partition (its last key and the end of that key's run), which is joined back by broadcast:
its size is the number of partitions, whatever the data.

Edge cases: a null or placeholder reference is no reference; a reference that has no key form but is not blank is
an orphan; a reference without an instant is an orphan unless its key has an endless run; a parent without a start
never exists; a span that ends at or before its start is empty; repeated parents merge; with no parents every
reference is an orphan; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordmill.functions.scalars import is_placeholder
from fjordmill.session import Workspace

ENDLESS = np.iinfo(np.int64).max
#: A ten-character accession: letter, digit, then twice letter, two letters or digits, digit.
ACCESSION = r"[A-Z][0-9][A-Z][A-Z0-9]{2}[0-9][A-Z][A-Z0-9]{2}[0-9]"


def accession(text: Column) -> Column:
    """The accession in a text, whatever its case and what is written around it; null where there is none."""
    u = F.upper(text)
    alone = F.regexp_extract(u, rf"(?<![A-Z0-9])({ACCESSION})(?![A-Z0-9])", 1)
    return F.coalesce(F.nullif(alone, F.lit("")), F.nullif(F.regexp_extract(u, f"({ACCESSION})", 1), F.lit("")))


def accessions(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(rf"(?<![A-Z0-9])({ACCESSION})(?![A-Z0-9])"), F.lit(1))


def integer_key(key: Column) -> Column:
    """Keys of at most twelve letters and digits read as a number to the base 36; any other key by a 64-bit hash, which
    is negative, so the two kinds don't meet."""
    short = F.upper(F.trim(key)).rlike("^[A-Z0-9]{1,12}$")
    return F.when(short, F.conv(F.substring(F.trim(key), 1, 12), 36, 10).cast("bigint")).otherwise(F.when(key.isNotNull(), F.xxhash64(key).bitwiseOR(F.lit(-(2**63)))))


def _latest(group: np.ndarray, end: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Running maximum of ``end`` within the groups (numbered 0, 1, ... in order) over the rows in use; the least long
    where there is none yet."""
    values, rank = np.unique(end, return_inverse=True)
    base = group.astype(np.int64) * (len(values) + 1)
    top = np.maximum.accumulate(base + np.where(use, rank + 1, 0)) - base
    return np.where(top > 0, values[np.maximum(top - 1, 0)], np.iinfo(np.int64).min)


def _merge(batches):
    """Spans sorted by key, at -> the runs they make up."""
    held = None  # the run that may go on: key, start, end
    for b in batches:
        if not b.num_rows:
            continue
        key, at, end = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held is not None:
            key, at, end = np.append(held[0], key), np.append(held[1], at), np.append(held[2], end)
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        latest = _latest(np.cumsum(new_key) - 1, end, np.ones(len(key), bool))
        new = new_key.copy()
        new[1:] |= at[1:] - 1 > latest[:-1]
        starts = np.nonzero(new)[0]
        ends = np.append(starts[1:], len(key)) - 1
        rows = key[starts], at[starts], latest[ends]
        held = tuple(x[-1] for x in rows)
        if len(starts) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in rows], names=["key", "at", "end"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], names=["key", "at", "end"])


def runs(parents: DataFrame, partitions: int) -> DataFrame:
    """(key, at, end): contiguous runs of the integers that the spans (key, at, end long; both ends belong to it) cover."""
    spans = parents.where("key is not null and at is not null and end >= at").groupBy("key", "at").agg(F.max("end").alias("end"))
    return spans.repartitionByRange(partitions, "key", "at").sortWithinPartitions("key", "at").mapInArrow(_merge, "key long, at long, end long")


def _match(batches):
    """Rows sorted by key, at, kind (0 run, 1 reference). Gives each reference that its partition can't resolve
    (open: it has the partition's first key, so an earlier partition may) and one row of carry per partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    cur_key = cur_end = first_key = None
    for b in batches:
        if not b.num_rows:
            continue
        key, at = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        kind, end = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
        if first_key is None:
            first_key = key[0]
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        latest = _latest(group, end, kind == 0)
        if cur_key is not None and cur_key == key[0]:
            latest = np.where(group == 0, np.maximum(latest, cur_end), latest)
        cur_key, cur_end = key[-1], latest[-1]
        miss = (kind == 1) & (latest < at)
        if miss.any():
            rows = pa.array(np.nonzero(miss)[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[miss]), pa.array(at[miss]), b.column(4).take(rows), pa.array(key[miss] == first_key), pa.array(np.full(miss.sum(), part, np.int32)), pa.nulls(int(miss.sum()), pa.int64())],
                names=["key", "at", "ref", "open", "part", "carry_end"],
            )
    if cur_key is not None and cur_end > np.iinfo(np.int64).min:
        yield pa.RecordBatch.from_arrays(
            [pa.array([cur_key]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.bool_()), pa.array([part], pa.int32()), pa.array([cur_end])],
            names=["key", "at", "ref", "open", "part", "carry_end"],
        )


def unmatched(refs: DataFrame, parents: DataFrame, partitions: int) -> DataFrame:
    """refs: key, at long, ref string (an id that comes out again). parents: key, at, end long (end is the last
    instant covered). The ref of each reference beyond the end of its preceding run."""
    events = runs(parents, partitions).select("key", "at", F.lit(0).alias("kind"), "end", F.lit(None).cast("string").alias("ref")).unionByName(
        refs.select("key", "at", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("end"), "ref")
    )
    ordered = events.repartitionByRange(partitions, "key", "at").sortWithinPartitions("key", "at", "kind")
    # written, so that both uses below see one and the same placing of the rows
    found = Workspace(refs.sparkSession, "orphans").put(ordered.mapInArrow(_match, "key long, at long, ref string, open boolean, part int, carry_end long"), "found")
    misses = found.where("carry_end is null")
    carry = found.where("carry_end is not null").select(F.col("key").alias("c_key"), F.col("part").alias("c_part"), F.col("carry_end").alias("c_end"))
    # one carry row per partition of the sort: bounded by their number
    saved = F.expr("open and key = c_key and c_part < part and c_end >= at")
    return misses.join(F.broadcast(carry), saved, "left_anti").select("ref")


def missing(rows: DataFrame, column: str, parents: DataFrame, parent_column: str, *, row_id: str = "row_id", partitions: int | None = None) -> DataFrame:
    """(row_id) of the rows whose integer reference is none of the parents' keys, at whatever time. Null references are
    no reference."""
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.lit(0).cast("bigint").alias("key")
    spans = parents.select(key, F.col(parent_column).cast("bigint").alias("at"), F.col(parent_column).cast("bigint").alias("end"))
    refs = rows.where(F.col(column).isNotNull()).select(key, F.col(column).cast("bigint").alias("at"), F.col(row_id).cast("string").alias("ref"))
    return unmatched(refs, spans, partitions).select(F.col("ref").cast("bigint").alias("row_id")).distinct()


def orphans(tables: dict[str, tuple[DataFrame, str]], parents: DataFrame, *, row_id: str = "row_id", at: str = "recorded_at", partitions: int | None = None, key=accession) -> DataFrame:
    """(ref_table, row_id, at) of the rows whose reference resolves to no parent.

    tables: name -> (rows, the reference column). parents: accession string (the key), starts, ends timestamp (null: no
    end). ``key`` makes the key, of any form and length, from a column of references; null where there is none.
    """
    spark = parents.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = None
    for name, (df, column) in tables.items():
        one = df.where(~is_placeholder(F.col(column))).select(
            F.lit(name).alias("ref_table"), F.col(row_id).cast("bigint").alias("row_id"), F.col(at).cast("timestamp").alias("at_ts"), key(F.col(column)).alias("acc")
        )
        every = one if every is None else every.unionByName(one)
    coded = every.select("ref_table", "row_id", "at_ts", integer_key(F.col("acc")).alias("key"), F.coalesce(F.unix_micros("at_ts"), F.lit(ENDLESS)).alias("at"))
    spans = parents.where("starts is not null").select(
        integer_key(F.col("accession")).alias("key"), F.unix_micros(F.col("starts").cast("timestamp")).alias("at"), F.coalesce(F.unix_micros(F.col("ends").cast("timestamp")) - 1, F.lit(ENDLESS)).alias("end")
    )
    refs = coded.where("key is not null").select("key", "at", F.concat_ws("\t", "ref_table", "row_id", F.coalesce(F.unix_micros("at_ts").cast("string"), F.lit(""))).alias("ref"))
    lost = unmatched(refs, spans, partitions).select(F.split("ref", "\t").alias("r"))
    from_keys = lost.select(F.col("r")[0].alias("ref_table"), F.col("r")[1].cast("bigint").alias("row_id"), F.timestamp_micros(F.nullif(F.col("r")[2], F.lit("")).cast("bigint")).alias("at"))
    formless = coded.where("key is null").select("ref_table", "row_id", F.col("at_ts").alias("at"))
    return from_keys.unionByName(formless).distinct()


def by_period(found: DataFrame, unit: str = "month") -> DataFrame:
    """Orphans per table and period of their instant."""
    return found.groupBy("ref_table", F.date_format(F.date_trunc(unit, "at"), "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("n_orphans"))
