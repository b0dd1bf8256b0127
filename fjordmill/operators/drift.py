"""Schemas that drift between the files of a stream.

1. The schema of every file is read in parallel: each Arrow batch of records is parsed once and gives the distinct
   (stream, file, parent, field, type) it holds, so what is shuffled grows with files and fields, not with records.
2. Types fold through a promotion lattice, within a file and over all files:
   null < boolean, number < string < array (a value can always be written as text, and text as a list of one).
3. The ordered differences of each file against the preceding one of its stream are logged.
4. Names that a rename joins, in whatever stream, are one column: that of the name which most streams end with (then the
   one in most files, then the least). Only where a file has two of the names at once do they stay apart.
5. Records are cast to the union schema in one narrow pass; numbers that are whole in all files stay whole.

Edge cases: a payload that is null, broken, or no object is unreadable and gives nothing; a file without a readable
record still counts as a file, without fields; NaN and Infinity are no JSON; of a key that an object has twice the
last value holds; an empty object is no field, an empty array is one; a null value doesn't make a file have a field;
a file delivered twice is one file, and a line delivered twice one record (the first to be loaded, ties by
record id; rows without a line number are all kept); keys may hold any characters (a dot in a key reads as one more level in the
path); rows with a null stream or file number are left out; an empty table gives no changes and no records.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordmill.session import Workspace

#: Order in the lattice. Two different types below string promote to string; array is the top.
RANK = {"boolean": 1, "number": 1, "string": 2, "array": 3}


def promote(a: str | None, b: str | None) -> str | None:
    """The least type that holds both; commutative, associative, and null is neutral."""
    if a is None or b is None or a == b:
        return a or b
    if RANK[a] == RANK[b]:
        return "string"
    return a if RANK[a] > RANK[b] else b


def _no_constant(name):
    raise ValueError(name)


def readable(payload: str | None) -> dict | None:
    if payload is None:
        return None
    try:
        record = json.loads(payload, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "array" if isinstance(value, list) else "string"


def whole(value) -> bool:
    """A number without a fraction that a long holds."""
    return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63


def fields(record: dict):
    """(parent path, name, value) of every value that is not an object; walked without recursion."""
    todo = [("", record)]
    while todo:
        parent, obj = todo.pop()
        for name, value in obj.items():
            if isinstance(value, dict):
                todo.append((f"{parent}.{name}" if parent else name, value))
            else:
                yield parent, name, value


def _headers(batches):
    for b in batches:
        seen = set()
        streams, seqs, payloads = (b.column(i).to_pylist() for i in range(3))
        for stream, seq, payload in zip(streams, seqs, payloads):
            record = readable(payload)
            for parent, name, value in fields(record) if record else ():
                if value is not None:
                    seen.add((stream, seq, parent, name, kind(value), whole(value)))
        cols = list(zip(*seen)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), pa.array(cols[5], pa.bool_())], names=["stream_id", "file_seq", "parent", "name", "type", "whole"]
        )


def lattice_type(types):
    """Aggregate column: the fold of a set of types through the lattice, from flags that combine in any order."""
    has = {t: F.max(types == t) for t in RANK}
    return F.when(has["array"], "array").when(has["string"] | (has["boolean"] & has["number"]), "string").when(has["boolean"], "boolean").otherwise("number")


def file_schemas(records: DataFrame) -> DataFrame:
    """(stream_id, file_seq, parent, field_path, type, whole), one row per file and field."""
    narrow = records.where("stream_id is not null and file_seq is not null").select("stream_id", F.col("file_seq").cast("bigint"), F.col("payload").cast("string"))
    found = narrow.mapInArrow(_headers, "stream_id string, file_seq long, parent string, name string, type string, whole boolean")
    path = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws(".", "parent", "name"))
    return found.groupBy("stream_id", "file_seq", "parent", path.alias("field_path")).agg(lattice_type(F.col("type")).alias("type"), F.bool_and("whole").alias("whole"))


def changes(records: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(stream_id, file_seq, field_path, change, renamed_from) against the preceding file of the stream. The schemas are
    used twice, so they are written first where they aren't given."""
    schemas = Workspace(records.sparkSession, "drift").put(file_schemas(records), "schemas") if schemas is None else schemas
    files = records.where("stream_id is not null and file_seq is not null").select("stream_id", F.col("file_seq").cast("bigint").alias("file_seq")).distinct()
    follow = files.withColumn("next_seq", F.lead("file_seq").over(Window.partitionBy("stream_id").orderBy("file_seq")))
    starts = files.groupBy("stream_id").agg(F.min("file_seq").alias("first_seq"))
    now = schemas.select("stream_id", "file_seq", "parent", "field_path", F.col("type").alias("new_type"))
    then = schemas.join(follow, ["stream_id", "file_seq"]).where("next_seq is not null").select("stream_id", F.col("next_seq").alias("file_seq"), "parent", "field_path", F.col("type").alias("old_type"))
    both = now.join(then, ["stream_id", "file_seq", "parent", "field_path"], "full_outer")
    both = both.join(starts, "stream_id").where("file_seq > first_seq and not (new_type <=> old_type)")
    sort = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("type")
    told = both.select("stream_id", "file_seq", "parent", "field_path", sort.alias("change"))
    # one path gone and one new under one parent: counted before the rows of the parent are looked at again
    w = Window.partitionBy("stream_id", "file_seq", "parent")
    told = told.select("*", F.count_if(F.col("change") == "added").over(w).alias("n_new"), F.count_if(F.col("change") == "removed").over(w).alias("n_gone"), F.max(F.when(F.col("change") == "removed", F.col("field_path"))).over(w).alias("gone"))
    swap = (F.col("n_new") == 1) & (F.col("n_gone") == 1)
    return told.where(~(swap & (F.col("change") == "removed"))).select(
        "stream_id", "file_seq", "field_path",
        F.when(swap & (F.col("change") == "added"), "renamed").otherwise(F.col("change")).alias("change"),
        F.when(swap & (F.col("change") == "added"), F.col("gone")).alias("renamed_from"),
    )


def union_schema(schemas: DataFrame) -> DataFrame:
    """(field_path, type, n_files) over all files of all streams."""
    return schemas.groupBy("field_path").agg(lattice_type(F.col("type")).alias("type"), F.count("*").alias("n_files"))


def columns(schemas: DataFrame, log: DataFrame) -> list[tuple[str, str, str]]:
    """(field_path, column, type) of every field name. What comes to the driver are catalogues: a row per distinct field,
    per distinct rename, and per name that can't be folded. Types: long, double, boolean, string, array."""
    last = schemas.join(schemas.groupBy("stream_id").agg(F.max("file_seq").alias("file_seq")), ["stream_id", "file_seq"], "left_semi").groupBy("field_path").agg(F.count("*").alias("n_last"))
    every = schemas.groupBy("field_path").agg(F.collect_set("type").alias("types"), F.count("*").alias("n"), F.bool_and("whole").alias("whole"))
    names = {r.field_path: r for r in every.join(last, "field_path", "left").collect()}
    top = {n: n for n in names}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in log.where("change = 'renamed'").select("field_path", "renamed_from").distinct().collect():
        a, b = sorted((find(r.field_path), find(r.renamed_from)))
        top[b] = a
    groups: dict[str, list[str]] = {}
    for n in sorted(names):
        groups.setdefault(find(n), []).append(n)
    several = [(n, g) for g, ns in groups.items() if len(ns) > 1 for n in ns]
    apart = set()
    if several:
        named = schemas.join(schemas.sparkSession.createDataFrame(several, "field_path string, g string"), "field_path")
        apart = {r.g for r in named.groupBy("stream_id", "file_seq", "g").agg(F.countDistinct("field_path").alias("n")).where("n > 1").select("g").distinct().collect()}
    out = []
    for g, ns in groups.items():
        for own in [[n] for n in ns] if g in apart else [ns]:
            column = min(own, key=lambda n: (-(names[n].n_last or 0), -names[n].n, n))
            kinds = None
            for n in own:
                for t in names[n].types:
                    kinds = promote(kinds, t)
            if kinds == "number":
                kinds = "long" if all(names[n].whole for n in own) else "double"
            out += [(n, column, kinds) for n in own]
    return sorted(out)


def _cast(value, to: str):
    if value is None:
        return None
    if to == "array":
        return json.dumps(value if isinstance(value, list) else [value], ensure_ascii=False)
    if to == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return value


def _caster(names: list[tuple[str, str, str]]):
    to = {path: (column, kind) for path, column, kind in names}
    types = {column: kind for _, column, kind in names}
    made = {"long": int, "double": float}

    def run(batches):
        for b in batches:
            out = {column: [None] * b.num_rows for column in types}
            ok = []
            for i, payload in enumerate(b.column(3).to_pylist()):
                record = readable(payload)
                ok.append(record is not None)
                for parent, name, value in fields(record) if record else ():
                    column, kind = to.get(f"{parent}.{name}" if parent else name, (None, None))
                    if column is not None and value is not None:
                        out[column][i] = made[kind](value) if kind in made else _cast(value, kind)
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            arrays = [b.column(0), b.column(1), b.column(2), *(pa.array(out[c], kinds.get(t, pa.string())) for c, t in types.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=["record_id", "stream_id", "file_seq", *types]).filter(pa.array(ok))

    return run


def once(records: DataFrame, *, line: str = "line_no", order: str = "loaded_at") -> DataFrame:
    """(record_id, stream_id, file_seq, payload): each line of a file once."""
    rows = records.select(F.col("record_id").cast("bigint").alias("record_id"), "stream_id", F.col("file_seq").cast("bigint").alias("file_seq"), F.col("payload").cast("string").alias("payload"), F.col(line).alias("line"), F.col(order).alias("first"))
    own = F.when(F.col("line").isNull(), F.col("record_id"))
    kept = rows.groupBy("stream_id", "file_seq", "line", own.alias("own")).agg(F.min_by(F.struct("record_id", "payload"), F.struct("first", "record_id")).alias("r"))
    return kept.select("r.record_id", "stream_id", "file_seq", "r.payload")


def consistent(records: DataFrame, names: list[tuple[str, str, str]]) -> DataFrame:
    """All readable records cast to the union schema: (record_id, stream_id, file_seq, one column per field).

    names: (field_path, column, type) from columns(); its length is the number of distinct fields, a catalogue.
    """
    types = {column: kind for _, column, kind in names}
    sql = {"long": "long", "double": "double", "boolean": "boolean"}
    ddl = ", ".join(["record_id long", "stream_id string", "file_seq long", *(f"`{c.replace('`', '``')}` {sql.get(t, 'string')}" for c, t in types.items())])
    narrow = records.where("stream_id is not null and file_seq is not null").select(F.col("record_id").cast("bigint"), "stream_id", F.col("file_seq").cast("bigint"), F.col("payload").cast("string"))
    return narrow.mapInArrow(_caster(names), ddl)
