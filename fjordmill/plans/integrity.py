"""Queries of problems 1, 3 and 5 (references, drifting schemas, packed fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordmill.operators import drift, orphans, packed
from fjordmill.session import Workspace, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    proteins = table(spark, d, "proteins")
    keys = F.array_distinct(F.concat(F.coalesce(orphans.accessions(F.col("protein_id")), F.array()), F.coalesce(orphans.accessions(F.col("uniprot_ids_all")), F.array())))
    parents = proteins.select(F.explode(keys).alias("accession"), F.col("loaded_at").alias("starts"), F.col("deleted_at").alias("ends"))
    return orphans.orphans(
        {"crystal_reference_list": (table(spark, d, "crystal_reference_list"), "protein_id"), "oligo_active_updated": (table(spark, d, "oligo_active_updated"), "uniprot_id")}, parents
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_id")


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.by_period(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "qc_report_raw")).select("stream_id", "file_seq", "field_path", "change")


def p3_union_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.union_schema(drift.file_schemas(table(spark, d, "qc_report_raw")))


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    raw, work = table(spark, d, "qc_report_raw"), Workspace(spark, "drift")
    schemas = work.put(drift.file_schemas(raw), "schemas")
    names = drift.columns(schemas, work.put(drift.changes(raw, schemas), "log"))
    return drift.consistent(drift.once(raw), names), names


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)[0]


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """What each column of the consistent table holds: its type, values, and their total (numbers: their sum; true: their
    count)."""
    rows, names = _records(spark, d)
    types = {column: kind for _, column, kind in names}
    col = lambda c: F.col(f"`{c.replace('`', '``')}`")
    total = {"long": lambda c: c.cast("double"), "double": lambda c: c, "boolean": lambda c: c.cast("double")}
    each = [F.struct(F.lit(c).alias("field_path"), F.lit(t).alias("type"), F.count(col(c)).alias("n_values"), F.round(F.sum(total.get(t, lambda _: F.lit(None).cast("double"))(col(c))), 3).alias("total")) for c, t in types.items()]
    return rows.agg(F.array(*each).alias("e")).select(F.explode("e").alias("s")).select("s.*") if each else spark.createDataFrame([], "field_path string, type string, n_values long, total double")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack_all([
        ("proteins", table(spark, d, "proteins"), "uniprot_ids_all", False),
        ("metadata_pdb_count", table(spark, d, "metadata_pdb_count"), "pdb_ids_before_af3_cutoff", False),
        ("oligo_active_updated", table(spark, d, "oligo_active_updated"), "oligo_active_classes", False),
        ("clustering_pilot_protein_overview", table(spark, d, "clustering_pilot_protein_overview"), "binding_modules", True),
    ])


_ACC = orphans.ACCESSION
_ORPHAN_SQL = f"""
WITH refs AS (
  SELECT 'crystal_reference_list' AS ref_table, row_id, protein_id AS ref, recorded_at FROM crystal_reference_list
  UNION ALL SELECT 'oligo_active_updated', row_id, uniprot_id, recorded_at FROM oligo_active_updated),
keyed AS (
  SELECT ref_table, row_id, recorded_at, nullif(regexp_extract(upper(ref), '({_ACC})', 1), '') AS acc FROM refs
  WHERE ref IS NOT NULL AND lower(trim(ref)) NOT IN ('', '-', 'na', 'n/a', 'none', 'null', 'unknown')),
parents AS (
  SELECT DISTINCT unnest(regexp_extract_all(upper(concat_ws(' ', protein_id, uniprot_ids_all)), '{_ACC}')) AS acc, loaded_at, deleted_at FROM proteins),
lost AS (
  SELECT * FROM keyed k WHERE NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.acc = k.acc AND p.loaded_at <= k.recorded_at AND (p.deleted_at IS NULL OR p.deleted_at > k.recorded_at)))
"""
# uniprot_ids_all and the like: quoted items stay whole, brackets belong to the code before them
_CODES = r"""'"(?:[^"]|"")*"|''[^'']*''|[A-Za-z0-9_.:-]+(?:\[[^\]]*\])?'"""
_MODULES = r"""'"(?:[^"]|"")*"|''[^'']*''|[A-Za-z][^\[]*\[[^\]]*\] \([0-9]+-[0-9]+\)'"""


def _unpack_sql(name: str, column: str, pattern: str) -> str:
    return f"""
SELECT '{name}' AS src_table, row_id, pos, item FROM (
  SELECT row_id, unnest(items) AS item, CAST(generate_subscripts(items, 1) AS BIGINT) AS pos FROM (
    SELECT row_id, list_transform(regexp_extract_all(trim({column}), {pattern}),
      lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') WHEN x[1] = '''' THEN x[2:-2] ELSE x END)) AS items
    FROM {name} WHERE {column} IS NOT NULL AND lower(trim({column})) NOT IN ('', '-', 'na', 'n/a', 'none', 'null', 'unknown')))"""


QUERIES = {f.__name__: f for f in (p1_found, p1_by_month, p3_found, p3_union_schema, p3_records, p3_columns, p5_found)}
_FIELDS_SQL = """
WITH valid AS (SELECT stream_id, file_seq, payload FROM qc_report_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
leaf AS (
  SELECT DISTINCT v.stream_id, v.file_seq, replace(t.fullkey[3:], '"', '') AS field_path, replace(t.path[3:], '"', '') AS parent,
    CASE t.type WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type
  FROM valid v, json_tree(v.payload) t
  WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%'),
field AS (
  SELECT stream_id, file_seq, parent, field_path,
    CASE WHEN bool_or(type = 'array') THEN 'array' WHEN bool_or(type = 'string') OR count(DISTINCT type) > 1 THEN 'string' ELSE min(type) END AS type
  FROM leaf GROUP BY ALL)
"""
_CHANGE_SQL = _FIELDS_SQL + """,
files AS (SELECT stream_id, file_seq, lag(file_seq) OVER (PARTITION BY stream_id ORDER BY file_seq) AS prev FROM (SELECT DISTINCT stream_id, file_seq FROM qc_report_raw)),
was AS (SELECT f.stream_id, f.file_seq, p.parent, p.field_path, p.type FROM files f JOIN field p ON p.stream_id = f.stream_id AND p.file_seq = f.prev),
now AS (SELECT d.* FROM field d JOIN files f USING (stream_id, file_seq) WHERE f.prev IS NOT NULL),
diff AS (
  SELECT coalesce(n.stream_id, w.stream_id) AS stream_id, coalesce(n.file_seq, w.file_seq) AS file_seq, coalesce(n.parent, w.parent) AS parent,
    coalesce(n.field_path, w.field_path) AS field_path, CASE WHEN w.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed' ELSE 'type' END AS change
  FROM now n FULL JOIN was w ON n.stream_id = w.stream_id AND n.file_seq = w.file_seq AND n.field_path = w.field_path
  WHERE n.type IS DISTINCT FROM w.type),
counted AS (SELECT *, count(*) FILTER (change = 'added') OVER p AS na, count(*) FILTER (change = 'removed') OVER p AS nr FROM diff WINDOW p AS (PARTITION BY stream_id, file_seq, parent))
SELECT stream_id, file_seq, field_path, CASE WHEN na = 1 AND nr = 1 AND change = 'added' THEN 'renamed' ELSE change END AS change
FROM counted WHERE NOT (na = 1 AND nr = 1 AND change = 'removed')
"""

_COLUMNS_SQL = _CHANGE_SQL.rsplit("SELECT stream_id, file_seq, field_path", 1)[0].replace("WITH valid", "WITH RECURSIVE valid", 1) + """,
links AS (SELECT DISTINCT max(field_path) FILTER (change = 'added') AS a, max(field_path) FILTER (change = 'removed') AS b FROM counted WHERE na = 1 AND nr = 1 GROUP BY stream_id, file_seq, parent),
reach AS (SELECT DISTINCT field_path AS x, field_path AS y FROM field UNION SELECT r.x, CASE WHEN l.a = r.y THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.y IN (l.a, l.b)),
grp AS (SELECT x AS field_path, min(y) AS g FROM reach GROUP BY x),
apart AS (SELECT DISTINCT g FROM (SELECT g FROM field JOIN grp USING (field_path) GROUP BY stream_id, file_seq, g HAVING count(DISTINCT field_path) > 1)),
last AS (SELECT field_path, count(*) AS n_last FROM field JOIN (SELECT stream_id, max(file_seq) AS file_seq FROM field GROUP BY 1) USING (stream_id, file_seq) GROUP BY 1),
name AS (SELECT field_path, CASE WHEN a.g IS NULL THEN p.g ELSE field_path END AS g, coalesce(n_last, 0) AS n_last, n FROM grp p LEFT JOIN apart a USING (g) LEFT JOIN last USING (field_path) JOIN (SELECT field_path, count(*) AS n FROM field GROUP BY 1) USING (field_path)),
named AS (SELECT field_path, first_value(field_path) OVER (PARTITION BY g ORDER BY n_last DESC, n DESC, field_path) AS col FROM name),
one AS (SELECT DISTINCT ON (stream_id, file_seq, line_no) stream_id, file_seq, payload FROM qc_report_raw ORDER BY stream_id, file_seq, line_no, loaded_at, record_id),
vals AS (SELECT n.col, t.type, t.atom FROM (SELECT payload FROM one WHERE json_valid(payload) AND json_type(payload) = 'OBJECT') v, json_tree(v.payload) t, named n
  WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%' AND n.field_path = replace(t.fullkey[3:], '"', '')),
typed AS (SELECT col, bool_or(type = 'ARRAY') AS a, bool_or(type = 'VARCHAR') AS s, bool_or(type = 'BOOLEAN') AS b, bool_or(type = 'DOUBLE') AS d, bool_or(type IN ('BIGINT', 'UBIGINT')) AS i FROM vals GROUP BY col)
SELECT col AS field_path, CASE WHEN a THEN 'array' WHEN s OR (b AND (d OR i)) THEN 'string' WHEN b THEN 'boolean' WHEN d THEN 'double' ELSE 'long' END AS type, count(*) AS n_values,
  round(CASE WHEN a OR s OR (b AND (d OR i)) THEN NULL WHEN b THEN sum(CAST(atom = 'true' AS DOUBLE)) ELSE sum(TRY_CAST(atom AS DOUBLE)) END, 3) AS total
FROM vals JOIN typed USING (col) GROUP BY col, a, s, b, d, i"""

SQL = {
    "p3_found": _CHANGE_SQL,
    "p3_columns": _COLUMNS_SQL,
    "p3_union_schema": _FIELDS_SQL + """SELECT field_path, CASE WHEN bool_or(type = 'array') THEN 'array' WHEN bool_or(type = 'string') OR count(DISTINCT type) > 1 THEN 'string' ELSE min(type) END AS type,
  count(*) AS n_files FROM field GROUP BY field_path""",
    "p1_found": _ORPHAN_SQL + "SELECT DISTINCT ref_table, row_id FROM lost",
    "p1_by_month": _ORPHAN_SQL + "SELECT ref_table, strftime(date_trunc('month', recorded_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS period, count(*) AS n_orphans FROM lost GROUP BY ALL",
    "p5_found": " UNION ALL ".join([
        _unpack_sql("proteins", "uniprot_ids_all", _CODES), _unpack_sql("metadata_pdb_count", "pdb_ids_before_af3_cutoff", _CODES),
        _unpack_sql("oligo_active_updated", "oligo_active_classes", _CODES), _unpack_sql("clustering_pilot_protein_overview", "binding_modules", _MODULES),
    ]),
}
