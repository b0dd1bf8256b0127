"""Text formats and sinks (survey groups S and K): tables are written in a format and read back from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordmill.plans.classify import _bits, _BITS
from fjordmill.sources import readers, writers
from fjordmill.session import Workspace, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _path(spark: SparkSession, name: str) -> str:
    return Workspace(spark, name).root + "/" + name


@query("SELECT CAST(row_id AS VARCHAR) AS row_id, nullif(trim(uniprot_id), '') AS uniprot_id, nullif(trim(family), '') AS family, nullif(trim(ec_number), '') AS ec_number, CAST(NULL AS VARCHAR) AS missing FROM oligo_active_updated")
def s1_tsv_k1_columns(spark: SparkSession, d: str) -> DataFrame:
    cols = ["row_id", "uniprot_id", "family", "ec_number", "missing"]
    writers.write_tsv(table(spark, d, "oligo_active_updated"), p := _path(spark, "tsv"), cols)
    df = readers.read_tsv(spark, p, cols)
    return df.select(*(F.nullif(F.regexp_replace(c, "^ +| +$", ""), F.lit("")).alias(c) for c in cols))


@query("SELECT count(*) AS n FROM (SELECT 1 WHERE false)")
def s1_missing_path(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_tsv(spark, _path(spark, "nowhere"), ["a", "b"]).agg(F.count("*").alias("n"))


@query("SELECT pdb_code, chain FROM crystal_reference_list WHERE family = 'AA10' AND pdb_code IS NOT NULL")
def s3_semicolon_reference(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "crystal_reference_list").select("family", "pdb_code", F.coalesce("chain", F.lit("\\N")).alias("chain"))
    df.write.csv(p := _path(spark, "semicolon"), sep=";", header=True, emptyValue='""', nullValue="")
    got = readers.read_delimited(spark, p, ["family", "pdb_code"])
    return got.where("family = 'AA10' and pdb_code is not null").select("pdb_code", F.nullif(F.coalesce("chain", F.lit("")), F.lit("\\N")).alias("chain")).orderBy("pdb_code")


@query("SELECT row_id, sequence FROM proteins WHERE sequence IS NOT NULL")
def s6_fasta_k8(spark: SparkSession, d: str) -> DataFrame:
    writers.write_fasta(table(spark, d, "proteins").where("sequence is not null").withColumn("h", F.concat_ws("|", "row_id", F.regexp_replace(F.coalesce("organism", F.lit("")), ">", " "))), p := _path(spark, "fasta"), "h", "sequence")
    return readers.read_fasta(spark, p).select(F.split("header", r"\|")[0].cast("bigint").alias("row_id"), "sequence")


@query("SELECT DISTINCT protein_id AS id FROM proteins WHERE protein_id IS NOT NULL")
def s7_id_list(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "proteins").where("protein_id is not null").select("protein_id").distinct().coalesce(4).write.text(p := _path(spark, "ids"))
    return readers.read_ids(spark, p)


@query("""SELECT record_id, json_extract_string(payload, '$.overall_status') AS status, CAST(json_extract_string(payload, '$.privateer.total_sugars') AS VARCHAR) AS sugars FROM qc_report_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'""")
def s8_json_fields(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("payload")
    df = table(spark, d, "qc_report_raw").select("record_id", v.alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return df.select("record_id", F.try_variant_get("v", "$.overall_status", "string").alias("status"), F.try_variant_get("v", "$.privateer.total_sugars", "string").alias("sugars"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) = 'purchase' AS completed, count(*) AS n_events FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def s9_jsonl_k9(spark: SparkSession, d: str) -> DataFrame:
    """Two appended batches of event lines and one broken line, replayed."""
    from fjordmill.operators import replay

    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    p = _path(spark, "log")
    for part in (e.where("event_type = 'error'"), e.where("event_type <> 'error'")):
        writers.write_jsonl(part, p, append=True)
    spark.range(1).select(F.lit('{"event_id": 1, "user').alias("v")).write.mode("append").text(p)
    got = readers.read_jsonl(spark, p, "event_id long, user_id long, event_type string, at long")
    return replay.last_state(got, "user_id", "event_type", ["at", "event_id"], done="purchase", revoked="error")


@query("SELECT CAST(row_id AS VARCHAR) AS id, CASE WHEN sequence_length > 250 THEN 'SP' ELSE 'OTHER' END AS prediction, CASE WHEN sequence_length > 250 THEN sequence_length % 40 END AS cleavage FROM proteins")
def s11_signalp(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("sequence_length")
    line = F.concat_ws("\t", "row_id", F.when(n > 250, "SP").otherwise("OTHER"), F.lit("0.1"), F.when(n > 250, F.concat(F.lit("CS pos: "), n % 40, F.lit("-"), n % 40 + 1)).otherwise(""))
    table(spark, d, "proteins").select(line).write.text(p := _path(spark, "signalp"))
    return readers.read_signalp(spark, p)


@query("SELECT 'NAG' AS sugar, 'B' AS chain, l_linenumber AS number, l_discount AS score, CASE WHEN l_returnflag = 'A' THEN 'yes' ELSE 'check' END AS verdict FROM lineitem")
def s12_validation_rows(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("  NAG-B-"), F.col("l_linenumber"), F.lit("   "), F.col("l_discount").cast("string"), F.lit("  "), F.when(F.col("l_returnflag") == "A", "yes").otherwise("check"))
    table(spark, d, "lineitem").select(line).write.text(p := _path(spark, "rows"))
    return readers.read_validation_rows(spark, p)


@query("SELECT test, CAST(outcome AS VARCHAR) AS outcome FROM (SELECT CAST(p_brand AS VARCHAR) AS p_brand, CAST(p_type AS VARCHAR) AS p_type, CAST(p_size AS VARCHAR) AS p_size FROM part ORDER BY p_partkey LIMIT 1) UNPIVOT (outcome FOR test IN (p_brand, p_type, p_size))")
def s13_first_row(spark: SparkSession, d: str) -> DataFrame:
    return readers.first_row_long(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey")


@query("SELECT CAST(vec_id AS INT) AS serial, 'C' AS atom, 'ALA' AS residue, 'A' AS chain, CAST(label AS INT) AS number, round(CAST(embedding[1] AS DOUBLE), 3) AS x, round(CAST(embedding[2] AS DOUBLE), 3) AS y, round(CAST(embedding[3] AS DOUBLE), 3) AS z FROM embeddings")
def s17_pdb_atoms(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.lpad(F.format_string("%.3f", F.element_at("embedding", i).cast("double")), 8, " ")
    line = F.concat(F.lit("ATOM  "), F.lpad(F.col("vec_id").cast("string"), 5, " "), F.lit("  C   ALA A"), F.lpad(F.col("label").cast("string"), 4, " "), F.lit("    "), e(1), e(2), e(3))
    table(spark, d, "embeddings").select(line).write.text(p := _path(spark, "pdb"))
    return readers.read_pdb_atoms(spark, p)


@query("SELECT pose_key, len(ifp_lpmo_bitvector) AS n_bits, CAST(list_sum(ifp_lpmo_bitvector) AS BIGINT) AS n_on FROM cbm_analysis_result WHERE ifp_lpmo_bitvector IS NOT NULL")
def s19_json_cells(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stored as JSON text in table cells, reloaded."""
    df = table(spark, d, "cbm_analysis_result").where("ifp_lpmo_bitvector is not null").select(F.col("pose_key").cast("string").alias("pose_key"), F.to_json("ifp_lpmo_bitvector").alias("cell"))
    writers.write_tsv(df, p := _path(spark, "cells"), ["pose_key", "cell"])
    v = F.from_json("cell", "array<int>")
    return readers.read_tsv(spark, p, ["pose_key", "cell"]).select(F.col("pose_key").cast("bigint"), F.size(v).cast("bigint").alias("n_bits"), F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_on"))


@query(f"SELECT CAST(pose_key AS VARCHAR) AS pose_key, CAST(feature AS VARCHAR) AS feature, CAST(1 AS DOUBLE) AS value FROM (SELECT DISTINCT pose_key, feature FROM {_BITS})")
def s20_matrix_k2(spark: SparkSession, d: str) -> DataFrame:
    b = _bits(spark, d).select("pose_key", "feature", F.lit(1).alias("bit"))
    names = sorted(r.feature for r in b.select("feature").distinct().collect())  # the width of the vectors
    writers.write_matrix(b, p := _path(spark, "matrix"), "pose_key", "feature", "bit", names)
    return readers.read_matrix(spark, p, "pose_key").where("value <> 0")


@query("SELECT 'shard_' || (c_custkey % 3) AS source_file, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def s23_shards(spark: SparkSession, d: str) -> DataFrame:
    c, root = table(spark, d, "customer"), _path(spark, "shards")
    for i in range(3):
        c.where(F.col("c_custkey") % 3 == i).select("c_custkey", "c_acctbal").write.json(f"{root}/shard_{i}")
    return readers.read_shards(spark, root + "/shard_*", "c_custkey long, c_acctbal double").groupBy("source_file").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT pose_key, condition_id, passed FROM geometry_result WHERE coalesce(passed, false)")
def k3_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The per-pose metrics file leaves dropped poses out."""
    g = table(spark, d, "geometry_result").where(F.coalesce("passed", F.lit(False))).select(F.col("pose_key").cast("string"), "condition_id", F.col("passed").cast("string"))
    writers.write_tsv(g, p := _path(spark, "metrics"), ["pose_key", "condition_id", "passed"], sep=",")
    return readers.read_tsv(spark, p, ["pose_key", "condition_id", "passed"], sep=",").select(F.col("pose_key").cast("bigint"), "condition_id", F.col("passed").cast("boolean"))


@query("""SELECT '{"n_poses":' || count(*) || ',"n_conditions":' || count(DISTINCT condition_id) || '}' AS summary FROM geometry_result""")
def k4_summary_json(spark: SparkSession, d: str) -> DataFrame:
    return writers.summary_json(table(spark, d, "geometry_result").agg(F.count("*").alias("n_poses"), F.countDistinct("condition_id").alias("n_conditions")))


@query("SELECT pose_key, coalesce(passed, false) AS passed, CASE WHEN coalesce(passed, false) THEN 'pass' ELSE 'fail' END AS overall FROM geometry_result")
def k5_report_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested reports written and read as JSON under an explicit schema."""
    ok = F.coalesce("passed", F.lit(False))
    writers.write_jsonl(table(spark, d, "geometry_result").select("pose_key", F.struct(ok.alias("passed"), F.when(ok, "pass").otherwise("fail").alias("overall")).alias("verdict")), p := _path(spark, "reports"))
    return readers.read_jsonl(spark, p, "pose_key long, verdict struct<passed: boolean, overall: string>").select("pose_key", "verdict.passed", "verdict.overall")


@query("SELECT p_partkey, p_brand, p_size, p_retailprice, typeof(CAST(p_partkey AS INT)) = 'INTEGER' AS is_int FROM part")
def s2_typed_csv(spark: SparkSession, d: str) -> DataFrame:
    """Types inferred from the text: whole numbers, numbers and text."""
    table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice").write.csv(p := _path(spark, "inferred"), header=True, sep="\t")
    got = readers.read_inferred(spark, p)
    kinds = dict(got.dtypes)
    return got.select(F.col("p_partkey").cast("bigint"), "p_brand", "p_size", "p_retailprice", F.lit(kinds["p_partkey"] == "int" and kinds["p_retailprice"] == "double").alias("is_int"))


@query(r"""WITH r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) + 1 AS line_no, trim(replace(replace(coalesce(uniprot_id, ''), ';', ' '), '\n', ' ')) AS u FROM oligo_active_updated)
SELECT row_id, line_no, len(list_filter(string_split_regex(upper(u), '[\s,;|/]+'), lambda x: lower(x) NOT IN ('', '-', 'nan', 'none'))) AS n_tokens FROM r""")
def s4_token_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a header-checked file with their line numbers and the ids of a cell as an array."""
    cell = F.trim(F.translate(F.coalesce("uniprot_id", F.lit("")), ";\n", "  "))
    rows = table(spark, d, "oligo_active_updated").select("row_id", F.concat_ws(";", F.col("row_id"), cell).alias("v")).orderBy("row_id")
    lines = spark.createDataFrame([(-1, "Row ; UniProt;GenBank")], "row_id long, v string").unionByName(rows).coalesce(1).orderBy("row_id").select("v").coalesce(1)
    lines.write.text(p := _path(spark, "characterized"))
    got = readers.token_arrays(readers.read_checked(spark, p, ["uniprot", "genbank"]), {"ids": "uniprot"})
    return got.select(F.col("row").cast("bigint").alias("row_id"), "line_no", F.size("ids").cast("bigint").alias("n_tokens"))


@query(r"""WITH r AS (SELECT row_id, organism, protein_id, CASE row_id % 3 WHEN 0 THEN 'ncbi' WHEN 1 THEN 'jgi' ELSE 'other' END AS source FROM proteins WHERE organism IS NOT NULL AND protein_id IS NOT NULL)
SELECT 'ncbi' AS kind, NULL AS organism, count(*) AS n, NULL AS ids FROM r WHERE source = 'ncbi' UNION ALL SELECT 'jgi', array_to_string(string_split_regex(trim(organism), '\s+')[1:2], ' '), count(*), array_to_string(list_sort(list(trim(protein_id))), ',') FROM r WHERE source = 'jgi' GROUP BY ALL""")
def s5_organism_groups(spark: SparkSession, d: str) -> DataFrame:
    """Accessions of the nucleotide databases, and those of the genome portal by genus and species."""
    r = table(spark, d, "proteins").where("organism is not null and protein_id is not null")
    source = F.when(F.col("row_id") % 3 == 0, "NCBI").when(F.col("row_id") % 3 == 1, "jgi").otherwise("other")
    version = F.when(F.col("row_id") % 2 == 0, F.concat("organism", F.lit(" v1.0"))).otherwise(F.col("organism"))
    r.select(F.concat_ws("\t", F.lit("AA9"), F.lit("Eukaryota"), version, "protein_id", source)).write.text(p := _path(spark, "export"))
    spark.range(1).select(F.lit("AA9\tshort")).write.mode("append").text(p)
    plain, groups = readers.read_family_export(spark, p)
    none = F.lit(None).cast("string")
    one = plain.agg(F.count("*").alias("n")).select(F.lit("ncbi").alias("kind"), none.alias("organism"), "n", none.alias("ids"))
    return one.unionByName(groups.select(F.lit("jgi").alias("kind"), "organism", F.size("accessions").cast("bigint").alias("n"), F.array_join("accessions", ",").alias("ids")))


@query("""SELECT 'd' || l_linenumber AS domain_name, CAST(l_quantity AS INT) * 4 AS model_length, 'q' || l_orderkey AS query_name, CAST(l_quantity AS INT) + 300 AS seq_length, l_discount AS evalue, l_tax AS score, 1 AS hmm_from, 9 AS hmm_to, l_linenumber AS seq_start, l_linenumber + 20 AS seq_end, CAST(0.5 AS DOUBLE) AS acc, 'a long name' AS description, 'x' AS source, 21 AS alignment_length, round(21.0 / (CAST(l_quantity AS INT) * 4), 9) AS coverage FROM lineitem""")
def s10_domtblout(spark: SparkSession, d: str) -> DataFrame:
    """All 22 fields of a domain table, and what follows from them."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    cells = {"domain_name": F.concat(F.lit("d"), n), "model_length": q * 4, "query_name": F.concat(F.lit("q"), "l_orderkey"), "seq_length": q + 300, "evalue": F.col("l_discount"), "score": F.col("l_tax"), "hmm_from": F.lit(1), "hmm_to": F.lit(9), "seq_start": n, "seq_end": n + 20, "acc": F.lit("0.5")}
    line = F.concat_ws("   ", *(cells.get(name, F.lit("-")) for name, _ in readers.DOMTBLOUT), F.lit("a long name"))
    table(spark, d, "lineitem").select(line).write.text(p := _path(spark, "domtblout"))
    spark.range(1).select(F.lit("# comment   x")).write.mode("append").text(p)
    got = readers.read_domtblout(spark, p, "x")
    return got.select(*cells, "description", "source", "alignment_length", F.round("coverage", 9).alias("coverage"))


@query("""WITH p AS (SELECT o_custkey % 5 AS t, o_orderkey % 5 AS r, o_orderkey % 7 AS seed, o_orderkey % 3 AS sample FROM orders), b AS (SELECT t, CASE WHEN t % 4 = 0 THEN 9 ELSE max(r) END AS r FROM p GROUP BY t), a AS (SELECT t, CASE WHEN t % 4 = 0 AND r = 2 THEN 9 ELSE r END AS r, seed, sample FROM p), c AS (SELECT t, max(r) AS r FROM a GROUP BY t)
SELECT CAST(t AS VARCHAR) AS target, CASE WHEN r = 9 THEN 2147483647 ELSE CAST(r AS INT) END AS run, CAST(seed AS INT) AS seed, CAST(sample AS INT) AS sample, 1 AS n FROM (SELECT DISTINCT a.* FROM a JOIN c USING (t, r))""")
def s14_discover(spark: SparkSession, d: str) -> DataFrame:
    """Result files found in a folder: a real tree is written and listed; of each target the latest run."""
    k = F.col("o_orderkey")
    t, r = F.col("o_custkey") % 5, k % 5
    run = F.when((t % 4 == 0) & (r == 2), "latest").otherwise(F.concat(F.lit("run_"), r))
    root = _path(spark, "tree")
    rows = table(spark, d, "orders").select(t.cast("string").alias("t"), run.alias("run"), F.concat(F.lit("seed-"), k % 7, F.lit("_sample-"), k % 3).alias("s")).distinct()
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for x in rows.collect():  # the tree of this test: 525 files at most, whatever the table
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{x.t}/{x.run}/{x.s}/model.cif"))
        out.write(35)
        out.close()
    return readers.discover(readers.list_files(spark, root, "*.cif")).groupBy("target", "run", "seed", "sample").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT condition_id, pose_key FROM cbm_analysis_result WHERE condition_id IS NOT NULL AND cbm_ligand_min_dist IS NOT NULL), f AS (SELECT condition_id, min(pose_key) AS pose_key FROM geometry_result WHERE condition_id NOT IN (SELECT condition_id FROM a) GROUP BY 1),
u AS (SELECT condition_id, pose_key, 'pose' AS origin FROM a UNION ALL SELECT condition_id, pose_key, 'top_model' FROM f) SELECT condition_id, pose_key, origin FROM (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY pose_key) AS r FROM u) WHERE r <= 5""")
def s15_fallback_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Poses of each condition in order, five at most; of conditions without any the top model."""
    poses = table(spark, d, "cbm_analysis_result").where("condition_id is not null").select("condition_id", "pose_key", F.col("cbm_ligand_min_dist").isNotNull().alias("usable")).distinct()
    top = table(spark, d, "geometry_result").groupBy("condition_id").agg(F.min("pose_key").alias("pose_key"))
    return readers.pose_inputs(poses, top, "condition_id", ["pose_key"], keep=F.col("usable"), cap=5).select("condition_id", "pose_key", "origin")


@query("""WITH s AS (SELECT pilot_rank, min(uniprot_id) AS uniprot_id FROM clustering_pilot_protein_overview WHERE pilot_rank <= 5 GROUP BY 1) SELECT 'table' AS origin, pilot_rank, uniprot_id, run_domain_only, lower(coalesce(has_cbm, '')) = 'ja' AS has_cbm FROM clustering_pilot_protein_overview UNION ALL SELECT 'manifest', pilot_rank, uniprot_id, true, NULL FROM s WHERE uniprot_id IS NOT NULL""")
def s22_pilot_overview(spark: SparkSession, d: str) -> DataFrame:
    """The overview table, and a selection manifest of its first ranks as text that is read back."""
    o = table(spark, d, "clustering_pilot_protein_overview")
    one = o.select(F.lit("table").alias("origin"), "pilot_rank", "uniprot_id", "run_domain_only", (F.lower(F.coalesce("has_cbm", F.lit(""))) == "ja").alias("has_cbm"))
    top = o.where("pilot_rank <= 5").groupBy("pilot_rank").agg(F.min("uniprot_id").alias("uniprot_id")).where("uniprot_id is not null").collect()  # a manifest of five entries
    text = "selection:\n" + "".join(f"  - pilot_rank: {r.pilot_rank}\n    uniprot_id: '{r.uniprot_id}'  # id\n    run_domain_only: true\n" for r in top)
    entries = [(e["pilot_rank"], str(e["uniprot_id"]), e["run_domain_only"]) for e in readers.read_selection(text)]
    two = spark.createDataFrame(entries, "pilot_rank int, uniprot_id string, run_domain_only boolean")
    return one.unionByName(two.select(F.lit("manifest").alias("origin"), "pilot_rank", "uniprot_id", "run_domain_only", F.lit(None).cast("boolean").alias("has_cbm")))
