"""Readers of the text formats, each a plan over spark.read; nothing is read on the driver but headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_tsv(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """All columns as text, blanks as null; a missing path is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, sep=sep, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=False)


def read_inferred(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited file whose column types are inferred from its values (a pass over the file; give a schema for large
    ones)."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True, escape='"')


def read_delimited(spark: SparkSession, path: str, required: list[str], sep: str = ";") -> DataFrame:
    """A delimited file with quoting whose header must hold the required columns; short rows are padded with nulls."""
    df = spark.read.csv(path, sep=sep, header=True, mode="PERMISSIVE")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_checked(spark: SparkSession, path: str, required: list[str], sep: str = ";", forbidden: str = ",") -> DataFrame:
    """(line_no, columns): a delimited file whose header must hold the required columns, with ``sep`` and without the
    forbidden mark; names are compared in lower case without blanks. Short rows are padded with blanks, blank rows left
    out; line numbers count from the header's 1. Cells are not quoted. The header is all that comes to the driver."""
    place = ["_file", "_start", "_at"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    first = lines.orderBy(*place).limit(1).collect()
    if not first:
        raise ValueError("the file is empty; a header is expected")
    header = first[0].value
    if sep not in header or forbidden in header:
        raise ValueError(f"the header must have {sep!r} between its columns and no {forbidden!r}")
    names = [h.strip().lower() for h in header.split(sep)]
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    from fjordmill.operators.manifest import ordinals

    blank = F.regexp_replace("value", f"[{sep} ]", "") == ""
    numbered = ordinals(lines, place, "line_no").where((F.col("value") != header) & ~blank)
    cell = F.split("value", f"[{sep}]", -1)
    return numbered.select("line_no", *(F.trim(F.coalesce(F.get(cell, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)))


def token_arrays(rows: DataFrame, columns: dict[str, str], placeholders: tuple[str, ...] = ("", "-", "nan", "none")) -> DataFrame:
    """Cells of several ids as arrays: upper case, without versions (.1), in order, each once. columns: name -> column."""
    def tokens(c: str):
        parts = F.transform(F.split(F.upper(F.col(c)), r"[\s,;|/]+"), lambda x: F.regexp_replace(x, r"\.\d+$", ""))
        return F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin(*placeholders)))

    return rows.withColumns({name: tokens(c) for name, c in columns.items()})


def read_family_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A tab export family, kingdom, organism, accession, source -> ((accession) of the nucleotide databases, (organism,
    accessions) of the genome portal by genus and species). Lines below five fields are left out; versions (v1.0) are no
    part of an organism."""
    f = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 5).select(F.trim(F.col("f")[2]).alias("organism"), F.trim(F.col("f")[3]).alias("accession"), F.lower(F.trim(F.col("f")[4])).alias("source"))
    words = F.split(F.trim(F.regexp_replace("organism", r"\s+v\d+(\.\d+)*\b", "")), r"\s+")
    named = rows.where("source = 'jgi'").select(F.array_join(F.slice(words, 1, 2), " ").alias("organism"), "accession")
    return rows.where(F.col("source").isin("ncbi", "genbank")).select("accession"), named.groupBy("organism").agg(F.array_sort(F.collect_list("accession")).alias("accessions"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence): one record per header line, sequence lines joined."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    record = F.regexp_replace("value", "^>", "")
    return raw.select(F.trim(F.substring_index(record, "\n", 1)).alias("header"), F.regexp_replace(F.expr("substring(regexp_replace(value, '^>', ''), locate('\n', regexp_replace(value, '^>', '')) + 1)"), r"\s", "").alias("sequence"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event logs: lines that don't parse are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


#: Fields of a domain table, in order: name, type. What follows the last is the description.
DOMTBLOUT = (
    ("domain_name", "string"), ("target_accession", "string"), ("model_length", "int"), ("query_name", "string"), ("query_accession", "string"), ("seq_length", "int"), ("evalue", "double"), ("full_score", "double"), ("full_bias", "double"),
    ("domain_number", "int"), ("n_domains", "int"), ("c_evalue", "double"), ("i_evalue", "double"), ("score", "double"), ("bias", "double"), ("hmm_from", "int"), ("hmm_to", "int"), ("seq_start", "int"), ("seq_end", "int"), ("env_from", "int"), ("env_to", "int"), ("acc", "double"),
)


def read_domtblout(spark: SparkSession, path: str, source: str = "") -> DataFrame:
    """Domain tables: columns by white space, comments and rows below 22 fields left out; with the length of the
    alignment, its share of the model, the description and the source. A missing path is an empty table."""
    lines = spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= len(DOMTBLOUT))
    cells = [(F.col("f")[i] if t == "string" else F.col("f")[i].try_cast(t)).alias(n) for i, (n, t) in enumerate(DOMTBLOUT)]
    rest = F.array_join(F.slice("f", len(DOMTBLOUT) + 1, F.greatest(F.size("f"), F.lit(1))), " ")
    length = F.col("seq_end") - F.col("seq_start") + 1
    return rows.select(*cells, rest.alias("description"), F.lit(source).alias("source")).withColumns({"alignment_length": length, "coverage": F.when(F.coalesce("model_length", F.lit(0)) == 0, 0.0).otherwise(length / F.col("model_length"))})


def read_signalp(spark: SparkSession, path: str) -> DataFrame:
    """Signal-peptide calls: id, prediction and cleavage position."""
    v = F.split("value", "\t")
    cut = F.regexp_extract("value", r"CS pos: (\d+)-(\d+)", 1)
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(v[0].alias("id"), v[1].alias("prediction"), F.nullif(cut, F.lit("")).cast("int").alias("cleavage"))


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atom lines of fixed width."""
    v = lambda a, n: F.trim(F.substring("value", a, n))
    return spark.read.text(path).where(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")).select(
        v(7, 5).try_cast("int").alias("serial"), v(13, 4).alias("atom"), v(18, 3).alias("residue"), v(22, 1).alias("chain"), v(23, 4).try_cast("int").alias("number"),
        v(31, 8).try_cast("double").alias("x"), v(39, 8).try_cast("double").alias("y"), v(47, 8).try_cast("double").alias("z"),
    )


def read_validation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Validation lines ``NAME-CHAIN-NUMBER  score  verdict``."""
    p = r"^\s*([A-Z0-9]{3})-([A-Z])-(\d+)\s+([0-9.]+)\s+(\w+)"
    g = lambda i: F.regexp_extract("value", p, i)
    return spark.read.text(path).where(F.col("value").rlike(p)).select(g(1).alias("sugar"), g(2).alias("chain"), g(3).cast("int").alias("number"), g(4).try_cast("double").alias("score"), g(5).alias("verdict"))


def first_row_long(df: DataFrame, order: str) -> DataFrame:
    """The first row of a wide table as (test, outcome) rows."""
    tests = [c for c in df.columns if c != order]
    one = df.orderBy(order).limit(1)
    return one.select(*(F.col(c).cast("string").alias(c) for c in tests)).unpivot([], tests, "test", "outcome")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below a folder, listed by the executors; a missing folder is empty."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, length long, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def discover(paths: DataFrame, column: str = "path", latest_only: bool = True, targets: list[str] | None = None, models: bool = False) -> DataFrame:
    """Result files by the segments of their paths: .../target/run_N/seed-S_sample-T/..., with a model between target and
    run where there are ``models``; of each target (and model) the run called latest, or the greatest, or all of them;
    of the given targets, or all."""
    p = rf"([^/]+)/{'([^/]+)/' if models else '()'}(?:run_(\d+)|(latest))/seed-(\d+)_sample-(\d+)/"
    g = lambda i: F.regexp_extract(column, p, i)
    parts = paths.where(F.col(column).rlike(p)).select(column, g(1).alias("target"), F.nullif(g(2), F.lit("")).alias("model"), F.when(g(4) == "latest", 2147483647).otherwise(g(3).try_cast("int")).alias("run"), g(5).cast("int").alias("seed"), g(6).cast("int").alias("sample"))
    if targets is not None:
        parts = parts.where(F.col("target").isin(*targets))
    if not latest_only:
        return parts
    best = parts.groupBy("target", "model").agg(F.max("run").alias("_run"))
    return parts.join(best, parts.target.eqNullSafe(best.target) & parts.model.eqNullSafe(best.model) & (parts.run == best._run), "left_semi")


def pose_inputs(poses: DataFrame, top_models: DataFrame, condition: str, order: list, *, keep=None, cap: int | None = None) -> DataFrame:
    """Pose files, and of conditions that have none the top model's, with their origin: filtered, in a total order, and
    (where that is asked for) the first ``cap`` of each condition."""
    own = poses if keep is None else poses.where(keep)
    out = own.withColumn("origin", F.lit("pose")).unionByName(top_models.join(own, condition, "left_anti").withColumn("origin", F.lit("top_model")), allowMissingColumns=True)
    if cap is None:
        return out.orderBy(condition, *order)
    ranked = out.withColumn("_r", F.row_number().over(Window.partitionBy(condition).orderBy(*order)))
    return ranked.where(F.col("_r") <= cap).drop("_r").orderBy(condition, *order)


def read_selection(text: str) -> list[dict]:
    """Entries of a selection manifest: a list of ``- key: value`` blocks (the part of YAML these files use)."""
    out: list[dict] = []
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        entry = body.strip()
        if entry.startswith("- "):
            out.append({})
            entry = entry[2:].strip()
        if out and ":" in entry:
            k, v = (x.strip().strip("\"'") for x in entry.split(":", 1))
            if v:
                out[-1][k] = {"true": True, "false": False}.get(v.lower(), int(v) if v.lstrip("-").isdigit() else v)
    return out


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a pattern, with the file each row came from."""
    return spark.read.schema(schema).json(pattern).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_matrix(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A wide matrix file as (key, feature, value)."""
    df = spark.read.csv(path, header=True)
    names = [c for c in df.columns if c != key]
    return df.unpivot([key], names, "feature", "value").withColumn("value", F.col("value").try_cast("double"))
