"""Reading bundles, run stores, plans and retriever stores as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTIONS = "case_id string, question string, gold_answer_id string, gold_evidence_set_id string, tags array<string>, metadata map<string,string>"
GOLD_ANSWERS = "gold_answer_id string, kind string, canonical string, accepted_values array<string>, locale string, unit string, tolerance string"
LOCATOR = "struct<type:string,start:bigint,end:bigint,object_type:string,object_id:string,table_id:string,row:string,column:string,page:bigint,x0:double,y0:double,x1:double,y1:double>"
GOLD_EVIDENCE = f"gold_evidence_set_id string, evidence array<struct<evidence_id:string,document_id:string,locator:{LOCATOR},canonical_value:string,quote_anchor:string>>, required_groups array<array<string>>, mses_paths array<array<array<string>>>"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with path and line number (from 1); blank lines are skipped, broken ones have `broken`.

    Whole files are read to number their lines, so this is for contracts and manifests; tables of traces need no line
    numbers and are read with spark.read.json.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "raw"))
    kind = T.StructType([*T._parse_datatype_string(schema), T.StructField("broken", T.StringType())])
    rows = whole.filter(F.trim("raw") != "").withColumn("row", F.from_json("raw", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    return rows.select("path", (F.col("line") + 1).alias("line"), "row.*")


def bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a question bundle: questions, gold answers, gold evidence (one row each), clauses, documents."""
    sets = jsonl(spark, f"{root}/gold_evidence.jsonl", GOLD_EVIDENCE)
    evidence = sets.select("gold_evidence_set_id", F.explode("evidence").alias("e")).select("gold_evidence_set_id", "e.*")
    paths = F.coalesce("mses_paths", F.array("required_groups"))
    clauses = sets.select("gold_evidence_set_id", F.posexplode(paths).alias("path", "clauses"))
    clauses = clauses.select("gold_evidence_set_id", "path", F.posexplode("clauses").alias("clause", "ids")).select("gold_evidence_set_id", "path", "clause", F.explode("ids").alias("evidence_id"))
    texts = spark.read.text(f"{root}/documents", wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("name"), F.col("value").alias("text"))
    return {"questions": jsonl(spark, f"{root}/questions.jsonl", QUESTIONS), "gold_answers": jsonl(spark, f"{root}/gold_answers.jsonl", GOLD_ANSWERS), "gold_evidence": evidence, "clauses": clauses, "documents": texts}


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of all files under root, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def canonical_records(spark: SparkSession, path: str) -> DataFrame:
    """Canonical object records; row and column keep apart whether they were numbers or text."""
    schema = "document_id string, object_id string, object_type string, canonical_value string, document_order bigint, status string, table_id string, row string, column string, attributes map<string,string>"
    raw = spark.read.text(path).filter(F.trim("value") != "")
    rows = raw.select("value", F.from_json("value", schema).alias("r")).select("value", "r.*")
    quoted = lambda name: F.col("value").rlike(f'"{name}"\\s*:\\s*"')
    return rows.withColumn("row_is_text", quoted("row")).withColumn("column_is_text", quoted("column")).drop("value")


def run_store(spark: SparkSession, root: str, schema: str, pattern: str = "run.json") -> DataFrame:
    """Run or case documents of a run store, with the folder that they are in."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root)
    return rows.withColumn("folder", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]*$", 1))


def plan(spark: SparkSession, path: str) -> DataFrame:
    """A planning CSV with a header; lines that begin with # are comments; `a or b` cells stay text, see alternatives."""
    return spark.read.option("header", "true").option("comment", "#").csv(path)


def alternatives(column: str):
    """array<string> of a cell of the form `x or y`."""
    return F.transform(F.split(F.lower(column), r"\s+or\s+"), lambda x: F.trim(x))


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, chunk_order_index, content, file_path, full_doc_id, start, end) of a key-value JSON file of text chunks."""
    value = "map<string,struct<chunk_order_index:bigint,content:string,file_path:string,full_doc_id:string,source_span:struct<start:bigint,end:bigint>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", value)).alias("chunk_id", "c"))
    return whole.select("chunk_id", "c.chunk_order_index", "c.content", "c.file_path", "c.full_doc_id", "c.source_span.start", "c.source_span.end")


def archive_union(primary: DataFrame, archive: DataFrame) -> DataFrame:
    """Runs of both stores, primary ones first on the same run_id."""
    from scorewright.operators.compare import first_wins

    return first_wins(primary, archive, "run_id")
