"""Readers of JSON lines, tab-separated chunk maps, text trees, predictions and annotation batches (O-001..O-010, O-021..O-027, O-096)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import as_int

QA_SCHEMA = (
    "task_id string, id string, task_type string, instruction string, question string, expected_response string, reference_answer string, response string, answer string, "
    "rag struct<prompt:string,contexts:array<string>,sources:array<string>,scores:array<double>,retrieved:array<struct<source_path:string,chunk_idx:int,text:string>>>, metadata string, split string"
)
CHUNK_COLUMNS = ("id", "source_path", "page", "chunk_index", "token_start", "token_end", "section_title", "text")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, drop_bad: bool = True) -> DataFrame:
    """JSON lines under a declared schema; blank lines don't count, bad ones are dropped or kept in _corrupt_record."""
    if drop_bad:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    st = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(T.StructType([*st.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def jsonl_issues(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, kind): lines that are no JSON object, with their number within the file.

    Files are read in splits; a line's number is its place in its split, told by
    consecutive ids, after the lines of the splits before.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), F.rtrim("value").alias("text"))
    splits = lines.groupBy("path", "start").agg(F.min("i").alias("lo"), F.count("*").alias("n"))
    bases = splits.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    bad = F.try_parse_json("text").isNull() | ~F.ltrim("text").startswith("{")
    return lines.where((F.trim("text") != "") & bad).join(bases, ["path", "start"]).select("path", (F.col("before") + F.col("i") - F.col("lo") + 1).cast("int").alias("line"), F.lit("invalid_json").alias("kind"))


def count_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, n): lines of each file that aren't blank."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("path"))
    return lines.groupBy("path").agg(F.count("*").alias("n"))


def read_chunk_map(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated chunk map, typed: a blank index falls back to the id, then 0; rows without source are dropped; page 'none' is null."""
    raw = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    have = set(raw.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return raw.select(
        as_int(col("id")).cast("bigint").alias("chunk_id"),
        F.trim(col("source_path")).alias("source_path"),
        as_int(F.when(~F.lower(F.trim(col("page"))).isin("", "none"), col("page"))).alias("page"),
        F.coalesce(as_int(col("chunk_index")), as_int(col("id")), F.lit(0)).alias("chunk_index"),
        as_int(col("token_start")).alias("token_start"),
        as_int(col("token_end")).alias("token_end"),
        F.nullif(F.trim(col("section_title")), F.lit("")).alias("section_title"),
        F.coalesce(col("text"), F.lit("")).alias("text"),
    ).where("coalesce(source_path, '') <> ''")


def read_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text): every .txt below a folder, one row each."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_split_dirs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON lines of one folder per split; the folder's name is the split."""
    return spark.read.schema(schema).json(pattern).withColumn("split", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def without_sidecar(documents: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Documents that no page record belongs to, to be read whole."""
    return documents.join(pages.select(key).distinct(), key, "left_anti")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_responses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(model_label, task_id, response): the last of each in file order, under either key name."""
    raw = spark.read.schema("model_label string, task_id string, id string, model_answer string, response string").json(paths)
    rows = raw.select("model_label", F.coalesce("task_id", "id").alias("task_id"), F.coalesce("model_answer", "response").alias("response"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("o"))
    return rows.where("task_id is not null and trim(coalesce(response, '')) <> ''").groupBy("model_label", "task_id").agg(F.max_by("response", "o").alias("response"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of batch files joined with their tasks; annotations without a task are dropped."""
    schema = "batch_id string, tasks array<struct<task_id:string,model_a:string,model_b:string>>, annotations array<struct<task_id:string,annotator_id:string,verdict:string,confidence:string>>"
    b = spark.read.schema(schema).option("multiLine", True).json(path)
    t = b.select("batch_id", F.explode("tasks").alias("t")).select("batch_id", "t.*")
    a = b.select("batch_id", F.explode("annotations").alias("a")).select("batch_id", "a.*")
    return a.join(t, ["batch_id", "task_id"])


def directory_changes(source: DataFrame, target: DataFrame, root_a: str, root_b: str) -> DataFrame:
    """(rel_path, action): copy, skip or extra, from two listings of :func:`file_hashes`."""
    a = source.select(F.regexp_replace("path", f"^.*{root_a}/", "").alias("rel_path"), F.col("sha256").alias("x"))
    b = target.select(F.regexp_replace("path", f"^.*{root_b}/", "").alias("rel_path"), F.col("sha256").alias("y"))
    return a.join(b, "rel_path", "full").select("rel_path", F.when(F.col("x").isNull(), "extra").when(F.col("y").isNull() | (F.col("x") != F.col("y")), "copy").otherwise("skip").alias("action"))
