"""Readers and writers of the experiment's JSON files.

Schemas are stated, never inferred. Whole-file JSON arrays are read for
compatibility; one record per line is the splittable layout to keep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imagora.functions import text as tx

CORPUS = "skill_id string, name string, description string, content string"
INSTANCE = ("instance_id string, dataset string, question string, "
            "skill_annotations array<string>, eval_data struct<answer: string, answer_type: string>")
HIT = "struct<skill_id: string, score: double>"
RECORD = f"instance_id string, gold_skill_ids array<string>, retrieved array<{HIT}>"
PAYLOAD = (
    "metadata map<string, string>, metrics map<string, double>, results array<struct<"
    f"instance_id: string, gold_skill_ids: array<string>, retrieved: array<{HIT}>>>")
PACK = "instance_id string, domain string, query string, imaginations map<string, array<string>>"
OUTCOMES = "metrics map<string, double>, details array<struct<instance_id: string, correct: boolean>>"
NAME_PATTERN = r"([^/=]*?)-([^/]*)\.json"
STEM_PATTERN = r"(?:^|[/=])([^/=-]+-[^/=]*?\.json)(?:/|$)"
FALLBACK_META_CHARS = 200


def read_corpus(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """(doc_id, name, description, content)."""
    df = spark.read.schema(CORPUS).option("multiLine", array_file).json(path)
    return df.withColumnRenamed("skill_id", "doc_id")


def corpus_fields(index: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, has_record, meta, body, code) for every indexed document.

    An id without a record falls back to its text: the first 200 characters as
    meta, all of it as body, no code. ``index``: doc_id, text.
    """
    rec = records.select("doc_id", tx.fields(
        F.col("name"), F.col("description"), F.col("content")).alias("f"))
    bare = F.struct(F.substring("text", 1, FALLBACK_META_CHARS).alias("meta"),
                    F.col("text").alias("body"), F.lit("").alias("code"))
    joined = index.join(rec, "doc_id", "left")
    return joined.select("doc_id", F.col("f").isNotNull().alias("has_record"),
                         F.coalesce("f", bare).alias("f")).select("doc_id", "has_record", "f.*")


def read_instances(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """(instance_id, domain, query, gold, eval_data) of annotated rows."""
    df = spark.read.schema(INSTANCE).option("multiLine", array_file).json(path)
    return annotated(df)


def annotated(instances: DataFrame) -> DataFrame:
    return instances.filter(F.size("skill_annotations") > 0).select(
        "instance_id", F.col("dataset").alias("domain"), F.col("question").alias("query"),
        F.col("skill_annotations").alias("gold"), "eval_data")


def instance_problems(instances: DataFrame, domain: str | None = None) -> DataFrame:
    """(instance_id, problem): repeated ids, blank queries, and rows of another domain."""
    repeated = instances.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1") \
        .select("instance_id", F.lit("duplicate").alias("problem"))
    blank = instances.filter(F.coalesce(tx.is_blank(F.col("query")), F.lit(True))).select(
        "instance_id", F.lit("empty").alias("problem"))
    repeated = repeated.unionByName(blank)
    if domain is None:
        return repeated
    foreign = instances.filter(F.col("domain") != domain).select(
        "instance_id", F.lit("domain").alias("problem"))
    return repeated.unionByName(foreign)


def explode_hits(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records -> (keep, instance_id, rank, doc_id, score), rank from 1."""
    return records.select(*keep, "instance_id", F.posexplode("retrieved").alias("pos", "hit")).select(
        *keep, "instance_id", (F.col("pos") + 1).alias("rank"), F.col("hit.skill_id").alias("doc_id"),
        F.col("hit.score").alias("score"))


def explode_gold(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return records.select(*keep, "instance_id", F.explode("gold_skill_ids").alias("doc_id"))


def _payloads(spark: SparkSession, path: str, array_file: bool) -> DataFrame:
    """Run files with their name, without the ``.eval.json`` ones.

    A file may be a folder of that name with parts of the run as lines.
    """
    raw = spark.read.schema(PAYLOAD).option("multiLine", array_file).option(
        "recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), STEM_PATTERN, 1)
    name = F.when(stem != "", stem).otherwise(F.col("_metadata.file_name"))
    return raw.withColumn("file", name).filter(~F.col("file").endswith(".eval.json"))


def read_run_payload(spark: SparkSession, path: str,
                     array_file: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-document runs -> (records, metadata rows, metric rows), each with the file."""
    raw = _payloads(spark, path, array_file)
    records = raw.select("file", F.explode("results").alias("r")).select("file", "r.*")
    meta = raw.select("file", F.explode("metadata").alias("key", "value"))
    values = raw.select("file", F.explode("metrics").alias("metric", "value"))
    return records, meta, values


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Runs kept as one record per line, with partition columns for identity."""
    return spark.read.schema(RECORD + ", domain string, variant string").json(path)


def write_run_records(run: DataFrame, gold: DataFrame, path: str, depth: int = 50) -> None:
    """(domain, variant, instance_id, rank, doc_id, score) -> record lines."""
    hit = F.struct("rank", F.col("doc_id").cast("string").alias("skill_id"), "score")
    lists = run.filter(F.col("rank") <= depth).groupBy("domain", "variant", "instance_id").agg(
        F.transform(F.sort_array(F.collect_list(hit)),
                    lambda h: F.struct(h["skill_id"].alias("skill_id"), h["score"].alias("score")))
        .alias("retrieved"))
    g = gold.groupBy("instance_id").agg(F.array_sort(F.collect_set(
        F.col("doc_id").cast("string"))).alias("gold_skill_ids"))
    lists.join(g, "instance_id", "left").withColumn(
        "gold_skill_ids", F.coalesce("gold_skill_ids", F.array().cast("array<string>"))
    ).withColumn("instance_id", F.col("instance_id").cast("string")).write.mode("overwrite") \
        .partitionBy("domain", "variant").json(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACK).json(path)


def pack_texts(packs: DataFrame) -> DataFrame:
    """(instance_id, domain, query, template, sample_index, text)."""
    return packs.select("instance_id", "domain", "query",
                        F.explode("imaginations").alias("template", "texts")).select(
        "instance_id", "domain", "query", "template", F.posexplode("texts").alias("sample_index", "text"))


def read_outcomes(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """(instance_id, correct) rows of an outcome file."""
    df = spark.read.schema(OUTCOMES).option("multiLine", array_file).json(path)
    return df.select(F.explode("details").alias("d")).select("d.instance_id", "d.correct")


def file_identity(path: Column) -> tuple[Column, Column]:
    """(dataset, variant) out of ``<dataset>-<variant>.json``; the first dash
    splits, the variant may hold more."""
    return (F.regexp_extract(path, NAME_PATTERN, 1).alias("dataset"),
            F.regexp_extract(path, NAME_PATTERN, 2).alias("variant"))


def read_named_runs(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """(dataset, variant, instance_id, gold_skill_ids, retrieved) of all run files
    under a path, without the ``.eval.json`` ones."""
    return _payloads(spark, path, array_file).select(
        *file_identity(F.col("file")), F.explode("results").alias("r")).select("dataset", "variant", "r.*")


def write_jsonl(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Gzip JSON lines in one global order with fields by name.

    The order runs over the part files by number; nothing is gathered in a
    single task.
    """
    df.select(*sorted(df.columns)).orderBy(*order).write.mode("overwrite").option(
        "compression", "gzip").json(path)
