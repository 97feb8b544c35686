"""Logs and documents in JSON: the usage log, transcripts, evidence, benchmark manifests; and the sinks beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USAGE = "time string, tool string, project string, task string, ok boolean, ms double, outcome string, candidateTokens long, returnedTokens long, savedTokens long, fileTokens long, jevRequests long, jevInputTokens long, jevCost double, error string"
MANIFEST = "schemaVersion int, labelPolicy string, repositories map<string, struct<root: string, revision: string>>, cases array<struct<id: string, split: string, repository: string, task: string, entry: struct<file: string, line: int>, acceptableEntries: array<struct<file: string, line: int, endLine: int>>, required: array<struct<file: string, name: string, line: int, requiredLevel: string>>>>"
EVIDENCE = "path string, leads array<struct<name: string, range: struct<startLine: int, endLine: int>, score: double>>"


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Whole rows of a JSON-lines log; lines that don't parse or lack a required field are dropped."""
    raw = spark.read.schema(f"{USAGE}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    need = ("time", "tool", "project", "task", "ms", "outcome")
    fine = F.col("_bad").isNull()
    for c in need:
        fine = fine & F.col(c).isNotNull()
    return raw.where(fine).drop("_bad").withColumn("time", F.to_timestamp("time"))


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def recent_days(log: DataFrame, days: int) -> DataFrame:
    return log.where(F.col("time") >= F.current_timestamp() - F.make_dt_interval(days=F.lit(days)))


def transcripts(spark: SparkSession, path: str, byte_cap: int | None = None) -> DataFrame:
    """(session, block_type, block_name) of the blocks in per-session JSON-lines files.

    With a cap, sessions are taken newest first and one that doesn't fit is passed over.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("bytes"), "value")
    if byte_cap is not None:
        files = raw.select("session", "modified", "bytes").distinct().agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("modified")).alias("age"), "session", "bytes"))).alias("all"))
        zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))
        fits = lambda s, x: s["used"] + x["bytes"] <= byte_cap
        fold = F.aggregate("all", zero, lambda s, x: F.struct(F.when(fits(s, x), s["used"] + x["bytes"]).otherwise(s["used"]).alias("used"), F.when(fits(s, x), F.concat(s["kept"], F.array(x["session"]))).otherwise(s["kept"]).alias("kept")))
        raw = raw.join(files.select(F.explode(fold["kept"]).alias("session")), "session", "left_semi")
    line = F.from_json("value", "struct<cwd: string, message: struct<content: array<struct<type: string, name: string>>>>")
    return raw.select("session", F.explode(line["message"]["content"]).alias("b")).select("session", F.col("b.type").alias("block_type"), F.col("b.name").alias("block_name"))


def manifest_cases(spark: SparkSession, path: str, split: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """One row for each case of a manifest, with its repository's root and revision."""
    raw = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    cases = raw.select("repositories", F.explode("cases").alias("c")).select("c.*", F.col("repositories")[F.col("c.repository")].alias("at"))
    if split:
        cases = cases.where(F.col("split") == split)
    return cases.where(F.col("id").isin(*ids)) if ids else cases


def best_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, start_line, end_line, score): the best lead of each evidence document."""
    e = spark.read.schema(EVIDENCE).option("multiLine", "true").json(path)
    best = e.select("path", F.explode("leads").alias("l")).groupBy("path").agg(F.max_by("l", F.col("l.score")).alias("l"))
    return best.select("path", "l.name", F.col("l.range.startLine").alias("start_line"), F.col("l.range.endLine").alias("end_line"), "l.score")


def result_document(rows: DataFrame) -> DataFrame:
    """(json): each row as one document."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def answers(raw: DataFrame, column: str = "answer") -> DataFrame:
    """Adds score: a probability from any of the shapes in which a decision may come back; null for none."""
    get = lambda p: F.get_json_object(column, p)
    number = F.coalesce(*[get(p).try_cast("double") for p in ("$", "$.probability", "$.noul", "$.value")])
    flag = F.when(F.lower(get("$.value")) == "true", 1.0).when(F.lower(get("$.value")) == "false", 0.0)
    return raw.withColumn("score", F.coalesce(number, flag))


def first_of(df: DataFrame, by: str, order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")
