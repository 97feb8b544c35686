"""Judges: where semantic scores come from. A judge turns candidates(id, payload) into scores(id, include, score)."""

from __future__ import annotations

import json
import urllib.request
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.logs import answers

BATCH, AT_ONCE, RETRIES, TIMEOUT = 16, 4, 1, 30
# How much of a text goes into a question.
SOURCE_CHARS, CONTEXT_CHARS, SITE_CHARS = 4000, 3000, 600


class Judge(Protocol):
    name: str

    def scores(self, task: str, stage: str, candidates: DataFrame) -> DataFrame: ...


class IncludeAll:
    """Every candidate is included, and none scored."""

    name = "include-all"

    def scores(self, task: str, stage: str, candidates: DataFrame) -> DataFrame:
        return candidates.select("id", F.lit(True).alias("include"), F.lit(None).cast("double").alias("score"))


class TableJudge:
    """Scores from a table (stage, id, score); a candidate it lacks has none."""

    name = "table"

    def __init__(self, table: DataFrame, threshold: float = 0.3):
        self.table, self.threshold = table, threshold

    def scores(self, task: str, stage: str, candidates: DataFrame) -> DataFrame:
        known = self.table.where(F.col("stage") == stage).select(F.col("id").alias("_i"), "score")
        joined = candidates.select("id").join(known, F.col("id") == F.col("_i"), "left")
        return joined.select("id", F.coalesce(F.col("score") >= self.threshold, F.lit(False)).alias("include"), "score")


def batches(candidates: DataFrame, order: str = "id", size: int = BATCH) -> DataFrame:
    """Adds the batch of each candidate of a stage."""
    return candidates.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("stage").orderBy(order)) - 1) / size).cast("int"))


def payload(task: str) -> object:
    """The question about a declaration as JSON, with its texts cut to size."""
    return F.to_json(F.struct(F.lit(task).alias("task"), "id", "name", "file", F.substring("source", 1, SOURCE_CHARS).alias("source"), F.substring("signature", 1, SITE_CHARS).alias("signature")))


class HttpJudge:
    """Asks a service about batches of candidates, AT_ONCE at a time; a batch that fails twice has no scores.

    Answers that were given before come from ``cache`` (digest, answer), and only the rest is asked.
    """

    name = "http"

    def __init__(self, url: str, cache: DataFrame | None = None, threshold: float = 0.3):
        self.url, self.cache, self.threshold = url, cache, threshold

    def scores(self, task: str, stage: str, candidates: DataFrame) -> DataFrame:
        url = self.url
        asked = candidates.withColumn("payload", payload(task)).withColumn("digest", F.sha2(F.concat_ws("|", F.lit(url), F.lit(stage), "payload"), 256))
        old = None
        if self.cache is not None:
            old = asked.join(self.cache, "digest").select("id", "answer")
            asked = asked.join(self.cache, "digest", "left_anti")

        def ask(parts):
            for pdf in parts:
                out: list = []
                for at in range(0, len(pdf), BATCH):
                    part = pdf.iloc[at : at + BATCH]
                    body = json.dumps({"stage": stage, "candidates": [json.loads(p) for p in part["payload"]]}).encode()
                    got: dict = {}
                    for _ in range(1 + RETRIES):
                        try:
                            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=TIMEOUT) as r:
                                got = json.load(r)
                            break
                        except OSError:
                            continue
                    out += [json.dumps(got[i]) if i in got else None for i in part["id"]]
                yield pdf[["id"]].assign(answer=out)

        new = asked.select("id", "payload").repartition(AT_ONCE).mapInPandas(ask, "id string, answer string")
        told = answers(new if old is None else new.unionByName(old))
        fine = F.when(F.col("score").between(0, 1), F.col("score"))
        return told.select("id", F.coalesce(fine >= self.threshold, F.lit(False)).alias("include"), fine.alias("score"))
