"""The usage log as a stream: rolling latency by tool, running totals by project, appending to a folder.

The log has no late-data rule: rows are taken as they come, so a watermark would be an addition, not a likeness.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import ROLLING

LOG = "event_id long, time timestamp, tool string, project string, ms double, candidate_tokens long, returned_tokens long"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def rolling_latency(log: DataFrame, rows: int = ROLLING) -> DataFrame:
    """(tool, event_id, median, p95) after each call, over the tool's last ``rows`` calls; the state is those values."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values(["time", "event_id"]).itertuples():
            last = [*last, float(r.ms)][-rows:]
            order, n = sorted(last), len(last)
            out.append((key[0], r.event_id, (order[(n - 1) // 2] + order[n // 2]) / 2, order[math.ceil(0.95 * n) - 1]))
        state.update((last,))
        yield pd.DataFrame(out, columns=["tool", "event_id", "median", "p95"])

    return log.groupBy("tool").applyInPandasWithState(step, "tool string, event_id long, median double, p95 double", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def running_totals(log: DataFrame) -> DataFrame:
    """Totals by project so far, for the complete output mode."""
    saved = F.greatest(F.col("candidate_tokens") - F.col("returned_tokens"), F.lit(0))
    return log.groupBy("project").agg(F.count("*").alias("calls"), F.sum("candidate_tokens").alias("candidate"), F.sum("returned_tokens").alias("returned"), F.sum(saved).alias("saved"))


def append_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the stream to a folder of JSON lines, each row once."""
    return log.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def index_changes(files: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest version of each file in a Parquet table; files(file, version, text) is a stream of what was read."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("file").agg(F.max_by(F.struct("version", "text"), "version").alias("x")).select("file", "x.*")
        try:
            old = spark.read.parquet(f"{table_path}/{epoch - 1}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], newest.schema)
        old.join(newest.select("file"), "file", "left_anti").unionByName(newest).write.mode("overwrite").parquet(f"{table_path}/{epoch}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
