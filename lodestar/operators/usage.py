"""Usage statistics: aggregates by tool and project, rolling latency, running savings, recent calls, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLLING = 50


def by_group(log: DataFrame, group: str) -> DataFrame:
    """Calls, failures, outcomes, sums and mean seconds of each tool or project; log(tool, project, ok, ms, outcome, ...)."""
    return log.groupBy(group).agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("outcome") == "no-context").alias("no_context"), F.count_if(F.col("outcome") == "not-covered").alias("not_covered"), F.coalesce(F.sum("returned_tokens"), F.lit(0)).alias("returned_tokens"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), F.round(F.avg("ms") / 1000, 6).alias("mean_seconds"))


def rolling_latency(log: DataFrame, key: str, order: list[str], value: str, rows: int = ROLLING) -> DataFrame:
    """After each call of a tool, the median and the nearest-rank 95th percentile of its last ``rows`` calls."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)
    last = F.sort_array(F.collect_list(value).over(frame))
    return log.withColumn("median", F.expr(f"percentile({value}, 0.5)").over(frame)).withColumn("_last", last).withColumn("p95", F.element_at("_last", F.ceil(F.size("_last") * 95 / 100).cast("int"))).drop("_last")


def running_savings(log: DataFrame, key: str, order: list[str], candidate: str, returned: str) -> DataFrame:
    """Totals of a session after each call; a call never saves less than nothing."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    saved = F.greatest(F.col(candidate) - F.col(returned), F.lit(0))
    return log.withColumns({"total_candidate": F.sum(candidate).over(so_far), "total_returned": F.sum(returned).over(so_far), "total_saved": F.sum(saved).over(so_far)})


def recent(log: DataFrame, order: list, k: int = 8) -> DataFrame:
    return log.orderBy(*order).limit(k)


def session_counts(messages: DataFrame) -> DataFrame:
    """(session, turns, tool_uses, own_uses): messages(session, block_type, block_name)."""
    use = F.col("block_type") == "tool_use"
    return messages.groupBy("session").agg(F.count("*").alias("turns"), F.count_if(use).alias("tool_uses"), F.count_if(use & F.startswith("block_name", F.lit("mcp__"))).alias("own_uses"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(p * 100)}") for p in shares])


def savings_line(candidate: int, returned: int) -> str:
    saved = max(candidate - returned, 0)
    return f"{returned} of {candidate} candidate tokens returned ({saved} saved{f', {round(100 * saved / candidate)}%' if candidate else ''})"


def judge_batches(batches: DataFrame, by: list[str]) -> DataFrame:
    """Requests, retries, cache hits, tokens and cost; batches(..., candidates, attempts, cache_hit, input_tokens, cost)."""
    return batches.groupBy(*by).agg(F.count("*").alias("batches"), F.sum("candidates").alias("candidates"), F.sum("attempts").alias("requests"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.count_if("cache_hit").alias("cache_hits"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 9).alias("cost"))


def savings_summary(results: DataFrame) -> DataFrame:
    """Adds what a result saved of its candidates, as tokens and share, and how much of the budget it used."""
    saved = F.greatest(F.col("candidate_tokens") - F.col("returned_tokens"), F.lit(0))
    return results.withColumns({"saved_tokens": saved, "reduction": F.when(F.col("candidate_tokens") > 0, saved / F.col("candidate_tokens")), "budget_used": F.when(F.col("token_budget") > 0, F.col("returned_tokens") / F.col("token_budget")).otherwise(0.0), "basis": F.when(F.col("candidate_tokens").isNull(), "explicit-entry").otherwise("ranking-pool")})


def agent_sessions(steps: DataFrame) -> DataFrame:
    """(session, arm, tokens, searches, files, correct): steps(session, arm, kind, tokens, file, correct)."""
    return steps.groupBy("session", "arm").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("kind") == "search").alias("searches"), F.countDistinct("file").alias("files"), F.bool_or(F.coalesce("correct", F.lit(False))).alias("correct"))


def arm_medians(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("arm").agg(F.count("*").alias("sessions"), F.median("tokens").alias("tokens"), F.median("searches").alias("searches"), F.avg(F.col("correct").cast("int")).alias("correct"))
