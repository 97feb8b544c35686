"""Discovery: from a task to a few leads. Directories are judged, then the files of the best, then the symbols of those.

Between the stages stand small decisions (is anything covered, which scopes go on), each one action on a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import is_test_file
from ..operators import inventory, lexical, ranking, select
from .judge import Judge


@dataclass(frozen=True)
class Options:
    """Limits of discovery; values out of range are refused."""

    max_candidates: int = 64
    max_leads: int = 4
    max_files: int = 256
    max_directories: int = 8
    max_relevant_files: int = 8
    min_lead_score: float = 0.3
    min_file_score: float = 0.3
    rescue_files: int = 4
    not_covered_margin: float = 0.2
    lexical: bool = True

    def __post_init__(self):
        # The legal ranges.
        for name, lo, hi in (("max_candidates", 1, 128), ("max_leads", 1, 8), ("max_files", 1, 1000), ("max_directories", 1, 32), ("max_relevant_files", 1, 32), ("min_lead_score", 0, 1), ("min_file_score", 0, 1), ("rescue_files", 0, 16)):
            if not lo <= getattr(self, name) <= hi:
                raise ValueError(f"{name} must be from {lo} to {hi}")


@dataclass
class Discovery:
    status: str
    leads: list[dict]
    directories: list[tuple[str, float]]
    files: list[tuple[str, float]]
    rescued: list[str]
    candidates: DataFrame
    warnings: list[str] = field(default_factory=list)


def _judged(judge: Judge, task: str, stage: str, rows: DataFrame) -> DataFrame:
    answers = judge.scores(task, stage, rows).select(F.col("id").alias("_id"), F.col("score").alias("_s"))
    return rows.join(answers, F.col("id") == F.col("_id"), "left").withColumn("score", scoring.valid_score(F.col("_s"))).withColumn("invalid", F.col("_s").isNull() | (F.col("score") != F.col("_s"))).drop("_id", "_s")


def discover(task: str, docs: DataFrame, symbols: DataFrame, edges: DataFrame, judge: Judge, unanalysed: DataFrame | None = None, options: Options = Options()) -> Discovery:
    """docs(id, file, line, five token fields), symbols(id, name, file, start_line, end_line, signature, type_level),
    edges(src_id, dst_id), unanalysed(file): sources outside the analysed ones."""
    spark, warnings = docs.sparkSession, []
    fused = lexical.fuse(lexical.scores(docs, task))
    candidates = fused.orderBy(*lexical.order()).limit(options.max_candidates)

    files = symbols.select("file").distinct()
    counts = inventory.prefix_counts(files)
    scopes = inventory.scopes(counts)
    scoped = files.withColumn("scope", inventory.scope_of(scopes))
    others = inventory.scopes(inventory.prefix_counts(unanalysed), split_root=True) if unanalysed is not None else {}
    if len(scopes) == 1 and not others:
        directories = [(d, 1.0) for d in scopes]
    else:
        rows = spark.createDataFrame([(f"dir::{d}", d, True) for d in scopes] + [(f"dir::unanalysed::{d}", d, False) for d in others], "id string, directory string, analysed boolean")
        told = _judged(judge, task, "directory", rows).orderBy(F.desc("score"), "directory").collect()
        directories = [(r["directory"], r["score"]) for r in told if r["analysed"]]
        outside = [(r["directory"], r["score"]) for r in told if not r["analysed"] and r["score"] >= options.min_file_score]
        best = directories[0][1] if directories else 0.0
        if outside and outside[0][1] - best >= options.not_covered_margin:
            return Discovery("not-covered", [], directories, [], [], candidates, [f"most relevant: {outside[0][0]}, which isn't analysed"])
        if outside:
            warnings.append(f"also relevant, not analysed: {', '.join(d for d, _ in outside)}")

    chosen = [d for d, s in directories if s >= options.min_file_score][: options.max_directories]
    place = spark.createDataFrame([(d, k) for k, d in enumerate(chosen)], "scope string, place int")
    strength = lexical.file_scores(fused) if options.lexical else fused.limit(0).select("file", F.lit(0.0).alias("score"))
    ranked = scoped.join(F.broadcast(place), "scope").join(strength.withColumnsRenamed({"file": "f", "score": "strength"}), F.col("file") == F.col("f"), "left")  # at most max_directories rows
    listed = ranking.interleave(ranked.withColumn("strength", F.coalesce("strength", F.lit(0.0))), "scope", "place", [F.desc("strength"), F.asc("file")], options.max_files).select("file")
    rescued = []
    if options.lexical and options.rescue_files:
        best_place = candidates.withColumn("r", F.row_number().over(Window.orderBy(*lexical.order()))).groupBy("file").agg(F.min("r").alias("r"))  # at most max_candidates rows
        top = best_place.orderBy("r").limit(options.rescue_files)
        rescued = [r["file"] for r in top.join(listed, "file", "left_anti").orderBy("r").collect()]
    pool = listed.unionByName(spark.createDataFrame([(f,) for f in rescued], "file string"))

    judged = _judged(judge, task, "file", pool.withColumn("id", F.concat(F.lit("file::"), "file")))
    good = judged.where(F.col("score") >= options.min_file_score).orderBy(F.desc("score"), "file").limit(options.max_relevant_files)
    chosen_files = [(r["file"], r["score"]) for r in good.collect()]
    mine = symbols.where(F.col("file").isin(*[f for f, _ in chosen_files]) if chosen_files else F.lit(False))
    leads = _judged(judge, task, "symbol", mine).join(candidates.select(F.col("id").alias("_l"), "rrf"), F.col("id") == F.col("_l"), "left").withColumn("rrf", F.coalesce("rrf", F.lit(0.0))).drop("_l")
    invalid = leads.where("invalid").count()
    if invalid:
        warnings.append(f"{invalid} answers were missing or invalid and count as 0")
    graph = edges.groupBy("src_id").agg(F.collect_set("dst_id").alias("near"))
    eligible = leads.where(F.col("score") >= options.min_lead_score).join(graph, F.col("id") == F.col("src_id"), "left")
    test = is_test_file(F.col("file"))
    ordered = eligible.withColumn("class", F.when(test, 2).when(F.col("type_level"), 1).otherwise(0)).withColumn("graph", F.concat(F.array("id"), F.coalesce("near", F.array().cast("array<string>"))))
    ordered = ordered.withColumn("task", F.lit(0)).withColumn("line", F.col("start_line"))  # symbols of at most max_relevant_files files
    by = [F.col("class"), -F.col("score"), -F.col("rrf"), F.col("file"), F.col("line"), F.col("id")]
    taken = select.diverse(ordered, "task", options.max_leads, by).select(F.col("id").alias("_l"), "place")
    chosen_leads = [r.asDict() for r in ordered.join(F.broadcast(taken), F.col("id") == F.col("_l")).orderBy("place").drop("_l", "place", "task").collect()]  # max_leads rows
    if not chosen_leads:
        warnings.append("no symbol scored above the threshold")
    return Discovery("complete" if chosen_leads and not warnings else "incomplete", chosen_leads, directories, chosen_files, rescued, candidates, warnings)


#: The ways of leaving parts out, for comparing them.
ABLATIONS = ("full", "lexical-only", "no-rerank", "no-lexical-merge", "semantic-only", "leads-only", "no-rescue", "structural-only")


def ablation(mode: str) -> tuple[Options, dict]:
    """Discovery options and retrieval switches of a mode."""
    if mode not in ABLATIONS:
        raise ValueError(f"unknown mode {mode}")
    switches = {"expand": mode != "leads-only", "merge_lexical": mode not in ("no-lexical-merge", "semantic-only"), "rerank": mode not in ("no-rerank", "structural-only", "lexical-only")}
    return Options(lexical=mode != "semantic-only", rescue_files=0 if mode in ("no-rescue", "semantic-only") else 4), switches
