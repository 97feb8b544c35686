"""Lexical ranking: BM25 by field, exact and path evidence, fused by reciprocal rank.

``docs`` has id, file, line and five arrays of tokens. Statistics are one row of sums, so ranking reads the documents twice and
shuffles scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import FIELD_WEIGHTS, bm25, idf, rrf
from ..functions.text import query_terms
from .ranking import global_rank

FIELDS = tuple(FIELD_WEIGHTS)


def averages(docs: DataFrame) -> DataFrame:
    """One row: documents, and the average length of each field."""
    return docs.agg(F.count("*").alias("n"), *[F.avg(F.size(f)).alias(f"avg_{f}") for f in FIELDS])


def document_terms(docs: DataFrame) -> DataFrame:
    """(term, df): documents that hold a term in any field."""
    every = F.array_distinct(F.concat(*FIELDS))
    return docs.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(id, field, term, tf)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("tokens")) for f in FIELDS]))
    postings = docs.select("id", each.alias("x")).select("id", "x.field", F.explode("x.tokens").alias("term"))
    return postings.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def reduced(docs: DataFrame, terms: list[str]) -> DataFrame:
    """All that ranking needs of the documents for these terms: lengths, counts and substring hits, a few numbers each.

    Tokens are made and read once; what is kept is small, and both the statistics and the scores come from it.
    """
    known = F.array(*map(F.lit, terms)).cast("array<string>")
    keep = [c for c in docs.columns if c not in FIELDS]
    hits = {f: F.filter(f, lambda x: F.array_contains(known, x)) for f in FIELDS}
    inside = {f: F.array_join(f, " ") for f in ("name", "signature", "literals")}
    wide = docs.select(*keep, *[F.size(f).alias(f"len_{f}") for f in FIELDS], *[h.alias(f"hit_{f}") for f, h in hits.items()], *[t.alias(f"all_{f}") for f, t in inside.items()], "path")
    tf = [_counts(f"hit_{f}", known).alias(f"tf_{f}") for f in FIELDS]
    any_ = F.transform(known, lambda t: F.contains("all_name", t) | F.contains("all_signature", t) | F.contains("all_literals", t))
    in_path = F.transform(known, lambda t: F.exists("path", lambda p: F.contains(p, t)))
    return wide.select(*keep, *[f"len_{f}" for f in FIELDS], *tf, any_.alias("inside"), in_path.alias("in_path"))


def _counts(hits: str, known: Column) -> Column:
    return F.transform(known, lambda t: F.size(F.filter(hits, lambda x: x == t)))


def scores(docs: DataFrame, task: str) -> DataFrame:
    """The rows of ``docs`` with bm25, exact, path_score and evidence for a task. What is kept in between is cached, and can be
    made again."""
    terms = query_terms(task)
    keep = [c for c in docs.columns if c not in FIELDS]
    small = reduced(docs, terms).persist()
    at = lambda f, k: F.col(f"tf_{f}")[k]
    held = lambda k: F.greatest(*[at(f, k) for f in FIELDS]) > 0
    stats = small.agg(F.count("*").alias("n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in FIELDS], F.array(*[F.count_if(held(F.lit(k))) for k in range(len(terms))]).cast("array<bigint>").alias("df"))
    places, known = F.sequence(F.lit(0), F.lit(len(terms) - 1)) if terms else F.array().cast("array<int>"), F.array(*map(F.lit, terms)).cast("array<string>")

    def over_terms(value) -> Column:
        """A fold over the terms: unrolled, the sums would be too long an expression to compile."""
        return F.aggregate(places, F.lit(0.0), lambda sum_, k: sum_ + value(k))

    def ranked(k: Column) -> Column:
        part = F.lit(0.0)
        for f, w in FIELD_WEIGHTS.items():
            part = part + bm25(at(f, k), F.col(f"len_{f}"), F.col(f"avg_{f}"), F.lit(float(w)))
        return F.when(F.col("df")[k] > 0, idf(F.col("n"), F.col("df")[k]) * part).otherwise(0.0)

    def worth(*signals: tuple[Column, float]) -> Column:
        total = F.lit(0.0)
        for value, points in signals:
            total = total + F.when(value, points).otherwise(0.0)
        return total

    exact = over_terms(lambda k: worth((at("name", k) > 0, 6.0), (at("identifiers", k) > 0, 2.0), (at("literals", k) > 0, 2.0), (F.col("inside")[k], 0.5)))
    path = over_terms(lambda k: worth((at("path", k) > 0, 3.0), (F.col("in_path")[k], 0.5)))
    found = F.transform(F.filter(places, held), lambda k: known[k])
    return small.join(F.broadcast(stats)).select(*keep, F.round(over_terms(ranked), 6).alias("bm25"), exact.alias("exact"), path.alias("path_score"), found.alias("evidence"))  # one row


def fuse(scored: DataFrame) -> DataFrame:
    """Scored rows with a positive signal, their ranks by signal and the sum of 1 / (60 + rank)."""
    ties = ["file", "line", "id"]
    out = scored.where((F.col("bm25") > 0) | (F.col("exact") > 0) | (F.col("path_score") > 0))
    n = out.count()
    for s in ("bm25", "exact", "path_score"):
        # the rows without a signal rank last, so the ranks of the others are what they are among themselves
        out = global_rank(out, s, ties, f"{s}_rank", n)
        out = out.withColumn(f"{s}_rank", F.when(F.col(s) > 0, F.col(f"{s}_rank")))
    total = F.lit(0.0)
    for s in ("bm25", "exact", "path_score"):
        total = total + F.when(F.col(f"{s}_rank").isNotNull(), rrf(F.col(f"{s}_rank"))).otherwise(0.0)
    return out.withColumn("rrf", F.round(total, 9))


def order() -> list:
    return [F.desc("rrf"), F.desc("bm25"), F.desc("exact"), F.desc("path_score"), F.asc("file"), F.asc("line"), F.asc("id")]


def rank(docs: DataFrame, task: str, k: int = 64) -> DataFrame:
    """The k best documents of a task, in order."""
    return fuse(scores(docs, task)).orderBy(*order()).limit(k)


def file_scores(fused: DataFrame) -> DataFrame:
    """(file, score): the best of each file over all ranked rows."""
    return fused.groupBy("file").agg(F.max("rrf").alias("score"))
