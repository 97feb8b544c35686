"""Keyword evidence in text lines: which files hold which of a task's keywords, where, and which keywords nothing holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FILE_LINES, LINE_KEPT, is_test_file, kept_line, matches_term, tokens

MATCHES, BEST_LINES = 6, 3


def text_lines(files: DataFrame) -> DataFrame:
    """(file, line, text): trimmed lines worth keeping, the first ``FILE_LINES`` of each file, cut to ``LINE_KEPT``.

    The limit counts kept lines inside the row's own array, so no shuffle is needed.
    """
    lines = F.transform(F.split("text", r"\r?\n", -1), lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("text")))
    kept = F.slice(F.filter(lines, lambda x: kept_line(x["text"])), 1, FILE_LINES)
    return files.select("file", F.explode(kept).alias("x")).select("file", "x.line", F.substring("x.text", 1, LINE_KEPT).alias("text"))


def outside_lines(lines: DataFrame, declarations: DataFrame) -> DataFrame:
    """Lines that lie in no declaration of their file."""
    d = declarations.select(F.col("file").alias("df"), "start_line", "end_line")
    return lines.join(d, (F.col("file") == F.col("df")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti")


def terms_in(words: Column, terms: list[str]) -> Column:
    """Which terms a list of tokens holds, in the task's order."""
    known = F.array(*map(F.lit, terms)).cast("array<string>")
    return F.filter(known, lambda t: F.exists(words, lambda w: matches_term(w, t)))


def matching_lines(lines: DataFrame, terms: list[str]) -> DataFrame:
    """Lines with a keyword: a cheap substring test first, then tokens. ``found`` lists the terms."""
    low = F.lower("text")
    maybe = F.lit(False)
    for t in terms:
        maybe = maybe | F.contains(low, F.lit(t))
    return lines.where(maybe).withColumn("found", terms_in(tokens(F.col("text")), terms)).where(F.size("found") > 0)


def file_matches(lines: DataFrame, terms: list[str], kinds: DataFrame) -> DataFrame:
    """(file, kind, terms, n_lines, lines): each matching file with its terms and its best lines in order of line.

    ``kinds`` has (file, kind) of every file; a file may match by its path, unless it is ``top-level``; tests don't match.
    """
    named = kinds.where(~is_test_file(F.col("file"))).withColumn("in_path", terms_in(tokens(F.col("file")), terms))
    hits = matching_lines(lines, terms).withColumn("count", F.size("found"))
    best = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("count"), "line"))
    per_file = hits.withColumn("r", best).groupBy("file").agg(
        F.array_distinct(F.flatten(F.collect_set("found"))).alias("in_lines"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= BEST_LINES, F.struct("line", "text")))).alias("lines"),
    )
    joined = named.join(per_file, "file", "left").where(F.col("lines").isNotNull() | ((F.size("in_path") > 0) & (F.col("kind") != "top-level")))
    known = F.array(*map(F.lit, terms)).cast("array<string>")
    both = F.concat("in_path", F.coalesce("in_lines", F.array().cast("array<string>")))
    return joined.withColumn("terms", F.filter(known, lambda t: F.array_contains(both, t))).select("file", "kind", "terms", F.size(F.coalesce("lines", F.array())).alias("n_lines"), "lines")


def best_matches(matches: DataFrame, terms: list[str], k: int = MATCHES) -> DataFrame:
    """The files to report: most terms first, text files before module-level code, then most lines, then by name."""
    code = F.col("kind") == "top-level"
    enough = ~code | (F.size("terms") >= min(2, len(terms)))
    return matches.where(enough).orderBy(F.desc(F.size("terms")), code, F.desc("n_lines"), "file").limit(k)


def missing_terms(found: DataFrame, terms: list[str]) -> DataFrame:
    """(term) of the task that no row of ``found(term)`` matches."""
    asked = found.sparkSession.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, place int")
    return asked.join(found.select(F.col("term").alias("hit")).distinct(), F.col("term") == F.col("hit"), "left_anti").orderBy("place").select("term")


def outside_first(matches: DataFrame, terms: list[str], code_terms: int) -> bool:
    """Whether text files hold more of the task than any file of code."""
    best = matches.where("kind <> 'top-level'").agg(F.max(F.size("terms"))).first()[0] or 0
    return best >= min(2, len(terms)) and best > code_terms
