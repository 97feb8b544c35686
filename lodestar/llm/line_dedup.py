"""Deletes later repeated runs of lines, found by winnowing over line hashes; DataFrame operations only.

Winnowing here measures its window in words: from each line, forwards and backwards, the fewest lines that hold ``least`` words.
The least hash in each window is a fingerprint, so two runs of equal lines of ``least`` words or more share one for certain. Only
the selected minima are rows: a position, with the ends of the windows that selected it. Positions are joined by fingerprint; of
those that meet another one the match is extended, backwards and forwards line by line to the ends of their windows, and what
both extensions hold is compared (128 bits). A window that stood before (in an earlier document, or earlier in the same one
without overlap) is deleted with all its lines. Every repeated run of ``least`` words is the union of such windows, so runs go
whole; shorter ones stay.

No key's rows meet in one task, however many documents share a line or a window (``common.told``).

A line's words are its spaces and one; blank lines belong to no run and stay. Documents are in order of doc_id, null first, then
of their text's hash.

Cases: a null text stays null, an empty one stays; a row repeated with its doc_id and text is a later repeat of the first one
(in order of a hash of all columns) and loses all its lines if they hold ``least`` words; an empty table gives an empty result;
other columns pass through, and names that clash are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_order, told, unused

LEAST = 50
#: A document: whether it has an id, the id (0 for none), its text's hash.
DOC = ["named", "d", "k"]
BLANK = " \t\r\f\x0b"


def _text():
    return F.coalesce("text", F.lit(""))


def _doc() -> list:
    return [F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64(_text()).alias("k")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(DOC, lines): of each row, the place, two hashes and the words of its lines that aren't blank."""

    def line(x, pos):
        words = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
        return F.struct(pos.alias("pos"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit("#"), x).alias("g"), words.alias("w"), (F.length(F.trim(x, F.lit(BLANK))) > 0).alias("full"))

    return docs.select(*_doc(), F.filter(F.transform(F.split(_text(), "\n", -1), line), lambda x: x["full"]).alias("lines"))


def positions_of(lines: DataFrame, least: int) -> DataFrame:
    """(DOC, fp, at, ends): each selected minimum, where it stands, and first * 2^32 + last line of the windows that select it.

    Lines are numbered from 1 among those of their document that aren't blank.
    """
    each = lines.select(*DOC, F.explode("lines").alias("x")).select(*DOC, "x.pos", "x.h", "x.w").repartition(*DOC).dropDuplicates([*DOC, "pos"])
    doc = Window.partitionBy(*DOC)
    by_line = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.withColumns({"i": F.row_number().over(doc.orderBy("pos")), "to": F.sum("w").over(by_line)})
    summed = summed.withColumns({"before": F.col("to") - F.col("w"), "all": F.sum("w").over(doc)})
    ahead, behind = doc.orderBy("before").rangeBetween(0, least - 1), doc.orderBy("to").rangeBetween(1 - least, 0)
    ends = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)
    each = summed.withColumns({"f": F.min(F.struct("h", "i")).over(ahead), "f_end": F.max("i").over(ahead), "b": F.min(F.struct("h", "i")).over(behind), "b_begin": F.min("i").over(behind)})
    both = F.array(
        F.when(F.col("all") - F.col("before") >= least, F.struct("f.h", "f.i", ends("i", "f_end").alias("ends"))),
        F.when(F.col("to") >= least, F.struct("b.h", "b.i", ends("b_begin", "i").alias("ends"))),
    )
    rows = each.select(*DOC, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select(*DOC, F.col("x.h").alias("fp"), F.col("x.i").alias("at"), "x.ends")
    return rows.groupBy(*DOC, "fp", "at").agg(F.collect_set("ends").alias("ends"))


def extended(lines: DataFrame, positions: DataFrame) -> DataFrame:
    """(DOC, u, v, start, end, first_pos, last_pos): of joined positions, what extends to both ends of each of their windows."""
    found = positions.groupBy(*DOC).agg(F.collect_list(F.struct("at", "ends")).alias("found"))
    whole = lines.join(found.select(*DOC), DOC, "left_semi").groupBy(*DOC).agg(F.first("lines").alias("lines"))

    def hashes(begin, end, name):
        return F.transform(F.slice("lines", begin, end - begin + 1), lambda x: x[name])

    def window(at, ends):
        begin, end = F.shiftright(ends, 32).cast("int"), ends.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        backwards, forwards = F.xxhash64(hashes(begin, at, "h")), F.xxhash64(hashes(at, end, "h"))
        return F.struct(F.xxhash64(backwards, forwards).alias("u"), F.xxhash64(hashes(begin, end, "g")).alias("v"), begin.alias("start"), end.alias("end"), F.element_at("lines", begin)["pos"].alias("first_pos"), F.element_at("lines", end)["pos"].alias("last_pos"))

    windows = F.flatten(F.transform("found", lambda p: F.transform(p["ends"], lambda e: window(p["at"], e))))
    return whole.join(found, DOC).select(*DOC, F.explode(windows).alias("x")).select(*DOC, "x.*")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(DOC, gone): for each document with later repeats, the numbers of the lines that go, blank ones between them too."""
    lines = cut(lines_of(docs))
    joined = told(cut(positions_of(lines, least)), ["fp"], DOC)
    same = told(cut(extended(lines, joined)), ["u", "v"], DOC, F.struct(*DOC, "start", "end"))
    here = F.struct(*DOC) == F.struct("first.named", "first.d", "first.k")
    later = same.where(~here | (F.col("first.end") < F.col("start")))
    spans = later.groupBy(*DOC).agg(F.collect_set(F.struct("first_pos", "last_pos")).alias("spans"))
    return spans.select(*DOC, F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["first_pos"], x["last_pos"])))).alias("gone"))


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the later repeated runs deleted from ``text``, and two columns more: n_lines and n_removed_lines."""
    names = {n: unused([*docs.columns, *DOC, "gone"], n) for n in ("key", "id", "none", "copy", "parts", "left")}
    gone = repeats(docs, least)
    keyed = docs.withColumns(dict(zip((names["none"], names["id"], names["key"]), _doc(), strict=True)))
    a, b = keyed.alias("a"), gone.alias("b")
    same = [F.col(f"a.{names[x]}") == F.col(f"b.{y}") for x, y in zip(("none", "id", "key"), DOC, strict=True)]
    joined = a.join(b, same, "left").select("a.*", F.col("b.gone").alias(names["left"]))
    again = docs.groupBy("doc_id", F.xxhash64(_text()).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.split("text", "\n", -1)
    index = F.sequence(F.lit(0), F.size(parts) - 1)
    drop = F.coalesce(F.col(names["left"]), F.array().cast("array<int>"))
    if not again.isEmpty():
        full = F.filter(index, lambda i: F.length(F.trim(F.element_at(parts, i + 1), F.lit(BLANK))) > 0)
        words = F.aggregate(full, F.lit(0), lambda s, i: s + F.length(F.element_at(parts, i + 1)) - F.length(F.replace(F.element_at(parts, i + 1), F.lit(" "), F.lit(""))) + 1)
        joined = joined.withColumn(names["copy"], F.row_number().over(Window.partitionBy(names["none"], names["id"], names["key"]).orderBy(*row_order(docs))))
        drop = F.when((F.col(names["copy"]) > 1) & (words >= least), full).otherwise(drop)
    kept = F.array_except(index, drop)
    text = F.when(F.size(drop) > 0, F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n")).otherwise(F.col("text"))
    made = joined.withColumn(names["parts"], F.when(F.col("text").isNotNull(), F.size(drop)).otherwise(0))
    low = {"text", "n_lines", "n_removed_lines"}
    return made.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c == "text" or c.lower() not in low], F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.col(names["parts"]).cast("long").alias("n_removed_lines"))
