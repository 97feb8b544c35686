"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

Each source has a weight and so a target in words; a document of it is wanted target / source size times, a whole number of
copies and a fraction. The fractions are rounded together: two of them meet, random mass moves from one to the other until one
is 0 or 1, and the other goes on. Documents of like size meet first, so what is taken stays near the target. A first round
works on groups of bounded size (source, hash group), each in order of size, and leaves at most one open fraction a group;
the open ones meet in groups of groups, level by level, until each source has one left, which is rounded alone.

Randomness comes from hashes of the documents, not from a generator, so reruns agree on any partitioning.

Cases: a null text has size 0; documents of size 0 are rounded as any, at no cost in words; a null source is one more source,
last in order; rows alike in doc_id and text share one decision; an empty table gives an empty result; other columns are not
read (``mix`` keeps them all, renaming none).
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, WORD, cut, doc_key, unused

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
GROUP = 1024
FAN_IN = 256
#: So many sources' rows are broadcast at most; more are joined, each source's documents in parts.
SOURCES = 100_000


def targets(stats: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, n, target, copies, fraction) from (source, source_size, n): words wanted of each source.

    A share of all by weight, at most ``most`` times the source's size, the excess dealt again: then each source has its weight
    times one level, or its bound. The level is found in rounds of one aggregate each, exactly, in whole numbers; no round but
    the last leaves the level as it was, and sources that reached their bound stay there.
    """
    order = F.col("source").asc_nulls_last()
    ranged = cut(stats.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before, seen = {}, 0
    for r in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        before[r["part"]], seen = seen, seen + r["n"]
    offsets = ranged.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("before") + F.col("at"), F.lit(len(weights))).cast("int") + 1)
    big = lambda x: F.col(x).cast("decimal(38,0)")
    named = ranged.join(F.broadcast(offsets), "part").withColumn("w", weight.cast("long")).withColumn("cap", most * F.col("source_size")).drop("part", "at", "before")
    all_ = share * (named.agg(F.sum("source_size")).first()[0] or 0)
    level: Fraction | None = None
    while True:
        open_ = F.lit(True) if level is None else big("w") * level.numerator < big("cap") * level.denominator
        r = named.agg(F.sum(F.when(open_, F.col("w"))).alias("w"), F.sum(F.when(~open_, F.col("cap"))).alias("cap")).first()
        if not r["w"]:
            break
        now = (all_ - (r["cap"] or 0)) / r["w"]
        if now == level:
            break
        level = now
    level = level or Fraction(0)
    words, size = big("w") * level.numerator, big("source_size") * level.denominator
    capped = words >= big("cap") * level.denominator
    target = F.when(capped, F.col("cap").cast("double")).otherwise(words.cast("double") / float(level.denominator))
    whole = named.select("source", "source_size", "n", target.alias("target"), words.alias("words"), F.nullif(size, F.lit(0)).alias("size"), capped.alias("capped"))
    whole = whole.withColumn("copies", F.when(F.col("capped"), F.lit(most).cast("long")).otherwise(F.expr("words div size"))).withColumn("copies", F.coalesce("copies", F.lit(0).cast("long")))
    rest = (F.col("words") - F.col("copies").cast("decimal(20,0)") * F.col("size")).cast("double") / F.col("size").cast("double")
    return cut(whole.select("source", "source_size", "n", "target", F.when(F.col("size").isNull(), 0).otherwise(F.col("copies")).cast("long").alias("copies"), F.when(F.col("capped") | F.col("size").isNull(), 0.0).otherwise(rest).alias("fraction")))


def coin(*parts) -> float:
    """A number in [0, 1) from what is said; the same wherever it is asked."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / (1 << 56)


def meet(a: float, b: float, u: float) -> tuple[float, float]:
    """Two fractions after one meeting: one of them is 0 or 1, the sum is kept, and so is each one's mean."""
    total = a + b
    if total <= 1:
        return (total, 0.0) if u * total < a else (0.0, total)
    return (1.0, total - 1) if u * (2 - total) < 1 - b else (total - 1, 1.0)


def round_group(rows: list[tuple], level: int) -> list[float]:
    """Fractions of (size, doc_id, key, fraction) after meeting in order of size, the largest first; one at most stays open."""
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][0], rows[k][2], rows[k][1] is not None, rows[k][1] or 0))
    out, held = [r[3] for r in rows], None
    for k in order:
        if not 1e-9 < out[k] < 1 - 1e-9:
            out[k] = float(round(out[k]))
            continue
        if held is None:
            held = k
            continue
        pair = held, k
        out[held], out[k] = meet(out[held], out[k], coin(level, rows[held][1], rows[held][2], rows[k][1], rows[k][2]))
        held = next((x for x in pair if 1e-9 < out[x] < 1 - 1e-9), None)
        for x in pair:
            if x != held:
                out[x] = float(round(out[x]))
    return out


UNIT = "source string, size long, doc_id long, k1 long, k2 long, copies long, fraction double, rows long, grp long"


def _round(units: DataFrame, level: int) -> DataFrame:
    def run(key, table):
        cols = {c: table.column(c).to_pylist() for c in ("size", "doc_id", "k1", "k2", "fraction")}
        rows = list(zip(cols["size"], cols["doc_id"], zip(cols["k1"], cols["k2"], strict=True), cols["fraction"], strict=True))
        return table.set_column(table.column_names.index("fraction"), "fraction", pa.array(round_group(rows, level), pa.float64()))

    return units.groupBy("source", "grp").applyInArrow(lambda key, t: run(key, t), UNIT)


def decide(docs: DataFrame, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """(source, size, doc_id, k1, k2, rows, copies, source_size, target): one row for each different document."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    k1, k2 = doc_key()
    units = docs.select("source", "doc_id", words.alias("size"), k1.alias("k1"), k2.alias("k2")).groupBy("source", "doc_id", "k1", "k2", "size").agg(F.count("*").alias("rows"))
    units = cut(units)
    plan = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n")))
    few = plan.count() <= SOURCES

    def with_plan(rows: DataFrame, columns: list[str]) -> DataFrame:
        """A row for each source is broadcast where these are few; else joined with each source's documents in SALTS parts."""
        right = plan.select(F.col("source").alias("s"), *columns)
        if few:
            return rows.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        left = rows.withColumn("part", F.pmod(F.xxhash64("k1", "k2", "doc_id"), F.lit(SALTS)))
        spread = right.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.join(spread, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("of"))).drop("s", "part", "of")

    named = with_plan(units, ["copies", "fraction", F.greatest(F.lit(1), F.ceil(F.col("n") / group)).alias("groups")])
    named = named.withColumn("grp", F.pmod(F.xxhash64("k1", "k2", "doc_id"), F.col("groups")))
    only = ["source", "size", "doc_id", "k1", "k2", "copies", "fraction", "rows", "grp"]
    done, level, most = [], 0, (plan.agg(F.max("n")).first()[0] or 0) // group + 1
    now = named.select(*only)
    while True:
        now = cut(_round(now, level))
        is_open = "fraction > 0 and fraction < 1"
        done.append(now.where(f"not ({is_open})"))
        left = now.where(is_open)
        if most <= 1:
            break
        level, most = level + 1, -(-most // fan_in)
        now = left.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long"))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("last"), "source", "doc_id", "k1", "k2"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    done.append(left.withColumn("fraction", F.when(u < F.col("fraction"), 1.0).otherwise(0.0)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select("source", "size", "doc_id", "k1", "k2", "rows", (F.col("copies") + F.col("fraction").cast("long")).alias("copies"))
    return with_plan(out, ["source_size", "target"])


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: 0, 1 or 2 times."""
    a, b, n = unused(docs.columns, "k1"), unused(docs.columns, "k2"), unused(docs.columns, "copies")
    k1, k2 = doc_key()
    chosen = decide(docs).where("copies > 0").select(F.col("doc_id").alias(f"{a}d"), F.col("source").alias(f"{a}s"), F.col("k1").alias(f"{a}k"), F.col("k2").alias(f"{b}k"), F.col("copies").alias(n))
    keyed = docs.withColumn(a, k1).withColumn(b, k2)
    same = (keyed[a] == chosen[f"{a}k"]) & (keyed[b] == chosen[f"{b}k"]) & keyed["doc_id"].eqNullSafe(chosen[f"{a}d"]) & keyed["source"].eqNullSafe(chosen[f"{a}s"])
    times = keyed.join(chosen, same).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return times.select(*[F.col(f"`{c}`") for c in docs.columns])
