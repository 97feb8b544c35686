"""Retrieval against labels: precision, recall by level, hits at k, footprints, sweeps and their spreads.

items(case_id, file, name, start_line, end_line, level, depth, score, tokens), gold(case_id, file, name, line, required_level).
Having nothing to find is a ratio of 1, except precision, which is 1 only if there was nothing to find either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import level, ratio
from .ranking import bucket_of, by_bucket


def level_satisfies(got: Column, wanted: Column) -> Column:
    return (got == "body") | ((got == "signature") & (wanted == "signature"))


def strict_match(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Items with the gold target of the same file and name, and line if it has one."""
    g = gold.select(F.col("case_id").alias("gc"), F.col("file").alias("gf"), F.col("name").alias("gn"), F.col("line").alias("gl"), F.coalesce("required_level", F.lit("signature")).alias("wanted"))
    same = (F.col("case_id") == F.col("gc")) & (F.col("file") == F.col("gf")) & (F.col("name") == F.col("gn")) & (F.col("gl").isNull() | (F.col("gl") == F.col("start_line")))
    return items.join(g, same, "left")


def scores(cases: DataFrame, items: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each case: what was retrieved (depth over 0), what of it counts, and the ratios."""
    got = strict_match(items.where("depth > 0"), gold)
    per = got.groupBy("case_id").agg(
        F.count_if(F.col("level") != "omitted").alias("retrieved"),
        F.count_if((F.col("level") != "omitted") & F.col("gf").isNotNull()).alias("relevant"),
        F.count_if((F.col("level") == "body") & F.col("gf").isNotNull()).alias("bodies"),
        F.count_if(F.col("gf").isNotNull() & level_satisfies(F.col("level"), F.col("wanted"))).alias("at_level"),
        F.count_if((F.col("level") == "omitted") & F.col("gf").isNotNull()).alias("omitted_relevant"),
        F.sum(F.when(F.col("level") != "omitted", F.col("tokens")).otherwise(0)).alias("tokens"),
    )
    wanted = gold.groupBy("case_id").agg(F.count("*").alias("gold"))
    all_ = cases.select("case_id").join(wanted, "case_id", "left").join(per, "case_id", "left").na.fill(0)
    precision = F.when(F.col("retrieved") == 0, (F.col("gold") == 0).cast("double")).otherwise(F.col("relevant") / F.col("retrieved"))
    return all_.select("case_id", "gold", "retrieved", "relevant", "omitted_relevant", precision.alias("precision"), ratio(F.col("relevant"), F.col("gold")).alias("recall"), ratio(F.col("bodies"), F.col("gold")).alias("body_recall"), ratio(F.col("at_level"), F.col("gold")).alias("required_level_recall"), F.when(F.col("tokens") == 0, 0.0).otherwise(F.col("relevant") * 1000 / F.col("tokens")).alias("per_1k"))


def located_match(items: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, target, hit, level_hit): a target is hit by an item around its line or, without a line, of its name."""
    g = gold.select("case_id", "target", F.col("file").alias("gf"), F.col("name").alias("gn"), F.col("line").alias("gl"), F.coalesce("required_level", F.lit("body")).alias("wanted"))
    i = items.select(F.col("case_id").alias("ic"), "file", "name", "start_line", "end_line", "level")
    place = (F.col("case_id") == F.col("ic")) & (F.col("file") == F.col("gf"))
    lined = g.where("gl is not null").withColumn("gb", bucket_of(F.col("gl"))).join(by_bucket(i, "start_line", "end_line", "ib"), place & (F.col("gb") == F.col("ib")) & (F.col("start_line") <= F.col("gl")) & (F.col("end_line") >= F.col("gl")))
    named = g.where("gl is null").join(i, place & (F.col("name") == F.col("gn")))
    found = [x.select("case_id", "target", "wanted", F.lit(True).alias("hit"), "level") for x in (lined, named)]
    every = g.select("case_id", "target", "wanted", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("level")).unionByName(found[0]).unionByName(found[1])
    return every.groupBy("case_id", "target").agg(F.bool_or("hit").alias("hit"), F.coalesce(F.bool_or(level_satisfies(F.col("level"), F.col("wanted"))), F.lit(False)).alias("level_hit"))


def required_context(items: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, targets, recall, required_level_recall, missing)."""
    m = located_match(items, gold)
    return m.groupBy("case_id").agg(F.count("*").alias("targets"), ratio(F.count_if("hit"), F.count("*")).alias("recall"), ratio(F.count_if("level_hit"), F.count("*")).alias("required_level_recall"), F.array_sort(F.collect_list(F.when(~F.col("level_hit"), F.col("target")))).alias("missing"))


def footprint(items: DataFrame) -> DataFrame:
    """(case_id, symbols, files, bodies, signatures, tokens)."""
    return items.groupBy("case_id").agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"), F.count_if(F.col("level") == "body").alias("bodies"), F.count_if(F.col("level") == "signature").alias("signatures"), F.sum("tokens").alias("tokens"))


def neighborhood_recall(items: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, recall, targets, hits, symbols, tokens): how many of a case's targets its neighborhood holds.

    items(case_id, file, name, tokens), gold(case_id, file, name); a case without targets has recall 1.
    """
    size = items.groupBy("case_id").agg(F.count("*").alias("symbols"), F.sum("tokens").alias("tokens"))
    asked = gold.select("case_id", "file", "name").distinct()
    held = asked.join(items.select("case_id", "file", "name").distinct().withColumn("hit", F.lit(1)), ["case_id", "file", "name"], "left")
    hits = held.groupBy("case_id").agg(F.count("*").alias("targets"), F.count("hit").alias("hits"))
    both = size.join(hits, "case_id", "full").na.fill(0, ["symbols", "tokens", "targets", "hits"])
    return both.select("case_id", ratio(F.col("hits"), F.col("targets")).alias("recall"), "targets", "hits", "symbols", "tokens")


def hit_at(leads: DataFrame, entries: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(case_id, hit_at_k..., shortlist): whether a lead by rank holds an acceptable entry's lines."""
    e = entries.select(F.col("case_id").alias("ec"), F.col("file").alias("ef"), F.col("line").alias("el"), F.coalesce("end_line", "line").alias("ee"))
    held = (F.col("case_id") == F.col("ec")) & (F.col("file") == F.col("ef")) & (F.col("start_line") <= F.col("el")) & (F.col("end_line") >= F.col("ee"))
    found = leads.join(e, held, "left_semi").select(F.col("case_id").alias("hc"), F.col("rank").alias("hr"))
    return leads.select("case_id").distinct().join(found.groupBy("hc").agg(F.min("hr").alias("best")), F.col("case_id") == F.col("hc"), "left").select("case_id", *[F.coalesce(F.col("best") <= k, F.lit(False)).alias(f"hit_at_{k}") for k in ks], F.col("best").isNotNull().alias("shortlist"))


def lead_recovery(items: DataFrame, entries: DataFrame) -> DataFrame:
    """(case_id, depth, within_1, within_2): the least depth at which an acceptable entry was reached."""
    e = entries.select(F.col("case_id").alias("ec"), F.col("file").alias("ef"), F.col("line").alias("el"), F.coalesce("end_line", "line").alias("ee"))
    held = (F.col("case_id") == F.col("ec")) & (F.col("file") == F.col("ef")) & (F.col("start_line") <= F.col("el")) & (F.col("end_line") >= F.col("ee"))
    best = items.join(e, held, "left_semi").groupBy("case_id").agg(F.min("depth").alias("depth"))
    return items.select("case_id").distinct().join(best, "case_id", "left").select("case_id", "depth", F.coalesce(F.col("depth") <= 1, F.lit(False)).alias("within_1"), F.coalesce(F.col("depth") <= 2, F.lit(False)).alias("within_2"))


def macro_average(per_case: DataFrame, columns: list[str]) -> DataFrame:
    """Means over cases, each case alike; zero without cases."""
    return per_case.agg(F.count("*").alias("cases"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns])


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation, 0 for a single run."""
    return df.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def stability(df: DataFrame, by: list[str], value: str, include: float = 0.3) -> DataFrame:
    """How much a score moves between runs: population deviation, range, and how often it is over a threshold."""
    return df.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("range"), F.avg((F.col(value) > include).cast("int")).alias("include_rate"))


def separation(df: DataFrame, score: str, is_gold: Column) -> DataFrame:
    """The least gold score less the highest other one."""
    return df.agg(F.min(F.when(is_gold, F.col(score))).alias("min_gold"), F.max(F.when(~is_gold, F.col(score))).alias("max_noise"), (F.min(F.when(is_gold, F.col(score))) - F.max(F.when(~is_gold, F.col(score)))).alias("margin"))


def threshold_sweep(scored: DataFrame, thresholds: list[float], omit: float = 0.3) -> DataFrame:
    """(threshold, items, bodies, signatures, required, at_level, recall): levels by score under each body threshold.

    scored(score, wanted): ``wanted`` is body, signature or null for what nobody needs. Each row meets each of a few thresholds.
    """
    each = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    got = level(F.col("score"), omit=omit)
    leveled = each.withColumn("level", F.when(F.col("score") > F.col("threshold"), "body").otherwise(F.when(got == "body", "signature").otherwise(got)))
    hit = F.col("wanted").isNotNull() & level_satisfies(F.col("level"), F.col("wanted"))
    return leveled.groupBy("threshold").agg(F.count("*").alias("items"), F.count_if(F.col("level") == "body").alias("bodies"), F.count_if(F.col("level") == "signature").alias("signatures"), F.count("wanted").alias("required"), F.count_if(hit).alias("at_level"), ratio(F.count_if(hit), F.count("wanted")).alias("recall"))


def sweep(runs: DataFrame, budget: str, case: str, value: str) -> DataFrame:
    """Mean and deviation by case and budget, and by budget over all cases, in one pass over grouping sets."""
    return runs.groupingSets([[F.col(case), F.col(budget)], [F.col(budget)]], F.col(case), F.col(budget)).agg(F.grouping(case).cast("int").alias("overall"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def win_tie_loss(pairs: DataFrame, by: str, ours: str, theirs: str) -> DataFrame:
    return pairs.groupBy(by).agg(F.count_if(F.col(ours) > F.col(theirs)).alias("win"), F.count_if(F.col(ours) == F.col(theirs)).alias("tie"), F.count_if(F.col(ours) < F.col(theirs)).alias("loss"))


def delivered_coverage(delivered: DataFrame, gold: DataFrame, share: float = 0.9) -> DataFrame:
    """(case_id, target, lines, found, covered): a target counts if its first line and ``share`` of its lines were delivered.

    delivered(case_id, file, start_line, end_line) are ranges; lines are counted once however many ranges hold them.
    """
    lines = gold.select("case_id", "target", "file", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    d = delivered.select(F.col("case_id").alias("dc"), F.col("file").alias("df"), F.col("start_line").alias("ds"), F.col("end_line").alias("de"))
    got = lines.join(d, (F.col("case_id") == F.col("dc")) & (F.col("file") == F.col("df")) & F.col("line").between(F.col("ds"), F.col("de")), "left_semi").groupBy("case_id", "target").agg(F.count("*").alias("found"), F.min("line").alias("first"))
    every = gold.select("case_id", "target", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    joined = every.join(got, ["case_id", "target"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.select("case_id", "target", "lines", "found", (F.coalesce(F.col("first") == F.col("start_line"), F.lit(False)) & (F.col("found") >= share * F.col("lines"))).alias("covered"))


def leaks(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """(case_id, name, leaked): whether a target's last name part is spelled in the task, case and marks aside.

    tasks(case_id, task), targets(case_id, name).
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    last = plain(F.element_at(F.split("name", r"[.#:/]"), -1))
    joined = targets.join(tasks, "case_id")
    return joined.select("case_id", "name", ((F.length(last) > 2) & F.contains(plain(F.col("task")), last)).alias("leaked"))
