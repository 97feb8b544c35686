"""Personal data, and the terms that give it away; DataFrame operations only.

Four kinds of protected entity are found by pattern and check sum. Then, over the corpus, it is estimated how strongly a term
reveals an entity of its document. An entity is a value, and also each kind as a whole, so that values that occur once or twice
pool their evidence. Over N different texts (copies count once), of which n_e hold the entity, n_t the term and c both, the
term's information on the entity in a text is PMI = log2(p / (n_e / N)) with p = (c - 1 + SMOOTH n_e / N) / (n_t - 1 + SMOOTH): the
share of the other texts with the term that hold the entity, smoothed towards the entity's share of all. The entity's own
information is IC = -log2(n_e / N). A term of which PMI reaches ``disclosure`` times IC discloses the entity and is removed with it,
wherever it stands in a document with the entity. A text is no evidence on itself, so a term of one text alone never discloses.

The patterns are the plain ones with possessive repeats and with starts tied to the begin of a run or the end of the last match:
the matches are the same (of cards those of 14 to 19 digits, the only ones that can pass), and the time is linear in the text,
however long a run of digits or letters is. Places come from running sums in two levels, as appending one by one is quadratic.

Cases: null counts as an empty text; repeated rows are each reported alike; spans of different kinds may overlap; an empty table
gives an empty result; other columns are not read by ``find``; ``sanitize`` keeps them and replaces text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, cut, unused

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns of the four kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
DISCLOSURE, SMOOTH = 0.9, 1.0
BLOCK = 256
#: So many groups of copies are broadcast at most.
GROUPS = 100_000


def matches_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order, each with the length of what is between it and the one before."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))), lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), both).otherwise(F.array().cast("array<struct<m:string,g:int>>"))


def spans_of(matches: str) -> Column:
    """(start, end, value) of a column of matches, in code points.

    Lengths are summed within blocks of BLOCK matches, and the blocks' sums over the blocks.
    """
    one, found = "array<struct<start:int,end:int,value:string>>", F.col(matches)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda k: F.slice(found, k * BLOCK + 1, BLOCK))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(s["got"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("got"))

    def over(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["got"], F.array(F.struct(s["at"].alias("from"), x["got"].alias("got")))).alias("got"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(one).alias("got"))
    each = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
    whole = F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<from:int,got:{one}>>").alias("got")), over)["got"]
    moved = lambda b: F.transform(b["got"], lambda x: F.struct((b["from"] + x["start"]).alias("start"), (b["from"] + x["end"]).alias("end"), x["value"].alias("value")))
    return F.when(F.size(found) > 0, F.flatten(F.transform(whole, moved))).otherwise(F.array().cast(one))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x["value"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(x["value"])).between(14, 19) & F.when(F.length(_digits(x["value"])).between(14, 19), _luhn(_digits(x["value"]))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x["value"])).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str, to: str) -> DataFrame:
    """``docs`` with the spans of the four kinds in one array of (start, k, end, value), by start, then kind."""
    lit = {"email": F.col(text).contains("@"), "phone": F.col(text).contains("+")}
    empty = F.array().cast("array<struct<m:string,g:int>>")
    raw = {k: unused(docs.columns, f"raw_{k}") for k in PATTERNS}
    found = docs.withColumns({raw[k]: F.when(lit.get(k, F.lit(True)), matches_of(F.col(text), p)).otherwise(empty) for k, p in PATTERNS.items()})
    found = found.withColumns({raw[k]: spans_of(raw[k]) for k in PATTERNS})

    def good(n: int, k: str) -> Column:
        named = lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("k"), x["end"].alias("end"), x["value"].alias("value"))
        return F.transform(F.filter(F.col(raw[k]), lambda x: _valid(k, x)), named)

    return found.withColumn(to, F.array_sort(F.concat(*[good(n, k) for n, k in enumerate(PATTERNS)]))).drop(*raw.values())


def _masked(text: Column, spans: Column) -> Column:
    """The text with spaces in the place of its spans, as long as before."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        to = F.greatest(s["at"], x["end"])
        kept = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), to - F.greatest(s["at"], x["start"]))
        return F.struct(to.alias("at"), F.concat(s["out"], F.array(F.concat(kept, blank))).alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _term_counts(docs: DataFrame) -> tuple[int, DataFrame]:
    """How many different texts there are, and (term, n_t): in how many of them each term stands; ``docs`` has d, key and text.

    Of copies the one with the least id speaks; where copies have that id too, each for its part. The groups of copies are
    broadcast where they are few; else one text of each is brought together.
    """
    rows = docs.groupBy("key", "d").agg(F.count("*").alias("m"))
    groups = cut(rows.groupBy("key").agg(F.sum("m").alias("n"), F.min(F.struct("d", "m")).alias("lead")).select("key", "n", "lead"))
    total, copied = groups.count(), groups.where("n > 1").select(F.col("key").alias("key2"), "lead")
    if copied.count() <= GROUPS:
        kept = docs.join(F.broadcast(copied), F.col("key") == F.col("key2"), "left").where(F.col("key2").isNull() | F.col("lead.d").eqNullSafe(F.col("d")))
        once = kept.select("text", (1 / F.coalesce("lead.m", F.lit(1))).alias("part"))
    else:
        once = docs.groupBy("key").agg(F.first("text").alias("text")).select("text", F.lit(1.0).alias("part"))
    each = once.select(F.explode(_terms(F.col("text"))).alias("term"), "part")
    return total, each.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_t"))


def disclosing_terms(found: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame | None:
    """(key, places) for each different text with terms that disclose an entity in it; None if no term does.

    ``found`` has key, text and spans of every document with a span; ``docs`` has d, key and text of all.
    """
    entities = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.array(F.xxhash64(s["k"], F.lower(s["value"])), F.xxhash64(F.lit("kind"), s["k"])))))
    once = cut(found.select("key", _masked(F.col("text"), F.col("spans")).alias("text"), entities.alias("entities")).dropDuplicates(["key"]))
    each = once.select("key", F.explode("entities").alias("entity"), "text")
    counted = each.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") > 1)  # in one text alone it has no evidence
    pairs = each.select("key", "entity", F.explode(_terms(F.col("text"))).alias("term"))
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    total, terms = _term_counts(docs)
    share = F.col("n_e") / total
    others = F.greatest("n_t", "c") - 1
    pmi, ic = F.log2((F.col("c") - 1 + SMOOTH * share) / (others + SMOOTH) / share), -F.log2(share)
    told = both.join(counted, "entity").join(terms, "term").where((ic > 0) & (pmi >= disclosure * ic)).select("entity", "term")
    told = cut(told)
    if told.isEmpty():
        return None
    hits = pairs.join(told, ["entity", "term"]).groupBy("key").agg(F.collect_set("term").alias("terms"))
    words = once.join(hits, "key").select("key", "terms", matches_of(F.col("text"), TERM).alias("words"))
    return words.select("key", F.filter(spans_of("words"), lambda x: F.array_contains("terms", F.lower(x["value"]))).alias("places"))


def find(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, key, base, spans) for every row: arrays of (start, k, end), base of the four kinds, spans of all five."""
    plain = docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    based = base_spans(plain, "text", "spans").select("d", F.xxhash64("text").alias("key"), F.when(F.size("spans") > 0, F.col("text")).alias("text"), "spans")
    based = cut(based)  # the patterns run once; texts are kept only where something was found
    short = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    more = disclosing_terms(based.where(F.size("spans") > 0), plain.select("d", F.xxhash64("text").alias("key"), "text"), disclosure)
    rows = based.select("d", "key", short.alias("base"))
    if more is None:
        return rows.select(F.col("d").alias("doc_id"), "key", "base", F.col("base").alias("spans"))
    added = more.select(F.col("key").alias("key2"), F.transform("places", lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("term")).alias("k"), x["end"].alias("end"))).alias("more"))
    # copies share a key: each key's rows are joined in SALTS parts
    added = added.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("part", F.pmod(F.xxhash64("d"), F.lit(SALTS))).join(added, (F.col("key") == F.col("key2")) & (F.col("part") == F.col("of")), "left")
    return joined.select(F.col("d").alias("doc_id"), "key", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def spelled(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    found = find(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def sanitize(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span in ``text`` generalised to its kind in brackets; overlapping spans become the first one's kind."""
    key, spans = unused(docs.columns, "key"), unused(docs.columns, "spans")
    found = find(docs, **options).where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias(f"{key}_d"), F.col("key").alias(f"{key}_k"), F.col("spans").alias(spans))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found[f"{key}_d"]) & (keyed[key] == found[f"{key}_k"]), "left")
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(F.expr("''"), F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.element_at(kinds, x["k"] + 1))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(F.col(spans), zero, step)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
