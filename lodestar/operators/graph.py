"""Bounded expansion over a typed graph: one hop either way, siblings, callees of callees, shared readers, merging.

nodes(id, name, file, start_line, end_line, source, signature, external, outline)
edges(src_id, dst_id, kind, site_text, symbol)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import NESTED_PRIOR, edge_prior, term_hits
from ..functions.text import spaced
from .ranking import bucket_of, by_bucket, top_in

REVERSE_FAN_IN, SIBLINGS, NESTED, SHARED = 12, 4, 4, 4
TESTS_PER_LEAD, TESTS_TOTAL, TYPE_USERS, HUB_CALLERS = 3, 4, 3, 25
SEEN = 256
SHARED_HUB, SHARED_PER_SYMBOL, SHARED_PER_LEAD, SHARED_SYMBOLS = 40, 3, 6, 8
CALLS = ("call", "method", "import")


def task_score(terms: list[str], *columns: str):
    """How many terms the joined columns hold anywhere."""
    return term_hits(F.lower(spaced(F.concat_ws(" ", *columns))), terms)


def forward(leads: DataFrame, edges: DataFrame) -> DataFrame:
    """(lead_id, dst_id, kind, ...): a lead's edges; of several to one target the last one stands."""
    hop = leads.select(F.col("id").alias("lead_id")).join(edges, F.col("lead_id") == F.col("src_id"))
    last = F.row_number().over(Window.partitionBy("lead_id", "dst_id").orderBy(F.desc("seq"), F.desc("kind"), F.desc("site_text")))
    return hop.withColumn("r", last).where("r = 1").drop("r", "src_id")


def reverse(leads: DataFrame, edges: DataFrame) -> DataFrame:
    """(lead_id, src_id, kind, ...): edges into a lead; of several from one source the first stands."""
    hop = leads.select(F.col("id").alias("lead_id")).join(edges, F.col("lead_id") == F.col("dst_id"))
    first = F.row_number().over(Window.partitionBy("lead_id", "src_id").orderBy("seq", "kind", "site_text"))
    return hop.withColumn("r", first).where("r = 1").drop("r", "dst_id")


def reverse_top(leads: DataFrame, edges: DataFrame, nodes: DataFrame, terms: list[str], k: int = REVERSE_FAN_IN) -> DataFrame:
    """The k callers of each lead that the task is most about, then by the prior of their kind."""
    found = reverse(leads, edges).join(nodes.select(F.col("id").alias("src_id"), "name", "file"), "src_id")
    scored = found.withColumn("task_score", task_score(terms, "name", "file", "site_text")).withColumn("prior", edge_prior(F.col("kind")))
    return top_in(scored, ["lead_id"], [F.desc("task_score"), F.desc("prior"), "src_id"], k)


def inside(inner: str, outer: str):
    """Whether one declaration lies in another, by columns with these prefixes."""
    return (F.col(f"{inner}_file") == F.col(f"{outer}_file")) & (F.col(f"{inner}_start") >= F.col(f"{outer}_start")) & (F.col(f"{inner}_end") <= F.col(f"{outer}_end"))


def located(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{prefix}_id"), F.col("file").alias(f"{prefix}_file"), F.col("start_line").alias(f"{prefix}_start"), F.col("end_line").alias(f"{prefix}_end"))


def siblings(leads: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = SIBLINGS) -> DataFrame:
    """(lead_id, sibling_id): what callers in the lead's file call in that file beside the lead, first seen first."""
    at = nodes.select(F.col("id").alias("n"), F.col("file").alias("f"))
    up = reverse(leads, edges.where("kind in ('call', 'method', 'import', 'caller')")).select("lead_id", F.col("src_id").alias("caller"), F.col("seq").alias("s1"))
    home = up.join(at.withColumnsRenamed({"n": "lead_id", "f": "lead_file"}), "lead_id").join(at.withColumnsRenamed({"n": "caller", "f": "caller_file"}), "caller").where("lead_file = caller_file")
    down = edges.where(F.col("kind").isin(*CALLS)).select(F.col("src_id").alias("caller"), F.col("dst_id").alias("sibling_id"), F.col("seq").alias("s2"))
    beside = home.join(down, "caller").join(at.withColumnsRenamed({"n": "sibling_id", "f": "sibling_file"}), "sibling_id").where("sibling_file = lead_file and sibling_id <> lead_id")
    once = beside.groupBy("lead_id", "sibling_id").agg(F.min(F.struct("s1", "s2")).alias("seen"))
    return top_in(once, ["lead_id"], ["seen", "sibling_id"], k).select("lead_id", "sibling_id", "rank")


def nested_callees(leads: DataFrame, edges: DataFrame, nodes: DataFrame, terms: list[str], k: int = NESTED) -> DataFrame:
    """(lead_id, callee_id, via): callees of a lead's callees that it doesn't reach itself, most about the task first."""
    calls = edges.where(F.col("kind").isin(*CALLS))
    one = leads.select(F.col("id").alias("lead_id")).join(calls.select(F.col("src_id").alias("lead_id"), F.col("dst_id").alias("via"), F.col("seq").alias("s1")), "lead_id")
    two = one.join(calls.select(F.col("src_id").alias("via"), F.col("dst_id").alias("callee_id"), "site_text", F.col("seq").alias("s2")), "via").where("callee_id <> lead_id")
    direct = leads.select(F.col("id").alias("lead_id")).join(edges.select(F.col("src_id").alias("lead_id"), F.col("dst_id").alias("callee_id")), "lead_id")
    fresh = two.join(direct, ["lead_id", "callee_id"], "left_anti")
    once = fresh.groupBy("lead_id", "callee_id").agg(F.min(F.struct("s1", "s2", "via", "site_text")).alias("first"), F.min(F.struct("s1", "s2", "via")).alias("seen"))
    named = once.join(nodes.where("not external and not outline").select(F.col("id").alias("callee_id"), "name", "file"), "callee_id").withColumn("site_text", F.col("first.site_text"))
    scored = named.withColumn("task_score", task_score(terms, "name", "file", "site_text"))
    return top_in(scored, ["lead_id"], [F.desc("task_score"), "seen", "callee_id"], k).select("lead_id", "callee_id", F.col("first.via").alias("via"), "task_score", F.lit(NESTED_PRIOR).alias("prior"), "rank")


def shared_readers(leads: DataFrame, reads: DataFrame, nodes: DataFrame, hub: int = SHARED_HUB, per_symbol: int = SHARED_PER_SYMBOL, per_lead: int = SHARED_PER_LEAD) -> DataFrame:
    """(lead_id, symbol, reader_id): others that read what a lead reads; symbols with over ``hub`` readers say nothing.

    reads(node_id, symbol). Readers in other files come first. A reader is listed under the first symbol that brings it.
    """
    sizes = reads.groupBy("symbol").agg(F.countDistinct("node_id").alias("readers"))
    narrow = reads.join(sizes.where(F.col("readers") <= hub), "symbol")
    at = nodes.select(F.col("id").alias("n"), F.col("file").alias("f"))
    mine = leads.select(F.col("id").alias("lead_id")).join(narrow.select(F.col("node_id").alias("lead_id"), "symbol"), "lead_id").distinct()
    mine = top_in(mine, ["lead_id"], ["symbol"], SHARED_SYMBOLS).drop("rank")
    others = mine.join(narrow.select("symbol", F.col("node_id").alias("reader_id")), "symbol").where("reader_id <> lead_id").distinct()
    placed = others.join(at.withColumnsRenamed({"n": "lead_id", "f": "lead_file"}), "lead_id").join(at.withColumnsRenamed({"n": "reader_id", "f": "reader_file"}), "reader_id").withColumn("here", F.col("lead_file") == F.col("reader_file"))
    few = top_in(placed, ["lead_id", "symbol"], ["here", "reader_file", "reader_id"], per_symbol, "in_symbol")
    once = few.groupBy("lead_id", "reader_id").agg(F.min(F.struct("symbol", "in_symbol")).alias("first"))
    return top_in(once, ["lead_id"], ["first", "reader_id"], per_lead).select("lead_id", F.col("first.symbol").alias("symbol"), "reader_id", "rank")


def hop_distance(leads: DataFrame, targets: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """(target_id, distance): steps from the nearest lead over edges either way, null beyond ``most``. A bounded loop."""
    both = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).unionByName(edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"))).distinct()
    seen = leads.select(F.col("id").alias("node"), F.lit(0).alias("distance")).distinct()
    edge = seen
    for step in range(1, most + 1):
        edge = edge.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(step))
        seen = seen.unionByName(edge)
    return targets.select(F.col("id").alias("target_id")).join(seen.withColumnRenamed("node", "target_id"), "target_id", "left")


def lead_distance(leads: DataFrame, targets: DataFrame, edges: DataFrame, seen: int = SEEN) -> DataFrame:
    """(lead_id, distance): steps from each lead to its nearest target over edges either way, null beyond two.

    Of a lead's neighbours, forward ones first, each in order of its edges, those go on that are among the first ``seen`` nodes
    met, the lead being one. Only edges at nodes that are asked about are followed.
    """
    start, goal = leads.select(F.col("id").alias("lead_id")).distinct(), targets.select(F.col("id").alias("node")).distinct()

    def around(at: DataFrame) -> DataFrame:
        out = at.join(edges.select(F.col("src_id").alias("at"), F.col("dst_id").alias("node"), F.lit(0).alias("back"), "seq"), "at")
        return out.unionByName(at.join(edges.select(F.col("dst_id").alias("at"), F.col("src_id").alias("node"), F.lit(1).alias("back"), "seq"), "at"))

    near = around(start.withColumn("at", F.col("lead_id"))).where("node <> lead_id").groupBy("lead_id", "node").agg(F.min(F.struct("back", "seq")).alias("met"))
    on = top_in(near, ["lead_id"], ["met", "node"], seen - 2).select("lead_id", F.col("node").alias("at"))
    steps = start.select("lead_id", F.col("lead_id").alias("node"), F.lit(0).alias("distance"))
    steps = steps.unionByName(near.select("lead_id", "node", F.lit(1).alias("distance"))).unionByName(around(on).select("lead_id", "node", F.lit(2).alias("distance")))
    found = steps.join(goal, "node", "left_semi").groupBy("lead_id").agg(F.min("distance").alias("distance"))
    return start.join(found, "lead_id", "left")


def soft_recall(targets: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(target_id, reached): whether a target, or a neighbour of it either way, is a candidate."""
    both = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).unionByName(edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b")))
    near = targets.select(F.col("id").alias("target_id")).withColumn("node", F.col("target_id")).unionByName(targets.select(F.col("id").alias("target_id")).join(both, F.col("target_id") == F.col("a")).select("target_id", F.col("b").alias("node")))
    hit = near.join(candidates.select(F.col("id").alias("node")), "node", "left_semi").select("target_id").distinct().withColumn("hit", F.lit(True))
    return targets.select(F.col("id").alias("target_id")).join(hit, "target_id", "left").select("target_id", F.coalesce("hit", F.lit(False)).alias("reached"))


def merge_nodes(found: DataFrame) -> DataFrame:
    """One row for each node reached: least depth, best scores, kinds, leads and sources in order of first appearance.

    found(node_id, seq, depth, kind, lead_id, source, via, site_text, structural, semantic). The way of the least depth gives
    ``via``; a semantic score of 0 is none.
    """
    def seen(column: str):
        kept = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("seq", F.col(column).alias("v")))))
        return F.array_distinct(F.transform(kept, lambda x: x["v"]))

    return found.groupBy("node_id").agg(
        F.min("depth").alias("depth"),
        seen("kind").alias("kinds"),
        seen("lead_id").alias("lead_ids"),
        seen("source").alias("sources"),
        F.min_by("via", F.struct("depth", "seq")).alias("via"),
        F.min_by("site_text", F.when(F.col("site_text").isNotNull(), F.col("seq"))).alias("site_text"),
        F.max("structural").alias("structural"),
        F.nullif(F.max(F.coalesce("semantic", F.lit(0.0))), F.lit(0.0)).alias("semantic"),
    )


def locate(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entry_id, node_id): the smallest declaration that holds an entry's lines; entries(entry_id, file, line, end_line)."""
    n = nodes.select(F.col("id").alias("node_id"), F.col("file").alias("nf"), "start_line", F.col("end_line").alias("ne"))
    at = entries.withColumn("bucket", bucket_of(F.col("line")))
    held = at.join(by_bucket(n, "start_line", "ne", "nb"), (F.col("file") == F.col("nf")) & (F.col("bucket") == F.col("nb")) & (F.col("start_line") <= F.col("line")) & (F.col("ne") >= F.coalesce("end_line", "line")))
    return top_in(held.withColumn("span", F.col("ne") - F.col("start_line")), ["entry_id"], ["span", "node_id"], 1).select("entry_id", "node_id")


def import_closure(roots: DataFrame, imports: DataFrame) -> DataFrame:
    """(file): what the roots import, directly or not; imports(src, dst). Rounds end when one adds nothing."""
    seen = roots.select("file").distinct()
    edge = seen
    while True:
        edge = edge.join(imports, F.col("file") == F.col("src")).select(F.col("dst").alias("file")).distinct().join(seen, "file", "left_anti")
        edge = edge.checkpoint() if edge.sparkSession.sparkContext.getCheckpointDir() else edge.persist()
        if edge.isEmpty():
            return seen
        seen = seen.unionByName(edge)


def argument_sources(leads: DataFrame, edges: DataFrame, k: int = 6) -> DataFrame:
    """(lead_id, source_id, symbol, rank): functions whose results callers pass into a lead; the first ``k`` in order seen.

    edges of kind ``argument`` go from the producer to the lead, with the parameter as their symbol.
    """
    hop = leads.select(F.col("id").alias("lead_id")).join(edges.where("kind = 'argument'"), F.col("lead_id") == F.col("dst_id"))
    once = hop.groupBy("lead_id", "src_id").agg(F.min(F.struct("seq", "symbol")).alias("first"))
    return top_in(once, ["lead_id"], ["first", "src_id"], k).select("lead_id", F.col("src_id").alias("source_id"), F.col("first.symbol").alias("symbol"), "rank")


def untraced(unresolved: DataFrame, sources: DataFrame) -> DataFrame:
    """Unresolved references of a lead that no traced parameter explains; unresolved(lead_id, expression)."""
    known = sources.select(F.col("lead_id").alias("_l"), F.col("symbol").alias("_s"))
    return unresolved.join(known, (F.col("lead_id") == F.col("_l")) & (F.col("expression") == F.col("_s")), "left_anti")


def supporting_context(items: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 6) -> DataFrame:
    """(item_id, node_id, hops, rank): constants and types of the same file that an item uses, within two local steps."""
    at = nodes.select(F.col("id").alias("n"), F.col("file").alias("f"))
    local = edges.where("kind in ('value', 'type')").join(at.withColumnsRenamed({"n": "src_id", "f": "sf"}), "src_id").join(at.withColumnsRenamed({"n": "dst_id", "f": "df"}), "dst_id").where("sf = df").select("src_id", "dst_id", "seq")
    one = items.select(F.col("id").alias("item_id")).join(local, F.col("item_id") == F.col("src_id")).select("item_id", F.col("dst_id").alias("node_id"), F.lit(1).alias("hops"), "seq")
    two = one.select("item_id", F.col("node_id").alias("via")).join(local, F.col("via") == F.col("src_id")).select("item_id", F.col("dst_id").alias("node_id"), F.lit(2).alias("hops"), "seq")
    once = one.unionByName(two).where("node_id <> item_id").groupBy("item_id", "node_id").agg(F.min(F.struct("hops", "seq")).alias("first"))
    return top_in(once, ["item_id"], ["first", "node_id"], k).select("item_id", "node_id", F.col("first.hops").alias("hops"), "rank")


def resolve_aliases(names: DataFrame, aliases: DataFrame, most: int = 5) -> DataFrame:
    """(name, target): where a name leads over aliases(alias, target), after ``most`` steps at most."""
    out = names.select("name", F.col("name").alias("target"))
    for _ in range(most):
        step = aliases.select(F.col("alias").alias("_a"), F.col("target").alias("_t"))
        out = out.join(step, F.col("target") == F.col("_a"), "left").select("name", F.coalesce("_t", "target").alias("target"))
    return out
