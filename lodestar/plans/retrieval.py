"""Retrieval: leads to context within a budget of tokens; from a task, or from an entry that is given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import is_test_file, query_terms, words_of
from ..operators import graph, inventory, select
from .discovery import Discovery, discover
from .discovery import Options as DiscoveryOptions
from .judge import Judge


@dataclass(frozen=True)
class Options:
    token_budget: int = 8000
    per_lead_nodes: int = 24
    neighborhood_factor: int = 2
    min_relevance: float = 0.3
    lexical_merge: int = 64
    reverse_fan_in: int = 12
    max_depth: int = 4
    max_nodes: int = 30
    body: float = 0.3
    omit: float = 0.3
    expand: bool = True
    merge_lexical: bool = True
    rerank: bool = True

    def __post_init__(self):
        # The legal ranges.
        for name, lo, hi in (("token_budget", 500, 100_000), ("per_lead_nodes", 1, 100), ("min_relevance", 0, 1), ("lexical_merge", 0, 128), ("reverse_fan_in", 1, 100), ("max_depth", 0, 6), ("max_nodes", 1, 100)):
            if not lo <= getattr(self, name) <= hi:
                raise ValueError(f"{name} must be from {lo} to {hi}")
        if not 0 <= self.omit <= self.body <= 1:
            raise ValueError("omit must not be over body")


OUTSIDE_FIRST = 2000
POOL = "lead_id node_id kind depth via site_text structural task_score part".split()


def _none(kind: str = "string"):
    return F.lit(None).cast(kind)


def neighborhood(leads: DataFrame, nodes: DataFrame, edges: DataFrame, terms: list[str], options: Options, reads: DataFrame | None = None) -> DataFrame:
    """POOL columns of all that the leads reach, best first in a lead by (structural, task_score, node_id).

    leads(id, place, typed); reads(node_id, symbol). What the lead uses, its callers within their quotas, what same-file callers
    use beside it, what callers pass into it, others that read what it reads, and callees of its callees. Targets inside their
    lead are left out, but for callers.
    """
    edges = edges if "symbol" in edges.columns else edges.withColumn("symbol", _none())

    def found(df, node, kind, part, depth=1, via=None, site=None):
        return df.select("lead_id", F.col(node).alias("node_id"), kind.alias("kind"), F.lit(depth).alias("depth"), (_none() if via is None else F.col(via)).alias("via"), (F.lit("") if site is None else F.col(site)).alias("site_text"), F.lit(part).alias("part"))

    forward = found(graph.forward(leads, edges.where("kind <> 'argument'")), "dst_id", F.col("kind"), 0, site="site_text")
    named = graph.reverse(leads, edges.where("kind <> 'argument'")).join(nodes.select(F.col("id").alias("src_id"), "name", "file"), "src_id")
    used = F.when((F.col("kind") == "test") | is_test_file(F.col("file")), "test").when(F.col("kind").isin(*graph.CALLS, "new", "jsx"), "caller").otherwise(F.col("kind"))
    ranked = graph.top_in(named.withColumns({"kind": used, "task_score": graph.task_score(terms, "name", "file", "site_text")}), ["lead_id"], [F.desc("task_score"), F.desc(scoring.edge_prior(F.col("kind"))), "src_id"], 1 << 30)
    quota = ranked.join(leads.select(F.col("id").alias("lead_id"), "place", "typed"), "lead_id").withColumn("task", F.lit(0)).withColumn("lead", F.col("lead_id"))
    callers = found(select.caller_quota(quota, "task", fan_in=options.reverse_fan_in), "src_id", F.col("kind"), 1, site="site_text")
    parts = [
        forward,
        callers,
        found(graph.siblings(leads, edges, nodes), "sibling_id", F.lit("sibling"), 2, depth=2),
        found(graph.argument_sources(leads, edges), "source_id", F.lit("argument"), 3),
        found(graph.nested_callees(leads, edges, nodes, terms), "callee_id", F.lit("call"), 5, depth=2, via="via"),
    ]
    if reads is not None:
        shared = graph.shared_readers(leads, reads, nodes).join(nodes.select(F.col("id").alias("reader_id"), "name", "file"), "reader_id").withColumnRenamed("rank", "seen")
        best = graph.top_in(shared.withColumn("score", graph.task_score(terms, "name", "file")), ["lead_id"], [F.desc("score"), "seen"], graph.SHARED)
        parts.append(found(best, "reader_id", F.lit("shared"), 4))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    at, of = graph.located(nodes, "lead"), graph.located(nodes, "node")
    outside = whole.join(at, "lead_id").join(of, "node_id").where(~graph.inside("node", "lead") | (F.col("part") == 1))
    scored = outside.join(nodes.select(F.col("id").alias("node_id"), "name", "file"), "node_id").withColumn("task_score", graph.task_score(terms, "name", "file", "site_text"))
    prior = F.when(F.col("via").isNotNull(), scoring.NESTED_PRIOR).otherwise(scoring.edge_prior(F.col("kind")))
    return scored.withColumn("structural", prior).select(*POOL)


def capped_neighborhood(near: DataFrame, own: DataFrame, costs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Rows of ``own`` and ``near`` that stay within each lead's bounds, and the ids of the nodes within the bound of all.

    A lead is charged first, then what it reaches, best first: a body if it fits, else a signature. Merged over the leads, the
    nodes are charged again in the same way against ``neighborhood_factor`` budgets.
    """
    charged = near.join(costs, "node_id").join(costs.select(F.col("node_id").alias("lead_id"), F.col("body_tokens").alias("lead_tokens")), "lead_id")
    order = charged.withColumns({"o1": -F.col("structural"), "o2": -F.col("task_score")})
    kept = select.capped_fold(order, "lead_id", ["o1", "o2", "node_id"], "node_id", "body_tokens", "signature_tokens", options.token_budget, most=options.per_lead_nodes, start_used="lead_tokens", start_rows=1)
    ids = kept.select("lead_id", F.explode("ids").alias("node_id"))
    rows = own.unionByName(near.join(ids, ["lead_id", "node_id"], "left_semi").select(own.columns))
    merged = rows.groupBy("node_id").agg((-F.max("structural")).alias("o1"), F.min("depth").alias("o2")).join(costs, "node_id").withColumn("all", F.lit(0))
    total = select.capped_fold(merged, "all", ["o1", "o2", "node_id"], "node_id", "body_tokens", "signature_tokens", options.neighborhood_factor * options.token_budget)
    return rows, total.select(F.explode("ids").alias("node_id"), F.col("used").alias("capped_tokens"))


def rank_pool(pool: DataFrame, answers: DataFrame, min_relevance: float) -> DataFrame:
    """``pool`` with answer and final, without what the answers say is unrelated; leads and what has no answer stay.

    answers(node_id, answer). The floor is on the answer itself, whatever the structure says.
    """
    told = pool.join(answers, "node_id", "left")
    lead = F.array_contains("sources", "semantic-lead")
    kept = told.where(lead | F.col("answer").isNull() | (F.col("answer") >= min_relevance))
    return kept.withColumn("final", scoring.blend(F.col("answer"), F.col("structural")))


def retrieve(task: str, docs: DataFrame, nodes: DataFrame, edges: DataFrame, judge: Judge, options: Options = Options(), finding: DiscoveryOptions = DiscoveryOptions(), found: Discovery | None = None, reads: DataFrame | None = None, outside_first: bool = False, stats: dict | None = None) -> tuple[Discovery, list[dict]]:
    """The discovery and the context, best first; nodes as in ``graph`` with type_level. Pools are a few dozen rows.

    ``outside_first``: the task's words are mostly in files that aren't code, so code gets a smaller budget. ``stats`` is filled
    with the sizes of the neighborhood and of the pool.
    """
    spark, terms = docs.sparkSession, query_terms(task)
    found = found or discover(task, docs, nodes, edges, judge, options=finding)
    if not found.leads:
        return found, []
    budget = min(options.token_budget, OUTSIDE_FIRST) if outside_first else options.token_budget
    size = lambda c: F.ceil(F.length(c) / 4).cast("long")
    costs = nodes.select(F.col("id").alias("node_id"), F.when(F.col("external"), size("signature")).otherwise(size("source")).alias("body_tokens"), size("signature").alias("signature_tokens"))
    leads = spark.createDataFrame([(x["id"], k, bool(x.get("type_level"))) for k, x in enumerate(found.leads)], "id string, place int, typed boolean")
    own = leads.select(F.col("id").alias("lead_id"), F.col("id").alias("node_id"), _none().alias("kind"), F.lit(0).alias("depth"), _none().alias("via"), _none().alias("site_text"), F.lit(1.0).alias("structural"), F.lit(0).alias("task_score"), F.lit(-1).alias("part"))
    reached = own
    if options.expand:
        near = neighborhood(leads, nodes, edges, terms, options, reads)
        rows, within = capped_neighborhood(near, own, costs, options)
        reached = rows.join(within.select("node_id"), "node_id", "left_semi").select(own.columns)
        if stats is not None:
            raw = own.select("node_id").unionByName(near.select("node_id")).distinct().join(costs, "node_id").agg(F.count("*").alias("n"), F.sum("body_tokens").alias("t")).first()
            capped = within.agg(F.count("*").alias("n"), F.max("capped_tokens").alias("t")).first()
            per_lead = near.count() - rows.count() + own.count()
            stats |= {"raw_symbols": raw["n"], "raw_tokens": raw["t"], "capped_symbols": capped["n"], "capped_tokens": capped["t"], "per_lead_pruned": per_lead, "total_pruned": rows.select("node_id").distinct().count() - capped["n"]}
    if options.merge_lexical and options.lexical_merge:
        from ..operators import lexical

        top = found.candidates.withColumn("r", F.row_number().over(Window.orderBy(*lexical.order()))).where(F.col("r") <= options.lexical_merge)  # at most max_candidates rows
        prior = scoring.lexical_prior(F.col("r") - 1, F.count("*").over(Window.partitionBy()))
        hints = top.select(_none().alias("lead_id"), F.col("id").cast("string").alias("node_id"), F.lit("lexical").alias("kind"), F.lit(0).alias("depth"), _none().alias("via"), _none().alias("site_text"), prior.alias("structural"), F.lit(0).alias("task_score"), F.lit(9).alias("part"))
        reached = reached.unionByName(hints.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(own.columns))
    seq = F.struct(F.coalesce("lead_id", F.lit("~")).alias("l"), "part", "node_id", "kind")
    pool = graph.merge_nodes(reached.withColumn("seq", seq).withColumn("source", F.when(F.col("kind") == "lexical", "lexical").when(F.col("depth") == 0, "semantic-lead").otherwise("compiler")).withColumn("semantic", _none("double")))
    pool = pool.join(costs, "node_id").join(nodes.withColumnRenamed("id", "node_id"), "node_id").withColumn("id", F.col("node_id"))
    total = pool.agg(F.sum("body_tokens")).first()[0] or 0
    if options.rerank and total > budget:
        support = graph.supporting_context(pool.select("id"), edges, nodes).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id"))).alias("s"))
        asked = pool.join(support.select(F.col("item_id").alias("id"), F.transform("s", lambda x: x["node_id"]).alias("support")), "id", "left")
        pool = rank_pool(pool, judge.scores(task, "rank", asked).select(F.col("id").alias("node_id"), F.col("score").alias("answer")), options.min_relevance)
    else:
        pool = pool.withColumn("final", F.col("structural"))
    levels = select.allocate(pool.withColumn("task", F.lit(0)), "task", budget).drop("task")
    return found, [r.asDict() for r in pool.join(levels, "id").orderBy("place").collect()]  # bounded by leads, per-lead nodes and lexical hints


def from_entry(entry_id: str, task: str, nodes: DataFrame, edges: DataFrame, judge: Judge, options: Options = Options(), wrappers: bool = True) -> list[dict]:
    """Context around a given declaration: a frontier for each depth, judged, then taken by priority within budget and nodes.

    One join for each depth; a frontier is bounded by ``max_nodes`` declarations' edges. Type edges need no judge.
    """
    spark = nodes.sparkSession
    tokens = lambda s: -(-len(s or "") // 4)
    start = nodes.where(F.col("id") == entry_id).first()
    if start is None:
        raise ValueError(f"no declaration {entry_id}")
    out = [start.asDict() | {"level": "body", "depth": 0, "path": [entry_id], "score": None}]
    used, taken, seen, words = tokens(start["source"]), 1, {entry_id}, words_of(task)
    frontier = {entry_id: ("all", [entry_id])}
    for depth in range(1, options.max_depth + 1):
        if not frontier or used >= options.token_budget:
            break
        ids = spark.createDataFrame([(i,) for i in frontier], "id string")
        hop = graph.forward(ids, edges).select("lead_id", F.col("dst_id").alias("id"), "kind", "seq", F.lit(0).alias("back"))
        if depth == 1:
            top = graph.reverse_top(ids, edges, nodes, words, options.reverse_fan_in)
            hop = hop.unionByName(top.select("lead_id", F.col("src_id").alias("id"), F.lit("caller").alias("kind"), F.col("rank").cast("long").alias("seq"), F.lit(1).alias("back")))
        rows = hop.join(nodes, "id").orderBy("back", "lead_id", "seq", "id").collect()
        found: dict[str, dict] = {}
        for r in rows:
            ways, path = frontier[r["lead_id"]]
            typed = r["kind"] == "type"
            if r["id"] in seen or r["id"] in found or (ways == "runtime" and typed) or (ways == "types" and not typed):
                continue
            found[r["id"]] = r.asDict() | {"path": [*path, r["id"]], "depth": depth}
        if not found:
            break
        seen |= set(found)
        asked = nodes.join(spark.createDataFrame([(i,) for i in found], "id string"), "id", "left_semi")
        told = {r["id"]: r for r in judge.scores(task, f"depth-{depth}", asked).collect()}
        degree = {r["src_id"]: r["n"] for r in edges.where("kind <> 'type'").join(asked.select(F.col("id").alias("src_id")), "src_id", "left_semi").groupBy("src_id").agg(F.count("*").alias("n")).collect()}
        queue = []
        for i, x in found.items():
            typed = x["kind"] == "type"
            score = 1.0 if typed else told[i]["score"] if i in told and told[i]["score"] is not None else float(i in told and told[i]["include"])
            wrapper = wrappers and not typed and len(x["source"] or "") < 220 and degree.get(i, 0) == 1
            value = max(score, 0.45 if wrapper else 0.0) * 0.8 ** (depth - 1)
            queue.append((-value, i, x, score, wrapper, typed))
        frontier = {}
        for _, i, x, score, wrapper, typed in sorted(queue, key=lambda q: q[:2]):
            level = "body" if (typed or score > options.body) and not x["external"] else "signature" if typed or score >= options.omit else "omitted"
            if level != "omitted" and taken >= options.max_nodes:
                level = "omitted"
            if level == "body" and used + tokens(x["source"]) > options.token_budget:
                level = "signature"
            if level == "signature" and used + tokens(x["signature"]) > options.token_budget:
                level = "omitted"
            if level != "omitted":
                used += tokens(x["source"] if level == "body" else x["signature"])
                taken += 1
            out.append(x | {"level": level, "score": score})
            if not x["external"] and used < options.token_budget:
                ways = "all" if level == "body" else "runtime" if wrapper else "types" if level == "signature" else None
                if ways:
                    frontier[i] = ways, x["path"]
    return out


def broad_answer(files: DataFrame, specificity: float, chars: int = 4000, least: float = 0.5) -> tuple[str, list[tuple[str, int]]] | None:
    """For a task that names no place: a map of the repository and areas for subtasks; None for a specific task."""
    if specificity >= least:
        return None
    counts = inventory.prefix_counts(files)
    return inventory.repository_map(counts, chars), inventory.areas(counts)


def query(task: str, docs: DataFrame, nodes: DataFrame, edges: DataFrame, judge: Judge, entry_id: str | None = None, options: Options = Options()) -> list[dict]:
    """Context from an entry if one is given, else from the task."""
    return from_entry(entry_id, task, nodes, edges, judge, options) if entry_id else retrieve(task, docs, nodes, edges, judge, options)[1]
