"""Operators on small frames, with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scoring, text
from lodestar.operators import evaluate, graph, inventory, keywords, lexical, ranking, render, select, usage
from lodestar.sources import files, logs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tokens(spark):
    df = spark.createDataFrame([("getHTTPResponse-for_userId 42 Café",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.tokens(F.col("t"))).collect()]
    assert got == [["get", "httpresponse", "for", "user", "id", "42", "café"], [], None]
    assert text.split_tokens("getHTTPResponse-for_userId") == ["get", "httpresponse", "for", "user", "id"]


def test_keyword_terms_and_missing(spark):
    terms = text.keywords_of("is there latency compensation for input delay")
    assert terms == ["latency", "compensation", "input", "delay"]
    found = spark.createDataFrame([("input",)], "term string")
    assert [r[0] for r in keywords.missing_terms(found, terms).collect()] == ["latency", "compensation", "delay"]


def test_prefix_match_needs_four_letters(spark):
    df = spark.createDataFrame([("sounds", "sound"), ("inputs", "inp"), ("inp", "inp")], "a string, b string")
    assert [r[0] for r in df.select(text.matches_term(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_levels(spark):
    df = spark.createDataFrame([(0.7,), (0.71,), (0.3,), (0.29,)], "s double")
    assert [r[0] for r in df.select(scoring.level(F.col("s"), 0.7, 0.3)).collect()] == ["signature", "body", "signature", "omitted"]


def test_blend_keeps_structure_without_answer(spark):
    df = spark.createDataFrame([(1.0, 0.5), (None, 0.5)], "a double, s double")
    assert [round(r[0], 6) for r in df.select(scoring.blend(F.col("a"), F.col("s"))).collect()] == [0.85, 0.5]


def test_valid_score(spark):
    df = spark.createDataFrame([(0.4,), (1.2,), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in df.select(scoring.valid_score(F.col("s"))).collect()] == [0.4, 0.0, 0.0, 0.0]


def _docs(spark):
    one = lambda i, name, sig, ids, lit=(): (i, f"src/{name[0]}.ts", i, list(name), ["src", name[0], "ts"], list(sig), list(ids), list(lit))
    return spark.createDataFrame([one(1, ["refresh", "token"], ["refresh", "token", "user"], ["refresh", "token", "jwt"]), one(2, ["decode"], ["decode", "jwt"], ["decode", "token"]), one(3, ["paint"], ["paint"], ["color"])], "id long, file string, line int, name array<string>, path array<string>, signature array<string>, identifiers array<string>, literals array<string>")


def test_lexical_rank(spark):
    got = lexical.rank(_docs(spark), "refresh the token").collect()
    assert [r["id"] for r in got] == [1, 2]
    assert got[0]["exact"] == 2 * (6 + 2 + 0.5) and got[0]["path_score"] == 3.5
    assert got[0]["rrf"] == pytest.approx(3 / 61) and got[1]["rrf"] == pytest.approx(2 / 62)


def test_global_rank_by_ranges(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("double").alias("s"))
    wide = ranking.global_rank(df, "s", ["id"], "r", range_rows=700)
    flat = ranking.global_rank(df, "s", ["id"], "r")
    assert rows(wide, "id", "r") == rows(flat, "id", "r")


def test_interleave(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 1, 3), ("a", 0, 4)], "g string, p int, v int")
    assert [r["v"] for r in ranking.interleave(df, "g", "p", ["v"], 3).collect()] == [1, 3, 2]


def test_folds(spark):
    df = spark.createDataFrame([("t", 1, 50, 5), ("t", 2, 60, 5), ("t", 3, 30, 5)], "g string, i int, c long, s long")
    assert rows(select.budget_fold(df, "g", ["i"], "i", "c", 100), "ids", "used") == [([1, 3], 80)]
    assert rows(select.capped_fold(df, "g", ["i"], "i", "c", "s", 100, most=3), "ids", "used", "n") == [([1, 2, 3], 85, 3)]
    assert rows(select.capped_fold(df, "g", ["i"], "i", "c", "s", 100, most=1), "ids", "n") == [([1], 1)]


def item(i, lo, hi, body, sig, final, **more):
    return {"id": i, "file": "f", "start_line": lo, "end_line": hi, "body_tokens": body, "signature_tokens": sig, "depth": 1, "structural": final, "final": final, "external": False, "outline": False} | more


ITEM = "id string, file string, start_line long, end_line long, body_tokens long, signature_tokens long, depth int, structural double, final double, external boolean, outline boolean, g int"


def levels(spark, items, budget):
    names = [c.split()[0] for c in ITEM.split(", ")]
    df = spark.createDataFrame([tuple((x | {"g": 0})[n] for n in names) for x in items], ITEM)
    return {r["id"]: r["level"] for r in select.allocate(df, "g", budget).collect()}


def test_allocate_covers_and_refunds(spark):
    got = levels(spark, [item("inner", 5, 8, 40, 5, 0.9), item("outer", 1, 20, 90, 9, 0.8), item("late", 30, 40, 200, 10, 0.7)], 100)
    assert got == {"inner": "covered", "outer": "body", "late": "signature"}
    assert levels(spark, [item("outer", 1, 20, 90, 9, 0.9), item("inner", 5, 8, 40, 5, 0.8), item("x", 50, 60, 30, 30, 0.1)], 100) == {"outer": "body", "inner": "covered", "x": "omitted"}


def test_allocate_second_pass_and_outline(spark):
    got = levels(spark, [item("big", 1, 9, 95, 10, 0.9, outline=True), item("cls", 10, 90, 900, 20, 0.8, outline=True), item("ext", 95, 99, 10, 5, 0.7, external=True)], 200)
    assert got == {"big": "body", "cls": "signature", "ext": "signature"}
    # what is wrapped gives its tokens back, so a signature from before can grow
    assert levels(spark, [item("a", 5, 8, 60, 5, 0.9), item("b", 30, 39, 50, 10, 0.8), item("c", 1, 20, 40, 4, 0.7)], 100) == {"a": "covered", "b": "body", "c": "body"}


def lead(n, score, graph, line=0, name=None):
    return {"id": n, "file": n, "line": line, "name": name or n, "signature": n, "score": score, "graph": graph}


def chosen(spark, leads, most=4):
    df = spark.createDataFrame([(0, x["id"], 0, x["file"], x["line"], x["name"], x["signature"], x["score"], x["graph"]) for x in leads], "g int, id string, class int, file string, line int, name string, signature string, score double, graph array<string>")
    return [r["id"] for r in select.diverse(df, "g", most).orderBy("place").collect()]


def test_diverse_leads(spark):
    a, b, c, d = lead("a", 0.9, ["a", "x", "y"]), lead("b", 0.88, ["b", "x", "y"]), lead("c", 0.7, ["c", "z"]), lead("d", 0.5, ["d"])
    assert chosen(spark, [a, b, c, d]) == ["a", "b", "c", "d"]  # b comes back before the weaker c
    assert chosen(spark, [a, b]) == ["a", "b"]
    near = lead("e", 0.85, ["e", "z", "x"])
    assert chosen(spark, [a, b, near, d], most=2) == ["a", "e"]
    same = lead("f", 0.89, ["q"], name="a") | {"signature": " a "}
    assert chosen(spark, [a, same, near]) == ["a", "e"]


def test_caller_quota(spark):
    e = lambda lead, kind, k, typed=False: (0, lead, int(lead[1]), k, kind, k, typed)
    df = spark.createDataFrame([*[e("l1", "test", k) for k in range(5)], e("l1", "caller", 9), *[e("l2", "test", k) for k in range(20, 23)], *[e("l3", "caller", k, True) for k in range(30, 36)], e("l3", "test", 36, True), *[e("l4", "caller", k) for k in range(40, 67)]], "task int, lead string, place int, rank int, kind string, id int, typed boolean")
    got = select.caller_quota(df, "task")
    assert [r["id"] for r in got.orderBy("place", "rank").collect()] == [0, 1, 2, 9, 20, 30, 31, 32]  # l4 is a hub, and l3 took what narrow leads share
    assert [r["id"] for r in select.caller_quota(df.where("lead = 'l4'"), "task", hub=30).collect()] == list(range(40, 52))


def _graph(spark):
    n = spark.createDataFrame([(i, i, f, s, s + 5, i, i, False, False) for i, f, s in (("a", "f", 1), ("b", "f", 10), ("c", "f", 20), ("d", "g", 1), ("x", "h", 1))], "id string, name string, file string, start_line long, end_line long, source string, signature string, external boolean, outline boolean")
    e = spark.createDataFrame([(1, "a", "b", "call", ""), (2, "a", "c", "call", ""), (3, "b", "d", "call", "order"), (4, "d", "x", "type", ""), (5, "a", "b", "type", "late")], "seq long, src_id string, dst_id string, kind string, site_text string")
    return n, e


def test_hops(spark):
    n, e = _graph(spark)
    a, b = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("b",)], "id string")
    assert rows(graph.forward(a, e), "dst_id", "kind") == [("b", "type"), ("c", "call")]
    assert rows(graph.reverse(b, e), "src_id", "kind") == [("a", "call")]
    assert rows(graph.siblings(b, e, n), "lead_id", "sibling_id") == [("b", "c")]
    assert rows(graph.nested_callees(a, e, n, ["order"]), "callee_id", "via", "task_score") == [("d", "b", 1)]
    ids = n.select("id")
    assert dict(rows(graph.hop_distance(a, ids, e), "target_id", "distance")[k] for k in range(5)) == {"a": 0, "b": 1, "c": 1, "d": 2, "x": None}
    assert rows(graph.soft_recall(spark.createDataFrame([("x",), ("c",)], "id string"), spark.createDataFrame([("d",)], "id string"), e), "target_id", "reached") == [("c", False), ("x", True)]


def test_lead_distance(spark):
    n, e = _graph(spark)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert dict(rows(graph.lead_distance(ids("a", "b", "x", "c"), ids("b", "d"), e), "lead_id", "distance")) == {"a": 1, "b": 0, "x": 1, "c": 2}
    assert dict(rows(graph.lead_distance(ids("c"), ids("x"), e), "lead_id", "distance")) == {"c": None}
    assert dict(rows(graph.lead_distance(ids("a"), ids("d"), e, seen=2), "lead_id", "distance")) == {"a": None}  # only the lead is expanded


def test_neighborhood_recall(spark):
    items = spark.createDataFrame([(1, "f", "a", 10), (1, "f", "b", 5)], "case_id int, file string, name string, tokens int")
    gold = spark.createDataFrame([(1, "f", "a"), (1, "g", "c"), (2, "f", "a")], "case_id int, file string, name string")
    got = {r["case_id"]: (r["recall"], r["hits"], r["tokens"]) for r in evaluate.neighborhood_recall(items, gold).collect()}
    assert got == {1: (0.5, 1, 15), 2: (0.0, 0, 0)}


def test_shared_readers_skip_hubs(spark):
    n = spark.createDataFrame([(f"n{k}", f"file{k % 3}") for k in range(60)] + [("lead", "file0")], "id string, file string")
    reads = [(f"n{k}", "HUB") for k in range(46)] + [("lead", "HUB"), ("lead", "DEBUG"), ("n50", "DEBUG"), ("n51", "DEBUG")]
    got = graph.shared_readers(spark.createDataFrame([("lead",)], "id string"), spark.createDataFrame(reads, "node_id string, symbol string"), n)
    assert rows(got, "reader_id") == [("n50",), ("n51",)]


def test_merge(spark):
    f = spark.createDataFrame([("n", 1, 2, "call", "l1", "compiler", "via1", None, 0.58, 0.0), ("n", 2, 1, "caller", "l2", "compiler", None, "s", 0.95, None)], "node_id string, seq int, depth int, kind string, lead_id string, source string, via string, site_text string, structural double, semantic double")
    assert rows(graph.merge_nodes(f), "depth", "kinds", "lead_ids", "sources", "via", "site_text", "structural", "semantic") == [(1, ["call", "caller"], ["l1", "l2"], ["compiler"], None, "s", 0.95, None)]


def test_import_closure(spark):
    got = graph.import_closure(spark.createDataFrame([("a",)], "file string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string"))
    assert rows(got, "file") == [("a",), ("b",), ("c",)]


def test_metrics(spark):
    cases = spark.createDataFrame([("full",), ("none",)], "case_id string")
    items = spark.createDataFrame([("full", "f", f"n{k}", 1, 1, "body", 1, 1.0, 10) for k in range(8)], "case_id string, file string, name string, start_line int, end_line int, level string, depth int, score double, tokens long")
    gold = spark.createDataFrame([(c, "f", f"n{k}", None, None) for k in range(5) for c in ("full", "none")], "case_id string, file string, name string, line int, required_level string")
    m = evaluate.scores(cases, items, gold)
    assert rows(m, "case_id", "precision", "recall", "required_level_recall") == [("full", 0.625, 1.0, 1.0), ("none", 0.0, 0.0, 0.0)]
    assert evaluate.macro_average(m, ["recall"]).first()["mean_recall"] == 0.5


def test_level_recall(spark):
    items = spark.createDataFrame([("c", "f", "a", 1, 9, "body", 1), ("c", "f", "b", 10, 19, "signature", 1)], "case_id string, file string, name string, start_line int, end_line int, level string, depth int")
    gold = spark.createDataFrame([("c", "ta", "f", "a", None, None), ("c", "tb", "f", None, 12, "body")], "case_id string, target string, file string, name string, line int, required_level string")
    r = evaluate.required_context(items, gold).first()
    assert (r["recall"], r["required_level_recall"], r["missing"]) == (1.0, 0.5, ["tb"])


def test_hits(spark):
    leads = spark.createDataFrame([("c", "f", 10, 20, 1), ("c", "g", 1, 5, 2)], "case_id string, file string, start_line int, end_line int, rank int")
    r = evaluate.hit_at(leads, spark.createDataFrame([("c", "g", 3, None)], "case_id string, file string, line int, end_line int")).first()
    assert (r["hit_at_1"], r["hit_at_3"], r["shortlist"]) == (False, True, True)


def test_coverage(spark):
    gold = spark.createDataFrame([("c", "t", "f", 1, 10), ("c", "u", "f", 20, 29)], "case_id string, target string, file string, start_line int, end_line int")
    got = spark.createDataFrame([("c", "f", 1, 9), ("c", "f", 5, 9), ("c", "f", 21, 29)], "case_id string, file string, start_line int, end_line int")
    assert rows(evaluate.delivered_coverage(got, gold), "target", "found", "covered") == [("t", 9, True), ("u", 9, False)]


def test_rolling_latency(spark):
    log = spark.createDataFrame([("t", k, float(v)) for k, v in enumerate((10, 20, 30, 40, 50, 60))], "tool string, k int, ms double")
    got = [(r["median"], r["p95"]) for r in usage.rolling_latency(log, "tool", ["k"], "ms", 5).orderBy("k").collect()]
    assert got[4:] == [(30.0, 50.0), (40.0, 60.0)]


def test_running_savings(spark):
    log = spark.createDataFrame([("s", k, 100, 60) for k in range(9)] + [("s", 9, 50, 80)], "p string, k int, c long, r long")
    last = usage.running_savings(log, "p", ["k"], "c", "r").orderBy(F.desc("k")).first()
    assert (last["total_candidate"], last["total_returned"], last["total_saved"]) == (950, 620, 360)


def test_scopes_and_areas(spark):
    names = [f"src/billing/{k}.ts" for k in range(40)] + [f"src/shipping/{k}.ts" for k in range(40)] + ["src/a.ts", "src/b.ts"]
    counts = inventory.prefix_counts(spark.createDataFrame([(n,) for n in names], "file string"))
    assert inventory.scopes(counts) == {"src": (2, True), "src/billing": (40, False), "src/shipping": (40, False)}
    assert sum(n for _, n in inventory.areas(counts)) == 82
    assert inventory.flat_runs(20, 8) == [3, 3, 3, 3, 2, 2, 2, 2] and len(inventory.flat_runs(20, 30)) == 20
    assert len(inventory.repository_map(counts, 60)) <= 60
    assert inventory.tree(["b/c", "a", "b/d"]) == "a\nb\n  c\n  d"


def test_unconfigured(spark):
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "file string")
    got = inventory.unconfigured(f("web/a.ts", "web/b.ts", "docs/c.ts"), spark.createDataFrame([("web",)], "dir string"), f("web/a.ts"))
    assert rows(got, "file") == [("web/b.ts",)]


def test_keyword_files(spark):
    src = spark.createDataFrame([("a/view.html", "<p>throw the ball</p>\nplain\nthrowing far"), ("b.html", "nothing"), ("test/c.html", "throw")], "file string, text string")
    got = keywords.file_matches(keywords.text_lines(src), ["throw", "ball"], src.select("file", F.lit("text").alias("kind")))
    assert rows(got, "file", "terms", "n_lines") == [("a/view.html", ["throw", "ball"], 2)]
    lines = keywords.text_lines(src)
    inside = spark.createDataFrame([("a/view.html", 1, 2)], "file string, start_line int, end_line int")
    assert rows(keywords.outside_lines(lines, inside).where("file = 'a/view.html'"), "line") == [(3,)]


SCRIPT = """// head
export function outer(a: number) {
  const inner = (x) => { return x + "}" };
  return inner(a);
}
class Box {
  size(): number { return 1; }
}
interface Shape { side: number }
"""


def test_declarations():
    got = [(n, k, lo, hi) for n, k, lo, hi, _, _ in files.declarations(SCRIPT)]
    assert got == [("outer", "function", 2, 5), ("inner", "value", 3, 3), ("Box", "class", 6, 8), ("size", "method", 7, 7), ("Shape", "interface", 9, 9)]
    masked = files.mask_component("<template>\n<b/></template>\n<script>\nlet a = 1\n</script>")
    assert masked.count("\n") == 4 and "let a = 1" in masked and "template" not in masked


def test_source_walk(spark, tmp_path):
    for name, body in (("src/a.ts", SCRIPT), ("src/b.d.ts", "x"), ("node_modules/c.ts", "x"), (".hid/d.ts", "x"), ("page.html", "<p>")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    listed = files.classify(files.listing(spark, str(tmp_path)))
    assert rows(listed, "file", "kind") == [("page.html", "markup"), ("src/a.ts", "code"), ("src/b.d.ts", "other")]
    read = files.contents(spark, listed.where("kind = 'code'"), str(tmp_path))
    assert rows(files.extract(read), "name", "start_line")[0] == ("Box", 6)
    assert files.changed(listed, read).count() == 2


def test_usage_log(spark, tmp_path):
    good = {"time": "2026-01-02T03:04:05Z", "tool": "t", "project": "p", "task": "x", "ok": True, "ms": 5.0, "outcome": "complete"}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps({k: v for k, v in good.items() if k != "tool"})]))
    assert logs.usage_log(spark, str(tmp_path)).count() == 1


def test_transcripts_and_answers(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text(json.dumps({"message": {"content": [{"type": "tool_use", "name": "mcp__x"}, {"type": "text"}]}}))
    t = logs.transcripts(spark, str(tmp_path))
    assert rows(usage.session_counts(t), "turns", "tool_uses", "own_uses") == [(2, 1, 1)]
    a = spark.createDataFrame([("0.4",), ('{"probability": 0.7}',), ('{"value": true}',), ('{"other": 1}',)], "answer string")
    assert [r["score"] for r in logs.answers(a).collect()] == [0.4, 0.7, 1.0, None]


def test_render():
    one = {"file": "f", "start_line": 1, "end_line": 3, "name": "a", "level": "body", "source": "x" * 50, "signature": "sig"}
    assert "x" * 50 in render.render([one], 200) and "(signature)" in render.render([one], 40) and "(location)" in render.render([one | {"signature": "s" * 99}], 40)


def test_failures(spark):
    from lodestar.functions.failures import failure_kind, request_status

    df = spark.createDataFrame([("EACCES", "x"), (None, "request failed (429): slow"), (None, "failed (503)"), (None, "fetch failed"), (None, "odd")], "c string, m string")
    assert [r[0] for r in df.select(failure_kind(F.col("c"), F.col("m"))).collect()] == ["not-permitted", "rate-limited", "service-trouble", "unreachable", "unexpected"]
    w = spark.createDataFrame([(["3 candidates were pruned by x"],), (["failed"],), ([],)], "w array<string>")
    assert [r[0] for r in w.select(request_status(F.col("w"))).collect()] == ["complete", "incomplete", "complete"]


def test_projects(spark, tmp_path):
    from lodestar.sources import projects

    assert projects.unsuitable_root("/") and projects.unsuitable_root(str(tmp_path)) is None
    assert projects.readable(str(tmp_path)) == ([str(tmp_path)], None)
    conf = spark.createDataFrame([("web/tsconfig.json", '{"extends": "../tsconfig.base", "include": ["src"], /* c */ }'), ("tsconfig.base.json", '{"exclude": ["**/gen"], // x\n}')], "file string, text string")
    src = spark.createDataFrame([("web/src/a.ts",), ("web/other/b.ts",), ("api/c.ts",)], "file string")
    got = projects.project_files(conf, src)
    assert rows(got.where("dir = 'web'"), "file") == [("web/src/a.ts",)]
    assert rows(inventory.nearest_config(src, got), "file", "config")[2] == ("web/src/a.ts", "web/tsconfig.json")


def test_small_graph_rules(spark):
    lead = spark.createDataFrame([("l",)], "id string")
    e = spark.createDataFrame([(1, "p", "l", "argument", "mask"), (2, "q", "l", "argument", "grid")], "seq long, src_id string, dst_id string, kind string, symbol string")
    got = graph.argument_sources(lead, e)
    assert rows(got, "source_id", "symbol") == [("p", "mask"), ("q", "grid")]
    open_ = spark.createDataFrame([("l", "mask"), ("l", "other")], "lead_id string, expression string")
    assert rows(graph.untraced(open_, got), "expression") == [("other",)]
    names = spark.createDataFrame([("a",), ("z",)], "name string")
    assert rows(graph.resolve_aliases(names, spark.createDataFrame([("a", "b"), ("b", "c")], "alias string, target string")), "name", "target") == [("a", "c"), ("z", "z")]
