"""Whole queries: discovery, retrieval, entries, streams, and every registered query against SQL."""

import json
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestar.plans import bindings, discovery, judge, registry, retrieval
from lodestar.streaming import usage as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    fix = lambda v: round(float(v), 9) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int)) else str(v)
    return sorted((tuple(fix(v.item() if hasattr(v, "item") else v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(registry.ORACLE[name]).df())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def _repo(spark):
    node = lambda i, name, file, lo, hi, src="x" * 400, sig="sig": (i, name, file, lo, hi, src, sig, False, False, False)
    nodes = spark.createDataFrame([node("1", "refreshToken", "src/auth.ts", 1, 9), node("2", "verifyToken", "src/jwt.ts", 1, 9), node("3", "decodeJwt", "src/jwt.ts", 11, 19), node("4", "paint", "src/ui.ts", 1, 9)], "id string, name string, file string, start_line long, end_line long, source string, signature string, external boolean, outline boolean, type_level boolean")
    edges = spark.createDataFrame([(1, "1", "2", "call", "verifyToken(t)"), (2, "2", "3", "call", "decodeJwt(t)")], "seq long, src_id string, dst_id string, kind string, site_text string")
    tok = {"1": ["refresh", "token"], "2": ["verify", "token"], "3": ["decode", "jwt"], "4": ["paint"]}
    docs = spark.createDataFrame([(r["id"], r["file"], int(r["start_line"]), tok[r["id"]], r["file"].replace("/", " ").replace(".", " ").split(), tok[r["id"]], tok[r["id"]], []) for r in nodes.collect()], "id string, file string, line int, name array<string>, path array<string>, signature array<string>, identifiers array<string>, literals array<string>")
    return docs, nodes, edges


def _judge(spark):
    return judge.TableJudge(spark.createDataFrame([("file", "file::src/auth.ts", 0.9), ("file", "file::src/ui.ts", 0.1), ("symbol", "1", 0.9), ("depth-1", "2", 0.9), ("depth-2", "3", 0.1)], "stage string, id string, score double"))


def test_retrieval(spark):
    docs, nodes, edges = _repo(spark)
    found, got = retrieval.retrieve("refresh the token", docs, nodes, edges, _judge(spark))
    assert [x["id"] for x in found.leads] == ["1"]
    assert {x["id"]: x["level"] for x in got} == {"1": "body", "2": "body", "3": "body"}
    tight = retrieval.retrieve("refresh the token", docs, nodes, edges, _judge(spark), found=found, options=retrieval.Options(token_budget=500, merge_lexical=False))[1]
    assert sum(x["level"] == "body" for x in tight) == 3


def test_not_covered(spark):
    docs, nodes, edges = _repo(spark)
    scores = spark.createDataFrame([("directory", "dir::.", 0.2), ("directory", "dir::unanalysed::legacy", 0.9)], "stage string, id string, score double")
    got = discovery.discover("old things", docs, nodes, edges, judge.TableJudge(scores), unanalysed=spark.createDataFrame([("legacy/a.js",)], "file string"))
    assert got.status == "not-covered"


def test_from_entry(spark):
    _, nodes, edges = _repo(spark)
    got = retrieval.from_entry("1", "refresh", nodes, edges, _judge(spark))
    assert [(x["id"], x["level"], x["depth"]) for x in got] == [("1", "body", 0), ("2", "body", 1), ("3", "omitted", 2)]
    assert got[2]["path"] == ["1", "2", "3"]
    everything = retrieval.from_entry("1", "refresh", nodes, edges, judge.IncludeAll())
    assert [x["level"] for x in everything] == ["body"] * 3
    assert len(retrieval.from_entry("1", "refresh", nodes, edges, judge.IncludeAll(), retrieval.Options(max_depth=0))) == 1


def test_options_are_checked():
    with pytest.raises(ValueError):
        retrieval.Options(token_budget=1)
    with pytest.raises(ValueError):
        discovery.Options(max_leads=9)
    assert discovery.ablation("leads-only")[1]["expand"] is False


def test_streams(spark, tmp_path):
    rows = [{"event_id": k, "time": f"2026-01-01T00:00:{k:02d}Z", "tool": "t", "project": "p", "ms": float(v), "candidate_tokens": 100, "returned_tokens": 60} for k, v in enumerate((10, 20, 30, 40, 50, 60))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    log = stream.read_log(spark, str(tmp_path / "in"))
    q = stream.rolling_latency(log, 5).writeStream.format("memory").queryName("lat").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["median"], r["p95"]) for r in spark.table("lat").orderBy("event_id").collect()][4:] == [(30.0, 50.0), (40.0, 60.0)]
    q = stream.running_totals(log).writeStream.format("memory").queryName("tot").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tot").select("calls", "saved").first() == (6, 240)
    stream.append_log(log, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_judge_batches(spark):
    c = spark.range(40).select(F.lit("s").alias("stage"), "id")
    assert {r["batch"]: r["count"] for r in judge.batches(c).groupBy("batch").count().collect()} == {0: 16, 1: 16, 2: 8}


def test_term_freq_fields_is_whole(spark):
    fields = ("name", "path", "signature", "identifiers", "literals")
    rows = bindings.fields(spark, SF).collect()
    want = Counter((r["id"], f, t) for r in rows for f in fields for t in r[f])
    assert {(r["id"], r["field"], r["term"]): r["tf"] for r in registry.QUERIES["term_freq_fields"](spark, SF).collect()} == want
    assert {f for _, f, _ in want} == set(fields) and min(want.values()) == 1
