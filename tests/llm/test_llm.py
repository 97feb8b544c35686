"""Each operator against a plain version, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import bagminhash, balltree, bpe, castore, line_dedup, mixing, pii, quality, queries, recurrent, suffix_dedup
from lodestar.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "word", "a b c d e", "x " * 30000, "line one of many words here\n" * 40, "é🙂\n\n  tabs\tand more", "same text again and again", "same text again and again"]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    data = [(k, t, "en", None if k % 3 else "s", 1, k, f"x{k}") for k, t in enumerate(ODD)] + [(8, ODD[8], "en", None, 1, 8, "again"), (None, "no id", "en", "s", 1, 1, "n")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, kept string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def dicts(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


# --- 3: byte-level BPE ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "é", "ñ", "12", "!!", "'s", "'", "日本", "🙂", "\x1c", "\xa0", "zq", "aaaa", "\t"]), max_size=30).map("".join))
def test_bpe_as_the_library(encoder, reference, text):
    assert encoder.ids(text) == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), st.integers(1, 5))
def test_bpe_round_trip(encoder, text, every):
    parts = list(bpe.decode_parts(encoder.ids(text), encoder.machine.token.__getitem__, every))
    assert "".join(t for _, t in parts) == text and b"".join(b for b, _ in parts) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12), st.integers(1, 4))
def test_utf8_states(data, every):
    """Any bytes in any parts give what they give at once, and a character that can still become whole waits."""
    machine = bpe.Utf8()
    got = [machine.feed(data[k : k + every]) for k in range(0, len(data), every)] + [machine.feed(b"", final=True)]
    assert "".join(got) == data.decode("utf-8", "replace")


def test_bpe_long_pieces_and_small_tables(reference):
    machine = bpe.Transducer(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), most=50)
    for piece in ("a" * 5000, "abcdefghij" * 800, " " * 300):
        assert machine.encode(piece.encode()) == reference.encode_ordinary(piece)


def test_bpe_query(spark, rows, reference):
    got = dicts(queries.op3_bpe(spark, SF), "doc_id")
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids))), "decoded_sha256": sha(t or "")}


def test_bpe_odd(odd, none):
    made = bpe.encode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == sha(r["text"] or "") for r in made.collect())
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# --- 4: quality rules ----------------------------------------------------------------------------------------------------


def plain_rules(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k : k + 3])] > 1}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": failed}


def test_quality_query(spark, rows):
    got = dicts(queries.op4_quality(spark, SF), "doc_id")
    for i, t in rows:
        want = plain_rules(t)
        assert {k: got[i][k] for k in want} == want
        assert not (got[i]["kept"] and want["base_failed"])


def test_quality_separates(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality.score(docs, quality.fit(docs, labels)).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    rate = {r["quality"]: r["kept"] for r in got}
    assert rate[1] == 1.0 and rate[0] < 0.1


def test_quality_odd(spark, odd, none):
    ratio = quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"), buckets=1024)
    assert not ratio.any()
    got = quality.score(odd, ratio).collect()
    assert len(got) == odd.count()
    for r in got:
        want = plain_rules(r["text"])
        assert {k: r[k] for k in want} == want and r["kept"] == (not want["base_failed"])
    assert quality.score(none, ratio).count() == 0 and not quality.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"), buckets=64).any()


# --- 1: line dedup -------------------------------------------------------------------------------------------------------


def test_line_dedup_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(map(tuple, c.execute(queries.LINE_DEDUP_SQL).fetchall()))
    assert sorted(tuple(r) for r in queries.op1_line_dedup(spark, SF).select("doc_id", "n_lines", "n_removed_lines", "kept_sha256").collect()) == want


def test_line_dedup_cases(spark, odd, none):
    long = [f"line {k} " + "w " * 9 + "end" for k in range(12)]
    data = [(1, "\n".join(long)), (2, "\n".join(["own first"] + long[3:9] + ["own last"])), (3, "\n".join(long[:3])), (4, "\n".join(long[:5] + ["mid"] + long[:5])), (5, None)]
    got = {r["doc_id"]: r for r in line_dedup.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1]["n_removed_lines"] == 0 and got[2]["text"] == "own first\nown last"
    assert got[3]["text"] == "\n".join(long[:3])  # under 50 words
    assert got[4]["text"] == "mid" and got[5]["text"] is None
    same = spark.createDataFrame([(1, "\n".join(long))] * 3, "doc_id long, text string")
    assert sorted(r["n_removed_lines"] for r in line_dedup.deduplicate(same).collect()) == [0, 12, 12]
    assert line_dedup.deduplicate(odd).count() == odd.count() and line_dedup.deduplicate(none).count() == 0
    assert "PythonUDF" not in line_dedup.deduplicate(odd)._jdf.queryExecution().toString()


# --- 10: BagMinHash ------------------------------------------------------------------------------------------------------


def bag(text):
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def plain_classes(rows):
    bags, first, parent = [bag(t) for _, t in rows], {}, list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    index = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        if (j := first.setdefault(t or "", k)) != k:
            parent[find(k)] = find(j)
        for g, n in bags[k].items():
            index[g].append((k, n))
    both = Counter()
    for found in index.values():
        for x in range(len(found)):
            for y in range(x):
                both[found[y][0], found[x][0]] += min(found[x][1], found[y][1])
    for (a, b), n in both.items():
        if n >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - n):
            parent[find(b)] = find(a)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), i), i)
    return sorted((i, best[find(k)]) for k, (i, _) in enumerate(rows))


def test_near_dedup_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, queries.op10_bagminhash(spark, sf).collect())) == plain_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng, errors = np.random.default_rng(3), []
    for _ in range(60):
        h = rng.choice(1 << 32, 80, replace=False).astype(np.uint32)
        a, b = rng.integers(0, 9, 80), rng.integers(0, 9, 80)
        s, t = (bagminhash.signature(np.sort(h[w > 0]), w[w > 0][np.argsort(h[w > 0])]) for w in (a, b))
        errors.append((s == t).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_near_dedup_hard_buckets(spark):
    """Texts that share most of a passage without being near each other, and chains of near copies."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[: 55 + k % 5] + [f"own{k}x{j}" for j in range(40)])) for k in range(30)]
    chain = list(base)
    for k in range(30, 45):
        chain = [*chain]
        chain[(k - 30) * 6] = f"new{k}"
        rows.append((k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, bagminhash.classes(df).select("doc_id", "class_id").collect())) == plain_classes(rows)


def test_near_dedup_odd(odd, none):
    got = bagminhash.deduplicate(odd)
    assert got.columns == odd.columns
    texts = [r["text"] or "" for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for t in ODD}) + 1
    assert bagminhash.deduplicate(none).count() == 0 and bagminhash.classes(none).count() == 0


# --- 9: suffix dedup -----------------------------------------------------------------------------------------------------


def plain_suffix(rows, n=200):
    seen = Counter(b[k : k + n] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - n + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                edge[k] += 1
                edge[k + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return sorted(out, key=repr)


def test_suffix_query(spark, rows):
    assert sorted(map(tuple, queries.op9_suffix_dedup(spark, SF).collect()), key=repr) == plain_suffix(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(4, 40))
def test_suffix_pointers(texts, length):
    """Places with so many bytes left share a pointer if and only if these bytes are equal."""
    sizes, data = np.array([len(t) for t in texts]), b"".join(texts)
    ends = np.repeat(np.cumsum(sizes), sizes)
    got, one, other = suffix_dedup.refined(np.frombuffer(data, np.uint8), ends, length), {}, {}
    for p in range(len(data)):
        if ends[p] - p >= length:
            b = data[p : p + length]
            assert one.setdefault(b, got[p]) == got[p] and other.setdefault(got[p], b) == b


def test_suffix_runs_at_segment_borders(monkeypatch):
    data = np.random.default_rng(5).integers(97, 100, 9000).astype(np.uint8)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    whole = suffix_dedup.runs(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 11)
    cut = suffix_dedup.runs(data)
    starts = lambda got: [(int(a), s) for a, first, last in zip(*got[:3], strict=True) for s in range(first, last + 1)]
    assert starts(whole) == starts(cut) and len(set(cut[1].tolist())) == len(cut[1])


def test_suffix_cases(spark, monkeypatch, none):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, rows = word(400), []
    for k in range(30):
        rows.append((k, word(150) + shared[k * 3 : 390 - k * 2] + word(120)))
    rows += [(50, "ab" * 400), (51, word(199)), (52, shared[:200]), (53, None), (54, ""), (55, "é" * 150), (56, rows[0][1]), (56, rows[0][1]), (57, word(300) + "ab" * 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_suffix(rows)
    assert sorted(map(tuple, suffix_dedup.deduplicate(df).collect()), key=repr) == want
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2)  # all buckets take the way of the large ones
    assert sorted(map(tuple, suffix_dedup.deduplicate(df).collect()), key=repr) == want
    assert suffix_dedup.deduplicate(none).count() == 0


# --- 5: personal data ----------------------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def fine(kind, value):
        d = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if fine(k, m[0]))


TRICKY = ["a@b.c_d@e.f", "x@y z@w.com.", "1.2.3.4.5.6.7.8", "300.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111", "+1 (555) 010-9999x +12", "é ü@x.de ñ a.b+c%d@x-y.z.org", "9" * 5000, "a" * 20000, "1-2 3-4 " * 3000, "+1.2.3.4.5.6.7.8.9.0", "a@b.c.d.e@f.g", "..@..a@-.-", None, "", "@" * 50]
TRICKY += ["10.0.0.1 " * 700, "4111 1111 1111 1111, é " * 600, "a@b.co +1 555 010 99 99; " * 600, "7-4111 1111 1111 1111 -4111111111111111 5 -4111-1111-1111-1111"]
TRICKY += ["".join(np.random.default_rng(k).choice(list("0123456789 -."), 4000, p=[0.08] * 10 + [0.09, 0.08, 0.03])) for k in range(6)]


def test_pii_base(spark, rows):
    data = [(k, t) for k, t in enumerate(TRICKY)] + [(1000 + i, t) for i, t in rows]
    got = dicts(pii.report(spark.createDataFrame(data, "doc_id long, text string")), "doc_id")
    for i, t in data:
        want = plain_spans(t or "")
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in want)), t
        assert {k: got[i][f"n_{k}"] for k in KINDS} == {k: sum(w[3] == k for w in want) for k in KINDS}


def test_pii_terms_that_disclose(spark):
    mail = "zoe@mail.example.org"
    data = [(k, f"today number{chr(97 + k)} Quillfeather wrote from {mail} about item{chr(97 + k)}") for k in range(8)] + [(100 + k, f"today somebody wrote about nothing number{chr(97 + k % 8)}") for k in range(60)]
    got = dicts(pii.report(spark.createDataFrame(data, "doc_id long, text string")), "doc_id")
    text = data[0][1]
    at = text.index("Quillfeather")
    assert f"term:{at}:{at + 12}" in got[0]["spans"] and "term" not in got[100]["spans"]
    assert f"term:{text.index('wrote')}" not in got[0]["spans"]
    clean = dicts(pii.sanitize(spark.createDataFrame(data, "doc_id long, text string")), "doc_id")
    assert "Quillfeather" not in clean[0]["text"] and mail not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"]
    copies = spark.createDataFrame([(k, data[0][1]) for k in range(9)] + data[8:], "doc_id long, text string")
    assert "term" not in dicts(pii.report(copies), "doc_id")[0]["spans"]  # a text that is only copied is no evidence


def test_pii_copies_hide_no_term(spark):
    texts = [f"number{chr(97 + k)} Quillfeather wrote from zoe@mail.example.org about item{chr(97 + k)}" for k in range(8)]
    data = [(k, texts[k % 8]) for k in range(400)] + [(1000 + k, f"somebody wrote about {chr(97 + k // 26) * 3}{chr(97 + k % 26) * 3}") for k in range(600)]
    spans = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    at = texts[0].index("Quillfeather")
    assert all(f"term:{at}:{at + 12}" in spans[k] for k in range(400))


def test_pii_rare_entities_and_far_terms(spark):
    filler = " ".join(f"filler{chr(97 + k)}" for k in range(26))
    texts = [f"Quillfeather wrote {chr(97 + k) * 4} {filler} mail to user{k}@mail{k}.example" for k in range(6)]
    data = list(enumerate(texts)) + [(100 + k, f"somebody wrote {filler} mail {chr(97 + k // 26) * 3}{chr(97 + k % 26) * 3}") for k in range(200)]
    spans = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):  # each address occurs once, 27 words away from the name
        assert [x for x in spans[k].split(",") if x.startswith("term")] == ["term:0:12"], spans[k]
    assert not any(spans[100 + k] for k in range(200))


def test_pii_odd(odd, none):
    assert pii.report(odd).count() == odd.count() and pii.report(none).count() == 0
    assert pii.sanitize(odd).columns == odd.columns and pii.sanitize(odd).count() == odd.count()
    assert "PythonUDF" not in pii.report(odd)._jdf.queryExecution().toString()


# --- 6: exact top k ------------------------------------------------------------------------------------------------------


def plain_top(rows, k=5):
    v = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in v:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in v if j != i and len(w) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_top_k_query(spark):
    data = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, queries.op6_balltree(spark, SF).collect())) == plain_top(data)


def test_top_k_cases(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD", 20)
    monkeypatch.setattr(balltree, "BALLS", 3)
    rng = np.random.default_rng(0)
    data = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(150)] + [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(150, 260)]
    data += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (None, [1.0] * 4), (352, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, balltree.top_k(df).collect())) == plain_top(data)
    assert balltree.top_k(df.limit(0)).count() == 0


# --- 7: content-addressed store ------------------------------------------------------------------------------------------


def plain_store(rows):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, out = 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_query(spark, rows):
    assert sorted(map(tuple, queries.op7_castore(spark, SF).collect())) == plain_store(rows)


def test_store_encodes_as_the_library(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n y", "<|endoftex|>", "plain", "a  b", "é <|endoftext|>ü", None]
    rows = list(enumerate(texts))
    got = castore.store_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, castore.read_store(spark, *got).collect())) == plain_store(rows)


def test_store_checks_the_chunk_lists(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(9000))
    root = castore.write_store(spark.createDataFrame([(1, text)], "doc_id long, text string"), P.path("byte_bpe_50k.json"), str(tmp_path / "s"))
    recipes = spark.read.parquet(str(tmp_path / "s/recipes"))
    turned = spark.createDataFrame(recipes.withColumn("chunks", F.transform(F.reverse("chunks"), lambda c, i: F.struct(i.alias("seq"), c["address"].alias("address"), c["n"].alias("n")))).collect(), recipes.schema)
    turned.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "s/recipes"))
    with pytest.raises(ValueError):
        castore.read_store(spark, str(tmp_path / "s"), root)


def test_store_odd(spark, odd, none):
    got = queries.castore.store_documents(odd.where("doc_id is not null"), P.path("byte_bpe_50k.json"))
    ordered = sorted(((r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()), key=lambda r: r[0])
    assert sorted(map(tuple, castore.read_store(spark, *got).collect())) == plain_store(ordered)
    empty = castore.store_documents(none, P.path("byte_bpe_50k.json"))
    assert castore.read_store(spark, *empty).count() == 0


def test_store_keeps_chunks_once_and_checks(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(3000))
    df = spark.createDataFrame([(k, text + (" tail" if k % 2 else "")) for k in range(20)], "doc_id long, text string")
    root = castore.write_store(df, P.path("byte_bpe_50k.json"), str(tmp_path / "s"))
    chunks = spark.read.parquet(str(tmp_path / "s/objects")).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("address").distinct().count() < 60
    with pytest.raises(ValueError):
        castore.read_store(spark, str(tmp_path / "s"), "0" * 64)
    assert castore.read_store(spark, str(tmp_path / "s"), root).count() == 20


def test_crc_join():
    a, b = b"some bytes", b"and quite a few more of them"
    assert castore.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# --- 8: mixing -----------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Exact fractions, in rounds: whatever is over twice its size stops there, the rest shares what is left."""
    order = sorted(s for s, _ in sizes if s is not None) + [s for s, _ in sizes if s is None]
    weight, size = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, dict(sizes)
    stopped: dict = {}
    while True:
        left = Fraction(3, 2) * sum(size.values()) - sum(stopped.values())
        open_ = [s for s in order if s not in stopped]
        got = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s: Fraction(2 * size[s]) for s in open_ if got[s] > 2 * size[s]}
        if not over:
            return got | stopped
        stopped |= over


@pytest.mark.parametrize("few", [True, False])
def test_targets(spark, monkeypatch, few):
    """Also where there are more sources than are broadcast."""
    if not few:
        monkeypatch.setattr(mixing, "SOURCES", 1)
    rng = np.random.default_rng(3)
    for sizes in ([("b", 100), ("a", 10), (None, 1000), ("c", 100)], [(f"s{k:03}", int(x)) for k, x in enumerate(rng.pareto(0.6, 60) * 50)], [("only", 7)], [("none", 0), ("x", 3)]):
        want = plain_targets(sizes)
        df = spark.createDataFrame([(k, s, " ".join(["w"] * n)) for k, (s, n) in enumerate(sizes)], "doc_id long, source string, text string")
        for r in mixing.decide(df).collect():
            assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12) and r["copies"] in (int(r["target"] // r["size"]), -int(-r["target"] // r["size"])) if r["size"] else r["target"] == 0


def test_meetings_keep_the_mean():
    out = [mixing.meet(0.3, 0.9, (k + 0.5) / 1000) for k in range(1000)]
    assert abs(np.mean([a for a, _ in out]) - 0.3) < 0.01 and all(abs(a + b - 1.2) < 1e-9 for a, b in out)


def test_mixing_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op8_mixing(spark, sf).collect())) and len(got) == len(docs)
    sums = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]]["text"] or "")) and r["taken"] <= 2 * r["size"]
        s = sums[docs[r["doc_id"]]["source"]]
        s[0], s[1], s[2] = s[0] + r["taken"], r["target"], s[2] + r["size"]
    assert all(abs(t - w) < 0.15 * max(w, 1) for t, w, _ in sums.values())
    assert abs(sum(w for _, w, _ in sums.values()) - 1.5 * sum(n for _, _, n in sums.values())) < 1e-3


def test_mixing_levels_and_odd(spark, odd, none):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.lit("one").alias("source")).unionByName(spark.createDataFrame([(9000 + k, "a b c", "two") for k in range(300)], "doc_id long, text string, source string"))
    got = mixing.decide(df, group=16, fan_in=4).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 3 for r in got)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.mix(none).count() == 0
    counts = Counter((r["doc_id"], r["n_chars"]) for r in mixed.collect())
    assert max(counts.values()) <= 4  # twice, and the repeated row twice


# --- 2: recurrent language model -----------------------------------------------------------------------------------------


def test_recurrent_gradients():
    rng, net = np.random.default_rng(0), recurrent.Network(np.arange(100, 0, -1).astype(float))
    net.p = {k: v.astype(np.float64) + rng.normal(size=v.shape) * 0.1 for k, v in net.p.items()}
    x, y, fresh = rng.integers(0, 100, (5, 3)), rng.integers(0, 100, (5, 3)), np.zeros((5, 3), bool)
    fresh[2, 1] = True
    h = rng.normal(size=(3, recurrent.HIDDEN))
    _, grad, _ = net.gradients(h.copy(), x, y, fresh)
    dense = np.zeros_like(net.p["inp"])
    dense[grad["inp"][0]] = grad["inp"][1]
    for k, g in {**grad, "inp": dense}.items():
        at = tuple(int(rng.integers(0, n)) for n in net.p[k].shape) if k != "inp" else (int(grad["inp"][0][0]), 3)
        net.p[k][at] += 1e-5
        up = net.gradients(h.copy(), x, y, fresh)[2]
        net.p[k][at] -= 2e-5
        down = net.gradients(h.copy(), x, y, fresh)[2]
        net.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3, k


def test_recurrent_carries_state():
    net = recurrent.Network(np.arange(50, 0, -1).astype(float))
    docs = [np.array([k % 50 for k in range(n)]) for n in (1, 7, 200, 64)]
    whole = net.score(docs, 0)
    assert np.allclose(whole, net.score(docs, 0, lanes=2, window=5), atol=1e-3)
    assert np.allclose(whole, [net.score([d], 0)[0] for d in docs], atol=1e-3)


def test_recurrent_query(spark):
    sf = "/root/testdata/sf0.01"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(low)), "\n"] for r in table(spark, sf, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = dicts(queries.op2_recurrent(spark, sf), "doc_id")
    assert got.keys() == toks.keys()
    for i, t in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    per = lambda k: sum(r[k] for r in got.values() if r["held_out"]) / sum(r["n_tokens"] for r in got.values() if r["held_out"])
    assert per("score") > per("base_score")


def test_recurrent_learns_from_every_training_document(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").union(spark.createDataFrame([(None, f"no id {k}") for k in range(40)], "doc_id long, text string"))
    model = recurrent.Model(recurrent.count_words(docs).cache())
    encoded = recurrent.encode(docs, model).cache()
    assert sum(recurrent._train_round(encoded, model, k, 2) for k in range(recurrent.ROUNDS)) == model.total


def test_recurrent_names_frequent_words(spark):
    words = [f"w{k}" for k in range(recurrent.WORDS + 60) for _ in range(1 + (k < recurrent.WORDS))]
    model = recurrent.Model(recurrent.count_words(spark.createDataFrame([(None, " ".join(words))], "doc_id long, text string")).cache())
    named = {int(model.ids[np.searchsorted(model.hashes, recurrent.hash_of(f"w{k}"))]) for k in range(recurrent.WORDS)}
    assert len(named) == recurrent.WORDS and model.other not in named


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aZé \t\n\x0b\x0c\r\x1c\x85\u2003\x00x", max_size=12), max_size=5))
def test_recurrent_words(texts):
    n, which, h = recurrent.words_in(pa.array(texts, pa.string()))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = [WORD.findall(t.translate(low)) for t in texts]
    assert n.tolist() == [len(p) for p in plain] and h[which].tolist() == [recurrent.hash_of(w) for p in plain for w in p]
    assert len(set(h.tolist())) == len({w for p in plain for w in p})


def test_recurrent_score_follows_the_network(spark):
    """Of each text, word by word in a loop: the network's mix with the unigram, and for other words their counts."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    model, counts, encoded = recurrent.fit(docs)
    c, net = {r["h"]: r["c"] for r in counts.collect()}, model.network
    named = dict(zip(model.hashes.tolist(), model.ids.tolist(), strict=True))
    got = dicts(recurrent.score(docs, model, counts, encoded), "doc_id")
    for r in docs.where("length(text) < 900").limit(25).collect():
        h, last, total = np.zeros((1, recurrent.HIDDEN), np.float32), model.end, 0.0
        for w in [*WORD.findall(r["text"] or ""), None]:
            k = model.end if w is None else named.get(recurrent.hash_of(w), model.other)
            h, _ = net.step(h, net.p["inp"][[last]])
            p = recurrent.SHARE_NET * math.exp(net.log_p(h, np.array([k]))[0][0]) * model.within[k] + (1 - recurrent.SHARE_NET) * model.unigram[k]
            total += math.log10(p * (c.get(recurrent.hash_of(w), 0) + 1 if k == model.other else 1))
            last = k
        assert got[r["doc_id"]]["score"] == pytest.approx(total, rel=1e-4)


def test_recurrent_reruns_agree(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    one, two = (dicts(recurrent.score(d, *recurrent.fit(d)), "doc_id") for d in (docs, docs.repartition(7, "text")))
    assert one.keys() == two.keys() and all(one[k]["score"] == pytest.approx(two[k]["score"], rel=1e-6) for k in one)


def test_recurrent_long_text_beside_short_ones():
    net, rng = recurrent.Network(np.arange(50, 0, -1).astype(float)), np.random.default_rng(1)
    docs = [rng.integers(1, 50, 100_000).astype(np.uint16), *(rng.integers(1, 50, 5).astype(np.uint16) for _ in range(600))]
    tracemalloc.start()
    got = net.score(docs, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(got).all() and peak < 40e6  # bytes; lanes padded to the longest would take 1.3e9


def test_recurrent_odd(odd, none):
    got = recurrent.score(odd, *recurrent.fit(odd)).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert recurrent.score(none, *recurrent.fit(none)).count() == 0
    assert all(math.isfinite(r["score"]) for r in recurrent.score(odd, *recurrent.fit(none)).collect())


# --- the pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, rows, reference):
    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append((name, docs.count()))
    assert [n for n, _ in seen] == ["quality rules", "line dedup", "near dedup", "mixing", "tokens"]
    assert len(rows) > seen[0][1] >= seen[1][1] >= seen[2][1]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_stages_keep_columns(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
