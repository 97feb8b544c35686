"""The whole pipeline against plain Python, stage by stage, from the same documents."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash

import corpus_pipeline
from lodestar.llm import bpe, mixing, quality
from lodestar.llm.common import doc_key, table

from .test_llm import WORD, plain_classes, plain_rules, plain_targets

SF = "/root/testdata/sf0.001"


def plain_quality(docs, good):
    """Mean log ratio of hashed n-grams, counted in plain dictionaries."""
    def bins(text):
        h = np.array([xxhash.xxh64_intdigest(w.encode()) for w in WORD.findall(text or "")], np.uint64)
        return quality.buckets_of(h, quality.BUCKETS).tolist() if len(h) else []

    raw, target = Counter(), Counter()
    for d in docs:
        raw.update(bins(d["text"]))
        if d["doc_id"] in good:
            target.update(bins(d["text"]))
    n, t, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    prior = lambda k: (raw[k] + 0.5) / (n + 0.5 * b)
    ratio = lambda k: np.log((target[k] + b * quality.PRIOR * prior(k)) / (t + b * quality.PRIOR)) - np.log(prior(k))
    return [d for d in docs if not plain_rules(d["text"])["base_failed"] and np.mean([ratio(k) for k in bins(d["text"])]) >= quality.THRESHOLD]


def plain_line_dedup(docs, least=50):
    lines, first, windows = {}, {}, []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        every = d["text"].split("\n")
        full = [(k, x, x.count(" ") + 1) for k, x in enumerate(every) if x.strip(" \t\r\f\x0b")]
        lines[d["doc_id"]] = every
        found = set()
        for j in range(len(full)):
            for way in (1, -1):
                total, k = 0, j
                while 0 <= k < len(full) and total < least:
                    total, k = total + full[k][2], k + way
                if total >= least:
                    found.add((min(j, k - way), max(j, k - way)))
        for lo, hi in sorted(found):
            key = tuple(x for _, x, _ in full[lo : hi + 1])
            at = (d["doc_id"], full[lo][0], full[hi][0])
            first[key] = min(first.get(key, at), at)
            windows.append((key, at))
    gone = defaultdict(set)
    for key, (i, lo, hi) in windows:
        a, _, end = first[key]
        if a != i or end < lo:
            gone[i] |= set(range(lo, hi + 1))
    out = []
    for d in docs:
        text = "\n".join(x for k, x in enumerate(lines[d["doc_id"]]) if k not in gone[d["doc_id"]])
        if not gone[d["doc_id"]] or WORD.search(text):
            out.append({**d, "text": text})
    return out


def plain_mix(docs, keys):
    size = {d["doc_id"]: len(WORD.findall(d["text"])) for d in docs}
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d)
    want, out = plain_targets([(s, sum(size[d["doc_id"]] for d in g)) for s, g in by.items()]), []
    for s, group in by.items():
        assert len(group) <= mixing.GROUP
        x = want[s] / sum(size[d["doc_id"]] for d in group)
        rows = [(size[d["doc_id"]], d["doc_id"], keys[d["text"]], float(x - int(x))) for d in group]
        for (_, i, (k1, k2), _), p, d in zip(rows, mixing.round_group(rows, 0), group, strict=True):
            if 0 < p < 1:
                u = int(hashlib.sha256(f"last:{s}:{i}:{k1}:{k2}".encode()).hexdigest()[:13], 16) / (1 << 52)
                p = float(u < p)
            out += [d] * (int(x) + int(p))
    return out


def test_run_equals_the_plain_version(spark):
    docs = [r.asDict() for r in table(spark, SF, "documents").collect()]
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1 and toxic = 0").collect()}
    a = plain_quality(docs, good)
    b = plain_line_dedup(a)
    best = {c for _, c in plain_classes([(d["doc_id"], d["text"]) for d in b])}
    c = [d for d in b if d["doc_id"] in best]
    k1, k2 = doc_key()
    keys = {r["text"]: (r["x"], r["y"]) for r in spark.createDataFrame([(d["text"],) for d in c], "text string").select("text", k1.alias("x"), k2.alias("y")).collect()}
    d = plain_mix(c, keys)
    assert len(docs) > len(a) > len(c) and re.search(r"\w", c[0]["text"])
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((x["doc_id"], x["lang"], x["source"], len(ids := coder.encode_ordinary(x["text"])), sha(" ".join(map(str, ids))), sha(x["text"])) for x in d)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == want
