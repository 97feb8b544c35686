"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every document's word unigrams and bigrams are hashed into ``buckets`` bins. Two multinomials are counted, one over all
documents and one over the trusted ones (labelled good and not toxic), both smoothed; a document's verdict is the mean log
ratio of its n-grams against a fixed threshold, so a document's length cancels and a rerun agrees.

Cases: a null or empty text has no words and fails the base rules; without any trusted document the ratio is 0 for all, and
only the base rules decide; repeated rows are scored alike; other columns pass through, and one that has the name of a
result is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, add_columns, release, small

BUCKETS = 1 << 16
#: Mean log ratio below which a document goes.
THRESHOLD = -0.17
#: Pseudo-counts for each bin, dealt as the raw corpus is: a small target says little, and then nobody is rejected by it.
PRIOR = 2.0
#: At most so many labelled rows, those with the least hash, say which documents are trusted.
TRUSTED = 20_000
MEMO = 150_000
FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("llr", T.DoubleType())]


class Words(dict):
    """Word -> number, with a hash kept for each number. Bounded: start() forgets all once it is large."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.chars = np.zeros(1 << 12, np.int64)

    def __missing__(self, word):
        n = self[word] = len(self)
        if n >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.hashes[n] = self.hash(word.encode("utf-8", "surrogatepass"))
        self.chars[n] = len(word)
        return n

    def start(self):
        if len(self) > MEMO:
            self.clear()

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bins of the unigrams and the bigrams of a document."""
    with np.errstate(over="ignore"):
        two = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        mixed = np.concatenate([hashes, two]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(40)).astype(np.int64) % buckets


def repeated_words(ids: np.ndarray) -> int:
    """Words in a 3-word window that is found twice or more in the text."""
    if len(ids) < 4:
        return 0
    _, low = np.unique(ids, return_inverse=True)
    span = int(low.max()) + 1
    pair = low[:-1] * span + low[1:]
    if span >= 1 << 20:
        _, pair = np.unique(pair, return_inverse=True)
    key = pair[:-1] * span + low[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def ngram_counts(docs: DataFrame, trusted: set, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): counts over all documents and over those in ``trusted``; each task sends sums only."""

    def count(batches):
        import pyarrow as pa

        find, words, sums = re.compile(WORD).findall, Words(), np.zeros((2, buckets), np.int64)
        for b in small(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words.start()
                got = words.numbers(find(text or ""))
                if len(got):
                    add = np.bincount(buckets_of(words.hashes[got], buckets), minlength=buckets)
                    sums[0] += add
                    if doc_id in trusted:
                        sums[1] += add
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    each = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED) -> np.ndarray:
    """Log ratio by bucket. What comes to the driver is bounded by ``trusted_rows`` ids and ``buckets`` sums."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(trusted_rows)
    trusted = {r[0] for r in good.select("doc_id").collect()}
    sums = np.zeros((2, buckets))
    for bucket, raw, target in ngram_counts(docs, trusted, buckets).collect():
        sums[:, bucket] = raw, target
    if not sums[1].sum():
        return np.zeros(buckets)
    prior = (sums[0] + 0.5) / (sums[0] + 0.5).sum()
    target = (sums[1] + buckets * PRIOR * prior) / (sums[1].sum() + buckets * PRIOR)
    return np.log(target) - np.log(prior)


def score(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Adds the counts of the base rules, ``llr`` (mean log ratio) and ``kept`` to every row."""
    buckets = len(ratio)

    def make():
        release()
        find, symbols, words = re.compile(WORD).findall, re.compile(r"[#*$%&|<>]").findall, Words()

        def step(texts):
            out = [[] for _ in FIELDS]
            for text in texts:
                text = text or ""
                words.start()
                ids = words.numbers(find(text))
                n, lines = len(ids), [x for x in text.split("\n") if x and not x.isspace() or find(x)]
                lines = [x for x in lines if find(x)] if any(x.isspace() for x in lines) else lines
                again = repeated_words(ids)
                llr = float(ratio[buckets_of(words.hashes[ids], buckets)].mean()) if n else 0.0
                failed = n < 50 or 100 * again > 50 * n
                for column, value in zip(out, (n, int(words.chars[ids].sum()), len(symbols(text)), len(lines) - len(set(lines)), again, failed, not failed and llr >= threshold, llr), strict=True):
                    column.append(value)
            return out

        return step

    return add_columns(docs, ["text"], make, FIELDS, keep)
