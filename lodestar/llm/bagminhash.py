"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A document is the multiset of its ``SHINGLE``-word windows (a shorter one is a single shingle of all its words). Over the
weight axis of each shingle, cut at 1, 2, 4, ..., stands a Poisson process for each piece, of rate its width; a point is seen by
a document whose weight reaches above the point. Each point falls on one of ``M`` places, and a place keeps the earliest: two
documents agree in a place with the probability of their weighted Jaccard similarity. Pieces are only followed up to the time
by which every place is taken.

Bands of the signature are the buckets. Each member of a bucket is held against the least member by the whole overlap of the
multisets; those that fail are held so against all members, in blocks of bounded size with an index over shingles, so no bucket
is capped and no pair is listed that isn't a link. In an overlap a shingle is known by 32 bits: two texts of ten thousand
different shingles share one by chance in one case of forty. Exact copies are one node from the start. Links are followed to
components by passing the least label on, in checkpointed rounds.

Cases: null counts as an empty text; documents without words are copies of each other only; a repeated row is one more copy; a
null doc_id is greater than any; an empty table gives an empty result; other columns are not read (``deduplicate`` keeps them).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, doc_key, row_order, small, unused
from .quality import Words

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
BLOCK = 512
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str], numbers: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles, ascending, and how often each stands in the text."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    ids = numbers.numbers(words)
    h = numbers.hashes[ids]
    n, size = max(1, len(h) - SHINGLE + 1), min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mix(out * _A + h[k : k + n])
    got, count = np.unique((out >> np.uint64(32)).astype(np.uint32), return_counts=True)
    return got, count


def signature(hashes: np.ndarray, weights: np.ndarray, m: int = M) -> np.ndarray:
    """The earliest point in each of ``m`` places; ``hashes`` is not empty."""
    with np.errstate(over="ignore"):
        base = [hashes.astype(np.uint64) * _A]
        width, limit = [np.ones(len(hashes))], [weights]
        low, piece = 1, 1
        while (more := weights > low).any():
            base.append(mix(hashes[more].astype(np.uint64) * _A + np.uint64(piece)))
            width.append(np.full(int(more.sum()), float(low)))
            limit.append(weights[more] - low)
            low, piece = 2 * low, piece + 1
        seeds, width, limit = np.concatenate(base), np.concatenate(width), np.concatenate(limit)
        until = m * (np.log(m) + 3) / weights.sum()
        while True:
            places, times, names = _points(seeds, width, limit, until, m)
            order = np.argsort(times)[::-1]
            out = np.zeros(m, np.uint64)
            taken = np.zeros(m, bool)
            out[places[order]] = names[order]
            taken[places] = True
            if taken.all():
                return out
            until *= 2


def _points(seeds, width, limit, until, m):
    """Points up to a time: place, time, name. Those above the document's weight are left out."""
    found, now, k = [], np.zeros(len(seeds)), 0
    while len(seeds):
        step = int(min(64, max(4, until * width.mean() * 1.2 + 2)))
        h = mix(seeds[:, None] + (np.arange(k, k + step, dtype=np.uint64) + np.uint64(1)) * _C)
        gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width[:, None]
        at = now[:, None] + np.cumsum(gaps, axis=1)
        ok = at <= until
        names = mix(h + _A)
        seen = ok & (((names >> np.uint64(40)).astype(np.float64) / (1 << 24) * width[:, None]) < limit[:, None]) if width.max() > 1 else ok
        found.append(((names[seen] % np.uint64(m)).astype(np.int64), at[seen], h[seen]))
        on = ok[:, -1]
        seeds, width, limit, now, k = seeds[on], width[on], limit[on], at[on, -1], k + step
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def bands_of(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key for each band, different between bands."""
    with np.errstate(over="ignore"):
        rows = sig.reshape(bands, -1)
        out = np.arange(1, bands + 1, dtype=np.uint64) * _A
        for k in range(rows.shape[1]):
            out = mix(out + rows[:, k])
    return out.view(np.int64)


def pack(hashes: np.ndarray, weights: np.ndarray) -> bytes:
    """A multiset in bytes: hashes, then the weights if any is over 1."""
    return hashes.astype("<u4").tobytes() + (weights.astype("<u4").tobytes() + b"w" if (weights > 1).any() else b"")


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) % 4:
        both = np.frombuffer(data[:-1], "<u4").reshape(2, -1)
        return both[0], both[1].astype(np.int64)
    got = np.frombuffer(data, "<u4")
    return got, np.ones(len(got), np.int64)


def similarity(a: bytes, b: bytes) -> float:
    (x, wx), (y, wy) = unpack(a), unpack(b)
    total = int(wx.sum() + wy.sum())
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(wx[i], wy[j]).sum())
    return both / (total - both) if total else 0.0


def _reader(pick):
    """mapInArrow over texts: ``pick(words, numbers)`` -> the value of the last column."""

    def run(batches):
        find, numbers = re.compile(WORD).findall, Words()
        for b in small(batches):
            out = []
            for text in b.column("text").to_pylist():
                numbers.start()
                out.append(pick(find(text or ""), numbers))
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(out, pa.list_(pa.int64()) if pick is _bands else pa.binary())], [*keep, "made"])

    return run


def _bands(words, numbers):
    got = shingles(words, numbers)
    return bands_of(signature(*got)).tolist() if len(got[0]) else []


def _packed(words, numbers):
    return pack(*shingles(words, numbers))


def grouped(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(nodes, labels): a node for each different text, with its least doc_id; the component of each node that has a link."""
    k1, k2 = doc_key()
    keyed = docs.select("doc_id", k1.alias("node"), k2.alias("k2"), "text")
    banded = keyed.mapInArrow(_reader(_bands), "doc_id long, node long, k2 long, made array<long>")
    nodes = cut(banded.groupBy("node", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("made").alias("bands")))
    rows = nodes.select("node", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    held = cut(rows.join(hubs, "key"))
    pairs = held.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared"))
    pairs = cut(pairs.select("node", "hub"))

    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    first = nodes.join(wanted, "node", "left_semi").select("node", F.col("k2").alias("x"), F.col("doc_id").alias("d"))
    texts = keyed.join(first, (keyed["node"] == first["node"]) & (keyed["k2"] == first["x"]) & keyed["doc_id"].eqNullSafe(first["d"]), "left_semi")
    sets = cut(texts.select("node", "text").mapInArrow(_reader(_packed), "node long, made binary").groupBy("node").agg(F.first("made").alias("bag")))

    def verify(batches):
        for b in small(batches):
            near = [similarity(x, y) >= similar for x, y in zip(b.column("bag").to_pylist(), b.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("hub"), pa.array(near, pa.bool_())], ["node", "hub", "near"])

    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("bag").alias("other")), "hub")
    told = cut(both.select("node", "hub", "bag", "other").mapInArrow(verify, "node long, hub long, near boolean"))
    found = told.where("near").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    labels = components(found)
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_in"))
    failed = told.where("not near").select("node", "hub").join(of("node"), "node", "left").join(of("hub"), "hub", "left")
    failed = cut(failed.where(F.coalesce("node_in", "node") != F.coalesce("hub_in", "hub")).select("node", "hub"))
    if failed.isEmpty():
        return nodes, labels
    more = cut(_others(held, failed, sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), similar))
    return nodes, labels if more.isEmpty() else components(found.unionByName(more))


def _others(held: DataFrame, failed: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links between components that meet in a bucket, where its least member showed none: in blocks of bounded size.

    Every member of another component than the least one's is held against all members of other components than its own; of the
    links that a block finds, those that join what the block hasn't joined yet are listed, one fewer than it has components.
    """
    left = held.select("key", "node", "hub", "n").join(failed, ["node", "hub"]).select("key", "node", "n")
    open_ = left.groupBy("key").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("n > 2")
    sized = open_.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    seek = left.join(sized, "key").select("key", "node", F.pmod(F.xxhash64("node"), F.col("mb")).cast("int").alias("mi"), F.explode(spread("nb")).alias("ni"), F.lit(True).alias("seeks"))
    all_ = held.select("key", "node").join(sized, "key").select("key", "node", F.explode(spread("mb")).alias("mi"), F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("ni"), F.lit(False).alias("seeks"))
    given = seek.unionByName(all_).join(sets, "node")

    def compare(key, table):
        seeks, node, label = np.array(table.column("seeks").to_pylist(), bool), table.column("node").to_numpy(), table.column("label").to_numpy()
        bags = [unpack(x) for x in table.column("bag").to_pylist()]
        a, b = np.flatnonzero(seeks), np.flatnonzero(~seeks)
        names, label = np.unique(label, return_inverse=True)
        joined, out = np.arange(len(names)), []
        if len(a) and len(b):
            h, w = np.concatenate([bags[k][0] for k in b]), np.concatenate([bags[k][1] for k in b])
            of = np.repeat(np.arange(len(b)), [len(bags[k][0]) for k in b])
            order = np.argsort(h, kind="stable")
            h, w, of = h[order], w[order], of[order]
            total = np.array([bags[k][1].sum() for k in b])
            for k in a:
                x, wx = bags[k]
                lo, hi = np.searchsorted(h, x, "left"), np.searchsorted(h, x, "right")
                n = hi - lo
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                both = np.bincount(of[at], np.minimum(np.repeat(wx, n), w[at]), len(b))
                near = both >= similar * (wx.sum() + total - both)
                for j in b[near & (joined[label[b]] != joined[label[k]])]:
                    if joined[label[j]] != joined[label[k]]:
                        out.append((int(node[k]), int(node[j])))
                        joined[joined == joined[label[j]]] = joined[label[k]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return given.groupBy("key", "mi", "ni").applyInArrow(lambda key, t: compare(key, t), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, by rounds of least neighbouring label and label of label."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "least").alias("least"))
        jump = step.select(F.col("node").alias("to"), F.col("least").alias("further"))
        step = step.join(jump, step["least"] == jump["to"]).select("node", "label", F.least("least", "further").alias("new"))
        step = cut(step)
        if step.where("new <> label").isEmpty():
            return labels
        labels = step.select("node", F.col("new").alias("label"))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, node, k2, class_id, first): a row for each row of ``docs``; ``first`` is the key of the row that its class keeps."""
    nodes, labels = grouped(docs, similar)
    named = nodes.select("node", "k2", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    key = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "k2")).alias("first")
    lead = named.groupBy("label").agg(key)
    known = named.join(lead, "label").select(F.col("node").alias("n1"), F.col("k2").alias("n2"), "first")
    k1, k2 = doc_key()
    rows = docs.select("doc_id", k1.alias("node"), k2.alias("k2"))
    return rows.join(known, (F.col("node") == F.col("n1")) & (F.col("k2") == F.col("n2"))).select("doc_id", "node", "k2", F.col("first.doc_id").alias("class_id"), "first")


def deduplicate(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each class: that of its least doc_id, with all its columns."""
    nodes, labels = grouped(docs, similar)
    named = nodes.select("node", "k2", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "k2")).alias("first"))
    a, b, c = (unused(docs.columns, n) for n in ("k1", "k2", "nth"))
    want = first.select(F.col("first.doc_id").alias(f"{a}d"), F.col("first.node").alias(f"{a}n"), F.col("first.k2").alias(f"{b}n"))
    k1, k2 = doc_key()
    keyed = docs.withColumn(a, k1).withColumn(b, k2)
    kept = keyed.join(want, (keyed[a] == want[f"{a}n"]) & (keyed[b] == want[f"{b}n"]) & keyed["doc_id"].eqNullSafe(want[f"{a}d"]), "left_semi")
    one = kept.withColumn(c, F.row_number().over(Window.partitionBy(a, b, "doc_id").orderBy(*row_order(docs)))).where(F.col(c) == 1)
    return one.select(*[F.col(f"`{x}`") for x in docs.columns])
