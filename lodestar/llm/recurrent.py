"""Language-model scoring by a gated recurrent network in numpy, with a class-factored softmax over words.

Counts of all training words give the vocabulary and a unigram model. The network predicts the most frequent words, the end and
"another word"; which other word it is comes from the counts, so every text has a probability. It starts at the unigram
frequencies. Texts are split and looked up once; what travels further are the network's ids, two bytes a word.

Training is truncated backpropagation through windows of ``WINDOW`` words with the state carried over; each shard of about
``SHARD_WORDS`` words trains from the same parameters and the shards' results are averaged, weighted, over ``ROUNDS`` rounds. Each
training document is in exactly one round, so the network learns from all of them once. A shard is one stream of documents in
order of doc_id and words, cut into lanes of equal length, and sums are made in order of shards, so a rerun on another
partitioning gives the same model. Scoring carries the state through a document to its end, however long, many documents side by
side; memory follows the words at hand, not the longest text times the lanes.

What reaches every worker is bounded: the network, and the counts of at most ``HOT`` words; counts of rarer words are joined.
Words are known by 64-bit hashes.

Cases: a null or empty text is the end alone; a null doc_id is never held out; without training words all get the uniform
probability that the counts give; repeated rows are scored alike; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

WORDS, HIDDEN, CLASS = 4094, 16, 64
WINDOW, LANES = 16, 512
ROUNDS, SHARD_WORDS = 4, 2_000_000
HOT = 400_000
RATE = 1.6e-2
#: The network's share of a word's probability; the rest is the unigram's.
SHARE_NET = 0.9
#: Rows of scoring side by side, and rows of states that are turned into probabilities together.
SIDE, STATES = 1024, 16_384
COUNTED, BATCH = 1_000_000, 1000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


END_HASH = -(1 << 63)  # no word's in practice
_powers = np.ones(1, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


_VALUES = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _A)


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, mixed with its length; no word is empty."""
    global _powers
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw, size = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], np.diff(ends)
    if len(_powers) < size.max():
        _powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * int(size.max()), _C)))
    begin = ends[:-1] - ends[0]
    sums = np.add.reduceat(_VALUES[raw] * _powers[np.arange(len(raw)) - np.repeat(begin, size)], begin)
    return _mixed(sums + size.astype(np.uint64) * _A).view(np.int64)


def hash_of(word: str) -> int:
    return int(hashes_of(pc.ascii_lower(pa.array([word], pa.string())))[0])


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: how many words each has, which of the different words each is, and the hashes of these."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # its separators are space and the controls 9-13
    flat, edges = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    real = pc.greater(pc.binary_length(flat), 0)
    n = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[edges])
    coded = flat.filter(real).dictionary_encode()
    return n, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), hashes_of(coded.dictionary)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): the training words and the end; a task sends each word once for as long as it remembers it."""

    def run(batches):
        held, rows, ends = [], 0, 0

        def flush():
            h, back = np.unique(np.concatenate([x for x, _ in held] + [np.zeros(0, np.int64)]), return_inverse=True)
            c = np.bincount(back, np.concatenate([x for _, x in held] + [np.zeros(0)]), len(h)).astype(np.int64)
            if ends:
                h, c = np.append(h, END_HASH), np.append(c, ends)
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64())], ["h", "c"])

        for b in small(batches, BATCH):
            learnt = pa.array([not held_out(i) for i in b.column("doc_id").to_pylist()], pa.bool_())
            n, which, h = words_in(b.column("text").filter(learnt))
            ends += len(n)
            held.append((h, np.bincount(which, minlength=len(h))))
            rows += len(h)
            if rows > COUNTED:
                yield flush()
                held, rows, ends = [], 0, 0
        yield flush()

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Network:
    """A gated recurrent layer over words in order of frequency, and a softmax over classes of CLASS neighbours, then in the class."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        n, rng = len(counts), np.random.default_rng(seed)
        self.classes = -(-n // CLASS)
        p = (counts + 1) / (counts + 1).sum()
        padded = np.zeros(self.classes * CLASS)
        padded[:n] = p
        mass = padded.reshape(-1, CLASS).sum(axis=1)
        bias = np.log(np.maximum(padded, 1e-30)).reshape(-1, CLASS) - np.log(mass)[:, None]
        f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "inp": f(n, 3 * HIDDEN), "rec": f(HIDDEN, 3 * HIDDEN), "new": np.zeros(HIDDEN, np.float32),
            "cls": f(HIDDEN, self.classes) * np.float32(0.1), "cls_b": np.log(mass).astype(np.float32),
            "out": f(self.classes, HIDDEN, CLASS) * np.float32(0.1), "out_b": bias.astype(np.float32),
        }

    def step(self, h: np.ndarray, g: np.ndarray):
        """The next state after words with inputs ``g``, and what the way back needs."""
        a = h @ self.p["rec"]
        zr = g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        inner = a[:, 2 * HIDDEN :] + self.p["new"]
        new = np.tanh(g[:, 2 * HIDDEN :] + r * inner)
        return new + z * (h - new), (h, z, r, inner, new)

    def log_p(self, hs: np.ndarray, y: np.ndarray, back: dict | None = None):
        """Natural log probability of each word after each state; with ``back``, also the gradients of their negative sum."""
        p, c = self.p, (y // CLASS).astype(np.uint16)
        order = np.argsort(c, kind="stable")
        hs, c = hs[order], c[order]
        place = y[order] - c.astype(np.int64) * CLASS
        edges = np.searchsorted(c, np.arange(self.classes + 1))
        # exponents stay small: states lie within -1 and 1, and the largest bias is that of a probability
        e = hs @ p["cls"]
        e += p["cls_b"]
        np.minimum(e, 80, out=e)
        rows = np.arange(len(y))
        out = e[rows, c]
        np.exp(e, out=e)
        total = e.sum(axis=1)
        out -= np.log(total)
        d_h = None
        if back is not None:
            e /= total[:, None]
            e[rows, c] -= 1
            back["cls"], back["cls_b"] = hs.T @ e, e.sum(axis=0)
            d_h = e @ p["cls"].T
            back["out"], back["out_b"] = np.zeros_like(p["out"]), np.zeros_like(p["out_b"])
        for k in range(self.classes):
            part = slice(edges[k], edges[k + 1])
            n = part.stop - part.start
            if not n:
                continue
            hk, w, one = hs[part], place[part], rows[:n]
            e = hk @ p["out"][k]
            e += p["out_b"][k]
            np.minimum(e, 80, out=e)
            mine = e[one, w]
            np.exp(e, out=e)
            total = e.sum(axis=1)
            out[part] += mine - np.log(total)
            if back is not None:
                e /= total[:, None]
                e[one, w] -= 1
                back["out"][k], back["out_b"][k] = hk.T @ e, e.sum(axis=0)
                d_h[part] += e @ p["out"][k].T
        whole = np.empty_like(out)
        whole[order] = out
        if back is None:
            return whole, None
        d = np.empty_like(d_h)
        d[order] = d_h
        return whole, d

    def gradients(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray):
        """One window [time, lane]: the state after it, gradients, loss. The way back ends at the window's begin.

        Places where ``y`` is negative lie past a lane's end and count nothing.
        """
        saved, hs, inp = [], np.empty((*x.shape, HIDDEN), h.dtype), self.p["inp"]
        for t in range(len(x)):
            if fresh[t].any():
                h = h * ~fresh[t][:, None]
            h, more = self.step(h, inp[x[t]])
            saved.append(more)
            hs[t] = h
        grad: dict = {}
        real = y >= 0
        if real.all():
            logp, d_out = self.log_p(hs.reshape(-1, HIDDEN), y.ravel(), grad)
            d_out = d_out.reshape(hs.shape)
        else:
            logp, some = self.log_p(hs[real], y[real], grad)
            d_out = np.zeros_like(hs)
            d_out[real] = some
        rec, d_h, d_x = self.p["rec"], np.zeros_like(h), np.empty((*x.shape, 3 * HIDDEN), h.dtype)
        grad["rec"], grad["new"] = np.zeros_like(rec), np.zeros(HIDDEN, h.dtype)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, inner, new = saved[t]
            d = d_out[t] + d_h
            d_new = d * (1 - z)
            d_z = d_new * (before - new) * z
            d_new *= 1 - new * new
            d_r = d_new * inner * r * (1 - r)
            d_x[t, :, :HIDDEN], d_x[t, :, HIDDEN : 2 * HIDDEN], d_x[t, :, 2 * HIDDEN :] = d_z, d_r, d_new
            d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
            grad["rec"] += before.T @ d_a
            grad["new"] += d_a[:, 2 * HIDDEN :].sum(axis=0)
            d_h = d * z + d_a @ rec.T
            if fresh[t].any():
                d_h *= ~fresh[t][:, None]
        flat, g = x.ravel(), d_x.reshape(-1, 3 * HIDDEN)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        ranked = flat[order]
        at = np.flatnonzero(np.diff(ranked, prepend=-1))
        grad["inp"] = (ranked[at], np.add.reduceat(g[order], at, axis=0))
        return h, grad, -float(logp.sum())

    def train(self, ids: list[np.ndarray], end: int) -> int:
        """Adam over the documents as one stream in LANES equal parts; returns the words seen."""
        y = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        if not len(y):
            return 0
        begins = np.zeros(len(y), bool)
        begins[np.cumsum([0, *(len(d) for d in ids[:-1])])] = True
        x = np.where(begins, end, np.append(end, y[:-1]))
        lanes = int(max(1, min(LANES, len(y) // WINDOW)))
        rows = -(-len(y) // lanes)
        pad = rows * lanes - len(y)
        x, y, begins = (np.append(v, np.full(pad, fill, v.dtype)).reshape(lanes, rows).T for v, fill in ((x, end), (y, -1), (begins, False)))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        h = np.zeros((lanes, HIDDEN), np.float32)
        for step, t in enumerate(range(0, rows, WINDOW), 1):
            part = slice(t, t + WINDOW)
            h, grad, _ = self.gradients(h, x[part], y[part], begins[part])
            scale = np.float32(1 / max(1, int((y[part] >= 0).sum())))
            rate = np.float32(RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            which, g = grad.pop("inp")
            grad["inp"] = np.zeros_like(self.p["inp"])
            grad["inp"][which] = g
            for k, v in self.p.items():
                m, s = moments[k]
                g = grad[k]
                g *= scale
                m += np.float32(0.1) * (g - m)
                s += np.float32(0.001) * (g * g - s)
                v -= rate * m / (np.sqrt(s) + np.float32(1e-8))
        return sum(map(len, ids))

    def score(self, ids: list[np.ndarray], end: int, lanes: int = SIDE, window: int | None = None, within: np.ndarray | None = None, unigram: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each whole document.

        With ``within`` and ``unigram``, by word of the network: a word's probability is the network's times the first, mixed
        with the second.
        """
        out = np.zeros(len(ids))
        sizes = np.array([len(d) for d in ids], np.int64)
        if not sizes.sum():
            return out
        dealt = lanes_of(sizes.tolist(), lanes)
        order = np.concatenate([np.array(lane, np.int64) for lane in dealt])
        y, doc = np.concatenate([ids[k] for k in order]).astype(np.int64), np.repeat(order, sizes[order])
        begins = np.zeros(len(y) + 1, bool)
        begins[np.append(0, np.cumsum(sizes[order]))] = True
        begins = begins[:-1]
        x = np.where(begins, end, np.append(end, y[:-1]))
        length = np.array([sizes[lane].sum() for lane in dealt])
        at = np.append(0, np.cumsum(length))[:-1]
        h, t = np.zeros((len(dealt), HIDDEN), np.float32), 0
        while t < length[0]:
            w = window or max(16, STATES // int(np.searchsorted(-length, -t)))
            hs, places = [], []
            for u in range(t, min(t + w, int(length[0]))):
                here = at[: int(np.searchsorted(-length, -u))] + u  # lanes are in order of length
                h = h[: len(here)]
                new = begins[here]
                if new.any():
                    h = h * ~new[:, None]
                h, _ = self.step(h, self.p["inp"][x[here]])
                hs.append(h)
                places.append(here)
            t += w
            where = np.concatenate(places)
            logp, _ = self.log_p(np.concatenate(hs), y[where])
            if unigram is not None:
                logp = np.log(SHARE_NET * np.exp(logp.astype(np.float64)) * within[y[where]] + (1 - SHARE_NET) * unigram[y[where]])
            out += np.bincount(doc[where], logp, len(ids))
        return out


def lanes_of(sizes: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest lane first."""
    heap = [(0, k, []) for k in range(max(1, min(lanes, len(sizes))))]
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        n, at, docs = heap[0]
        docs.append(k)
        heapq.heapreplace(heap, (n + sizes[k], at, docs))
    return [docs for _, _, docs in sorted(heap, key=lambda x: (-x[0], x[1]))]


class Model:
    """The counts that travel, the totals and the network."""

    def __init__(self, counts: DataFrame):
        # the least count that leaves at most HOT words, from a histogram of a few hundred bins
        bins = counts.where(F.col("h") != END_HASH).groupBy(F.floor(F.log2("c") * 8).cast("int").alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("b")).collect()
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("h") == END_HASH, F.col("c"))), F.lit(0)).alias("ends")).collect()[0]
        self.total, self.distinct, ends = total["n"], total["v"], total["ends"]
        got, least = 0, None
        for r in bins:
            if got + r["n"] > HOT:
                break
            got, least = got + r["n"], r["c"]
        hot = counts.where((F.col("h") != END_HASH) & (F.col("c") >= F.lit(least))).toArrow() if least is not None else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        h, c = hot.column("h").to_numpy(), hot.column("c").to_numpy()
        top = np.lexsort((h, -c))[:WORDS]
        rest = int(self.total - ends - c[top].sum())
        weights = np.append(c[top], [rest, ends])
        order = np.argsort(-weights, kind="stable")  # the network's ids are ranks
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = np.full(len(h), rank[len(top)])
        ids[top] = rank[: len(top)]
        by_hash = np.argsort(h)
        self.hashes, self.counts, self.ids = h[by_hash], c[by_hash], ids[by_hash]
        self.other, self.end, self.ends = int(rank[len(top)]), int(rank[len(top) + 1]), ends
        self.others_total = rest + (self.distinct - (ends > 0) - len(top)) + 1  # words the network doesn't name, and one unseen
        self.network = Network(weights[order].astype(np.float64))
        # by word of the network: of "another word" the part that all such words share, their count and one comes later
        self.within = np.ones(len(order))
        self.within[self.other] = 1 / self.others_total
        self.unigram = (weights[order] + 1) / (self.total + self.distinct + 1)
        self.unigram[self.other] = 1 / (self.total + self.distinct + 1)

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: words in each; and for each word the network's id, the count (-1: too rare to be here), which, and its hash."""
        n, which, h = words_in(texts)
        c, ids = np.full(len(h), -1), np.full(len(h), self.other)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            c[hit], ids[hit] = self.counts[at[hit]], self.ids[at[hit]]
        return n, ids[which], c[which], which, h


ENCODED = "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, more double, rare_h array<long>, rare_n array<long>, ids binary"


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """Each row as the network's ids, two bytes a word, the end last, with what the counts at hand say of its words."""
    per_token = np.log10(model.total + model.distinct + 1)
    keep = {k: v for k, v in vars(model).items() if k != "network"}

    def run(batches):
        known, row = Model.__new__(Model), TaskContext.get().partitionId() << 40
        vars(known).update(keep)
        for b in small(batches, BATCH):
            docs_n = b.num_rows
            n, ids, c, which, h = known.split(b.column("text"))
            of, logs = np.repeat(np.arange(docs_n), n), np.log10(np.maximum(c, 0) + 1.0)
            total = lambda weights: np.bincount(of, weights, docs_n)  # noqa: E731, B023
            base = total(np.where(c >= 0, logs, 0.0)) + np.log10(known.ends + 1.0) - (n + 1) * per_token
            more = total(np.where((ids == known.other) & (c >= 0), logs, 0.0))
            seen = total(c > 0).astype(np.int64) + (known.ends > 0)
            rare, times = np.unique(of[c < 0] * max(1, len(h)) + which[c < 0], return_counts=True)
            edges = pa.array(np.searchsorted(rare // max(1, len(h)), np.arange(docs_n + 1)), pa.int32())
            flat = np.full(len(ids) + docs_n, known.end, np.uint16)
            flat[np.arange(len(ids)) + of] = ids
            ends = np.append(0, 2 * np.cumsum(n + 1)).astype(np.int32)
            names = b.column("doc_id").to_pylist()
            columns = [
                b.column("doc_id"), pa.array(np.arange(row, row + docs_n)), pa.array([held_out(i) for i in names], pa.bool_()), pa.array(n + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(more, pa.float64()),
                pa.ListArray.from_arrays(edges, pa.array(h[rare % max(1, len(h))], pa.int64())), pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())),
                pa.Array.from_buffers(pa.binary(), docs_n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())]),
            ]
            row += docs_n
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ENCODED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def _ids(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def _train_round(encoded: DataFrame, model: Model, number: int, shards: int) -> int:
    """Each shard trains from the model's parameters; their weighted mean becomes the model's. Returns the words learnt from."""
    start, end = pickle.dumps(model.network), model.end

    def run(key, table):
        network, names, ids = pickle.loads(start), table.column("doc_id").to_pylist(), _ids(table.column("ids"))
        order = sorted(range(len(ids)), key=lambda k: (names[k] is not None, names[k] or 0, ids[k].tobytes()))
        weight = network.train([ids[k] for k in order], end)
        flat = np.concatenate([network.p[k].ravel() for k in sorted(network.p)]).astype(np.float64) * weight
        cuts = range(0, len(flat), 4096)
        return pa.table({"part": pa.array(list(cuts), pa.int32()), "shard": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "weight": pa.array([float(weight)] * len(cuts)), "sums": pa.array([flat[k : k + 4096].astype(np.float32).tolist() for k in cuts], pa.list_(pa.float32()))})

    def add(key, table):
        rows = sorted(zip(table.column("shard").to_pylist(), table.column("weight").to_pylist(), table.column("sums").to_pylist(), strict=True), key=lambda r: r[0])
        sums = np.sum([np.array(r[2], np.float64) for r in rows], axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "weight": pa.array([float(sum(r[1] for r in rows))]), "sums": pa.array([sums.astype(np.float32).tolist()], pa.list_(pa.float32()))})

    schema = "part int, shard int, weight double, sums array<float>"
    chosen = encoded.where(~F.col("held_out")).where(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "ids"), F.lit(ROUNDS)) == number)
    dealt = chosen.select(F.pmod(F.xxhash64(F.lit("deal"), "doc_id", "ids"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "ids")
    each = dealt.groupBy("shard").applyInArrow(lambda key, t: run(key, t), schema)

    def less(each: DataFrame, into) -> DataFrame:
        return each.withColumn("into", into).groupBy("part", "into").applyInArrow(lambda key, t: add(key, t), schema)

    while shards > 64:  # a tree: 64 shards' parameters meet in a task at most
        shards = -(-shards // 64)
        each = less(each, F.floor(F.col("shard") / 64).cast("int"))
    rows = less(each, F.lit(0)).collect()  # the network, in parts
    if not rows:
        return 0
    flat, at = np.concatenate([np.array(r["sums"], np.float64) / r["weight"] for r in sorted(rows, key=lambda r: r["part"])]), 0
    for k in sorted(model.network.p):
        v = model.network.p[k]
        model.network.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return round(rows[0]["weight"])


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model learnt from documents that aren't held out, the counts of all their words, and ``docs`` encoded."""
    plain = docs.select("doc_id", "text")
    counts = cut(count_words(plain))
    model = Model(counts)
    encoded = cut(encode(plain, model))
    shards = int(max(1, round(model.total / ROUNDS / SHARD_WORDS)))
    for number in range(ROUNDS):
        _train_round(encoded, model, number, shards)
    return model, counts, encoded


def score(docs: DataFrame, model: Model, counts: DataFrame, encoded: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; ``encoded`` saves encoding again."""
    state = pickle.dumps((model.network, model.end, model.within, model.unigram))
    main = cut(encode(docs, model)) if encoded is None else encoded

    def run(batches):
        network, end, within, unigram = pickle.loads(state)
        for b in small(batches, 10_000):
            ids = _ids(b.column("ids"))
            log_p = network.score(ids, end, within=within, unigram=unigram) / np.log(10) + b.column("more").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(log_p, pa.float64())], [*b.schema.names[:-2], "log_p"])

    told = main.select("doc_id", "row", "held_out", "n_tokens", "n_known", "base", "more", "ids").mapInArrow(run, "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, log_p double")
    rare = main.select("row", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("x")).select("row", F.col("x.rare_h").alias("h"), F.col("x.rare_n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    added = rare.join(counts, "h", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + F.lit(1.0))).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    both = told.join(added, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("log_p") + logs).alias("score"))
