"""Exact top-k by inner product: a ball tree for each shard, branch and bound, the kth score shared between waves.

Vectors are dealt to cells by the nearest of a few pivots (a bounded, deterministic sample) and cells to shards of bounded size,
so a vector that a third of the rows share fills many shards and no single task. A shard's rows become a ball tree. A query
first searches the shard it would lie in itself; the kth score from there goes with it into the second wave, to those cells
whose ball may still hold a better one: centre times query plus radius times the query's length. In a tree, nodes are taken in
order of that bound for all queries of a block together, and a query leaves a node once the bound falls under its kth score.

Cases: vectors null, empty, or holding null or non-finite components take no part, nor do rows without an id; vectors of
different lengths never meet; a query's own id is no candidate; an id that repeats is a candidate for each row and one query, by its
vector of least hash; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, EVERY = 5, 50
PIVOTS, SHARD, LEAF, BLOCK = 64, 4096, 128, 2048
#: So many shards' balls are broadcast at most.
BALLS = 10_000
LOW = np.iinfo(np.int64).min


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part, each component x as floor(256 x)."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * 256)).alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def build(ids: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> list[tuple]:
    """Nodes (centre, radius, children or None, from, to) over rows in tree order, then the ordered ids and vectors."""
    f, order, nodes = v.astype(np.float64), np.arange(len(v)), []

    def grow(lo: int, hi: int) -> int:
        at = len(nodes)
        nodes.append(None)
        part = f[order[lo:hi]]
        centre = part.mean(axis=0)
        far = np.sqrt(((part - centre) ** 2).sum(axis=1))
        radius, children = float(far.max()), None
        if hi - lo > leaf and radius > 0:
            a = part[far.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            order[lo:hi] = order[lo:hi][np.argsort(part @ (b - a), kind="stable")]
            mid = (lo + hi) // 2
            children = grow(lo, mid), grow(mid, hi)
        nodes[at] = centre, radius * (1 + 1e-9) + 1e-6, children, lo, hi
        return at

    grow(0, len(v))
    return [nodes, ids[order], v[order]]


def scores_of(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats only where they are exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def search(tree: list, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of each query's k best in a tree that reach ``kth``, scores descending; LOW where there are fewer."""
    nodes, ids, v = tree
    n = len(qid)
    best, best_id = np.full((n, k), LOW), np.full((n, k), np.iinfo(np.int64).max)
    f, length = q.astype(np.float64), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        b = f[who] @ nodes[node][0] + length[who] * nodes[node][1]
        return b + 1e-9 * np.abs(b) + 1e-6

    def open_(node: int, who: np.ndarray) -> None:
        b = bound(node, who)
        alive = b >= kth[who]
        if alive.any():
            heapq.heappush(heap, (-float(b[alive].max()), node, who[alive], b[alive]))

    heap: list = []
    kth = kth.copy()
    open_(0, np.arange(n))
    while heap:
        _, node, who, b = heapq.heappop(heap)
        who = who[b >= kth[who]]
        if not len(who):
            continue
        _, _, children, lo, hi = nodes[node]
        if children:
            for child in children:
                open_(child, who)
            continue
        got = scores_of(q[who], v[lo:hi])
        got[ids[None, lo:hi] == qid[who][:, None]] = LOW
        better = got.max(axis=1) >= kth[who]
        who, got = who[better], got[better]
        if not len(who):
            continue
        all_s = np.concatenate([best[who], got], axis=1)
        all_i = np.concatenate([best_id[who], np.broadcast_to(ids[lo:hi], got.shape)], axis=1)
        first = np.lexsort((all_i, -np.maximum(all_s, LOW + 1)), axis=1)[:, :k]
        best[who], best_id[who] = np.take_along_axis(all_s, first, axis=1), np.take_along_axis(all_i, first, axis=1)
        kth[who] = np.maximum(kth[who], best[who, -1])
    return best_id, best


def _cells(pivots: dict[int, np.ndarray]):
    """The nearest pivot of the vector's length; one cell of its own for a length without pivot."""

    def run(batches):
        for b in batches:
            rows, out = b.column("v").to_pylist(), np.zeros(b.num_rows, np.int64)
            by_dim: dict[int, list[int]] = {}
            for k, r in enumerate(rows):
                by_dim.setdefault(len(r), []).append(k)
            for dim, at in by_dim.items():
                out[at] = -dim
                if dim in pivots:
                    p = pivots[dim]
                    for lo in range(0, len(at), 4096):
                        x = np.array([rows[k] for k in at[lo : lo + 4096]], np.float64)
                        out[at[lo : lo + 4096]] = dim * PIVOTS + ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "cell"])

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vector_col)
    sample: dict[int, list] = {}
    for r in rows.select("v", F.xxhash64("id", "v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(PIVOTS).collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    celled = rows.mapInArrow(_cells({d: np.array(p, np.float64) for d, p in sample.items()}), "id long, v array<long>, cell long")
    celled = cut(celled)
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / SHARD).cast("int")).select("cell", "salts")
    sizes = cut(sizes)
    n_queries = celled.where(F.col("id") % every == 0).count()
    blocks = max(1, -(-n_queries // BLOCK))
    salted = celled.join(F.broadcast(sizes), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))  # a row for each pivot and vector length

    def plant(key, table):
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v"))
        tree = build(ids, v)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "salt": pa.array([key[1].as_py()], pa.int32()), "centre": pa.array([tree[0][0][0].tolist()], pa.list_(pa.float64())), "radius": pa.array([tree[0][0][1]], pa.float64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = cut(salted.groupBy("cell", "salt").applyInArrow(plant, "cell long, salt int, centre array<double>, radius double, tree binary"))
    one = salted.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v", "cell", "salt")).alias("x"))
    queries = one.select(F.col("id").alias("q"), F.col("x.v").alias("qv"), "x.cell", "x.salt", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def hunt(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q, v, kth = right.column("q").to_numpy(), _matrix(right.column("qv")), right.column("kth").to_numpy()
        got, score = search(pickle.loads(left.column("tree")[0].as_py()), q, v, kth, k)
        real = score > LOW
        return pa.table({"q": np.repeat(q, real.sum(axis=1)), "id": got[real], "score": score[real]})

    def wave(asked: DataFrame) -> DataFrame:
        """Each tree goes only to the blocks of queries that ask for it."""
        asked = asked.select("q", "qv", "kth", *[F.col(c).alias(f"to_{c}") for c in ("cell", "salt", "block")])
        wanted = asked.select(F.col("to_cell").alias("cell"), F.col("to_salt").alias("salt"), F.col("to_block").alias("block")).distinct()
        planted = trees.select("cell", "salt", "tree").join(wanted, ["cell", "salt"])
        return planted.groupBy("cell", "salt", "block").cogroup(asked.groupBy("to_cell", "to_salt", "to_block")).applyInArrow(hunt, "q long, id long, score long")

    home = cut(wave(queries.withColumn("kth", F.lit(int(LOW)).cast("long"))))
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    kth = home.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("q", F.col("score").alias("kth"))
    knows = queries.withColumnsRenamed({"cell": "own", "salt": "own_salt"}).join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(int(LOW)).cast("long")))
    balls = trees.select("cell", "salt", "centre", "radius", F.size("centre").alias("cdim"))
    parts = -(-balls.count() // BALLS)
    balls = balls.withColumn("part", F.pmod(F.xxhash64("cell", "salt"), F.lit(max(parts, 1))).cast("int"))
    # BALLS rows are broadcast at most; more are joined part by part with the queries block by block
    balls = F.broadcast(balls) if parts <= 1 else balls.withColumn("to_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    knows = knows.withColumn("dim", F.size("qv")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))))
    length = F.sqrt(F.aggregate("qv", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with("qv", "centre", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    met = (F.col("dim") == F.col("cdim")) & (F.col("at") == F.col("part"))
    asked = knows.join(balls, met if parts <= 1 else met & (F.col("block") == F.col("to_block")))
    asked = asked.where((F.col("cell") != F.col("own")) | (F.col("salt") != F.col("own_salt"))).where((dot + length * F.col("radius")) * (1 + 1e-9) + 1 >= F.col("kth").cast("double")).select("q", "qv", "kth", "cell", "salt", "block")
    found = home.unionByName(wave(asked))
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    out = best.select(F.col("q").alias("query_id"), F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))
