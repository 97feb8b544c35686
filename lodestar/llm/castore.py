"""Content-addressed store of token-id streams.

A store is a folder of three Parquet datasets that Spark writes:

- ``objects/kind=chunk``: each distinct chunk once, under the BLAKE2b-128 of its ids; ``objects/kind=ref``: which chunk stands
  where in which document;
- ``recipes``: for each document in ascending order its chunks, its leaf (the hash over their addresses) and its start;
- ``manifest``: the Merkle root of the leaves of each part of the recipes, and over these the root of all.

A rolling hash over ``WINDOW`` ids cuts the streams, so an insertion moves no cut but those near it and equal passages yield
equal chunks. Reading takes chunks from the files, checks them against their address and the leaves against the manifest, and
composes each document's CRC from its chunks' CRCs, so no payload is shuffled again and a chunk that a third of the documents
share is read once.

Cases: a null or empty text is the end id alone; repeated rows are documents of their own with the same recipe; an empty table
gives an empty store; null ids come first; columns other than doc_id and text are not stored.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, shared_dir, small
from .pieces import LETTERS, SPACES, Recent, narrow

WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 4096
MEMO, PIECES = 250_000, 250_000
#: Fixed value: how byte-level tokenizers of this format cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 2
#: Marks that stand alone behind a word, as a class and plainly; letters plainly; what sends a text to the library whole: other
#: characters, white space side by side or at an end, and the sign that stands for a text's begin.
MARKS = r",.;:!?%&$#*()|"
MARKS_PLAIN, FIRST = ",.;:!?%&$#*()|", "\x02"
LETTERS_PLAIN = "".join(c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c))
ODD = f"[^\\x{{00}}-\\x{{ff}}]|[{SPACES}\x1c-\x1f][{SPACES}\x1c-\x1f]|^[{SPACES}\x1c-\x1f]|[{SPACES}\x1c-\x1f]$|{FIRST}"


class Encoder:
    """The tokenizers library, piece by piece where the cuts are certain; what pieces that were met became is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.kind, self.code = ("<u2", "H") if self.library.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        with open(path, "rb") as f:
            setup = json.load(f)
        # the same model over words that are spelled in the vocabulary's letters already, so nothing is left to cut or to spell
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {ord(c): spell(c)[0][0] for c in " \n" + LETTERS_PLAIN}
        self.mark = self.library.token_to_id(self.spelled[ord("\n")])
        before = setup["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not setup.get("normalizer") and self.mark is not None
        self.split = narrow(PATTERN).findall if plain else None
        # texts that spell a token which the library looks for before it cuts go to it whole
        self.odd = "|".join([ODD, *(re.escape(t["content"]) for t in setup.get("added_tokens") or [])])
        self.kept = Recent(PIECES)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(pieces), 5000):
            out += [array(self.code, got.ids).tobytes() for got in self.library.encode_batch_fast(pieces[at : at + 5000], add_special_tokens=False)]
        return out

    def _stems(self, stems: list[str]) -> pa.Array:
        """Words of letters, each behind a space but for FIRST: many to a call, between them a line break, which is a token of its own."""
        between, parts, sizes = f" {self.spelled[ord(chr(10))]} ", [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        space = self.spelled[32]
        words = [w[1:] if w[0] == FIRST else space + w for w in " ".join(["", *stems]).translate(self.spelled).split(space)[1:]]
        for at in range(0, len(words), 5000):
            groups = [words[k : k + 500] for k in range(at, min(at + 5000, len(words)), 500)]
            for got in self.words.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False):
                ids = np.array(got.ids, self.kind)
                edges = np.flatnonzero(ids == self.mark)
                sizes.append(np.diff(np.concatenate([[-1], edges, [len(ids)]])) - 1)
                parts.append(ids[ids != self.mark])
        flat, ends = np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))
        return pa.Array.from_buffers(pa.binary(), len(stems), [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])

    def _words(self, words: list[str]) -> list[bytes]:
        """Stretches between single spaces, each with the space before it; FIRST stands for none."""
        cut = [self.split(w[1:] if w[0] == FIRST else f" {w}") for w in words]
        got, at, out = self.kept.all([p for part in cut for p in part], self._encode), 0, []
        for part in cut:
            out.append(b"".join(got[at : at + len(part)]))
            at += len(part)
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts of single spaces and the first 256 code points: split and looked up as columns, only what differs in Python.

        Most words are letters and then marks; their ids are those of the letters and those of the marks.
        """
        # a line break, which no white space is beside here, is a word of its own, and the next one has no space before it
        lines = pc.replace_substring(texts, "\n", f" {FIRST}\n {FIRST}")
        listed = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(FIRST), lines, ""), " ")
        coded = listed.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        simple = pc.match_substring_regex(words, f"^{FIRST}?[{LETTERS}]+[{MARKS}]*$")
        easy, hard = words.filter(simple), words.filter(pc.invert(simple))
        stems = pc.utf8_rtrim(easy, characters=MARKS_PLAIN).dictionary_encode()
        tails = pc.utf8_ltrim(easy, characters=FIRST + LETTERS_PLAIN).dictionary_encode()
        of_stem = self._stems(stems.dictionary.to_pylist())
        of_tail = pa.array(self.kept.all(tails.dictionary.to_pylist(), self._encode), pa.binary())
        of_easy = pc.binary_join_element_wise(of_stem.take(stems.indices), of_tail.take(tails.indices), b"")
        both = pa.concat_arrays([of_easy, pa.array(self._words(hard.to_pylist()), pa.binary())])
        where = np.empty(len(words), np.int64)
        mask = simple.to_numpy(zero_copy_only=False)
        where[mask], where[~mask] = np.arange(len(easy)), len(easy) + np.arange(len(hard))
        sizes = pc.binary_length(both).to_numpy()[where[at]]
        flat = both.take(pa.array(where[at]))
        data = np.frombuffer(flat.buffers()[2], np.uint8, int(sizes.sum())).view(self.kind) if len(sizes) else np.zeros(0, self.kind)
        ends = np.concatenate([[0], np.cumsum(sizes)])[listed.offsets.to_numpy()] // np.dtype(self.kind).itemsize
        return data, ends

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.split else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        calm = np.flatnonzero(~odd)
        if len(calm):
            data, ends = self._plain(texts.take(pa.array(calm)))
            for j, k in enumerate(calm.tolist()):
                out[k] = data[ends[j] : ends[j + 1]]
        rest = np.flatnonzero(odd).tolist()
        for k, got in zip(rest, self._encode(texts.take(pa.array(rest, pa.int64())).to_pylist()), strict=True):
            out[k] = np.frombuffer(got, self.kind)
        return out


def encoder_of(path: str) -> Encoder:
    gc.set_threshold(200_000, 50, 1000)  # its tables hold no cycles
    return hold(("castore", path), lambda: Encoder(path))


def marks(ids: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Places behind which the rolling hash of the last WINDOW ids has zeros."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, step = 0xBF58476D1CE4E5B9, 1
    while step < WINDOW:
        if len(h) > step:
            moved = h[:-step] * np.uint64(base)
            h[step:] += moved
        base, step = base * base & (1 << 64) - 1, 2 * step
    return np.flatnonzero(h >> np.uint64(40) & np.uint64(mean - 1) == 0) + 1


def cuts(places: list[int], n: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Where chunks of ``n`` ids end: at marks, no chunk under ``least`` or over ``most``.

    ``least`` is over WINDOW, so no mark that depends on what stands before the document is ever taken.
    """
    ends, last = [], 0
    for at in places:
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            last = at
            ends.append(at)
    while n - last > most:
        last += most
        ends.append(last)
    return ends if last == n else [*ends, n]


def address(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def _emit(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Rows of both kinds. A task sends a payload once for as long as it remembers having sent it."""

    def run(batches):
        encoder, sent, row = encoder_of(path), set(), TaskContext.get().partitionId() << 40
        for b in small(batches, 4000, holding=True):
            out = {k: [] for k in ("kind", "address", "doc_id", "row", "seq", "n", "payload")}
            stop, parts = np.array([end], encoder.kind), []
            for ids in encoder.batch(b.column("text")):
                parts += ids, stop
            flat = np.concatenate([*parts, np.zeros(0, encoder.kind)])
            begins = np.cumsum([0] + [len(ids) + 1 for ids in parts[::2]])
            places = marks(flat)
            of = np.searchsorted(places, begins, "right")
            for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                begin, last, row = int(begins[k]), 0, row + 1
                ids = flat[begin : begins[k + 1]]
                for seq, to in enumerate(cuts((places[of[k] : of[k + 1]] - begin).tolist(), len(ids))):
                    chunk, last = ids[last:to], to
                    name = address(chunk)
                    rows = [("ref", name, doc_id, row, seq, len(chunk), None)]
                    if name not in sent:
                        if len(sent) > MEMO:
                            sent.clear()
                        sent.add(name)
                        rows.append(("chunk", name, None, None, None, len(chunk), chunk.tobytes()))
                    for r in rows:
                        for k, v in zip(out, r, strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], list(out))

    return docs.select("doc_id", "text").mapInArrow(run, "kind string, address binary, doc_id long, row long, seq int, n int, payload binary")


def _once(batches):
    """Drops a chunk that its partition, which holds all of its address, has had."""
    had = set()
    for b in batches:
        keep = []
        for kind, name in zip(b.column("kind").to_pylist(), b.column("address").to_pylist(), strict=True):
            keep.append(kind == "ref" or name not in had)
            if kind == "chunk":
                had.add(name)
        yield b.filter(pa.array(keep, pa.bool_()))


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd one moves up."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _roots(df: DataFrame) -> DataFrame:
    """(part, root) of the leaves of each part, in order of ``at``. Parts are single partitions of the recipes' files.

    Trees are built as leaves come: a stack of whole subtrees, so memory is logarithmic in a part's documents.
    """

    def top(stack: list[tuple[int, bytes]]) -> bytes:
        out = stack.pop()[1]
        while stack:
            out = hashlib.sha256(stack.pop()[1] + out).digest()
        return out

    def run(batches):
        now, stack = None, []
        for b in batches:
            done: list[tuple[int, bytes]] = []
            for part, leaf in zip(b.column("part").to_pylist(), b.column("leaf").to_pylist(), strict=True):
                if part != now and stack:
                    done.append((now, top(stack)))
                now, height = part, 0
                while stack and stack[-1][0] == height:
                    leaf, height = hashlib.sha256(stack.pop()[1] + leaf).digest(), height + 1
                stack.append((height, leaf))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.int32()), pa.array([r for _, r in done], pa.binary())], ["part", "root"])
        if stack:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([top(stack)], pa.binary())], ["part", "root"])

    return df.select("part", "at", "leaf").repartition("part").sortWithinPartitions("part", "at").mapInArrow(run, "part int, root binary")


def _leaf() -> Column:
    """A recipe's leaf: the hash over its document's id and its chunks' addresses."""
    return F.unhex(F.sha2(F.concat_ws("", F.col("doc_id").cast("string"), F.transform("chunks", lambda c: F.hex(c["address"]))), 256))


def write_store(docs: DataFrame, tokenizer: str, where: str, end: int = END) -> str:
    """Encodes, cuts and writes; returns the Merkle root in hexadecimal. Three jobs, each from files of the one before."""
    spark = docs.sparkSession
    key = F.when(F.col("kind") == "chunk", F.xxhash64("address")).otherwise(F.xxhash64("doc_id", "row"))
    objects = _emit(docs, tokenizer, end).withColumn("to", key).repartition("to").drop("to").mapInArrow(_once, "kind string, address binary, doc_id long, row long, seq int, n int, payload binary")
    objects.write.partitionBy("kind").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(f"{where}/objects")
    refs = spark.read.schema("address binary, doc_id long, row long, seq int, n int, payload binary, kind string").parquet(f"{where}/objects").where("kind = 'ref'")
    list_of = F.sort_array(F.collect_list(F.struct("seq", "address", "n")))
    recipes = refs.groupBy("doc_id", "row").agg(list_of.alias("chunks")).withColumn("leaf", _leaf())
    recipes = recipes.withColumn("n_tokens", F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["n"]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "leaf", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "leaf", "row")
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged.write.option("compression", "zstd").parquet(f"{where}/recipes")
    back = spark.read.schema("doc_id long, row long, chunks array<struct<seq:int,address:binary,n:int>>, leaf binary, n_tokens long, part int, at long").parquet(f"{where}/recipes")
    sums = back.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("documents"))
    tops = sums.join(_roots(back), "part").orderBy("part").collect()  # one row for each part
    start, rows = 0, []
    for r in tops:
        rows.append((r["part"], start, r["n_tokens"], r["documents"], bytes(r["root"])))
        start += r["n_tokens"]
    spark.createDataFrame(rows, "part int, start long, n_tokens long, documents long, root binary").coalesce(1).write.parquet(f"{where}/manifest")
    return merkle([r[4] for r in rows]).hex()


#: x^(8 * 4 * k) modulo the CRC polynomial, for composing CRCs of chunks of k ids.
POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product modulo the polynomial, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLY if b & 1 else 0)
    return out


@functools.lru_cache(1 << 14)
def _shift(n_bytes: int) -> int:
    square, out = 1 << 23, 1 << 31  # x^8 and 1
    while n_bytes:
        if n_bytes & 1:
            out = _times(out, square)
        square, n_bytes = _times(square, square), n_bytes >> 1
    return out


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two strings in a row, from theirs."""
    return _times(_shift(second_bytes), first) ^ second


def read_store(spark: SparkSession, where: str, root: str, tokenizer_kind: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; fails if a file disagrees with its address."""
    manifest = spark.read.schema("part int, start long, n_tokens long, documents long, root binary").parquet(f"{where}/manifest").orderBy("part").collect()
    recipes = spark.read.schema("doc_id long, row long, chunks array<struct<seq:int,address:binary,n:int>>, leaf binary, n_tokens long, part int, at long").parquet(f"{where}/recipes")
    now = {r["part"]: bytes(r["root"]) for r in _roots(recipes.withColumn("leaf", _leaf())).collect()}  # one row for each part; leaves as the chunk lists give them
    if now != {r["part"]: bytes(r["root"]) for r in manifest} or merkle([bytes(r["root"]) for r in manifest]).hex() != root:
        raise ValueError(f"the recipes in {where} don't match the manifest")

    def check(batches):
        for b in batches:
            crcs, sizes, names = [], [], b.column("address")
            for name, payload in zip(names.to_pylist(), b.column("payload").to_pylist(), strict=True):
                ids = np.frombuffer(payload, tokenizer_kind)
                if address(ids) != name:
                    raise ValueError(f"chunk {name.hex()} has other content")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([names, pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], ["address", "n", "crc"])

    chunks = spark.read.schema("address binary, n int, payload binary, kind string").parquet(f"{where}/objects").where("kind = 'chunk'").select("address", "payload").mapInArrow(check, "address binary, n int, crc long")
    refs = recipes.select("part", "at", F.explode("chunks").alias("c")).select("part", "at", "c.seq", "c.address")
    joined = refs.join(chunks, "address", "left").groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc"))).alias("c"), F.count("*").alias("want"), F.count("crc").alias("got"))

    def compose(batches):
        for b in batches:
            crcs, sizes = [], []
            for chunks, want, got in zip(b.column("c").to_pylist(), b.column("want").to_pylist(), b.column("got").to_pylist(), strict=True):
                if want != got:
                    raise ValueError("a recipe names a chunk that isn't stored")
                crc, n = 0, 0
                for c in chunks:
                    crc, n = crc_join(crc, c["crc"], 4 * c["n"]), n + c["n"]
                crcs.append(crc)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("at"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["part", "at", "n_tokens", "ids_crc32"])

    read = joined.mapInArrow(compose, "part int, at long, n_tokens long, ids_crc32 long")
    before = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spark.createDataFrame([(r["part"], r["start"]) for r in manifest], "part int, begin long")
    whole = recipes.select("part", "at", "doc_id").join(read, ["part", "at"])
    placed = whole.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(F.broadcast(offsets), "part")  # a row for each part
    return placed.select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def store_documents(docs: DataFrame, tokenizer: str) -> tuple[str, str]:
    """Writes the documents to a new store in the shared folder; its path and root."""
    where = f"{shared_dir(docs.sparkSession).rstrip('/')}/castore-{uuid.uuid4().hex}"
    return where, write_store(docs, tokenizer, where)
