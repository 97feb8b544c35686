"""What the operators share: reading tables, passing rows through Python in Arrow batches, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space and the ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch on its way to Python, where the session has not set its own: long texts make rows uneven.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "67108864"):
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode one of our own if it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestar-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept in the shared folder, removed when nothing refers to it."""
    sc = df.sparkSession.sparkContext
    where = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, smaller there than a checkpoint, for as long as the block runs."""
    spark, where = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(where)
        yield spark.read.schema(df.schema).parquet(where)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(taken: Iterable[str], name: str) -> str:
    """A column name that no column has, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def add_columns(df: DataFrame, read: list[str], make: Callable[[], Callable[..., list]], fields: list[tuple[str, T.DataType]], keep: list[str] | None = None) -> DataFrame:
    """``df[keep]`` with new columns. ``make()`` runs once a task and returns f(*lists of the columns read) -> lists of new values.

    Rows keep their place; columns that clash with a new name are replaced.
    """
    bound_batches(df.sparkSession)
    new = {n.lower() for n, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    only = [c for c in read if c not in keep]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    types = [_arrow(t) for _, t in fields]
    names = [*keep, *(n for n, _ in fields)]

    def run(batches):
        step = make()
        for b in small(batches, holding=True):
            got = step(*(b.column(c).to_pylist() for c in read))
            arrays = [b.column(c) for c in keep] + [pa.array(v, t) for v, t in zip(got, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(*keep, *only).mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def tidy() -> None:
    """Gives memory that earlier tasks of a worker process freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker process keeps between tasks: the tables of one operator at most.
_held: dict = {}


def hold(key: tuple, make: Callable[[], object]) -> object:
    """The object that this worker process made for ``key``; making one lets go of any other."""
    if key not in _held:
        _held.clear()
        tidy()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of what another operator's tasks left in this worker process."""
    if _held:
        _held.clear()
    tidy()


def small(batches: Iterable[pa.RecordBatch], rows: int = 500, holding: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most, so Python objects are made for a few at a time."""
    if not holding:
        release()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    tidy()


def doc_key(text: str = "text") -> list:
    """Two 64-bit hashes of a text; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit("#"), t)]


#: In how many parts rows of one key are counted and joined, so no key's rows meet in one task.
SALTS = 32


def told(rows: DataFrame, key: list[str], by: list[str], least: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows whose ``key`` others have too, with ``n``, how many have it, and ``first``, the least ``least`` of them.

    A key's rows are dealt to SALTS parts by ``by``; parts are counted, the counts summed, and the sums sent back to the parts,
    so a key that a third of all rows hold is spread over as many tasks. ``rows`` are read twice: ``cut`` what is dear to compute.
    ``how``: an inner join, or a left one to keep all rows.
    """
    salt = unused(rows.columns, "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    also = [F.min(least).alias("first")] if least is not None else []
    parts = dealt.groupBy(*key, salt).agg(F.count("*").alias("n"), *also)
    again = [F.min("first").alias("first")] if least is not None else []
    sums = parts.groupBy(*key).agg(F.sum("n").alias("n"), *again, F.collect_list(salt).alias("salts")).where("n > 1")
    back = sums.select(*key, F.explode("salts").alias(salt), "n", *["first"] * (least is not None))
    return dealt.join(back, [*key, salt], how).drop(salt)


def row_order(df: DataFrame) -> list[Column]:
    """An order of rows by all that they hold, so that which of several rows is the first does not depend on where they lie."""
    return [F.xxhash64(*[F.map_entries(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields])]
