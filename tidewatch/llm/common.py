"""What the operators of this subpackage share: tables, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words in the contracts: tab, line feed,
#: vertical tab, form feed, carriage return and space.
SPACES = " \t\n\x0b\f\r"
#: The same as a character class for Java and Python patterns.
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
#: Characters of text that a worker handles at a time; longer single texts go alone.
CHUNK_CHARS = 1 << 21
#: Bits of a table that says which digests may be in a set (1 MB). The rest of the digest is
#: compared by the join that follows, so the table only saves work.
MASK_BITS = 23
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: A-Z to a-z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: below ``spark.checkpoint.dir``, which all
    machines of a cluster share. Only where that is unset and Spark runs in one process is a
    temporary folder made; on a cluster the setting is required."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _dirs.setdefault("local", "file://" + tempfile.mkdtemp(prefix="tidewatch-"))
    return f"{base.rstrip('/')}/tidewatch-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: it cuts the lineage, is
    there for every executor and survives the loss of any. Deleted when the application ends.
    With ``by``, the last column, each of its values has a folder of its own."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def pieces(batch: pa.RecordBatch, texts: int | None = None, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes (or list elements) in its column ``texts`` each, one row at
    least; a batch of very long texts is so never worked on as one array."""
    column = batch.column(batch.num_columns - 1 if texts is None else texts)
    start = size = 0
    lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    for i, n in enumerate(lengths.to_pylist()):
        n = n or 0
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def give_back() -> None:
    """Returns memory that Arrow and the C library have free to the system; the latter where it can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after which what the task has freed goes back to the system: its worker
    stays beside the JVM while later stages run."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """``mapInArrow`` of ``work`` over slices of bounded size; the text is the last column."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, limit=limit):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidy(run), schema)


def _set_bits(df: DataFrame, column: str) -> DataFrame:
    """(w, bits): the word of 64 bits, and the bit in it, of each digest by its leading bits."""
    at = df.select(F.shiftrightunsigned(column, 64 - MASK_BITS).alias("i"))
    return at.select(F.shiftright("i", 6).alias("w"), F.expr("shiftleft(1L, cast(i & 63 as int))").alias("bits"))


def bits_of(df: DataFrame, column: str) -> DataFrame:
    """``mask_of`` as one row with an array of ``2 ** MASK_BITS / 64`` longs (1 MB), for a scalar subquery."""
    none = df.sparkSession.range(1 << (MASK_BITS - 6)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = _set_bits(df, column).unionByName(none).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("a")).select(F.col("a.bits").alias("bits"))


def in_bits(bits: str, digest: str) -> Column:
    """Whether the column ``bits`` (``bits_of``) has the bit of a digest."""
    return F.expr(f"shiftrightunsigned(get({bits}, cast(shiftrightunsigned({digest}, {70 - MASK_BITS}) AS INT)), cast(shiftrightunsigned({digest}, {64 - MASK_BITS}) & 63 AS INT)) & 1 = 1")


def mask_of(df: DataFrame, column: str) -> np.ndarray:
    """A table of bits by the digests' leading bits; at most ``2 ** MASK_BITS / 64`` rows reach
    the driver, however many digests there are."""
    rows = _set_bits(df, column).groupBy("w").agg(F.bit_or("bits").alias("bits")).collect()
    words = np.zeros(1 << (MASK_BITS - 6), np.uint64)
    for w, bits in rows:
        words[w] = bits % (1 << 64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)
