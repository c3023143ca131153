"""Repeated passages by content-defined chunks.

A gear hash rolls over a text's bytes, runs of white space counting as one space; where its upper bits are zero a chunk ends. A bound depends
on the 16 bytes before it only, so equal passages have equal bounds from there on, whatever was
inserted before them. From each bound the next chunks up to the least length of a passage make one
variable chunk, and these are compared by digest. So a digest that several documents have is a
whole passage in each of them, and nothing is put together from different sources: overlapping
ones make a longer passage only where the same other document has them at the same distance.

Digests are counted by partial aggregation, and what is repeated is joined back to the chunks, so
a chunk that a third of all documents have is neither gathered nor counted in one task alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, keep, pieces, table

#: A bound stands at one byte in 2 ** BITS on average; a chunk has at most ``LONGEST`` bytes.
BITS, LONGEST = 5, 4096
#: Least length of a reported passage in code points, from one bound to another.
LEAST = 100
_BLANK = bytes.maketrans(SPACES.encode(), b" " * len(SPACES))
_GEAR = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([b]), seed=7) for b in range(256)), np.uint64).astype(np.uint16)


def bounds(data: np.ndarray) -> np.ndarray:
    """The ends of the chunks of a text's bytes. ``h = (h << 1) + gear[byte]`` in 16 bits is a sum
    over the last 16 bytes; four doublings make it for all bytes at once."""
    n = len(data)
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        if n > step:
            h[step:] += h[:-step].copy() << np.uint16(step)
    ends = np.flatnonzero((h >> np.uint16(16 - BITS)) == 0) + 1
    # A bound must not fall inside a code point.
    ends = ends[ends < n]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max(initial=0) > LONGEST:  # runs without a bound
        cut, last = [], 0
        for e in ends.tolist():
            while e - last > LONGEST:
                at = last + LONGEST
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                cut.append(at)
                last = at
            cut.append(e)
            last = e
        ends = np.array(cut)
    return ends


def one_spaced(text: bytes) -> tuple[bytes, np.ndarray]:
    """The text with each run of white space as one space, and for each byte of that the number
    of the text's code points up to it."""
    data = np.frombuffer(text.translate(_BLANK), np.uint8)
    blank = data == 32
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    kept[0] = True
    return data[kept].tobytes(), np.cumsum((data & 0xC0) != 0x80)[kept]


CHUNKS = "digest long, doc_id long, start int, end int"


def spans_of(plain: bytes, place: np.ndarray, least: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Digests, starts and ends (code points) of the variable chunks of ``least`` code points or more;
    the ends of those that the text had before are negative."""
    e = bounds(np.frombuffer(plain, np.uint8))
    s = np.concatenate([[0], e[:-1]])
    ends = place[e - 1]
    starts = np.concatenate([[0], ends[:-1]])
    upto = np.searchsorted(ends, starts + least)
    some = np.flatnonzero(upto < len(e))
    upto = upto[some]
    digests = [xxhash.xxh3_64_intdigest(plain[a:b]) for a, b in zip(s[some].tolist(), e[upto].tolist(), strict=True)]
    if not digests:
        return digests, some, some
    again = np.ones(len(digests), bool)
    again[np.unique(np.array(digests, np.uint64), return_index=True)[1]] = False
    return digests, starts[some], np.where(again, -ends[upto], ends[upto])


def chunks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, doc_id, start, end) of the variable chunks of all texts, in code points."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                ids, digests, spans = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if text and doc_id is not None:
                        found, *span = spans_of(*one_spaced(text), least)
                        digests += found
                        ids.append(np.full(len(found), doc_id))
                        spans.append(np.array(span, np.int32))
                if digests:
                    cols = [pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64)), *map(pa.array, np.concatenate(spans, axis=1))]
                    yield pa.RecordBatch.from_arrays(cols, names=["digest", "doc_id", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNKS)


def repeated_chunks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end, other, shift): the chunks that two documents or more have, with the smallest
    doc_id among these (in that document itself: the largest), and how far its place is from that in ``other``."""
    cut = keep(chunks(docs, least), "chunks")
    own = F.when(F.col("end") > 0, F.col("doc_id"))
    shared = cut.groupBy("digest").agg(F.min(own).alias("first"), F.min_by("start", own).alias("first_at"), F.max(own).alias("last"), F.max_by("start", own).alias("last_at"))
    found = cut.join(shared.where("first < last"), "digest")
    is_first = F.col("doc_id") == F.col("first")
    other, at = F.when(is_first, F.col("last")).otherwise(F.col("first")), F.when(is_first, F.col("last_at")).otherwise(F.col("first_at"))
    return found.select("doc_id", "start", F.abs("end").alias("end"), other.alias("other"), (F.col("start") - at).alias("shift")).distinct()


def runs_of(found: DataFrame, by: list[str]) -> DataFrame:
    """(doc_id, *by, start, end): the unions of chunks that overlap and agree in the columns ``by``."""
    before = W.partitionBy("doc_id", *by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    marked = found.withColumn("new", F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1)))
    so_far = W.partitionBy("doc_id", *by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = marked.withColumn("run", F.sum("new").over(so_far)).groupBy("doc_id", *by, "run").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    return runs.drop("run")


def passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end, n_chars, first_doc_id, is_first, other_doc_id): the passages of ``docs``
    (doc_id, text) that other documents have too.

    A passage runs from one bound to another, has ``least`` code points or more and stands whole,
    white space aside, in the document ``other_doc_id``: the smallest doc_id that has it, or
    where that is this document (``is_first``) the largest. Passages of one document with
    different others can overlap; of the same two they do not, unless their distance changes (white space,
    repeats). What only one document repeats is not reported. Nulls: a null or empty text has no
    chunk, rows without a doc_id are passed over. Rows with an equal doc_id are one document;
    repeated rows report a passage once. Without documents the result is empty. Other columns
    are not read.
    """
    out = runs_of(repeated_chunks(docs, least), ["other", "shift"])
    first = F.least("doc_id", "other")
    return out.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_chars"), first.alias("first_doc_id"), (first == F.col("doc_id")).alias("is_first"), F.col("other").alias("other_doc_id")).distinct()


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the passages that a document with a smaller doc_id has: the earliest
    document keeps a passage. Rows without a doc_id or text stay as they are."""
    later = repeated_chunks(docs, least).where(F.col("other") < F.col("doc_id")).select("doc_id", "start", "end").distinct()
    cuts = runs_of(later, []).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    text, spans = F.col("text"), F.col("_cuts")
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    kept = F.transform(spans, lambda s, i: F.substring(text, (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")))
    tail = F.substring(text, (F.element_at(spans, -1)["end"] + 1).cast("int"), F.length(text))
    joined = docs.join(cuts, "doc_id", "left")
    return joined.withColumn("text", F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))).select(*docs.columns)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL: dict = {}
