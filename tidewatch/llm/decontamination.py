"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of an item (all its words if it has fewer). It is a set of word
shingles that a document must contain wholly, so one shingle is a sufficient prefix: the rarest
by its count over all documents. A document's shingles are joined with these prefixes; the
position gives the one place where the window can stand, the length bounds rule out places before
the start and beyond the end, and the words there are compared.

The items are taken in blocks of bounded size, each one broadcast; documents go through the blocks
one after the other in one narrow chain, so a larger benchmark costs more passes and not memory.
"""

from __future__ import annotations


from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import LOWER, UPPER, pieces, table, tidy
from tidewatch.llm.words import SIGNS, Sums, Words

WINDOW, SHINGLE = 13, 3
#: A document is contaminated if 1 in so many of its words is hit.
SHARE = 20
#: Bytes of item texts in a block, about.
BLOCK_BYTES = 8 << 20


class Lookup:
    """Places of hashes in a sorted array; a bit table turns most of the others away first."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` and places in ``values``."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(self.values) or not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        same = self.values[place] == hashes[at]
        return at[same], place[same]


class Plain:
    """The words of ``Words`` in lower case with a space after each, as one byte string; equal runs of words are equal slices."""

    def __init__(self, words: Words) -> None:
        raw = np.frombuffer(words.data, np.uint8).copy()
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[words.starts], inside[words.ends] = 1, -1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        raw[words.ends], inside[words.ends] = 0x20, True
        self.data = raw[inside].tobytes().lower()
        self.at = np.zeros(len(words.starts) + 1, np.int32 if len(self.data) < 1 << 31 else np.int64)
        np.cumsum(words.ends - words.starts + 1, out=self.at[1:])

    def run(self, start: int, end: int) -> bytes:
        return self.data[self.at[start] : self.at[end]]


class Windows:
    """The distinct windows of a block of items and the shingles that they consist of.

    The items' words are held once; a window is a start and a length in them, and its items are a
    stretch of one array, so a block takes a few times its bytes. Windows are told apart by 64-bit
    hashes, and where these are equal by their words."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        items = sorted(items)
        words = Words([text for _, text in items], SIGNS)
        self.names, self.plain = [name for name, _ in items], Plain(words)
        first = words.first.astype(np.int64)
        n = np.diff(first)
        many = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
        owner = np.repeat(np.arange(len(items)), many)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
        size = np.minimum(n, WINDOW)[owner]
        hashes = Sums(words.hashes).of(start, start + size)
        order = np.lexsort((owner, hashes))
        owner, start, size, hashes = owner[order], start[order], size[order], hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for i in np.flatnonzero(~new).tolist():  # repeated windows only; unequal words are a window of their own
            new[i] = self.plain.run(start[i - 1], start[i - 1] + size[i - 1]) != self.plain.run(start[i], start[i] + size[i])
        self.start, self.size = start[new].astype(np.int32), size[new].astype(np.int8)
        self.owner, self.owned = owner.astype(np.int32), np.append(np.flatnonzero(new), len(order)).astype(np.int32)
        kinds = np.minimum(self.size, SHINGLE)
        self.sizes = np.unique(kinds).tolist()
        self.runs = {s: words.runs(s) for s in self.sizes}
        self.by_size = {s: Lookup(np.concatenate([self.runs[s][a : b - s + 1] for a, b in zip(first[:-1], first[1:], strict=True) if min(SHINGLE, b - a) == s])) for s in self.sizes}

    def choose(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Takes each window's rarest shingle as its prefix, by the ``counts`` of the sorted ``keys`` (others: 0); ties by hash."""
        prefix, place = np.zeros(len(self.start), np.uint64), np.zeros(len(self.start), np.int8)
        for s in self.sizes:
            mine = np.flatnonzero(np.minimum(self.size, SHINGLE) == s)
            best = np.full(len(mine), np.iinfo(np.int64).max)
            for i in range(WINDOW - s + 1):
                some = np.flatnonzero(i + s <= self.size[mine])
                at = mine[some]
                h = self.runs[s][self.start[at] + i]
                c = np.zeros(len(h), np.int64)
                if len(keys):
                    where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    c = np.where(keys[where] == h, counts[where], 0)
                less = (c < best[some]) | (c == best[some]) & (h < prefix[at])
                best[some[less]], prefix[at[less]], place[at[less]] = c[less], h[less], i
        self.place, self.by_prefix, self.groups = place, {}, {}
        for s in self.sizes:
            mine = np.flatnonzero(np.minimum(self.size, SHINGLE) == s)
            mine = mine[np.argsort(prefix[mine], kind="stable")]
            self.by_size[s] = Lookup(prefix[mine])
            self.by_prefix[s] = mine.astype(np.int32)
            self.groups[s] = np.append(np.searchsorted(prefix[mine], self.by_size[s].values), len(mine)).astype(np.int32)
        self.runs = {}

    def items_of(self, windows: set[int]) -> set[str]:
        return {self.names[i] for k in windows for i in self.owner[self.owned[k] : self.owned[k + 1]].tolist()}

    def hits(self, words: Words) -> dict[int, list[tuple[int, int, int]]]:
        """For each text that has any the (start, end, window) of all occurrences in it."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        plain = None
        for size in self.sizes:
            pos, place = self.by_size[size].find(words.runs(size))
            if not len(pos):
                continue
            plain = plain or Plain(words)
            texts = np.searchsorted(words.first, pos, "right") - 1
            edges = self.groups[size]
            for p, a, b, t in zip(pos.tolist(), edges[place].tolist(), edges[place + 1].tolist(), texts.tolist(), strict=True):
                first, last = int(words.first[t]), int(words.first[t + 1])
                for k in self.by_prefix[size][a:b].tolist():
                    start = p - int(self.place[k])
                    end, own = start + int(self.size[k]), int(self.start[k])
                    if start >= first and end <= last and plain.run(start, end) == self.plain.run(own, own + end - start):
                        out[t].append((start - first, end - first, k))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``limit`` bytes, collected one by one. Items without an id
    or text are none."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        yield [(r[0], r[1].encode()) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def shingle_counts(docs: DataFrame, lookups: dict[int, Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """The block's shingles that occur in documents, sorted, and how often each does in all of them; at
    most one row for each leaves a task and reaches the driver."""
    held = docs.sparkSession.sparkContext.broadcast(lookups)

    def run(batches):
        by_size = held.value
        counts = {size: np.zeros(len(x.values), np.int64) for size, x in by_size.items()}
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column(0).cast(pa.binary()).to_pylist(), SIGNS)
                for size, lookup in by_size.items():
                    pos, place = lookup.find(words.runs(size))
                    text = np.searchsorted(words.first, pos, "right") - 1
                    at, n = np.unique(place[pos + size <= words.first[text + 1]], return_counts=True)
                    counts[size][at] += n
        for size, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(by_size[size].values[some].view(np.int64)), pa.array(n[some])], names=["h", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, items: DataFrame, carried: list[str]) -> DataFrame:
    """A struct ``row`` of the ``carried`` columns of ``docs``, and of its text n_words, spans
    (merged, in words) and items."""
    # The text is the last column, by whose size batches are cut.
    df = docs.select(F.struct(*[docs[c] for c in carried]).alias("row"), F.lit(0).cast("long").alias("n_words"), F.array().cast(_FOUND["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items"), docs["text"].cast("string").alias("text"))
    schema = df.schema
    for block in blocks(items):
        windows = Windows(block)
        windows.choose(*shingle_counts(docs, windows.by_size))
        held = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches, held=held):
            w = held.value
            for batch in batches:
                for part in pieces(batch):
                    words = Words(part.column(4).cast(pa.binary()).to_pylist(), SIGNS)
                    n, spans, found = np.diff(words.first), part.column(2).to_pylist(), part.column(3).to_pylist()
                    for i, hits in w.hits(words).items():
                        merge = merged([*((x["start"], x["end"]) for x in spans[i]), *((a, b) for a, b, _ in hits)])
                        spans[i] = [{"start": a, "end": b} for a, b in merge]
                        found[i] = sorted({*found[i], *w.items_of({k for _, _, k in hits})})
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.string())), part.column(4)], names=["row", "n_words", "spans", "items", "text"])

        df = df.mapInArrow(tidy(run), schema)
    return df.drop("text")


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text) against all ``items`` (item_id, text).

    A word is hit if it stands in any occurrence of a window; contaminated: some word is hit and
    1 in ``SHARE`` words at least. Nulls: a null text has no words, a null doc_id is carried
    along, an item without id or text is passed over. Repeated documents are judged one by one,
    repeated items count once. Without documents the result is empty, without items nothing is
    hit. Ties in rarity go by hash and do not change the result. Other columns are not read.
    """
    found = find(docs, items, ["doc_id"])
    hit = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    found = find(docs, items, docs.columns)
    hit = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.where((hit == 0) | (SHARE * hit < F.col("n_words"))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[k + 1 : k + least(13, len(w))], ' ') AS win
  FROM i, unnest(range(0, greatest(len(w) - 12, 1))) t(k) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, k, size, array_to_string(w[k + 1 : k + size], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM iw) s, unnest(range(0, len(w) - size + 1)) t(k)),
h AS (SELECT r, k, size, item_id FROM dw JOIN iw USING (size, win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM h, unnest(range(k, k + size)) t(p) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""
QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLE_SQL = {"op5_benchmark_decontamination": ORACLE}
