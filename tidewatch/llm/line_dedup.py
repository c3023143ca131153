"""Near-duplicate lines by deletion neighbourhoods over words.

Two lines are the same if one word replaced, added or taken away makes them equal (edit distance
at most 1, over words). Each line emits hashed keys: itself, and itself without each of its words,
once with and once without the word's position. Lines that differ in one place's word have the
variant of that place in common, a line with a word more has a variant that is the other line.
So equal keys join what is within the bound and nothing else; the edit distance is then computed.

Variants are as many as words, so a line emits them only where it can have a partner: one edit leaves
the first or the second half of the shorter line as it is. Lines that share neither half with
another line go no further, and the others emit the variants of words outside the shared half only.
Keys lead from each line to the earliest one in its group only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, MASK_BITS, SPACE_CLASS, UPPER, bits_of, in_bits, keep, let, mask_of, pieces, table, tidy

#: Lines of fewer words are not compared by edits: one word is too large a part of them.
MIN_WORDS = 8
#: A document with fewer words would not pass the quality rules.
LEFT_WORDS = 20
# A-Z to a-z; the other bytes stay. bytes.split() cuts at the white-space bytes.
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = 0x9E3779B97F4A7C15
_digest = xxhash.xxh3_64_digest


def _longs(digests: list[bytes]) -> pa.Array:
    return pa.array(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64))


def halves(words: list[bytes], line: bytes) -> list[bytes]:
    """Digests of the halves that a line (its words, joined by spaces) has in common with a line within
    one edit: the first and the second half for a shorter line of its own length, then those for
    one of one word less."""
    n = len(words)
    m = n // 2
    at = len(b" ".join(words[:m]))
    first, second = line[:at], line[at + 1 if m else 0 :]
    first_less, second_less = (first, second[len(words[m]) + 1 :]) if n % 2 else (line[: max(at - len(words[m - 1]) - 1, 0)], second)
    return [_digest(first, 2 * n), _digest(second, 2 * n + 1), _digest(first_less, 2 * n - 2), _digest(second_less, 2 * n - 1)]


def variants(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of a line (its words' hashes) without each word, with the position and without, and
    of the line itself."""
    n = len(words)
    with np.errstate(over="ignore"):
        odd = np.uint64(_ODD)
        powers = np.cumprod(np.full(n + 1, odd, np.uint64)) * np.uint64(pow(_ODD, -1, 1 << 64))
        before = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:n])])  # of words[:i]
        shifted = before[1:] - words * powers[:n]
        rest = (before[n] - before[1:]) * np.uint64(pow(_ODD, -1, 1 << 64))  # of words[i + 1:], one to the left
        without = shifted + rest
        placed = (without ^ (without >> np.uint64(31))) * odd + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return placed, without, int(before[n])


def within_one(x: list[int], y: list[int]) -> bool:
    """Whether the edit distance of two word lists is at most 1."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


def _lines(text: bytes | None, least: int):
    """(number, words) of the lines with ``least`` words or more."""
    for k, line in enumerate((text or b"").translate(_LOW).split(b"\n")):
        words = line.split()
        if len(words) >= least:
            yield k, words


def line_rows(docs: DataFrame, least: int, shortest: int) -> DataFrame:
    """(h, doc_id, row, line, halves) of the lines with ``shortest`` words or more; those with fewer than
    ``least`` have no halves and so can only be equal to another line. ``row`` tells rows with an
    equal doc_id apart, by a hash of the text."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                h, ids, rows, at, keys, ends = [], [], [], [], [], [0]
                for doc_id, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    for k, words in _lines(text, shortest):
                        whole = b" ".join(words)
                        h.append(_digest(whole))
                        ids.append(doc_id)
                        rows.append(row)
                        at.append(k)
                        if len(words) >= least:
                            keys += halves(words, whole)
                        ends.append(len(keys))
                if h:
                    offsets = pa.array(ends, pa.int32())
                    yield pa.RecordBatch.from_arrays([_longs(h), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.ListArray.from_arrays(offsets, _longs(keys))], names=["h", "doc_id", "row", "line", "halves"])

    some = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(tidy(run), "h long, doc_id long, row long, line int, halves array<long>")


def word_rows(docs: DataFrame, least: int, met: DataFrame) -> DataFrame:
    """(h, words) of the lines ``met`` (h, doc_id), read where they first stand; words as 64-bit hashes.
    Two tables of bits say which documents and which lines may be in it, others are passed over."""
    near = F.xxhash64("doc_id").alias("at")
    held = docs.sparkSession.sparkContext.broadcast((mask_of(met.select(near), "at"), mask_of(met, "h")))

    def run(batches):
        seen: set[int] = set()
        here, wanted = held.value
        for batch in batches:
            some = here[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MASK_BITS)]
            for part in pieces(batch.filter(pa.array(some))):
                h, rows = [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    for _, words in _lines(text, least):
                        d = xxhash.xxh3_64_intdigest(b" ".join(words))
                        if wanted[d >> (64 - MASK_BITS)] and d not in seen:
                            if len(seen) < 1_000_000:
                                seen.add(d)
                            h.append(d)
                            rows.append([_digest(w) for w in words])
                if h:
                    offsets = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, _longs([w for r in rows for w in r]))], names=["h", "words"])

    some = docs.where("doc_id IS NOT NULL").select(F.xxhash64(F.col("doc_id").cast("long")).alias("at"), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(tidy(run), "h long, words array<long>").dropDuplicates(["h"])


def variant_rows(lines: DataFrame) -> DataFrame:
    """(key, kind, h, doc_id, line): kind 0 a placed variant, 1 a variant, 2 the line itself. ``roles`` has
    the bits of the halves (in their order) that the line shares; an edit lies outside of one that it
    leaves, so a line emits only variants without a word there, and itself only for longer lines."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 4, 1 << 18):
                flat = part.column(4).flatten().to_numpy().view(np.uint64)
                ends = np.cumsum(part.column(4).value_lengths().to_numpy())
                keys, counts = [], []
                for roles, a, b in zip(part.column(3).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    placed, without, whole = variants(flat[a:b])
                    n = b - a
                    mid, less = n // 2, (n - 1) // 2
                    some = [
                        placed[0 if roles & 2 else mid : n if roles & 1 else mid],
                        without[0 if roles & 8 else less : n if roles & 4 else less],
                        np.full(1 if roles & 3 else 0, whole, np.uint64),
                    ]
                    keys += some
                    counts += map(len, some)
                key = np.concatenate(keys)
                kind = np.repeat(np.tile(np.arange(3, dtype=np.int8), part.num_rows), counts)
                rows = pa.array(np.repeat(np.arange(part.num_rows), np.reshape(counts, (-1, 3)).sum(1)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), *[part.column(k).take(rows) for k in range(3)]], names=["key", "kind", "h", "doc_id", "line"])

    return lines.select("h", "doc_id", "line", "roles", "words").mapInArrow(tidy(run), "key long, kind byte, h long, doc_id long, line int")


def near_pairs(keys: DataFrame) -> DataFrame:
    """(h, other): each line and an earlier one within the bound, the earliest of each group. The
    earliest is found by partial aggregation and joined back, so that large groups can be split."""
    placed = keys.where("kind = 0").select("key", "h", F.struct("doc_id", "line").alias("at"))
    first = placed.groupBy("key").agg(F.min(F.struct("at", "h")).alias("first"), F.min("h").alias("low"), F.max("h").alias("high")).where("low < high")
    replaced = placed.join(first.select("key", "first"), "key").where(F.col("at") > F.col("first.at")).select("h", F.col("first.h").alias("other"))
    whole = keys.where("kind = 2").select("key", F.col("h").alias("y"), F.struct("doc_id", "line").alias("y_at"))
    added = keys.where("kind = 1").select("key", F.col("h").alias("x"), F.struct("doc_id", "line").alias("x_at")).join(whole, "key").where("x_at <> y_at")
    later = F.col("x_at") > F.col("y_at")
    added = added.select(F.when(later, F.col("x")).otherwise(F.col("y")).alias("h"), F.when(later, F.col("y")).otherwise(F.col("x")).alias("other"))
    return replaced.unionByName(added).where("h <> other").distinct()


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The lines (h) that have an earlier line within one edit."""

    def run(batches):
        for batch in batches:
            same = [within_one(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same, pa.bool_()))], names=["h"])

    both = pairs.join(words.select("h", F.col("words").alias("x")), "h").join(words.select(F.col("h").alias("other"), F.col("words").alias("y")), "other")
    return both.select("h", "x", "y").mapInArrow(tidy(run), "h long").distinct()


def duplicate_lines(docs: DataFrame, least: int = MIN_WORDS, shortest: int | None = None) -> DataFrame:
    """(doc_id, row, line, near): the lines of ``docs`` that an earlier line makes superfluous; near:
    where such a line first stands it is within one edit of an earlier one, else it is equal."""
    lines = keep(line_rows(docs, least, least if shortest is None else shortest), "lines")
    firsts = keep(lines.groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("at")), "firsts")
    half = lines.select("h", F.explode("halves").alias("half"))
    several = half.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("half")
    several = keep(several, "several")
    # The bits only spare the shuffle of most other halves; the join decides.
    half = lines.select("h", F.posexplode("halves").alias("role", "half")).select("*", bits_of(several, "half").scalar().alias("bits"))
    half = half.where(in_bits("bits", "half")).drop("bits")
    met = half.join(several, "half").groupBy("h").agg(F.bit_or(F.expr("shiftleft(1, role)")).alias("roles"))
    met = keep(met.join(firsts, "h").select("h", "at.doc_id", "at.line", "roles"), "met")
    words = keep(met.join(word_rows(docs, least, met), "h"), "words")
    later = verified(near_pairs(keep(variant_rows(words), "variants")), words)
    # Written, so that the join with all lines is one of its own, whose frequent lines Spark splits.
    known = firsts.select("h", "at").join(later.withColumn("near", F.lit(True)), "h", "left").select("h", "at", F.coalesce("near", F.lit(False)).alias("near"))
    known = keep(known, "known")
    spots = lines.select("h", "doc_id", "row", "line", F.struct("doc_id", "line").alias("own")).join(known, "h")
    return spots.where(F.col("near") | (F.col("own") != F.col("at"))).select("doc_id", "row", "line", "near").distinct()


def dedup(docs: DataFrame, least: int = MIN_WORDS, shortest: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, others) with the remaining text, and ``n_lines``, ``n_exact`` and
    ``n_near`` (lines before; removed as equal, removed as within one edit) as further columns.

    Lines are compared by their lower-case (A-Z) words. Those with ``least`` words or more are compared
    by one edit, those with ``shortest`` or more (``least`` if not given) only as equal; the others
    stay. Earlier means a smaller doc_id, then a smaller line number; a line goes if any earlier
    line is within the bound, whether that one stays or not. Nulls: a null text stays null and
    has no lines; rows without a doc_id stay as they are and are compared with nothing. Rows with
    an equal doc_id count as equally early: lines with the same number in them do not remove each other. Without documents the result
    is empty. Clashing columns: those of ``docs`` that are named like a new one give way.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    removed = duplicate_lines(docs.select("doc_id", "text"), least, shortest)
    by_doc = removed.groupBy("doc_id", "row").agg(F.collect_set(F.when(F.col("near"), F.col("line"))).alias("_near"), F.collect_set(F.when(~F.col("near"), F.col("line"))).alias("_exact"))
    none = F.array().cast("array<int>")
    count: Column = F.size(F.split("text", "\n"))
    by_doc = keep(by_doc.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_near", "_exact"), "removed")
    # Documents that lose nothing are mostly told by bits and not shuffled; the join decides.
    changed = bits_of(by_doc.select(F.xxhash64("_id").alias("at")), "at").scalar()
    marked = docs.select(*names, changed.alias("_bits"), F.xxhash64(F.col("doc_id").cast("long")).alias("_at"))
    whole = marked.where(~in_bits("_bits", "_at")).select(*names, none.alias("_near"), none.alias("_exact"))
    # Hashed, as the removed lines are few beside the texts, which would have to be sorted.
    joined = marked.where(in_bits("_bits", "_at")).select(*names).join(by_doc.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left")
    joined = joined.select(*names, *[F.coalesce(c, none).alias(c) for c in ("_near", "_exact")]).unionByName(whole)
    gone = joined.withColumn("_gone", F.sort_array(F.concat("_near", "_exact")))

    def rest(lines: Column, cut: Column) -> Column:
        """The kept lines, which are those between the removed ones."""
        before = lambda i: F.coalesce(F.get(cut, i - 1), F.lit(-1)) + 1
        return F.array_join(F.flatten(F.transform(F.concat(cut, F.array(F.size(lines))), lambda e, i: F.slice(lines, before(i) + 1, e - before(i)))), "\n")

    # The text is split once, not for each removed line.
    less = let(F.split("text", "\n"), lambda lines: let(F.col("_gone"), lambda cut: rest(lines, cut)))
    out = gone.withColumn("_text", F.when(F.size("_gone") == 0, F.col("text")).otherwise(less))
    return out.select(
        *[F.col("_text").alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.size("_exact").cast("long").alias("n_exact"), F.size("_near").cast("long").alias("n_near"),
    )


def dedup_documents(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the superfluous lines. A document that loses lines goes if it has no words left, or only
    leftovers: lines under ``least`` words, fewer than ``LEFT_WORDS`` in all and under half of its characters."""
    out = dedup(docs.withColumn("_chars", F.length("text")), least, 1)
    changed = F.col("n_exact") + F.col("n_near") > 0

    def leftover(lines: Column) -> Column:
        longest, total = F.array_max(lines), F.aggregate(lines, F.lit(0), lambda a, n: a + n)
        return (total == 0) | ((longest < least) & (total < LEFT_WORDS) & (2 * F.length("text") < F.col("_chars")))

    sizes = F.transform(F.split("text", "\n"), lambda line: F.size(F.array_remove(F.split(line, SPACE_CLASS + "+"), "")))
    return out.where(~F.when(changed, let(sizes, leftover)).otherwise(F.lit(False))).select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), shortest=1).select("doc_id", "n_lines", "n_exact", "n_near", "text")


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL: dict = {}
