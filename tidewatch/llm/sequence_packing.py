"""Best-fit packing of tokenized documents, after Martello and Toth's dominance reduction.

There are at most ``capacity`` different lengths, so the whole instance is a histogram of that
size, however many pieces there are. It is solved on the driver with multiplicities: dominance
fixes bins for good and shrinks the instance, best fit decreasing packs what remains. The plan is
a list of intervals: the pieces of a length with the ranks ``lo`` to ``hi`` take the same place in
consecutive sequences. Executors number the pieces of each length in salted groups and look up
their places, so no task holds all pieces of a length.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, keep, table

CAPACITY, END = 2048, 0
#: Parts of words whose ids a worker remembers, and bytes that they take; beyond that, only those of the last slice stay.
CACHE_PARTS, CACHE_BYTES = 1_000_000, 1 << 26
#: Bytes of text that are encoded at a time, but for longer single texts.
SLICE = 1 << 22
#: Pieces of one length that are ranked in one group, about.
GROUP_ROWS = 1_000
#: Largest plan (intervals of about 60 bytes) that is broadcast; a larger one is joined by shuffle.
PLAN_ROWS = 50_000

#: How the tokenizer cuts what it has normalized; ``cut`` does the same.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that ``cut`` does not know: all but ASCII, the letters of Latin-1, and dashes, quotes and the like.
#: None of those that it knows composes with another or has a lower case that depends on others.
UNKNOWN = "[^\\x00-\\x7F\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}\\x{2010}-\\x{2027}]"
#: What ends the last token of a part, and only that: no part has both letters and other characters.
LAST = "</w>"
#: A character with one id of its own, put between new words that are odd.
MARK = "\x01"
#: Parts in a line, and lines that are encoded at a time.
TOGETHER, LINES = 64, 64

SPACE, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]], KIND[48:58], KIND[65:91], KIND[97:123] = SPACE, DIGIT, LETTER, LETTER
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def cut(texts: pa.Array, special: list[bytes] | None) -> tuple[pa.Array, np.ndarray]:
    """The parts into which the tokenizer cuts the texts, one after the other and in lower case, and how many of them
    stand before the end of each text. A word (what stands between white space) with an unknown character or with
    one of ``special`` is one part and left as it is; if ``special`` is None, every word."""
    texts = pc.fill_null(texts, "")
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), " ")[0].as_py() + "   "
    raw = np.frombuffer(line.encode(), np.uint8)
    kind, low = KIND[raw], SMALL[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    two, three = lead[raw[lead] == 0xC3], lead[raw[lead] == 0xE2]
    second = raw[two + 1]
    letter = (second != 0x97) & (second != 0xB7)
    kind[two[letter]] = kind[two[letter] + 1] = LETTER
    low[two[letter & (second < 0x9F)] + 1] += 32
    sign = (raw[three + 1] == 0x80) & (raw[three + 2] >= 0x90) & (raw[three + 2] <= 0xA7)
    odd = [lead[(raw[lead] != 0xC3) & (raw[lead] != 0xE2)], two[~letter], three[~sign]]

    word = kind != SPACE
    begins, starts = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero(raw == 39)
    quote = quote[starts[quote]]
    first, next_ = low[quote + 1], low[quote + 2]
    one = np.isin(first, list(b"stmd"))
    both = np.isin(first * np.uint16(256) + next_, [256 * x + y for x, y in (b"re", b"ve", b"ll")])
    starts[quote[one | both] + 1] = False
    after = np.concatenate([quote[one] + 2, quote[both] + 3])
    starts[after[kind[after] == LETTER]] = True

    if special is None:
        low, starts = raw, begins
    else:
        for token in special:
            at = np.flatnonzero(raw == token[0])
            odd.append(at[raw[at + 1] == token[1]] if len(token) > 1 else at)
        odd = np.concatenate(odd)
        if len(odd):
            number = np.cumsum(begins, dtype=np.int32)
            whole = np.zeros(number[-1] + 1, bool)
            whole[number[odd]] = True
            whole = whole[number]
            low, starts = np.where(whole, raw, low), np.where(whole, begins, starts)
    body = low[word]
    bounds = np.append(np.flatnonzero(starts[word]), len(body)).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(body))
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1) - 1
    return parts, np.searchsorted(np.flatnonzero(starts), ends)


def _lines(parts: pa.Array, between: str) -> list[str]:
    bounds = pa.array([*range(0, len(parts), TOGETHER), len(parts)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(bounds, parts), between).to_pylist() if len(parts) else []


class Ids:
    """Token ids of texts, the same as the tokenizer gives.

    The tokenizer normalizes (no character composes with a space), drops white space, cuts words into
    parts and encodes each part by itself. So a text's ids are those of its parts, which a worker
    remembers. What a slice of texts has is told apart by Arrow, so that the tokenizer and Python see
    each new part once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        vocabulary = t.get_vocab()
        self.kind = np.dtype(np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32)
        first = json.loads(t.pre_tokenizer.__getstate__()).get("pretokenizers", [{}])[0]
        known = first.get("pattern") == {"Regex": SPLIT} and t.model.end_of_word_suffix == LAST
        self.special = [x.content.encode() for x in t.get_added_tokens_decoder().values()] if known else None
        self.odd = "|".join([UNKNOWN, *[re.escape(x.decode()[:2]) for x in self.special]]) if known else ""
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith(LAST)]] = True
        self.parts = Tokenizer(t.model)
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.mark,) = t.encode(MARK, add_special_tokens=False).ids
        self.keys, self.ids = pa.array([], pa.string()), self.listed([0], np.array([], self.kind))

    def of_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        parts, at = cut(texts, self.special)
        parts = parts.dictionary_encode()
        every = self.of_parts(parts.dictionary).take(parts.indices)
        ids, ends = every.flatten().to_numpy(), every.offsets.to_numpy()[at]
        return [ids[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]

    def of_parts(self, parts: pa.Array) -> pa.Array:
        """A list of ids for each of ``parts``, which differ."""
        at = pc.index_in(parts, value_set=self.keys)
        new = parts.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = np.arange(len(self.keys), len(self.keys) + len(new))
        if len(new):
            self.keys, self.ids = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.ids, self.learned(new)])
        found = self.ids.take(pa.array(at))
        if len(self.keys) > CACHE_PARTS or self.keys.nbytes + self.ids.nbytes > CACHE_BYTES:
            self.keys, self.ids = parts, found
        return found

    def learned(self, parts: pa.Array) -> pa.Array:
        odd = pc.match_substring_regex(parts, self.odd)
        alone = pc.and_(odd, pc.match_substring(parts, MARK))
        kinds = pc.if_else(alone, 2, pc.if_else(odd, 1, 0)).to_numpy()
        plain, others, marked = (parts.filter(pa.array(kinds == k)) for k in range(3))
        ids = self.encoded(self.parts, _lines(plain, " "))
        made = [self.listed([0, *(np.flatnonzero(self.last[ids]) + 1)], ids)]
        ids = self.encoded(self.tokenizer, [f"{x} {MARK}" for x in _lines(others, f" {MARK} ")])
        mark = ids == self.mark
        made.append(self.listed([0, *(np.flatnonzero(mark) - np.arange(mark.sum()))], ids[~mark]))
        made += [self.listed([0, len(x)], x) for x in (self.encoded(self.tokenizer, [t]) for t in marked.to_pylist())]
        if sum(map(len, made)) != len(parts):
            raise ValueError("the tokenizer does not end parts as expected")
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.argsort(kinds, kind="stable"))))

    def encoded(self, tokenizer, lines: list[str]) -> np.ndarray:
        ids = [np.array([], self.kind)]
        for at in range(0, len(lines), LINES):
            ids.append(np.array([i for e in tokenizer.encode_batch_fast(lines[at : at + LINES], add_special_tokens=False) for i in e.ids], self.kind))
        return np.concatenate(ids)

    def listed(self, bounds, ids: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.from_numpy_dtype(self.kind)))


@functools.cache
def ids_for(path: str) -> Ids:
    """One tokenizer and cache for each worker process, which has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and id 0, cut every ``capacity`` ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = ids_for(tokenizer)
        rows: list[tuple] = []
        for doc_id, known in zip(batch.column(0).to_pylist(), ids.of_all(batch.column(1)), strict=True):
            data = memoryview(known.astype("<u4").tobytes() + END.to_bytes(4, "little"))
            n = len(data) // 4
            for k, start in enumerate(range(0, n, capacity)):
                end = min(n, start + capacity)
                rows.append((doc_id, k, start, end - start, zlib.crc32(data[4 * start : 4 * end])))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, PIECES, SLICE)


class Bin(NamedTuple):
    """``times`` sequences with the same content: (length, copies) in order."""

    content: tuple[tuple[int, int], ...]
    times: int


def dominated(counts: dict[int, int], capacity: int) -> list[Bin]:
    """Bins that some best packing has; their items are taken out of ``counts``.

    For an item ``x`` with the room ``c`` beside it: alone if nothing fits; with the item of
    length ``c``; with the largest that fits, if no two others fit or no two are together longer
    and no three fit."""
    fixed: list[Bin] = []

    def take(content: tuple[tuple[int, int], ...], times: int) -> None:
        fixed.append(Bin(content, times))
        for length, copies in content:
            counts[length] -= copies * times
            if not counts[length]:
                del counts[length]

    changed = True
    while changed:
        changed = False
        for x in sorted(counts, reverse=True):
            while x in counts:
                c = capacity - x
                left = lambda y: counts.get(y, 0) - (y == x)  # noqa: B023, E731
                if c == x and left(x) > 0:
                    take(((x, 2),), counts[x] // 2)
                elif c != x and left(c) > 0:
                    take(((x, 1), (c, 1)), min(counts[x], counts[c]))
                else:
                    small = _smallest(counts, x)
                    if not small or small[0] > c:
                        take(((x, 1),), counts[x] if not small or small[0] != x or 2 * x > capacity else 1)
                    else:
                        j = max(y for y in counts if y <= c and left(y) > 0)
                        three = len(small) < 3 or sum(small[:3]) > c
                        if len(small) < 2 or small[0] + small[1] > c or (three and _best_pair(counts, x, c) <= j):
                            if j == x:
                                take(((x, 2),), 1)
                            else:
                                take(((x, 1), (j, 1)), _times(counts, x, j, small))
                        else:
                            break
                changed = True
    return fixed


def _times(counts: dict[int, int], x: int, j: int, small: list[int]) -> int:
    """How often the pair can be taken before the reason for it could change: while the three
    smallest items are not touched, or once."""
    spare = counts[j] - sum(y == j for y in small)
    return max(1, min(counts[x] - sum(y == x for y in small), spare))


def _smallest(counts: dict[int, int], x: int) -> list[int]:
    """Up to three smallest items beside one of length ``x``."""
    out: list[int] = []
    for y in sorted(counts):
        out += [y] * min(3 - len(out), counts[y] - (y == x))
        if len(out) == 3:
            break
    return out


def _best_pair(counts: dict[int, int], x: int, c: int) -> int:
    """The largest sum up to ``c`` of two items beside one of length ``x``."""
    ys = sorted(y for y in counts if counts[y] - (y == x) > 0)
    best, i, j = 0, 0, len(ys) - 1
    while i <= j:
        s = ys[i] + ys[j]
        if s > c:
            j -= 1
        else:
            if i < j or counts[ys[i]] - (ys[i] == x) > 1:
                best = max(best, s)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Bin]:
    """Best fit decreasing over lengths with multiplicities."""
    open_bins: dict[int, list[Bin]] = defaultdict(list)  # by room

    def put(b: Bin, room: int) -> None:
        if b.times:
            open_bins[room].append(b)

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r, bins in open_bins.items() if r >= x and bins), default=capacity)
            b = open_bins[room].pop() if open_bins.get(room) else Bin((), n)
            copies = min(room // x, n)
            times = min(b.times, n // copies)
            if b.content:
                put(Bin(b.content, b.times - times), room)
            put(Bin((*b.content, (x, copies)), times), room - copies * x)
            n -= copies * times
    return [b for bins in open_bins.values() for b in bins]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, first place, sequences): the pieces of this length with
    the ranks lo to hi - 1; rank r has copy ``(r - lo) // sequences``."""
    counts = {x: n for x, n in counts.items() if n}
    bins = dominated(counts, capacity)
    bins += best_fit(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for b in bins:
        at = 0
        for length, copies in b.content:
            lo = used[length]
            used[length] = hi = lo + copies * b.times
            out.append((length, lo, hi, sequence, at, b.times))
            at += copies * length
        sequence += b.times
    return out


def _local(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """Rows of longs as a local relation: read from Arrow by the JVM, it starts no Python workers."""
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
    return spark.createDataFrame(pa.table(columns, names=names))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (the columns of ``PIECES``) with ``sequence_id`` and ``offset``.

    Ties: pieces of one length take their places in the order of a hash of doc_id and piece;
    which of repeated equal rows goes where is open, the set of result rows is not. An empty
    table gives an empty result; a null doc_id is carried along. Lengths are 1 to ``capacity``.
    """
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    places = plan({r["length"]: r["count"] for r in rows}, capacity)
    groups = _local(spark, ["length", "groups"], [(r["length"], 1 + r["count"] // GROUP_ROWS) for r in rows])
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups"))).drop("groups")
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place_in = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("place_in", place_in).join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("place_in"))
    found = _local(spark, ["length", "lo", "hi", "seq", "at", "times"], places)
    if len(places) <= PLAN_ROWS:
        found = F.broadcast(found)
    hit = ranked.join(found, [ranked["length"] == found["length"], F.col("rank") >= F.col("lo"), F.col("rank") < F.col("hi")])
    k = F.col("rank") - F.col("lo")
    return hit.select(
        *[ranked[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
        (F.col("seq") + F.pmod(k, F.col("times"))).alias("sequence_id"),
        (F.col("at") + F.floor(k / F.col("times")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text) with their places; see ``pack``.

    Nulls: a null text is an empty one (one piece with id 0). Repeated rows are packed as rows of
    their own. Texts of any length are tokenized whole. Other columns are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(keep(tokenized(docs, str(tokenizer), capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE_SQL: dict = {}
