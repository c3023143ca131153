"""Jaccard join of shingle sets by parity sketches.

A sketch is a row of bits; each shingle flips the one that its hash names. So the Hamming distance
of two sketches is at most the symmetric difference of their sets. Sizes fall into bands, and all
linked pairs that meet in a band have a symmetric difference of at most ``D``. A band's sketch is
cut into ``P > D`` words of ``2 ** WORD_BITS`` bits; two linked sets have ``P - D`` equal words at
least, so joining on equal words (by a hash of their set bits) loses no link. Words with at most one
bit say little and many sets share them. A set with no more than ``P - D - 1`` of these need not
emit them, for one of its equal words is then another one; a set with more emits all. Of what meets in
a word, the Hamming distance of short sketches takes most of the rest away; what is left is
verified on the whole sets.

Sets are compared by their digest first: equal sets are one node, however many copies there are.
Of its words a set can do without as many as there are more than needed, if all sets give up their
most frequent ones in the same order: of the words that two linked sets share, the rarest stays.
In a word's group each set is first verified against the group's smallest digest only; what that
links is settled by connected components. Groups that then still hold several components are
joined again, for pairs of different components whose sketches do not rule a link out.
"""

from __future__ import annotations

from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, MASK_BITS, UPPER, keep, mask_of, pieces, table, tidy
from tidewatch.llm.components import components
from tidewatch.llm.words import ODD, Words, mix

WORDS = 4
#: The least Jaccard similarity is this many hundredths.
PERCENT = 85
#: Bits of a word of the sketches by band.
WORD_BITS = 20
#: Bits of a hash that place a shingle in a short sketch.
SHORT = 40
#: Rows of a batch that have one key without a salt, two at least; salts of those beyond.
FREE, SALTS = 2, 4096


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def shingle_sets(texts: list[bytes | None], size: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its shingles (64 bits for each); of a text with fewer
    words, the hash of all of them; without words empty."""
    words = Words(texts)
    runs = {k: words.runs(k) for k in range(1, size + 1)}
    out = []
    for at, end in pairwise(words.first.tolist()):
        k = min(size, end - at)
        out.append(distinct(runs[k][at : end - k + 1]) if k else np.empty(0, np.uint64))
    return out


@cache
def bands(limit: int, percent: int = PERCENT) -> list[int]:
    """Least sizes of the bands of sizes up to ``limit``, and of two more. Linked sets are in one
    band or in neighbours."""
    out = [1]
    while len(out) < 3 or out[-3] <= limit:
        out.append(out[-1] * 10000 // (percent * percent) + 1)
    return out


def shape(band: int, limits: list[int], percent: int = PERCENT) -> tuple[int, int]:
    """The bound D on the symmetric difference in a band, and the words P of its sketches."""
    most = limits[band + 1] - 1
    d = 2 * most * (100 - percent) // (100 + percent)
    return d, -(-(d + 1) * 139 // 100) + 2


def words_of_sketch(tokens: np.ndarray, band: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a set bit, how many they have, and a hash of which."""
    h = mix(tokens + np.uint64(band * ODD % (1 << 64)))
    bit = ((h % np.uint64(words)) << np.uint64(WORD_BITS)) | (h >> np.uint64(64 - WORD_BITS))
    bit.sort()
    if (bit[1:] == bit[:-1]).any():  # what flips twice is not set
        bit, flips = np.unique(bit, return_counts=True)
        bit = bit[flips & 1 == 1]
    at = (bit >> np.uint64(WORD_BITS)).astype(np.int64)
    start = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(start, append=len(at))
    return at[start], n, np.bitwise_xor.reduceat(mix(bit), start) if len(at) else bit


def keys_of(tokens: np.ndarray, limits: list[int], percent: int = PERCENT) -> list[tuple[np.ndarray, int, int]]:
    """A set's keys in its band (0), and in the next one (1) if a linked set may be there; with
    how many of these keys it can still do without, given the sizes that linked sets can have."""
    n, out = len(tokens), []
    own = int(np.searchsorted(limits, n, "right")) - 1
    for band in (own, own + 1):
        if band > own and 100 * n < percent * limits[band]:
            continue
        d, p = shape(band, limits, percent)
        if d == 0:  # only equal sets
            continue
        at, bits, words = words_of_sketch(tokens, band, p)
        full = bits > 1
        largest = min(limits[band + 1] - 1, 100 * n // percent)
        d = (n + largest) * (100 - percent) // (100 + percent)
        room = int(full.sum()) - d - 1  # of P - d - 1 what the words with a bit or none leave
        if room >= 0:
            at, words = at[full], words[full]
        else:
            every = np.zeros(p, np.uint64)
            every[at] = words
            at, words = np.arange(p), every
        keys = mix(words * np.uint64(ODD) + mix(at.astype(np.uint64) * np.uint64(ODD ^ 0xFF00) + np.uint64(band)))
        out.append((keys, max(0, room), band - own))
    return out


def short_sketch(tokens: np.ndarray) -> np.ndarray:
    """A sketch with as many bits as the set has shingles, to the next power of 2, 64 at least."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    flips = np.bincount((tokens >> np.uint64(64 - SHORT)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(flips, bitorder="little").view(np.uint64)


def digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _sets(docs: DataFrame, size: int, mask: np.ndarray | None, emit, schema: str) -> DataFrame:
    """Rows of ``emit`` for each task's distinct non-empty sets (if a mask is given, those that
    may be in a pair)."""
    held = None if mask is None else docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch):
                found = {}
                for tokens in shingle_sets(part.column(0).cast(pa.binary()).to_pylist(), size):
                    d = digest(tokens)
                    if not len(tokens) or d in seen or held is not None and not held.value[d >> (64 - MASK_BITS)]:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(d)
                    found[d] = tokens
                if found:
                    yield emit(list(found.items()))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def key_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, salt, d, room): the keys of all sets; room is twice how many of its keys a set can do
    without, and 1 more for those in the next band. Of the rows of a batch with one key, those
    after the first ``FREE`` have a salt, so that a key of very many sets is dealt to many tasks;
    a salted key is in several sets for certain."""

    def emit(found):
        limits = bands(max(len(t) for _, t in found), percent)
        keys, ds, rooms, n = [np.empty(0, np.uint64)], [], [], []
        for d, t in found:
            for k, room, band in keys_of(t, limits, percent):
                keys.append(k)
                n.append(len(k))
                ds.append(d)
                rooms.append(2 * room + band)
        ds, rooms = np.repeat(np.array(ds, np.uint64), n), np.repeat(np.array(rooms, np.int32), n)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        first = np.append(True, flat[order][1:] != flat[order][:-1])[: len(flat)]
        at = np.arange(len(flat))
        nth = np.empty(len(flat), np.int64)
        nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        salts = np.where(nth < FREE, 0, 1 + (ds % np.uint64(SALTS)).astype(np.int64)).astype(np.int32)
        return pa.RecordBatch.from_arrays([_signed(flat), pa.array(salts), _signed(ds), pa.array(rooms)], names=["key", "salt", "d", "room"])

    return _sets(docs, size, None, emit, "key long, salt int, d long, room int")


def set_rows(docs: DataFrame, size: int, mask: np.ndarray) -> DataFrame:
    """(d, tokens) of the sets that the mask lets pass."""

    def emit(found):
        offsets = np.cumsum([0, *(len(t) for _, t in found)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate([t for _, t in found])))
        return pa.RecordBatch.from_arrays([_signed([d for d, _ in found]), tokens], names=["d", "tokens"])

    return _sets(docs, size, mask, emit, "d long, tokens array<long>").dropDuplicates(["d"])


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, d): the keys that several sets have, without those that a set can do without. Most keys
    are in one set and go in one pass by key and salt; the rest is counted by partial aggregation
    and joined back, so that a key of very many sets can be split."""
    group = W.partitionBy("key", "salt")
    before = F.lag("d").over(group.orderBy("d"))
    rows = keys.select("key", "salt", "d", "room", F.min("d").over(group).alias("low"), F.max("d").over(group).alias("high"), before.alias("before"))
    rows = rows.where(((F.col("salt") > 0) | (F.col("low") < F.col("high"))) & (F.col("before").isNull() | (F.col("before") != F.col("d"))))
    rows = keep(rows.select("key", "d", "room"), "shared")
    counted = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    rank = F.row_number().over(W.partitionBy("d", "room").orderBy(F.desc("n"), "key"))
    return counted.withColumn("rank", rank).where(F.col("rank") > F.shiftright("room", 1)).select("key", "d")


def hubs(rows: DataFrame) -> DataFrame:
    """(key, hub, d): each set of a key's group beside the group's smallest, the hub."""
    least = rows.groupBy("key").agg(F.min("d").alias("hub"), F.max("d").alias("high")).where("hub < high").select("key", "hub")
    return rows.join(least, "key").where("hub <> d").select("key", "hub", "d")


def within_reach(nx: Column, sx: Column, ny: Column, sy: Column, percent: int) -> Column:
    """Whether sizes and short sketches leave it open that two sets are linked. A sketch of twice
    the other's length is folded; that flips the bits that the shorter one has."""

    def fold(s: Column, other: Column) -> Column:
        half = F.shiftright(F.size(s), 1)
        folded = F.zip_with(F.slice(s, 1, half), F.slice(s, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(s) > F.size(other), folded).otherwise(s)

    far = F.aggregate(F.zip_with(fold(sx, sy), fold(sy, sx), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, x: t + x)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * far <= (100 - percent) * (nx + ny))


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose sets are similar."""
    pairs = keep(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    sets = keep(set_rows(docs, size, mask_of(pairs.select(F.explode(F.array("a", "b")).alias("d")), "d")), "sets")
    left = pairs.join(sets.select(F.col("d").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("d").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return keep(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "verified")


def links(docs: DataFrame, base: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between the digests of different sets, enough to connect all that are linked."""
    known = base.where("d IS NOT NULL").dropDuplicates(["d"]).select("d", F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    named = lambda df, t: df.select(*[F.col(c).alias(f"{c}{t}" if c != "key" else c) for c in df.columns])
    reach = within_reach(F.col("nx"), F.col("sx"), F.col("ny"), F.col("sy"), percent)
    rows = keep(shared_keys(key_rows(docs, size, percent)), "rows")
    star = hubs(rows).select(F.col("hub").alias("dx"), F.col("d").alias("dy")).distinct()
    star = star.join(named(known, "x"), "dx").join(named(known, "y"), "dy").where(reach)
    first = verified(star.select(F.col("dx").alias("a"), F.col("dy").alias("b")), docs, size, percent)
    roots = components(first)
    rooted = rows.join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high AND size > 2").select("key")
    open_rows = rooted.join(several, "key")
    # A pair is taken in the first of the groups in which its sets meet.
    held = known.join(open_rows.groupBy("d").agg(F.collect_list("key").alias("keys")), "d")
    rest = keep(open_rows.join(held, "d"), "rest")
    x, y = named(rest, "x"), named(rest, "y").withColumnRenamed("key", "keyy")
    pairs = x.join(y, (F.col("key") == F.col("keyy")) & (F.col("dx") < F.col("dy")) & (F.col("rootx") != F.col("rooty")) & reach & (F.array_min(F.array_intersect("keysx", "keysy")) == F.col("key")))
    second = verified(pairs.select(F.col("dx").alias("a"), F.col("dy").alias("b")), docs, size, percent)
    return first.unionByName(second)


def base_rows(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, d, sketch); d is null for a document without words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), size)
                d = np.array([digest(t) for t in sets], np.uint64).view(np.int64)
                sketches = [short_sketch(t) for t in sets]
                offsets = pa.array(np.cumsum([0, *map(len, sketches)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(t) for t in sets], pa.int64()), pa.array(d, mask=np.array([not len(t) for t in sets])),
                    pa.ListArray.from_arrays(offsets, _signed(np.concatenate(sketches))),
                ], names=["doc_id", "n_shingles", "d", "sketch"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return out.mapInArrow(tidy(run), "doc_id long, n_shingles long, d long, sketch array<long>")


def find(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two documents link if their sets of ``size``-word shingles have a Jaccard similarity of
    ``percent`` hundredths or more. Sets stand for their shingles by 64-bit hashes and for each
    other by a 64-bit digest. Nulls: a null text has no words; what has no words is its own
    component; a null doc_id is never a component_id unless no other row of the component has
    one. Repeated rows give repeated rows. Without documents the result is empty. Other columns
    are not read.
    """
    base = keep(base_rows(docs, size), "base")
    roots = components(links(docs, base, size, percent))
    rooted = base.drop("sketch").join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    # Both written, so that the join is one of its own, whose large components Spark splits.
    rooted = keep(rooted, "rooted")
    least = keep(rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    some = rooted.where("root IS NOT NULL").join(least, "root").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return some.unionByName(rooted.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def first_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component, one row for each doc_id."""
    found = find(docs, size, percent)
    firsts = found.where("doc_id IS NULL OR doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(0, len(w) - 3), lambda k: array_to_string(w[k + 1 : k + 4], ' ')) END) AS set FROM d),
u AS (SELECT min(doc_id) AS id, len(set) AS n, set FROM (SELECT doc_id, list_sort(set) AS set FROM s WHERE len(set) > 0) GROUP BY set),
t AS (SELECT id, n, unnest(set) AS x FROM u),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM t a JOIN t b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id),
e AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (n - c) UNION SELECT b, a FROM p WHERE 100 * c >= 85 * (n - c)),
r(id, root) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id),
k AS (SELECT s.doc_id, u.id, len(s.set) AS n FROM s LEFT JOIN u ON list_sort(s.set) = u.set)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(g.root, k.id, k.doc_id) AS component_id FROM k LEFT JOIN g ON k.id = g.id"""
QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLE_SQL = {"op2_ngram_jaccard": ORACLE}
