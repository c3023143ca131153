"""Prefix tree of conversations with sums over subtrees, by heavy-path decomposition.

A node is a sequence of turns; its key is its depth and the exclusive-or of hashes of its turns
with their places, twice 64 bits. Of each node's children the one with the most conversations (then
with the smallest conversation) is heavy, and chains of heavy children are the paths. A path hangs
by its top on a node of another path, which then has at least twice as many conversations; so in
the order of the logarithm of the top's count, every path comes after those that hang on it. Each such round
takes suffix sums along its paths and adds the tops' sums to the nodes on which they hang.

A conversation, a path or a node may hold any part of all rows: ranks, running hashes and suffix
sums are taken in blocks of ``BLOCK`` rows, and blocks are put together by their totals; keys that many rows share are
summed by partial aggregation; a join with many rows of one conversation or path has the block in its key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, table

#: Rows of a block of a conversation or of a path.
BLOCK = 1024
#: Conversations, by this power of two of neighbouring ids, whose ids are put into one string.
ID_BITS = 12
#: Longest prefix taken from another conversation, and how many conversations share one.
MOST, FAMILY = 5, 100
NODE = ["d", "x", "y"]


def ranked(conversations: DataFrame) -> DataFrame:
    """(c, k, a, b, chars): turn ``k`` (from 1) of conversation ``c``, two hashes of its role and text, and its text's code points.

    Turns are in the order of ``turn``, nulls first, and then of the hashes. All rows are dealt
    by ranges of this order, so a conversation of any length is spread over tasks."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("at"),
    )
    dealt = keep(rows.repartitionByRange("c", "turn", "a", "b", "at").withColumn("p", F.spark_partition_id()), "turns")
    inside = F.row_number().over(W.partitionBy("c", "p").orderBy(F.asc_nulls_first("turn"), "a", "b", "at"))
    earlier = F.sum("count").over(W.partitionBy("c").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    # only the first conversation of a range can have begun in another: a row for each range at most
    begun = dealt.groupBy("c", "p").count().select("c", "p", earlier.alias("earlier")).where("earlier > 0")
    return dealt.withColumn("k", inside).join(F.broadcast(begun), ["c", "p"], "left").select("c", (F.col("k") + F.coalesce("earlier", F.lit(0))).alias("k"), "a", "b", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (c, d, a, b, chars, len) and the conversations (c, n, h, base, len) after the exchange of prefixes.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % 100`` (``base`` of them are there)
    and goes on with its own after the ``h``-th; ``h`` is the crc32 of its number modulo 6; ``len`` turns in all."""
    n = turns.groupBy("c").agg(F.count("*").alias("n"))
    size = n.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % (MOST + 1)).withColumn("r", F.col("c") - F.col("c") % FAMILY)
    first = n.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("r"), F.col("n").alias("there"))
    base = F.least("h", F.coalesce("there", F.lit(0)))
    convs = keep(size.join(first, "r", "left").select("c", "r", "n", "h", base.alias("base"), (base + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    blocks = convs.where("n > h").select("c", "h", "base", "len", F.explode(F.expr(f"sequence(h div {BLOCK}, (n - 1) div {BLOCK})")).alias("block"))
    own = turns.withColumn("block", F.expr(f"(k - 1) div {BLOCK}")).join(blocks, ["c", "block"]).where("k > h")
    own = own.select("c", (F.col("base") + F.col("k") - F.col("h")).alias("d"), "a", "b", "chars", "len")
    heads = turns.where((F.col("c") % FAMILY == 0) & (F.col("k") <= MOST)).select(F.col("c").alias("r"), F.col("k").alias("d"), "a", "b", "chars")
    taken = heads.join(convs.where("base > 0").select("c", "r", "base", "len"), "r").where("d <= base")
    return own.unionByName(taken.select("c", "d", "a", "b", "chars", "len")), convs


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, x, y, px, py, chars, len) of ``rows`` (c, d, a, b, chars, len): the key of the first ``d`` turns and that of one less."""
    rows = rows.select("c", "d", F.expr(f"(d - 1) div {BLOCK}").alias("block"), F.xxhash64("a", "d").alias("a"), F.xxhash64("b", "d").alias("b"), "chars", "len")
    upto = W.partitionBy("c", "block").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.where(F.col("len") > BLOCK).groupBy("c", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = totals.select("c", "block", F.bit_xor("a").over(before).alias("ca"), F.bit_xor("b").over(before).alias("cb")).where("block > 0")
    inside = rows.withColumn("x", F.bit_xor("a").over(upto)).withColumn("y", F.bit_xor("b").over(upto))
    whole = inside.join(carried, ["c", "block"], "left").withColumn("x", _xor(F.col("x"), F.coalesce("ca", F.lit(0)))).withColumn("y", _xor(F.col("y"), F.coalesce("cb", F.lit(0))))
    return whole.select("c", "d", "x", "y", _xor(F.col("x"), F.col("a")).alias("px"), _xor(F.col("y"), F.col("b")).alias("py"), "chars", "len")


def node_table(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, x, y, px, py, n, m, chars, n_children, heavy, hn, hm): ``n`` conversations, the smallest ``m``,
    whether the node is heavy, and these two of its heavy child."""
    root = convs.agg(F.count("*").alias("n"), F.min("c").alias("m")).where("n > 0")
    root = root.select(F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(k) for k in ("x", "y")], *[F.lit(None).cast("long").alias(k) for k in ("px", "py")], "n", "m", F.lit(0).cast("long").alias("chars"))
    made = rows.groupBy(*NODE).agg(F.min("px").alias("px"), F.min("py").alias("py"), F.count("*").alias("n"), F.min("c").alias("m"), F.min("chars").alias("chars"))
    nodes = keep(made.unionByName(root), "nodes")
    most = F.max(F.struct("n", F.bitwise_not("m").alias("not_m"), "x", "y"))
    below = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"), most.alias("best"))
    heavy = below.select((F.col("d") + 1).alias("d"), "best.x", "best.y", F.lit(True).alias("heavy"))
    both = nodes.join(below, NODE, "left").join(heavy, NODE, "left")
    return keep(both.select(*NODE, "px", "py", "n", "m", "chars", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("heavy", F.lit(False)).alias("heavy"), F.col("best.n").alias("hn"), F.bitwise_not("best.not_m").alias("hm")), "nodes")


def paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their path: (pm, pn), ``m`` and ``n`` of its top, ``block`` of the depth, and whether the path has more than one.

    Nodes of one ``m`` and ``n`` are a chain without branches, known without a walk. Chains find
    the top of their path by doubling: each points to the chain above it in its path, then to the
    one to which that points. At any time no two unfinished chains point to the same one."""
    chain = nodes.groupBy("m", "n").agg(F.min("d").alias("d1"), F.max("d").alias("d2"), F.max_by(F.struct("hm", "hn"), "d").alias("next"))
    chain = keep(chain, "chains")
    above = chain.where("next.hm IS NOT NULL").select(F.col("next.hm").alias("m"), F.col("next.hn").alias("n"), F.col("m").alias("um"), F.col("n").alias("un"))
    found = chain.select("m", "n", "d1", "d2").join(above, ["m", "n"], "left")
    found = found.select("m", "n", "d1", "d2", F.coalesce("um", "m").alias("um"), F.coalesce("un", "n").alias("un"), F.col("um").isNull().alias("done"))
    while True:
        found = keep(found, "chains")
        if found.where("NOT done").isEmpty():
            break
        to = found.select(F.col("m").alias("um"), F.col("n").alias("un"), F.col("um").alias("vm"), F.col("un").alias("vn"), F.col("done").alias("there"))
        moved = found.where("NOT done").join(to, ["um", "un"]).select("m", "n", "d1", "d2", F.col("vm").alias("um"), F.col("vn").alias("un"), F.col("there").alias("done"))
        found = found.where("done").unionByName(moved)
    ends = found.groupBy("um", "un").agg((F.expr(f"min(d1) div {BLOCK} < max(d2) div {BLOCK}")).alias("long"))
    chains = found.join(ends, ["um", "un"]).select("m", "n", "um", "un", "long", F.explode(F.expr(f"sequence(d1 div {BLOCK}, d2 div {BLOCK})")).alias("block"))
    placed = nodes.withColumn("block", F.expr(f"d div {BLOCK}")).join(chains, ["m", "n", "block"])
    return placed.withColumnsRenamed({"um": "pm", "un": "pn"})


def subtree_sums(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``placed`` (of ``paths``) with a column for each of ``sums``: the sum of its expression over a node's subtree."""
    names = list(sums)
    keys = [*NODE, "px", "py", "n", "m", "n_children", "heavy", "pm", "pn", "block", "long"]
    valued = placed.select(*keys, *[v.cast("long").alias(k) for k, v in sums.items()], F.floor(F.log2("pn")).cast("int").alias("class"))
    valued = keep(valued, "paths", by="class")
    done, pending = [], None
    for k, long in sorted(tuple(r) for r in valued.groupBy("class").agg(F.max("long")).collect()):  # a row for each power of two
        part = valued.where(F.col("class") == k).drop("class")
        if pending is not None:
            hung = pending.groupBy(*NODE).agg(*[F.sum(s).alias(f"hung_{s}") for s in names])
            part = part.join(hung, NODE, "left").select(*keys, *[(F.col(s) + F.coalesce(f"hung_{s}", F.lit(0))).alias(s) for s in names])
        down = W.partitionBy("pm", "pn", "block").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
        whole = part.select(*keys, *[F.sum(s).over(down).alias(s) for s in names])
        if long:
            later = W.partitionBy("pm", "pn").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
            totals = part.where("long").groupBy("pm", "pn", "block").agg(*[F.sum(s).alias(s) for s in names])
            carried = totals.select("pm", "pn", "block", *[F.sum(s).over(later).alias(f"later_{s}") for s in names])
            whole = whole.join(carried, ["pm", "pn", "block"], "left").select(*keys, *[(F.col(s) + F.coalesce(f"later_{s}", F.lit(0))).alias(s) for s in names])
        whole = keep(whole, "sums")
        done.append(whole)
        tops = whole.where("NOT heavy AND d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")).agg(*[F.sum(s).alias(s) for s in names])
        tops = keep(tops, "hung")
        pending = tops if pending is None else pending.unionByName(tops)
    out = valued.drop("class").limit(0)
    for part in done:
        out = out.unionByName(part.select(out.columns))
    return out


def ends_digest(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, x, y, ends_sha256) of the nodes at which conversations end. Ids are put together in
    strings of at most ``2 ** ID_BITS`` neighbouring ones first; a node's strings pass through its
    digest one by one, so a node of any number of copies takes no memory."""
    ends = rows.where("d = len").select(*NODE, "c").unionByName(convs.where("len = 0").select(*[F.lit(0).cast("long").alias(k) for k in NODE], "c"))
    ids = ends.groupBy(*NODE, F.shiftright("c", ID_BITS).alias("q")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda i: i.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for d, x, y, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if now == (d, x, y):
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (d, x, y), hashlib.sha256()
                state.update(text.encode())
            if out:
                yield _digest_rows(out)
        if now is not None:
            yield _digest_rows([(*now, state.hexdigest())])

    return ids.repartition(*NODE).sortWithinPartitions(*NODE, "q").select(*NODE, "q", "ids").mapInArrow(digests, "d long, x long, y long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*NODE, "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the tree of all rebuilt ``conversations`` (conv_id, turn, role, text): conv_id (smallest
    member), depth, parent_conv_id (of the parent), n_convs, n_children, n_leaves and saved_tokens
    (over the subtree), ends_sha256 (of the conversations that end here); and node and parent, keys of the node and of its parent.

    Nulls: a null turn comes first, a null role or text is empty, rows without a conv_id are in no
    conversation. Rows of one turn are in the order of hashes of role and text; repeated rows are
    turns of their own. Without any conversation there is no node, not even the root. Texts count
    whole; other columns are not read. The family of a conversation is ``c - c % 100`` as SQL has it (toward zero).
    """
    rows, convs = rebuilt(ranked(conversations))
    rows = keep(prefixes(rows), "prefixes")
    nodes = node_table(rows, convs)
    sums = {"n_leaves": F.expr("if(n_children = 0, 1, 0)"), "saved_tokens": (F.col("n") - 1) * F.col("chars")}
    summed = subtree_sums(paths(nodes), sums)
    # many nodes can have one parent: the sort-merge join lets Spark split its partitions while it runs
    parents = nodes.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("m").alias("parent_conv_id"))
    out = summed.join(ends_digest(rows, convs), NODE, "left").join(parents, ["d", "px", "py"], "left")
    key = lambda d, x, y: F.concat_ws("-", F.col(d).cast("string"), F.lower(F.lpad(F.hex(x), 16, "0")), F.lower(F.lpad(F.hex(y), 16, "0")))
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        key("d", "x", "y").alias("node"), F.when(F.col("d") > 0, F.concat_ws("-", (F.col("d") - 1).cast("string"), F.lower(F.lpad(F.hex("px"), 16, "0")), F.lower(F.lpad(F.hex("py"), 16, "0")))).alias("parent"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(s) + 1),
               lambda i: [CAST(ascii(s[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
               lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 6 AS h
        FROM (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM t GROUP BY c)),
i AS (SELECT a.c, a.n, a.h, least(a.h, coalesce(b.n, 0)) AS base FROM crc a LEFT JOIN crc b ON b.c = a.c - a.c % 100),
w AS (SELECT t.c, i.base + t.k - i.h AS d, r, x FROM t JOIN i USING (c) WHERE t.k > i.h
      UNION ALL SELECT i.c, t.k, r, x FROM i JOIN t ON t.c = i.c - i.c % 100 AND t.k <= i.base),
p AS (SELECT c, d, x, md5(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM w),
q AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), 'root') AS pk FROM p),
node AS (SELECT d, k, any_value(pk) AS pk, count(*) AS n, min(c) AS m, any_value(length(x)) AS chars FROM q GROUP BY d, k
         UNION ALL SELECT 0, 'root', NULL, count(*), min(c), 0 FROM i HAVING count(*) > 0),
kids AS (SELECT pk AS k, count(*) AS n_children FROM node WHERE pk IS NOT NULL GROUP BY pk),
v AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n - 1) * chars AS saved FROM node LEFT JOIN kids USING (k)),
pair AS (SELECT DISTINCT a.k AS top, b.k FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d UNION ALL SELECT 'root', k FROM node),
sub AS (SELECT top AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved FROM pair JOIN v USING (k) GROUP BY top),
last AS (SELECT i.c, coalesce(max_by(p.k, p.d), 'root') AS k FROM i LEFT JOIN p USING (c) GROUP BY i.c),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM last GROUP BY k)
SELECT v.m AS conv_id, CAST(v.d AS BIGINT) AS depth, u.m AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM v JOIN sub USING (k) LEFT JOIN ends USING (k) LEFT JOIN v u ON u.k = v.pk
"""
}
