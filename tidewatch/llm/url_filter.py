"""URL filter: path rules, then a blocked Bloom filter of listed canonical URLs before an exact join.

Only DataFrame functions. A url's candidates are its host and all parent domains, each with every
prefix of its path that ends in ``/`` and with the whole path. The filter has blocks of eight
64-bit words; a key sets one bit in each word of its block. It grows with the list and reaches the
rows as one scalar subquery of at most ``MAX_BLOCKS`` blocks (16 MB): a list of more than some 8
million entries lets more false candidates pass, and the exact join takes those away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, UPPER, let, table

#: (verdict, host and path): the contract's rules.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
# Sites of the list, each under all three endings. The list itself is a parameter of ``judge``.
SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
ENDINGS = ["com", "net", "org"]
#: Canonical URLs (hosts with all their subdomains, and paths).
LISTED = [f"{site}.example.{ending}/" for site in SITES for ending in ENDINGS]
WORDS = 8
#: 16 MB, which holds about 8 million entries at ``BITS_PER_KEY``.
MAX_BLOCKS = 1 << 18
BITS_PER_KEY = 16


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and where ``://`` is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def fits(host: Column, path: Column, rule: str) -> Column:
    rule_host, _, rule_path = rule.partition("/")
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)


def by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        rule = F.when(fits(host, path, text), text).otherwise(rule)
        verdict = F.when(fits(host, path, text), what).otherwise(verdict)
    return rule, verdict


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host without a closing dot, an empty path as ``/``."""
    return F.regexp_replace(host, r"\.+$", ""), F.when(path == "", "/").otherwise(path)


def candidates(host: Column, path: Column) -> Column:
    """All listed forms that would cover the url."""
    host, path = canonical(host, path)
    labels = F.split(host, r"\.")
    hosts = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    steps = F.split(path, "/")
    paths = F.transform(F.slice(steps, 1, F.size(steps) - 1), lambda _, i: F.concat(F.array_join(F.slice(steps, 1, i + 1), "/"), F.lit("/")))
    paths = F.array_union(paths, F.array(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def places(key: Column, blocks: int) -> list[tuple[Column, Column]]:
    """(index of the word, bit) of each of a key's eight bits."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)) * WORDS
    bits = F.xxhash64(key, F.lit("bit"))
    return [(block + i, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row with one array: the words of the filter of ``listed.key``. At most
    ``blocks * WORDS`` rows leave the aggregation, whatever the list's size."""
    spots = F.explode(F.array(*[F.struct(i.alias("i"), bit.alias("bit")) for i, bit in places(F.col("key"), blocks)]))
    words = listed.select(spots.alias("spot")).select(F.col("spot.i").alias("i"), F.expr("shiftleft(1L, spot.bit)").alias("w"))
    dense = listed.sparkSession.range(blocks * WORDS).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    each = words.unionByName(dense).groupBy("i").agg(F.bit_or("w").alias("w"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "w")))
    return each.agg(F.transform(ordered, lambda x: x["w"]).alias("words"))


def passes(key: Column, words: Column, blocks: int) -> Column:
    out = F.lit(True)
    for i, bit in places(key, blocks):
        out = out & (F.getbit(F.get(words, i.cast("int")), bit) == 1)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """A verdict for each row of ``pages`` (page_id, url).

    ``listed`` has canonical urls in its column ``key`` (host and path; a path that ends in ``/``
    covers all below it, a host all its subdomains). A url under a rule takes the longest fitting
    rule's verdict; any other is blocked if the list covers it and allowed if not. ``listed_by``
    is the longest entry that covers it.

    Nulls: a null url has empty host and path and is allowed; a null page_id is carried along;
    null keys of the list count for nothing. Repeated rows are judged one by one, repeated keys
    once. An empty table gives an empty result, an empty list allows all. Other columns of either
    table are not looked at.
    """
    listed = listed.select(F.col("key").cast("string").alias("key")).where(F.col("key").isNotNull()).distinct()
    n, blocks = listed.count(), 1
    while blocks < MAX_BLOCKS and blocks * WORDS * 64 < n * BITS_PER_KEY:
        blocks *= 2
    host, path = parts(F.col("url"))
    split = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    held = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), bloom(listed, blocks).scalar().alias("words"))
    possible = let(F.col("words"), lambda words: F.filter(candidates(F.col("host"), F.col("path")), lambda key: passes(key, words, blocks)))
    probed = held.select(
        "page_id", "host", "path", "rule", "ruled",
        F.when(F.col("ruled").isNull() & (F.col("host") != ""), possible).otherwise(F.array().cast("array<string>")).alias("possible"),
    )
    clear = probed.where(F.size("possible") == 0)
    maybe = probed.where(F.size("possible") > 0)
    # Only what passes the filter is shuffled; each distinct url is looked up once.
    keys = maybe.groupBy("host", "path").agg(F.first("possible").alias("possible")).select("host", "path", F.explode("possible").alias("key"))
    covered = keys.join(listed, "key").groupBy("host", "path").agg(F.max_by("key", F.length("key")).alias("listed_by"))
    exact = maybe.join(covered, ["host", "path"], "left")
    out = exact.unionByName(clear, allowMissingColumns=True)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed_by").isNotNull(), "block").otherwise("allow")).alias("verdict"), "listed_by")


def listed_frame(spark: SparkSession, keys: list[str] = LISTED) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), listed_frame(spark))


def _sql() -> str:
    rule, verdict = "NULL", "NULL"
    for what, text in sorted(RULES, key=lambda r: len(r[1])):
        rule_host, _, rule_path = text.partition("/")
        test = f"(host = '{rule_host}' OR ends_with(host, '.{rule_host}')) AND starts_with(path, '/{rule_path}')"
        rule, verdict = f"CASE WHEN {test} THEN '{text}' ELSE {rule} END", f"CASE WHEN {test} THEN '{what}' ELSE {verdict} END"
    values = ", ".join(f"('{k}')" for k in LISTED)
    return f"""
WITH listed AS (SELECT key, split_part(key, '/', 1) AS h, substr(key, strpos(key, '/')) AS p FROM (VALUES {values}) v(key)),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM split),
form AS (SELECT *, regexp_replace(host, '[.]+$', '') AS ch, CASE WHEN path = '' THEN '/' ELSE path END AS cp FROM ruled),
found AS (SELECT f.*, (SELECT arg_max(key, length(key)) FROM listed WHERE (f.ch = h OR ends_with(f.ch, '.' || h))
  AND (f.cp = p OR (ends_with(p, '/') AND starts_with(f.cp, p)))) AS by_list FROM form f)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN by_list IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN ruled IS NULL AND host <> '' THEN by_list END AS listed_by FROM found"""


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {"op4_url_filter": _sql()}
