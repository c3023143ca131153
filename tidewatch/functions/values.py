"""Null, number and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with a mark and the letters without it.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīįķĺľłńňņōőŕřśşšťţūůűųźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeegiiklllnnnoorrsssttuuuuzzz"
#: Words at the end of a place's name that say what it is.
PLACE_SUFFIX = r"(?:\s+(?:district|dist|distt|dt))+$"
STOP_WORDS = ["and", "of", "the", "de", "da", "do", "district"]


def number(c: Column | str) -> Column:
    """A double, null where the value is no number or NaN."""
    d = F.expr(f"try_cast(`{c}` AS double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """The value within the bounds; null stays null (least and greatest would skip it)."""
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(float(high))).otherwise(out)
    return out


def is_true(c: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.coalesce(c, F.lit(False)).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0 or null."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def text_key(c: Column) -> Column:
    """A name for joins: lower case, marks off, ``&`` as and, other signs as spaces, the words
    for district at the end off (as long as nothing but letters stands behind them)."""
    x = F.regexp_replace(F.lower(c), "&", " and ")
    x = F.translate(x, MARKED, PLAIN)
    x = F.regexp_replace(x, "[^a-z0-9]+", " ")
    x = F.regexp_replace(x, PLACE_SUFFIX, "")
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def token_key(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """The key's distinct words in order, without stop words."""
    words = F.array_except(F.array_distinct(F.split(text_key(c), " ")), F.array(*[F.lit(w) for w in [*stop, ""]]))
    return F.array_join(F.array_sort(words), " ")


def shard(c: Column, shards: int, missing: str = "__missing_district__") -> Column:
    """A stable shard number from the first 32 bits of the name's md5."""
    name = F.lower(F.btrim(F.coalesce(c, F.lit(missing))))
    return F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards))
