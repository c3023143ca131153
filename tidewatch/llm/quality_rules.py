"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample.

Only DataFrame functions. The rules stand in one CASE, so that a document pays only for the
rules up to the first that rejects it. ``filter_documents`` has all rules in the cascade and
computes a measure when its rule is reached; ``judge`` returns the base counts of every document,
so there only the other rules are left to cut short. A document is rejected if any rule rejects
it, so the order moves the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import toxicity
from tidewatch.llm.common import LOWER, SPACE_CLASS, SPACES, UPPER, let, table

#: Words in a window, and the limits of the base rules.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which cost and selectivity are estimated, about; times that a rule is timed.
SAMPLE_ROWS, REPEATS = 1000, 2
Parts = dict[str, list[str]] | None
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of ``window`` words that the text has twice or more.
    Windows are compared by a 64-bit hash within one text."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(rows: Column) -> Column:
            same = lambda a, b: F.get(rows, a)["h"] == b["h"]
            twice = F.filter(rows, lambda x, j: F.coalesce(same(j - 1, x), F.lit(False)) | F.coalesce(same(j + 1, x), F.lit(False)))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), total)

        def total(starts: Column) -> Column:
            new = F.transform(starts, lambda s, j: F.coalesce(F.least(F.get(starts, j + 1) - s, F.lit(window)), F.lit(window)))
            return F.aggregate(new, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, of))

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashes, covered))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def line_counts(text: Column) -> Column:
    """A struct of how many lines with a word there are (n) and how many of these are equal to an earlier one (dup)."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def chars_in(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(name: str, text: Column, words: Column) -> Column:
    """One measure of a text and its words; only what a rule asks for is computed."""
    if name == "n_words":
        return F.size(words).cast("long")
    if name == "word_chars":
        return F.length(F.array_join(words, "")).cast("long")
    if name == "n_repeat_words":
        return repeated_words(words).cast("long")
    if name == "n_symbols":
        return chars_in(text, SYMBOLS).cast("long")
    return line_counts(text) if name == "lines" else text


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules(of: Callable[[str], Column], toxic: Callable[[Column], Column] | None = None) -> list[Rule]:
    """The rules, the two base ones first, over the measures that ``of`` gives by name; ``toxic``: of the number of words,
    whether the toxicity score rejects. Each names its measures once where they are dear, for in a
    branch of a CASE a measure is computed at each mention."""
    text, n = of("text"), of("n_words")
    out = [
        Rule("few_words", n < MIN_WORDS),
        Rule("repeated_windows", 100 * of("n_repeat_words") > MAX_REPEATED * n),
        Rule("symbols", 10 * of("n_symbols") > n),
        Rule("word_length", let(of("word_chars"), lambda k: (k > 15 * n) | (10 * k < 25 * n))),
        Rule("repeated_lines", let(of("lines"), lambda x: 2 * x["dup"] > x["n"])),
        Rule("capitals", chars_in(text, UPPER) > chars_in(text, LOWER)),
        Rule("exclamations", 4 * chars_in(text, "!") > n),
    ]
    return [*out, Rule("toxic", toxic(n))] if toxic else out


def rejected(found: list[Rule], order: list[str]) -> Column:
    """One CASE: the rules in the given order up to the first that rejects; what it does not name comes last."""
    known = {name: k for k, name in enumerate(order)}
    out = F
    for rule in sorted(found, key=lambda r: known.get(r.name, len(known))):
        out = out.when(rule.rejects, True)
    return out.otherwise(False)


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``n_lines`` and ``base_failed`` as further columns."""
    text = F.coalesce(docs["text"], F.lit(""))
    of_words = lambda w: F.struct(*[measure(c, text, w).alias(c) for c in ("n_words", "word_chars", "n_repeat_words")])
    held = docs.withColumns({"_w": let(words_of(text), of_words), "_l": line_counts(text), "n_symbols": measure("n_symbols", text, text)})
    out = held.select(
        *[docs[c] for c in docs.columns], F.col("_w.n_words").alias("n_words"), F.col("_w.word_chars").alias("word_chars"), "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"), F.col("_l.n").alias("n_lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def _counted(toxic_parts: Parts) -> list[Rule]:
    """The rules over the columns of ``with_stats``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = {"text": text, "lines": F.struct(F.col("n_lines").alias("n"), F.col("n_dup_lines").alias("dup"))}
    return rules(lambda name: at.get(name, F.col(name)), _toxic(text, F.col("lang"), toxic_parts) if toxic_parts else None)


def _uncounted(docs: DataFrame, toxic_parts: Parts, body: Callable[[list[Rule]], Column]) -> Column:
    """``body`` of the rules over texts of which nothing is counted yet: only the words are bound
    before the first rule, every other measure is computed when its rule is reached."""
    text = F.coalesce(docs["text"], F.lit(""))
    toxic = _toxic(text, docs["lang"], toxic_parts) if toxic_parts else None
    return let(words_of(text), lambda words: body(rules(lambda name: measure(name, text, words), toxic)))


def _toxic(text: Column, lang: Column, parts: dict[str, list[str]]) -> Callable[[Column], Column]:
    return lambda n: toxicity.is_toxic(text, lang, n, parts)


def ordered_rules(docs: DataFrame, toxic_parts: Parts = None, counted: bool = False, rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' names by falling rejection per second on a sample by hash of about ``rows`` rows.
    Each rule is timed as the only branch of a CASE over the held sample, the best of ``REPEATS`` times,
    and what the same pass takes without a rule is taken off. ``counted``: the base counts are held
    as well, as ``judge`` has them for every row anyway."""
    docs = docs.select("doc_id", "text", *["lang"] * bool(toxic_parts))
    share = min(1.0, rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = (with_stats(sample) if counted else sample).persist()
    try:
        n = max(1, sample.count())
        names = [r.name for r in _counted(toxic_parts)]

        def verdict(k: int | None) -> Column:
            body = lambda some: F.lit(False) if k is None else F.when(some[k].rejects, True).otherwise(False)
            return body(_counted(toxic_parts)) if counted else _uncounted(sample, toxic_parts, body)

        def timed(k: int | None) -> tuple[float, float]:
            passed, best, hits = sample.agg(F.sum(verdict(k).cast("int")).alias("hits")), float("inf"), 0
            for _ in range(REPEATS):
                began = time.perf_counter()
                hits = passed.first()["hits"] or 0
                best = min(best, time.perf_counter() - began)
            return best, hits / n

        empty, _ = timed(None)
        found = [(share / max(cost - empty, 1e-3), name) for k, name in enumerate(names) for cost, share in [timed(k)]]
    finally:
        sample.unpersist()
    return [name for _, name in sorted(found, key=lambda x: (-x[0], x[1]))]


def judge(docs: DataFrame, toxic_parts: Parts = None, order: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text; lang with ``toxic_parts``) with the columns of ``with_stats`` and ``kept``.

    Every row gets its base counts, so only the rules beside these can be cut short; ``toxic_parts`` (of
    ``toxicity.fit``) make the toxicity score one of them. Nulls: a null text is an empty one, has
    no words and so fails a base rule; a null doc_id is carried along; a null lang takes the parts
    of all languages. Repeated rows are judged one by one. An empty table gives an empty result.
    Texts of any length are read whole. Clashing columns: only those named here are taken.
    """
    docs = docs.select("doc_id", "text", *["lang"] * bool(toxic_parts))
    order = ordered_rules(docs, toxic_parts, counted=True) if order is None else order
    return with_stats(docs).withColumn("kept", ~rejected(_counted(toxic_parts), order))


def filter_documents(docs: DataFrame, toxic_parts: Parts = None, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that every rule lets pass, with their own columns; nulls, repeated rows
    and empty tables as in ``judge``. All rules, base ones too, are in the cascade: a text pays for
    its words and for the measures of the rules up to the first that rejects it."""
    order = ordered_rules(docs, toxic_parts) if order is None else order
    return docs.where(~_uncounted(docs, toxic_parts, lambda found: rejected(found, order)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *STATS, "base_failed", "kept")


ORACLE = rf"""
WITH {toxicity.PARTS_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN (SELECT lang FROM parts) THEN lang END AS tongue,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
s AS (SELECT r, k, count(*) OVER (PARTITION BY r, array_to_string(w[k + 1 : k + 8], ' ')) AS c FROM d, unnest(range(0, len(w) - 7)) u(k)),
p AS (SELECT r, count(DISTINCT q) AS n FROM s, unnest(range(k, k + 8)) u(q) WHERE c > 1 GROUP BY r),
x AS (SELECT r, tongue, word, count(*) AS c FROM (SELECT r, tongue, unnest(regexp_extract_all(lower(t), '{toxicity.WORD}')) AS word FROM d) WHERE length(word) >= {toxicity.SHORTEST} GROUP BY ALL),
y AS (SELECT DISTINCT r, word, c FROM x, unnest(range({toxicity.SHORTEST}, {toxicity.LONGEST + 1})) u(k) JOIN parts ON part = substr(word, 1, k) WHERE length(word) >= k AND (tongue IS NULL OR tongue = parts.lang)),
z AS (SELECT r, sum(c) AS toxic_words FROM y GROUP BY r),
b AS (SELECT d.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps,
  length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS small, length(t) - length(replace(t, '!', '')) AS shouts, coalesce(toxic_words, 0) AS toxic_words FROM d LEFT JOIN p USING (r) LEFT JOIN z USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR 10 * word_chars < 25 * n_words
    OR 2 * n_dup_lines > len(ls) OR caps > small OR 4 * shouts > n_words OR {toxicity.OVER_SQL}) AS kept FROM b"""
QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL = {"op8_quality_rules": ORACLE}
