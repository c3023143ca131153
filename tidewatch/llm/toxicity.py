"""A toxicity score over word beginnings, fitted for each language on a bounded sample of labels.

A part is a beginning of four to eight letters that stands much more often in toxic texts than in
clean ones. A text is toxic if two words, and more than 15 in a thousand, or four words, and more than
5 in a thousand, begin with a part of its language; the parts of all languages count where the language
has none or is unknown. The fit counts the beginnings of the whole sampled texts by aggregation, equal
texts once, so that only the chosen parts reach the driver; the score is one native expression over
whole texts. All of it are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import let

#: Texts of the sample for each language, on average.
TOXIC_ROWS, CLEAN_ROWS = 300, 600
#: Lengths of parts; times that a part is as frequent in toxic texts; toxic texts that a part needs.
SHORTEST, LONGEST, RATIO, LEAST_TEXTS = 4, 8, 12, 4
#: Words with a part, and in how many of a thousand words they must be more: either pair is enough.
BOUNDS = (2, 15), (4, 5)
WORD = r"\p{L}+"


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, toxic, words) of the labelled texts; of languages with many, a share by hash
    that gives the numbers above on average. Equal texts of a language and label are one row."""
    known = labels.where("toxic IS NOT NULL").select("doc_id", (F.col("toxic") == 1).alias("toxic")).distinct()
    known = known.join(docs.where("lang IS NOT NULL").select("doc_id", "lang").distinct(), "doc_id")
    rows = F.when(F.col("toxic"), TOXIC_ROWS).otherwise(CLEAN_ROWS)
    shares = known.groupBy("lang", "toxic").agg(F.floor(rows * F.lit(1_000_000) / F.count(F.lit(1))).alias("share"))
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 1_000_000
    ids = known.join(shares, ["lang", "toxic"]).where(place < F.col("share")).select("doc_id", "lang", "toxic")
    # One row a language: of many labelled texts only those that the share can choose are shuffled.
    most = shares.groupBy("lang").agg(F.max("share").alias("share"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "lang", "text").join(F.broadcast(most), "lang").where(place < F.col("share")).drop("share")
    return texts.join(ids, ["doc_id", "lang"]).dropDuplicates(["lang", "toxic", "text"]).select("doc_id", "lang", "toxic", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"))


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, list[str]]:
    """Parts by language, from ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, toxic),
    without those that begin with another part. Rows without an id, text,
    lang or label are not learned from; without labels there are no parts."""
    sample = sampled(docs, labels).persist()
    try:
        sizes = sample.groupBy("lang").agg(
            F.sum(F.when(F.col("toxic"), F.size("words")).otherwise(0)).alias("bad_words"), F.sum(F.when(~F.col("toxic"), F.size("words")).otherwise(0)).alias("good_words"),
            F.sum(F.col("toxic").cast("int")).alias("bad_texts"),
        )
        lengths = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("word")))
        starts = sample.select("doc_id", "lang", "toxic", F.explode("words").alias("word")).where(F.length("word") >= SHORTEST)
        starts = starts.select("doc_id", "lang", "toxic", F.explode(F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))).alias("part"))
        in_text = starts.groupBy("lang", "part", "toxic", "doc_id").count()
        bad = F.col("toxic")
        counts = in_text.groupBy("lang", "part").agg(F.sum(F.when(bad, F.col("count")).otherwise(0)).alias("bad"), F.sum(F.when(~bad, F.col("count")).otherwise(0)).alias("good"), F.sum(bad.cast("int")).alias("texts"))
        often = (F.col("texts") >= LEAST_TEXTS) & (10 * F.col("texts") >= F.col("bad_texts"))
        chosen = counts.join(F.broadcast(sizes), "lang").where(often & (F.col("bad") * F.col("good_words") >= RATIO * (F.col("good") + 1) * F.col("bad_words")))
        rows = chosen.select("lang", "part").collect()
    finally:
        sample.unpersist()
    out: dict[str, list[str]] = {}
    for lang in sorted({r["lang"] for r in rows}):
        some = {r["part"] for r in rows if r["lang"] == lang}
        out[lang] = sorted(p for p in some if not any(p[:k] in some for k in range(SHORTEST, len(p))))
    return out


def pattern(parts: Iterable[str]) -> str:
    """A regular expression for words that begin with one of ``parts`` (letters only). Parts with the
    same beginning share a branch, so a word is compared letter by letter and not part by part."""
    tree: dict = {}
    for part in sorted(parts):
        at = tree
        for letter in part:
            at = at.setdefault(letter, {})
            if None in at:  # a shorter part says it already
                break
        else:
            at.clear()
            at[None] = {}

    def written(at: dict) -> str:
        some = [letter + written(below) for letter, below in at.items() if letter]
        return "(?:" + "|".join(some) + ")" if len(some) > 1 else "".join(some)

    return r"(?<!\p{L})" + written(tree)


def over(k: Column, n_words: Column) -> Column:
    """Whether ``k`` of ``n_words`` words are enough by one of ``BOUNDS``."""
    (few, dense), (many, thin) = BOUNDS
    return (k >= few) & (1000 * k > dense * n_words) | (k >= many) & (1000 * k > thin * n_words)


def is_toxic(text: Column, lang: Column, n_words: Column, parts: dict[str, list[str]]) -> Column:
    """Whether the score of a text is over the bound; never null."""
    if not parts:
        return F.lit(False)
    count = lambda some: F.regexp_count(F.lower(text), F.lit(pattern(some)))
    found = F
    for name, some in parts.items():
        found = found.when(lang == name, count(some))
    found = found.otherwise(count({p for some in parts.values() for p in some}))
    return F.coalesce(let(found, lambda k: over(k, n_words)), F.lit(False))


#: The parts as SQL over the tables documents and labels: a table parts (lang, part).
PARTS_SQL = rf"""known AS (SELECT DISTINCT l.doc_id, d.lang, l.toxic = 1 AS toxic FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL AND d.lang IS NOT NULL),
shares AS (SELECT lang, toxic, floor(CASE WHEN toxic THEN {TOXIC_ROWS} ELSE {CLEAN_ROWS} END * 1000000 / count(*)) AS share FROM known GROUP BY lang, toxic),
ids AS (SELECT doc_id, lang, toxic FROM known JOIN shares USING (lang, toxic) WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < share),
sample AS (SELECT min(doc_id) AS doc_id, lang, toxic, regexp_extract_all(lower(text), '{WORD}') AS words FROM documents JOIN ids USING (doc_id, lang) WHERE text IS NOT NULL GROUP BY lang, toxic, text),
sizes AS (SELECT lang, sum(CASE WHEN toxic THEN len(words) ELSE 0 END) AS bad_words, sum(CASE WHEN toxic THEN 0 ELSE len(words) END) AS good_words, count(*) FILTER (toxic) AS bad_texts FROM sample GROUP BY lang),
starts AS (SELECT doc_id, lang, toxic, substr(word, 1, k) AS part FROM (SELECT doc_id, lang, toxic, unnest(words) AS word FROM sample), unnest(range({SHORTEST}, {LONGEST + 1})) u(k) WHERE length(word) >= k),
counts AS (SELECT lang, part, count(*) FILTER (toxic) AS bad, count(*) FILTER (NOT toxic) AS good, count(DISTINCT CASE WHEN toxic THEN doc_id END) AS texts FROM starts GROUP BY lang, part),
chosen AS (SELECT lang, part FROM counts JOIN sizes USING (lang) WHERE texts >= {LEAST_TEXTS} AND 10 * texts >= bad_texts AND bad * good_words >= {RATIO} * (good + 1) * bad_words),
parts AS (SELECT lang, part FROM chosen c
  WHERE NOT EXISTS (SELECT 1 FROM chosen s WHERE s.lang = c.lang AND length(s.part) < length(c.part) AND starts_with(c.part, s.part)))"""
#: ``over`` as SQL.
OVER_SQL = " OR ".join(f"toxic_words >= {k} AND 1000 * toxic_words > {share} * n_words" for k, share in BOUNDS)
