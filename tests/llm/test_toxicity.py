"""The toxicity score of the pipeline's quality stage."""

import random
import re
from collections import Counter

import corpus_pipeline
from tidewatch.llm import quality_rules, toxicity


def test_toxic_texts_of_each_language_go(spark, tmp_path):
    rng, docs, labels, bad = random.Random(3), [], [], set()
    for lang, stem in (("de", "achlich"), ("fr", "réê"), ("en", "loser")):
        words = ["".join(rng.choice("bdfgmnprtuio") for _ in range(5)) for _ in range(300)]
        for i in range(80):
            text = [rng.choice(words) for _ in range(60)]
            if toxic := i % 4 == 0:
                for k in (3, 20, 41):
                    text[k] = stem.title() + rng.choice(["s", "e", "ung", "ou"])
            n = len(docs)
            docs.append((n, " ".join(text), lang))
            bad |= {n} if toxic else set()
            if i < 60:
                labels.append((n, int(toxic)))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.append((len(docs), docs[-4][1], None))  # toxic, in no known language
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = corpus_pipeline.quality(spark, frame, str(tmp_path))
    assert out.columns == frame.columns
    assert {r.doc_id for r in out.collect()} == set(range(len(docs) - 1)) - bad


def test_parts_against_a_plain_count(spark):
    """Nulls, repeated labels and rows, and a language without toxic texts."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    docs, labels = [], [(None, 1), (7, None), (999, 1)]
    for i in range(120):
        lang, toxic = ("de", "fr", None)[i % 3], i % 4 == 0
        docs.append((i, None if i == 5 else " ".join(rng.choice(words[: 20 if toxic else 60]) + ("Übelung!" if toxic and lang == "de" and rng.random() < 0.2 else "") for _ in range(40)), lang))
        labels += [(i, int(toxic))] * (1 + i % 2)
    docs += [(None, "abcd", "de"), docs[0], (500, "", "it")]
    labels.append((500, 0))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    want, label = {}, dict(labels)
    texts_of = {t: (i, x) for i, t, x in docs if None not in (i, t, label.get(i))}  # equal texts count once
    for lang in ("de", "fr", "it"):
        rows = [(i, re.findall(r"[^\W\d_]+", t.lower()), label[i]) for t, (i, x) in texts_of.items() if x == lang]
        bad, good, texts = Counter(), Counter(), Counter()
        for i, found, toxic in rows:
            starts = [w[:k] for w in found for k in range(4, min(8, len(w)) + 1)]
            (bad if toxic else good).update(starts)
            texts.update({(p, i) for p in starts} if toxic else ())
        per_text = Counter(p for p, _ in texts)
        n = [sum(len(f) for _, f, t in rows if t == k) for k in (0, 1)]
        need = max(4, sum(t for *_, t in rows) / 10)
        chosen = {p for p in bad if per_text[p] >= need and bad[p] * n[0] >= 12 * (good[p] + 1) * n[1]}
        if kept := sorted(p for p in chosen if not any(p != q and p.startswith(q) for q in chosen)):
            want[lang] = kept
    assert got == want and want
    assert toxicity.fit(frame, spark.createDataFrame([], "doc_id long, toxic int")) == {}


def test_pattern_is_the_same_as_all_parts():
    rng = random.Random(2)
    for _ in range(200):
        parts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        text = "".join(rng.choice("aabbé 1-") for _ in range(80))
        plain = sum(any(w.startswith(p) for p in parts) for w in re.findall(r"[^\W\d_]+", text))
        assert len(re.findall(toxicity.pattern(parts).replace(r"\p{L}", r"[^\W\d_]"), text)) == plain


def test_score_of_a_language_and_of_none(spark):
    parts = {"de": ["übel"], "en": ["loser"]}
    filler = " ".join(f"{a}{b}" for a in "abcdefgh" for b in ("lder", "mine", "stone", "reed"))
    other = [f"{a}{b}stone" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{b}reed" for a in "abcdefghijklm" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(1, "de", "Übeltat üble übel"), (2, "en", "Losers loser"), (3, "en", "Übel übel"), (4, "it", "losers übel"), (5, None, "übel loser"), (6, "de", "übel xübel"), (7, "de", None), (8, "de", "übel " * 3 + " ".join(other[:600])), (9, "de", "übel " * 4 + " ".join(other[:600])), (10, "de", "übel " * 4 + " ".join(other[:900]))]
    frame = spark.createDataFrame([(i, t and f"{filler} {t}", x) for i, x, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame, parts, ["toxic"]).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: True, 9: False, 10: True}
