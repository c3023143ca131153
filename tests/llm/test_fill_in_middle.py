"""Fill-in-middle against a plain version, with odd rows, marks in texts and very long texts."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import fill_in_middle as fim

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": "[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+", "char": "(?s)."}


def plain_version(doc_id, text, units="line", seed=7, rate=100, spm=50):
    text = text or ""
    u = re.findall(PATTERNS[units], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return doc_id, len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def corpus():
    rng = random.Random(11)
    out = [(None, "a\nb"), (None, None), (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no end"), (6, "x<P>y\nz"), (7, "<S"), (8, "<M>"), (9, "<\n<P\n>\nP>\n<"), (9, "<\n<P\n>\nP>\n<"), (10, "\r\nÉé\n€\n\U0001f600"), (11, ">\n" * 40)]
    pieces = ["\n", " ", "word", "é", "€uro", "\U0001f600", "<", ">", "<S", "P>", "M", "\t", "\r"]
    return out + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(300)]


def frame(spark, rows):
    return spark.createDataFrame([(7, i, "f", t, "o") for i, t in rows], "n long, doc_id long, form string, text string, output string").repartition(3)


key = lambda r: tuple(map(str, r))


@pytest.mark.parametrize(("units", "rate", "spm"), [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_same_as_plain_version(spark, units, rate, spm):
    rows = corpus()
    if units == "word":  # leading white space is a unit of its own
        rows = [(i, t and t.strip(" \t\n\r")) for i, t in rows]
    docs = frame(spark, rows)
    out = fim.transform(docs, units, rate=rate, spm=spm)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((plain_version(i, t, units, rate=rate, spm=spm) for i, t in rows), key=key)
    back = fim.restored(out).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)


def test_of_nothing_and_of_wrong_parameters(spark):
    none = frame(spark, corpus()).limit(0)
    assert fim.restored(fim.transform(none)).isEmpty()
    for wrong in ({"units": "page"}, {"marks": ("<P>", "<P>", "<M>")}, {"marks": ("<", "<S>", "<M>")}, {"marks": ("", "a", "b")}):
        with pytest.raises(ValueError):
            fim.transform(none, **wrong)
    with pytest.raises(ValueError):
        fim.rebuild(["psm"], pa.array(["<P>a<S>b"]), fim.MARKS)


def test_other_marks_and_sliced_columns():
    texts = [None if i % 7 == 0 else "line\n" * (i % 5) + "tail" * (i % 3) for i in range(50)]
    column = pa.array([t or "" for t in texts])
    marks = ("[prefix]", "{suffix}", "(middle)")
    part = fim.rearrange(list(range(10, 40)), column.slice(10, 30), "line", 7, 100, 50, marks)
    assert fim.rebuild(part.column(2).to_pylist(), part.column(5), marks).to_pylist() == column.slice(10, 30).to_pylist()
    assert any("{suffix}" in x for x in part.column(5).to_pylist())


def test_very_long_text(spark):
    """A text of 20 MB with four million lines beside short ones is cut whole, in time that grows with it."""
    text = "ab\né\n" * 2_000_000 + "end"
    docs = frame(spark, [(i, f"{i}\n" * i) for i in range(20)]).unionByName(spark.range(1).select(F.lit(7).cast("long").alias("n"), F.lit(-5).cast("long").alias("doc_id"), F.lit("f").alias("form"), F.concat(F.repeat(F.lit("ab\né\n"), 2_000_000), F.lit("end")).alias("text"), F.lit("o").alias("output")))
    row = fim.restored(fim.transform(docs)).where("doc_id = -5").select("n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("o"), F.sha2("restored", 256).alias("r")).first()
    want = plain_version(-5, text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert tuple(row) == (*want[1:5], sha(want[5]), sha(text))
