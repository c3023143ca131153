"""Fill-in-middle rearrangement of documents, by array operations on the UTF-8 bytes of whole batches.

A text's bytes get classes from a table of 256 entries; a mask over pairs of adjacent classes says
where a unit (line, word or code point) begins. One cumulative sum over the batch, less its value
at a document's first byte, numbers the units of each document, and one binary search in that sum
finds the cuts of all documents. Texts are cut at bytes and never decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, arrow_map, table

SEED, RATE, SPM = 7, 100, 50
#: Before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM_FORM = "plain", "psm", "spm"
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Units(NamedTuple):
    """``classes``: the class of each byte; ``begins[a, b]``: whether a unit begins at a byte of class ``b`` after one of class ``a``."""

    classes: np.ndarray
    begins: np.ndarray


def _units(inside: bytes, begins: list[list[bool]]) -> Units:
    classes = np.zeros(256, np.uint8)
    classes[list(inside)] = 1
    return Units(classes, np.array(begins))


#: A line ends behind its line feed, a word in front of the next one, so that every byte is in one unit.
UNITS = {
    "line": _units(b"\n", [[False, False], [True, True]]),
    "word": _units(SPACES.encode(), [[False, False], [True, False]]),
    "char": _units(bytes(range(0x80, 0xC0)), [[True, False], [True, False]]),
}
#: 1 for the first byte of a code point.
LEADS = np.array([not 0x80 <= b < 0xC0 for b in range(256)], np.uint8)


class Texts:
    """The bytes of an Arrow column of strings without nulls, as one array; text ``i`` is from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_string()).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]

    def places(self, mark: bytes) -> np.ndarray:
        """Where ``mark`` stands wholly within one text."""
        n = max(0, len(self.data) - len(mark) + 1)
        hit = np.ones(n, bool)
        for j, b in enumerate(mark):
            hit &= self.data[j : j + n] == b
        found = np.flatnonzero(hit)
        return found[self.at[self.text_of(found) + 1] >= found + len(mark)]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, places, "right") - 1


class Numbered:
    """The units of all texts of a batch: ``counts`` of each text, and where any of them begins."""

    def __init__(self, texts: Texts, units: Units) -> None:
        classes = units.classes[texts.data]
        mask = np.empty(len(classes), bool)
        mask[1:] = units.begins[classes[:-1], classes[1:]]
        mask[texts.at[:-1][texts.at[:-1] < texts.at[1:]]] = True
        self.seen = np.cumsum(mask, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)
        upto = np.concatenate([[0], self.seen])[texts.at] if len(mask) < 1 << 20 else np.where(texts.at > 0, self.seen[texts.at - 1], 0)
        self.before, self.counts = upto[:-1].astype(np.int64), np.diff(upto).astype(np.int64)

    def starts(self, k: np.ndarray) -> np.ndarray:
        """The byte where unit ``k`` (from 0, a column for each text) begins; the text's end for its count."""
        return np.searchsorted(self.seen, (self.before + k + 1).astype(self.seen.dtype), "left")


def numbers(doc_ids: Sequence[int | None], seed: int) -> np.ndarray:
    """The first four groups of 8 hex digits of the sha256 of ``seed:doc_id``, as a row each."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def _checked(marks: Sequence[str]) -> list[bytes]:
    out = [m.encode() for m in marks]
    if len(set(out)) != 3 or not all(out) or any(m[0] in other[1:] or (m != other and other.startswith(m)) for m in out for other in out):
        raise ValueError("three marks are needed, none of which begins another, and whose first bytes stand nowhere else in them")
    return out


def rearrange(doc_ids: Sequence[int | None], column: pa.Array, units: str, seed: int, rate: int, spm: int, marks: Sequence[str]) -> pa.RecordBatch:
    """The rows of ``COLUMNS`` for a batch."""
    p, s, m = _checked(marks)
    texts, h = Texts(column), numbers(doc_ids, seed)
    lines = Numbered(texts, UNITS[units])
    k = np.sort(h[:, :2] % (lines.counts[:, None] + 1), axis=1)
    start, end = texts.at[:-1], texts.at[1:]
    one, two = lines.starts(k[:, 0]), lines.starts(k[:, 1])
    marked = np.zeros(len(start), bool)
    for mark in (p, s, m):
        marked[texts.text_of(texts.places(mark))] = True
    plain = (start == end) | marked | (h[:, 2] % 100 >= rate)
    first = h[:, 3] % 100 < spm  # suffix first
    points = np.cumsum(LEADS[texts.data], dtype=np.int64)
    upto = lambda x: np.where(x > 0, points[np.maximum(x, 1) - 1], 0) if len(points) else np.zeros(len(x), np.int64)
    data, parts = memoryview(np.ascontiguousarray(texts.data)), []
    for a, b, c, d, same, suffix_first in zip(start.tolist(), one.tolist(), two.tolist(), end.tolist(), plain.tolist(), first.tolist(), strict=True):
        if same:
            parts.append(data[a:d])
        else:
            parts += (s, data[c:d], p, data[a:b], m, data[b:c]) if suffix_first else (p, data[a:b], s, data[c:d], m, data[b:c])
    at = np.concatenate([[0], np.cumsum(end - start + np.where(plain, 0, len(p) + len(s) + len(m)))]).astype(np.int64)
    output = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(b"".join(parts)))
    forms = pa.array(np.where(plain, PLAIN, np.where(first, SPM_FORM, PSM)), pa.string())
    chars = [pa.array(upto(y) - upto(x), pa.int64(), mask=plain) for x, y in ((start, one), (one, two))]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(lines.counts), forms, *chars, output.cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, units: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: Sequence[str] = MARKS) -> DataFrame:
    """``docs`` (doc_id, text) rearranged: the columns of ``COLUMNS``, one row for each row of ``docs``.

    A text of ``n`` units is cut after two numbers of them that depend on ``seed`` and doc_id;
    ``rate`` in a hundred documents are rearranged, ``spm`` in a hundred of these with the suffix
    first. A text is left as it is (``plain``, no numbers of characters) if it is empty or has one
    of ``marks`` in it. Null texts are empty; a null doc_id counts as the empty number; repeated
    rows are cut alike; an empty table gives an empty one. Texts of any length are cut whole, the
    longest alone in a batch. Columns but doc_id and text are not read.
    """
    if units not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    _checked(marks)
    work = lambda batch: rearrange(batch.column(0).to_pylist(), batch.column(1), units, seed, rate, spm, marks)
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), work, COLUMNS)


def rebuild(forms: Sequence[str], column: pa.Array, marks: Sequence[str]) -> pa.Array:
    """The texts before the rearrangement, of outputs and their forms."""
    all_marks = _checked(marks)
    texts, form = Texts(column), np.array(forms, object)
    moved = np.flatnonzero(form != PLAIN)
    found = np.sort(np.concatenate([texts.places(mark) for mark in all_marks]))
    owner = texts.text_of(found)
    found = found[form[owner] != PLAIN] if len(found) else found
    if not np.array_equal(texts.text_of(found), np.repeat(moved, 3)):
        raise ValueError("an output has not each mark once")
    hits = dict(zip(moved.tolist(), found.reshape(-1, 3).tolist(), strict=True))
    p, s, m = map(len, all_marks)
    data, parts, lengths = memoryview(np.ascontiguousarray(texts.data)), [], []
    for i, (a, d, f) in enumerate(zip(texts.at[:-1].tolist(), texts.at[1:].tolist(), forms, strict=True)):
        if f == PLAIN:
            parts.append(data[a:d])
            lengths.append(d - a)
            continue
        x, y, z = hits[i]
        prefix, suffix = (data[y + p : z], data[x + s : y]) if f == SPM_FORM else (data[x + p : y], data[y + s : z])
        parts += (prefix, data[z + m : d], suffix)
        lengths.append(d - a - p - s - m)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(at), pa.py_buffer(b"".join(parts))).cast(pa.string())


def restored(rows: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``rows`` of ``transform`` with a column ``restored``: the text rebuilt from output and form alone."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = rebuild(batch.column(batch.schema.get_field_index("form")).to_pylist(), batch.column(batch.num_columns - 1), marks)
        return pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "restored"])

    return arrow_map(rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"), work, f"{COLUMNS}, restored string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(transform(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLE_SQL = {
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || substr(k, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(k, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(k, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(k, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""
}
