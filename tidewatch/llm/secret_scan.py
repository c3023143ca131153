"""Secret scan: patterns, and sliding-window entropy by character class with an allow-list.

A candidate is a maximal run of a class's characters. A window slides over it; the counts of its
characters and the sum of ``c * log2(c)`` change by one character in and one out, so each step is
constant work. Windows at or above the class's entropy are joined to spans. The work on a text
needs nothing from other texts, so the operator is one map over the whole table.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, table

# The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``pattern`` are candidates; a window of ``window`` characters with at least
    ``bits`` bits a character is random enough, if its run has ``kinds`` of the kinds digit,
    capital and small letter at least."""

    kind: str
    pattern: str
    window: int
    bits: float
    kinds: int


CLASSES = [
    CharClass("random_hex", r"[0-9A-Fa-f]{20,}", 20, 2.9, 2),
    CharClass("random_base64", r"[A-Za-z0-9+/=_-]{24,}", 24, 3.9, 3),
    CharClass("random_small", r"[a-z0-9]{24,}", 24, 3.7, 2),
    CharClass("random_capital", r"[A-Z0-9]{24,}", 24, 3.7, 2),
]
KINDS = ["assign", "access", "hex", *(c.kind for c in CLASSES)]
#: What is known to be harmless though it looks random.
ALLOWED = [
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r".*(?i:example|sample|placeholder|dummy|changeme|xxxx).*",
    r".*(?i:abcdefghij|qwertyuiop|0123456789).*",  # alphabets and keyboards
    r"[0-9]+([-/_=+][0-9]+)*",  # plain numbers, dates, telephone numbers
    r"([A-Za-z]+[-/_=+]+)+[A-Za-z]*",  # words joined by signs: slugs and paths
]
ALLOW = re.compile("|".join(f"(?:{p})" for p in ALLOWED))
_LOG = [0.0, 0.0] + [c * math.log2(c) for c in range(2, 257)]


def dense_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Spans of ``run`` that are covered by windows of at least ``bits`` bits of entropy."""
    counts: dict[str, int] = {}
    total, out = 0.0, []  # total: the sum of c * log2(c)
    most = (math.log2(window) - bits) * window
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _LOG[n + 1] - _LOG[n]
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += _LOG[n - 1] - _LOG[n]
        if i >= window - 1 and total <= most + 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def scan(text: str, classes: list[CharClass] = CLASSES, allow: re.Pattern = ALLOW) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text as (start, order of the kind, end)."""
    base = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    base += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    base.sort()
    added: list[tuple[int, int, int]] = []
    for k, c in enumerate(classes, 3):
        new = []
        for m in re.finditer(c.pattern, text):
            run = m[0]
            if bool(re.search("[0-9]", run)) + bool(re.search("[A-Z]", run)) + bool(re.search("[a-z]", run)) < c.kinds or allow.fullmatch(run):
                continue
            new += [(m.start() + a, k, m.start() + b) for a, b in dense_windows(run, c.window, c.bits)]
        added = sorted([*added, *apart(new, sorted([*base, *added]))])
    return base, added


def apart(new: list[tuple[int, int, int]], known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``new`` that overlap none of ``known``; both are ordered, and one walk over both does."""
    out, i, reach = [], 0, 0  # reach: the furthest end of the known spans that start before the new one ends
    for span in new:
        while i < len(known) and known[i][0] < span[2]:
            reach = max(reach, known[i][2])
            i += 1
        if reach <= span[0]:
            out.append(span)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """The secrets of every whole text of ``docs`` (doc_id, text); offsets are code points.

    Nulls: a null text is empty and has no span; a null doc_id is carried along. Repeated rows
    are scanned one by one; an empty table gives an empty result; other columns are not read.
    A span that the entropy adds never overlaps a base span or an earlier added one.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            base, added = scan(text or "")
            n = [sum(1 for x in base if x[1] == k) for k in range(3)]
            rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written([*base, *added]), len(added)))
        cols = list(zip(*rows, strict=True))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE_SQL: dict = {}
