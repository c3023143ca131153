"""Token ids in binary files, in ascending order of doc_id, with Elias-Fano coded boundaries.

Documents are dealt to shards of neighbouring ids, whose edges come from a histogram of the ids;
each task encodes its texts, a shuffle brings a shard's documents together, and one task sorts and
writes them. The files are a data source of their own (``token_files``): a task writes under
names that no other attempt uses, and what a job has written counts only with its manifest.

A file, little-endian, is: the ids of its documents one after the other (2 bytes each if the
vocabulary allows it, else 4); the Elias-Fano code of where each document ends; that of the
doc_ids (``elias_fano``); and ``_FOOT``. Documents without a doc_id come first and are only counted.
``manifest.json`` lists the files in order, with the documents and ids of each and the ids before it.
"""

from __future__ import annotations

import atexit
import functools
import itertools
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewatch.llm.common import _delete, arrow_map, scratch_dir, table
from tidewatch.llm.elias_fano import EliasFano, encode

END = 2
#: Documents of a shard, about, while that makes no more shards than ``MOST_SHARDS``; then shards grow.
SHARD_DOCS, MOST_SHARDS = 8192, 10_000
#: Bins of the first histogram of ids, and of a bin that is cut again.
BINS, SUB_BITS = 8192, 6
#: A file is closed after so many ids or documents; the next document opens another one.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 22
#: Bytes of ids, and documents, that a reader has in memory at a time, but for longer single documents.
READ_BYTES, READ_DOCS = 1 << 22, 8192
#: Pieces whose ids a worker remembers at most: half of them since the last turn, and half from before it.
CACHE_RUNS = 1_200_000
MANIFEST, MAGIC = "manifest.json", b"TOKEF001"
_FOOT = struct.Struct("<IIIIQQ8s")  # bytes of an id, documents, of these without doc_id, bytes of the ends' code, of the doc_ids' code, ids, magic

#: White space of the pre-tokenizer's pattern. No token has a character in front of white space and that white space in it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Stands alone in the vocabulary, so it never joins its neighbours; new runs are encoded in lines with it between.
MARK, TOGETHER = " \x01", 64


def _run(piece: str) -> str:
    """What a piece stands for: itself after a line end, the start of a text (after a space), or else with a space before."""
    return piece[1:] if piece[0] == " " else piece if piece[0] == "\n" else f" {piece}"


def _sound(piece: str) -> bool:
    """Whether a piece has no white space at its ends, so that its text may be cut there."""
    body = piece[1:] if piece[:1] in (" ", "\n") else piece
    return body != "" and body == body.strip()


class Ids:
    """Token ids of texts, the same as the tokenizer gives for whole texts.

    White space begins a new token wherever it follows other characters, so a text's ids are those
    of its runs (white space, then other characters) one after the other. Where each white space that
    is cut at is one space or line end between others, the runs are the text's pieces at spaces, which a
    worker remembers; other texts are cut by ``_RUNS``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        alone = self.tokenizer.encode(MARK[1:], add_special_tokens=False).tokens
        self.together = len(self.mark) == 2 and len(alone) == 1 and sum(alone[0] in t for t in self.tokenizer.get_vocab()) == 1

    def of_all(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_RUNS // 2:
            self.before, self.cache = self.cache, {}
        cache = self.cache
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        for pieces in cut:
            pieces[0] = f" {pieces[0]}"
        ids = [list(map(cache.get, pieces)) for pieces in cut]
        gaps = [[k for k, x in enumerate(known) if x is None] for known in ids]
        new = {pieces[k] for pieces, ks in zip(cut, gaps, strict=True) for k in ks}
        cache.update((p, x) for p in new if (x := self.before.get(p)) is not None)
        learned = [p for p in new if p not in cache and (p == p.strip() != "" or _sound(p))]
        self.learn(learned, [_run(p) for p in learned], cache)
        out = []
        for text, pieces, known, ks in zip(texts, cut, ids, gaps, strict=True):
            for k in ks:
                known[k] = cache.get(pieces[k])
            out.append(self.by_runs(text) if any(known[k] is None for k in ks) else b"".join(known))
        return out

    def by_runs(self, text: str) -> bytes:
        runs = _RUNS.findall(text)
        if len(self.runs) > CACHE_RUNS // 4:
            self.runs.clear()
        new = [r for r in dict.fromkeys(runs) if r not in self.runs]
        self.learn(new, new, self.runs)
        return b"".join([self.runs[r] for r in runs])

    def learn(self, keys: list[str], runs: list[str], cache: dict[str, bytes]) -> None:
        """The ids of each run go into ``cache`` under its key."""
        alone = [not self.together or r[0] not in " \n" or MARK[1:] in r or r.isspace() for r in runs]
        if any(alone):
            rest = list(itertools.compress(keys, alone)), list(itertools.compress(runs, alone))
            keys, runs = ([x for x, y in zip(some, alone, strict=True) if not y] for some in (keys, runs))
            for at in range(0, len(rest[0]), 4096):
                found = self.tokenizer.encode_batch_fast(rest[1][at : at + 4096], add_special_tokens=False)
                cache.update(zip(rest[0][at : at + 4096], [np.array(e.ids, self.kind).tobytes() for e in found], strict=True))
        for at in range(0, len(runs), 64 * TOGETHER):
            part = runs[at : at + 64 * TOGETHER]
            lines = [MARK.join([*part[i : i + TOGETHER], ""]) for i in range(0, len(part), TOGETHER)]
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], self.kind)
            ends = self.width * (np.flatnonzero(ids == self.mark[1]) - 1)
            data, starts = ids.tobytes(), [0, *(ends + 2 * self.width).tolist()]
            cache.update(zip(keys[at : at + 64 * TOGETHER], [data[a:b] for a, b in zip(starts, ends.tolist())], strict=True))  # noqa: B905


@functools.cache
def ids_for(path: str) -> Ids:
    """One tokenizer and cache for each worker process, which has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


def shard_edges(docs: DataFrame, per_shard: int = SHARD_DOCS, most: int = MOST_SHARDS) -> list[int]:
    """The least doc_ids of all shards but the first. Reads doc_ids only; at most ``BINS`` counts reach
    the driver at first, then ``2 ** SUB_BITS`` for each bin that is too large for a shard."""
    n, least, largest = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return []
    share, shift = max(per_shard, -(-n // most)), 0
    while (largest >> shift) - (least >> shift) >= BINS:
        shift += 1
    known = docs.where("doc_id IS NOT NULL")
    count = lambda rows, bits: {r["bin"]: r["count"] for r in rows.groupBy(F.shiftright("doc_id", bits).alias("bin")).count().collect()}
    level, bins = count(known, shift), {}
    while large := [b for b, k in level.items() if k > share and shift]:
        bins |= {b << shift: k for b, k in level.items() if k <= share}
        some = F.broadcast(docs.sparkSession.createDataFrame([(b,) for b in large], "large long"))
        rows, shift = known.join(some, F.shiftright("doc_id", shift) == F.col("large"), "left_semi"), max(0, shift - SUB_BITS)
        level = count(rows, shift)
    bins |= {b << shift: k for b, k in level.items()}
    edges, held = [], 0
    for low, k in sorted(bins.items()):
        if held and held + k > share:
            edges.append(low)
            held = 0
        held += k
    return edges


def tokens(docs: DataFrame, tokenizer: str, end: int = END, edges: list[int] | None = None) -> DataFrame:
    """(shard, doc_id, ids): the ids of each whole text and ``end``, as bytes of one width for all."""
    at = np.array(edges or [], np.int64)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = ids_for(tokenizer)
        last = np.array([end], known.kind).tobytes()
        ids = [x + last for x in known.of_all(batch.column(1).to_pylist())]
        doc_id = batch.column(0)
        low = np.iinfo(np.int64).min
        shard = np.searchsorted(at, doc_id.fill_null(low).to_numpy(zero_copy_only=False), "right")
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), doc_id, pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), work, "shard int, doc_id long, ids binary")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class FileOut:
    """A file in the making: ids go out as they come, ends and doc_ids are kept until it is closed."""

    def __init__(self, folder: str, shard: int, width: int) -> None:
        self.fs, where = opened(folder)
        self.name, self.width, self.shard = f"{shard:06d}-{uuid.uuid4().hex}.tok", width, shard
        self.path = f"{where}/{self.name}"
        self.fs.create_dir(where)
        self.out = self.fs.open_output_stream(self.path)
        self.ends: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.n_docs = self.n_ids = self.nulls = 0
        self.first: int | None = None

    def add(self, doc_ids: np.ndarray, nulls: int, ids: memoryview, lengths: np.ndarray) -> None:
        """Documents in order, of which the first ``nulls`` have no doc_id."""
        self.out.write(ids)
        if self.first is None and len(doc_ids):
            self.first = int(doc_ids[0])
        self.ends.append(self.n_ids + np.cumsum(lengths))
        self.doc_ids.append(doc_ids)
        self.nulls += nulls
        self.n_docs += len(lengths)
        self.n_ids += int(lengths.sum())

    def close(self) -> tuple:
        ends, doc_ids = encode(np.concatenate(self.ends)), encode(np.concatenate(self.doc_ids))
        self.out.write(ends + doc_ids + _FOOT.pack(self.width, self.n_docs, self.nulls, len(ends), len(doc_ids), self.n_ids, MAGIC))
        self.out.close()
        return self.shard, self.first, self.name, self.n_docs, self.n_ids


class TokenFile:
    """A written file: documents by number or doc_id, without reading the others."""

    def __init__(self, path: str) -> None:
        fs, where = opened(path)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        foot = self.file.read_at(_FOOT.size, size - _FOOT.size)
        self.width, self.n_docs, self.nulls, n_ends, n_doc_ids, self.n_ids, magic = _FOOT.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.kind = np.dtype(f"<u{self.width}")
        at = size - _FOOT.size - n_doc_ids
        self.doc_ids, self.ends = EliasFano(self.file.read_at(n_doc_ids, at)), EliasFano(self.file.read_at(n_ends, at - n_ends))

    def bounds(self, start: int, end: int) -> np.ndarray:
        """Where the documents ``start`` to ``end - 1`` begin and the last of them ends, in ids of this file."""
        ends = self.ends.values(max(0, start - 1), end)
        return ends if start else np.concatenate([[0], ends])

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), self.kind)

    def document(self, k: int) -> np.ndarray:
        a, b = self.bounds(k, k + 1).tolist()
        return self.ids(a, b)

    def find(self, doc_id: int) -> int | None:
        """The number of the first document of this doc_id."""
        k = self.doc_ids.first_from(doc_id)
        return self.nulls + k if k < len(self.doc_ids) and self.doc_ids[k] == doc_id else None

    def batches(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """(doc_ids, bounds, ids) of all documents in order, in parts of bounded size."""
        for start in range(0, self.n_docs, READ_DOCS):
            end = min(self.n_docs, start + READ_DOCS)
            at = self.bounds(start, end)
            nulls = max(0, min(self.nulls, end) - start)
            doc_ids = [None] * nulls + self.doc_ids.values(max(0, start - self.nulls), end - self.nulls).tolist()
            i = 0
            while i < end - start:
                j = max(i + 1, int(np.searchsorted(at, at[i] + READ_BYTES // self.width, "right")) - 1)
                yield doc_ids[i:j], at[i : j + 1], self.ids(int(at[i]), int(at[j]))
                i = j


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple]


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.width, self.overwrite = options["path"].rstrip("/"), int(options["width"]), overwrite
        self.file_ids, self.file_docs = int(options.get("fileids", FILE_IDS)), int(options.get("filedocs", FILE_DOCS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[tuple] = []
        out: FileOut | None = None
        for batch in iterator:
            shards, doc_ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ids = batch.column(2).cast(pa.large_binary())
            at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
            data, i = memoryview(ids.buffers()[2]), 0
            while i < len(ids):
                j = i + int(np.searchsorted(shards[i:], shards[i], "right"))
                if out and (out.shard != shards[i] or out.n_ids >= self.file_ids or out.n_docs >= self.file_docs):
                    files.append(out.close())
                    out = None
                out = out or FileOut(self.folder, int(shards[i]), self.width)
                room = at[i] + self.width * (self.file_ids - out.n_ids)
                j = min(j, i + self.file_docs - out.n_docs, max(i + 1, int(np.searchsorted(at, room, "left"))))
                part = doc_ids.slice(i, j - i)
                out.add(part.drop_null().to_numpy(zero_copy_only=False), part.null_count, data[at[i] : at[j]], np.diff(at[i : j + 1]) // self.width)
                i = j
        if out:
            files.append(out.close())
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the files, in order, and then removes what attempts that do not count have left."""
        fs, where = opened(self.folder)
        if not self.overwrite and fs.get_file_info(f"{where}/{MANIFEST}").type != pafs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.folder} has token files already")
        files = [tuple(f) for m in messages if m for f in m.files]
        # a shard's files are one task's, in the order in which it wrote them
        rank = {f[2]: k for k, f in enumerate(files)}
        files.sort(key=lambda f: (f[0], rank[f[2]]))
        listed, before = [], 0
        for _, first, name, n_docs, n_ids in files:
            listed.append([name, n_docs, n_ids, before, first])
            before += n_ids
        fs.create_dir(where)
        with fs.open_output_stream(f"{where}/{MANIFEST}.new") as f:
            f.write(json.dumps({"version": 1, "width": self.width, "files": listed}).encode())
        if self.overwrite and fs.get_file_info(f"{where}/{MANIFEST}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{where}/{MANIFEST}")
        fs.move(f"{where}/{MANIFEST}.new", f"{where}/{MANIFEST}")
        for info in fs.get_file_info(pafs.FileSelector(where)):
            if info.base_name.endswith(".tok") and info.base_name not in rank:
                fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, where = opened(self.folder)
        for name in (f[2] for m in messages if m for f in m.files):
            fs.delete_file(f"{where}/{name}")


class OneFile(InputPartition):
    def __init__(self, name: str, before: int) -> None:
        self.name, self.before = name, before


def manifest(folder: str) -> dict:
    fs, where = opened(folder)
    with fs.open_input_stream(f"{where}/{MANIFEST}") as f:
        return json.loads(f.read())


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")

    def partitions(self) -> list[OneFile]:
        return [OneFile(name, before) for name, _, _, before, _ in manifest(self.folder)["files"]] or [OneFile("", 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        for doc_ids, at, ids in TokenFile(f"{self.folder}/{partition.name}").batches():
            data = pa.py_buffer(ids.astype("<u4"))
            places = pa.py_buffer((4 * (at - at[0])).astype(np.int64))
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc_ids), [None, places, data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(partition.before + at[:-1]), pa.array(np.diff(at)), column], names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """``token_files``: rows (shard, doc_id, ids), sorted within each task, are written; (doc_id, start,
    n_tokens, ids) are read, ``start`` over all files, ``ids`` as little-endian 32-bit bytes."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options), overwrite)


def _uri(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would use for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, per_shard: int = SHARD_DOCS, overwrite: bool = False, **limits: int) -> None:
    """The token ids of all ``docs`` (doc_id, text), each with ``end`` behind it, as files below ``path``,
    a folder that driver and executors share and that ``pyarrow.fs`` can open.

    Documents are in ascending order of doc_id; those without one come first, and rows of one
    doc_id are in the order of their ids. A null text is an empty one. Texts of any length are
    encoded whole. An empty table gives a manifest without files. Other columns are not read.
    ``limits``: ``fileids`` and ``filedocs``, after which a file is closed, so that a shard of any
    size is written with bounded memory. A doc_id is in one shard, however often it is repeated.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    edges = shard_edges(docs.select(F.col("doc_id").cast("long").alias("doc_id")), per_shard)
    rows = tokens(docs, str(tokenizer), end, edges).repartitionById(len(edges) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    out = rows.write.format("token_files").option("path", _uri(spark, path)).option("width", ids_for(str(tokenizer)).width)
    for name, value in limits.items():
        out = out.option(name, value)
    out.mode("overwrite" if overwrite else "append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files below ``path``."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("path", _uri(spark, path)).load()


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    atexit.register(_delete, spark, path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op12_token_files": op12_token_files}
ORACLE_SQL: dict = {}
