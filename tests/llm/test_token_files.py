"""Token files against the tokenizer on whole texts, and the boundaries' code against plain arrays."""

import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import token_files as tf
from tidewatch.llm.elias_fano import EliasFano, encode

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(-(2**63), 2**63 - 1), st.integers(0, 50)), max_size=40), st.integers(0, 41), st.integers(0, 41))
def test_code_of_any_rising_numbers(numbers, a, b):
    values = np.array(sorted(numbers), np.int64)
    ef = EliasFano(encode(values))
    assert len(ef) == len(values) and ef.values(a, b).tolist() == values[a:b].tolist()
    for x in numbers[:5]:
        assert ef.first_from(x) == np.searchsorted(values, x)


def test_code_is_small_and_selects_anywhere():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(0, 900, 200_000))
    data = encode(values)
    ef = EliasFano(data)
    assert 8 * len(data) / len(values) < np.log2(values[-1] / len(values)) + 2.6
    assert np.array_equal(ef.values(0, len(ef)), values)
    for i in rng.integers(0, len(values), 50).tolist():
        assert ef[i] == values[i] and ef.values(i, i + 700).tolist() == values[i : i + 700].tolist()
    with pytest.raises(ValueError):
        encode(np.array([2, 1]))


ODD = ["", " ", "\n", "  a", "a  ", "a \n b", "it's 'S we'll I'M", "'s", "!'s ''s", "\x01 a\x01b", " \x01", "a\x1cb !\x1c!", "\x85a\x85", "é　ü", "12ab 3.5", "<|endoftext|> a<|endoftext|>", "a\t\tb\r\n\r\nc", "\U0001f600\U0001f600", "x​z", "a  b", "~~~ ###", "﻿a", "İıſß"]


def test_runs_have_the_tokenizers_ids(tokenizer):
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "'s", "'", "!", "7", "é", "\x01", "\x1c", "\x85", "　", "\t", "\U0001f600", "<|endoftext|>", "<|", "ing"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    ids = tf.Ids(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert ids.together and ids.width == 2
    for _ in range(2):  # anew, then from memory
        for text, got in zip(texts, ids.of_all(texts), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


class Counted:
    """A tokenizer that keeps what it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_stay_known_while_they_are_used(monkeypatch, tokenizer):
    ids = tf.Ids(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids.tokenizer = asked = Counted(ids.tokenizer)
    monkeypatch.setattr(tf, "CACHE_RUNS", 8)
    for i in range(20):
        text = f"so word, {chr(97 + i)}q\nword {chr(97 + i)}z"
        assert np.frombuffer(ids.of_all([text])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert "".join(asked.asked).count(" word,") == 1 and len(ids.cache) + len(ids.before) <= 16


def test_texts_with_other_white_space_are_cut_by_runs(tokenizer):
    ids = tf.Ids(str(public_tokenizers.path("byte_bpe_50k.json")))
    for text in ["a b", "\na b", "a b\nc", "a\tb c", "a  b", "a \nb", "a\n b", "a\n\nb c", "a\r\nb", " a b", "a b ", "a\t b", "a \tb", "\x85 a", "a \x85", "a\u3000 b", "a \x1cb", " ", "\n", ""]:
        assert np.frombuffer(ids.of_all([text])[0], "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
        assert bool(ids.runs) == (text not in ("a b", "a b\nc", "a\tb c", "")), text
        ids.runs.clear()


def rows():
    rng = random.Random(2)
    out = [(i, " ".join(rng.choice(["alpha", "beta.", "Γ", "12", "\n"]) for _ in range(rng.randint(0, 50)))) for i in [rng.randint(-(2**62), 2**62) for _ in range(150)]]
    out += [(i, f"near {i}") for i in range(1000, 1400)] + [(5, t) for t in ("b", "a", "b", "")] * 20
    return out + [(None, "none"), (None, None), (7, None), (2**63 - 1, "last"), (-(2**63), "first"), (8, "word " * 200_000)]


def expected(data, tokenizer):
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in data]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    out, at = [], 0
    for i, x in ids:
        out.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return out


@pytest.mark.parametrize(("per_shard", "limits"), [(50, {}), (60, {"fileids": 900, "filedocs": 25}), (10**6, {})])
def test_files_hold_all_documents_in_order(spark, tmp_path, tokenizer, per_shard, limits):
    data = rows()
    docs = spark.createDataFrame([(9, t, "x", i, 4) for i, t in data], "start long, text string, ids string, doc_id long, shard int").repartition(5)
    path = f"file://{tmp_path}/tokens"
    tf.write(docs, path, per_shard=per_shard, **limits)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tf.read(spark, path).orderBy("start").collect()]
    assert got == expected(data, tokenizer)
    listed = tf.manifest(path)["files"]
    assert len(listed) > 1 or per_shard == 10**6
    name = next(f[0] for f in listed if f[4] is not None and f[4] <= 1200 and f[1] > 1)
    file = tf.TokenFile(f"{path}/{name}")
    k = file.n_docs - 1
    doc_id = file.doc_ids[k - file.nulls]
    assert file.document(file.find(doc_id)).tolist() in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in data if i == doc_id]
    assert file.find(doc_id + 1) is None if doc_id < 2**62 else True
    with pytest.raises(Exception, match="already"):
        tf.write(docs, path)
    assert tf.manifest(path)["files"] == listed
    tf.write(docs.where("doc_id = 5"), path, overwrite=True)
    assert tf.read(spark, path).count() == 80 and len(list((tmp_path / "tokens").glob("*.tok"))) == 1


def test_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = f"file://{tmp_path}/t"
    tf.write(docs, path)
    assert tf.read(spark, path).isEmpty() and json.loads((tmp_path / "t" / tf.MANIFEST).read_text())["files"] == []


def test_what_a_lost_attempt_left_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "000000-lost.tok").write_bytes(b"half a file")
    tf.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path)
    assert tf.read(spark, path).count() == 1 and not (tmp_path / "t" / "000000-lost.tok").exists()


def test_edges_split_ids_evenly_however_they_lie(spark):
    ids = [2**60 + i for i in range(3000)] + list(range(0, 3000)) + [-(2**63), 2**63 - 1] + [77] * 500
    edges = tf.shard_edges(spark.createDataFrame([(i,) for i in ids], "doc_id long"), 100, 1000)
    dealt = np.bincount(np.searchsorted(edges, np.array(ids), "right"))
    assert edges == sorted(edges) and dealt.max() <= 600 and np.sort(dealt)[-2] <= 200 and len(edges) < 130
