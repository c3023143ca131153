"""The pipeline's stages one after the other on the small tables."""

import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute
from tidewatch.llm import common, sequence_packing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_of_nothing_and_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "line").withColumnsRenamed({"source": "n_words"})
    none = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 1), (1, "", None, "s", 1), (1, "", None, "s", 1), (None, "a b", "xx", "s", 1)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.isEmpty() and (name == "packing" or out.columns == docs.columns), name
        kept = stage(spark, odd, SF).count()
        assert kept == {"quality_rules": 0, "line_dedup": 5, "ngram_jaccard": 3, "decontamination": 5, "packing": 5}[name], (name, kept)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).persist()
        assert docs.columns == columns
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 50
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(brute.contamination(t, items)[4] for t in list(texts.values())[:40])
    sets = {i: brute.shingles(t, 5) for i, t in texts.items()}
    comp = brute.components(sets, 80)
    assert all(comp[i] == i for i in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(texts)


class Taken:
    """Stands for a DataFrame: ``mapInArrow`` gives the function of the task."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_a_task_gives_back_what_it_freed():
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    pins = []

    def work(batch):
        some = [np.ones(100_000, np.uint8) for _ in range(3000)]
        pins.append(np.ones(50_000, np.uint8))  # above the others in the heap, so that it can't shrink from its end
        assert held() > before + 200
        del some
        return batch

    before = held()
    assert len(list(common.arrow_map(Taken(), work, "")([pa.RecordBatch.from_pydict({"text": ["a"]})]))) == 1
    assert held() < before + 100


def test_the_plan_of_a_packing_starts_no_python_workers(spark):
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2, 3], "text": ["a", "b c", "d"]}))
    plan = sequence_packing.pack_documents(docs)._jdf.queryExecution().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan and "ExistingRDD" not in plan
