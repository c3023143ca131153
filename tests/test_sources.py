"""Sources, sinks, the stream and the whole run."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.plans import pipeline
from tidewatch.sources import paged, readers
from tidewatch.streaming import weekly


def pages_of(url, headers):
    """Three pages of two records for each region."""
    page = int(url.split("page=")[1].split("&")[0])
    region = url.split("uf=")[1].split("&")[0]
    return json.dumps({"items": [{"casos": page * 10 + i, "uf": region} for i in range(2)], "has_more": page < 3})


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").options(url="http://x/api", regions="AA,BB", start="2015", end="2016", fetch="tests.test_sources:pages_of", size="2", pause="0").load()
    assert df.count() == 2 * 2 * 6
    total = df.select(F.from_json("record", "casos int, uf string").alias("r"), "region").where("r.uf = region").agg(F.sum("r.casos")).first()[0]
    assert total == 4 * (10 + 11 + 20 + 21 + 30 + 31)


def counted_pages(url, headers):
    """As ``pages_of``; each request leaves a line in the file that the url names, and page 2 of a region ``bad`` fails."""
    with open(url.split("//")[1].split("?")[0], "a") as f:
        f.write(url + "\n")
    if "uf=bad" in url and "page=2" in url:
        raise OSError("no page")
    return pages_of(url, headers)


def test_cache_of_chunks(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    log, cache = tmp_path / "requests", tmp_path / "cache"
    requests = lambda: len(log.read_text().splitlines()) if log.exists() else 0

    def read(regions="AA,B B/é", **more):
        options = {"url": f"x://{log}", "regions": regions, "start": "2015", "end": "2016", "fetch": "tests.test_sources:counted_pages", "size": "2", "pause": "0", "cache": f"file://{cache}"}
        return sorted(map(tuple, spark.read.format("paged").options(**options | more).load().collect()))

    first = read()
    assert requests() == 12 and len(first) == 24 and len(list(cache.rglob("*.jsonl"))) == 4
    assert read() == first and requests() == 12
    assert read(refresh="true") == first and requests() == 24
    assert read(regions="AA", query='{"disease": "x"}') and requests() == 30  # another question
    with pytest.raises(Exception, match="no page"):
        read(regions="bad")
    assert not list(cache.rglob("*bad*/*")) and not list(cache.rglob("*.part"))
    half = paged.through_cache(f"file://{cache}", "half", iter([{"a": 1}, {"a": 2}]))
    next(half)
    half.close()
    assert not list(cache.rglob("half*"))
    assert list(paged.through_cache(f"file://{cache}", "none", iter([]))) == [] == list(paged.through_cache(f"file://{cache}", "none", iter([{"a": 1}])))


def test_payload_forms(spark):
    assert paged.payload([{"a": 1}, 2]) == ([{"a": 1}], None, None)
    assert paged.payload({"results": [], "links": {"next": "u"}})[1] == "u"
    assert paged.payload({"data": [{}], "pagination": {"page": 2, "total_pages": 2}})[2] is False
    texts = ['{"items": [{"a": 1}, 2, "x"], "results": [{"b": {"c": [1]}}]}', '[{"a": 3}]', '{"items": 5, "data": []}', "broken", None]
    found = paged.records_of(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id int, t string"), "t").orderBy("record_id").collect()
    assert [(r.record_id, json.loads(r.record)) for r in found] == [(0, {"b": {"c": [1]}}), (1, {"a": 3})]
    seen = list(paged.pages(lambda u, h: json.dumps({"items": [{}], "next": "http://same"}), "http://b", {}, {}, 1))
    assert len(seen) == 2  # the loop of urls ends


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2019, 1, 6), 1), ("B", dt.date(2020, 1, 5), 2)], "state string, date date, cases int").withColumn("year", F.year("date"))
    readers.write_panel(df, str(tmp_path / "p.parquet"), ["year"])
    readers.write_panel(df.where("year = 2020").withColumn("cases", F.lit(9)), str(tmp_path / "p.parquet"), ["year"])
    assert {(r.year, r.cases) for r in readers.read_table(spark, str(tmp_path / "p.parquet")).collect()} == {(2019, 1), (2020, 9)}
    readers.write_jsonl(df, str(tmp_path / "j.jsonl"))
    assert readers.read_table(spark, str(tmp_path / "j.jsonl")).count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "Census 2011.csv").write_text("State,District,Pop-Total\nS,D,5\n")
    (tmp_path / "d" / "notes.csv").write_text("a\n1\n")
    assert readers.load_census(spark, str(tmp_path / "d")).columns == ["state", "district", "pop_total"]
    assert readers.load_census(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    by, missing = readers.manifest(df, [2019, 2020])
    assert by.count() == 2 and {(r.state, r.year) for r in missing.collect()} == {("A", 2020), ("B", 2019)}


def test_weekly_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for d in range(60)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = weekly.read_events(spark, str(tmp_path / "in"), "user_id long, ts timestamp")
    weekly.start(weekly.weekly_counts(stream, "user_id"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.week: r.cases for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[dt.date(2024, 1, 1)] == 7 and len(got) >= 5 and all(w.weekday() == 0 for w in got)


def test_whole_run(spark):
    rows = [(d, s, dt.date(y, 1, 3) + dt.timedelta(7 * w), (w * 3 + y + k) % 11, 10.0 * w, 25.0 + w % 5, 60.0) for k, (d, s) in enumerate((("A", "S"), ("B", "S"))) for y in range(2010, 2014) for w in range(12)]
    raw = spark.createDataFrame(rows, "district string, state string, date date, cases int, rainfall double, temperature double, humidity double")
    cfg = pipeline.config(first_valid=2012, last_valid=2013, train_years=2, run_id="r7")
    out = pipeline.run(raw, cfg)
    m = pipeline.manifest(out, cfg)
    assert m["decision_rows"] == 48 and pipeline.check_manifest(m, "r7") == [] and pipeline.check_manifest(m, "x")
    assert out.metrics.count() == 1
    risk = pipeline.effects_out_of_fold(out.prepared, pipeline.Adapters().folds(spark, cfg))
    assert risk.count() == 48 and risk.where("risk NOT BETWEEN 0 AND 1").isEmpty()
    assert pipeline.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
