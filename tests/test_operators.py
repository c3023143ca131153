"""Operators on small literal frames: values that can be checked by hand."""

import datetime as dt
import math

import pytest

from tidewatch.functions import dates, values
from tidewatch.operators import clean, decision, features, folds, impute, labels, metrics, models, population, posterior, quality
from pyspark.sql import functions as F


def col(df, c, *order):
    return [r[c] for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def weekly(spark):
    rows = [(d, dt.date(2016, 1, 3) + dt.timedelta(7 * i), c) for d, cs in (("A", [1.0, 2.0, 3.0, 4.0, 5.0]), ("B", [10.0, 11.0, 12.0, 13.0, 14.0])) for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "district string, date date, cases double")


def test_global_thresholds_and_labels(weekly):
    out = labels.choose_label(labels.add_labels(labels.global_thresholds(weekly)), 75)
    assert {(r.district, r.threshold_p75) for r in out.collect()} == {("A", 4.0), ("B", 13.0)}
    assert col(out, "outbreak_label", "district", "date") == [0, 0, 0, 1, 1] * 2
    with pytest.raises(ValueError, match="outbreak_label_p90"):
        labels.choose_label(out, 90)


def test_past_and_next_labels(weekly):
    assert col(labels.past_thresholds(weekly, 0.5, "t").where("district = 'A'"), "t", "date") == [1, 1.5, 2, 2.5, 3]
    assert col(labels.next_step_label(weekly, F.lit(3), "y").where("district = 'A'"), "y", "date") == [0, 0, 1, 1, 0]


def test_temporal_features(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, d), c) for d, c in ((1, 1), (8, 3), (15, 10))], "district string, date date, cases int")
    out = features.temporal(df)
    assert col(out, "case_rolling_mean", "date") == [None, 1, 2]
    assert col(out, "case_rolling_std", "date") == [0, 0, 0]
    assert col(out, "case_velocity", "date") == [None, None, 2]


def test_null_district_is_a_group(spark):
    df = spark.createDataFrame([(None, dt.date(2020, 1, d), c) for d, c in ((1, 1), (8, 3))], "district string, date date, cases int")
    assert col(features.causal(df), "case_lag_1", "date") == [0, 1]
    assert col(labels.global_thresholds(df), "threshold_p75", "date") == [2.5, 2.5]


def test_neighbours_use_the_observation_before(spark):
    a, b = dt.date(2020, 1, 1), dt.date(2020, 1, 8)
    df = spark.createDataFrame([(a, "A", 0.0, 0.0, 1), (a, "B", 1.0, 1.0, 10), (b, "A", 0.0, 0.0, 999), (b, "B", 1.0, 1.0, 999)], "date date, district string, lat double, lon double, cases int")
    edges = features.neighbours(features.centroids(df), k=1)
    assert col(features.neighbour_mean(df, edges), "neighbor_mean_cases", "date", "district") == [None, None, 10, 1]


def test_causality(spark):
    """A change in one row reaches no feature of that row or an earlier one."""
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(7 * i), (i * 7) % 5) for i in range(20)]
    changed = [(d, t, c + 100 if i == 12 else c) for i, (d, t, c) in enumerate(rows)]
    a, b = (features.causal(spark.createDataFrame(r, "district string, date date, cases int")).drop("cases").orderBy("date").collect() for r in (rows, changed))
    assert a[:13] == b[:13] and a[13:] != b[13:]


def test_units_and_dates(spark):
    df = spark.createDataFrame([("A", 3, 1, 2015, 300.15, 1.0), ("A", 31, 2, 2015, 299.15, 1.0)], "district string, day int, mon int, year int, temp double, rainfall double")
    out = clean.clean(df, ["temp", "rainfall"])
    r = out.collect()
    assert len(r) == 1 and r[0].date == dt.date(2015, 1, 3) and round(r[0].temperature, 6) == 27 and r[0].temp_kelvin == 300.15


def test_imputation_keeps_kelvin(spark):
    df = spark.createDataFrame([("A", dt.date(2015, 1, 1), 300.0, None), ("A", dt.date(2015, 1, 8), None, 50.0), ("A", dt.date(2015, 1, 15), 302.0, 150.0)], "district string, date date, temperature double, humidity double")
    out = impute.impute_climate(df)
    assert col(out, "temp_kelvin", "date") == [300, 301, 302] and max(col(out, "temperature", "date")) < 60
    assert col(out, "humidity", "date") == [75, 50, 100]


def test_week_arithmetic(spark):
    df = spark.createDataFrame([(2020, 53), (2021, 53), (2021, 1), (2021, 54), (None, 1)], "y int, w int")
    assert [r[0] for r in df.select(dates.iso_week_start(F.col("y"), F.col("w"))).collect()] == [dt.date(2020, 12, 28), None, dt.date(2021, 1, 4), None, None]
    d = spark.createDataFrame([(dt.date(2020, 1, k),) for k in range(6, 13)], "d date").select(dates.to_anchor(F.col("d"), 6))
    assert [r[0].day for r in d.collect()] == [5, 5, 5, 12, 12, 12, 12]


def test_panel_is_complete(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 5), 2), ("B", dt.date(2020, 1, 19), 3), (None, dt.date(2020, 1, 12), 4)], "district string, date date, cases int")
    out = clean.complete_panel(df, ["district"])
    assert out.count() == 9 and out.agg(F.sum("cases")).first()[0] == 9


def test_shards_are_disjoint_and_cover(spark):
    df = spark.createDataFrame([(f" D{i}",) for i in range(50)] + [(None,)], "district string")
    parts = [clean.memory_filter(df, shards=3, at=k).collect() for k in range(3)]
    assert sum(map(len, parts)) == 51 and len({r.district for p in parts for r in p}) == 51


def test_forbidden_columns(spark):
    df = spark.createDataFrame([(1,) * 6], "outbreak_label int, outbreak_label_p75 int, threshold_p75 int, cases int, case_lag_1 int, rainfall int")
    assert clean.drop_forbidden(df).columns == ["case_lag_1", "rainfall"]


def test_names(spark):
    assert clean.normal_name(" Temp / Max-% ") == "temp_max_pct"
    df = spark.createDataFrame([("São  José & Co District",), ("Foo Dist.",), ("The City of X",)], "n string")
    assert [r[0] for r in df.select(values.text_key(F.col("n"))).collect()] == ["sao jose and co", "foo dist", "the city of x"]
    assert df.select(values.token_key(F.col("n"))).collect()[2][0] == "city x"


def test_population_cascade(spark):
    df = spark.createDataFrame([("S1", "Alpha"), ("S2", "Beta"), ("S1", "Twin"), ("S9", "Gamma")], "state string, district string")
    census = spark.createDataFrame([("S1", "ALPHA district", 1), ("S8", "Beta", 2), ("S2", "Twin", 3), ("S3", "Twin", 4), ("S1", "Alpha", 9)], "state string, district string, population int")
    out = {r.district: r.population for r in population.merge_population(df, census, ["population"]).collect()}
    assert out == {"Alpha": 1, "Beta": 2, "Twin": None, "Gamma": None}


def test_folds(spark):
    df = spark.createDataFrame([(dt.date(y, 1, 1), int(y % 2)) for y in range(2015, 2021)], "date date, y int")
    led = folds.ledger(df, folds.expanding(spark, 2015, 2016, 2021), "y").orderBy("fold").collect()
    assert [(r.train_start, r.train_end, r.valid_year, r.n_train) for r in led[:5]] == [(2015, v - 1, v, v - 2015) for v in range(2016, 2021)]
    assert [r.status for r in led] == ["single_class_train"] + ["yielded"] * 4 + ["empty_slice"]
    assert all(t.agg(F.max(F.year("date"))).first()[0] < v.agg(F.min(F.year("date"))).first()[0] for _, t, v in folds.splits(df, folds.rolling(spark, 2018, 2020), "y"))


def test_decisions(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (1, 0.9)], "y int, p double")
    assert [r[0] for r in df.select((F.col("p") >= decision.cost_loss_threshold(1, 5)).cast("int")).collect()] == [0, 1, 1]
    edge = spark.createDataFrame([(0.29,), (0.3,), (0.5,), (0.7,), (None,)], "p double")
    assert [r[0] for r in edge.select(decision.alert_level(F.col("p"))).collect()] == ["NO_ACTION", "YELLOW", "ORANGE", "RED", "NO_ACTION"]
    best = decision.best_threshold(df, "y", "p", 1, 5).first()
    assert best.threshold == 0.2 and not best.optimized
    best = decision.best_threshold(df, "y", "p", 1, 5, least=3).first()
    assert best.optimized and best.threshold == 0.11 and math.isclose(best.objective_cost, 2 / 3)
    assert decision.decision_frame(df.withColumns({"date": F.current_date(), "district": F.lit("A")}), None, "y", "r", 1, 5).columns == decision.COLUMNS


def test_lead_time(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, i + 1), y, p) for i, (y, p) in enumerate(zip([0, 0, 0, 0, 1], [1, 0, 0, 0, 0], strict=True))], "district string, date date, y int, p int")
    assert metrics.lead_times(df, "y", "p", 2).first().lead == 0
    assert metrics.lead_times(df, "y", "p", None).first().lead == 4
    assert metrics.lead_utility(metrics.lead_times(df.where("y = 0"), "y", "p")).first().lead_utility == 0


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.2)], "y int, p double")
    auc = metrics.roc_auc(df, "y", "p").first()[0]
    assert math.isclose(auc, metrics.roc_auc(df.withColumn("p", F.exp("p") * 3), "y", "p").first()[0]) and math.isclose(auc, 0.5)
    assert math.isclose(metrics.average_precision(df, "y", "p").first()[0], (1 + 2 / 3 + 3 / 5) / 3)
    one = df.where("y = 1")
    assert metrics.roc_auc(one, "y", "p").first()[0] is None and metrics.confusion(one, "y", "p").first().false_alarm_rate is None


def test_quality_gate(spark):
    df = spark.range(30).selectExpr("cast(id AS double) AS a", "1.0D AS b", "cast(NULL AS double) AS c")
    flagged = {r.feature: r.flagged for r in quality.gate(df, ["a", "b", "c"]).collect()}
    assert flagged == {"a": False, "b": True, "c": False} and quality.drop_flagged(df, ["a", "b"]).columns == ["a", "c"]
    assert {r.feature: r.passed for r in quality.validate(df, ["a", "c", "x"]).collect()} == {"a": True, "c": False, "x": False}


def test_models_and_fallback(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 20 AS double) AS x", "cast(id % 20 > 9 AS int) AS y", "'d' AS district", "cast(id % 20 AS double) AS cases")
    for m in ("lr", "poisson", "nb", "rf"):
        out = models.fit_score(m, df, df, ["x"], "y", trees=5)
        assert metrics.roc_auc(out, "y", "score").first()[0] > 0.95, m
        assert out.where("score < 0 OR score > 1").isEmpty()
    assert models.fit_score("rf", df.where("y = 1"), df, ["x"], "y").select("score").distinct().collect()[0][0] == 1
    with pytest.raises(ValueError, match="unknown model"):
        models.resolve("nope")
    assert models.calibrate(df.withColumn("s", F.col("x") / 20), df.withColumn("s", F.col("x") / 20), "s", "y", "platt").where("calibrated NOT BETWEEN 0 AND 1").isEmpty()


def test_risk_and_draws(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1), 0.0, 1.0), ("A", dt.date(2020, 1, 8), 2.0, 3.0), ("A", dt.date(2020, 1, 15), 1.0, 1.0)], "district string, date date, y double, t double")
    out = posterior.linear_predictor(df, *posterior.effects(df, "y")).withColumn("risk", posterior.exceedance(F.col("linear"), F.col("t")))
    risk = col(out, "risk", "date")
    assert risk[0] >= risk[1] and all(0 <= r <= 1 for r in risk)
    for mu, k in ((0.5, 2), (3.0, 0), (2.0, 5)):
        assert math.isclose(posterior.nb_exceedance(mu, k, 1.0), (mu / (1 + mu)) ** k)
    s = posterior.draw_summary(spark.createDataFrame([([3.0, 1.0, None, 2.0],), ([],)], "draws array<double>")).collect()
    assert (s[0].mean, s[0].median, round(s[0].std, 6)) == (2, 2, 0.816497) and s[1].mean is None
    assert posterior.converged([{"r_hat": 1.0, "ess_bulk": 500}]) and not posterior.converged([{"r_hat": 1.2, "ess_bulk": 20}])


def test_last_known_neighbours(spark):
    df = spark.createDataFrame([(1, "A", 5), (2, "B", 7), (3, "A", 9), (4, "C", 1), (5, "B", 2), (6, "A", 3)], "o int, district string, cases int")
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "A")], "src string, dst string")
    assert col(features.neighbour_last_mean(df, edges, "o"), "neighbor_mean_cases", "o") == [None, 5, 7, None, 9, 1.5]


def test_names_and_alerts_of_models(spark):
    assert models.safe_names(["a.b", "a b", "2x", "%", "_c__d_", "a_b"], ["a_b"]) == {"a.b": "a_b_2", "a b": "a_b_3", "2x": "f_2x", "%": "feature", "_c__d_": "c_d", "a_b": "a_b_4"}
    df = spark.range(200).selectExpr("cast(id % 2 AS int) AS y", "cast(id % 2 AS double) AS `x.1`", "cast(id % 7 AS double) AS x_1")
    out = models.fit_score("logistic", df, df, ["x.1"], "y")
    assert out.columns == [*df.columns, "score"] and out.where("(score > 0.5) <> (y = 1)").isEmpty()
    oof = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.7), (2, "a", -1.0), (2, "b", None)], "k int, model string, score double")
    assert sorted(map(tuple, models.wide_scores(oof, ["k"], ["a", "b", "c"]).collect())) == [(1, 0.5, 1.0, 0.0), (2, 0.0, 0.0, 0.0)]
    assert sorted(map(tuple, models.alerts(oof, ["k"], ["a", "b"]).collect())) == [(1, 1, 1), (2, 0, 0)]


def test_permutation_importance(spark):
    from tidewatch.operators import importance

    df = spark.range(500).selectExpr("id", "date_add(DATE'2020-01-01', cast(id AS int)) AS date", "cast(hash(id) % 2 = 0 AS int) AS y", "cast(hash(id) % 2 AS double) AS good", "cast(hash(id, 5) % 7 AS double) AS noise")
    moved = importance.permuted(df, ["noise", "good"], ["id"], 3, 2, rows=100).select("id", "_r", F.col("_donor.noise").alias("other"))
    a, b = ([r.other for r in moved.where(F.col("_r") == k).select("id", "other").orderBy("id").collect()] for k in (0, 1))
    assert sorted(a) == sorted(b) == sorted(col(df, "noise", "id")) and a != b and a != col(df, "noise", "id")
    scored = spark.range(300).selectExpr("id % 3 AS g", "cast(hash(id) % 2 = 0 AS int) AS y", "cast(pmod(hash(id, 3), 40) AS double) / 40 AS p")
    by = {r.g: r.average_precision for r in metrics.average_precision_by(scored, "y", "p", ["g"]).collect()}
    assert all(math.isclose(by[g], metrics.average_precision(scored.where(F.col("g") == g), "y", "p").first()[0]) for g in (0, 1, 2))
    out = {r.feature: r for r in importance.permutation_importance(df, ["good", "noise"], "y", ["id"], repeats=2, trees=5).collect()}
    assert out["good"].importance > 0.2 > abs(out["noise"].importance) and out["good"].forest > out["noise"].forest


def test_quantiles_by_ranks(spark):
    """Nulls, ties, one value, no value, and many more values than parts."""
    import numpy as np
    from tidewatch.operators.ranks import quantiles

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=3000).round(3), rng.integers(0, 5, 3000)
    rows = [(float(x), int(y) if k % 3 else None, None, 7.0) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double")
    at = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    r = quantiles(df, ["a", "b", "c", "d"], at).collect()
    from tidewatch.operators import ranks

    now = [ranks.quantiles_now(df, ["a", "b", "c", "d"], at)]
    few, ranks.FEW = ranks.FEW, 10
    now.append(ranks.quantiles_now(df, ["a", "b", "c", "d"], at))
    ranks.FEW = few
    assert all(x["c"] is None and all(np.allclose(x[c], r[0][c]) for c in "abd") for x in now)
    some = [y for _, y, _, _ in rows if y is not None]
    assert len(r) == 1 and np.allclose(r[0]["a"], np.quantile(a, at)) and np.allclose(r[0]["b"], np.quantile(some, at))
    assert r[0]["c"] is None and r[0]["d"] == [7.0] * 6
    assert quantiles(df.limit(0), ["a"], at).collect()[0]["a"] is None


def test_pages_that_never_end_are_an_error():
    from tidewatch.sources.paged import pages

    more = lambda url, headers: '{"results": [{"a": 1}], "has_more": true}'
    with pytest.raises(ValueError, match="goes on"):
        list(pages(more, "http://x", {}, {}, 1, most=5))


def test_leading_districts_prefer_risk_and_count_what_is_no_number_as_zero(spark):
    rows = [("A", "0.2", 9), ("A", None, 9), ("B", "0.1", 1), ("C", "x", 50), (None, "0.9", 0)]
    df = spark.createDataFrame(rows, "district string, risk string, cases int")
    assert [tuple(r) for r in decision.leading_districts(df, 4).collect()] == [(None, 0.9), ("A", 0.1), ("B", 0.1), ("C", 0.0)]
    assert [r.district for r in decision.leading_districts(df.drop("risk"), 1).collect()] == ["C"]
    assert [r.district for r in decision.leading_districts(df.select("district"), 1).collect()] == ["A"]
    assert decision.in_leading_districts(df.where("district IS NOT NULL"), 2).count() == 3
    assert decision.leading_districts(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        decision.leading_districts(df, 0)
