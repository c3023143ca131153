"""Registered queries and their SQL.

A query is declared with the kinds of its columns (s as it is, l a long, d a double rounded to six
places, after a shift that keeps exact halves from falling either way), a function and, where SQL can say the same, its body over the tables of ``bridge.SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import dates, values
from tidewatch.operators import clean, decision, diagnostics, features, folds, held, hierarchical, impute, labels, metrics, models, population, posterior, quality
from tidewatch.plans import audit, bridge, pipeline
from tidewatch.plans.bridge import full, observed, panel, scores, table
from tidewatch.sources import paged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, columns: str, body: str | None = None):
    kinds = [c.split(":") for c in columns.split()]
    spark_kinds = {"l": lambda c: F.col(c).cast("long"), "d": lambda c: F.round(F.col(c).cast("double") + 1e-9, 6), "s": F.col}
    sql_kinds = {"l": "CAST({0} AS BIGINT) AS {0}", "d": "round(CAST({0} AS DOUBLE) + 1e-9, 6) AS {0}", "s": "{0}"}

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).select(*[spark_kinds[k](c).alias(c) for c, k in kinds])
        if body:
            ORACLE_SQL[name] = f"WITH {bridge.SQL},\nq AS ({body})\nSELECT {', '.join(sql_kinds[k].format(c) for c, k in kinds)} FROM q"
        return f

    return register


def over(frame: str = "", key: str = "district") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY date {frame})"


BEFORE4 = "ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING"
UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
P75 = "(SELECT district, quantile_cont(cases, 0.75) AS t FROM panel GROUP BY district)"


# Flagship: panel, thresholds, next-step labels, causal features, rule, alert levels.
@query("early_warning", "district:s date:s cases:l threshold_p75:d outbreak_label:l case_lag_1:d case_roll4_mean:d score:d alert_level:s", f"""
SELECT p.district, p.date, cases, t AS threshold_p75, CAST(coalesce(lead(cases) {over(key="p.district")} > t, false) AS INT) AS outbreak_label,
  coalesce(lag(cases, 1) {over(key="p.district")}, 0) AS case_lag_1, coalesce(avg(cases) {over(BEFORE4, "p.district")}, 0) AS case_roll4_mean,
  CAST(cases >= t AS INT) AS score, CASE WHEN cases >= t THEN 'RED' ELSE 'NO_ACTION' END AS alert_level
FROM panel p JOIN {P75} x ON x.district = p.district""")
def early_warning(spark, d):
    p = labels.global_thresholds(panel(spark, d), percentiles=(75,))
    w = labels.in_order()
    p = labels.next_step_label(p, F.col("threshold_p75"), "outbreak_label").withColumns({"case_lag_1": F.coalesce(F.lag("cases").over(w), F.lit(0)), "case_roll4_mean": F.coalesce(F.avg("cases").over(w.rowsBetween(-4, -1)), F.lit(0.0))})
    p = p.withColumn("score", values.is_true(F.col("cases") >= F.col("threshold_p75")))
    return p.withColumn("alert_level", decision.alert_level(F.col("score")))


@query("panel_complete", "district:s state:s date:s cases:l", "SELECT * FROM panel")
def panel_complete(spark, d):
    return panel(spark, d)


@query("week_anchor_align", "key:l aligned:s", """SELECT event_id AS key, CASE WHEN b <= 3 THEN day - CAST(b AS INT) ELSE day + CAST(7 - b AS INT) END AS aligned
FROM (SELECT event_id, CAST(ts AS DATE) AS day, (isodow(ts) - 1 - 6 + 7) % 7 AS b FROM events)""")
def week_anchor_align(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("key"), dates.to_anchor(F.to_date("ts"), 6).alias("aligned"))


@query("iso_week_to_date", "key:l day:s", """SELECT key, CASE WHEN w BETWEEN 1 AND 53 AND year(m + 3) = y THEN m END AS day FROM (
SELECT key, y, w, CAST(date_trunc('week', make_date(y, 1, 4)) AS DATE) + CAST((w - 1) * 7 AS INT) AS m FROM (SELECT o_orderkey AS key, 2015 + o_orderkey % 10 AS y, o_orderkey % 56 AS w FROM orders))""")
def iso_week_to_date(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("key"), dates.iso_week_start(2015 + k % 10, k % 56).alias("day"))


@query("date_from_parts", "key:l day:s", """SELECT o_orderkey AS key, TRY_CAST('2019-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) AS day FROM orders""")
def date_from_parts(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("key"), dates.from_parts(F.lit(2019), (k % 14).cast("int"), (k % 33).cast("int")).alias("day"))


@query("year_filter", "district:s date:s cases:l", "SELECT * FROM panel WHERE year(date) BETWEEN 1996 AND 1998")
def year_filter(spark, d):
    return clean.filter_years(panel(spark, d), 1996, 1998)


@query("dedup_keep_first", "o_custkey:l o_orderkey:l", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedup_keep_first(spark, d):
    return clean.keep_one(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")])


@query("dedup_keep_last", "o_custkey:l date:s o_orderkey:l", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def dedup_keep_last(spark, d):
    o = table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    return clean.keep_one(o, ["o_custkey", "date"], [F.desc("o_orderkey")])


@query("coerce_numeric", "event_id:l v:d", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS v FROM events")
def coerce_numeric(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string")))
    return clean.coerce_numbers(e, ["v"])


@query("normalize_names", "a_b:l total_pct:l", "SELECT n_nationkey AS a_b, n_regionkey AS total_pct FROM nation")
def normalize_names(spark, d):
    return clean.normalize_columns(table(spark, d, "nation").select(F.col("n_nationkey").alias(" A-b "), F.col("n_regionkey").alias("Total / %")))


@query("temp_units", "district:s date:s temperature:d temp_kelvin:d", "SELECT district, date, temperature, temperature + 273.15 AS temp_kelvin FROM fp")
def temp_units(spark, d):
    return clean.normalize_temperature(full(spark, d).withColumn("temp", F.col("temperature") + 273.15).drop("temperature"))


@query("clip_bounds", "key:l v:d", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_totalprice < 50000 THEN 50000 WHEN o_totalprice > 200000 THEN 200000 ELSE o_totalprice END AS v FROM orders")
def clip_bounds(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return clean.clip_columns(o.withColumnRenamed("o_orderkey", "key"), {"v": (50000, 200000)})


@query("impute_group_median", "district:s date:s temperature:d", """SELECT f.district, f.date, coalesce(f.temperature, g.m, a.m) AS temperature FROM fp f
LEFT JOIN (SELECT district, month(date) AS mo, quantile_cont(temperature, 0.5) AS m FROM fp GROUP BY 1, 2) g ON g.district = f.district AND g.mo = month(f.date)
CROSS JOIN (SELECT quantile_cont(temperature, 0.5) AS m FROM fp) a""")
def impute_group_median(spark, d):
    return impute.median_impute(impute.with_month(full(spark, d)), ["temperature"], ["district", "month"])


@query("impute_climate", "district:s date:s rainfall:d temperature:d temp_kelvin:d", """SELECT f.district, f.date, coalesce(f.rainfall, g.r, a.r) AS rainfall, coalesce(f.temperature, g.m, a.m) AS temperature, coalesce(f.k, g.k, a.k) AS temp_kelvin
FROM (SELECT *, temperature + 273.15 AS k FROM fp) f
LEFT JOIN (SELECT district, month(date) AS mo, quantile_cont(temperature, 0.5) AS m, quantile_cont(rainfall, 0.5) AS r, quantile_cont(temperature + 273.15, 0.5) AS k FROM fp GROUP BY 1, 2) g ON g.district = f.district AND g.mo = month(f.date)
CROSS JOIN (SELECT quantile_cont(temperature, 0.5) AS m, quantile_cont(rainfall, 0.5) AS r, quantile_cont(temperature + 273.15, 0.5) AS k FROM fp) a""")
def impute_climate(spark, d):
    return impute.impute_climate(full(spark, d))


@query("md5_shard", "custkey:l shard:l", "SELECT c_custkey AS custkey, CAST('0x' || substr(md5(lower(trim(coalesce(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END, '__missing_district__')))), 1, 8) AS BIGINT) % 7 AS shard FROM customer")
def md5_shard(spark, d):
    name = F.when(F.col("c_custkey") % 11 != 0, F.col("c_name"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), values.shard(name, 7).alias("shard"))


@query("anchor_report", "keys_before:l keys_after:l modal_weekday:l", """SELECT count(DISTINCT (user_id, day)) AS keys_before, count(DISTINCT (user_id, CASE WHEN b <= 3 THEN day - CAST(b AS INT) ELSE day + CAST(7 - b AS INT) END)) AS keys_after,
(SELECT w FROM (SELECT isodow(ts) - 1 AS w, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, w LIMIT 1)) AS modal_weekday
FROM (SELECT user_id, CAST(ts AS DATE) AS day, (isodow(ts) - 1 - 6 + 7) % 7 AS b FROM events)""")
def anchor_report(spark, d):
    return clean.anchor_report(table(spark, d, "events").withColumn("date", F.to_date("ts")), 6, ["user_id"])


@query("api_normalize", "state:s district:s date:s cases:d", """SELECT 'XX' AS state, n_name AS district, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_totalprice < 100000 THEN 0 ELSE round(o_totalprice - 100000, 2) END AS cases FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey""")
def api_normalize(spark, d):
    o = table(spark, d, "orders").join(F.broadcast(table(spark, d, "nation")), F.col("o_orderkey") % 25 == F.col("n_nationkey"))
    raw = o.select(F.col("n_name").alias("municipio_nome"), F.to_date("o_orderdate").cast("string").alias("data_iniSE"), F.round(F.col("o_totalprice") - 100000, 2).cast("string").alias("casos"))
    return clean.normalize_api(raw, "XX")


for _p in (70, 75, 80):
    @query(f"label_global_p{_p}", f"district:s date:s threshold_p{_p}:d outbreak_label_p{_p}:l", f"""SELECT p.district, date, t AS threshold_p{_p}, CAST(cases >= t AS INT) AS outbreak_label_p{_p}
FROM panel p JOIN (SELECT district, quantile_cont(cases, {_p / 100}) AS t FROM panel GROUP BY district) x ON x.district = p.district""")
    def label_global(spark, d, p=_p):
        return labels.add_labels(labels.global_thresholds(panel(spark, d), percentiles=(p,)), percentiles=(p,))


@query("label_next_step", "district:s date:s label:l", f"SELECT p.district, date, CAST(coalesce(lead(cases) {over(key='p.district')} > t, false) AS INT) AS label FROM panel p JOIN {P75} x ON x.district = p.district")
def label_next_step(spark, d):
    return labels.next_step_label(labels.global_thresholds(panel(spark, d)), F.col("threshold_p75"), "label")


@query("label_next_step_fixed", "district:s date:s label:l", f"SELECT district, date, CAST(coalesce(lead(cases) {over()} > 3, false) AS INT) AS label FROM panel")
def label_next_step_fixed(spark, d):
    return labels.next_step_label(panel(spark, d), F.lit(3), "label")


@query("temporal_one_series", "date:s cases:l case_rolling_mean:d case_velocity:d case_acceleration:d case_lag_1:d case_lag_2:d", f"""WITH t AS (SELECT date, sum(cases) AS cases FROM panel GROUP BY date),
l AS (SELECT *, lag(cases, 1) OVER o AS a, lag(cases, 2) OVER o AS b, lag(cases, 3) OVER o AS c, avg(cases) OVER (ORDER BY date {BEFORE4}) AS m FROM t WINDOW o AS (ORDER BY date))
SELECT date, cases, m AS case_rolling_mean, a - b AS case_velocity, (a - b) - (b - c) AS case_acceleration, a AS case_lag_1, b AS case_lag_2 FROM l""")
def temporal_one_series(spark, d):
    return features.temporal(panel(spark, d).groupBy("date").agg(F.sum("cases").alias("cases")), district=None)


@query("impute_all_median", "district:s date:s rainfall:d temperature:d", """SELECT f.district, f.date, coalesce(f.rainfall, a.r) AS rainfall, coalesce(f.temperature, a.m) AS temperature
FROM fp f CROSS JOIN (SELECT quantile_cont(temperature, 0.5) AS m, quantile_cont(rainfall, 0.5) AS r FROM fp) a""")
def impute_all_median(spark, d):
    return impute.median_impute(full(spark, d), ["rainfall", "temperature"], [])


@query("month_index", "key:l day:s", "SELECT o_orderkey AS key, make_date(coalesce(CASE WHEN o_orderkey % 5 > 0 THEN 2000 + o_orderkey % 20 END, 1970), greatest(least(o_orderkey % 16 - 1, 12), 1), 1) AS day FROM orders")
def month_index(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("key"), features.month_index(F.when(k % 5 > 0, (2000 + k % 20).cast("int")), (k % 16 - 1).cast("int")).alias("day"))


@query("rename_aliases", "o_orderkey:l state:s rainfall:d longitude:d", "SELECT o_orderkey, o_orderstatus AS state, o_totalprice AS rainfall, o_totalprice / 1000 AS longitude FROM orders")
def rename_aliases(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state_ut"), F.col("o_totalprice").alias("preci"), (F.col("o_totalprice") / 1000).alias("longitute"))
    return clean.rename_aliases(o)


@query("label_fixed", "district:s date:s outbreak_label:l", "SELECT district, date, CAST(cases >= 3 AS INT) AS outbreak_label FROM panel")
def label_fixed(spark, d):
    return labels.fixed_label(panel(spark, d), 3)


@query("threshold_past_only", "district:s date:s t:d", f"SELECT district, date, quantile_cont(cases, 0.75) {over(UP_TO)} AS t FROM panel")
def threshold_past_only(spark, d):
    return labels.past_thresholds(panel(spark, d), 0.75, "t")


_TRAIN = """tr AS (SELECT v.y, p.district, quantile_cont(p.cases, 0.75) AS t FROM (SELECT DISTINCT year(date) AS y FROM panel) v
JOIN panel p ON year(p.date) BETWEEN {0} AND v.y - 1 GROUP BY 1, 2)"""


@query("threshold_train_fold", "district:s date:s t:d", f"WITH {_TRAIN.format('v.y - 3')} SELECT p.district, date, t FROM panel p LEFT JOIN tr ON tr.y = year(date) AND tr.district = p.district")
def threshold_train_fold(spark, d):
    return labels.train_thresholds(panel(spark, d), 0.75, "t")


@query("threshold_train_start", "district:s date:s t:d", f"WITH {_TRAIN.format('1996')} SELECT p.district, date, t FROM panel p LEFT JOIN tr ON tr.y = year(date) AND tr.district = p.district")
def threshold_train_start(spark, d):
    return labels.train_thresholds(panel(spark, d), 0.75, "t", start=1996)


@query("threshold_gap_fill", "district:s date:s t:d", f"""WITH {_TRAIN.format('v.y - 3')}, a AS (SELECT p.district, date, cases, t FROM panel p LEFT JOIN tr ON tr.y = year(date) AND tr.district = p.district)
SELECT district, date, coalesce(t, quantile_cont(cases, 0.75) {over(UP_TO, 'district, t IS NULL')}) AS t FROM a""")
def threshold_gap_fill(spark, d):
    return labels.gap_fill(labels.train_thresholds(panel(spark, d), 0.75, "t"), 0.75, "t")


@query("threshold_scope_audit", "n_rows:l n_bad:l", f"""WITH {_TRAIN.format('v.y - 3')}, g AS {P75}
SELECT (SELECT count(*) FROM panel) AS n_rows, count(*) AS n_bad FROM panel p JOIN tr ON tr.y = year(date) AND tr.district = p.district JOIN g ON g.district = p.district WHERE abs(g.t - tr.t) > 1e-9""")
def threshold_scope_audit(spark, d):
    p = labels.global_thresholds(panel(spark, d), percentiles=(75,))
    return p.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(labels.scope_audit(p, "threshold_p75", 0.75).agg(F.count(F.lit(1)).alias("n_bad")))


@query("temporal_features", "district:s date:s case_rolling_mean:d case_rolling_std:d case_velocity:d case_acceleration:d case_lag_1:d case_lag_2:d", f"""SELECT district, date, avg(cases) {over(BEFORE4)} AS case_rolling_mean,
coalesce(CASE WHEN count(cases) {over(BEFORE4)} >= 3 THEN stddev_samp(cases) {over(BEFORE4)} END, 0) AS case_rolling_std, lag(cases, 1) {over()} - lag(cases, 2) {over()} AS case_velocity,
(lag(cases, 1) {over()} - lag(cases, 2) {over()}) - (lag(cases, 2) {over()} - lag(cases, 3) {over()}) AS case_acceleration, lag(cases, 1) {over()} AS case_lag_1, lag(cases, 2) {over()} AS case_lag_2 FROM panel""")
def temporal_features(spark, d):
    return features.temporal(panel(spark, d))


@query("causal_features", "district:s date:s case_lag_1:d case_lag_2:d case_lag_3:d case_lag_4:d case_roll4_mean:d case_roll4_var:d case_roll4_max:d case_roll4_cv:d case_trend_1w:d case_trend_4w:d case_cum12:d year:l month:l weekofyear:l", f"""WITH v AS (SELECT district, date,
{', '.join(f'lag(cases, {k}) {over()} AS l{k}' for k in (1, 2, 3, 4))}, avg(cases) {over(BEFORE4)} AS m, var_samp(cases) {over(BEFORE4)} AS s, max(cases) {over(BEFORE4)} AS x,
sum(cases) {over('ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING')} AS c FROM panel)
SELECT district, date, {', '.join(f'coalesce(l{k}, 0) AS case_lag_{k}' for k in (1, 2, 3, 4))}, coalesce(m, 0) AS case_roll4_mean, coalesce(s, 0) AS case_roll4_var, coalesce(x, 0) AS case_roll4_max,
coalesce(sqrt(s) / nullif(m, 0), 0) AS case_roll4_cv, coalesce(l1 - l2, 0) AS case_trend_1w, coalesce(l1 - l4, 0) AS case_trend_4w, coalesce(c, 0) AS case_cum12,
year(date) AS year, month(date) AS month, weekofyear(date) AS weekofyear FROM v""")
def causal_features(spark, d):
    return features.causal(panel(spark, d))


_SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'pre_monsoon' WHEN month(date) <= 9 THEN 'monsoon' ELSE 'post_monsoon' END"


@query("climate_features", "district:s date:s season:s degree_days:d temp_optimal:l temp_anomaly:d rainfall_4wk:d temp_rain_interaction:d", f"""SELECT district, date, season, CASE WHEN temperature > 20 THEN temperature - 20 ELSE temperature * 0 END AS degree_days,
CAST(coalesce(temperature BETWEEN 25 AND 30, false) AS INT) AS temp_optimal, temperature - avg(temperature) OVER (PARTITION BY district, season) AS temp_anomaly,
sum(rainfall) {over('ROWS BETWEEN 3 PRECEDING AND CURRENT ROW')} AS rainfall_4wk, temperature * rainfall AS temp_rain_interaction FROM (SELECT *, {_SEASON} AS season FROM fp)""")
def climate_features(spark, d):
    return features.climate(full(spark, d))


@query("season_anomaly", "district:s date:s rain_anomaly:d", f"SELECT district, date, rainfall - avg(rainfall) OVER (PARTITION BY district, {_SEASON}) AS rain_anomaly FROM fp")
def season_anomaly(spark, d):
    f = full(spark, d).withColumn("season", dates.season(F.month("date")))
    return features.group_anomaly(f, "rainfall", "rain_anomaly", ["district", "season"])


@query("district_code", "district:s district_code:l", "SELECT DISTINCT district, CASE WHEN district IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY district NULLS LAST) - 1 END AS district_code FROM panel")
def district_code(spark, d):
    return features.district_codes(panel(spark, d)).select("district", "district_code").distinct()


_KNN = """nn AS (SELECT a.district AS src, b.district AS dst, row_number() OVER (PARTITION BY a.district ORDER BY sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)), b.district) AS rank
FROM place a JOIN place b ON a.district <> b.district QUALIFY rank <= 3)"""


@query("knn_neighbors", "src:s dst:s rank:l", f"WITH {_KNN} SELECT * FROM nn")
def knn_neighbors(spark, d):
    return features.neighbours(bridge.places(spark, d))


_SEEN = "seen AS (SELECT n_name AS district, (c_custkey % 97) * 0.5e0 - 10 AS lat, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 31 + n_nationkey END AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("place_centroids", "district:s lat:d lon:d", f"WITH {_SEEN} SELECT district, avg(lat) AS lat, avg(lon) AS lon FROM seen WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1")
def place_centroids(spark, d):
    """Where a nation's customers are on average; those without a place are left out."""
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation")
    k = F.col("c_custkey")
    seen = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("district"), (k % 97 * 0.5 - 10).alias("lat"), F.when(k % 7 != 0, k % 31 + F.col("n_nationkey")).alias("lon"))
    return features.centroids(seen)


@query("neighbor_lag_mean", "district:s date:s neighbor_mean_cases:d", f"""WITH {_KNN}, lg AS (SELECT district, date, lag(cases) {over()} AS l FROM panel)
SELECT p.district, p.date, m AS neighbor_mean_cases FROM panel p LEFT JOIN (SELECT src, date, avg(l) AS m FROM nn JOIN lg ON lg.district = dst GROUP BY 1, 2) x ON src = p.district AND x.date = p.date""")
def neighbor_lag_mean(spark, d):
    return features.neighbour_mean(panel(spark, d), features.neighbours(bridge.places(spark, d)))


@query("order_issues", "n_backward:l n_duplicate_rows:l", """SELECT sum(CAST(day < coalesce(prev, day) AS INT)) AS n_backward, sum(CAST(n > 1 AS INT)) AS n_duplicate_rows FROM (
SELECT day, lag(day) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, count(*) OVER (PARTITION BY o_custkey, day) AS n FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders))""")
def order_issues(spark, d):
    o = table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    return features.order_issues(o, ["o_orderkey"], "o_custkey")


@query("missingness_report", "feature:s n:l missing_rate:d variance:d uniqueness_rate:d", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n, avg(CAST({c} IS NULL AS INT)) AS missing_rate, coalesce(var_pop({c}), 0) AS variance, count(DISTINCT {c}) / count({c}) AS uniqueness_rate FROM fp" for c in ("cases", "rainfall", "temperature")))
def missingness_report(spark, d):
    return quality.column_report(full(spark, d), ["cases", "rainfall", "temperature"])


@query("quality_gate", "feature:s flagged:s", "SELECT 'cases' AS feature, var_pop(cases) <= 1e-10 OR count(DISTINCT cases) / count(cases) <= 0.01 AS flagged FROM fp UNION ALL SELECT 'temperature', var_pop(temperature) <= 1e-10 OR count(DISTINCT temperature) / count(temperature) <= 0.01 FROM fp")
def quality_gate(spark, d):
    return quality.gate(full(spark, d), ["cases", "temperature"])


@query("feature_diagnostics", "missing_rate:d variance:d uniqueness_rate:d district_cv:d temporal_cv:d stability_score:d", """WITH w AS (SELECT avg(CAST(temperature IS NULL AS INT)) AS missing_rate, var_pop(temperature) AS variance, count(DISTINCT temperature) / count(temperature) AS uniqueness_rate FROM fp),
a AS (SELECT stddev_pop(m) / abs(avg(m)) AS district_cv FROM (SELECT avg(temperature) AS m FROM fp GROUP BY district)), b AS (SELECT stddev_pop(m) / abs(avg(m)) AS temporal_cv FROM (SELECT avg(temperature) AS m FROM fp GROUP BY date))
SELECT *, CASE WHEN uniqueness_rate <= 0.01 THEN 0 ELSE 1 / (1 + (district_cv + temporal_cv) / 2) END AS stability_score FROM w, a, b""")
def feature_diagnostics(spark, d):
    return quality.diagnostics(full(spark, d), "temperature")


_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(lower({0}), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'), '(\s+(district|dist|distt|dt))+$', ''), '\s+', ' ', 'g'))"


@query("norm_key", "part:l k:s", f"SELECT p_partkey AS part, {_KEY.format(chr(39) + 'É & ' + chr(39) + ' || p_name || ' + chr(39) + '-Distt' + chr(39))} AS k FROM part")
def norm_key(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), values.text_key(F.concat(F.lit("É & "), "p_name", F.lit("-Distt"))).alias("k"))


@query("token_key", "part:l k:s", f"SELECT p_partkey AS part, array_to_string(list_sort(list_distinct(list_filter(string_split({_KEY.format('p_name || ' + chr(39) + ' of the part' + chr(39))}, ' '), lambda x: x NOT IN ('and', 'of', 'the', 'de', 'da', 'do', 'district', '')))), ' ') AS k FROM part")
def token_key(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), values.token_key(F.concat("p_name", F.lit(" of the part"))).alias("k"))


@query("population_cascade", "district:s date:s population:l", """SELECT district, date, CASE WHEN n_nationkey % 3 <> 2 THEN 1000 + n_nationkey END AS population FROM panel JOIN nation ON n_name = district""")
def population_cascade(spark, d):
    """A census that lacks every third district, and has another state for every third one."""
    k = F.col("n_nationkey")
    census = bridge.places(spark, d).where(k % 3 != 2).select(F.when(k % 3 == 1, F.lit("elsewhere")).otherwise(F.lower("state")).alias("state"), F.concat(F.initcap("district"), F.lit(" dist")).alias("district"), (1000 + k).alias("population"))
    return population.merge_population(panel(spark, d), census, ["population"])


@query("population_tokens", "district:s date:s population:l", "SELECT district, date, CASE WHEN n_nationkey % 2 = 0 THEN 1000 + n_nationkey END AS population FROM panel JOIN nation ON n_name = district")
def population_tokens(spark, d):
    """A census of other states that writes the words of its names in another order, so that only words are left to join by."""
    k = F.col("n_nationkey")
    name = F.concat(F.split("district", "_")[1], F.lit(" of "), F.initcap(F.split("district", "_")[0]))
    census = bridge.places(spark, d).where(k % 2 == 0).select(F.lit("elsewhere").alias("state"), name.alias("district"), (1000 + k).alias("population"))
    return population.merge_population(panel(spark, d), census, ["population"])


@query("fold_ledger_rolling", "fold:l train_start:l train_end:l valid_year:l n_train:l n_valid:l status:s", f"""WITH y AS (SELECT year(date) AS yr, CAST(cases >= t AS INT) AS l FROM panel p JOIN {P75} x ON x.district = p.district)
SELECT v - 1995 AS fold, v - 3 AS train_start, v - 1 AS train_end, v AS valid_year, count(*) FILTER (yr < v) AS n_train, count(*) FILTER (yr = v) AS n_valid,
CASE WHEN count(*) FILTER (yr < v) = 0 OR count(*) FILTER (yr = v) = 0 THEN 'empty_slice' WHEN count(DISTINCT CASE WHEN yr < v THEN l END) = 1 THEN 'single_class_train' ELSE 'yielded' END AS status
FROM (SELECT CAST(unnest(range(1996, 2004)) AS BIGINT) AS v) LEFT JOIN y ON yr BETWEEN v - 3 AND v GROUP BY v""")
def fold_ledger_rolling(spark, d):
    p = labels.choose_label(labels.add_labels(labels.global_thresholds(panel(spark, d))))
    return folds.ledger(p, folds.rolling(spark, 1996, 2003), "outbreak_label")


@query("fold_ledger_expanding", "fold:l train_start:l valid_year:l n_train:l n_valid:l status:s", f"""WITH y AS (SELECT year(date) AS yr FROM panel)
SELECT v - 1995 AS fold, 1995 AS train_start, v AS valid_year, count(*) FILTER (yr < v) AS n_train, count(*) FILTER (yr = v) AS n_valid, CASE WHEN count(*) FILTER (yr = v) = 0 THEN 'empty_slice' ELSE 'yielded' END AS status
FROM (SELECT CAST(unnest(range(1996, 2003)) AS BIGINT) AS v) LEFT JOIN y ON yr BETWEEN 1995 AND v GROUP BY v""")
def fold_ledger_expanding(spark, d):
    p = labels.choose_label(labels.add_labels(labels.global_thresholds(panel(spark, d))))
    return folds.ledger(p, folds.expanding(spark, 1995, 1996, 2002), "outbreak_label")


@query("rule_fit_predict", "district:s date:s score:d", """WITH t AS (SELECT district, quantile_cont(cases, 0.75) AS t FROM panel WHERE year(date) BETWEEN 1996 AND 1998 GROUP BY 1), w AS (SELECT quantile_cont(cases, 0.75) AS w FROM panel WHERE year(date) BETWEEN 1996 AND 1998)
SELECT p.district, date, CAST(cases >= coalesce(t, w) AS INT) AS score FROM panel p LEFT JOIN t ON t.district = p.district CROSS JOIN w WHERE year(date) = 1999""")
def rule_fit_predict(spark, d):
    train, valid = folds.split(panel(spark, d), {"train_start": 1996, "train_end": 1998, "valid_year": 1999})
    return models.percentile_rule(train, valid)


@query("confusion_metrics", "tp:l fp:l fn:l tn:l accuracy:d precision:d recall:d f1:d kappa:d false_alarm_rate:d", """WITH c AS (SELECT sum(CAST(p >= 0.5 AND y = 1 AS INT)) AS tp, sum(CAST(p >= 0.5 AND y = 0 AS INT)) AS fp, sum(CAST(p < 0.5 AND y = 1 AS INT)) AS fn, sum(CAST(p < 0.5 AND y = 0 AS INT)) AS tn FROM sc),
e AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS a, (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(tn + fn AS DOUBLE) * (tn + fp)) / (CAST(tp + fp + fn + tn AS DOUBLE) * (tp + fp + fn + tn)) AS pe FROM c)
SELECT *, a AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (a - pe) / (1 - pe) AS kappa, fp / (fp + tn) AS false_alarm_rate FROM e""")
def confusion_metrics(spark, d):
    return metrics.confusion(scores(spark, d), "y", "p")


_S = "s AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY p)"


@query("roc_auc", "roc_auc:d", f"WITH {_S} SELECT sum(pos * (coalesce(b, 0) + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM (SELECT *, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s)")
def roc_auc(spark, d):
    return metrics.roc_auc(scores(spark, d), "y", "p")


_C = f"WITH {_S}, c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC {UP_TO}) AS tp, sum(neg) OVER (ORDER BY p DESC {UP_TO}) AS fp FROM s)"


@query("average_precision", "average_precision:d", f"{_C} SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision FROM c")
def average_precision(spark, d):
    return metrics.average_precision(scores(spark, d), "y", "p")


@query("roc_pr_curves", "p:d tpr:d fpr:d precision:d", f"{_C} SELECT p, tp / (SELECT sum(pos) FROM s) AS tpr, fp / (SELECT sum(neg) FROM s) AS fpr, tp / (tp + fp) AS precision FROM c")
def roc_pr_curves(spark, d):
    return metrics.curves(scores(spark, d), "y", "p")


@query("brier", "brier:d", "SELECT avg((p - y) * (p - y)) AS brier FROM sc")
def brier(spark, d):
    return metrics.brier(scores(spark, d), "y", "p")


_BINS = "SELECT lo AS bin_lower, hi AS bin_upper, count(*) AS count, avg(p) AS avg_pred, avg(y) AS obs_rate FROM e JOIN sc ON (p > lo OR (p = lo AND lo = (SELECT min(lo) FROM e))) AND p <= hi GROUP BY 1, 2"
_BIN_COLS = "bin_lower:d bin_upper:d count:l avg_pred:d obs_rate:d"


@query("reliability_quantile", _BIN_COLS, f"""WITH q AS (SELECT DISTINCT unnest(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS lo FROM sc), e AS (SELECT * FROM (SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi FROM q) WHERE hi IS NOT NULL) {_BINS}""")
def reliability_quantile(spark, d):
    return metrics.reliability_quantile(scores(spark, d), "y", "p")


@query("reliability_uniform", _BIN_COLS, f"WITH e AS (SELECT k / 10 AS lo, (k + 1) / 10 AS hi FROM range(10) t(k)) {_BINS}")
def reliability_uniform(spark, d):
    return metrics.reliability_uniform(scores(spark, d), "y", "p")


@query("reliability_range", _BIN_COLS, f"WITH m AS (SELECT min(p) AS a, max(p) AS b FROM sc), e AS (SELECT a + (b - a) * k / 10 AS lo, a + (b - a) * (k + 1) / 10 AS hi FROM m, range(10) t(k)) {_BINS}")
def reliability_range(spark, d):
    return metrics.reliability_range(scores(spark, d), "y", "p")


_LEADS = f"""lt AS (SELECT district, date, CASE WHEN pos - a > 8 THEN 0 ELSE coalesce(pos - a, 0) END AS lead FROM (
SELECT *, max(CASE WHEN s = 1 THEN pos END) {over('ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a FROM (
SELECT p.district, date, CAST(cases >= t AS INT) AS y, CAST(coalesce(lag(cases) {over(key='p.district')} >= t, false) AS INT) AS yb, CAST(cases = 2 AS INT) AS s, row_number() {over(key='p.district')} AS pos FROM panel p JOIN {P75} x ON x.district = p.district)) WHERE y = 1 AND yb = 0)"""


def _leads(spark, d):
    p = labels.choose_label(labels.add_labels(labels.global_thresholds(panel(spark, d)))).withColumn("alert", (F.col("cases") == 2).cast("int"))
    return metrics.lead_times(p, "outbreak_label", "alert")


@query("lead_time", "district:s date:s lead:l", f"WITH {_LEADS} SELECT * FROM lt")
def lead_time(spark, d):
    return _leads(spark, d)


@query("lead_utility", "lead_utility:d mean_lead:d n_onsets:l", f"WITH {_LEADS} SELECT avg(least(lead, 4)) AS lead_utility, avg(lead) AS mean_lead, count(*) AS n_onsets FROM lt")
def lead_utility(spark, d):
    return metrics.lead_utility(_leads(spark, d))


@query("interval_coverage", "coverage:d mean_width:d", "SELECT avg(CAST(y BETWEEN p - 0.4 AND p + 0.3 AS INT)) AS coverage, 0.7 AS mean_width FROM sc")
def interval_coverage(spark, d):
    return metrics.interval_coverage(scores(spark, d).withColumns({"low": F.col("p") - 0.4, "high": F.col("p") + 0.3}), "y", "low", "high")


_LEVEL = "CASE WHEN p >= 0.7 THEN 'RED' WHEN p >= 0.5 THEN 'ORANGE' WHEN p >= 0.3 THEN 'YELLOW' ELSE 'NO_ACTION' END"


@query("alert_levels", "key:l alert_level:s action:l", f"SELECT key, {_LEVEL} AS alert_level, CAST(p >= 0.2 AS INT) AS action FROM sc")
def alert_levels(spark, d):
    return scores(spark, d).select("key", decision.alert_level(F.col("p")).alias("alert_level"), (F.col("p") >= decision.cost_loss_threshold(1, 5)).cast("int").alias("action"))


@query("expected_cost", "expected_cost:d", "SELECT avg(CASE WHEN p >= 0.4 THEN 1.0 ELSE y * 5.0 END) AS expected_cost FROM sc")
def expected_cost(spark, d):
    return decision.expected_cost(scores(spark, d), "y", "p", 0.4, 1.0, 5.0)


_GRID = "g AS (SELECT k / 100 AS threshold, avg(CASE WHEN p >= k / 100 THEN 1.0 ELSE y * 5.0 END) AS expected_cost FROM sc CROSS JOIN range(101) t(k) GROUP BY k)"


@query("threshold_grid", "threshold:d expected_cost:d", f"WITH {_GRID} SELECT * FROM g")
def threshold_grid(spark, d):
    return decision.threshold_grid(scores(spark, d), "y", "p", 1.0, 5.0)


@query("best_threshold", "threshold:d objective_cost:d sample_size:l optimized:s method:s", f"WITH {_GRID} SELECT threshold, expected_cost AS objective_cost, (SELECT count(*) FROM sc) AS sample_size, true AS optimized, 'empirical_cost_loss_oof' AS method FROM g ORDER BY round(expected_cost, 9), threshold LIMIT 1")
def best_threshold(spark, d):
    return decision.best_threshold(scores(spark, d), "y", "p", 1.0, 5.0)


@query("staged_value", "alert_level:s samples:l avg_total_cost:d", f"SELECT l AS alert_level, count(*) AS samples, avg(CASE l WHEN 'RED' THEN 3 WHEN 'ORANGE' THEN 2 WHEN 'YELLOW' THEN 1 ELSE y * 10 END) AS avg_total_cost FROM (SELECT y, {_LEVEL} AS l FROM sc) GROUP BY 1")
def staged_value(spark, d):
    return decision.staged_value(scores(spark, d), "y", "p", {"NO_ACTION": 0, "YELLOW": 1, "ORANGE": 2, "RED": 3}, 10)


@query("decision_frame", " ".join(f"{c}:{'s' if c in ('run_id', 'date', 'district', 'risk_score_basis', 'decision_policy_version', 'alert_level') else 'l' if c == 'recommended_action' else 'd'}" for c in decision.COLUMNS), f"""SELECT 'r1' AS run_id, date, district, p AS risk_score, p AS risk_mean, p AS risk_q05, p AS risk_q95, NULL AS threshold_cases, 'oof_risk' AS risk_score_basis, 0.2 AS decision_threshold_used, 1 AS decision_cost, 5 AS decision_loss,
0.3 AS alert_threshold_yellow, 0.5 AS alert_threshold_orange, 0.7 AS alert_threshold_red, 'v1' AS decision_policy_version, {_LEVEL} AS alert_level, CAST(p >= 0.2 AS INT) AS recommended_action FROM sc""")
def decision_frame(spark, d):
    return decision.decision_frame(scores(spark, d), "p", "y", "r1", 1, 5)


@query("track_comparison", "metric:s track_a:d track_b:d delta:d relative_delta_pct:d", """WITH a AS (SELECT n_name AS metric, CAST(n_nationkey % 4 AS DOUBLE) AS v FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS metric, CAST(n_nationkey AS DOUBLE) AS v FROM nation WHERE n_nationkey > 5)
SELECT metric, a.v AS track_a, b.v AS track_b, b.v - a.v AS delta, (b.v - a.v) / nullif(abs(a.v), 0) * 100 AS relative_delta_pct FROM a FULL JOIN b USING (metric)""")
def track_comparison(spark, d):
    n = table(spark, d, "nation")
    a = n.where("n_nationkey < 20").select(F.col("n_name").alias("metric"), (F.col("n_nationkey") % 4).cast("double").alias("value"))
    return metrics.compare(a, n.where("n_nationkey > 5").select(F.col("n_name").alias("metric"), F.col("n_nationkey").cast("double").alias("value")))


@query("univariate_signals", "n:l spearman:d point_biserial:d fisher_score:d", """WITH r AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM sc)
SELECT count(*) AS n, corr(rp, ry) AS spearman, corr(p, y) AS point_biserial, pow(avg(p) FILTER (y = 1) - avg(p) FILTER (y = 0), 2) / var_pop(p) AS fisher_score FROM r""")
def univariate_signals(spark, d):
    return metrics.univariate(scores(spark, d), "p", "y")


@query("usefulness_scores", "feature:s score:d", """WITH r AS (SELECT 'cases' AS feature, avg(cases) AS m, var_pop(cases) AS v FROM fp UNION ALL SELECT 'rainfall', avg(rainfall), var_pop(rainfall) FROM fp UNION ALL SELECT 'temperature', avg(temperature), var_pop(temperature) FROM fp)
SELECT feature, 0.65 * (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) + 0.35 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS score FROM r""")
def usefulness_scores(spark, d):
    r = full(spark, d).agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(c).cast("double").alias("m"), F.var_pop(c).alias("v")) for c in ("cases", "rainfall", "temperature")]).alias("r")).select(F.inline("r"))
    return metrics.min_max(r, ["m", "v"]).withColumn("score", 0.65 * F.col("m_scaled") + 0.35 * F.col("v_scaled"))


@query("mutual_information", "mutual_info:d", """SELECT sum(c / n * ln(c * n / (cx * cy))) AS mutual_info FROM (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY bin) AS cx, sum(c) OVER (PARTITION BY y) AS cy FROM (
  SELECT len(list_filter(e[2:len(e) - 1], lambda x: x < p)) AS bin, y, CAST(count(*) AS DOUBLE) AS c FROM sc CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM sc) GROUP BY 1, 2))""")
def mutual_information(spark, d):
    return metrics.mutual_information(scores(spark, d), "p", "y")


@query("top_districts", "district:s mean_value:d", "SELECT district, avg(cases) AS mean_value FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_districts(spark, d):
    return decision.top_districts(panel(spark, d), "cases")


@query("leading_by_cases", "district:s value:d", "SELECT district, avg(coalesce(cases, 0)) AS value FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def leading_by_cases(spark, d):
    return decision.leading_districts(panel(spark, d), 5)


@query("leading_by_rows", "district:s value:d", "SELECT district, count(*) AS value FROM obs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def leading_by_rows(spark, d):
    return decision.leading_districts(observed(spark, d).select("district", "date"), 5)


@query("leading_rows", "district:s date:s cases:l", "SELECT district, date, cases FROM panel WHERE district IN (SELECT district FROM panel GROUP BY 1 ORDER BY avg(coalesce(cases, 0)) DESC, 1 LIMIT 5)")
def leading_rows(spark, d):
    return decision.in_leading_districts(panel(spark, d), 5)


@query("coverage_crosstab", "district:s m1:l m2:l m12:l", "SELECT district, count(*) FILTER (month(date) = 1) AS m1, count(*) FILTER (month(date) = 2) AS m2, count(*) FILTER (month(date) = 12) AS m12 FROM obs GROUP BY 1")
def coverage_crosstab(spark, d):
    return observed(spark, d).withColumn("m", F.concat(F.lit("m"), F.month("date"))).groupBy("district").pivot("m", [f"m{k}" for k in range(1, 13)]).count().fillna(0)


@query("alert_trend", "date:s NO_ACTION:l YELLOW:l ORANGE:l RED:l", f"SELECT date, {', '.join(f'count(*) FILTER (l = {chr(39)}{x}{chr(39)}) AS {x}' for x in decision.LEVELS)} FROM (SELECT date, {_LEVEL} AS l FROM sc) GROUP BY 1")
def alert_trend(spark, d):
    return decision.alert_trend(scores(spark, d).withColumn("alert_level", decision.alert_level(F.col("p"))))


@query("corr_matrix", "a:s b:s r:d", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM fp" for a, b in (("cases", "rainfall"), ("cases", "temperature"), ("rainfall", "temperature"))))
def corr_matrix(spark, d):
    pairs = [("cases", "rainfall"), ("cases", "temperature"), ("rainfall", "temperature")]
    return full(spark, d).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("x")).select(F.inline("x"))


@query("histogram", "bin:l n:l", "SELECT CASE WHEN rainfall = b THEN 30 ELSE CAST(floor((rainfall - a) / ((b - a) / 30)) AS INT) + 1 END AS bin, count(*) AS n FROM fp, (SELECT min(rainfall) AS a, max(rainfall) AS b FROM fp) WHERE rainfall IS NOT NULL GROUP BY 1")
def histogram(spark, d):
    f = full(spark, d).where("rainfall IS NOT NULL")
    span = F.broadcast(f.agg(F.min("rainfall").alias("a"), F.max("rainfall").alias("b")))
    at = F.when(F.col("rainfall") == F.col("b"), 30).otherwise(F.floor((F.col("rainfall") - F.col("a")) / ((F.col("b") - F.col("a")) / 30)) + 1)
    return f.crossJoin(span).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("coverage_missing_pairs", "district:s year:l", "SELECT e.district, y AS year FROM (SELECT DISTINCT district FROM obs) e, (SELECT CAST(unnest(range(1994, 2004)) AS BIGINT) AS y) WHERE (e.district, y) NOT IN (SELECT (district, year(date)) FROM obs)")
def coverage_missing_pairs(spark, d):
    o = observed(spark, d).select("district", F.year("date").alias("year")).distinct()
    grid = o.select("district").distinct().withColumn("year", F.explode(F.sequence(F.lit(1994), F.lit(2003))))
    return grid.join(o, ["district", "year"], "left_anti")


@query("integrity_profile", "n:l n_duplicates:l missing_prio:d median_price:d", "SELECT count(*) AS n, count(*) - count(DISTINCT (o_custkey, CAST(o_orderdate AS DATE))) AS n_duplicates, avg(CAST(o_orderpriority IS NULL AS INT)) AS missing_prio, quantile_cont(o_totalprice, 0.5) AS median_price FROM orders")
def integrity_profile(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("o_custkey", F.to_date("o_orderdate"))).alias("n_duplicates"), F.avg(F.isnull("o_orderpriority").cast("int")).alias("missing_prio"), F.percentile("o_totalprice", 0.5).alias("median_price"))


_EB = """rate AS (SELECT avg(cases) AS rate FROM panel), de AS (SELECT district, ln(1 + avg(cases)) AS de FROM panel GROUP BY 1), te AS (SELECT date, ln(1 + avg(cases)) AS te FROM panel GROUP BY 1)"""


@query("eb_effects", "district:s district_effect:d", f"WITH {_EB} SELECT district, de AS district_effect FROM de")
def eb_effects(spark, d):
    return posterior.effects(panel(spark, d), "cases")[1]


@query("eb_risk", "district:s date:s linear:d risk:d", f"""WITH {_EB}, l AS (SELECT p.district, p.date, de + te AS linear, t FROM panel p JOIN de ON de.district = p.district JOIN te ON te.date = p.date JOIN {P75} x ON x.district = p.district)
SELECT district, date, linear, pow(exp(linear) / (1 + exp(linear)), ceil(t)) AS risk FROM l""")
def eb_risk(spark, d):
    p = labels.global_thresholds(panel(spark, d), percentiles=(75,))
    out = posterior.linear_predictor(p, *posterior.effects(p, "cases"))
    return out.withColumn("risk", posterior.exceedance(F.col("linear"), posterior.resolve_threshold(p)))


def _draws(spark, d):
    n = bridge.places(spark, d).where("n_nationkey < 20").select("district", "n_nationkey")
    return n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("linear", (F.col("n_nationkey") + F.col("draw")) / 20.0)


_DR = "dr AS (SELECT n_name AS district, k AS draw, (n_nationkey + k) / CAST(20.0 AS DOUBLE) AS linear FROM nation, range(20) t(k) WHERE n_nationkey < 20)"


@query("posterior_risk", "district:s date:s risk_mean:d risk_q05:d risk_q95:d", f"""WITH {_DR}, a AS (SELECT district, draw, linear FROM dr UNION ALL SELECT n_name, draw, m FROM nation, (SELECT draw, avg(linear) AS m FROM dr GROUP BY 1) WHERE n_nationkey >= 20),
r AS (SELECT p.district, date, pow(exp(linear) / (1 + exp(linear)), ceil(t)) AS risk FROM panel p JOIN {P75} x ON x.district = p.district JOIN a ON a.district = p.district)
SELECT district, date, avg(risk) AS risk_mean, quantile_cont(risk, 0.05) AS risk_q05, quantile_cont(risk, 0.95) AS risk_q95 FROM r GROUP BY 1, 2""")
def posterior_risk(spark, d):
    p = labels.global_thresholds(panel(spark, d), percentiles=(75,))
    return posterior.posterior_risk(p, _draws(spark, d), F.col("threshold_p75"), ["district", "date"])


@query("draw_summary", "district:s mean:d median:d q05:d q95:d std:d exceedance:d risk_flag:l", f"""WITH {_DR} SELECT district, avg(linear) AS mean, quantile_cont(linear, 0.5) AS median, quantile_cont(linear, 0.05) AS q05, quantile_cont(linear, 0.95) AS q95, stddev_pop(linear) AS std,
avg(CAST(linear > 0.9 AS INT)) AS exceedance, CAST(avg(CAST(linear > 0.9 AS INT)) >= 0.5 AS INT) AS risk_flag FROM dr GROUP BY 1""")
def draw_summary(spark, d):
    rows = _draws(spark, d).groupBy("district").agg(F.collect_list("linear").alias("draws"))
    return posterior.draw_exceedance(posterior.draw_summary(rows), F.lit(0.9))


@query("rhat_split", "parameter:s r_hat:d", f"""WITH h AS (SELECT district AS parameter, draw % 2 AS chain, CASE WHEN draw < 10 THEN 0 ELSE 1 END AS half, linear AS v FROM ({_DR.split(' AS ', 1)[1][1:-1]})),
c AS (SELECT parameter, chain, half, avg(v) AS m, var_samp(v) AS s, count(*) AS n FROM h GROUP BY 1, 2, 3), g AS (SELECT parameter, avg(s) AS w, avg(n) * var_samp(m) AS b, avg(n) AS n FROM c GROUP BY 1)
SELECT parameter, sqrt(((n - 1) / n * w + b / n) / w) AS r_hat FROM g""")
def rhat_split(spark, d):
    dr = _draws(spark, d).select(F.col("district").alias("parameter"), (F.col("draw") % 2).alias("chain"), "draw", F.col("linear").alias("value"))
    return posterior.split_rhat(dr)


@query("subset_recent", "district:s date:s cases:l", "SELECT * FROM panel WHERE year(date) > (SELECT max(year(date)) FROM panel) - 2")
def subset_recent(spark, d):
    return posterior.recent_years(panel(spark, d), 2)


@query("subset_top_cases", "district:s date:s cases:l", "SELECT * FROM panel ORDER BY cases DESC, district, date LIMIT 50")
def subset_top_cases(spark, d):
    return posterior.top_cases(panel(spark, d), 50)


@query("stratified_sample", "district:s date:s outbreak_label:l", """SELECT district, date, outbreak_label FROM (SELECT *, row_number() OVER (PARTITION BY outbreak_label ORDER BY md5('7|' || district || '|' || CAST(date AS VARCHAR))) AS r,
count(*) OVER (PARTITION BY outbreak_label) AS n FROM (SELECT district, date, CAST(cases >= 3 AS INT) AS outbreak_label FROM panel)) WHERE r <= floor(0.2e0 * n + 0.5)""")
def stratified_sample(spark, d):
    return posterior.stratified(labels.fixed_label(panel(spark, d), 3), "outbreak_label", 0.2, ["district", "date"])


NUMERIC = ["case_lag_1", "case_lag_2", "case_roll4_mean", "case_roll4_max", "case_trend_1w", "case_cum12"]


def _oof(models_: list[str], trees: int | None = None):
    """All folds of the panel's years; the features are held, for each fold and step of a fit reads them."""

    def run(spark, d):
        f = features.causal(panel(spark, d))
        f = labels.next_step_label(labels.train_thresholds(f, 0.75, "t"), F.col("t"), "outbreak_label").where("t IS NOT NULL").persist()
        return models.out_of_fold(f, folds.rolling(spark, 1998, 2001), models_, NUMERIC, "outbreak_label", ["district", "date"], trees=trees)

    return run


for _m in ("logistic", "poisson", "negative_binomial", "random_forest", "boosted_4", "boosted_6"):
    query(f"{_m}_oof", "district:s date:s fold:l model:s score:d outbreak_label:l")(_oof([_m]))


@query("feature_audit", "feature:s score:d quality:d association:d importance:d deviation:d forest:d")
def feature_audit(spark, d):
    """The whole audit: diagnostics, signals, 20 permutations of each feature by a forest of 400 trees."""
    f = features.causal(panel(spark, d))
    f = labels.next_step_label(labels.train_thresholds(f, 0.75, "t"), F.col("t"), "outbreak_label").where("t IS NOT NULL")
    return audit.run(f, f, NUMERIC).scores


# The fitted value at a score is the largest over starts of the least mean from there to an end behind it.
_ISO = """tr AS (SELECT p, sum(y) AS s, count(*) AS n FROM sc WHERE key % 2 = 0 GROUP BY p), c AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS cs, sum(n) OVER (ORDER BY p) AS cn, s, n FROM tr),
jk AS (SELECT a.i AS j, b.i AS k, CAST(b.cs - a.cs + a.s AS DOUBLE) / (b.cn - a.cn + a.n) AS m FROM c a JOIN c b ON a.i <= b.i),
low AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM jk), g AS (SELECT p, g FROM (SELECT i, max(m) AS g FROM low GROUP BY i) JOIN c USING (i)),
nx AS (SELECT p, g, lead(p) OVER (ORDER BY p) AS p2, lead(g) OVER (ORDER BY p) AS g2 FROM g)"""


@query("isotonic_calibration", "key:l calibrated:d", f"""WITH {_ISO} SELECT t.key, CASE WHEN nx.p IS NULL THEN (SELECT arg_min(g, p) FROM g) WHEN t.p = nx.p OR p2 IS NULL THEN g ELSE g + (g2 - g) * (t.p - nx.p) / (p2 - nx.p) END AS calibrated
FROM (SELECT key, p FROM sc WHERE key % 2 = 1) t ASOF LEFT JOIN nx ON t.p >= nx.p""")
def isotonic_calibration(spark, d):
    s = scores(spark, d)
    return models.calibrate(s.where("key % 2 = 0"), s.where("key % 2 = 1"), "p", "y")


def _means(fitted):
    """Mean and diagnostics of every parameter, the districts' effects among them; few rows for each draw."""
    by_district = hierarchical.district_draws(fitted).select(F.col("district").alias("parameter"), "chain", "draw", F.col("effect").alias("value"))
    draws = held.written(fitted.common.unionByName(by_district), "draws")
    m = draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.05)).alias("q05"), F.percentile("value", F.lit(0.95)).alias("q95"))
    return m.join(diagnostics.rank_diagnostics(draws), "parameter")


@query("effect_sampler", "parameter:s mean:d r_hat:d ess:d")
def effect_sampler(spark, d):
    fitted = hierarchical.fit(panel(spark, d), "cases", [], simplified=True)
    return _means(fitted).withColumnRenamed("ess_bulk", "ess")


CLIMATE = ["rainfall", "temperature"]


@query("hierarchical_sampler", "parameter:s mean:d q05:d q95:d r_hat:d ess_bulk:d ess_tail:d")
def hierarchical_sampler(spark, d):
    """District and time effects and covariates, default draws."""
    return _means(hierarchical.fit(full(spark, d), "cases", CLIMATE))


@query("hierarchical_risk", "district:s date:s risk_mean:d risk_q05:d risk_q95:d")
def hierarchical_risk(spark, d):
    p = labels.global_thresholds(full(spark, d), percentiles=(75,))
    return pipeline.hierarchical_risk(p, p, CLIMATE, {"chains": 2, "tune": 300, "draws": 300})[0]


@query("weekly_events", "user_id:l week:s n:l total:d", "SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def weekly_events(spark, d):
    return table(spark, d, "events").groupBy("user_id", bridge.monday("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("payload_records", "customer:l id:l status:s", "SELECT o_custkey AS customer, o_orderkey AS id, o_orderstatus AS status FROM orders")
def payload_records(spark, d):
    """Each customer's orders as a page of JSON, in one container or another or in none, and the records of all pages."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("r"))
    name = F.element_at(F.array(*[F.lit(c) for c in paged.CONTAINERS]), (F.col("customer") % len(paged.CONTAINERS) + 1).cast("int"))
    page = F.when(F.col("customer") % 7 == 0, F.to_json("r")).otherwise(F.concat(F.lit('{"has_more": false, "'), name, F.lit('": '), F.to_json("r"), F.lit("}")))
    r = paged.records_of(orders.select("customer", page.alias("page")), "page")
    return r.select("customer", F.get_json_object("record", "$.id").cast("long").alias("id"), F.get_json_object("record", "$.status").alias("status"))


@query("json_payload", "event_id:l keys:l", "SELECT event_id, len(json_keys(props)) AS keys FROM events")
def json_payload(spark, d):
    return table(spark, d, "events").select("event_id", F.size(F.json_object_keys("props")).alias("keys"))
