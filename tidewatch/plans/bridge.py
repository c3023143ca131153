"""The star-schema tables as surveillance panels, in Spark and as SQL.

District is the nation, state the region, a case an order, the date the Monday of its week; rain
and temperature come from the line items shipped by the nation's suppliers. Temperatures are
missing on some days of the year, so that imputation has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.clean import complete_panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monday(c: str):
    return F.to_date(F.date_trunc("week", c))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, state, date, cases) where there are cases. Orders are counted by customer's nation
    before the names are joined."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", monday("o_orderdate").alias("date"))
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    by = orders.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "date").agg(F.count(F.lit(1)).alias("cases"))
    return by.join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey")).select("district", "state", "date", "cases")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, district, state, lat, lon): 25 rows at any scale."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(
        k, F.col("n_name").alias("district"), F.col("r_name").alias("state"), (k % 5 + k * 0.01).alias("lat"), (F.floor(k / 5) * 1.7 + k * 0.003).alias("lon")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_panel(observed(spark, sf_dir), ["district", "state"])


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", monday("l_shipdate").alias("date"), "l_quantity", F.round(F.col("l_discount") * 100).cast("long").alias("pct"))
    who = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    by = items.join(who, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "date").agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("rainfall"), (15 + F.sum("pct") / F.count(F.lit(1)) * 2).alias("temperature"))
    return by.join(F.broadcast(places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey")).select("district", "date", "rainfall", "temperature")


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with rain, temperature (missing on every 17th day of the year) and coordinates."""
    p = panel(spark, sf_dir).join(weather(spark, sf_dir), ["district", "date"], "left")
    p = p.withColumn("temperature", F.when(F.dayofyear("date") % 17 != 0, F.col("temperature")))
    return p.join(F.broadcast(places(spark, sf_dir).select("district", "lat", "lon")), "district")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, district, date, y, p): urgent orders, and a number that leans towards them."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    y = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    p = (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) + 300 * y) / 1300.0
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("key"), "district", F.to_date("o_orderdate").alias("date"), y.alias("y"), p.alias("p"))


SQL = """
place AS (SELECT n_nationkey, n_name AS district, r_name AS state, n_nationkey % 5 + n_nationkey * CAST(0.01 AS DOUBLE) AS lat,
  floor(n_nationkey / 5) * CAST(1.7 AS DOUBLE) + n_nationkey * CAST(0.003 AS DOUBLE) AS lon FROM nation JOIN region ON n_regionkey = r_regionkey),
obs AS (SELECT district, state, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, count(*) AS cases
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
span AS (SELECT min(date) AS a, max(date) AS b FROM obs),
weeks AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS date FROM span),
panel AS (SELECT e.district, e.state, w.date, coalesce(o.cases, 0) AS cases FROM (SELECT DISTINCT district, state FROM obs) e CROSS JOIN weeks w
  LEFT JOIN obs o ON o.district = e.district AND o.state = e.state AND o.date = w.date),
weather AS (SELECT district, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_quantity) / count(*) AS rainfall,
  15 + sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) * 2 AS temperature
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey GROUP BY 1, 2),
fp AS (SELECT p.*, c.rainfall, CASE WHEN dayofyear(p.date) % 17 <> 0 THEN c.temperature END AS temperature, lat, lon
  FROM panel p LEFT JOIN weather c ON c.district = p.district AND c.date = p.date JOIN place ON place.district = p.district),
sc AS (SELECT o_orderkey AS key, district, CAST(o_orderdate AS DATE) AS date, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS y,
  ((o_orderkey * 7919) % 1000 + 300 * CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT)) / CAST(1300.0 AS DOUBLE) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey)"""
