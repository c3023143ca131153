"""Window features over a panel: lags, trailing statistics, climate anomalies, neighbours.

All windows of a function share one partitioning and order, so they need one exchange and sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.dates import season
from tidewatch.functions.values import is_true, ratio
from tidewatch.operators import held
from tidewatch.operators.labels import in_order

DEGENERATE = 1e-12


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"year": F.year(date), "month": F.month(date), "weekofyear": F.weekofyear(date)})


def _before(w: W, n: int) -> W:
    return w.rowsBetween(-n, -1)


def temporal(df: DataFrame, cases: str = "cases", district: str | None = "district", date: str = "date", lags=(1, 2)) -> DataFrame:
    """Lags, mean and deviation of the four rows before, first and second differences. Without a
    district the whole table is one series and one task; give one where there is any."""
    order = F.col(date).asc_nulls_last()
    w = W.partitionBy(district).orderBy(order) if district else W.orderBy(order)
    c = F.col(cases).cast("double")
    lag = lambda k: F.lag(c, k).over(w)
    four = _before(w, 4)
    return df.withColumns({
        "case_rolling_mean": F.avg(c).over(four),
        "case_rolling_std": F.coalesce(F.when(F.count(c).over(four) >= 3, F.stddev_samp(c).over(four)), F.lit(0.0)),
        "case_velocity": lag(1) - lag(2),
        "case_acceleration": (lag(1) - lag(2)) - (lag(2) - lag(3)),
        **{f"case_lag_{k}": lag(k) for k in lags},
    })


def causal(df: DataFrame, cases: str = "cases", district: str = "district", date: str = "date", signals=("rt", "p_rt1", "receptivo")) -> DataFrame:
    """Features of the rows before only; what cannot be computed is 0."""
    w = in_order(district, date)
    c = F.col(cases).cast("double")
    lag = lambda k: F.lag(c, k).over(w)
    mean, var = F.avg(c).over(_before(w, 4)), F.var_samp(c).over(_before(w, 4))
    cols = {
        **{f"case_lag_{k}": lag(k) for k in (1, 2, 3, 4)},
        "case_roll4_mean": mean, "case_roll4_var": var, "case_roll4_max": F.max(c).over(_before(w, 4)),
        "case_roll4_cv": ratio(F.sqrt(F.when(var < 0, 0.0).otherwise(var)), mean),
        "case_trend_1w": lag(1) - lag(2), "case_trend_4w": lag(1) - lag(4), "case_cum12": F.sum(c).over(_before(w, 12)),
        **{f"{s}_lag_1": F.lag(F.col(s).cast("double"), 1).over(w) for s in signals if s in df.columns},
    }
    return calendar(df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in cols.items()}), date)


def stats_row(df: DataFrame, c: Column, tag: str) -> DataFrame:
    """One row: whether a column is degenerate (no or one value, no variance), and its median."""
    return df.agg(((F.count(c) == 0) | (F.countDistinct(c) <= 1) | (F.coalesce(F.var_pop(c), F.lit(0.0)) <= DEGENERATE)).alias(f"{tag}_flat"), F.percentile(c, 0.5).alias(f"{tag}_median"))


def climate(df: DataFrame, temperature: str = "temperature", rainfall: str = "rainfall", district: str = "district", date: str = "date") -> DataFrame:
    """Degree days over 20, the optimal range 25 to 30, anomalies, rain of four weeks, interaction.

    Where a feature is degenerate over the whole table, a relative form takes its place; whether
    it is, is one aggregated row, joined by broadcast. The anomaly is against the district's
    season, then the district, the season, all, the first that is not degenerate."""
    t = F.col(temperature).cast("double")
    out = df.withColumn("season", season(F.month(date)))
    groups = [[district, "season"], [district], ["season"], []]
    means = {f"_mean{i}": F.avg(t).over(W.partitionBy(*[F.col(g) for g in keys])) for i, keys in enumerate(groups[:3])}
    out = out.withColumns(means).crossJoin(F.broadcast(out.agg(F.avg(t).alias("_mean3"))))
    fixed_days, fixed_range = F.greatest(t - 20, F.lit(0.0)), is_true(t.between(25, 30))
    fixed_days = F.when(t.isNull(), None).otherwise(fixed_days)
    checks = [stats_row(out, fixed_days, "dd"), stats_row(out, fixed_range.cast("double"), "opt"), stats_row(out, t, "t"), *[stats_row(out, t - F.col(f"_mean{i}"), f"a{i}") for i in range(3)]]
    flags = reduce(lambda a, b: a.crossJoin(b), checks)
    out = out.crossJoin(F.broadcast(flags))
    anomaly = F.when(~F.col("a0_flat"), t - F.col("_mean0")).when(~F.col("a1_flat"), t - F.col("_mean1")).when(~F.col("a2_flat"), t - F.col("_mean2")).otherwise(t - F.col("_mean3"))
    rain = F.sum(F.col(rainfall)).over(in_order(district, date).rowsBetween(-3, 0))
    out = out.withColumns({
        "degree_days": F.when(F.col("dd_flat"), t - F.col("t_median")).otherwise(fixed_days),
        "temp_optimal": F.when(F.col("opt_flat"), is_true(t.between(F.col("t_median") - 2.5, F.col("t_median") + 2.5))).otherwise(fixed_range),
        "temp_anomaly": anomaly, "rainfall_4wk": rain, "temp_rain_interaction": t * F.col(rainfall),
    })
    return out.select(*df.columns, "season", "degree_days", "temp_optimal", "temp_anomaly", "rainfall_4wk", "temp_rain_interaction")


def group_anomaly(df: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    by = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg(column).alias("_mean"))
    return df.join(by, [df[k].eqNullSafe(by[f"_{k}"]) for k in keys], "left").withColumn(name, F.col(column) - F.col("_mean")).drop("_mean", *[f"_{k}" for k in keys])


def district_codes(df: DataFrame, district: str = "district") -> DataFrame:
    """Codes by name order from 0, -1 for null; ranked over the distinct names only."""
    codes = df.select(F.col(district).alias("_d")).where("_d IS NOT NULL").distinct().withColumn("district_code", F.dense_rank().over(W.orderBy("_d")) - 1)
    return df.join(codes, df[district] == codes["_d"], "left").withColumn("district_code", F.coalesce("district_code", F.lit(-1))).drop("_d")


def centroids(df: DataFrame, district: str = "district", lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(district).agg(F.avg(lat).alias(lat), F.avg(lon).alias(lon))


#: Sides of the extent are halved so often at most, and cells with up to so many places for each neighbour are searched whole.
LEVELS, CROWD = 20, 64
#: Places of different coordinates that are searched in one cell without looking for a finer grid.
FEW = 2000


def neighbours(places: DataFrame, k: int = 3, district: str = "district", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(src, dst, distance, rank): the ``k`` nearest other places, ties by name; fewer where there are fewer.

    Places of equal coordinates are one point with its first ``k + 1`` names. Points are dealt to cells of a
    grid, the finest at first whose cells are not crowded; a point meets those of its own and the eight cells
    around. Whatever is nearer than a cell's side is among them, so a point is done when its ``k``-th neighbour
    is; the others go on with cells of twice the side, until one cell holds all. Places without a name or
    coordinates have no neighbours and are none; repeated rows count once."""
    named = places.select(F.col(district).alias("name"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")).where("name IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").distinct()
    rank = F.row_number().over(W.partitionBy("x", "y").orderBy("name"))
    points = held.written(named.withColumn("r", rank), "places")
    firsts = points.where(F.col("r") <= k + 1).groupBy("x", "y").agg(F.array_sort(F.collect_list("name")).alias("names"))
    firsts = held.written(firsts, "points")
    about = firsts.agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side")).first()
    side = max(about["side"] or 0.0, 1e-300) * (1 + 1e-9)
    cell = lambda c, least, size: F.floor((F.col(c) - F.lit(least)) / F.lit(size))
    level = 0
    if about["n"] > FEW:
        at = firsts.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("size", F.lit(side) / F.pow(F.lit(2.0), F.col("level")))
        crowd = at.groupBy("level", F.floor((F.col("x") - about["x"]) / F.col("size")), F.floor((F.col("y") - about["y"]) / F.col("size"))).count().groupBy("level").agg(F.max("count").alias("n")).collect()
        level = min([r["level"] for r in crowd if r["n"] <= CROWD * k] or [LEVELS])
    todo, done = firsts.select("x", "y"), []
    while True:
        size = side / 2**level
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in ((-1, 0, 1) if level else (0,)) for j in ((-1, 0, 1) if level else (0,))])
        asks = todo.withColumns({"cx": cell("x", about["x"], size), "cy": cell("y", about["y"], size), "o": F.explode(around)}).select("x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        there = firsts.select(F.col("x").alias("u"), F.col("y").alias("v"), "names", cell("x", about["x"], size).alias("cx"), cell("y", about["y"], size).alias("cy"))
        dy, dx = F.col("y") - F.col("v"), F.col("x") - F.col("u")
        met = asks.join(there, ["cx", "cy"]).withColumn("distance", F.sqrt(dy * dy + dx * dx)).select("x", "y", "distance", F.explode("names").alias("dst"))
        near = W.partitionBy("x", "y").orderBy("distance", "dst")
        best = met.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
        lists = best.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("near"))
        # one of them can be the place itself, so k + 1 are needed; nothing nearer than a cell's side is missing
        sure = F.lit(True) if not level else (F.size("near") > k) & (F.element_at("near", -1)["distance"] < F.lit(size * (1 - 1e-9)))
        found = held.written(lists.withColumn("sure", sure), "near")
        done.append(found.where("sure").select("x", "y", "near"))
        if not level or found.where("NOT sure").isEmpty():
            break
        todo, level = found.where("NOT sure").select("x", "y"), level - 1
    lists = reduce(DataFrame.unionByName, done)
    rows = points.join(lists, ["x", "y"]).select(F.col("name").alias("src"), F.posexplode(F.slice(F.filter("near", lambda e: e["dst"] != F.col("name")), 1, k)).alias("p", "e"))
    return rows.select("src", "e.dst", "e.distance", (F.col("p") + 1).alias("rank"))


def neighbour_mean(df: DataFrame, edges: DataFrame, cases: str = "cases", district: str = "district", date: str = "date") -> DataFrame:
    """``neighbor_mean_cases``: the mean over neighbours with a row at the date of their value one
    observation before."""
    daily = df.groupBy(district, date).agg(F.avg(cases).alias("_c"))
    lagged = daily.withColumn("_l", F.lag("_c").over(W.partitionBy(district).orderBy(date)))
    hit = edges.join(lagged, edges["dst"] == lagged[district]).groupBy(F.col("src").alias("_s"), F.col(date).alias("_t")).agg(F.avg("_l").alias("neighbor_mean_cases"))
    return df.join(hit, (df[district] == hit["_s"]) & (df[date] == hit["_t"]), "left").drop("_s", "_t")


def neighbour_last_mean(df: DataFrame, edges: DataFrame, order: str, cases: str = "cases", district: str = "district") -> DataFrame:
    """``neighbor_mean_cases`` where there are no dates: the mean over neighbours of their last value
    before this row in ``order``. Observations and rows of an edge are one sorted stream, so
    the last value is a running one."""
    seen = edges.join(df, edges["dst"] == df[district]).select("src", "dst", F.col(order).alias("_o"), F.col(cases).cast("double").alias("_v"), F.lit(0).alias("_ask"))
    asks = edges.join(df, edges["src"] == df[district]).select("src", "dst", F.col(order).alias("_o"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_ask"))
    w = W.partitionBy("src", "dst").orderBy("_o", F.desc("_ask")).rowsBetween(W.unboundedPreceding, -1)
    last = seen.unionByName(asks).withColumn("_l", F.last("_v", ignorenulls=True).over(w)).where("_ask = 1")
    mean = last.groupBy("src", "_o").agg(F.avg("_l").alias("neighbor_mean_cases"))
    return df.join(mean, (df[district] == mean["src"]) & (df[order] == mean["_o"]), "left").drop("src", "_o")


def order_issues(df: DataFrame, order: list[str], district: str = "district", date: str = "date") -> DataFrame:
    """How often a date is before the one of the row before it, and how many keys are double."""
    w = W.partitionBy(district).orderBy(*order)
    back = F.coalesce((F.col(date) < F.lag(date).over(w)).cast("long"), F.lit(0))
    double = (F.count(F.lit(1)).over(W.partitionBy(district, date)) > 1).cast("long")
    return df.select(back.alias("b"), double.alias("d")).agg(F.sum("b").alias("n_backward"), F.sum("d").alias("n_duplicate_rows"))


def month_index(year: Column, month: Column) -> Column:
    m = F.when(month < 1, 1).when(month > 12, 12).otherwise(month)
    return F.make_date(F.coalesce(year, F.lit(1970)), F.coalesce(m, F.lit(1)), F.lit(1))
