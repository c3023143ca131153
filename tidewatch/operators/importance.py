"""Feature importance: of fitted trees, and by permuting a feature in later rows."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators import held
from tidewatch.operators.impute import median_impute
from tidewatch.operators.metrics import average_precision_by
from tidewatch.operators.ranks import quantiles_now


def time_split(df: DataFrame, share: float = 0.8, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """The rows up to the date under which ``share`` of the rows lie, and those after it."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    cut = quantiles_now(df.select(day.alias("day")), ["day"], [share])["day"]
    late = day > cut[0] if cut else F.lit(False)
    return df.where(~late), df.where(late)


def permuted(df: DataFrame, columns: list[str], key: list[str], seed: int, repeats: int, rows: int = 10_000) -> DataFrame:
    """The rows of ``df`` once for each repeat ``_r``, with ``_donor``: the ``columns`` of another row. In groups
    by hash of about ``rows`` rows each takes the next one's by another hash, the last those of the first;
    a repeat has its own groups and order."""
    groups = max(1, -(-df.count() // rows))
    out = df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    out = out.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed + 1), "_r", *key), F.lit(groups)))
    w = W.partitionBy("_r", "_g").orderBy(F.xxhash64(F.lit(seed), "_r", *key), *key)
    whole = F.struct(*columns)
    return out.withColumn("_donor", F.coalesce(F.lead(whole).over(w), F.first(whole).over(w))).drop("_g")


def forest(train: DataFrame, numeric: list[str], target: str, trees: int = 400, depth: int = 10, seed: int = 42):
    t = train.withColumn("_y", F.col(target).cast("double"))
    stages = [VectorAssembler(inputCols=numeric, outputCol="_features", handleInvalid="keep"), RandomForestClassifier(featuresCol="_features", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(t)


def tree_importances(model, numeric: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(numeric, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def permutation_importance(df: DataFrame, numeric: list[str], target: str, key: list[str], repeats: int = 20, trees: int = 400, seed: int = 42) -> DataFrame:
    """(feature, importance, deviation, forest): by how much the average precision on the later fifth
    of the rows falls when a feature is permuted there, over ``repeats`` permutations.

    A permutation gives each row another row's features, of which one is taken at a time. All features
    and repeats are rows of one table, scored in one job; average precision is grouped by them. ``numeric``
    may not be empty; a fall is null where the later rows have no label of 1."""
    filled = held.written(median_impute(df.select(*dict.fromkeys([*key, "date", target, *numeric])), numeric, []), "filled")
    train, test = time_split(filled)
    model = forest(train, numeric, target, trees, seed=seed)
    weights = tree_importances(model, numeric)
    moved = permuted(test, numeric, key, seed, repeats).withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(numeric))])))
    moved = moved.select("_f", "_r", target, *[F.when(F.col("_f") == i, F.col("_donor")[c]).otherwise(F.col(c)).alias(c) for i, c in enumerate(numeric)])
    base = test.select(F.lit(-1).alias("_f"), F.lit(0).alias("_r"), target, *numeric)
    scored = model.transform(base.unionByName(moved)).select("_f", "_r", target, vector_to_array("probability")[1].alias("_p"))
    found = average_precision_by(held.written(scored, "scored"), target, "_p", ["_f", "_r"]).collect()  # a row for each feature and repeat
    base_of = {r["_f"]: r["average_precision"] for r in found if r["_f"] < 0}
    rows = []
    for name, weight in weights:
        falls = [base_of[-1] - r["average_precision"] for r in found if r["_f"] == numeric.index(name) and r["average_precision"] is not None]
        mean = sum(falls) / len(falls) if falls else None
        rows.append((name, mean, (sum((x - mean) ** 2 for x in falls) / len(falls)) ** 0.5 if falls else None, weight))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, deviation double, forest double")
