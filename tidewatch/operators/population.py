"""Joining a population table by normalized names, with fallbacks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import text_key, token_key
from tidewatch.operators.clean import keep_one


def find_column(names: list[str], wanted: list[str]) -> str | None:
    """The best name: equal, then starting, then containing; ties by the name."""
    def score(name: str) -> int:
        plain = re.sub(r"[^a-z0-9]", "", name.lower())
        return max((100 if plain == w else 90 if plain.startswith(w) else 80 if w in plain else 0) for w in (re.sub(r"[^a-z0-9]", "", x.lower()) for x in wanted))

    ranked = sorted((-score(n), n) for n in names if score(n))
    return ranked[0][1] if ranked else None


def with_keys(df: DataFrame, state: str, district: str) -> DataFrame:
    return df.withColumns({"_sk": text_key(F.col(state)), "_dk": text_key(F.col(district)), "_tk": token_key(F.col(district))}).withColumn("_mk", F.concat_ws("|", "_sk", "_dk"))


def canonical_census(df: DataFrame) -> DataFrame:
    """(state, district, others) of the district rows for the total of town and country; a state's
    name comes from its own row by code."""
    low = lambda c: F.lower(F.btrim(F.col(c)))
    total = df.where(low("tru") == "total") if "tru" in df.columns else df
    districts = total.where(low("level") == "district")
    states = total.where(low("level") == "state").groupBy(F.col("state").alias("_code")).agg(F.min("name").alias("_state"))
    rest = [c for c in df.columns if c not in ("level", "tru", "name", "state")]
    return districts.join(states, districts["state"] == states["_code"], "left").select(F.coalesce("_state", districts["state"].cast("string")).alias("state"), F.col("name").alias("district"), *rest)


def merge_population(df: DataFrame, census: DataFrame, payload: list[str], state: str = "state", district: str = "district") -> DataFrame:
    """``df`` with the census ``payload``: by state and district; where that finds nothing, by the
    district's name if it stands for one place only; by the name's words only if neither has
    found anything at all. The three sides are deduplicated first, so no row multiplies.

    The cascade runs over the distinct names of ``df``, whose number does not grow with the dates; what it
    finds is joined to the rows once. Null names are names."""
    names = df.select(F.col(state).alias("_state"), F.col(district).alias("_district")).distinct()
    left = with_keys(names, "_state", "_district")
    right = keep_one(with_keys(census, state, district), ["_mk"], [F.col(c).asc_nulls_last() for c in ["_mk", *payload]])

    def unique(key: str, tag: str) -> DataFrame:
        by = right.groupBy(F.col(key).alias(f"_{tag}")).agg(F.countDistinct("_mk").alias("_n"), *[F.min(c).alias(f"{tag}_{c}") for c in payload])
        return by.where("_n = 1").drop("_n")

    main = right.select("_mk", *[F.col(c).alias(f"m_{c}") for c in payload])
    out = left.join(main, "_mk", "left").join(unique("_dk", "d"), F.col("_dk") == F.col("_d"), "left").join(unique("_tk", "t"), F.col("_tk") == F.col("_t"), "left")
    found = F.coalesce(*[F.col(f"{tag}_{c}") for tag in ("m", "d") for c in payload]).isNotNull()
    any_found = out.agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("_any"))
    fill = {f"_p_{c}": F.coalesce(f"m_{c}", f"d_{c}", F.when(~F.col("_any"), F.col(f"t_{c}"))) for c in payload}
    known = out.crossJoin(F.broadcast(any_found)).withColumns(fill).select("_state", "_district", *fill)
    kept = [c for c in df.columns if c not in payload]
    met = df.join(known, df[state].eqNullSafe(known["_state"]) & df[district].eqNullSafe(known["_district"]), "left")
    return met.select(*[df[c] for c in kept], *[known[f"_p_{c}"].alias(c) for c in payload])
