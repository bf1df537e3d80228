"""Agreement of annotators, voting of models, routing to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohens_kappa(df: DataFrame, one: str, two: str) -> DataFrame:
    """(items, observed, expected, kappa) of two label columns of the same items; 0 items give no kappa, perfect chance agreement gives 1.

    Items are first counted by their pair of labels, a table whose size is that of the label set squared.
    """
    cells = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(F.col(one).alias("a"), F.col(two).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("c"))
    j = total.where("items > 0").crossJoin(F.broadcast(chance))
    observed, expected = F.col("same") / F.col("items"), F.col("c") / (F.col("items").cast("double") * F.col("items"))
    return j.select("items", observed.alias("observed"), expected.alias("expected"), F.when(expected >= 1, 1.0).otherwise((observed - expected) / (1 - expected)).alias("kappa"))


def fleiss_kappa(df: DataFrame, item: str, value: str) -> DataFrame:
    """(items, kappa) of ratings in long form, of the items with two ratings or more."""
    cells = df.where(F.col(value).isNotNull()).groupBy(item, F.col(value).alias("v")).agg(F.count("*").cast("double").alias("n"))
    per = cells.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s")).where("r > 1")
    mean = per.agg(F.count("*").alias("items"), F.avg(F.col("s") / (F.col("r") * (F.col("r") - 1))).alias("p"))
    used = cells.join(per.select(item), item, "left_semi").groupBy("v").agg(F.sum("n").alias("n"))
    chance = used.agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2.0))).alias("pe"))
    return mean.where("items > 0").crossJoin(F.broadcast(chance)).select("items", F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def vote(df: DataFrame, item: str, value: str, weight: Column | None = None) -> DataFrame:
    """(item, winner, share): the value with most weight, the first by order among equals."""
    w = weight if weight is not None else F.lit(1.0)
    sums = df.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.sum(w).alias("w"))
    return sums.groupBy(item).agg(F.min_by(value, F.struct(-F.col("w"), F.col(value))).alias("winner"), (F.max("w") / F.sum("w")).alias("share"))


def route(df: DataFrame, kind: str, confidence: str, thresholds: dict[str, float], default: float = 0.9) -> DataFrame:
    """Every row with `route`: accepted at or above the threshold of its kind, else review; no confidence goes to review."""
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in thresholds.items() for x in p]), F.col(kind)), F.lit(default))
    return df.withColumn("route", F.when(F.col(confidence) >= least, "accepted").otherwise("review"))
