"""Keeping tables: replace and additive upserts, incremental selection, duplicates, search and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def replace_into(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` take the place of rows of `old` with their key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key is new."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def add_up(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters of both tables, summed by key."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def unchanged_out(new: DataFrame, seen: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows that are new or whose digest differs from the one seen."""
    return new.join(seen.select(key, digest), [key, digest], "left_anti")


def duplicates(df: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, duplicate_of): every row beyond the first of its digest. Counting by digest comes first, so a hot digest is one row before the join."""
    first = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("duplicate_of"), F.count("*").alias("n")).where("n > 1")
    return df.select(key, digest).join(first, digest).where(F.col(key) != F.col("duplicate_of")).select(key, "duplicate_of")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of a sorted table. The order must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def stage(items: DataFrame, status: str, most: int, outcome: Column, error: Column) -> DataFrame:
    """(id, status, error): one turn of a stage of the pipeline. The `most` items that wait in a status, the highest priority and then the oldest first, get
    the status and error that the expressions give. The result is merged with `replace_into`; turns follow until one is empty."""
    waiting = items.where(F.col("status") == status).orderBy(F.col("priority").desc_nulls_last(), F.col("created_at").asc_nulls_last(), "id").limit(most)
    return waiting.select("id", outcome.alias("status"), error.alias("error"))


def until_idle(items: DataFrame, stages: list[tuple[str, int, Column, Column]], turns: int | None = None) -> DataFrame:
    """The items after turns of all stages (status, most, outcome, error), in order, until a turn changes nothing or `turns` are over. Each turn's table is
    written to the shared folder, so a lost executor costs one turn at most."""
    from lexforge.runtime import cut

    items = items if "error" in items.columns else items.withColumn("error", F.lit(None).cast("string"))
    done = 0
    while turns is None or done < turns:
        moved = False
        for status, most, outcome, error in stages:
            new = cut(stage(items, status, most, outcome, error))
            if new.limit(1).count():
                moved = True
                kept = items.join(new.select("id"), "id", "left_anti")
                items = cut(kept.unionByName(items.drop("status", "error").join(new, "id").select(*items.columns)))
        done += 1
        if not moved:
            break
    return items
