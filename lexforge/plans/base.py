"""Canonical corpus views over the stored tables, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.runtime import table

#: Order of the periods (fixed values).
PERIODS = ("archaic", "classical", "hellenistic", "koine", "medieval", "early_modern", "modern")


def period_rank(c):
    """Position of a period in time, null for an unknown one."""
    out = F.when(c == PERIODS[0], 0)
    for k, p in enumerate(PERIODS[1:], 1):
        out = out.when(c == p, k)
    return out.cast("int")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """The fact table, a row stored twice taken once. One shuffle by sentence serves this and every window over a sentence behind it; only the
    columns that a query uses move."""
    return table(spark, d, "tokens").repartition("sentence_id").dropDuplicates(["sentence_id", "token_id"])


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """One metadata row for each item: the latest, ties broken by its values."""
    w = W.partitionBy("item_id").orderBy(*[F.col(c).desc_nulls_last() if c == "date_added" else F.col(c).asc_nulls_last() for c in ("date_added", "title", "author", "translator", "genre", "period")])
    period = F.regexp_replace(F.lower(F.trim("period")), r"\s+", "_")
    return table(spark, d, "metadata").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("period", period)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """document_id, language, period, genre, author of the collected items."""
    items = table(spark, d, "corpus_items").select(F.col("id").alias("document_id"), F.coalesce(F.lower(F.trim("language")), F.lit("und")).alias("language"), "status")
    m = metadata(spark, d).select(F.col("item_id").alias("document_id"), "period", "genre", "author", "title")
    return items.join(m, "document_id", "left")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Stored sentences, the earliest of repeated rows."""
    w = W.partitionBy("sentence_id").orderBy(F.col("created_at").asc_nulls_last(), F.col("text").asc_nulls_last())
    return table(spark, d, "sentences").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


TOK = "tok AS (SELECT DISTINCT * FROM tokens)"
META = """meta AS (SELECT * EXCLUDE (rn, period), regexp_replace(lower(trim(period)), '\\s+', '_', 'g') AS period FROM (SELECT *, row_number() OVER (PARTITION BY item_id
 ORDER BY date_added DESC NULLS LAST, title ASC NULLS LAST, author ASC NULLS LAST, translator ASC NULLS LAST, genre ASC NULLS LAST, period ASC NULLS LAST) AS rn FROM metadata) WHERE rn = 1)"""
DOC = META + """, doc AS (SELECT c.id AS document_id, coalesce(lower(trim(c.language)), 'und') AS language, c.status, m.period, m.genre, m.author, m.title
 FROM corpus_items c LEFT JOIN meta m ON m.item_id = c.id)"""
SEN = "sen AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY created_at ASC NULLS LAST, text ASC NULLS LAST) AS rn FROM sentences) WHERE rn = 1)"
RANK = "CASE period " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(PERIODS)) + " END"
