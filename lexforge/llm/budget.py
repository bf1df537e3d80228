"""Tokens of each text under an existing vocabulary, totalled exactly by source, language, domain and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.llm.bpe import VOCABULARY, with_token_counts
from lexforge.llm.langid import named

SLICES = ("source", "language", "domain", "period")


def spelt(column: str):
    """One spelling of a label: lower case, blanks and hyphens as underscores; empty and null as 'unknown'."""
    c = F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-]+", "_")
    return F.when(c.isNull() | (c == ""), F.lit("unknown")).otherwise(c)


def language(column: str):
    """The code of the language that a label names in whatever spelling or code system; 'unknown' where it names none."""
    return F.coalesce(named(column), F.lit("unknown"))


def one_per_item(metadata: DataFrame, key: str = "item_id") -> DataFrame:
    """The latest of an item's metadata rows; among equals the smallest by its values."""
    w = W.partitionBy(key).orderBy(F.col("date_added").desc_nulls_last(), F.col("period").asc_nulls_last(), F.col("genre").asc_nulls_last())
    return metadata.select(key, "period", "genre", "date_added").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "date_added")


def item_counts(items: DataFrame, metadata: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, language, domain, period, n_tokens) of corpus_items with content."""
    counted = with_token_counts(items.where(F.col("content").isNotNull()).select("id", "source_type", "language", "content"), "content", vocabulary=vocabulary)
    m = one_per_item(metadata).withColumnRenamed("item_id", "id")
    j = counted.drop("content").join(m, "id", "left")
    return j.select("id", spelt("source_type").alias("source"), language("language").alias("language"), spelt("genre").alias("domain"), spelt("period").alias("period"), "n_tokens")


def document_counts(documents: DataFrame, sources: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, language, domain, period, n_tokens) of documents with a text."""
    counted = with_token_counts(documents.where(F.col("text").isNotNull()).select("doc_id", "source", "lang", "period", "text"), "text", vocabulary=vocabulary)
    s = sources.select(F.col("source"), F.col("domain")).dropDuplicates(["source"])
    j = counted.drop("text").join(s, "source", "left")
    return j.select(F.col("doc_id").alias("id"), spelt("source").alias("source"), language("lang").alias("language"), spelt("domain").alias("domain"), spelt("period").alias("period"), "n_tokens")


def totals(counts: DataFrame, table: str) -> DataFrame:
    """(src_table, source, language, domain, period, texts, n_tokens) for every slice, each single dimension and the whole.

    Rows are first added up by all four labels, so a source with a third of the rows moves as few rows as any other; the other levels are
    sums of these and agree with them exactly. A label that a level leaves out is '*'.
    """
    fine = counts.groupBy(*SLICES).agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("n_tokens"))
    sets = [[*SLICES], *([s] for s in SLICES), []]
    out = fine.groupingSets([[F.col(c) for c in x] for x in sets], *SLICES).agg(
        *(F.grouping(c).alias(f"_{c}") for c in SLICES), F.sum("texts").alias("texts"), F.sum("n_tokens").alias("n_tokens")
    )
    return out.select(F.lit(table).alias("src_table"), *(F.when(F.col(f"_{c}") == 1, F.lit("*")).otherwise(F.col(c)).alias(c) for c in SLICES), "texts", "n_tokens")
