"""Queries of the training-data operators, over the whole of their tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import boilerplate, bpe, budget, confusables, langid, leakage, mojibake, names, packing, segment, splitting
from lexforge.runtime import table


def _people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata").select(F.explode(F.array("author", "translator")).alias("name"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.link(_people(spark, d)))


def p1_linked(spark: SparkSession, d: str) -> DataFrame:
    return names.link(_people(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_items").where(F.col("content").isNotNull())


def _languages(spark: SparkSession, d: str):
    """The restored pages with what training read of them, and the models that all of them teach."""
    read, *models = langid.readings(langid.pages_of(_items(spark, d), "id", "content", "language", "url"))
    return read.withColumnsRenamed({"k": "id", "t": "content"}), *models


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    pages, network, weights = _languages(spark, d)
    return langid.languages(pages, "id", "content", network, weights, "site", ready=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pages, network, weights = _languages(spark, d)
    found = langid.document_languages(pages, "id", "content", "a", network, weights, "site", ready=True)
    label, named = F.lower(F.trim("label")), langid.named("label")
    case = found.where(label.isNull() | label.isin(*sorted(langid.NO_LABEL)) | named.isNull() | (F.size("languages") > 1) | (named != F.col("language")))
    return case.select("id", F.explode("languages").alias("language"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    weights = boilerplate.fit((r["t"], r["u"]) for r in boilerplate.sample(items, "id", "content", "url", langid.named("language")))
    return boilerplate.strip_pages(items, "id", "content", weights, "url")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", F.explode("page_lines").alias("line_no"))


def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("id", "main_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    items = confusables.consistent(_items(spark, d).select("id", "content"), "id", "content")
    tokens = table(spark, d, "tokens").select("token_id", "lemma", "form").where(confusables.worth_a_look("lemma", "form"))
    lemmas = confusables.consistent(tokens, "token_id", "lemma", context="form")
    one = items.where("changes > 0").select(F.lit("corpus_items").alias("src_table"), F.col("id").alias("row_id"))
    # a repeated token row has its number once
    two = lemmas.where("changes > 0").select(F.lit("tokens").alias("src_table"), F.col("token_id").alias("row_id")).distinct()
    return one.unionByName(two)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "corpus_items").where(F.col("status").isin("parsed", "annotated") & F.col("content").isNotNull())
    return segment.split_sentences(parsed.select("id", "content"), "id", "content", segment.learn(parsed, "content")).select("id", "end_pos")


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).select("id", "content")
    return segment.split_sentences(items, "id", "content", segment.learn(items, "content"))


def p6_budget(spark: SparkSession, d: str) -> DataFrame:
    items = budget.item_counts(table(spark, d, "corpus_items"), table(spark, d, "metadata"))
    documents = budget.document_counts(table(spark, d, "documents"), table(spark, d, "sources"))
    return budget.totals(items, "corpus_items").unionByName(budget.totals(documents, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(_items(spark, d).select("id", "content"), "id", "content").where("spans > 0").select("id")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(_items(spark, d).select("id", "content"), "id", "content").where("spans > 0")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sized = bpe.with_token_counts(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "n_tokens")
    return packing.pack(sized, "doc_id", "n_tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece_no = 0").select("doc_id")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_linked, p2_found, p2_segments, p3_found, p3_main_text, p4_found, p5_found, p5_sentences, p6_budget, p7_found, p7_restored, p8_containers, p9_found, p10_found, p10_pieces,
)}

#: None of these can be put in SQL whole; tests hold them against brute force, round trips and held-out accuracy.
SQL: dict[str, str] = {}
