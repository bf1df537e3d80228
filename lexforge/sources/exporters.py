"""Texts in exchange formats, made by column expressions and written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import escape_xml


def _or_blank(c: str):
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("_"))


def conllu(tokens: DataFrame) -> DataFrame:
    """(sentence_id, conllu): ten columns a token, an underscore for what is missing."""
    line = F.concat_ws("\t", F.col("token_index").cast("string"), _or_blank("form"), _or_blank("lemma"), _or_blank("upos"), F.lit("_"), _or_blank("feats"), _or_blank("head"), _or_blank("deprel"), F.lit("_"), F.lit("_"))
    rows = tokens.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("token_index", line.alias("l")))).alias("x"))
    return rows.select("sentence_id", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("conllu"))


def proiel(tokens: DataFrame) -> DataFrame:
    """(sentence_id, xml): a sentence element with its token elements."""
    att = lambda n, c: F.concat(F.lit(f' {n}="'), escape_xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"'))
    head = F.when(F.col("head") > 0, F.concat(F.lit(' head-id="'), F.col("head").cast("string"), F.lit('"'))).otherwise("")
    token = F.concat(F.lit("<token"), att("id", "token_index"), att("form", "form"), att("lemma", "lemma"), att("part-of-speech", "upos"), head, att("relation", "deprel"), F.lit("/>"))
    rows = tokens.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("token_index", token.alias("l")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["l"]), "")
    return rows.select("sentence_id", F.concat(F.lit('<sentence id="'), F.col("sentence_id").cast("string"), F.lit('">'), body, F.lit("</sentence>")).alias("xml"))


def proiel_documents(tokens: DataFrame) -> DataFrame:
    """(document_id, xml): a whole file with its sentences, in order. A document is bounded."""
    s = proiel(tokens).join(tokens.select("sentence_id", "document_id").distinct(), "sentence_id")
    doc = s.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("sentence_id", "xml"))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["xml"]), "\n")
    return doc.select("document_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<proiel schema-version="3.0"><source id="'), F.col("document_id").cast("string"), F.lit('">\n'), body, F.lit("\n</source></proiel>")).alias("xml"))


def tei(items: DataFrame) -> DataFrame:
    """(id, tei): one document with title, author and text, escaped."""
    e = lambda c: escape_xml(F.coalesce(F.col(c), F.lit("")))
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), e("title"), F.lit("</title><author>"), e("author"),
        F.lit("</author></titleStmt></fileDesc></teiHeader><text><body><p>"), e("content"), F.lit("</p></body></text></TEI>"),
    )
    return items.select("id", xml.alias("tei"))


def markdown(items: DataFrame) -> DataFrame:
    """(id, note): a note with its properties above the text."""
    line = lambda n, c: F.concat(F.lit(f"{n}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"))
    return items.select("id", F.concat(F.lit("---\n"), line("title", "title"), line("author", "author"), line("language", "language"), line("period", "period"), F.lit("---\n\n"), F.coalesce("content", F.lit(""))).alias("note"))


def training_rows(items: DataFrame) -> DataFrame:
    """(id, text, language, word_count) with a text, for JSON lines."""
    return items.where(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0).select("id", F.col("content").alias("text"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("word_count", F.lit(0)).alias("word_count"))


def nested(tokens: DataFrame) -> DataFrame:
    """(document_id, json): a document's sentences with their tokens, in order. A document is bounded."""
    t = F.struct("token_index", "form", "lemma", "upos", "head", "deprel", "feats")
    s = tokens.groupBy("document_id", "sentence_id").agg(F.sort_array(F.collect_list(t)).alias("tokens"))
    doc = s.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("sentence_id", "tokens"))).alias("sentences"))
    return doc.select("document_id", F.to_json(F.struct("document_id", "sentences")).alias("json"))


def paula(tokens: DataFrame) -> DataFrame:
    """(document_id, xml): document, sentence and token elements."""
    att = lambda n, c: F.concat(F.lit(f' {n}="'), escape_xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"'))
    token = F.concat(F.lit("<tok"), att("id", "token_index"), att("form", "form"), att("lemma", "lemma"), att("pos", "upos"), F.lit("/>"))
    s = tokens.groupBy("document_id", "sentence_id").agg(F.sort_array(F.collect_list(F.struct("token_index", token.alias("l")))).alias("x"))
    one = F.concat(F.lit('<sent id="'), F.col("sentence_id").cast("string"), F.lit('">'), F.array_join(F.transform("x", lambda r: r["l"]), ""), F.lit("</sent>"))
    doc = s.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("sentence_id", one.alias("s")))).alias("x"))
    return doc.select("document_id", F.concat(F.lit('<doc id="'), F.col("document_id").cast("string"), F.lit('">'), F.array_join(F.transform("x", lambda r: r["s"]), ""), F.lit("</doc>")).alias("xml"))


def write(df: DataFrame, path: str, kind: str, by: str | None = None) -> None:
    """One table in a file format: csv, json lines (gzip), text of its last column, parquet."""
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(by)
    if kind == "csv":
        w.option("header", True).option("quoteAll", True).csv(path)
    elif kind == "jsonl":
        w.option("compression", "gzip").json(path)
    elif kind == "text":
        df.select(df.columns[-1]).write.mode("overwrite").text(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"no writer for {kind}")


#: Treebank exporters by format.
TREEBANK = {"conllu": conllu, "proiel": proiel, "json": nested, "paula": paula}


def convert(tokens: DataFrame, to: str) -> DataFrame:
    """A token table in another treebank format."""
    if to not in TREEBANK:
        raise ValueError(f"unknown format {to}")
    return TREEBANK[to](tokens)
