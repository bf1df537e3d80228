"""Rule-based annotation of raw texts: sentences, tokens, tags, trees, features - all as column expressions over arrays.

The rules are deliberately plain; a statistical back-end takes their place by giving a table of the same columns (`plug`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Closed classes and endings of the tagger (fixed values).
DET = ("the", "a", "an", "le", "la", "les", "un", "une", "der", "die", "das", "ein", "el", "los", "las")
ADP = ("of", "in", "on", "to", "for", "with", "de", "en", "von", "mit", "zu", "auf", "por", "para", "con")
TAIL = (("ADV", "(ly|ment|mente)$"), ("VERB", "(ed|ing|er|ir|ar|en)$"), ("ADJ", "(ous|ful|ble|ique|ig|oso)$"))
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(sentence_id, document_id, sentence_index, text): cut after runs of . ! ?; blanks collapsed, empty pieces dropped."""
    marked = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"([.!?]+)", "$1\u0001")
    pieces = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")
    x = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("document_id"), F.posexplode(pieces).alias("sentence_index", "text"))
    return x.select((F.col("document_id") * 100000 + F.col("sentence_index")).alias("sentence_id"), "document_id", F.col("sentence_index").cast("long").alias("sentence_index"), "text")


def tag(form):
    low = F.lower(form)
    out = F.when(~form.rlike(r"^[\p{L}\p{N}_]"), "PUNCT").when(form.rlike("^[0-9]+$"), "NUM").when(low.isin(*DET), "DET").when(low.isin(*ADP), "ADP")
    for name, tail in TAIL:
        out = out.when(form.rlike(f"(?i){tail}"), name)
    return out.otherwise("NOUN")


def tokens(sents: DataFrame) -> DataFrame:
    """(sentence_id, document_id, token_index, form, lemma, upos) of sentences: words and single signs."""
    x = sents.select("sentence_id", "document_id", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("p", "form"))
    return x.select("sentence_id", "document_id", (F.col("p") + 1).cast("long").alias("token_index"), "form", F.lower("form").alias("lemma"), tag(F.col("form")).alias("upos"))


def parse(toks: DataFrame) -> DataFrame:
    """The tokens with head, deprel and feats: the first verb is the root, else the first token; function words go to their right neighbour."""
    w = W.partitionBy("sentence_id")
    o = w.orderBy("token_index")
    x = toks.withColumn("_root", F.coalesce(F.min(F.when(F.col("upos") == "VERB", F.col("token_index"))).over(w), F.lit(1))).withColumn("_n", F.max("token_index").over(w)).withColumn("_before", F.lag("upos").over(o))
    i, up = F.col("token_index"), F.col("upos")
    head = F.when(i == F.col("_root"), 0).when(up.isin("DET", "ADJ", "ADP") & (i < F.col("_n")), i + 1).otherwise(F.col("_root"))
    rel = (
        F.when(i == F.col("_root"), "root").when(up == "DET", "det").when(up == "ADJ", "amod").when(up == "ADP", "case").when(up == "PUNCT", "punct").when(up == "ADV", "advmod").when(up == "NUM", "nummod").when(up == "VERB", "conj")
        .when(i < F.col("_root"), "nsubj").when(F.col("_before") == "ADP", "obl").otherwise("obj")
    )
    x = x.withColumn("head", head.cast("long")).withColumn("deprel", rel)
    case = F.when(F.col("deprel") == "nsubj", "Case=Nom").when(F.col("deprel") == "obj", "Case=Acc").when(F.col("deprel") == "obl", "Case=Dat")
    number = F.when(up == "NOUN", F.when(F.col("lemma").endswith("s"), "Number=Plur").otherwise("Number=Sing"))
    return x.withColumn("feats", F.nullif(F.concat_ws("|", case, number), F.lit(""))).drop("_root", "_n", "_before")


def annotate(docs: DataFrame, key: str, text: str) -> DataFrame:
    return parse(tokens(sentences(docs, key, text)))


def plug(sents: DataFrame, model: Callable[[list[str]], list[list[tuple[str, str, str]]]]) -> DataFrame:
    """Tokens of an outside model: it takes a batch of sentences and gives (form, lemma, tag) for each of their tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, d, i, *t) for s, d, ts in zip(b["sentence_id"], b["document_id"], model(b["text"].tolist())) for i, t in enumerate(ts, 1)]
            yield pd.DataFrame(rows, columns=["sentence_id", "document_id", "token_index", "form", "lemma", "upos"])

    return sents.select("sentence_id", "document_id", "text").mapInPandas(run, "sentence_id long, document_id long, token_index long, form string, lemma string, upos string")


def lexicon_lemmas(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The tokens with `lemma` from a lexicon of (form, lemma): the form itself, else the form without accents, else the form in lower case.

    A form with several lemmas in the lexicon takes the first by code point.
    """
    from lexforge.functions.text import without_accents

    exact = lexicon.groupBy(F.lower("form").alias("_f")).agg(F.min("lemma").alias("_l1"))
    plain = lexicon.groupBy(without_accents(F.lower("form")).alias("_p")).agg(F.min("lemma").alias("_l2"))
    forms = toks.where(F.col("form").isNotNull()).select(F.lower("form").alias("_f")).distinct()  # each form is looked up once
    found = forms.join(exact, "_f", "left").withColumn("_p", without_accents(F.col("_f"))).join(plain, "_p", "left").select("_f", F.coalesce("_l1", "_l2", "_f").alias("_lemma"))
    return toks.drop("lemma").withColumn("_f", F.lower("form")).join(found, "_f", "left").withColumnRenamed("_lemma", "lemma").drop("_f")
