"""Frequency lists, n-grams, collocations, keyness, word sketches and distributional similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions import association as a

#: Relations of a word sketch by part of speech: name, relation of the pair, whether the word is the head (fixed values).
RELATIONS = {
    "VERB": (("subject", "nsubj", True), ("object", "obj", True), ("oblique", "obl", True), ("modifier", "advmod", True), ("conjunct", "conj", True)),
    "NOUN": (("modifier", "amod", True), ("subject_of", "nsubj", False), ("object_of", "obj", False), ("possessor", "nmod", True), ("oblique_of", "obl", False)),
    "ADJ": (("modifies", "amod", False), ("adverb", "advmod", True)),
}


def frequency_list(tokens: DataFrame, level: str = "lemma", upos: str | None = None, least: int = 1, top: int | None = None) -> DataFrame:
    """(item, freq, docs) of the non-null values of a level; ties in a top list go by the value."""
    t = tokens.where(F.col(level).isNotNull())
    if upos:
        t = t.where(F.col("upos") == upos)
    out = t.groupBy(F.col(level).alias("item")).agg(F.count("*").alias("freq"), F.count_distinct("document_id").alias("docs")).where(F.col("freq") >= least)
    return out.orderBy(F.desc("freq"), "item").limit(top) if top else out


def ngrams(tokens: DataFrame, n: int, level: str = "lemma", pattern: list[str] | None = None, least: int = 1) -> DataFrame:
    """(ngram, freq, docs) of n neighbours in a sentence, joined by blanks; `pattern` asks for parts of speech. Null values break an n-gram."""
    w = W.partitionBy("sentence_id").orderBy("token_index")
    parts = [F.col(level), *[F.lead(level, k).over(w) for k in range(1, n)]]
    tags = [F.col("upos"), *[F.lead("upos", k).over(w) for k in range(1, n)]]
    x = tokens.select("document_id", *[p.alias(f"p{k}") for k, p in enumerate(parts)], *[t.alias(f"t{k}") for k, t in enumerate(tags)])
    whole = F.lit(True)
    for k in range(n):
        whole = whole & F.col(f"p{k}").isNotNull()
        if pattern:
            whole = whole & (F.col(f"t{k}") == pattern[k])
    return x.where(whole).groupBy(F.concat_ws(" ", *[f"p{k}" for k in range(n)]).alias("ngram")).agg(F.count("*").alias("freq"), F.count_distinct("document_id").alias("docs")).where(F.col("freq") >= least)


def _ahead(tokens: DataFrame, size: int, level: str) -> DataFrame:
    """(node, x.other, x.gap) of every token and the tokens at most `size` behind it in its sentence.

    Made by `lead` inside the sentence instead of a join of the fact table with itself: rows grow by `size`, not by the square of a sentence.
    """
    w = W.partitionBy("sentence_id").orderBy("token_index")
    ahead = range(1, size + 1)
    shifted = tokens.select(F.col(level).alias("node"), "token_index", *[F.lead(level, k).over(w).alias(f"o{k}") for k in ahead], *[F.lead("token_index", k).over(w).alias(f"i{k}") for k in ahead])
    near = F.array(*[F.struct(F.col(f"o{k}").alias("other"), (F.col(f"i{k}") - F.col("token_index")).alias("gap")) for k in ahead])
    return shifted.where("node is not null").select("node", F.explode(near).alias("x")).where(f"x.other is not null and x.gap <= {size}")


def windows(tokens: DataFrame, size: int, level: str = "lemma") -> DataFrame:
    """(node, collocate, position) pairs at most `size` tokens apart in a sentence, in both directions."""
    both = F.array(F.struct(F.col("node").alias("node"), F.col("x.other").alias("collocate"), F.col("x.gap").alias("position")), F.struct(F.col("x.other").alias("node"), F.col("node").alias("collocate"), (-F.col("x.gap")).alias("position")))
    return _ahead(tokens, size, level).select(F.explode(both).alias("p")).select("p.*")


def pair_counts(tokens: DataFrame, size: int, level: str = "lemma", word: str | None = None, least: int = 1) -> DataFrame:
    """(node, collocate, o11): how often two different items stand at most `size` tokens apart. Each pair is counted once, without its order, and the
    totals are given in both orders; with `word` only its pairs, with it as the node."""
    x = _ahead(tokens, size, level).select("node", F.col("x.other").alias("other")).where("node <> other")
    if word is not None:
        x = x.where((F.col("node") == word) | (F.col("other") == word))
    n = x.groupBy(F.least("node", "other").alias("p"), F.greatest("node", "other").alias("q")).agg(F.count("*").alias("o11")).where(F.col("o11") >= least)
    both = n.select(F.explode(F.array(F.struct(F.col("p").alias("node"), F.col("q").alias("collocate")), F.struct(F.col("q").alias("node"), F.col("p").alias("collocate")))).alias("y"), "o11").select("y.*", "o11")
    return both if word is None else both.where(F.col("node") == word)


def collocations(tokens: DataFrame, word: str | None = None, size: int = 5, least: int = 2, level: str = "lemma") -> DataFrame:
    """(node, collocate, o11, f1, f2, n, logdice, mi, mi3, t, g2) for one word or all. Joint counts are over windows, marginal ones over the corpus."""
    freq = tokens.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("item")).agg(F.count("*").alias("f"))
    total = freq.agg(F.sum("f").alias("n"))
    joint = pair_counts(tokens, size, level, word, least)
    j = joint.join(freq.select(F.col("item").alias("node"), F.col("f").alias("f1")), "node").join(freq.select(F.col("item").alias("collocate"), F.col("f").alias("f2")), "collocate")
    j = j.crossJoin(F.broadcast(total))  # one row
    return j.select("node", "collocate", "o11", "f1", "f2", "n", *[f("o11", "f1", "f2", "n").alias(k) for k, f in a.MEASURES.items()])


def keywords(tokens: DataFrame, focus: Column, reference: Column, level: str = "lemma", least: int = 1) -> DataFrame:
    """(item, focus_freq, reference_freq, ll, chi2) of the words of a focus against a reference part of the corpus, in one pass over the tokens."""
    t = tokens.where(F.col(level).isNotNull()).select(F.col(level).alias("item"), focus.cast("int").alias("f"), reference.cast("int").alias("r")).where("f = 1 or r = 1")
    freq = t.groupBy("item").agg(F.sum("f").cast("long").alias("focus_freq"), F.sum("r").cast("long").alias("reference_freq"))
    total = freq.agg(F.sum("focus_freq").alias("n1"), F.sum("reference_freq").alias("n2"))
    j = freq.where(F.col("focus_freq") >= least).crossJoin(F.broadcast(total)).where("n1 > 0 and n2 > 0")
    return j.select("item", "focus_freq", "reference_freq", a.keyness("focus_freq", "n1", "reference_freq", "n2").alias("ll"), a.chi_square("focus_freq", "n1", "reference_freq", "n2").alias("chi2"))


def dependencies(tokens: DataFrame) -> DataFrame:
    """(sentence_id, document_id, relation, head lemma and tag, dependent lemma and tag) for every token with a head in its sentence."""
    h = tokens.select("sentence_id", F.col("token_index").alias("head"), F.col("lemma").alias("head_lemma"), F.col("upos").alias("head_upos"))
    d = tokens.select("sentence_id", "document_id", "head", "deprel", F.col("lemma").alias("dep_lemma"), F.col("upos").alias("dep_upos")).where("head > 0")
    return d.join(h, ["sentence_id", "head"])


def word_sketch(tokens: DataFrame, upos: str, least: int = 2, top: int = 10) -> DataFrame:
    """(lemma, relation, collocate, freq, logdice, rank) for all lemmas of a part of speech: per relation the 2 x top most frequent, of them the top by
    logDice. One join of tokens with their heads serves all relations."""
    dep = dependencies(tokens)
    rows = [
        F.when((F.col("deprel") == rel) & (F.col("head_upos" if head else "dep_upos") == upos), F.struct(F.lit(name).alias("relation"), F.col("head_lemma" if head else "dep_lemma").alias("lemma"), F.col("dep_lemma" if head else "head_lemma").alias("collocate")))
        for name, rel, head in RELATIONS[upos]
    ]
    pairs = dep.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*").where("lemma is not null and collocate is not null")
    freq = pairs.groupBy("lemma", "relation", "collocate").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
    totals = tokens.where("lemma is not null").groupBy("lemma").agg(F.count("*").alias("f"))
    by_freq = W.partitionBy("lemma", "relation").orderBy(F.desc("freq"), "collocate")
    some = freq.withColumn("_r", F.row_number().over(by_freq)).where(F.col("_r") <= 2 * top).drop("_r")
    j = some.join(totals.withColumnRenamed("f", "f1"), "lemma").join(totals.select(F.col("lemma").alias("collocate"), F.col("f").alias("f2")), "collocate")
    j = j.withColumn("logdice", F.round(a.log_dice("freq", "f1", "f2"), 6))
    best = W.partitionBy("lemma", "relation").orderBy(F.desc("logdice"), "collocate")
    return j.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lemma", "relation", "collocate", "freq", "logdice", "rank")


def sketch_difference(sketches: DataFrame, one: str, two: str) -> DataFrame:
    """(relation, collocate, status): shared, or only with one of two lemmas."""
    x = sketches.where(F.col("lemma") == one).select("relation", "collocate", F.lit(1).alias("a"))
    y = sketches.where(F.col("lemma") == two).select("relation", "collocate", F.lit(1).alias("b"))
    status = F.when(F.col("a").isNull(), "only_second").when(F.col("b").isNull(), "only_first").otherwise("shared")
    return x.join(y, ["relation", "collocate"], "full_outer").select("relation", "collocate", status.alias("status"))


def thesaurus(tokens: DataFrame, lemma: str, size: int = 3, least: int = 5) -> DataFrame:
    """(other, cosine) of a lemma with all lemmas of at least `least` context counts, over window contexts in long form. One pass over the counts
    gives the norms and, beside the lemma's own contexts (a left join: those of one lemma), the products; a lemma without a common context is left out."""
    counts = pair_counts(tokens, size).select("node", F.col("collocate").alias("ctx"), F.col("o11").cast("double").alias("c"))
    mine = pair_counts(tokens, size, word=lemma).select(F.col("collocate").alias("ctx"), F.col("o11").cast("double").alias("m"))
    j = counts.join(mine, "ctx", "left").groupBy("node").agg(
        F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("m")).alias("dot")
    )
    own = mine.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("own"))
    j = j.where((F.col("total") >= least) & F.col("dot").isNotNull() & (F.col("node") != lemma)).crossJoin(F.broadcast(own))  # one row
    return j.select(F.col("node").alias("other"), (F.col("dot") / (F.col("norm") * F.col("own"))).alias("cosine"))
