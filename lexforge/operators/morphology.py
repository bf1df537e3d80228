"""Analyses of word forms: by an index of known forms, then by their longest ending; grades of roots, cognates, correspondences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings with their part of speech and features (fixed values).
ENDINGS = {
    "ουσιν": ("VERB", "Number=Plur|Person=3"), "ομεν": ("VERB", "Number=Plur|Person=1"), "εται": ("VERB", "Number=Sing|Person=3|Voice=Mid"), "ουσι": ("VERB", "Number=Plur|Person=3"), "ειν": ("VERB", "VerbForm=Inf"), "σεν": ("VERB", "Number=Sing|Person=3|Tense=Past"),
    "ους": ("NOUN", "Case=Acc|Number=Plur"), "οις": ("NOUN", "Case=Dat|Number=Plur"), "ων": ("NOUN", "Case=Gen|Number=Plur"), "ος": ("NOUN", "Case=Nom|Number=Sing"), "ον": ("NOUN", "Case=Acc|Number=Sing"), "ου": ("NOUN", "Case=Gen|Number=Sing"), "αι": ("NOUN", "Case=Nom|Number=Plur"), "οι": ("NOUN", "Case=Nom|Number=Plur"), "ει": ("VERB", "Number=Sing|Person=3"),
    "orum": ("NOUN", "Case=Gen|Number=Plur"), "arum": ("NOUN", "Case=Gen|Number=Plur"), "ibus": ("NOUN", "Case=Dat|Number=Plur"), "us": ("NOUN", "Case=Nom|Number=Sing"), "um": ("NOUN", "Case=Acc|Number=Sing"), "am": ("NOUN", "Case=Acc|Number=Sing"), "ae": ("NOUN", "Case=Gen|Number=Sing"), "nt": ("VERB", "Number=Plur|Person=3"), "it": ("VERB", "Number=Sing|Person=3"), "at": ("VERB", "Number=Sing|Person=3"), "re": ("VERB", "VerbForm=Inf"),
}
VOWELS = "eēoō"


def by_ending(form: Column, endings: dict[str, tuple[str, str]] | None = None) -> Column:
    """(pos, feats, stem) by the longest ending that leaves two letters; a form without any is an X."""
    table = sorted((endings or ENDINGS).items(), key=lambda x: (-len(x[0]), x[0]))
    pick = lambda value: reduce(lambda rest, x: F.when(form.endswith(x[0]) & (F.length(form) >= len(x[0]) + 2), value(x)).otherwise(rest), reversed(table), value(None))
    return F.struct(
        pick(lambda x: F.lit(x[1][0] if x else "X")).alias("pos"), pick(lambda x: F.lit(x[1][1]) if x else F.lit(None).cast("string")).alias("feats"),
        pick(lambda x: F.expr(f"substring(form, 1, length(form) - {len(x[0])})") if x else F.col("form")).alias("stem"),
    )


def analyse(forms: DataFrame, index: DataFrame, endings: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(form, source, lemma, pos, feats) of distinct forms: from an index of (form, lemma, pos), the first by order of several, else by the longest ending
    with the stem in place of a lemma. Null forms give no row."""
    known = index.where("form is not null").groupBy("form").agg(F.min(F.struct("lemma", "pos")).alias("k"))
    x = forms.where("form is not null").select("form").distinct().join(known, "form", "left").withColumn("e", by_ending(F.col("form"), endings))
    hit = F.col("k").isNotNull()
    return x.select(
        "form", F.when(hit, "index").when(F.col("e.pos") != "X", "ending").otherwise("none").alias("source"), F.when(hit, F.col("k.lemma")).otherwise(F.col("e.stem")).alias("lemma"),
        F.when(hit, F.col("k.pos")).otherwise(F.col("e.pos")).alias("pos"), F.when(~hit, F.col("e.feats")).alias("feats"),
    )


def grades(roots: DataFrame, root: str) -> DataFrame:
    """(root, grade, form): the root with its first vowel in every grade; roots without one give no row."""
    at = F.regexp_instr(F.col(root), F.lit(f"[{VOWELS}]"))
    before, behind = F.substring(F.col(root), F.lit(1), at - 1), F.substring(F.col(root), at + 1, F.length(root))
    names = {"e-grade": "e", "o-grade": "o", "zero-grade": "", "lengthened-e": "ē", "lengthened-o": "ō"}
    x = roots.where(F.col(root).rlike(f"[{VOWELS}]")).select(F.col(root).alias("root"), F.explode(F.array(*[F.struct(F.lit(k).alias("grade"), F.concat(before, F.lit(v), behind).alias("form")) for k, v in names.items()])).alias("g"))
    return x.select("root", "g.grade", "g.form")


def etymology(lemmas: DataFrame, cognates: DataFrame, loans: DataFrame) -> DataFrame:
    """(lemma, root, meaning, cognates, loan_source): by tables (root, meaning, language, form) and (form, source); the first root by order of several."""
    all_ = cognates.groupBy("root").agg(F.array_sort(F.collect_set(F.concat_ws(":", "language", "form"))).alias("cognates"))
    own = cognates.groupBy(F.col("form").alias("lemma")).agg(F.min(F.struct("root", "meaning")).alias("r")).select("lemma", "r.root", "r.meaning")
    loan = loans.groupBy(F.col("form").alias("lemma")).agg(F.min("source").alias("loan_source"))
    return lemmas.select("lemma").distinct().join(own, "lemma", "left").join(all_, "root", "left").join(loan, "lemma", "left").select("lemma", "root", "meaning", "cognates", "loan_source")


def reconstruct(forms: DataFrame, correspondences: dict[str, dict[str, str]]) -> DataFrame:
    """(set_id, form, confidence): every language's letters are put back by its table, the most frequent letter of each place (the first by order among
    equals) makes the form of the longest length that most agree on; confidence is a quarter for each language, 1 at most. `forms` has set_id, language, form."""
    table = F.create_map(*[y for lang, m in correspondences.items() for x, p in m.items() for y in (F.lit(f"{lang}:{x}"), F.lit(p))])
    x = forms.where(F.col("language").isin(*correspondences)).select("set_id", "language", F.length("form").alias("n"), F.posexplode(F.split("form", "")).alias("place", "letter")).where("letter <> ''")
    x = x.withColumn("old", F.coalesce(F.try_element_at(table, F.concat_ws(":", "language", "letter")), F.col("letter")))
    size = x.select("set_id", "language", "n").distinct().groupBy("set_id", "n").agg(F.count("*").alias("c")).groupBy("set_id").agg(F.max_by("n", F.struct("c", "n")).alias("size"))
    votes = x.groupBy("set_id", "place", "old").agg(F.count("*").alias("c")).groupBy("set_id", "place").agg(F.min_by("old", F.struct(-F.col("c"), F.col("old"))).alias("old"))
    form = votes.join(size, "set_id").where("place < size").groupBy("set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "old"))), lambda y: y["old"]), "").alias("form"))
    sure = x.groupBy("set_id").agg(F.least(F.count_distinct("language") / 4, F.lit(1.0)).alias("confidence"))
    return form.join(sure, "set_id").select("set_id", F.concat(F.lit("*"), "form").alias("form"), "confidence")
