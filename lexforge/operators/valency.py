"""Argument frames of verbs from dependency trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relations that make arguments, and their types (fixed values).
ARGUMENTS = {"nsubj": "SUBJ", "csubj": "SUBJ", "obj": "OBJ", "iobj": "IOBJ", "obl": "OBL", "ccomp": "COMP", "xcomp": "COMP", "sub": "SUBJ", "comp": "COMP"}
#: Cases in their canonical order (fixed values).
CASES = ("NOM", "ACC", "GEN", "DAT", "ABL", "LOC", "INS", "VOC")


def case_of(feats):
    """Three capitals of the Case feature, UNK without one."""
    found = F.upper(F.substring(F.regexp_extract(feats, r"(?:^|\|)Case=([^|]+)", 1), 1, 3))
    return F.when(found.isNull() | (found == ""), "UNK").otherwise(found)


def instances(tokens: DataFrame) -> DataFrame:
    """One row for each verb with an argument: sentence_id, document_id, verb_index, lemma, pattern, relations, cases, n_args, class.

    The pattern is NOM with the other arguments in order of their types, each the governing preposition and the case. Verbs and their dependents meet in
    one join on (sentence, head); a second finds prepositions under the arguments.
    """
    kinds = F.create_map(*[F.lit(x) for p in ARGUMENTS.items() for x in p])
    verbs = tokens.where(F.col("upos").isin("VERB", "AUX") & F.col("lemma").isNotNull()).select("sentence_id", F.col("token_index").alias("head"), "lemma")
    args = tokens.select("sentence_id", "document_id", "head", "token_index", F.try_element_at(kinds, F.col("deprel")).alias("kind"), "deprel", case_of(F.col("feats")).alias("case")).where("kind is not null and head > 0")
    adp = tokens.where((F.col("upos") == "ADP") | (F.col("deprel") == "case")).groupBy("sentence_id", F.col("head").alias("token_index")).agg(F.min_by(F.lower("lemma"), "token_index").alias("prep"))
    j = args.join(verbs, ["sentence_id", "head"]).join(adp, ["sentence_id", "token_index"], "left")
    part = F.when(F.col("prep").isNotNull(), F.concat_ws("+", "prep", "case")).otherwise(F.col("case"))
    grouped = j.groupBy("sentence_id", "document_id", F.col("head").alias("verb_index"), "lemma").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") != "SUBJ", F.struct("kind", "token_index", part.alias("part"))))).alias("a"),
        F.sort_array(F.collect_list(F.struct("token_index", "deprel"))).alias("r"),
        F.collect_set("case").alias("c"),
        F.count_if(F.col("kind") == "SUBJ").alias("subjects"), F.count_if(F.col("kind") == "OBJ").alias("objects"), F.count_if(F.col("kind") == "IOBJ").alias("indirect"), F.count("*").alias("n_args"),
    )
    pattern = F.concat_ws(" ", F.lit("NOM"), F.transform("a", lambda x: x["part"]))
    klass = F.when(F.col("indirect") > 0, "ditransitive").when(F.col("objects") > 0, "transitive").when(F.col("subjects") > 0, "intransitive").otherwise("impersonal")
    cases = F.concat_ws("-", F.filter(F.array(*[F.lit(c) for c in CASES]), lambda x: F.array_contains(F.col("c"), x)))
    return grouped.select("sentence_id", "document_id", "verb_index", "lemma", pattern.alias("pattern"), F.concat_ws(" ", F.transform("r", lambda x: x["deprel"])).alias("relations"), cases.alias("cases"), "n_args", klass.alias("class"))


def lexicon(found: DataFrame) -> DataFrame:
    """(lemma, pattern, freq, sentences): how often each verb has each pattern."""
    return found.groupBy("lemma", "pattern").agg(F.count("*").alias("freq"), F.count_distinct("sentence_id").alias("sentences"))


def primary(lexicon_: DataFrame) -> DataFrame:
    """(lemma, pattern, freq): the most frequent pattern of a verb, the first by code point among equals."""
    return lexicon_.groupBy("lemma").agg(F.min_by("pattern", F.struct(-F.col("freq"), "pattern")).alias("pattern"), F.max("freq").alias("freq"))


def pattern_changes(found: DataFrame, period: str, first: str, second: str) -> DataFrame:
    """(lemma, lost, gained, kept) between two periods, of verbs attested in both; the lists are sorted and joined by commas."""
    sets = found.where(F.col(period).isin(first, second)).groupBy("lemma").agg(
        F.collect_set(F.when(F.col(period) == first, F.col("pattern"))).alias("a"), F.collect_set(F.when(F.col(period) == second, F.col("pattern"))).alias("b")
    ).where("size(a) > 0 and size(b) > 0")
    text = lambda x: F.array_join(F.array_sort(x), ", ")
    return sets.select("lemma", text(F.array_except("a", "b")).alias("lost"), text(F.array_except("b", "a")).alias("gained"), text(F.array_intersect("a", "b")).alias("kept"))


#: Affixes of borrowed words by source language (fixed values).
BORROWED_PREFIXES = {"latin": ("ex", "de", "re", "pre", "pro")}
BORROWED_SUFFIXES = {"latin": ("tion", "ment", "ity", "ous"), "turkish": ("τζής", "λίκι", "τζίδικο"), "italian": ("άρω", "ίζω", "άδα"), "french": ("αρία", "ιέρα")}


def origin(lemma):
    """The language that a lemma's affixes point to: suffixes before prefixes, languages in the order of the table; native without any."""
    out = None
    for table, test in ((BORROWED_SUFFIXES, lambda c, x: c.endswith(x)), (BORROWED_PREFIXES, lambda c, x: c.startswith(x))):
        for language, affixes in table.items():
            hit = test(lemma, affixes[0])
            for x in affixes[1:]:
                hit = hit | test(lemma, x)
            out = F.when(hit, language) if out is None else out.when(hit, language)
    return out.otherwise("native")


def change_types(found: DataFrame, period: str, first: str, second: str) -> DataFrame:
    """(lemma, old_pattern, new_pattern, type): each lost pattern with each gained one of a verb: extension when arguments are added, reduction when
    they go, else alternation. A verb has few patterns, so the pairs are few."""
    sets = found.where(F.col(period).isin(first, second)).groupBy("lemma").agg(
        F.collect_set(F.when(F.col(period) == first, F.col("pattern"))).alias("a"), F.collect_set(F.when(F.col(period) == second, F.col("pattern"))).alias("b")
    )
    pairs = sets.select("lemma", F.explode(F.array_except("a", "b")).alias("old_pattern"), "a", "b").select("lemma", "old_pattern", F.explode(F.array_except("b", "a")).alias("new_pattern"))
    size = lambda c: F.size(F.split(c, " "))
    kind = F.when(size("new_pattern") > size("old_pattern"), "extension").when(size("new_pattern") < size("old_pattern"), "reduction").otherwise("alternation")
    return pairs.withColumn("type", kind)


def paradigm(stems: DataFrame, stem: str, endings: dict[str, str]) -> DataFrame:
    """(stem, cell, form): every stem with every ending of a table of endings, expanded in the row."""
    cells = F.array(*[F.struct(F.lit(k).alias("cell"), F.lit(v).alias("ending")) for k, v in endings.items()])
    x = stems.select(F.col(stem).alias("stem"), F.explode(cells).alias("e"))
    return x.select("stem", "e.cell", F.concat("stem", "e.ending").alias("form"))


#: Core arguments (fixed values).
CORE = ("nsubj", "obj", "iobj", "obl")


def variants(tokens: DataFrame) -> DataFrame:
    """One row for each verb with a lemma: sentence_id, verb_index, lemma and its frame in every notation in use: `core` (core relations, sorted), `counts`
    (SUBJ(n)+OBJ(n)+OBL(n) of all dependents; null without any), `plus` (NOM and the sorted cases of core arguments; null without any), `implied` (the set of NOM,
    ACC for obj, DAT for iobj, the case of obl), `ordered` (the set of cases in their canonical order), `notation` (NOM, ACC, the case of iobj in the order of words;
    INTR without any) and `size_class` by the number of core arguments.

    Verbs meet their dependents in one join on (sentence, head), which the shuffle by sentence already serves.
    """
    verbs = tokens.where((F.col("upos") == "VERB") & F.col("lemma").isNotNull()).select("sentence_id", F.col("token_index").alias("verb_index"), "lemma")
    case = case_of(F.col("feats"))
    deps = tokens.where("head > 0").select("sentence_id", F.col("head").alias("verb_index"), F.struct("token_index", "deprel", case.alias("case")).alias("d"))
    x = verbs.join(deps, ["sentence_id", "verb_index"], "left").groupBy("sentence_id", "verb_index", "lemma").agg(F.array_sort(F.collect_list("d")).alias("d"))
    core = F.filter("d", lambda y: y["deprel"].isin(*CORE))
    x = x.withColumn("c", core)
    count = lambda rel: F.size(F.filter("d", lambda y: F.coalesce(y["deprel"] == rel, F.lit(False))))
    subjects, objects = count("nsubj"), count("obj")
    other = F.size("d") - subjects - objects
    part = lambda name, n: F.when(n > 0, F.concat(F.lit(f"{name}("), n.cast("string"), F.lit(")")))
    counts = F.when(F.size("d") > 0, F.concat_ws("+", part("SUBJ", subjects), part("OBJ", objects), part("OBL", other)))
    cases = F.transform("c", lambda y: y["case"])
    plus = F.when(F.size("c") > 0, F.concat_ws("+", F.lit("NOM"), F.array_sort(cases)))
    taken = F.transform("c", lambda y: F.when(y["deprel"] == "obj", "ACC").when(y["deprel"] == "iobj", "DAT").when((y["deprel"] == "obl") & (y["case"] != "UNK"), y["case"]))
    implied = F.array_join(F.array_sort(F.array_distinct(F.concat(F.array(F.lit("NOM")), F.array_compact(taken)))), "+")
    every = F.array_distinct(F.concat(F.array(F.lit("NOM")), F.filter(cases, lambda c: c != "UNK")))
    ordered = F.array_join(F.concat(F.filter(F.array(*[F.lit(c) for c in CASES]), lambda c: F.array_contains(every, c)), F.array_sort(F.filter(every, lambda c: ~c.isin(*CASES)))), "+")
    signs = F.transform("c", lambda y: F.when(y["deprel"] == "nsubj", "NOM").when(y["deprel"] == "obj", "ACC").when(y["deprel"] == "iobj", F.when(y["case"] == "UNK", "OBL").otherwise(y["case"])))
    notation = F.coalesce(F.nullif(F.array_join(F.array_compact(signs), "+"), F.lit("")), F.lit("INTR"))
    n = F.size("c")
    size_class = F.when(n == 0, "intransitive").when(n == 1, "transitive").when(n == 2, "ditransitive").otherwise("complex")
    return x.select(
        "sentence_id", "verb_index", "lemma", F.array_join(F.array_sort(F.transform("c", lambda y: y["deprel"])), " ").alias("core"), counts.alias("counts"), plus.alias("plus"), implied.alias("implied"), ordered.alias("ordered"),
        notation.alias("notation"), size_class.alias("size_class"),
    )


def contact(found: DataFrame, language: str, etymology: str, klass: str) -> DataFrame:
    """(language, class, native, borrowed, difference): shares of the classes among borrowed less those among native verbs, in languages that have both."""
    n = found.groupBy(F.col(language).alias("language"), F.col(klass).alias("class")).agg(F.count_if(F.col(etymology) == "native").alias("native"), F.count_if(F.col(etymology) == "borrowed").alias("borrowed"))
    total = n.groupBy("language").agg(F.sum("native").alias("_n"), F.sum("borrowed").alias("_b")).where("_n > 0 and _b > 0")
    return n.join(total, "language").select("language", "class", "native", "borrowed", (F.col("borrowed") / F.col("_b") - F.col("native") / F.col("_n")).alias("difference"))


def features(tokens: DataFrame) -> DataFrame:
    """(lemma, 13 features) of every verb: which arguments it has and their most frequent case's place in the table, passive forms, borrowing, and the
    logarithm of its frequency. Causative, applicative and antipassive forms have no mark in the annotation and are 0."""
    verbs = tokens.where((F.col("upos") == "VERB") & F.col("lemma").isNotNull()).select("sentence_id", F.col("token_index").alias("head"), "lemma", F.col("feats").contains("Voice=Pass").alias("passive"))
    alone = verbs.groupBy("lemma").agg(F.count("*").alias("f"), F.max(F.coalesce(F.col("passive").cast("int"), F.lit(0))).alias("is_passive"))
    args = tokens.where(F.col("deprel").isin("nsubj", "obj", "iobj")).select("sentence_id", "head", "deprel", case_of(F.col("feats")).alias("case"))
    n = args.join(verbs, ["sentence_id", "head"]).groupBy("lemma", "deprel", "case").agg(F.count("*").alias("n"))
    best = n.groupBy("lemma").pivot("deprel", ["nsubj", "obj", "iobj"]).agg(F.min_by("case", F.struct(-F.col("n"), F.col("case"))))
    at = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(k) for k in CASES]), F.col(c)), F.lit(0)).cast("double")
    has = lambda c: F.col(c).isNotNull().cast("double")
    borrowed = (origin(F.col("lemma")) != "native").cast("double")
    zero = F.lit(0.0)
    x = alone.join(best, "lemma", "left")
    return x.select(
        "lemma", has("nsubj").alias("has_subject"), at("nsubj").alias("subject_case"), has("obj").alias("has_object"), at("obj").alias("object_case"), has("iobj").alias("has_indirect"), at("iobj").alias("indirect_case"),
        F.col("is_passive").cast("double").alias("is_passive"), zero.alias("is_causative"), zero.alias("is_applicative"), zero.alias("is_antipassive"), borrowed.alias("is_borrowing"), borrowed.alias("contact_confidence"), F.log1p("f").alias("log_freq"),
    )
