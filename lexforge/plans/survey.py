"""Queries of normal forms, splitters, quality, further valency notations, entities, form analysis, keeping of tables, and round trips of formats."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions import normalise as nm
from lexforge.operators import classify, entities, morphology, upkeep, valency
from lexforge.plans import base, corpus
from lexforge.plans.base import DOC, SEN, TOK
from lexforge.plans.catalog import query
from lexforge.plans.derived import _ORIGIN
from lexforge.runtime import checkpoint_dir, cut, drop_folder, table
from lexforge.sources import exporters, readers

R = lambda c, n=6: F.round(c, n)
_BL = r"[ \t\r\n\f]"


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def _nest(x: str, signs) -> str:
    for a, b in signs:
        x = "replace({}, '{}', '{}')".format(x, a, b.replace("'", "''"))
    return x


# ------------------------------------------------------------ texts

_SIGMA = r"regexp_replace(regexp_replace(replace(nfc_normalize(text), 'ϲ', 'σ'), 'σ([^\p{L}]|$)', 'ς\1', 'g'), 'ς(\p{L})', 'σ\1', 'g')"
_MARKS = rf"trim(regexp_replace(regexp_replace(regexp_replace({_SIGMA}, '[\[\]⟨⟩<>{{}}]', '', 'g'), '[†‡*]', '', 'g'), '\s+', ' ', 'g'), ' ')"
_NUMBERS = rf"regexp_replace(regexp_replace({_MARKS}, '(?m)^{_BL}*[\[(]?[0-9]+[\])]?{_BL}*', '', 'g'), '{_BL}+[0-9]+{_BL}+', ' ', 'g')"


@query("normalised_texts", rf"SELECT doc_id, md5(trim(regexp_replace({_NUMBERS}, '\s+', ' ', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def normalised_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(nm.full(F.col("text"))).alias("digest"))


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query("language_normalised", f"""WITH n AS (SELECT doc_id, lang, {_PLAIN} AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(trim(CASE WHEN lang IN ('grc', 'el') THEN {_nest('x', nm.GREEK_SIGNS)} WHEN lang = 'la' THEN {_nest('x', nm.MACRONS)} WHEN lang = 'en' THEN {_nest('x', nm.ENGLISH_SIGNS)} ELSE x END, ' ')) AS digest FROM n""")
def language_normalised(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(nm.by_language(F.col("text"), F.col("lang"))).alias("digest"))


@query("text_damage", r"""SELECT id, contains(content, '?') OR contains(content, chr(65533)) AS encoding, regexp_matches(content, '[\x{0370}-\x{03FF}]') AND regexp_matches(content, '[A-Za-z]') AS mixed_scripts, length(regexp_replace(content, '[^\x{2001}-\x{2FFF}]', '', 'g')) AS unusual FROM corpus_items WHERE content IS NOT NULL""")
def text_damage(spark, d):
    return table(spark, d, "corpus_items").where("content is not null").select("id", nm.damage(F.col("content")).alias("x")).select("id", "x.*")


@query("text_quality", rf"""WITH x AS (SELECT doc_id, text, length(text) AS n, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' '), lambda w: w <> '')) AS words, len(list_distinct(regexp_extract_all(lower(text), '(?s).'))) AS chars,
 length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n < {nm.SHORTEST} THEN 0.0 ELSE round((CASE WHEN n > {nm.LONGEST} THEN 0.8 ELSE 1.0 END * CASE WHEN words < {nm.FEWEST_WORDS} THEN 0.5 ELSE 1.0 END * CASE WHEN chars / n < 0.1 THEN 0.3 WHEN chars / n < 0.3 THEN 0.7 ELSE 1.0 END * CASE WHEN contains(text, '<') AND contains(text, '>') THEN 0.6 ELSE 1.0 END
 * CASE WHEN digits / n > 0.1 THEN 0.7 ELSE 1.0 END)::DOUBLE, 6) END::DOUBLE AS quality, NOT (contains(lower(left(text, 2000)), '<html') AND NOT contains(lower(left(text, 2000)), 'project gutenberg')) AND (contains(lower(left(text, 2000)), '*** start of') OR length(trim(left(text, 2000), ' ')) > 1000) AS looks_like_text FROM x""")
def text_quality(spark, d):
    return _docs(spark, d).select("doc_id", R(nm.quality(F.col("text"))).alias("quality"), nm.looks_like_text(F.col("text")).alias("looks_like_text"))


def _cut(pattern: str, new: str, x: str = "text") -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '{pattern}', {new}, 'g'), chr(1)), lambda s: regexp_replace(s, '^{_BL}+|{_BL}+$', '', 'g')), lambda s: s <> '')"


_BEHIND, _GREEK = _cut(rf"([.!?··;]){_BL}+", r"'\1' || chr(1)"), _cut(rf"([.;:!?·]){_BL}+", r"'\1' || chr(1)")
_CAPITAL = _cut(rf"([.!?]){_BL}+([A-Z])", r"'\1' || chr(1) || '\2'")


@query("sentence_splits", f"""WITH x AS (SELECT doc_id, {_BEHIND} AS a, CASE WHEN lang IN ('grc', 'la') THEN {_GREEK} ELSE {_CAPITAL} END AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(a)::BIGINT AS behind, coalesce(list_max(list_transform(a, lambda s: length(s))), 0)::BIGINT AS longest_behind, len(b)::BIGINT AS by_language, md5(array_to_string(b, chr(1))) AS digest FROM x""")
def sentence_splits(spark, d):
    x = _docs(spark, d).select("doc_id", nm.split_behind(F.col("text")).alias("a"), nm.split_by_language(F.col("text"), F.col("lang")).alias("b"))
    longest = F.coalesce(F.array_max(F.transform("a", lambda s: F.length(s))), F.lit(0))
    return x.select("doc_id", F.size("a").cast("long").alias("behind"), longest.cast("long").alias("longest_behind"), F.size("b").cast("long").alias("by_language"), F.md5(F.array_join("b", nm.MARK)).alias("digest"))


# ------------------------------------------------------------ valency

_CS = "coalesce(nullif(upper(substring(regexp_extract(a.feats, '(?:^|\\|)Case=([^|]+)', 1), 1, 3)), ''), 'UNK')"
_IN = ", ".join(f"'{c}'" for c in valency.CORE)
_LIST = "[" + ", ".join(f"'{c}'" for c in valency.CASES) + "]"


@query("valency_variants", f"""WITH {TOK}, v AS (SELECT sentence_id, token_index, lemma FROM tok WHERE upos = 'VERB' AND lemma IS NOT NULL), a AS (SELECT a.sentence_id, a.head, a.token_index, a.deprel, {_CS} AS c FROM tok a WHERE a.head > 0),
 f AS (SELECT v.sentence_id, v.token_index, count(a.token_index) AS deps, count(CASE WHEN a.deprel = 'nsubj' THEN 1 END) AS s, count(CASE WHEN a.deprel = 'obj' THEN 1 END) AS o, count(CASE WHEN a.deprel IN ({_IN}) THEN 1 END) AS n,
  coalesce(string_agg(CASE WHEN a.deprel IN ({_IN}) THEN a.deprel END, ' ' ORDER BY a.deprel), '') AS core, string_agg(CASE WHEN a.deprel IN ({_IN}) THEN a.c END, '+' ORDER BY a.c) AS cases,
  list(CASE WHEN a.deprel = 'obj' THEN 'ACC' WHEN a.deprel = 'iobj' THEN 'DAT' WHEN a.deprel = 'obl' AND a.c <> 'UNK' THEN a.c END) AS taken, list(CASE WHEN a.deprel IN ({_IN}) AND a.c <> 'UNK' THEN a.c END) AS every,
  coalesce(string_agg(CASE WHEN a.deprel = 'nsubj' THEN 'NOM' WHEN a.deprel = 'obj' THEN 'ACC' WHEN a.deprel = 'iobj' THEN CASE WHEN a.c = 'UNK' THEN 'OBL' ELSE a.c END END, '+' ORDER BY a.token_index, a.deprel, a.c), 'INTR') AS notation
  FROM v LEFT JOIN a ON a.sentence_id = v.sentence_id AND a.head = v.token_index GROUP BY v.sentence_id, v.token_index, v.lemma),
 g AS (SELECT core, CASE WHEN deps > 0 THEN concat_ws('+', CASE WHEN s > 0 THEN 'SUBJ(' || s || ')' END, CASE WHEN o > 0 THEN 'OBJ(' || o || ')' END, CASE WHEN deps - s - o > 0 THEN 'OBL(' || (deps - s - o) || ')' END) END AS counts, CASE WHEN n > 0 THEN 'NOM+' || cases END AS plus,
  array_to_string(list_sort(list_distinct(list_concat(['NOM'], list_filter(taken, lambda x: x IS NOT NULL)))), '+') AS implied,
  array_to_string(list_concat(list_filter({_LIST}, lambda x: x = 'NOM' OR list_contains(every, x)), list_sort(list_filter(list_distinct(list_filter(every, lambda x: x IS NOT NULL)), lambda x: NOT list_contains({_LIST}, x)))), '+') AS ordered, notation,
  CASE n WHEN 0 THEN 'intransitive' WHEN 1 THEN 'transitive' WHEN 2 THEN 'ditransitive' ELSE 'complex' END AS size_class FROM f)
SELECT core, counts, plus, implied, ordered, notation, size_class, count(*) AS n FROM g GROUP BY ALL""")
def valency_variants(spark, d):
    x = valency.variants(base.tokens(spark, d))
    return x.groupBy("core", "counts", "plus", "implied", "ordered", "notation", "size_class").agg(F.count("*").alias("n"))


@query("contact_preferences", f"""WITH {corpus._FRAMES}, {DOC}, n AS (SELECT d.language, f.class, count(CASE WHEN {_ORIGIN} = 'native' THEN 1 END) AS native, count(CASE WHEN {_ORIGIN} <> 'native' THEN 1 END) AS borrowed FROM frame f JOIN doc d USING (document_id) GROUP BY 1, 2),
 t AS (SELECT language, sum(native) AS tn, sum(borrowed) AS tb FROM n GROUP BY 1) SELECT language, class, native, borrowed, round(borrowed / tb - native / tn, 6) AS difference FROM n JOIN t USING (language) WHERE tn > 0 AND tb > 0""")
def contact_preferences(spark, d):
    f = valency.instances(base.tokens(spark, d)).join(base.documents(spark, d).select("document_id", "language"), "document_id")
    f = f.withColumn("etymology", F.when(valency.origin(F.col("lemma")) == "native", "native").otherwise("borrowed"))
    return valency.contact(f, "language", "etymology", "class").withColumn("difference", R(F.col("difference")))


_PLACE = lambda c: f"coalesce(list_position({_LIST}, {c}), 0)::DOUBLE"


@query("valency_features", f"""WITH {TOK}, v AS (SELECT sentence_id, token_index, lemma, contains(coalesce(feats, ''), 'Voice=Pass') AS p FROM tok WHERE upos = 'VERB' AND lemma IS NOT NULL), f AS (SELECT lemma, count(*) AS n, max(p::INT) AS p FROM v GROUP BY 1),
 a AS (SELECT v.lemma, a.deprel, {_CS} AS c, count(*) AS n FROM tok a JOIN v ON v.sentence_id = a.sentence_id AND v.token_index = a.head WHERE a.deprel IN ('nsubj', 'obj', 'iobj') GROUP BY 1, 2, 3),
 b AS (SELECT lemma, deprel, c FROM (SELECT *, row_number() OVER (PARTITION BY lemma, deprel ORDER BY n DESC, c) AS k FROM a) WHERE k = 1),
 w AS (SELECT lemma, max(CASE WHEN deprel = 'nsubj' THEN c END) AS s, max(CASE WHEN deprel = 'obj' THEN c END) AS o, max(CASE WHEN deprel = 'iobj' THEN c END) AS i FROM b GROUP BY 1)
SELECT lemma, (s IS NOT NULL)::DOUBLE AS has_subject, {_PLACE('s')} AS subject_case, (o IS NOT NULL)::DOUBLE AS has_object, {_PLACE('o')} AS object_case, (i IS NOT NULL)::DOUBLE AS has_indirect, {_PLACE('i')} AS indirect_case, p::DOUBLE AS is_passive, 0.0::DOUBLE AS is_causative, 0.0::DOUBLE AS is_applicative,
 0.0::DOUBLE AS is_antipassive, ({_ORIGIN} <> 'native')::DOUBLE AS is_borrowing, ({_ORIGIN} <> 'native')::DOUBLE AS contact_confidence, round(ln(1 + f.n), 6) AS log_freq FROM f LEFT JOIN w USING (lemma)""")
def valency_features(spark, d):
    return valency.features(base.tokens(spark, d)).withColumn("log_freq", R(F.col("log_freq")))


# ------------------------------------------------------------ entities, forms, roots

_MODELS = """m AS (SELECT sentence_id, token_index AS s, token_index + 1 AS e, 'PER' AS label, 0.9 AS c FROM tok WHERE upos = 'PROPN' UNION ALL SELECT sentence_id, token_index, token_index + 1, 'PER', 0.7 FROM tok WHERE token_index > 1 AND regexp_matches(form, '^[A-Z][a-z]')
 UNION ALL SELECT sentence_id, token_index, token_index + 1, 'PER', 0.4 FROM tok WHERE deprel = 'nsubj')"""


@query("entity_merge", f'WITH {TOK}, {_MODELS} SELECT sentence_id, s AS "start", e AS "end", label, count(*) AS models, round(avg(c), 6)::DOUBLE AS confidence FROM m GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND avg(c) > 0.6')
def entity_merge(spark, d):
    """Spans that two of three taggers agree on: by part of speech, by capitals inside a sentence, by subjects."""
    t = base.tokens(spark, d)
    votes = F.array_compact(F.array(F.when(F.col("upos") == "PROPN", 0.9), F.when((F.col("token_index") > 1) & F.col("form").rlike("^[A-Z][a-z]"), 0.7), F.when(F.col("deprel") == "nsubj", 0.4)))
    found = t.select("sentence_id", F.col("token_index").alias("start"), (F.col("token_index") + 1).alias("end"), F.lit("PER").alias("label"), F.explode(votes).alias("confidence"))
    return entities.merge(found).withColumn("confidence", R(F.col("confidence")))


@query("entities_found", f"""WITH {TOK}, g AS (SELECT form FROM tok WHERE upos = 'PROPN' AND form IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), x AS (SELECT CASE WHEN g.form IS NOT NULL THEN 'PER' WHEN regexp_matches(t.form, '^[0-9]+$') THEN 'NUM' WHEN regexp_matches(t.form, '^[A-Z][.]$') THEN 'INITIAL' WHEN t.upos = 'PROPN' THEN 'PER' END AS type,
 CASE WHEN g.form IS NOT NULL THEN 'gazetteer' WHEN regexp_matches(t.form, '^([0-9]+|[A-Z][.])$') THEN 'pattern' ELSE 'tag' END AS source FROM tok t LEFT JOIN g ON g.form = t.form WHERE t.form IS NOT NULL) SELECT type, source, count(*) AS n FROM x WHERE type IS NOT NULL GROUP BY 1, 2""")
def entities_found(spark, d):
    t = base.tokens(spark, d)
    names = t.where("upos = 'PROPN' and form is not null").groupBy("form").agg(F.count("*").alias("n")).where("n >= 3").select("form", F.lit("PER").alias("type"))
    return entities.recognise(t, names, {"NUM": "^[0-9]+$", "INITIAL": "^[A-Z][.]$"}).groupBy("type", "source").agg(F.count("*").alias("n"))


@query("model_benchmark", """WITH r AS (SELECT event_type AS model, value AS s, event_id % 10 <> 0 AS ok, (event_id % 100) / 100.0 AS c FROM events WHERE value IS NOT NULL) SELECT model, count(*) AS samples, round(avg(s), 6) AS average_time, round(avg(ok::INT), 6) AS success_rate, round(avg(CASE WHEN ok THEN c END), 6)::DOUBLE AS average_confidence,
 round(avg(ok::INT) * 0.7 + 0.3 / (1 + avg(s)), 6) AS score FROM r GROUP BY 1""")
def model_benchmark(spark, d):
    """Event types as models: their values as seconds, every tenth event failed."""
    e = table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("model"), F.col("value").alias("seconds"), (F.col("event_id") % 10 != 0).alias("ok"), ((F.col("event_id") % 100) / 100).alias("confidence"))
    x = entities.benchmark(e)
    return x.select("model", "samples", *[R(F.col(c)).alias(c) for c in ("average_time", "success_rate", "average_confidence", "score")])


def _ending_sql(value: str) -> str:
    table_ = sorted(morphology.ENDINGS.items(), key=lambda x: (-len(x[0]), x[0]))
    pick = {"pos": lambda e, v: f"'{v[0]}'", "feats": lambda e, v: f"'{v[1]}'", "stem": lambda e, v: f"substring(f.form, 1, length(f.form) - {len(e)})"}[value]
    last = {"pos": "'X'", "feats": "NULL", "stem": "f.form"}[value]
    return "CASE " + " ".join(f"WHEN f.form LIKE '%{e}' AND length(f.form) >= {len(e) + 2} THEN {pick(e, v)}" for e, v in table_) + f" ELSE {last} END"


@query("form_analysis", f"""WITH {TOK}, i AS (SELECT form, min(struct_pack(lemma := lemma, pos := upos)) AS k FROM tok WHERE form IS NOT NULL AND lemma IS NOT NULL AND upos IS NOT NULL AND document_id IN (SELECT id FROM corpus_items WHERE status = 'annotated') GROUP BY 1), f AS (SELECT DISTINCT form FROM tok WHERE form IS NOT NULL)
SELECT f.form, CASE WHEN i.form IS NOT NULL THEN 'index' WHEN {_ending_sql('pos')} <> 'X' THEN 'ending' ELSE 'none' END AS source, CASE WHEN i.form IS NOT NULL THEN k.lemma ELSE {_ending_sql('stem')} END AS lemma, CASE WHEN i.form IS NOT NULL THEN k.pos ELSE {_ending_sql('pos')} END AS pos,
 CASE WHEN i.form IS NULL THEN {_ending_sql('feats')} END AS feats FROM f LEFT JOIN i ON i.form = f.form""")
def form_analysis(spark, d):
    """All forms of the corpus against an index of the annotated documents' forms: what isn't indexed is analysed by endings."""
    t = base.tokens(spark, d)
    done = table(spark, d, "corpus_items").where("status = 'annotated'").select(F.col("id").alias("document_id"))
    index = t.where("lemma is not null and upos is not null").join(done, "document_id", "left_semi").select("form", "lemma", F.col("upos").alias("pos"))
    return morphology.analyse(t, index)


@query("ablaut_grades", f"""WITH {TOK}, r AS (SELECT DISTINCT lemma AS root, regexp_extract(lemma, '^[^eēoō]*') AS b FROM tok WHERE regexp_matches(lemma, '[eēoō]')), g(grade, v) AS (VALUES ('e-grade', 'e'), ('o-grade', 'o'), ('zero-grade', ''), ('lengthened-e', 'ē'), ('lengthened-o', 'ō'))
SELECT root, grade, b || v || substring(root, length(b) + 2) AS form FROM r, g""")
def ablaut_grades(spark, d):
    return morphology.grades(base.tokens(spark, d).where("lemma is not null").select("lemma").distinct(), "lemma")


#: English words and their Greek cognates (fixed values).
COGNATES = {"mother": "μήτηρ", "father": "πατήρ", "new": "νέος", "star": "ἀστήρ", "night": "νύξ", "foot": "πούς", "name": "ὄνομα", "knee": "γόνυ", "garden": "χόρτος", "winter": "χιών", "stone": "στία", "brother": "φράτηρ", "daughter": "θυγάτηρ", "door": "θύρα"}
_COG = ", ".join(f"'{a}'" for a in COGNATES)


@query("translation_ratio", rf"""WITH w AS (SELECT doc_id, genre, lang, text, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' '), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL AND genre IS NOT NULL), g AS (SELECT genre, arg_min(doc_id, doc_id) AS gid, arg_min(n, doc_id) AS gn FROM w WHERE lang = 'grc' GROUP BY 1),
 e AS (SELECT w.doc_id, w.genre, w.n, len(list_filter(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), ' '), lambda x: regexp_replace(x, '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g')), lambda x: list_contains([{_COG}], x))) AS cognates FROM w WHERE lang = 'en')
SELECT e.doc_id, g.gid AS greek_id, round(e.n / greatest(g.gn, 1), 6) AS word_ratio, e.cognates::BIGINT AS cognates, CASE WHEN e.n / greatest(g.gn, 1) > 1.2 THEN 'more' WHEN e.n / greatest(g.gn, 1) < 0.8 THEN 'fewer' ELSE 'alike' END AS note FROM e JOIN g USING (genre)""")
def translation_ratio(spark, d):
    """English texts against the first Greek one of their genre: words for words, and cognates of a word list."""
    tokens = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x != "")
    w = _docs(spark, d).where("genre is not null").select("doc_id", "genre", "lang", F.size(tokens(F.col("text"))).alias("n"), "text")
    g = w.where("lang = 'grc'").groupBy("genre").agg(F.min("doc_id").alias("greek_id"), F.min_by("n", "doc_id").alias("gn"))
    clean = F.transform(tokens(F.lower("text")), lambda x: F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}_]", ""))
    e = w.where("lang = 'en'").select("doc_id", "genre", "n", F.size(F.filter(clean, lambda x: x.isin(*COGNATES))).cast("long").alias("cognates"))
    ratio = F.col("n") / F.greatest("gn", F.lit(1))
    return e.join(g, "genre").select("doc_id", "greek_id", R(ratio).alias("word_ratio"), "cognates", F.when(ratio > 1.2, "more").when(ratio < 0.8, "fewer").otherwise("alike").alias("note"))


# ------------------------------------------------------------ statistics of annotation


@query("relation_totals", f"WITH {TOK} SELECT deprel AS relation, count(*) AS total FROM tok WHERE deprel IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def relation_totals(spark, d):
    return base.tokens(spark, d).where("deprel is not null").groupBy(F.col("deprel").alias("relation")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "relation").limit(20)


@query("parsed_documents", f"WITH {TOK}, {DOC} SELECT d.language, count(DISTINCT t.document_id) AS documents, count(*) AS tokens FROM tok t JOIN doc d USING (document_id) GROUP BY 1")
def parsed_documents(spark, d):
    n = base.tokens(spark, d).groupBy("document_id").agg(F.count("*").alias("n")).join(base.documents(spark, d).select("document_id", "language"), "document_id")
    return n.groupBy("language").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


@query("role_statistics", f"WITH {corpus._FRAMES} SELECT class, lemma AS predicate, count(*) AS annotations, sum(n_args)::BIGINT AS arguments FROM frame GROUP BY 1, 2 HAVING count(*) >= 2")
def role_statistics(spark, d):
    f = valency.instances(base.tokens(spark, d))
    return f.groupBy("class", F.col("lemma").alias("predicate")).agg(F.count("*").alias("annotations"), F.sum("n_args").alias("arguments")).where("annotations >= 2")


_SETS = """s AS (SELECT document_id, 'unigram' AS kind, lower(form) AS f FROM tok WHERE form IS NOT NULL UNION ALL SELECT document_id, 'pos', upos FROM tok WHERE upos IS NOT NULL UNION ALL SELECT document_id, 'syntax', deprel FROM tok WHERE deprel IS NOT NULL
 UNION ALL SELECT document_id, 'bigram', a || ' ' || b FROM (SELECT document_id, lower(form) AS a, lead(lower(form)) OVER (PARTITION BY sentence_id ORDER BY token_index) AS b FROM tok) WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query("feature_sets", f"WITH {TOK}, {_SETS} SELECT document_id, kind, count(*) AS n, count(DISTINCT f) AS features FROM s GROUP BY 1, 2")
def feature_sets(spark, d):
    """Sizes of the feature sets of each document: words, word pairs, parts of speech and relations, in one pass over the tokens."""
    w = W.partitionBy("sentence_id").orderBy("token_index")
    t = base.tokens(spark, d).select("document_id", F.lower("form").alias("a"), F.lead(F.lower("form")).over(w).alias("b"), "upos", "deprel")
    kinds = {"unigram": F.col("a"), "bigram": F.col("a") + F.col("b"), "pos": F.col("upos"), "syntax": F.col("deprel")}
    kinds["bigram"] = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat_ws(" ", "a", "b"))
    x = t.select("document_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("f")) for k, c in kinds.items()])).alias("x")).select("document_id", "x.*").where("f is not null")
    per = x.groupBy("document_id", "kind", "f").agg(F.count("*").alias("n"))
    return per.groupBy("document_id", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("features"))


@query("pattern_clusters")
def pattern_clusters(spark, d):
    """Sizes of the clusters of verbs with their patterns."""
    x = valency.lexicon(valency.instances(base.tokens(spark, d))).select(F.concat_ws(" : ", "lemma", "pattern").alias("t"))
    return classify.text_clusters(x, "t").groupBy("cluster").agg(F.count("*").alias("n"))


@query("gap_clusters")
def gap_clusters(spark, d):
    """Periods by how much the corpus has of them: documents, tokens and languages, standardised and clustered."""
    n = base.tokens(spark, d).groupBy("document_id").agg(F.count("*").alias("n")).join(base.documents(spark, d).where("period is not null"), "document_id")
    x = n.groupBy("period").agg(F.count("*").cast("double").alias("documents"), F.sum("n").cast("double").alias("tokens"), F.count_distinct("language").cast("double").alias("languages"))
    return classify.profile_clusters(x, ["documents", "tokens", "languages"]).select("period", "documents", "tokens", "languages", "cluster")


# ------------------------------------------------------------ keeping of tables


@query("stage_batch", """WITH q AS (SELECT id, length(content) AS n FROM corpus_items WHERE status = 'scraped' ORDER BY priority DESC NULLS LAST, created_at ASC NULLS LAST, id LIMIT 50) SELECT id, CASE WHEN n >= 400 THEN 'parsed' ELSE 'failed' END AS status, CASE WHEN n >= 400 THEN NULL ELSE 'too short' END AS error FROM q""")
def stage_batch(spark, d):
    """One turn of a stage: the 50 waiting items of highest priority get their next status, or failed with a reason. The batch size is the feature."""
    long = F.length("content") >= 400
    return upkeep.stage(table(spark, d, "corpus_items"), "scraped", 50, F.when(long, "parsed").otherwise("failed"), F.when(~F.coalesce(long, F.lit(False)), "too short"))


@query("ttl_cache", """WITH a AS (SELECT max(ts) AS now FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts IS NOT NULL) SELECT user_id, event_type AS value, ts + INTERVAL 2 DAY AS expires_at FROM l, a WHERE k = 1 AND ts + INTERVAL 2 DAY > now""")
def ttl_cache(spark, d):
    """What a cache still holds at the time of the last event: each user's latest event for two days."""
    e = table(spark, d, "events").where("ts is not null")
    held = upkeep.latest(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", F.col("event_type").alias("value"), (F.col("ts") + F.expr("interval 2 days")).alias("expires_at"))
    return held.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where("expires_at > now").drop("now")  # one row


@query("audit_log", "SELECT substring(md5(strftime(scraped_at, '%Y-%m-%d %H:%M:%S') || id || 'scrape'), 1, 16) AS log_id, id AS item_id, 'scrape' AS action, 'queued' AS old_value, status AS new_value FROM corpus_items WHERE scraped_at IS NOT NULL")
def audit_log(spark, d):
    x = table(spark, d, "corpus_items").where("scraped_at is not null")
    key = F.concat(F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss"), F.col("id").cast("string"), F.lit("scrape"))
    return x.select(F.substring(F.md5(key), 1, 16).alias("log_id"), F.col("id").alias("item_id"), F.lit("scrape").alias("action"), F.lit("queued").alias("old_value"), F.col("status").alias("new_value"))


@query("quality_snapshot", f"""WITH {TOK}, {SEN} SELECT (SELECT count(*) FROM corpus_items) AS documents, (SELECT count(*) FROM sen) AS sentences, count(*) AS tokens, count(CASE WHEN lemma IS NOT NULL AND upos IS NOT NULL THEN 1 END) AS annotated, (SELECT count(*) FROM corpus_items WHERE status = 'annotated') AS validated,
 round(count(CASE WHEN lemma IS NOT NULL AND upos IS NOT NULL THEN 1 END) / count(*), 6) AS coverage, (SELECT round(avg((status = 'failed')::INT), 6) FROM corpus_items) AS error_rate FROM tok""")
def quality_snapshot(spark, d):
    """One row to append to a table of snapshots."""
    done = F.count_if(F.col("lemma").isNotNull() & F.col("upos").isNotNull())
    t = base.tokens(spark, d).agg(F.count("*").alias("tokens"), done.alias("annotated"))
    i = table(spark, d, "corpus_items").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "annotated").alias("validated"), R(F.avg((F.col("status") == "failed").cast("int"))).alias("error_rate"))
    s = base.sentences(spark, d).agg(F.count("*").alias("sentences"))
    j = t.crossJoin(F.broadcast(i)).crossJoin(F.broadcast(s))  # one row each
    return j.select("documents", "sentences", "tokens", "annotated", "validated", R(F.col("annotated") / F.col("tokens")).alias("coverage"), "error_rate")


# ------------------------------------------------------------ round trips: what is exported is read again

_BACK = "nullif(nullif({0}, ''), '_')"


@query("conllu_round_trip", f"WITH {TOK} SELECT sentence_id, token_index, form, {_BACK.format('lemma')} AS lemma, {_BACK.format('upos')} AS upos, {_BACK.format('feats')} AS feats, head, {_BACK.format('deprel')} AS deprel FROM tok WHERE form IS NOT NULL")
def conllu_round_trip(spark, d):
    t = base.tokens(spark, d).where("form is not null")
    texts = exporters.conllu(t).select(F.concat(F.lit("# sent_id = "), F.col("sentence_id").cast("string"), F.lit("\n"), F.col("conllu")).alias("value"))
    return readers.parse_conllu(texts).select(F.col("sentence_id").cast("long").alias("sentence_id"), "token_index", "form", "lemma", "upos", "feats", "head", "deprel")


def _back_and_forth(spark, df, kind: str, read):
    """A table written to a folder of its own in the shared folder and read again; the files go when they are read."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    exporters.write(df, path, kind)
    out = cut(read(path))
    drop_folder(spark, path)
    return out


@query("json_round_trip", "SELECT id, md5(content) AS digest, coalesce(language, '') AS language, coalesce(word_count, 0) AS word_count FROM corpus_items WHERE length(trim(coalesce(content, ''), ' ')) > 0")
def json_round_trip(spark, d):
    read = lambda path: readers.json_lines(spark, path, "id long, text string, language string, word_count long").select("id", F.md5("text").alias("digest"), "language", "word_count")
    return _back_and_forth(spark, exporters.training_rows(table(spark, d, "corpus_items")), "jsonl", read)


@query("csv_round_trip", "SELECT id, url, source_type, status, priority::BIGINT AS priority FROM corpus_items")
def csv_round_trip(spark, d):
    rows = table(spark, d, "corpus_items").select("id", "url", "source_type", "status", F.col("priority").cast("long").alias("priority"))
    read = lambda path: spark.read.option("header", True).option("escape", '"').schema("id long, url string, source_type string, status string, priority long").csv(path)
    return _back_and_forth(spark, rows, "csv", read)





@query("proiel_round_trip", f"WITH {TOK} SELECT sentence_id, token_index, form, coalesce(lemma, '') AS lemma, head, coalesce(deprel, '') AS deprel FROM tok WHERE form IS NOT NULL")
def proiel_round_trip(spark, d):
    x = readers.parse_proiel(exporters.proiel(base.tokens(spark, d).where("form is not null")))
    return x.select(F.col("sentence_id").cast("long").alias("sentence_id"), "token_index", "form", F.coalesce("lemma", F.lit("")).alias("lemma"), "head", F.coalesce("deprel", F.lit("")).alias("deprel"))


@query("nested_round_trip", f"WITH {TOK} SELECT document_id, count(*) AS tokens, count(DISTINCT sentence_id) AS sentences, sum(token_index)::BIGINT AS places FROM tok GROUP BY 1")
def nested_round_trip(spark, d):
    schema = "document_id long, sentences array<struct<sentence_id: long, tokens: array<struct<token_index: long, form: string, lemma: string>>>>"
    x = exporters.nested(base.tokens(spark, d)).select(F.from_json("json", schema).alias("j")).select("j.document_id", F.explode("j.sentences").alias("s"))
    one = x.select("document_id", F.size("s.tokens").cast("long").alias("n"), F.aggregate("s.tokens", F.lit(0).cast("long"), lambda a, t: a + t["token_index"]).alias("p"))
    return one.groupBy("document_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("sentences"), F.sum("p").alias("places"))
