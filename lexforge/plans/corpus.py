"""Queries over annotated tokens: search, frequency, collocation, keyness, change over time, valency, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import cql, diachrony, lexis, trees, valency
from lexforge.plans import base
from lexforge.plans.base import DOC, RANK, SEN, TOK
from lexforge.plans.catalog import query

R = lambda c, n=6: F.round(c, n)

# ------------------------------------------------------------ search


@query("cql_sequence", f"""WITH {TOK}, x AS (SELECT document_id, sentence_id, token_index AS start, form, upos, lead(form) OVER w AS f1, lead(upos) OVER w AS u1, lead(form, 2) OVER w AS f2, lead(upos, 2) OVER w AS u2
 FROM tok WINDOW w AS (PARTITION BY sentence_id ORDER BY token_index))
SELECT document_id, sentence_id, start, 3 AS length, form || ' ' || f1 || ' ' || f2 AS matched FROM x WHERE upos = 'DET' AND u1 = 'NOUN' AND u2 = 'VERB' AND form IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL""")
def cql_sequence(spark, d):
    return cql.search(base.tokens(spark, d).where("form is not null"), '[pos="DET"] [pos="NOUN"] [pos="VERB"]')


@query("cql_repetition", f"""WITH {TOK}, x AS (SELECT document_id, sentence_id, token_index AS start, form, upos, lead(form) OVER w AS f1, lead(upos) OVER w AS u1, lead(form, 2) OVER w AS f2, lead(upos, 2) OVER w AS u2, lead(form, 3) OVER w AS f3, lead(upos, 3) OVER w AS u3
 FROM tok WINDOW w AS (PARTITION BY sentence_id ORDER BY token_index))
SELECT document_id, sentence_id, start, 2 AS length, concat_ws(' ', form, f1) AS matched FROM x WHERE upos = 'ADP' AND u1 = 'NOUN'
UNION ALL SELECT document_id, sentence_id, start, 3, concat_ws(' ', form, f1, f2) FROM x WHERE upos = 'ADP' AND u1 = 'DET' AND u2 = 'NOUN'
UNION ALL SELECT document_id, sentence_id, start, 4, concat_ws(' ', form, f1, f2, f3) FROM x WHERE upos = 'ADP' AND u1 = 'DET' AND u2 = 'DET' AND u3 = 'NOUN'""")
def cql_repetition(spark, d):
    return cql.search(base.tokens(spark, d), '[pos="ADP"] [pos="DET"]{0,2} [pos="NOUN"]')


@query("cql_features", f"""WITH {TOK} SELECT document_id, sentence_id, token_index AS start, 1 AS length, coalesce(form, '') AS matched FROM tok
 WHERE (upos = 'NOUN' OR upos = 'PROPN') AND regexp_matches(lemma, '^(?:[αβγ].*)$', 'i') AND coalesce(deprel, '') <> 'nsubj'""")
def cql_features(spark, d):
    return cql.search(base.tokens(spark, d), '[(pos="NOUN" | pos="PROPN") & lemma=/[αβγ].*/ & deprel!="nsubj"]')


@query("simple_search", f"""WITH {TOK} SELECT document_id, sentence_id, token_index AS start, 1 AS length, form AS matched FROM tok WHERE lower(form) = 'the' OR lower(lemma) = 'the'""")
def simple_search(spark, d):
    return cql.find(base.tokens(spark, d), "the")


@query("kwic", f"""WITH {TOK}, {SEN}, h AS (SELECT document_id, sentence_id, token_index AS start, form AS matched FROM tok WHERE upos = 'VERB' AND form IS NOT NULL),
 j AS (SELECT h.*, s.text, instr(lower(s.text), lower(split_part(matched, ' ', 1))) AS pos FROM h JOIN sen s USING (sentence_id))
SELECT document_id, sentence_id, start, trim(substring(text, greatest(pos - 50, 1), pos - greatest(pos - 50, 1)), ' ') AS left_context, matched AS keyword, trim(substring(text, pos + length(matched), 50), ' ') AS right_context,
 CAST(length(matched) AS INTEGER) AS size FROM j WHERE pos > 0""")
def kwic(spark, d):
    hits = cql.search(base.tokens(spark, d).where("form is not null"), '[pos="VERB"]')
    return cql.concordance(hits, base.sentences(spark, d))


# ------------------------------------------------------------ frequency


@query("frequency_list", f"WITH {TOK} SELECT lemma AS item, count(*) AS freq, count(DISTINCT document_id) AS docs FROM tok WHERE lemma IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def frequency_list(spark, d):
    return lexis.frequency_list(base.tokens(spark, d), least=2)


@query("frequency_top_nouns", f"WITH {TOK} SELECT lemma AS item, count(*) AS freq, count(DISTINCT document_id) AS docs FROM tok WHERE lemma IS NOT NULL AND upos = 'NOUN' GROUP BY 1 ORDER BY freq DESC, item LIMIT 50")
def frequency_top_nouns(spark, d):
    return lexis.frequency_list(base.tokens(spark, d), upos="NOUN", top=50)


@query("pos_distribution", f"WITH {TOK} SELECT upos, count(*) AS n FROM tok WHERE upos IS NOT NULL AND upos <> '' GROUP BY 1")
def pos_distribution(spark, d):
    return base.tokens(spark, d).where("upos is not null and upos <> ''").groupBy("upos").agg(F.count("*").alias("n"))


@query("hapax_legomena", f"WITH {TOK} SELECT lemma FROM tok WHERE lemma IS NOT NULL GROUP BY 1 HAVING count(*) = 1")
def hapax_legomena(spark, d):
    return lexis.frequency_list(base.tokens(spark, d)).where("freq = 1").select(F.col("item").alias("lemma"))


@query("corpus_statistics", f"""WITH {TOK} SELECT count(*) AS tokens, count(DISTINCT sentence_id) AS sentences, count(DISTINCT document_id) AS documents, count(DISTINCT form) AS forms, count(DISTINCT lemma) AS lemmas,
 round(count(DISTINCT form) / count(*), 6) AS ttr, round(count(*) / count(DISTINCT sentence_id), 6) AS mean_length FROM tok""")
def corpus_statistics(spark, d):
    # each distinct count from its own narrow aggregate: no row is expanded five times
    t = base.tokens(spark, d)
    a = t.groupBy("sentence_id", "document_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("tokens"), F.count("*").alias("sentences"), F.count_distinct("document_id").alias("documents"))
    forms = t.where("form is not null").groupBy("form").agg(F.lit(1)).agg(F.count("*").alias("forms"))
    lemmas = t.where("lemma is not null").groupBy("lemma").agg(F.lit(1)).agg(F.count("*").alias("lemmas"))
    j = a.crossJoin(F.broadcast(forms)).crossJoin(F.broadcast(lemmas))
    return j.select("tokens", "sentences", "documents", "forms", "lemmas", R(F.col("forms") / F.col("tokens")).alias("ttr"), R(F.col("tokens") / F.col("sentences")).alias("mean_length"))


@query("tokens_by_language_period", f"WITH {TOK}, {DOC} SELECT d.language, d.period, count(*) AS tokens, count(DISTINCT t.document_id) AS docs FROM tok t JOIN doc d USING (document_id) GROUP BY 1, 2")
def tokens_by_language_period(spark, d):
    n = base.tokens(spark, d).groupBy("document_id").agg(F.count("*").alias("n"))
    return n.join(base.documents(spark, d), "document_id").groupBy("language", "period").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))


@query("vocabulary_growth", f"""WITH {TOK}, p AS (SELECT document_id, form, row_number() OVER (PARTITION BY document_id ORDER BY sentence_id, token_index) AS pos FROM tok WHERE form IS NOT NULL),
 f AS (SELECT *, row_number() OVER (PARTITION BY document_id, form ORDER BY pos) AS k FROM p)
SELECT * FROM (SELECT document_id, pos, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) AS BIGINT) AS types FROM f) WHERE pos % 25 = 0""")
def vocabulary_growth(spark, d):
    from pyspark.sql import Window as W

    p = base.tokens(spark, d).where("form is not null").withColumn("pos", F.row_number().over(W.partitionBy("document_id").orderBy("sentence_id", "token_index")).cast("long"))
    f = p.withColumn("k", F.row_number().over(W.partitionBy("document_id", "form").orderBy("pos")))
    g = f.withColumn("types", F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).over(W.partitionBy("document_id").orderBy("pos")))
    return g.where("pos % 25 = 0").select("document_id", "pos", "types")


@query("inverted_index", f"WITH {TOK} SELECT lower(form) AS term, count(*) AS freq, count(DISTINCT document_id) AS docs, min(token_id) AS first_token, max(token_id) AS last_token FROM tok WHERE form IS NOT NULL GROUP BY 1")
def inverted_index(spark, d):
    t = base.tokens(spark, d).where("form is not null")
    return t.groupBy(F.lower("form").alias("term")).agg(F.count("*").alias("freq"), F.count_distinct("document_id").alias("docs"), F.min("token_id").alias("first_token"), F.max("token_id").alias("last_token"))


@query("pos_inconsistency", f"WITH {TOK} SELECT lemma, count(DISTINCT upos) AS tags, string_agg(DISTINCT upos, ',' ORDER BY upos) AS tag_list FROM tok WHERE lemma IS NOT NULL AND upos IS NOT NULL GROUP BY 1 HAVING count(DISTINCT upos) > 1")
def pos_inconsistency(spark, d):
    t = base.tokens(spark, d).where("lemma is not null and upos is not null").groupBy("lemma").agg(F.array_sort(F.collect_set("upos")).alias("s"))
    return t.where(F.size("s") > 1).select("lemma", F.size("s").cast("long").alias("tags"), F.array_join("s", ",").alias("tag_list"))


@query("annotation_coverage", f"""WITH {TOK} SELECT document_id, count(*) AS tokens, round(count(CASE WHEN lemma <> '' THEN 1 END) / count(*), 6) AS lemma_share, round(count(CASE WHEN upos <> '' THEN 1 END) / count(*), 6) AS upos_share,
 round(count(CASE WHEN feats <> '' THEN 1 END) / count(*), 6) AS feats_share FROM tok GROUP BY 1""")
def annotation_coverage(spark, d):
    share = lambda c: R(F.count_if(F.coalesce(F.col(c) != "", F.lit(False))) / F.count("*")).alias(f"{c}_share")
    return base.tokens(spark, d).groupBy("document_id").agg(F.count("*").alias("tokens"), share("lemma"), share("upos"), share("feats"))


@query("stylometry", f"""WITH {TOK}, w AS (SELECT document_id, length(form) AS l, upos, form FROM tok WHERE form IS NOT NULL)
SELECT document_id, count(*) AS tokens, round(avg(l), 6) AS mean_word, round(stddev_pop(l), 6) AS sd_word, max(l) AS longest, round(count(DISTINCT form) / count(*), 6) AS ttr, round(count(CASE WHEN upos = 'PUNCT' THEN 1 END) / count(*), 6) AS punct FROM w GROUP BY 1""")
def stylometry(spark, d):
    w = base.tokens(spark, d).where("form is not null").select("document_id", "form", "upos", F.length("form").cast("long").alias("l"))
    return w.groupBy("document_id").agg(
        F.count("*").alias("tokens"), R(F.avg("l")).alias("mean_word"), R(F.stddev_pop("l")).alias("sd_word"), F.max("l").alias("longest"), R(F.count_distinct("form") / F.count("*")).alias("ttr"), R(F.count_if(F.coalesce(F.col("upos") == "PUNCT", F.lit(False))) / F.count("*")).alias("punct")
    )


# ------------------------------------------------------------ n-grams, collocations, keyness


@query("bigrams", f"""WITH {TOK}, x AS (SELECT document_id, lemma AS a, lead(lemma) OVER (PARTITION BY sentence_id ORDER BY token_index) AS b FROM tok)
SELECT a || ' ' || b AS ngram, count(*) AS freq, count(DISTINCT document_id) AS docs FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def bigrams(spark, d):
    return lexis.ngrams(base.tokens(spark, d), 2, least=3)


@query("trigrams_by_pos", f"""WITH {TOK}, x AS (SELECT document_id, lemma AS a, upos AS ta, lead(lemma) OVER w AS b, lead(upos) OVER w AS tb, lead(lemma, 2) OVER w AS c, lead(upos, 2) OVER w AS tc FROM tok WINDOW w AS (PARTITION BY sentence_id ORDER BY token_index))
SELECT a || ' ' || b || ' ' || c AS ngram, count(*) AS freq, count(DISTINCT document_id) AS docs FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND ta = 'ADP' AND tb = 'DET' AND tc = 'NOUN' GROUP BY 1 HAVING count(*) >= 2""")
def trigrams_by_pos(spark, d):
    return lexis.ngrams(base.tokens(spark, d), 3, pattern=["ADP", "DET", "NOUN"], least=2)


_G2 = """2 * (o11 * ln(o11 / (r * c / n)) + CASE WHEN r - o11 > 0 THEN (r - o11) * ln((r - o11) / (r * (n - c) / n)) ELSE 0 END + CASE WHEN c - o11 > 0 THEN (c - o11) * ln((c - o11) / ((n - r) * c / n)) ELSE 0 END
 + CASE WHEN n - r - c + o11 > 0 AND (n - r) * (n - c) > 0 THEN (n - r - c + o11) * ln((n - r - c + o11) / ((n - r) * (n - c) / n)) ELSE 0 END)"""


@query("collocations", f"""WITH {TOK}, a AS (SELECT lemma, sentence_id, token_index FROM tok WHERE lemma IS NOT NULL),
 p AS (SELECT x.lemma AS node, y.lemma AS collocate, count(*) AS o FROM a x JOIN a y ON x.sentence_id = y.sentence_id AND y.token_index BETWEEN x.token_index - 3 AND x.token_index + 3 AND y.token_index <> x.token_index WHERE x.lemma <> y.lemma GROUP BY 1, 2 HAVING count(*) >= 3),
 f AS (SELECT lemma, count(*) AS f FROM a GROUP BY 1), t AS (SELECT sum(f) AS n FROM f),
 j AS (SELECT node, collocate, CAST(o AS DOUBLE) AS o11, CAST(f1.f AS DOUBLE) AS r, CAST(f2.f AS DOUBLE) AS c, CAST(t.n AS DOUBLE) AS n FROM p JOIN f f1 ON f1.lemma = node JOIN f f2 ON f2.lemma = collocate, t)
SELECT node, collocate, CAST(o11 AS BIGINT) AS o11, CAST(r AS BIGINT) AS f1, CAST(c AS BIGINT) AS f2, round(14 + log2(2 * o11 / (r + c)), 5) AS logdice, round(log2(o11 * n / (r * c)), 5) AS mi, round(log2(o11 * o11 * o11 * n / (r * c)), 5) AS mi3,
 round((o11 - r * c / n) / sqrt(o11), 5) AS t, round({_G2}, 4) AS g2 FROM j""")
def collocations(spark, d):
    t = base.tokens(spark, d).where("lemma is not null").select("lemma", "sentence_id", "token_index", "document_id")
    c = lexis.collocations(t, size=3, least=3)
    return c.select("node", "collocate", "o11", "f1", "f2", R(F.col("logdice"), 5).alias("logdice"), R(F.col("mi"), 5).alias("mi"), R(F.col("mi3"), 5).alias("mi3"), R(F.col("t"), 5).alias("t"), R(F.col("g2"), 4).alias("g2"))


@query("keywords_period", f"""WITH {TOK}, {DOC}, x AS (SELECT t.lemma AS item, CASE WHEN d.period = 'classical' THEN 1 ELSE 0 END AS f, CASE WHEN d.period IN ('medieval', 'modern') THEN 1 ELSE 0 END AS r FROM tok t JOIN doc d USING (document_id) WHERE t.lemma IS NOT NULL),
 q AS (SELECT item, CAST(sum(f) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS b FROM x GROUP BY 1 HAVING sum(f) + sum(r) > 0), n AS (SELECT sum(a) AS p, sum(b) AS q2 FROM q),
 e AS (SELECT *, p * (a + b) / (p + q2) AS e1, q2 * (a + b) / (p + q2) AS e2 FROM q, n WHERE a >= 2 AND p > 0 AND q2 > 0)
SELECT item, CAST(a AS BIGINT) AS focus_freq, CAST(b AS BIGINT) AS reference_freq, round(CASE WHEN a / p >= b / q2 THEN 1 ELSE -1 END * 2 * (a * ln(a / e1) + CASE WHEN b > 0 THEN b * ln(b / e2) ELSE 0 END), 5) AS ll FROM e""")
def keywords_period(spark, d):
    t = base.tokens(spark, d).select("document_id", "lemma").join(base.documents(spark, d).select("document_id", "period"), "document_id")
    k = lexis.keywords(t, F.coalesce(F.col("period") == "classical", F.lit(False)), F.coalesce(F.col("period").isin("medieval", "modern"), F.lit(False)), least=2)
    return k.select("item", "focus_freq", "reference_freq", R(F.col("ll"), 5).alias("ll"))


@query("keywords_chi_square", f"""WITH {TOK}, {DOC}, x AS (SELECT t.lemma AS item, CASE WHEN d.language IN ('grc', 'el') THEN 1 ELSE 0 END AS f, CASE WHEN d.language NOT IN ('grc', 'el') THEN 1 ELSE 0 END AS r FROM tok t JOIN doc d USING (document_id) WHERE t.lemma IS NOT NULL),
 q AS (SELECT item, CAST(sum(f) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS b FROM x GROUP BY 1), n AS (SELECT sum(a) AS p, sum(b) AS q2 FROM q),
 e AS (SELECT *, p - a AS c, q2 - b AS e, p + q2 AS n FROM q, n WHERE a >= 1 AND p > 0 AND q2 > 0)
SELECT item, CAST(a AS BIGINT) AS focus_freq, CAST(b AS BIGINT) AS reference_freq, round(CASE WHEN a / p >= b / q2 THEN 1 ELSE -1 END * n * pow(a * e - b * c, 2) / ((a + b) * (c + e) * p * q2), 4) AS chi2 FROM e""")
def keywords_chi_square(spark, d):
    t = base.tokens(spark, d).select("document_id", "lemma").join(base.documents(spark, d).select("document_id", "language"), "document_id")
    greek = F.col("language").isin("grc", "el")
    return lexis.keywords(t, greek, ~greek, least=1).select("item", "focus_freq", "reference_freq", R(F.col("chi2"), 4).alias("chi2"))


@query("terminology", f"""WITH {TOK}, {DOC}, g AS (SELECT t.sentence_id, t.token_index, t.lemma, d.genre FROM tok t JOIN doc d USING (document_id)),
 x AS (SELECT genre, lemma AS a, lead(lemma) OVER (PARTITION BY sentence_id ORDER BY token_index) AS b FROM g)
SELECT a || ' ' || b AS term, count(*) AS freq, count(*) * 2 AS score FROM x WHERE genre = 'medicine' AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def terminology(spark, d):
    docs = base.documents(spark, d).where("genre = 'medicine'").select("document_id")
    t = base.tokens(spark, d).join(docs, "document_id", "left_semi")
    return lexis.ngrams(t, 2, least=2).select(F.col("ngram").alias("term"), "freq", (F.col("freq") * 2).alias("score"))


@query("word_sketch_verbs", f"""WITH {TOK}, p AS (SELECT CASE x.deprel WHEN 'nsubj' THEN 'subject' WHEN 'obj' THEN 'object' WHEN 'obl' THEN 'oblique' WHEN 'advmod' THEN 'modifier' ELSE 'conjunct' END AS relation, h.lemma, x.lemma AS collocate
  FROM tok x JOIN tok h ON h.sentence_id = x.sentence_id AND h.token_index = x.head WHERE x.head > 0 AND h.upos = 'VERB' AND x.deprel IN ('nsubj', 'obj', 'obl', 'advmod', 'conj') AND h.lemma IS NOT NULL AND x.lemma IS NOT NULL),
 q AS (SELECT lemma, relation, collocate, count(*) AS freq FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2), s AS (SELECT *, row_number() OVER (PARTITION BY lemma, relation ORDER BY freq DESC, collocate) AS k FROM q),
 f AS (SELECT lemma, count(*) AS f FROM tok WHERE lemma IS NOT NULL GROUP BY 1), j AS (SELECT s.lemma, relation, s.collocate, freq, round(14 + log2(2.0::DOUBLE * freq / (a.f + b.f)), 6) AS logdice FROM s JOIN f a ON a.lemma = s.lemma JOIN f b ON b.lemma = s.collocate WHERE k <= 20)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lemma, relation ORDER BY logdice DESC, collocate) AS INTEGER) AS rank FROM j) WHERE rank <= 10""")
def word_sketch_verbs(spark, d):
    return lexis.word_sketch(base.tokens(spark, d), "VERB")


@query("sketch_difference", f"""WITH {TOK}, p AS (SELECT h.lemma, x.deprel AS relation, x.lemma AS collocate FROM tok x JOIN tok h ON h.sentence_id = x.sentence_id AND h.token_index = x.head WHERE x.head > 0 AND h.lemma IN ('γράφω', 'λέγω', 'dico', 'audio') AND x.lemma IS NOT NULL AND x.deprel IS NOT NULL),
 a AS (SELECT DISTINCT relation, collocate FROM p WHERE lemma IN ('γράφω', 'dico')), b AS (SELECT DISTINCT relation, collocate FROM p WHERE lemma IN ('λέγω', 'audio'))
SELECT coalesce(a.relation, b.relation) AS relation, coalesce(a.collocate, b.collocate) AS collocate, CASE WHEN a.relation IS NULL THEN 'only_second' WHEN b.relation IS NULL THEN 'only_first' ELSE 'shared' END AS status FROM a FULL JOIN b ON a.relation = b.relation AND a.collocate = b.collocate""")
def sketch_difference(spark, d):
    x = lexis.dependencies(base.tokens(spark, d)).where("dep_lemma is not null and deprel is not null")
    side = F.when(F.col("head_lemma").isin("γράφω", "dico"), "one").when(F.col("head_lemma").isin("λέγω", "audio"), "two")
    return lexis.sketch_difference(x.select(side.alias("lemma"), F.col("deprel").alias("relation"), F.col("dep_lemma").alias("collocate")).where("lemma is not null").distinct(), "one", "two")


@query("thesaurus", f"""WITH {TOK}, a AS (SELECT lemma, sentence_id, token_index FROM tok WHERE lemma IS NOT NULL),
 c AS (SELECT x.lemma AS node, y.lemma AS ctx, CAST(count(*) AS DOUBLE) AS c FROM a x JOIN a y ON x.sentence_id = y.sentence_id AND y.token_index BETWEEN x.token_index - 3 AND x.token_index + 3 AND y.token_index <> x.token_index WHERE x.lemma <> y.lemma GROUP BY 1, 2),
 n AS (SELECT node, sqrt(sum(c * c)) AS norm, sum(c) AS total FROM c GROUP BY 1), m AS (SELECT ctx, c AS m FROM c WHERE node = 'ὁ')
SELECT c.node AS other, round(sum(c.c * m.m) / (any_value(n.norm) * (SELECT norm FROM n WHERE node = 'ὁ')), 6) AS cosine FROM c JOIN m USING (ctx) JOIN n ON n.node = c.node WHERE c.node <> 'ὁ' AND n.total >= 5 GROUP BY 1""")
def thesaurus(spark, d):
    t = base.tokens(spark, d).where("lemma is not null").select("lemma", "sentence_id", "token_index", "document_id")
    return lexis.thesaurus(t, "ὁ").select("other", R(F.col("cosine")).alias("cosine"))


# ------------------------------------------------------------ change over time


@query("frequency_by_period", f"""WITH {TOK}, {DOC}, x AS (SELECT t.lemma, d.period FROM tok t JOIN doc d USING (document_id) WHERE d.period IS NOT NULL), s AS (SELECT period, count(*) AS n FROM x GROUP BY 1)
SELECT lemma AS item, period, count(*) AS freq, round(count(*) * 1e6 / any_value(s.n), 4) AS per_million FROM x JOIN s USING (period) WHERE lemma IS NOT NULL GROUP BY 1, 2""")
def frequency_by_period(spark, d):
    t = base.tokens(spark, d).select("document_id", "lemma").join(base.documents(spark, d).select("document_id", "period"), "document_id")
    return diachrony.per_million(t, "lemma").withColumn("per_million", R(F.col("per_million"), 4))


@query("detect_change", f"""WITH {TOK}, {DOC}, x AS (SELECT t.lemma, d.period FROM tok t JOIN doc d USING (document_id) WHERE d.period IS NOT NULL), s AS (SELECT period, count(*) AS n FROM x GROUP BY 1),
 f AS (SELECT lemma AS item, period, count(*) * 1e6 / any_value(s.n) AS pm, {RANK} AS rk FROM x JOIN s USING (period) WHERE lemma IS NOT NULL GROUP BY 1, 2), g AS (SELECT item, lag(period) OVER w AS from_period, period AS to_period, pm / lag(pm) OVER w AS ratio FROM f WHERE rk IS NOT NULL WINDOW w AS (PARTITION BY item ORDER BY rk))
SELECT item, from_period, to_period, round(ratio, 4) AS ratio, CASE WHEN ratio > 1 THEN 'rise' ELSE 'fall' END AS kind FROM g WHERE from_period IS NOT NULL AND (ratio >= 2 OR ratio <= 0.5)""")
def detect_change(spark, d):
    t = base.tokens(spark, d).select("document_id", "lemma").join(base.documents(spark, d).select("document_id", "period"), "document_id")
    return diachrony.changes(diachrony.per_million(t, "lemma"), base.period_rank(F.col("period"))).withColumn("ratio", R(F.col("ratio"), 4))


@query("distribution_change", f"""WITH {TOK}, {DOC}, x AS (SELECT t.deprel, d.period, count(*) AS n FROM tok t JOIN doc d USING (document_id) WHERE d.period IN ('classical', 'modern') AND t.deprel IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT period, sum(n) AS t FROM x GROUP BY 1), a AS (SELECT deprel, n / t AS p FROM x JOIN s USING (period) WHERE period = 'classical'), b AS (SELECT deprel, n / t AS p FROM x JOIN s USING (period) WHERE period = 'modern')
SELECT coalesce(a.deprel, b.deprel) AS deprel, round(coalesce(a.p, 0), 6) AS share_first, round(coalesce(b.p, 0), 6) AS share_second, round(coalesce(b.p, 0) - coalesce(a.p, 0), 6) AS difference FROM a FULL JOIN b ON a.deprel = b.deprel""")
def distribution_change(spark, d):
    t = base.tokens(spark, d).where("deprel is not null").groupBy("document_id", "deprel").agg(F.count("*").alias("n")).join(base.documents(spark, d).select("document_id", "period"), "document_id")
    x = diachrony.distribution_change(t, "deprel", "period", "classical", "modern")
    return x.select("deprel", *[R(F.col(c)).alias(c) for c in ("share_first", "share_second", "difference")])


@query("period_vocabulary_overlap", f"""WITH {TOK}, {DOC}, f AS (SELECT d.period, t.lemma, count(*) AS n FROM tok t JOIN doc d USING (document_id) WHERE t.lemma IS NOT NULL AND d.period IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT period, lemma FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, lemma) AS k FROM f) WHERE k <= 100)
SELECT a.period AS period_a, b.period AS period_b, count(*) AS shared FROM r a JOIN r b ON a.lemma = b.lemma AND a.period < b.period GROUP BY 1, 2""")
def period_vocabulary_overlap(spark, d):
    from pyspark.sql import Window as W

    t = base.tokens(spark, d).where("lemma is not null").select("document_id", "lemma").join(base.documents(spark, d).where("period is not null").select("document_id", "period"), "document_id")
    r = t.groupBy("period", "lemma").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(W.partitionBy("period").orderBy(F.desc("n"), "lemma"))).where("k <= 100")
    a, b = r.select(F.col("period").alias("period_a"), "lemma"), r.select(F.col("period").alias("period_b"), "lemma")
    return a.join(b, "lemma").where("period_a < period_b").groupBy("period_a", "period_b").agg(F.count("*").alias("shared"))


@query("sentence_length_effect", f"""WITH {TOK}, {DOC}, s AS (SELECT t.sentence_id, any_value(d.period) AS period, count(*) AS n FROM tok t JOIN doc d USING (document_id) GROUP BY 1),
 g AS (SELECT count(CASE WHEN period = 'classical' THEN n END) AS n1, count(CASE WHEN period = 'modern' THEN n END) AS n2, avg(CASE WHEN period = 'classical' THEN n END) AS mean1, avg(CASE WHEN period = 'modern' THEN n END) AS mean2,
  var_samp(CASE WHEN period = 'classical' THEN n END) AS v1, var_samp(CASE WHEN period = 'modern' THEN n END) AS v2 FROM s), e AS (SELECT *, CASE WHEN n1 > 1 AND n2 > 1 AND ((n1 - 1) * v1 + (n2 - 1) * v2) > 0 THEN (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) ELSE 0 END AS d FROM g)
SELECT n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM e""")
def sentence_length_effect(spark, d):
    s = base.tokens(spark, d).groupBy("sentence_id", "document_id").agg(F.count("*").alias("n")).join(base.documents(spark, d).select("document_id", "period"), "document_id")
    x = diachrony.cohens_d(s, "n", "period", "classical", "modern")
    return x.select("n1", "n2", R(F.col("mean1")).alias("mean1"), R(F.col("mean2")).alias("mean2"), R(F.col("d")).alias("d"), "label")


_U = lambda part, key: f"((('0x' || substring(md5({key}), {1 + 8 * part}, 8))::BIGINT + 0.5) / 4294967296.0)"
_Z = lambda key: f"sqrt(-2 * ln({_U(0, key)})) * cos(2 * pi() * {_U(1, key)})"
_BK = "concat_ws('|', g, x::DECIMAL(38, 6)::VARCHAR, b, 7)"


@query("sentence_length_bootstrap", f"""WITH {TOK}, {DOC}, s AS (SELECT sentence_id, d.period AS g, count(*)::DOUBLE AS x FROM tok t JOIN doc d USING (document_id) WHERE d.period IS NOT NULL GROUP BY 1, 2), c AS (SELECT g, x, count(*) AS c FROM s GROUP BY 1, 2), k AS (SELECT g, x, c, b FROM c, range(1, 101) AS r(b)),
 w AS (SELECT g, x, b, CASE WHEN c = 1 THEN (CASE {' '.join(f'WHEN {_U(0, _BK)} < {p} THEN {k}' for k, p in enumerate(diachrony.POISSON))} ELSE {len(diachrony.POISSON)} END)::DOUBLE ELSE greatest(0.0, round(c + sqrt(c) * {_Z(_BK)})) END AS w FROM k), m AS (SELECT g, b, sum(w * x) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2)
SELECT g AS period, round(any_value(z.mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, 100 AS rounds FROM m JOIN (SELECT g, sum(x * c) / sum(c) AS mean FROM c GROUP BY 1) z USING (g) GROUP BY 1""")
def sentence_length_bootstrap(spark, d):
    s = base.tokens(spark, d).groupBy("sentence_id", "document_id").agg(F.count("*").alias("n")).join(base.documents(spark, d).where("period is not null").select("document_id", "period"), "document_id")
    x = diachrony.bootstrap_mean(s.select("sentence_id", "n", "period"), "n", "period", rounds=100)
    return x.select("period", *[R(F.col(c)).alias(c) for c in ("mean", "low", "high")], "rounds")


@query("trend_slope", f"""WITH {TOK}, {DOC}, x AS (SELECT t.upos, d.period, {RANK.replace("period ", "d.period ", 1)} AS rk FROM tok t JOIN doc d USING (document_id) WHERE d.period IS NOT NULL), s AS (SELECT period, count(*) AS n FROM x GROUP BY 1),
 f AS (SELECT upos, rk, count(*) * 100.0::DOUBLE / any_value(s.n) AS share FROM x JOIN s USING (period) WHERE upos IS NOT NULL AND rk IS NOT NULL GROUP BY 1, 2)
SELECT upos, count(*) AS periods, round(regr_slope(share, rk), 6) AS slope, CASE WHEN regr_slope(share, rk) > 0.1 THEN 'rising' WHEN regr_slope(share, rk) < -0.1 THEN 'falling' ELSE 'stable' END AS trend FROM f GROUP BY 1 HAVING count(*) >= 3""")
def trend_slope(spark, d):
    t = base.tokens(spark, d).select("document_id", "upos").join(base.documents(spark, d).where("period is not null").select("document_id", "period"), "document_id")
    size = t.groupBy("period").agg(F.count("*").alias("n"))
    f = t.where("upos is not null").groupBy("upos", "period").agg(F.count("*").alias("c")).join(F.broadcast(size), "period").select("upos", base.period_rank(F.col("period")).alias("rk"), (F.col("c") * 100.0 / F.col("n")).alias("share")).where("rk is not null")
    x = diachrony.slope(f, "upos", "rk", "share")
    return x.select("upos", "periods", R(F.col("slope")).alias("slope"), "trend")


# ------------------------------------------------------------ valency

_ARG = "CASE x.deprel WHEN 'nsubj' THEN 'SUBJ' WHEN 'csubj' THEN 'SUBJ' WHEN 'obj' THEN 'OBJ' WHEN 'iobj' THEN 'IOBJ' WHEN 'obl' THEN 'OBL' WHEN 'ccomp' THEN 'COMP' WHEN 'xcomp' THEN 'COMP' WHEN 'sub' THEN 'SUBJ' WHEN 'comp' THEN 'COMP' END"
_CASE = "coalesce(nullif(upper(substring(regexp_extract(x.feats, '(?:^|\\|)Case=([^|]+)', 1), 1, 3)), ''), 'UNK')"
_FRAMES = f"""{TOK}, adp AS (SELECT sentence_id, head AS token_index, arg_min(lower(lemma), token_index) AS prep FROM tok WHERE (upos = 'ADP' OR deprel = 'case') AND lemma IS NOT NULL GROUP BY 1, 2),
 arg AS (SELECT x.sentence_id, x.document_id, x.head, x.token_index, x.deprel, {_ARG} AS kind, {_CASE} AS cs, v.lemma, a.prep FROM tok x JOIN tok v ON v.sentence_id = x.sentence_id AND v.token_index = x.head AND v.upos IN ('VERB', 'AUX') AND v.lemma IS NOT NULL
  LEFT JOIN adp a ON a.sentence_id = x.sentence_id AND a.token_index = x.token_index WHERE x.head > 0 AND {_ARG} IS NOT NULL),
 frame AS (SELECT sentence_id, document_id, head AS verb_index, lemma, concat_ws(' ', 'NOM', string_agg(CASE WHEN kind <> 'SUBJ' THEN CASE WHEN prep IS NOT NULL THEN prep || '+' || cs ELSE cs END END, ' ' ORDER BY kind, token_index)) AS pattern,
  string_agg(deprel, ' ' ORDER BY token_index) AS relations, count(*) AS n_args, CASE WHEN count(CASE WHEN kind = 'IOBJ' THEN 1 END) > 0 THEN 'ditransitive' WHEN count(CASE WHEN kind = 'OBJ' THEN 1 END) > 0 THEN 'transitive' WHEN count(CASE WHEN kind = 'SUBJ' THEN 1 END) > 0 THEN 'intransitive' ELSE 'impersonal' END AS class
  FROM arg GROUP BY 1, 2, 3, 4)"""


@query("valency_instances", f"WITH {_FRAMES} SELECT sentence_id, document_id, verb_index, lemma, pattern, relations, n_args, class FROM frame")
def valency_instances(spark, d):
    return valency.instances(base.tokens(spark, d)).drop("cases")


@query("valency_lexicon", f"WITH {_FRAMES} SELECT lemma, pattern, count(*) AS freq, count(DISTINCT sentence_id) AS sentences FROM frame GROUP BY 1, 2")
def valency_lexicon(spark, d):
    return valency.lexicon(valency.instances(base.tokens(spark, d)))


@query("valency_primary", f"WITH {_FRAMES}, q AS (SELECT lemma, pattern, count(*) AS freq FROM frame GROUP BY 1, 2) SELECT lemma, pattern, freq FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY freq DESC, pattern) AS k FROM q) WHERE k = 1")
def valency_primary(spark, d):
    return valency.primary(valency.lexicon(valency.instances(base.tokens(spark, d))))


@query("valency_classes_by_period", f"WITH {_FRAMES}, {DOC} SELECT d.language, d.period, f.class, count(*) AS n, round(avg(n_args), 6) AS mean_args FROM frame f JOIN doc d USING (document_id) GROUP BY 1, 2, 3")
def valency_classes_by_period(spark, d):
    f = valency.instances(base.tokens(spark, d)).join(base.documents(spark, d).select("document_id", "language", "period"), "document_id")
    return f.groupBy("language", "period", "class").agg(F.count("*").alias("n"), R(F.avg("n_args")).alias("mean_args"))


@query("valency_pattern_changes", f"""WITH {_FRAMES}, {DOC}, p AS (SELECT DISTINCT f.lemma, f.pattern, d.period FROM frame f JOIN doc d USING (document_id) WHERE d.period IN ('classical', 'modern')),
 a AS (SELECT lemma, list(pattern) AS l FROM p WHERE period = 'classical' GROUP BY 1), b AS (SELECT lemma, list(pattern) AS l FROM p WHERE period = 'modern' GROUP BY 1)
SELECT lemma, array_to_string(list_sort(list_filter(a.l, lambda x: NOT list_contains(b.l, x))), ', ') AS lost, array_to_string(list_sort(list_filter(b.l, lambda x: NOT list_contains(a.l, x))), ', ') AS gained, array_to_string(list_sort(list_filter(a.l, lambda x: list_contains(b.l, x))), ', ') AS kept FROM a JOIN b USING (lemma)""")
def valency_pattern_changes(spark, d):
    f = valency.instances(base.tokens(spark, d)).join(base.documents(spark, d).select("document_id", "period"), "document_id")
    return valency.pattern_changes(f, "period", "classical", "modern")


@query("case_distribution", f"WITH {TOK} SELECT {_CASE} AS \"case\", x.deprel, count(*) AS n FROM tok x WHERE x.upos IN ('NOUN', 'PROPN', 'PRON') GROUP BY 1, 2")
def case_distribution(spark, d):
    return base.tokens(spark, d).where("upos in ('NOUN', 'PROPN', 'PRON')").groupBy(valency.case_of(F.col("feats")).alias("case"), "deprel").agg(F.count("*").alias("n"))


@query("feature_values", f"WITH {TOK}, x AS (SELECT upos, unnest(string_split(feats, '|')) AS kv FROM tok WHERE feats IS NOT NULL AND feats NOT IN ('', '_')) SELECT upos, split_part(kv, '=', 1) AS feature, split_part(kv, '=', 2) AS value, count(*) AS n FROM x GROUP BY 1, 2, 3")
def feature_values(spark, d):
    t = base.tokens(spark, d).where("feats is not null and feats not in ('', '_')").select("upos", F.explode(F.split("feats", r"\|")).alias("kv"))
    return t.groupBy("upos", F.split_part("kv", F.lit("="), F.lit(1)).alias("feature"), F.split_part("kv", F.lit("="), F.lit(2)).alias("value")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------ trees


@query("tree_depth", f"""WITH RECURSIVE {TOK}, r(sentence_id, token_index, depth) AS (SELECT sentence_id, token_index, 0 FROM tok WHERE head = 0 UNION ALL SELECT t.sentence_id, t.token_index, r.depth + 1 FROM tok t JOIN r ON t.sentence_id = r.sentence_id AND t.head = r.token_index)
SELECT sentence_id, max(depth)::BIGINT AS depth, round(avg(depth), 6) AS mean_depth FROM (SELECT DISTINCT * FROM r) GROUP BY 1""")
def tree_depth(spark, d):
    return trees.depths(base.tokens(spark, d)).where("depth >= 0").groupBy("sentence_id").agg(F.max("depth").alias("depth"), R(F.avg("depth")).alias("mean_depth"))


@query("tree_crossings", f"""WITH {TOK}, e AS (SELECT sentence_id, least(token_index, head) AS a, greatest(token_index, head) AS b FROM tok WHERE head > 0), n AS (SELECT sentence_id, count(*) AS arcs FROM e GROUP BY 1),
 c AS (SELECT x.sentence_id, count(*) AS k FROM e x JOIN e y ON x.sentence_id = y.sentence_id AND x.a < y.a AND y.a < x.b AND x.b < y.b GROUP BY 1)
SELECT n.sentence_id, arcs, CAST(coalesce(k, 0) AS INTEGER) AS crossings FROM n LEFT JOIN c USING (sentence_id)""")
def tree_crossings(spark, d):
    return trees.crossing(base.tokens(spark, d))


@query("tree_problems", f"""WITH {TOK}, s AS (SELECT sentence_id, count(CASE WHEN head = 0 THEN 1 END) AS roots, count(*) AS n, count(DISTINCT token_index) AS d, max(token_index) AS most FROM tok GROUP BY 1),
 o AS (SELECT t.sentence_id, count(*) AS k FROM tok t JOIN s USING (sentence_id) WHERE t.head > s.most OR t.head < 0 GROUP BY 1)
SELECT sentence_id, 'no_root' AS rule, 1::BIGINT AS n FROM s WHERE roots = 0 UNION ALL SELECT sentence_id, 'several_roots', roots FROM s WHERE roots > 1 UNION ALL SELECT sentence_id, 'repeated_index', n - d FROM s WHERE n > d UNION ALL SELECT sentence_id, 'head_outside', k FROM o""")
def tree_problems(spark, d):
    return trees.problems(base.tokens(spark, d))


@query("arc_lengths", f"WITH {TOK} SELECT abs(head - token_index) AS length, count(*) AS arcs FROM tok WHERE head > 0 GROUP BY 1")
def arc_lengths(spark, d):
    return trees.arc_lengths(base.tokens(spark, d))


@query("subtree_sizes", """WITH RECURSIVE tok AS (SELECT DISTINCT * FROM tokens), r(sentence_id, t, a) AS (SELECT sentence_id, token_index, token_index FROM tok UNION SELECT r.sentence_id, r.t, k.head FROM r JOIN tok k ON k.sentence_id = r.sentence_id AND k.token_index = r.a WHERE k.head > 0)
SELECT t.sentence_id, t.token_index, count(*) AS size FROM tok t JOIN r ON r.sentence_id = t.sentence_id AND r.a = t.token_index GROUP BY 1, 2""")
def subtree_sizes(spark, d):
    return trees.subtree_sizes(base.tokens(spark, d))


@query("deprel_distribution", f"WITH {TOK} SELECT deprel, upos, count(*) AS n FROM tok GROUP BY 1, 2")
def deprel_distribution(spark, d):
    return base.tokens(spark, d).groupBy("deprel", "upos").agg(F.count("*").alias("n"))


@query("rule_lemma_accuracy", f"WITH {TOK} SELECT upos, count(*) AS n, count(CASE WHEN lower(form) = lemma THEN 1 END) AS identical FROM tok WHERE form IS NOT NULL AND lemma IS NOT NULL GROUP BY 1")
def rule_lemma_accuracy(spark, d):
    return base.tokens(spark, d).where("form is not null and lemma is not null").groupBy("upos").agg(F.count("*").alias("n"), F.count_if(F.lower("form") == F.col("lemma")).alias("identical"))


@query("conllu", f"""WITH {TOK} SELECT sentence_id, string_agg(concat_ws(chr(9), token_index, coalesce(nullif(form, ''), '_'), coalesce(nullif(lemma, ''), '_'), coalesce(nullif(upos, ''), '_'), '_', coalesce(nullif(feats, ''), '_'), coalesce(CAST(head AS VARCHAR), '_'), coalesce(nullif(deprel, ''), '_'), '_', '_'), chr(10) ORDER BY token_index) AS conllu FROM tok GROUP BY 1""")
def conllu(spark, d):
    from lexforge.sources import exporters

    return exporters.conllu(base.tokens(spark, d))

