"""Further queries: rule-based features, statistics of groups, roles and routing, exports, classification, star joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions import language as lg
from lexforge.operators import classify, lexis, trees
from lexforge.plans import base
from lexforge.plans.base import DOC, META, PERIODS, SEN, TOK
from lexforge.plans.catalog import query
from lexforge.runtime import table
from lexforge.sources import exporters

R = lambda c, n=6: F.round(c, n)
_in = lambda words: ", ".join(f"'{w}'" for w in words)
_E = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("language_by_script", """WITH n AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS l, length(regexp_replace(text, '[^\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]', '', 'g')) AS g, length(regexp_replace(text, '[^\\x{1F00}-\\x{1FFF}]', '', 'g')) AS p,
 length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) AS c, length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) AS z, length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN l = 0 THEN 'und' WHEN z > l / 2 THEN 'zh' WHEN s > l / 2 THEN 'sa' WHEN c > l / 2 THEN 'ru' WHEN g > l / 2 THEN CASE WHEN p * 10 > g THEN 'grc' ELSE 'el' END ELSE 'lat' END AS language FROM n""")
def language_by_script(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", lg.language_by_script(F.col("text")).alias("language"))


@query("discourse_markers", f"WITH {TOK} SELECT document_id, CASE " + " ".join(f"WHEN lower(form) IN ({_in(w)}) THEN '{k}'" for k, w in lg.MARKERS.items()) + f" END AS class, count(*) AS n FROM tok WHERE lower(form) IN ({_in(x for w in lg.MARKERS.values() for x in w)}) GROUP BY 1, 2")
def discourse_markers(spark, d):
    t = base.tokens(spark, d).select("document_id", lg.marker_class(F.col("form")).alias("class")).where("class is not null")
    return t.groupBy("document_id", "class").agg(F.count("*").alias("n"))


@query("temporal_expressions", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE regexp_matches(text, '{p}')" for k, p in lg.TEMPORAL.items()))
def temporal_expressions(spark, d):
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, p in lg.TEMPORAL.items()])
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(counts).alias("x")).where("x.n > 0").select("doc_id", "x.kind", "x.n")


@query("stems", f"WITH {TOK}, w AS (SELECT lower(form) AS w FROM tok WHERE form IS NOT NULL) SELECT CASE " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 3} THEN substring(w, 1, length(w) - {len(e)})" for e in lg.ENDINGS) + " ELSE w END AS stem, count(*) AS n, count(DISTINCT w) AS forms FROM w GROUP BY 1")
def stems(spark, d):
    """Stems of all forms in every script; forms without a known ending are their own stem."""
    t = base.tokens(spark, d).where("form is not null").groupBy(F.lower("form").alias("w")).agg(F.count("*").alias("n"))
    return t.groupBy(lg.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query("relations_mapped", f"WITH {TOK} SELECT coalesce(CASE deprel " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lg.UD_TO_PROIEL.items()) + " END, deprel) AS relation, count(*) AS n FROM tok WHERE deprel IS NOT NULL GROUP BY 1")
def relations_mapped(spark, d):
    t = base.tokens(spark, d).where("deprel is not null").groupBy("deprel").agg(F.count("*").alias("n"))
    return t.groupBy(F.coalesce(lg.lookup(lg.UD_TO_PROIEL, F.col("deprel")), F.col("deprel")).alias("relation")).agg(F.sum("n").alias("n"))


@query("semantic_roles", f"WITH {TOK} SELECT h.lemma AS verb, CASE x.deprel " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lg.ROLES.items()) + f" END AS role, count(*) AS n FROM tok x JOIN tok h ON h.sentence_id = x.sentence_id AND h.token_index = x.head AND h.upos = 'VERB' WHERE x.head > 0 AND x.deprel IN ({_in(lg.ROLES)}) AND h.lemma IS NOT NULL GROUP BY 1, 2")
def semantic_roles(spark, d):
    x = lexis.dependencies(base.tokens(spark, d)).where("head_upos = 'VERB' and head_lemma is not null").select(F.col("head_lemma").alias("verb"), lg.lookup(lg.ROLES, F.col("deprel")).alias("role")).where("role is not null")
    return x.groupBy("verb", "role").agg(F.count("*").alias("n"))


@query("period_of_translation", f"""WITH {META} SELECT CASE WHEN translation_year BETWEEN -800 AND -500 THEN 'archaic' WHEN translation_year BETWEEN -500 AND -323 THEN 'classical' WHEN translation_year BETWEEN -323 AND -31 THEN 'hellenistic' WHEN translation_year BETWEEN -31 AND 330 THEN 'koine'
 WHEN translation_year BETWEEN 330 AND 1453 THEN 'medieval' WHEN translation_year BETWEEN 1453 AND 1830 THEN 'early_modern' WHEN translation_year BETWEEN 1830 AND 2025 THEN 'modern' END AS period, count(*) AS n FROM meta GROUP BY 1""")
def period_of_translation(spark, d):
    return base.metadata(spark, d).groupBy(lg.period_of_year(F.col("translation_year")).alias("period")).agg(F.count("*").alias("n"))


@query("chi_square_fit", f"""WITH {DOC}, o AS (SELECT period, count(*) AS o FROM doc WHERE period IN ({_in(PERIODS)}) GROUP BY 1), t AS (SELECT sum(o) / count(*) AS e, count(*) AS k FROM o) SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, any_value(k) - 1 AS df FROM o, t""")
def chi_square_fit(spark, d):
    o = base.documents(spark, d).where(F.col("period").isin(*PERIODS)).groupBy("period").agg(F.count("*").alias("o"))
    t = o.agg((F.sum("o") / F.count("*")).alias("e"), F.count("*").alias("k"))
    return o.crossJoin(F.broadcast(t)).agg(R(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e"))).alias("chi2"), (F.first("k") - 1).alias("df"))


@query("language_contrast", f"""WITH {TOK}, {DOC}, f AS (SELECT d.language, t.deprel, count(*) AS n FROM tok t JOIN doc d USING (document_id) WHERE d.language IN ('grc', 'la', 'en', 'de') AND t.deprel IS NOT NULL GROUP BY 1, 2)
SELECT a.deprel, a.language AS one, b.language AS two, a.n AS freq1, b.n AS freq2, round(a.n / (b.n + 1.0::DOUBLE), 6) AS ratio, a.n - b.n AS difference FROM f a JOIN f b ON a.deprel = b.deprel AND a.language < b.language""")
def language_contrast(spark, d):
    docs = base.documents(spark, d).where("language in ('grc', 'la', 'en', 'de')").select("document_id", "language")
    f = base.tokens(spark, d).where("deprel is not null").groupBy("document_id", "deprel").agg(F.count("*").alias("n")).join(docs, "document_id").groupBy("language", "deprel").agg(F.sum("n").alias("n"))
    a, b = f.select("deprel", F.col("language").alias("one"), F.col("n").alias("freq1")), f.select("deprel", F.col("language").alias("two"), F.col("n").alias("freq2"))
    return a.join(b, "deprel").where("one < two").select("deprel", "one", "two", "freq1", "freq2", R(F.col("freq1") / (F.col("freq2") + 1.0)).alias("ratio"), (F.col("freq1") - F.col("freq2")).alias("difference"))


@query("adjacency", f"WITH {TOK} SELECT sentence_id, head, string_agg(CAST(token_index AS VARCHAR), ' ' ORDER BY token_index) AS children FROM tok WHERE head IS NOT NULL GROUP BY 1, 2")
def adjacency(spark, d):
    g = base.tokens(spark, d).where("head is not null").groupBy("sentence_id", "head").agg(F.sort_array(F.collect_list("token_index")).alias("c"))
    return g.select("sentence_id", "head", F.array_join(F.transform("c", lambda x: x.cast("string")), " ").alias("children"))


@query("parsing_quality", f"""WITH {TOK}, s AS (SELECT sentence_id, count(*) AS n, count(CASE WHEN head = 0 THEN 1 END) AS roots, count(CASE WHEN upos IS NULL OR upos = '' THEN 1 END) AS untagged FROM tok GROUP BY 1)
SELECT sentence_id, round(greatest(0, 1 - (untagged + CASE WHEN roots <> 1 THEN 1 ELSE 0 END) / n), 6) AS quality FROM s""")
def parsing_quality(spark, d):
    s = base.tokens(spark, d).groupBy("sentence_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("head") == 0, F.lit(False))).alias("roots"), F.count_if(F.col("upos").isNull() | (F.col("upos") == "")).alias("untagged"))
    return s.select("sentence_id", R(F.greatest(F.lit(0.0), 1 - (F.col("untagged") + (F.col("roots") != 1).cast("int")) / F.col("n"))).alias("quality"))


@query("treebank_comparison", f"""WITH {TOK}, {DOC}, s AS (SELECT t.sentence_id, any_value(d.language) AS language, count(*) AS n, avg(CASE WHEN head > 0 THEN abs(head - token_index) END) AS arc FROM tok t JOIN doc d USING (document_id) GROUP BY 1)
SELECT language, count(*) AS sentences, round(avg(n), 6) AS mean_length, round(avg(arc), 6) AS mean_arc FROM s GROUP BY 1""")
def treebank_comparison(spark, d):
    s = base.tokens(spark, d).groupBy("sentence_id", "document_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("head") > 0, F.abs(F.col("head") - F.col("token_index")))).alias("arc"))
    return s.join(base.documents(spark, d).select("document_id", "language"), "document_id").groupBy("language").agg(F.count("*").alias("sentences"), R(F.avg("n")).alias("mean_length"), R(F.avg("arc")).alias("mean_arc"))


@query("treebank_query", f"WITH {TOK} SELECT sentence_id, count(*) AS matches FROM tok WHERE regexp_matches(lower(form), '^(?:the|a)') AND upos = 'DET' GROUP BY 1")
def treebank_query(spark, d):
    return base.tokens(spark, d).where(F.lower("form").rlike("^(?:the|a)") & (F.col("upos") == "DET")).groupBy("sentence_id").agg(F.count("*").alias("matches"))


@query("deepest_sentences", f"""WITH RECURSIVE {TOK}, r(sentence_id, token_index, depth) AS (SELECT sentence_id, token_index, 0 FROM tok WHERE head = 0 UNION ALL SELECT t.sentence_id, t.token_index, r.depth + 1 FROM tok t JOIN r ON t.sentence_id = r.sentence_id AND t.head = r.token_index)
SELECT depth::BIGINT AS depth, count(*) AS tokens FROM (SELECT DISTINCT * FROM r) GROUP BY 1""")
def deepest_sentences(spark, d):
    return trees.depths(base.tokens(spark, d)).where("depth >= 0").groupBy("depth").agg(F.count("*").alias("tokens"))


@query("kwic_sorted", f"""WITH {TOK}, x AS (SELECT sentence_id, token_index, form, upos, lag(form) OVER w AS l, lead(form) OVER w AS r FROM tok WINDOW w AS (PARTITION BY sentence_id ORDER BY token_index)) SELECT sentence_id, token_index, form, l AS left_word, r AS right_word FROM x WHERE upos = 'ADJ' ORDER BY lower(r) NULLS LAST, lower(l) NULLS LAST, sentence_id, token_index LIMIT 100""")
def kwic_sorted(spark, d):
    w = W.partitionBy("sentence_id").orderBy("token_index")
    x = base.tokens(spark, d).select("sentence_id", "token_index", "form", "upos", F.lag("form").over(w).alias("left_word"), F.lead("form").over(w).alias("right_word")).where("upos = 'ADJ'").drop("upos")
    return x.orderBy(F.lower("right_word").asc_nulls_last(), F.lower("left_word").asc_nulls_last(), "sentence_id", "token_index").limit(100)


@query("previous_preposition", f"""WITH {TOK}, x AS (SELECT form, upos, lag(lower(form)) OVER w AS p, lag(upos) OVER w AS pu FROM tok WINDOW w AS (PARTITION BY sentence_id ORDER BY token_index)) SELECT p AS preposition, count(*) AS n FROM x WHERE upos IN ('NOUN', 'DET') AND pu = 'ADP' AND p IS NOT NULL GROUP BY 1""")
def previous_preposition(spark, d):
    w = W.partitionBy("sentence_id").orderBy("token_index")
    x = base.tokens(spark, d).select("upos", F.lag(F.lower("form")).over(w).alias("preposition"), F.lag("upos").over(w).alias("pu")).where("upos in ('NOUN', 'DET') and pu = 'ADP' and preposition is not null")
    return x.groupBy("preposition").agg(F.count("*").alias("n"))


@query("character_trigrams", "WITH t AS (SELECT regexp_extract_all(replace(lower(text), 'ς', 'σ'), '(?s).') AS c FROM documents WHERE length(text) >= 3), g AS (SELECT unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM t) SELECT g AS gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 3")
def character_trigrams(spark, d):
    t = table(spark, d, "documents").where(F.length("text") >= 3).select(F.split(F.replace(F.lower("text"), F.lit("ς"), F.lit("σ")), "").alias("c"))
    # runs of three by position: each text is cut into its characters once
    g = t.select(F.explode(F.arrays_zip(F.col("c").alias("a"), F.slice("c", 2, F.size("c")).alias("b"), F.slice("c", 3, F.size("c")).alias("e"))).alias("x")).where("x.e is not null")
    return g.groupBy(F.concat("x.a", "x.b", "x.e").alias("gram")).agg(F.count("*").alias("n")).where("n >= 3")


@query("sentence_token_counts", f"WITH {SEN}, {TOK}, n AS (SELECT sentence_id, count(*) AS n FROM tok GROUP BY 1) SELECT s.sentence_id, s.token_count AS stored, coalesce(n.n, 0) AS counted FROM sen s LEFT JOIN n USING (sentence_id) WHERE s.token_count IS NULL OR s.token_count <> coalesce(n.n, 0)")
def sentence_token_counts(spark, d):
    n = base.tokens(spark, d).groupBy("sentence_id").agg(F.count("*").alias("n"))
    j = base.sentences(spark, d).join(n, "sentence_id", "left").select("sentence_id", F.col("token_count").alias("stored"), F.coalesce("n", F.lit(0)).alias("counted"))
    return j.where("stored is null or stored <> counted")


@query("quality_filter", """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(w) AS x FROM w), f AS (SELECT doc_id, x, count(*) AS n FROM u GROUP BY 1, 2),
 q AS (SELECT doc_id, sum(n) AS words, max(n) AS most, sum(n * length(x)) AS chars FROM f GROUP BY 1) SELECT doc_id, words::BIGINT AS words, round(most / words, 6) AS top_share, round(chars / words, 6) AS mean_length, words >= 20 AND most <= 0.3::DOUBLE * words AND chars / words BETWEEN 2 AND 15 AS passes FROM q""")
def quality_filter(spark, d):
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " ")).alias("x")).where("x <> ''")
    f = w.groupBy("doc_id", "x").agg(F.count("*").alias("n"))
    q = f.groupBy("doc_id").agg(F.sum("n").alias("words"), F.max("n").alias("most"), F.sum(F.col("n") * F.length("x")).alias("chars"))
    ok = (F.col("words") >= 20) & (F.col("most") <= 0.3 * F.col("words")) & (F.col("chars") / F.col("words")).between(2, 15)
    return q.select("doc_id", "words", R(F.col("most") / F.col("words")).alias("top_share"), R(F.col("chars") / F.col("words")).alias("mean_length"), ok.alias("passes"))


@query("proiel_sentences", f"""WITH {TOK} SELECT sentence_id, '<sentence id="' || sentence_id || '">' || string_agg('<token id="' || token_index || '" form="' || {_E.format("coalesce(form, '')")} || '" lemma="' || {_E.format("coalesce(lemma, '')")} || '" part-of-speech="' || {_E.format("coalesce(upos, '')")} || '"'
 || CASE WHEN head > 0 THEN ' head-id="' || head || '"' ELSE '' END || ' relation="' || {_E.format("coalesce(deprel, '')")} || '"/>', '' ORDER BY token_index) || '</sentence>' AS xml FROM tok GROUP BY 1""")
def proiel_sentences(spark, d):
    return exporters.proiel(base.tokens(spark, d))


@query("corpus_export", f"""WITH {META} SELECT c.id, coalesce(m.title, '') AS title, coalesce(m.author, '') AS author, coalesce(c.language, '') AS language, coalesce(m.genre, '') AS genre, coalesce(m.period, '') AS period, coalesce(m.translation_year, 0) AS translation_year, coalesce(c.word_count, 0) AS word_count FROM corpus_items c LEFT JOIN meta m ON m.item_id = c.id WHERE c.content IS NOT NULL""")
def corpus_export(spark, d):
    c = table(spark, d, "corpus_items").where("content is not null").select("id", "language", "word_count")
    m = base.metadata(spark, d).select(F.col("item_id").alias("id"), "title", "author", "genre", "period", "translation_year")
    return c.join(m, "id", "left").select("id", "title", "author", "language", "genre", "period", "translation_year", "word_count").na.fill("").na.fill(0)


@query("markdown_notes", f"""WITH {META} SELECT c.id, '---' || chr(10) || 'title: ' || coalesce(m.title, '') || chr(10) || 'author: ' || coalesce(m.author, '') || chr(10) || 'language: ' || coalesce(c.language, '') || chr(10) || 'period: ' || coalesce(m.period, '') || chr(10) || '---' || chr(10) || chr(10) || coalesce(c.content, '') AS note FROM corpus_items c LEFT JOIN meta m ON m.item_id = c.id""")
def markdown_notes(spark, d):
    m = base.metadata(spark, d).select(F.col("item_id").alias("id"), "title", "author", "period")
    return exporters.markdown(table(spark, d, "corpus_items").select("id", "language", "content").join(m, "id", "left"))


_NB = """c AS (SELECT doc_id, w AS feature, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ' '), lambda x: x <> '')) AS w FROM documents WHERE title IS NOT NULL) GROUP BY 1, 2),
 l AS (SELECT doc_id, lang AS label FROM documents WHERE lang IS NOT NULL), tr AS (SELECT * FROM l WHERE doc_id % 4 <> 0), per AS (SELECT label, feature, sum(n) AS n FROM c JOIN tr USING (doc_id) GROUP BY 1, 2), v AS (SELECT count(DISTINCT feature) AS v FROM per), t AS (SELECT label, sum(n) AS t FROM per GROUP BY 1),
 p AS (SELECT t.label, ln(d.d * 1.0::DOUBLE / (SELECT count(*) FROM tr)) AS prior, ln(t.t + v.v) AS z FROM t JOIN (SELECT label, count(*) AS d FROM tr GROUP BY 1) d USING (label), v),
 x AS (SELECT c.* FROM c WHERE doc_id % 4 = 0 AND feature IN (SELECT feature FROM per)), s AS (SELECT x.doc_id, p.label, any_value(p.prior) + sum(x.n * (ln(coalesce(per.n, 0) + 1.0::DOUBLE) - p.z)) AS score FROM x CROSS JOIN p LEFT JOIN per ON per.label = p.label AND per.feature = x.feature GROUP BY 1, 2),
 g AS (SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) AS k FROM s) WHERE k = 1)"""


@query("naive_bayes_confusion", f"WITH {_NB} SELECT l.label AS truth, g.label AS guess, count(*) AS n FROM g JOIN l USING (doc_id) GROUP BY 1, 2")
def naive_bayes_confusion(spark, d):
    """Languages of documents by the words of their titles: every fourth document is held out."""
    docs = table(spark, d, "documents").select("doc_id", "title", "lang")
    counts = classify.features(docs.where("title is not null"), "doc_id", "title")
    model = classify.train_bayes(counts.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 <> 0"), "doc_id", "lang")
    guess = classify.predict_bayes(counts.where("doc_id % 4 = 0"), model, "doc_id").select("doc_id", F.col("label").alias("guess"))
    return classify.confusion(guess.join(docs.where("lang is not null").select("doc_id", F.col("lang").alias("truth")), "doc_id"), "truth", "guess")


@query("event_history", "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS delta FROM events WHERE value IS NOT NULL GROUP BY 1")
def event_history(spark, d):
    order = F.struct("ts", "event_id")
    e = table(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"))
    return e.withColumn("delta", R(F.col("last_value") - F.col("first_value")))


@query("events_sliding", """SELECT s AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events, unnest(range(0, 4)) AS u(k), LATERAL (SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS s) GROUP BY 1, 2""")
def events_sliding(spark, d):
    from lexforge.streaming import windows

    return windows.sliding(table(spark, d, "events")).withColumn("mean", R(F.col("mean")))


@query("retention", "SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '7 days' GROUP BY 1")
def retention(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("properties", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def properties(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("collector_attempts", "SELECT json_extract_string(metadata_json, '$.collector') AS collector, count(*) AS n, round(avg(CAST(json_extract_string(metadata_json, '$.attempt') AS DOUBLE)), 6) AS mean_attempt FROM corpus_items WHERE metadata_json IS NOT NULL GROUP BY 1")
def collector_attempts(spark, d):
    j = table(spark, d, "corpus_items").where("metadata_json is not null").select(F.from_json("metadata_json", "collector string, attempt double").alias("m"))
    return j.groupBy("m.collector").agg(F.count("*").alias("n"), R(F.avg("m.attempt")).alias("mean_attempt"))


@query("hosts", "SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS n, count(DISTINCT content_hash) AS texts FROM corpus_items WHERE url IS NOT NULL GROUP BY 1")
def hosts(spark, d):
    i = table(spark, d, "corpus_items").where("url is not null").select(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"), "content_hash")
    n = i.groupBy("host", "content_hash").agg(F.count("*").alias("n"))  # a hot host is counted in parts
    return n.groupBy("host").agg(F.sum("n").alias("n"), F.count("content_hash").alias("texts"))


@query("sources_of_documents", "SELECT s.domain, coalesce(s.licence, 'none') AS licence, count(*) AS n, sum(d.n_chars)::BIGINT AS chars FROM documents d LEFT JOIN sources s ON s.source = d.source GROUP BY 1, 2")
def sources_of_documents(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return n.join(table(spark, d, "sources"), "source", "left").groupBy("domain", F.coalesce("licence", F.lit("none")).alias("licence")).agg(F.sum("n").alias("n"), F.sum("c").alias("chars"))


@query("repeated_documents", "WITH h AS (SELECT md5(text) AS h, min(doc_id) AS first, count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT d.doc_id, h.first AS class_id, h.n, h.sources FROM documents d JOIN h ON md5(d.text) = h.h")
def repeated_documents(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.md5("text").alias("h"))
    h = x.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"), F.count_distinct("source").alias("sources")).where("n > 1")
    return x.join(h, "h").select("doc_id", "class_id", "n", "sources")


@query("orders_star", "SELECT o_orderpriority AS priority, c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def orders_star(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    j = o.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment")).agg(F.sum("n").alias("n"), R(F.sum("t"), 2).alias("total"), F.sum("f").alias("filled"))


@query("part_top_by_brand", "SELECT brand, part, quantity, CAST(k AS INTEGER) AS k FROM (SELECT p_brand AS brand, p_partkey AS part, sum(l_quantity) AS quantity, row_number() OVER (PARTITION BY p_brand ORDER BY sum(l_quantity) DESC, p_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE k <= 3")
def part_top_by_brand(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity")).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    q = q.withColumn("k", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("quantity"), "p_partkey"))).where("k <= 3")
    return q.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), "quantity", "k")
