"""Queries over annotations that are derived from raw documents by rules, near-duplicates, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import annotate, dedup, diachrony, valency
from lexforge.plans import base, corpus
from lexforge.plans.catalog import query
from lexforge.runtime import table

_in = lambda words: ", ".join(f"'{w}'" for w in words)
_S = r"""m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
 f AS (SELECT doc_id, list_filter(list_transform(p, lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM m),
 sn AS (SELECT doc_id * 100000 + i - 1 AS sentence_id, doc_id AS document_id, i - 1 AS sentence_index, p[i] AS text FROM f, unnest(range(1, len(p) + 1)) AS u(i))"""
_T = (
    _S
    + r""", r AS (SELECT sentence_id, document_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM sn), k AS (SELECT sentence_id, document_id, i AS token_index, w[i] AS form FROM r, unnest(range(1, len(w) + 1)) AS u(i)),
 tk AS (SELECT *, lower(form) AS lemma, CASE WHEN NOT regexp_matches(form, '^[\p{L}\p{N}_]') THEN 'PUNCT' WHEN regexp_matches(form, '^[0-9]+$') THEN 'NUM' """
    + f"WHEN lower(form) IN ({_in(annotate.DET)}) THEN 'DET' WHEN lower(form) IN ({_in(annotate.ADP)}) THEN 'ADP' "
    + " ".join(f"WHEN regexp_matches(form, '(?i){t}') THEN '{n}'" for n, t in annotate.TAIL)
    + " ELSE 'NOUN' END AS upos FROM k)"
)
_P = (
    _T
    + """, q AS (SELECT *, coalesce(min(CASE WHEN upos = 'VERB' THEN token_index END) OVER w, 1) AS root, max(token_index) OVER w AS n, lag(upos) OVER (PARTITION BY sentence_id ORDER BY token_index) AS b FROM tk WINDOW w AS (PARTITION BY sentence_id)),
 pt AS (SELECT sentence_id, document_id, token_index, upos, lemma, CASE WHEN token_index = root THEN 0 WHEN upos IN ('DET', 'ADJ', 'ADP') AND token_index < n THEN token_index + 1 ELSE root END AS head, CASE WHEN token_index = root THEN 'root' WHEN upos = 'DET' THEN 'det' WHEN upos = 'ADJ' THEN 'amod'
  WHEN upos = 'ADP' THEN 'case' WHEN upos = 'PUNCT' THEN 'punct' WHEN upos = 'ADV' THEN 'advmod' WHEN upos = 'NUM' THEN 'nummod' WHEN upos = 'VERB' THEN 'conj' WHEN token_index < root THEN 'nsubj' WHEN b = 'ADP' THEN 'obl' ELSE 'obj' END AS deprel FROM q)"""
)


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("derived_sentences", f"WITH {_S} SELECT sentence_id, document_id, sentence_index, text FROM sn")
def derived_sentences(spark, d):
    return annotate.sentences(_docs(spark, d), "doc_id", "text")


@query("derived_tokens", f"WITH {_T} SELECT document_id, upos, count(*) AS n, sum(token_index)::BIGINT AS places, count(DISTINCT lemma) AS lemmas FROM tk GROUP BY 1, 2")
def derived_tokens(spark, d):
    t = annotate.tokens(annotate.sentences(_docs(spark, d), "doc_id", "text"))
    return t.groupBy("document_id", "upos").agg(F.count("*").alias("n"), F.sum("token_index").alias("places"), F.count_distinct("lemma").alias("lemmas"))


@query("derived_dependencies", f"WITH {_P} SELECT document_id, deprel, count(*) AS n, sum(head)::BIGINT AS heads FROM pt GROUP BY 1, 2")
def derived_dependencies(spark, d):
    t = annotate.annotate(_docs(spark, d), "doc_id", "text")
    return t.groupBy("document_id", "deprel").agg(F.count("*").alias("n"), F.sum("head").alias("heads"))


_W = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')"
_NEAR = f"""d AS (SELECT doc_id, md5({_W}) AS h, string_split({_W}, ' ') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT h, min(doc_id) AS rep, any_value(w) AS w FROM d GROUP BY 1),
 s AS (SELECT rep, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS x FROM c WHERE len(w) >= 5), n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS same FROM s a JOIN s b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2), l AS (SELECT a, b, same, same / (x.n + y.n - same) AS jaccard FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE same >= 0.8 * (x.n + y.n - same) - 1e-9)"""


@query("near_duplicate_links", f"WITH {_NEAR} SELECT a, b, same, round(jaccard, 6) AS jaccard FROM l")
def near_duplicate_links(spark, d):
    """The pairs of different texts whose shingles of five words reach 0.8, each text by its first copy."""
    return dedup.links(_docs(spark, d), "doc_id", "text").select("a", "b", F.col("same").cast("long").alias("same"), F.round("jaccard", 6).alias("jaccard"))


@query("near_duplicate_documents", f"""WITH RECURSIVE {_NEAR}, u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(x, y) AS (SELECT rep, rep FROM c UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y), k AS (SELECT x AS rep, min(y) AS class_id FROM r GROUP BY 1), m AS (SELECT a AS rep, count(*) AS links FROM u GROUP BY 1)
SELECT d.doc_id, k.class_id, coalesce(m.links, 0) AS links FROM d JOIN c USING (h) JOIN k ON k.rep = c.rep LEFT JOIN m ON m.rep = c.rep""")
def near_duplicate_documents(spark, d):
    """One row a document: the class of its near-duplicates by shingles of five words at 0.8, and its links to different texts."""
    return dedup.classes(_docs(spark, d), "doc_id", "text")


_TK = "concat_ws('|', x::DECIMAL(38, 6)::VARCHAR, b, 11)"


@query("two_sample_length", f"""WITH d AS (SELECT length(text)::DOUBLE AS x, lang FROM documents WHERE lang IN ('grc', 'en') AND text IS NOT NULL), x AS (SELECT x, count(CASE WHEN lang = 'grc' THEN 1 END) AS a, count(*) AS n FROM d GROUP BY 1), t AS (SELECT sum(a)::DOUBLE AS na, sum(n)::DOUBLE AS nn, sum(a * x) AS sa, sum(n * x) AS sn FROM x),
 s AS (SELECT abs(sa / na - (sn - sa) / (nn - na)) AS observed, na / nn AS share, nn, sn FROM t), k AS (SELECT x, n, b, observed, share, nn, sn FROM x, s, range(1, 101) AS r(b)),
 w AS (SELECT *, CASE WHEN n = 1 THEN ({corpus._U(0, _TK)} < share)::DOUBLE ELSE least(greatest(round(n * share + sqrt(n * share * (1 - share)) * {corpus._Z(_TK)}), 0.0), n::DOUBLE) END AS k FROM k),
 m AS (SELECT b, sum(k) AS k, sum(k * x) AS s, any_value(nn) AS nn, any_value(sn) AS sn, any_value(observed) AS observed FROM w GROUP BY 1)
SELECT round(any_value(observed), 6) AS observed, round(avg((abs(s / nullif(k, 0) - (sn - s) / nullif(nn - k, 0)) >= observed)::INT), 6) AS p, count(*) AS rounds FROM m""")
def two_sample_length(spark, d):
    x = table(spark, d, "documents").where("lang in ('grc', 'en')").select("doc_id", "lang", F.length("text").alias("n"))
    y = diachrony.two_sample(x, "n", "lang", "grc", "en", rounds=100)
    return y.select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"), "rounds")


@query("content_digests", "SELECT id, substring(md5(trim(regexp_replace(lower(content), '[ \\t\\n\\r]+', ' ', 'g'), ' ')), 1, 16) AS digest, length(content) AS chars FROM corpus_items WHERE content IS NOT NULL")
def content_digests(spark, d):
    c = F.trim(F.regexp_replace(F.lower("content"), r"[ \t\n\r]+", " "))
    return table(spark, d, "corpus_items").where("content is not null").select("id", F.substring(F.md5(c), 1, 16).alias("digest"), F.length("content").cast("long").alias("chars"))


@query("shingle_counts", f"WITH w AS (SELECT string_split({_W}, ' ') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS shingle FROM w WHERE len(w) >= 5) SELECT shingle, count(*) AS docs FROM s GROUP BY 1 HAVING count(*) >= 3")
def shingle_counts(spark, d):
    """Shingles of five words that three texts or more share, over the whole of all texts."""
    t = _docs(spark, d).where("text is not null").select(F.explode(tx.shingles(F.col("text"), 5)).alias("shingle"))
    return t.groupBy("shingle").agg(F.count("*").alias("docs")).where("docs >= 3")


@query("vector_clusters")
def vector_clusters(spark, d):
    """Sizes of k-means clusters of the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=5, seed=42, maxIter=20).fit(v).transform(v).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


_ORIGIN = "CASE " + " ".join(f"WHEN {' OR '.join(f'lemma LIKE {chr(39)}%{x}{chr(39)}' for x in v)} THEN '{k}'" for k, v in valency.BORROWED_SUFFIXES.items()) + " " + " ".join(f"WHEN {' OR '.join(f'lemma LIKE {chr(39)}{x}%{chr(39)}' for x in v)} THEN '{k}'" for k, v in valency.BORROWED_PREFIXES.items()) + " ELSE 'native' END"


@query("verb_origins", f"WITH {base.TOK} SELECT {_ORIGIN} AS origin, count(*) AS n, count(DISTINCT lemma) AS verbs FROM tok WHERE upos = 'VERB' AND lemma IS NOT NULL GROUP BY 1")
def verb_origins(spark, d):
    v = base.tokens(spark, d).where("upos = 'VERB' and lemma is not null").groupBy("lemma").agg(F.count("*").alias("n"))
    return v.groupBy(valency.origin(F.col("lemma")).alias("origin")).agg(F.sum("n").alias("n"), F.count("*").alias("verbs"))


@query("valency_change_types", f"""WITH {corpus._FRAMES}, {base.DOC}, p AS (SELECT DISTINCT f.lemma, f.pattern, d.period FROM frame f JOIN doc d USING (document_id) WHERE d.period IN ('classical', 'koine')),
 a AS (SELECT lemma, pattern FROM p WHERE period = 'classical'), b AS (SELECT lemma, pattern FROM p WHERE period = 'koine'), lost AS (SELECT * FROM a EXCEPT SELECT * FROM b), gained AS (SELECT * FROM b EXCEPT SELECT * FROM a)
SELECT lemma, lost.pattern AS old_pattern, gained.pattern AS new_pattern, CASE WHEN len(string_split(gained.pattern, ' ')) > len(string_split(lost.pattern, ' ')) THEN 'extension' WHEN len(string_split(gained.pattern, ' ')) < len(string_split(lost.pattern, ' ')) THEN 'reduction' ELSE 'alternation' END AS type FROM lost JOIN gained USING (lemma)""")
def valency_change_types(spark, d):
    f = valency.instances(base.tokens(spark, d)).join(base.documents(spark, d).select("document_id", "period"), "document_id")
    return valency.change_types(f, "period", "classical", "koine")


@query("lexicon_lemmas", f"""WITH {base.TOK}, lx AS (SELECT lower(form) AS f, min(lemma) AS l FROM tok WHERE form IS NOT NULL AND lemma IS NOT NULL GROUP BY 1), lp AS (SELECT replace(strip_accents(lower(form)), 'ς', 'σ') AS f, min(lemma) AS l FROM tok WHERE form IS NOT NULL AND lemma IS NOT NULL GROUP BY 1)
SELECT coalesce(lx.l, lp.l, lower(t.form)) AS lemma, count(*) AS n FROM tok t LEFT JOIN lx ON lx.f = lower(t.form) LEFT JOIN lp ON lp.f = replace(strip_accents(lower(t.form)), 'ς', 'σ') WHERE t.form IS NOT NULL GROUP BY 1""")
def lexicon_lemmas(spark, d):
    """Lemmas of all forms of all documents, in every script, from a lexicon of the whole table's annotations."""
    t = base.tokens(spark, d).where("form is not null")
    return annotate.lexicon_lemmas(t, t.where("lemma is not null").select("form", "lemma")).groupBy("lemma").agg(F.count("*").alias("n"))
