"""Queries over collected items, metadata, sentences and events: search, dashboards, upkeep, text functions, agreement, event time."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.operators import agreement, dedup, upkeep
from lexforge.plans import base
from lexforge.plans.base import DOC, META, SEN, TOK
from lexforge.plans.catalog import query
from lexforge.runtime import table
from lexforge.sources import exporters

R = lambda c, n=6: F.round(c, n)


def _items(spark, d):
    return table(spark, d, "corpus_items")


# ------------------------------------------------------------ search and paging


@query("search_documents", f"""WITH {META}, {SEN}, n AS (SELECT document_id, count(*) AS sentences FROM sen GROUP BY 1)
SELECT c.id, m.title, m.author, coalesce(n.sentences, 0) AS sentences FROM corpus_items c JOIN meta m ON m.item_id = c.id LEFT JOIN n ON n.document_id = c.id WHERE m.genre = 'epic' AND (c.content ILIKE '%river%' OR m.title ILIKE '%river%')""")
def search_documents(spark, d):
    n = base.sentences(spark, d).groupBy("document_id").agg(F.count("*").alias("sentences"))
    m = base.metadata(spark, d).where("genre = 'epic'").select(F.col("item_id").alias("id"), "title", "author")
    hit = F.coalesce(F.col("content").ilike("%river%"), F.lit(False)) | F.coalesce(F.col("title").ilike("%river%"), F.lit(False))
    j = _items(spark, d).select("id", "content").join(m, "id").where(hit).select("id", "title", "author")
    return j.join(n.withColumnRenamed("document_id", "id"), "id", "left").select("id", "title", "author", F.coalesce("sentences", F.lit(0)).alias("sentences"))


@query("search_snippets", """SELECT id, trim(substring(content, greatest(instr(lower(content), 'scribe') - 50, 1), 106), ' ') AS snippet FROM corpus_items WHERE instr(lower(content), 'scribe') > 0""")
def search_snippets(spark, d):
    at = F.expr("locate('scribe', lower(content))")
    return _items(spark, d).where(at > 0).select("id", F.expr("trim(substring(content, greatest(locate('scribe', lower(content)) - 50, 1), 106))").alias("snippet"))


@query("items_page", "SELECT id, priority, created_at FROM corpus_items WHERE status = 'scraped' ORDER BY priority DESC NULLS LAST, created_at ASC NULLS LAST, id LIMIT 20 OFFSET 20")
def items_page(spark, d):
    x = _items(spark, d).where("status = 'scraped'").select("id", "priority", "created_at")
    return upkeep.page(x, [F.col("priority").desc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("id")], 2, 20)


@query("items_needing_sentences", "SELECT id FROM corpus_items c WHERE content IS NOT NULL AND length(content) > 500 AND NOT EXISTS (SELECT 1 FROM sentences s WHERE s.document_id = c.id)")
def items_needing_sentences(spark, d):
    done = table(spark, d, "sentences").select(F.col("document_id").alias("id")).distinct()
    return _items(spark, d).where(F.length("content") > 500).select("id").join(done, "id", "left_anti")


@query("needs_attention", """SELECT id, CASE WHEN content IS NULL THEN 'no_content' WHEN language IS NULL OR trim(language) = '' THEN 'no_language' WHEN word_count < 20 THEN 'short' ELSE 'error' END AS reason FROM corpus_items
 WHERE content IS NULL OR language IS NULL OR trim(language) = '' OR word_count < 20 OR error_message IS NOT NULL""")
def needs_attention(spark, d):
    c = F.col
    bad_language = c("language").isNull() | (F.trim("language") == "")
    reason = F.when(c("content").isNull(), "no_content").when(bad_language, "no_language").when(c("word_count") < 20, "short").otherwise("error")
    return _items(spark, d).where(c("content").isNull() | bad_language | F.coalesce(c("word_count") < 20, F.lit(False)) | c("error_message").isNotNull()).select("id", reason.alias("reason"))


@query("lemma_lookup", f"WITH {TOK}, {SEN}, {DOC} SELECT t.token_id, s.text, d.title, d.period FROM tok t JOIN sen s USING (sentence_id) JOIN doc d ON d.document_id = t.document_id WHERE t.lemma = 'river'")
def lemma_lookup(spark, d):
    t = base.tokens(spark, d).where("lemma = 'river'").select("token_id", "sentence_id", "document_id")
    return t.join(base.sentences(spark, d).select("sentence_id", "text"), "sentence_id").join(base.documents(spark, d).select("document_id", "title", "period"), "document_id").select("token_id", "text", "title", "period")


# ------------------------------------------------------------ dashboards


@query("items_by_status", "SELECT source_type, status, count(*) AS n, coalesce(sum(word_count), 0)::BIGINT AS words, round(avg(word_count), 4) AS mean_words FROM corpus_items GROUP BY 1, 2")
def items_by_status(spark, d):
    return _items(spark, d).groupBy("source_type", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), R(F.avg("word_count"), 4).alias("mean_words"))


@query("status_by_language", """SELECT coalesce(lower(trim(language)), 'none') AS language, count(CASE WHEN status = 'discovered' THEN 1 END) AS discovered, count(CASE WHEN status = 'scraped' THEN 1 END) AS scraped, count(CASE WHEN status = 'parsed' THEN 1 END) AS parsed,
 count(CASE WHEN status = 'annotated' THEN 1 END) AS annotated, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM corpus_items GROUP BY 1""")
def status_by_language(spark, d):
    kinds = ("discovered", "scraped", "parsed", "annotated", "failed")
    return _items(spark, d).groupBy(F.coalesce(F.lower(F.trim("language")), F.lit("none")).alias("language")).agg(*[F.count_if(F.coalesce(F.col("status") == k, F.lit(False))).alias(k) for k in kinds])


@query("collection_progress", "SELECT count(*) AS total, count(CASE WHEN status IN ('parsed', 'annotated') THEN 1 END) AS done, round(100.0::DOUBLE * count(CASE WHEN status IN ('parsed', 'annotated') THEN 1 END) / greatest(count(*), 1), 4) AS percent, max(scraped_at) AS latest FROM corpus_items")
def collection_progress(spark, d):
    done = F.count_if(F.coalesce(F.col("status").isin("parsed", "annotated"), F.lit(False)))
    return _items(spark, d).agg(F.count("*").alias("total"), done.alias("done"), R(100.0 * done / F.greatest(F.count("*"), F.lit(1)), 4).alias("percent"), F.max("scraped_at").alias("latest"))


@query("growth_per_day", "SELECT CAST(created_at AS DATE) AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY CAST(created_at AS DATE)) AS BIGINT) AS total FROM corpus_items WHERE created_at IS NOT NULL GROUP BY 1")
def growth_per_day(spark, d):
    # one row a day is left before the running sum
    n = _items(spark, d).where("created_at is not null").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(W.orderBy("day")))


@query("top_authors", f"WITH {META} SELECT author, count(*) AS works, count(DISTINCT genre) AS genres FROM meta WHERE author IS NOT NULL AND trim(author) <> '' GROUP BY 1 ORDER BY works DESC, author LIMIT 25")
def top_authors(spark, d):
    m = base.metadata(spark, d).where("author is not null and trim(author) <> ''")
    return m.groupBy("author").agg(F.count("*").alias("works"), F.count_distinct("genre").alias("genres")).orderBy(F.desc("works"), "author").limit(25)


@query("metadata_completeness", f"""WITH {META}, x AS (SELECT item_id, (CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(author) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(translator) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(genre) <> '' THEN 1 ELSE 0 END
 + CASE WHEN trim(period) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(original_language) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(text_type) <> '' THEN 1 ELSE 0 END) AS filled FROM meta) SELECT filled, count(*) AS n, round(filled / 7, 6) AS completeness FROM x GROUP BY 1""")
def metadata_completeness(spark, d):
    filled = None
    for c in ("title", "author", "translator", "genre", "period", "original_language", "text_type"):
        one = F.coalesce((F.trim(c) != "").cast("int"), F.lit(0))
        filled = one if filled is None else filled + one
    return base.metadata(spark, d).select(filled.alias("filled")).groupBy("filled").agg(F.count("*").alias("n")).withColumn("completeness", R(F.col("filled") / 7))


@query("genre_period_matrix", f"WITH {META} SELECT genre, " + ", ".join(f"count(CASE WHEN period = '{p}' THEN 1 END) AS {p}" for p in base.PERIODS) + " FROM meta WHERE genre IS NOT NULL GROUP BY 1")
def genre_period_matrix(spark, d):
    return base.metadata(spark, d).where("genre is not null").groupBy("genre").pivot("period", list(base.PERIODS)).agg(F.count("genre")).na.fill(0)


@query("retranslations", f"WITH {META} SELECT original_language, count(*) AS n, count(CASE WHEN is_retranslation THEN 1 END) AS retranslations, min(translation_year) AS first_year, max(translation_year) AS last_year FROM meta GROUP BY 1")
def retranslations(spark, d):
    return base.metadata(spark, d).groupBy("original_language").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("is_retranslation"), F.lit(False))).alias("retranslations"), F.min("translation_year").alias("first_year"), F.max("translation_year").alias("last_year"))


@query("underrepresented_periods", f"""WITH {DOC}, n AS (SELECT language, period, count(*) AS n FROM doc WHERE period IS NOT NULL GROUP BY 1, 2)
SELECT language, period, n, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n, period) AS k FROM n) WHERE k <= 3""")
def underrepresented_periods(spark, d):
    n = base.documents(spark, d).where("period is not null").groupBy("language", "period").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("language").orderBy("n", "period"))).where("k <= 3")


@query("data_quality", """SELECT 'no_content' AS issue, count(CASE WHEN content IS NULL THEN 1 END) AS n FROM corpus_items UNION ALL SELECT 'no_language', count(CASE WHEN language IS NULL THEN 1 END) FROM corpus_items UNION ALL SELECT 'no_hash', count(CASE WHEN content_hash IS NULL THEN 1 END) FROM corpus_items
 UNION ALL SELECT 'late_scrape', count(CASE WHEN scraped_at < created_at THEN 1 END) FROM corpus_items UNION ALL SELECT 'wrong_hash', count(CASE WHEN md5(content) <> content_hash THEN 1 END) FROM corpus_items""")
def data_quality(spark, d):
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    c = F.col
    one = _items(spark, d).agg(n(c("content").isNull()).alias("no_content"), n(c("language").isNull()).alias("no_language"), n(c("content_hash").isNull()).alias("no_hash"), n(c("scraped_at") < c("created_at")).alias("late_scrape"), n(F.md5("content") != c("content_hash")).alias("wrong_hash"))
    return one.unpivot([], ["no_content", "no_language", "no_hash", "late_scrape", "wrong_hash"], "issue", "n")


# ------------------------------------------------------------ upkeep


@query("duplicate_items", "WITH f AS (SELECT content_hash, min(id) AS first FROM corpus_items WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT id, first AS duplicate_of FROM corpus_items JOIN f USING (content_hash) WHERE id <> first")
def duplicate_items(spark, d):
    return upkeep.duplicates(_items(spark, d).select("id", "content_hash"), "id", "content_hash")


@query("incremental_items", "SELECT id, content_hash FROM corpus_items WHERE content IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT id, content_hash FROM corpus_items WHERE status = 'annotated') s WHERE s.id = corpus_items.id AND s.content_hash = corpus_items.content_hash)")
def incremental_items(spark, d):
    items = _items(spark, d)
    return upkeep.unchanged_out(items.where("content is not null").select("id", "content_hash"), items.where("status = 'annotated'"), "id", "content_hash")


@query("upsert_replace", "SELECT id, status FROM corpus_items WHERE status <> 'queued' UNION ALL SELECT id, 'scraped' FROM corpus_items WHERE status = 'queued'")
def upsert_replace(spark, d):
    items = _items(spark, d).where("status is not null").select("id", "status")
    return upkeep.replace_into(items, items.where("status = 'queued'").withColumn("status", F.lit("scraped")), ["id"])


@query("additive_lemma_index", f"WITH {TOK} SELECT lemma, count(*) AS freq FROM tok WHERE lemma IS NOT NULL GROUP BY 1")
def additive_lemma_index(spark, d):
    t = base.tokens(spark, d).where("lemma is not null").select("lemma", F.lit(1).alias("freq"), (F.col("document_id") % 2).alias("half"))
    part = lambda h: t.where(F.col("half") == h).groupBy("lemma").agg(F.sum("freq").alias("freq"))
    return upkeep.add_up(part(0), part(1), ["lemma"], "freq")


@query("items_without_orphans", "SELECT sentence_id FROM sentences WHERE document_id NOT IN (SELECT id FROM corpus_items WHERE status = 'annotated' AND id IS NOT NULL)")
def items_without_orphans(spark, d):
    gone = _items(spark, d).where("status = 'annotated'").select(F.col("id").alias("document_id"))
    return table(spark, d, "sentences").join(gone, "document_id", "left_anti").select("sentence_id")


# ------------------------------------------------------------ text functions


@query("normalised_whitespace", "SELECT id, md5(trim(regexp_replace(content, '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS digest FROM corpus_items WHERE content IS NOT NULL")
def normalised_whitespace(spark, d):
    return _items(spark, d).where("content is not null").select("id", F.md5(F.trim(F.regexp_replace("content", r"[ \t\n\r]+", " "))).alias("digest"))


@query("script_shares", """SELECT doc_id, length(regexp_replace(text, '[^\\p{Greek}]', '', 'g')) AS greek, length(regexp_replace(text, '[^\\p{Cyrillic}]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) AS latin, length(regexp_replace(text, '[^\\p{Han}]', '', 'g')) AS han,
 length(regexp_replace(text, '[^\\p{Devanagari}]', '', 'g')) AS devanagari FROM documents WHERE text IS NOT NULL""")
def script_shares(spark, d):
    names = {"greek": "IsGreek", "cyrillic": "IsCyrillic", "latin": "IsLatin", "han": "IsHan", "devanagari": "IsDevanagari"}
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[F.length(F.regexp_replace("text", rf"[^\p{{{v}}}]", "")).cast("long").alias(k) for k, v in names.items()])


@query("word_frequency", """SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(replace(lower(text), 'ς', 'σ'), '[\\p{L}\\p{M}]+')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) >= 5""")
def word_frequency(spark, d):
    w = table(spark, d, "documents").where("text is not null").select(F.explode(F.regexp_extract_all(F.replace(F.lower("text"), F.lit("ς"), F.lit("σ")), F.lit(r"[\p{L}\p{M}]+"), 0)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")


@query("paragraphs", """WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n[ \\t]*\\n')) AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS paragraphs, max(length(p)) AS longest FROM p WHERE trim(p, ' ') <> '' GROUP BY 1""")
def paragraphs(spark, d):
    p = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", r"\n[ \t]*\n")).alias("p")).where("trim(p) <> ''")
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("p")).cast("long").alias("longest"))


@query("text_statistics", """WITH w AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(text, ' '), '[ \\n\\t]+', ' ', 'g'), ' ')) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS words, count(DISTINCT w) AS types, round(avg(length(w)), 6) AS mean_length, max(length(w)) AS longest FROM w WHERE w <> '' GROUP BY 1""")
def text_statistics(spark, d):
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.regexp_replace(F.trim("text"), r"[ \n\t]+", " "), " ")).alias("w")).where("w <> ''")
    per = w.groupBy("doc_id", "w").agg(F.count("*").alias("n"))  # combines on the map side before the second step
    return per.groupBy("doc_id").agg(F.sum("n").alias("words"), F.count("*").alias("types"), R(F.sum(F.col("n") * F.length("w")) / F.sum("n")).alias("mean_length"), F.max(F.length("w")).cast("long").alias("longest"))


@query("tei_documents", f"""WITH {META} SELECT c.id, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>' || e(coalesce(m.title, '')) || '</title><author>' || e(coalesce(m.author, '')) || '</author></titleStmt></fileDesc></teiHeader><text><body><p>' || e(c.content) || '</p></body></text></TEI>' AS tei
 FROM corpus_items c LEFT JOIN meta m ON m.item_id = c.id WHERE c.content IS NOT NULL""".replace("e(coalesce(m.title, ''))", "replace(replace(replace(replace(replace(coalesce(m.title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')")
.replace("e(coalesce(m.author, ''))", "replace(replace(replace(replace(replace(coalesce(m.author, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')").replace("e(c.content)", "replace(replace(replace(replace(replace(c.content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"))
def tei_documents(spark, d):
    m = base.metadata(spark, d).select(F.col("item_id").alias("id"), "title", "author")
    return exporters.tei(_items(spark, d).where("content is not null").select("id", "content").join(m, "id", "left"))


@query("training_rows", "SELECT id, content AS text, coalesce(language, '') AS language, coalesce(word_count, 0) AS word_count FROM corpus_items WHERE length(trim(coalesce(content, ''), ' ')) > 0")
def training_rows(spark, d):
    return exporters.training_rows(_items(spark, d))


@query("shingle_overlap_titles", f"""WITH {META}, t AS (SELECT lower(title) AS title, min(item_id) AS rep FROM meta WHERE title IS NOT NULL GROUP BY 1), p AS (SELECT rep, unnest(list_distinct(string_split(title, ' '))) AS w, len(list_distinct(string_split(title, ' '))) AS n FROM t)
SELECT a.rep AS item_a, b.rep AS item_b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard FROM p a JOIN p b ON a.w = b.w AND a.rep < b.rep GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5 - 1e-9""")
def shingle_overlap_titles(spark, d):
    """Pairs of different titles that share half of their words or more; each title by the first item that bears it."""
    t = base.metadata(spark, d).where("title is not null").groupBy(F.lower("title").alias("title")).agg(F.min("item_id").alias("rep"))
    sets = t.select("rep", F.transform(F.array_distinct(F.split("title", " ")), lambda x: F.xxhash64(x)).alias("s"))
    return dedup.similar(sets, 0.5).select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), R(F.col("jaccard")).alias("jaccard"))


# ------------------------------------------------------------ agreement

@query("kappa_pos", f"""WITH {TOK}, f AS (SELECT lemma, upos, count(*) AS n FROM tok WHERE lemma IS NOT NULL AND upos IS NOT NULL GROUP BY 1, 2), l AS (SELECT lemma, upos AS usual FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, upos) AS k FROM f) WHERE k = 1),
 x AS (SELECT t.upos AS a, l.usual AS b, count(*) AS n FROM tok t JOIN l USING (lemma) WHERE t.upos IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n) AS items, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM x), c AS (SELECT sum(na * 1.0::DOUBLE * nb) AS c FROM (SELECT a AS v, sum(n) AS na FROM x GROUP BY 1) JOIN (SELECT b AS v, sum(n) AS nb FROM x GROUP BY 1) USING (v))
SELECT items::BIGINT AS items, round(same / items, 6) AS observed, round(c / (items * 1.0::DOUBLE * items), 6) AS expected, round((same / items - c / (items * 1.0::DOUBLE * items)) / (1 - c / (items * 1.0::DOUBLE * items)), 6) AS kappa FROM t, c""")
def kappa_pos(spark, d):
    t = base.tokens(spark, d).where("lemma is not null and upos is not null").select("lemma", "upos")
    usual = agreement.vote(t, "lemma", "upos").select("lemma", F.col("winner").alias("usual"))
    k = agreement.cohens_kappa(t.join(usual, "lemma"), "upos", "usual")
    return k.select("items", *[R(F.col(c)).alias(c) for c in ("observed", "expected", "kappa")])


@query("fleiss_tags", f"""WITH {TOK}, c AS (SELECT lemma, upos, CAST(count(*) AS DOUBLE) AS n FROM tok WHERE lemma IS NOT NULL AND upos IS NOT NULL GROUP BY 1, 2), p AS (SELECT lemma, sum(n) AS r, sum(n * (n - 1)) AS s FROM c GROUP BY 1 HAVING sum(n) > 1), m AS (SELECT count(*) AS items, avg(s / (r * (r - 1))) AS p FROM p),
 u AS (SELECT upos, sum(n) AS n FROM c WHERE lemma IN (SELECT lemma FROM p) GROUP BY 1), e AS (SELECT sum(n * n) / pow(sum(n), 2) AS pe FROM u) SELECT items, round((p - pe) / (1 - pe), 6) AS kappa FROM m, e""")
def fleiss_tags(spark, d):
    return agreement.fleiss_kappa(base.tokens(spark, d).where("lemma is not null").select("lemma", "upos"), "lemma", "upos").withColumn("kappa", R(F.col("kappa")))


@query("majority_tag", f"""WITH {TOK}, f AS (SELECT lemma, upos, count(*) AS n FROM tok WHERE lemma IS NOT NULL AND upos IS NOT NULL GROUP BY 1, 2) SELECT lemma, upos AS winner, round(n / t, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, upos) AS k, sum(n) OVER (PARTITION BY lemma) AS t FROM f) WHERE k = 1""")
def majority_tag(spark, d):
    return agreement.vote(base.tokens(spark, d).where("lemma is not null"), "lemma", "upos").withColumn("share", R(F.col("share")))


@query("review_routing", "SELECT event_type, CASE WHEN value >= CASE event_type WHEN 'click' THEN 20.0 WHEN 'purchase' THEN 50.0 ELSE 90.0 END THEN 'accepted' ELSE 'review' END AS route, count(*) AS n FROM events GROUP BY 1, 2")
def review_routing(spark, d):
    e = agreement.route(table(spark, d, "events"), "event_type", "value", {"click": 20.0, "purchase": 50.0}, 90.0)
    return e.groupBy("event_type", "route").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ events


@query("metric_report", "SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def metric_report(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), R(F.min("value")).alias("least"), R(F.max("value")).alias("most"), R(F.avg("value")).alias("mean"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    from lexforge.streaming import windows

    return windows.tumbling(table(spark, d, "events")).withColumn("total", R(F.col("total"), 4))


@query("events_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, d):
    from lexforge.streaming import windows

    return windows.sessions(table(spark, d, "events"))


@query("error_bursts", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 5")
def error_bursts(spark, d):
    from lexforge.streaming import windows

    return windows.bursts(table(spark, d, "events"))


@query("threshold_alerts", "SELECT event_id, CASE WHEN value > 150 THEN 'high' ELSE 'medium' END AS severity FROM events WHERE value > 100")
def threshold_alerts(spark, d):
    from lexforge.streaming import windows

    return windows.alerts(table(spark, d, "events"), 100.0).select("event_id", "severity")


@query("degradation", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(CASE WHEN k <= 5 THEN value END), 6) AS recent, round(avg(CASE WHEN k > 5 THEN value END), 6) AS before FROM r WHERE n >= 10 GROUP BY 1""")
def degradation(spark, d):
    # the five latest of each partition first, so that a type with most of the rows never meets in one task
    e = table(spark, d, "events").select("event_type", "value", "ts", "event_id").withColumn("p", F.spark_partition_id())
    order = [F.desc("ts"), F.desc("event_id")]
    some = e.withColumn("k", F.row_number().over(W.partitionBy("event_type", "p").orderBy(*order))).where("k <= 5")
    last = some.withColumn("k", F.row_number().over(W.partitionBy("event_type").orderBy(*order))).where("k <= 5")
    recent = last.groupBy("event_type").agg(F.sum("value").alias("rs"), F.count("value").alias("rc"))
    whole = e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.count("value").alias("c")).where("n >= 10")
    j = whole.join(recent, "event_type")
    return j.select("event_type", R(F.col("rs") / F.col("rc")).alias("recent"), R((F.col("s") - F.col("rs")) / (F.col("c") - F.col("rc"))).alias("before"))


@query("nearest_vectors", """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, v.vec_id, round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings v ON v.vec_id <> q.query_id)
SELECT query_id, vec_id, cosine, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM s) WHERE k <= 5""")
def nearest_vectors(spark, d):
    """The five nearest of all vectors for each query vector, the queries being the rows whose id is divisible by 50."""
    from lexforge.operators import vectors

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@query("semantic_shift", """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS c FROM x GROUP BY 1, 2)
SELECT a.label AS group_a, b.label AS group_b, round(sqrt(sum(pow(a.c - b.c, 2))), 5) AS distance, round(sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 5) AS cosine FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def semantic_shift(spark, d):
    from lexforge.operators import diachrony

    return diachrony.semantic_shift(table(spark, d, "embeddings"), "embedding", "label").select("group_a", "group_b", R(F.col("distance"), 5).alias("distance"), R(F.col("cosine"), 5).alias("cosine"))


@query("revenue_by_nation", """SELECT n.n_name AS nation, r.r_name AS region, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def revenue_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = lines.join(t("orders").select("o_orderkey", "o_custkey"), lines.l_orderkey == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    by = j.groupBy("c_nationkey").agg(F.sum("n").alias("n_lines"), F.sum("v").alias("v"))
    g = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return by.join(g, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "n_lines", R(F.col("v"), 2).alias("revenue"))

