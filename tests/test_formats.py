from pyspark.sql import functions as F

from lexforge.sources import exporters, readers
from lexforge.streaming import windows


def test_conllu_round_trip(spark, tmp_path):
    body = "# sent_id = s1\n# text = a b\n1\ta\ta\tDET\t_\tCase=Nom\t2\tdet\t_\t_\n1-2\tab\t_\t_\t_\t_\t_\t_\t_\t_\n2\tb\tb\tNOUN\t_\t_\t0\troot\t_\tX=Y\n2.1\tc\t_\t_\t_\t_\t_\t_\t_\t_\nbroken line\n\n# sent_id = s2\n1\tc\t_\t_\t_\t_\t0\troot\t_\t_\n"
    (tmp_path / "x.conllu").write_text(body)
    rows = sorted((r["sentence_id"], r["token_index"], r["form"], r["lemma"], r["head"], r["feats"]) for r in readers.conllu(spark, str(tmp_path)).collect())
    assert rows == [("s1", 1, "a", "a", 2, "Case=Nom"), ("s1", 2, "b", "b", 0, None), ("s2", 1, "c", None, 0, None)]
    t = readers.conllu(spark, str(tmp_path)).where("sentence_id = 's1'").select(F.lit(1).alias("sentence_id"), "token_index", "form", "lemma", "upos", "head", "deprel", "feats")
    text = exporters.conllu(t).first()["conllu"]
    assert text == "1\ta\ta\tDET\t_\tCase=Nom\t2\tdet\t_\t_\n2\tb\tb\tNOUN\t_\t_\t0\troot\t_\t_"


def test_xml_treebanks(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<proiel><source><sentence id="7"><token id="t1" form="logos" lemma="logos" part-of-speech="Nb" morphology="-s---mn--i" head-id="t2" relation="sub"/><token id="t2" form="en" lemma="eimi" postag="v3siia---" relation="pred"/><token id="t3"/></sentence></source></proiel>')
    rows = [tuple(r) for r in readers.proiel(spark, str(tmp_path / "p.xml")).select("sentence_id", "token_index", "form", "upos", "feats", "head").orderBy("token_index").collect()]
    assert rows == [("7", 1, "logos", "NOUN", "Case=Nom|Gender=Masc|Inflection=Infl|Number=Sing", 2), ("7", 2, "en", "VERB", "Mood=Ind|Number=Sing|Person=3|Tense=Imp|Voice=Act", 0)]
    (tmp_path / "a.xml").write_text('<treebank><sentence id="1"><word id="1" form="x" lemma="y" postag="n-s---mn-" head="0" relation="PRED"/></sentence></treebank>')
    r = readers.agdt(spark, str(tmp_path / "a.xml")).first()
    assert (r["upos"], r["feats"], r["deprel"]) == ("NOUN", "Case=Nom|Gender=Masc|Number=Sing", "pred")


def test_tags_round_trip(spark):
    tag = "3spia-----"
    df = spark.createDataFrame([(tag,)], "t string").select(readers.decode_tag(F.col("t"), readers.PROIEL_MORPH).alias("f"))
    assert df.select(readers.encode_tag(F.col("f"), readers.PROIEL_MORPH).alias("t")).first()["t"] == tag
    assert spark.createDataFrame([("----------",)], "t string").select(readers.decode_tag(F.col("t"), readers.PROIEL_MORPH).alias("f")).first()["f"] is None


def test_other_readers(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<TEI><title>T</title><author>A</author><text><body><p>" + "word " * 40 + "</p></body></text></TEI>")
    r = readers.tei(spark, str(tmp_path / "t.xml")).first()
    assert r["title"] == "T" and len(r["id"]) == 12 and r["text"].startswith("word word")
    (tmp_path / "c.csv").write_text("text,label\n\"a, b\",x\n,y\n")
    assert [tuple(r) for r in readers.labelled_csv(spark, str(tmp_path / "c.csv")).collect()] == [("a, b", "x")]
    (tmp_path / "i.json").write_text('{"items": [{"id": 1, "content": " two words ", "is_verse": "yes"}]}')
    r = readers.external_items(spark, str(tmp_path / "i.json")).first()
    assert r["content"] == "two words" and r["word_count"] == 2 and r["is_verse"] is True
    d = tmp_path / "dirs" / "epic"
    d.mkdir(parents=True)
    (d / "a.txt").write_text("sing")
    assert [tuple(r) for r in readers.labelled_directories(spark, str(tmp_path / "dirs")).collect()] == [("sing", "epic")]
    g = spark.createDataFrame([("x\n*** START OF THE PROJECT GUTENBERG EBOOK Y ***\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK Y ***\nz",)], "t string")
    assert g.select(readers.gutenberg_text(F.col("t")).alias("t")).first()["t"] == "body"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:{(7 * i) % 60:02d}:00", i % 5, "error" if i % 3 else "view", float(i)) for i in range(200)]
    e = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = sorted(tuple(r) for r in windows.tumbling(e).collect())
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(s, late="48 hours").writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("t").collect()) == batch
    q = windows.pipeline(s, lambda b: b.select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
