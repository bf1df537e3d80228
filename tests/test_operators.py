import math
import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions import association as a
from lexforge.functions import html, normalise, text
from lexforge.operators import agreement, classify, cql, dedup, diachrony, entities, lexis, morphology, trees, upkeep, vectors

TOKENS = "token_id long, sentence_id long, document_id long, token_index long, form string, lemma string, upos string, head long, deprel string, feats string"


def tokens(spark, sentences):
    rows = []
    for s, words in enumerate(sentences, 1):
        for i, (form, upos) in enumerate(words, 1):
            rows.append((s * 1000 + i, s, 1 + s % 2, i, form, form and form.lower(), upos, 0 if i == 1 else 1, "root" if i == 1 else "dep", None))
    return spark.createDataFrame(rows, TOKENS)


def brute(query, sentences):
    """All matches by trying every length at every place."""
    steps, out = cql.parse(query), set()

    def holds(test, tok):
        ok = []
        for p in test.parts:
            if isinstance(p, cql.Junction):
                ok.append(holds(p, tok))
            else:
                v = {"form": tok[0], "lemma": tok[0] and tok[0].lower(), "upos": tok[1]}[cql.ATTRIBUTES[p.attribute]]
                hit = v is not None and (v.lower() == p.value.lower())
                ok.append(hit != p.negated)
        r = (any(ok) if test.any else all(ok)) if ok else True
        return r != test.negated

    def walk(s, i, k, n):
        if k == len(steps):
            if n:
                yield n
            return
        step = steps[k]
        for reps in range(step.least, (len(s) if step.most is None else step.most) + 1):
            if i + reps <= len(s) and all(holds(step.test, s[i + q]) for q in range(reps)):
                yield from walk(s, i + reps, k + 1, n + reps)

    for s, words in enumerate(sentences, 1):
        for i in range(len(words)):
            for n in walk(words, i, 0, 0):
                out.add((s, i + 1, n))
    return out


@pytest.mark.parametrize("query", ['[pos="A"] []{0,2} [pos="B"]', '"x" [pos!="B"]', '[word="x" | pos="B"]{2}', '[!(word="x") & pos="A"] "y"?', '[word="x"]+ within s', '[pos="A"]* "x" []*', '[word="x"]{2,} [pos="B"]?', '[]{0,25} "y"', '[pos="A" | pos="B"]{21}'])
def test_cql_against_brute_force(spark, query):
    g = random.Random(3)
    sentences = [[(g.choice(["x", "y", "X", None]), g.choice(["A", "B", None])) for _ in range(g.randint(1, 9))] for _ in range(40)] + [[("x", "A")] * 23]
    got = {(r["sentence_id"], r["start"], r["length"]) for r in cql.search(tokens(spark, sentences), query).collect()}
    assert got == brute(query, sentences)


@pytest.mark.parametrize("bad", ["", "[", '[pos=]', '[pos="A"]{3,1}', "[]{0,2}", '[a~"b"]'])
def test_cql_rejects(bad):
    with pytest.raises(cql.QueryError):
        cql.parse(bad)


def test_measures(spark):
    o, f1, f2, n = 12, 40, 55, 3000
    r = spark.range(1).select(*[f(F.lit(o), F.lit(f1), F.lit(f2), F.lit(n)).alias(k) for k, f in a.MEASURES.items()]).first()
    e = f1 * f2 / n
    assert math.isclose(r["mi"], math.log2(o / e)) and math.isclose(r["t"], (o - e) / math.sqrt(o)) and math.isclose(r["logdice"], 14 + math.log2(2 * o / (f1 + f2)))
    cells = [(o, e), (f1 - o, f1 * (n - f2) / n), (f2 - o, (n - f1) * f2 / n), (n - f1 - f2 + o, (n - f1) * (n - f2) / n)]
    assert math.isclose(r["g2"], 2 * sum(x * math.log(x / y) for x, y in cells if x))
    z = spark.range(1).select(a.log_dice(F.lit(0), F.lit(1), F.lit(1)).alias("a"), a.mutual_information(F.lit(0), F.lit(1), F.lit(1), F.lit(5)).alias("b")).first()
    assert z["a"] == 0 and z["b"] == 0


def test_windows_are_symmetric_and_bounded(spark):
    t = tokens(spark, [[(w, "A") for w in "abcde"], [("a", "A"), (None, "A"), ("b", "A")]])
    got = sorted((r["node"], r["collocate"], r["position"]) for r in lexis.windows(t, 2).collect())
    want = sorted((x, y, j - i) for s in (list("abcde"), ["a", None, "b"]) for i, x in enumerate(s) for j, y in enumerate(s) if i != j and abs(i - j) <= 2 and x and y)
    assert got == want


def test_depths_with_cycles_and_lost_heads(spark):
    rows = [(1, 1, 1, i, "w", "w", "X", h, "d", None) for i, h in ((1, 0), (2, 1), (3, 2), (4, 5), (5, 4), (6, 9), (7, 6), (8, 8))]
    got = {r["token_index"]: r["depth"] for r in trees.depths(spark.createDataFrame(rows, TOKENS)).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: -1, 5: -1, 6: -1, 7: -1, 8: -1}


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a")], "x string, y string")
    r = agreement.cohens_kappa(df, "x", "y").first()
    assert r["items"] == 4 and math.isclose(r["observed"], 0.75) and math.isclose(r["kappa"], (0.75 - 0.5) / 0.5)
    assert agreement.cohens_kappa(df.limit(0), "x", "y").count() == 0
    assert agreement.vote(spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "i int, v string"), "i", "v").collect()[0]["winner"] == "a"


def test_upkeep(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in upkeep.replace_into(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in upkeep.insert_missing(old, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert [r["id"] for r in upkeep.page(old, [F.col("id")], 2, 1).collect()] == [2]


def test_nearest_is_exact(spark):
    import numpy as np

    g = np.random.default_rng(1)
    m = g.normal(size=(300, 8)).round(3)
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>").repartition(5)
    got = {(r["query_id"], r["k"]): r["id"] for r in vectors.nearest(df.where("id % 50 = 0"), df, "id", "v", 4).collect()}
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        c = np.round(n @ n[q], 6)
        want = sorted(((-c[i], i) for i in range(300) if i != q))[:4]
        assert [got[(q, k)] for k in range(1, 5)] == [i for _, i in want]


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "g" if i % 2 else "h", float(i % 17)) for i in range(200)], "i int, g string, x double")
    one = sorted(tuple(r) for r in diachrony.bootstrap_mean(df.repartition(1), "x", "g", 50).collect())
    two = sorted(tuple(r) for r in diachrony.bootstrap_mean(df.repartition(7), "x", "g", 50).collect())
    assert [r[0] for r in one] == [r[0] for r in two] and all(abs(x - y) < 1e-9 for p, q in zip(one, two) for x, y in zip(p[1:4], q[1:4]))
    assert all(r[2] <= r[1] <= r[3] for r in one)


def test_naive_bayes_learns(spark):
    rows = [(i, "grain wheat corn " * 2 if i % 2 else "ship sea sail " * 2, "farm" if i % 2 else "navy") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    counts = classify.features(df, "id", "text", 2)
    model = classify.train_bayes(counts.where("id < 30"), df.where("id < 30"), "id", "label")
    guess = classify.predict_bayes(counts.where("id >= 30"), model, "id")
    j = guess.withColumnRenamed("label", "guess").join(df, "id")
    assert j.where("guess = label").count() == 10


def test_text_functions(spark):
    r = spark.createDataFrame([("<p>a &amp; <b>b</b></p><script>x</script>", "λόγοσ τοσ", None)], "h string, g string, n string").select(
        text.strip_markup(F.col("h")).alias("h"), text.final_sigma(F.col("g")).alias("g"), text.collapse(F.col("n")).alias("n"), text.escape_xml(F.lit('<a b="c">')).alias("x"), text.without_accents(F.col("g")).alias("w"),
        text.feature(F.lit("Case=Nom|Number=Sing"), "Number").alias("f"), html.title(F.col("h")).alias("t"),
    ).first()
    assert r["h"] == "a & b" and r["g"] == "λόγος τος" and r["n"] is None and r["x"] == "&lt;a b=&quot;c&quot;&gt;" and r["w"] == "λογοσ τοσ" and r["f"] == "Sing" and r["t"] == "Untitled"
    page = "<html><nav>menu one two</nav><p>" + "word " * 30 + "</p><p><a href='#'>" + "link " * 30 + "</a></p></html>"
    assert html.blocks(page) == ("word " * 30).strip()


def test_lemmas_and_stems_of_all_scripts(spark, tmp_path):
    from lexforge.plans import catalog

    rows = [("ΛΌΓΟΣ", "λόγος"), ("λογος", None), ("книги", "книга"), ("手稿", "手稿"), ("नदी", "नदी"), ("été", "été"), ("ete", None), ("walking", "walk"), ("neu", None), (None, "x")]
    kinds = "token_id long, sentence_id long, document_id long, token_index long, form string, lemma string, upos string, head long, deprel string, feats string"
    data = [(k, k, k % 3, 1, form, lemma, None, 0, None, None) for k, (form, lemma) in enumerate(rows)]
    spark.createDataFrame([*data, data[0]], kinds).write.parquet(f"{tmp_path}/tokens.parquet")
    lemmas = {r["lemma"]: r["n"] for r in catalog.queries()["lexicon_lemmas"](spark, str(tmp_path)).collect()}
    assert lemmas == {"λόγος": 2, "книга": 1, "手稿": 1, "नदी": 1, "été": 2, "walk": 1, "neu": 1}
    stems = {r["stem"]: (r["n"], r["forms"]) for r in catalog.queries()["stems"](spark, str(tmp_path)).collect()}
    assert stems["walk"] == (1, 1) and {"книги", "手稿", "नदी", "été", "ete"} <= set(stems) and sum(n for n, _ in stems.values()) == 9


@pytest.mark.parametrize("hot", [2000, 2])
def test_similar_sets_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT", hot)  # small groups are split as well
    g = random.Random(9)
    sets = []
    for k in range(60):
        base = sets[g.randrange(len(sets))][1] if sets and g.random() < 0.6 else [g.randrange(40) for _ in range(g.randint(1, 25))]
        sets.append((k, sorted({x if g.random() < 0.93 else g.randrange(400) for x in base})))
    df = spark.createDataFrame([*sets, (99, [])], "rep long, s array<long>").selectExpr("*", "1 as n", "2 as x")
    for t in (0.5, 0.8):
        want = {(i, j): len(set(a) & set(b)) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) >= t * len(set(a) | set(b)) - 1e-9}
        assert {(r["a"], r["b"]): r["same"] for r in dedup.similar(df, t).collect()} == want
    assert dedup.similar(df.limit(0), 0.8).count() == 0


def test_classes_of_near_duplicates(spark):
    w = [f"w{k}" for k in range(80)]
    near = [*w[:40], "other", *w[41:]]
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, "  ".join(w).upper()), (4, "too short"), (5, None), (6, ""), (7, " ".join(w[:40])), (8, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as rep", "'x' as h")
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in dedup.classes(df, "doc_id", "text").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0), 6: (6, 0), 7: (7, 0), 8: (4, 0)}
    assert dedup.classes(df.limit(0), "doc_id", "text").count() == 0


def test_shingles_of_a_long_text_take_linear_time(spark):
    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(60_000)),)], "t string")
    assert df.select(F.size(text.shingles(F.col("t"), 5))).first()[0] == 59_996


def test_entities_and_benchmarks(spark):
    t = spark.createDataFrame([(1, 1, "Homer", "PROPN"), (1, 2, "1901", "NUM"), (1, 3, "Athens", "NOUN"), (1, 4, None, "X"), (1, 5, "Zeno", "PROPN"), (1, 6, "sea", "NOUN")], "sentence_id long, token_index long, form string, upos string")
    g = spark.createDataFrame([("Athens", "LOC"), ("Homer", "PER"), ("Homer", "POET")], "form string, type string")
    got = {r["form"]: (r["type"], r["source"], r["confidence"]) for r in entities.recognise(t, g, {"DATE": "^[0-9]{4}$"}).collect()}
    assert got == {"Homer": ("PER", "gazetteer", 1.0), "1901": ("DATE", "pattern", 1.0), "Athens": ("LOC", "gazetteer", 1.0), "Zeno": ("PER", "tag", 0.7)}
    spans = spark.createDataFrame([(1, 0, 1, "PER", 0.9), (1, 0, 1, "PER", 0.5), (1, 2, 3, "LOC", 0.9), (1, 4, 5, "PER", 0.5), (1, 4, 5, "PER", 0.6)], "sentence_id long, start long, end long, label string, confidence double")
    assert [(r["start"], r["models"]) for r in entities.merge(spans).collect()] == [(0, 2)]
    runs = spark.createDataFrame([("a", 1.0, True, 0.8), ("a", 1.0, False, 0.1)], "model string, seconds double, ok boolean, confidence double")
    r = entities.benchmark(runs).first()
    assert (r["samples"], r["success_rate"], r["average_confidence"]) == (2, 0.5, 0.8) and math.isclose(r["score"], 0.35 + 0.15)


def test_roots(spark):
    roots = spark.createDataFrame([("bher",), ("gno",), ("xyz",), (None,)], "lemma string")
    got = {(r["root"], r["grade"]): r["form"] for r in morphology.grades(roots, "lemma").collect()}
    assert got[("bher", "o-grade")] == "bhor" and got[("gno", "zero-grade")] == "gn" and len(got) == 10
    cognates = spark.createDataFrame([("ph2ter", "father", "grc", "pater"), ("ph2ter", "father", "la", "pater2")], "root string, meaning string, language string, form string")
    loans = spark.createDataFrame([("taxi", "french")], "form string, source string")
    e = {r["lemma"]: r for r in morphology.etymology(spark.createDataFrame([("pater",), ("taxi",), ("none",)], "lemma string"), cognates, loans).collect()}
    assert e["pater"]["cognates"] == ["grc:pater", "la:pater2"] and e["taxi"]["loan_source"] == "french" and e["none"]["root"] is None
    forms = spark.createDataFrame([(1, "grc", "phero"), (1, "la", "fero"), (1, "sa", "bhara"), (2, "xx", "abc")], "set_id long, language string, form string")
    r = morphology.reconstruct(forms, {"grc": {"p": "b"}, "la": {"f": "b"}, "sa": {"a": "e"}}).collect()
    assert [(x["set_id"], x["confidence"]) for x in r] == [(1, 0.75)] and r[0]["form"].startswith("*b")


def test_normal_forms(spark):
    df = spark.createDataFrame([("[12] λόγοσ  ⟨καί⟩ 14 τέλος†", "grc"), ("ā “b” ’c’", "en"), ("ā ē", "la"), (None, "en"), ("", None)], "t string, lang string")
    assert [r[0] for r in df.select(normalise.full(F.col("t"))).collect()] == ["λόγος καί τέλος", "ā “b” ’c’", "ā ē", None, ""]
    assert [r[0] for r in df.select(normalise.by_language(F.col("t"), F.col("lang"))).collect()][1:] == ['ā "b" \'c\'', "a e", None, ""]
    q = spark.createDataFrame([("short",), (None,), ("The quick brown fox jumps over a lazy dog near " * 2 + "<b>",)], "t string").select(normalise.quality(F.col("t"))).collect()
    assert q[0][0] == 0 and q[1][0] == 0 and math.isclose(q[2][0], 0.7 * 0.6)
    s = spark.createDataFrame([("Cf. p. 12 here. Βλ. cod. A; end",)], "t string").select(normalise.split_by_tokens(F.col("t"), ".;", ("Cf", "p", "cod")).alias("p")).first()["p"]
    assert s == ["Cf. p. 12 here.", "Βλ.", "cod. A;", "end"]


def test_classifiers_are_evaluated(spark):
    g = random.Random(2)
    a, b = "river meadow winter harbour".split(), "council treaty oath magistrate".split()
    rows = [(k, " ".join(g.choice(a if k % 2 else b) for _ in range(6)), "ab"[k % 2]) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, label string").cache()
    folds = [r["accuracy"] for r in classify.cross_validated(df, "id", 3, kind="tree", pairs=True, most=0.95).collect()]
    assert len(folds) == 3 and min(folds) > 0.6
    r = classify.bootstrapped(df, "id", 3, kind="bayes").first()
    assert r["mean"] > 0.8 and r["significant"]
    model = classify.pipeline("forest").fit(df)
    assert {w for w, _ in classify.importances(model)} <= {*a, *b}
    v = classify.vectorised(spark.createDataFrame([(["river", "oath", "river", "x"],)], "w array<string>"), "w", ["oath", "river"]).first()["vector"]
    assert v.toArray().tolist() == [1.0, 2.0]
    registry = spark.createDataFrame([("m1", "pos", "grc", 0.8), ("m2", "pos", "grc", 0.9), ("m3", "pos", "la", 0.95)], "name string, task string, language string, accuracy double")
    assert classify.best_model(registry, "pos", "grc").first()["name"] == "m2"
    near = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "query_id long, vec_id long")
    labels = spark.createDataFrame([(10, "x"), (11, "y"), (12, "x")], "vec_id long, label string")
    assert classify.nearest_label(near, labels).first()["label"] == "x"


def test_stages_run_until_idle(spark):
    items = spark.createDataFrame([(k, "scraped", k % 3, k, "long enough" if k % 2 else "no") for k in range(7)], "id long, status string, priority int, created_at long, content string")
    long = F.length("content") > 5
    stages = [("scraped", 2, F.when(long, "parsed").otherwise("failed"), F.when(~long, "too short")), ("parsed", 5, F.lit("annotated"), F.lit(None).cast("string"))]
    first = {r["id"]: r["status"] for r in upkeep.until_idle(items, stages, turns=1).collect()}
    assert first[2] == "failed" and first[5] == "annotated" and sum(x == "scraped" for x in first.values()) == 5
    out = {r["id"]: (r["status"], r["error"]) for r in upkeep.until_idle(items, stages).collect()}
    assert all(v == (("annotated", None) if k % 2 else ("failed", "too short")) for k, v in out.items()) and len(out) == 7


def test_subtrees_with_cycles(spark):
    df = spark.createDataFrame([(1, i, h) for i, h in ((1, 2), (2, 3), (3, 2), (4, 1), (5, 0), (6, 5), (7, 99), (8, 8))], "sentence_id long, token_index long, head long")
    assert {r["token_index"]: r["size"] for r in trees.subtree_sizes(df).collect()} == {1: 2, 2: 4, 3: 4, 4: 1, 5: 2, 6: 1, 7: 1, 8: 1}
