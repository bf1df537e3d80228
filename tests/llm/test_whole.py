"""Models that are fitted to the whole of a table, in one part and in several."""

import random
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lexforge.llm import boilerplate, langid


@pytest.fixture(scope="module")
def documents(spark, small):
    df = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").where("text is not null and lang is not null and length(text) < 4000")
    return df.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("language"))


def test_every_labelled_document_is_read_in_training(monkeypatch):
    texts = [f"The scribe number {k} crossed the meadow and recorded the winter of the year {k}." for k in range(400)]
    read, pool = set(), langid.pool
    monkeypatch.setattr(langid, "pool", lambda net, units, *a: read.update(units) or pool(net, units, *a))
    monkeypatch.setattr(langid, "STEPS", 6)
    langid.train([(t, "en") for t in texts] + [("La rivière traverse la vallée et le scribe la regarde longtemps.", "fr")], boilerplate.Weights())
    assert {t.encode() for t in texts} <= read


@pytest.mark.parametrize("parts", [1, 2, 500])
def test_main_rounds_read_every_slice_once(parts):
    slices = [k for low, high, *_, main in langid._rounds(parts) if main for k in range(low, high)]
    assert sorted(slices) == list(range(langid.SLICES))


def pages(n=600):
    g = random.Random(4)
    words = [a + b for a in ("river", "meadow", "scribe", "winter", "lantern", "harbour") for b in ("song", "field", "gate", "stone")]
    sentence = lambda: " ".join(g.choice(words) for _ in range(9)).capitalize() + "."
    menu = ["Home", "Search", "Related texts", "Log out", "Contact"]
    return [(k, "\n".join([*g.sample(menu, 3), *(sentence() for _ in range(4)), "Read next", "The " + g.choice(words), "A " + g.choice(words), "Privacy | Contact"]), f"https://www.oldscroll.example/{k}") for k in range(n)]


def test_weights_of_page_lines_come_from_all_pages(spark, monkeypatch):
    rows = pages()
    # pages above 50 KB teach too
    rows += [(1000 + k, "\n".join(["Home", f"Longpage notice {k % 2}", *([f"The long text {chr(97 + k) * 3} goes on and on over the hills."] * 1200)]), "https://www.oldscroll.example/") for k in range(12)]
    df = spark.createDataFrame(rows, "id long, content string, url string")
    want = boilerplate.fit((t, u) for _, t, u in rows)
    got = boilerplate.fit_all(boilerplate.restored(df, "id", "content", "url"))
    assert got.text.keys() == want.text.keys() and all(abs(got.text[x] - v) < 1e-6 for x, v in want.text.items()) and got.text["longpage"] < 0
    assert got.entry == pytest.approx(want.entry) and got.head == pytest.approx(want.head)
    # in several parts the lines that come again, heads and entries are still those of all pages
    monkeypatch.setattr(boilerplate, "PART", 200_000)
    cut = boilerplate.restored(df, "id", "content", "url")
    assert cut.rdd.getNumPartitions() > 3
    several = boilerplate.fit_all(cut)
    assert several.entry == pytest.approx(want.entry)
    for _, t, u in rows[:100]:
        assert boilerplate.page_lines(t, several, boilerplate.site_of(u)) == boilerplate.page_lines(t, want, boilerplate.site_of(u))
    assert boilerplate.fit_all(boilerplate.restored(df.limit(0), "id", "content", "url")).text == {}


def test_a_network_trained_in_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(boilerplate, "PART", 300_000)
    cut = langid.pages_of(documents.where("id % 4 > 0"), "id", "content", "language")
    assert cut.rdd.getNumPartitions() > 2
    net, w = langid.models(cut)
    held_out = documents.where("id % 4 = 0")
    found = langid.document_languages(held_out, "id", "content", "language", net, w).collect()
    right = [r["language"] == langid.code_of(r["label"]) for r in found if langid.code_of(r["label"])]
    assert len(right) > 100 and sum(right) / len(right) > 0.9  # some labels are wrong


def test_what_training_has_learned_is_not_read_again(spark, documents, monkeypatch):
    monkeypatch.setattr(boilerplate, "PART", 300_000)
    rows = [(-1, "Ein Satz ohne Kennung, der trotzdem gelesen wird.", None), (-2, "kurz", "de")]
    pages = langid.pages_of(documents.where("id % 4 > 0").unionByName(spark.createDataFrame(rows, documents.schema)), "id", "content", "language")
    read, net, w = langid.readings(pages)
    text = {r["k"]: r for r in pages.collect()}
    got = read.collect()
    assert sorted(r["k"] for r in got) == sorted(text)
    known, long = 0, 0
    for r in got:
        page = text[r["k"]]
        assert (r["z"] is None) == (page["by"] is None) and r["a"] == page["a"]
        if r["z"] is None:
            assert r["t"] == page["t"]
            continue
        found, learned, logs = langid._page(r["z"], r["size"], r["spans"], r["logs"])
        assert found == (langid.prose(page["t"], w, page["site"], boilerplate.kept_lines(page["t"])) or [(0, page["t"])])
        # only what the network gave to the label of the page
        assert len(logs) == learned.sum() and (logs[:, langid.LANGUAGES.index(page["by"])] > np.log(langid.LEARNED) - 1e-3).all()
        known, long = known + learned.sum(), long + len(langid._units(found))
    assert known > long / 3
    whole = {r["id"]: r["language"] for r in langid.document_languages(pages.withColumnsRenamed({"k": "id"}), "id", "t", "a", net, w, "site", ready=True).collect()}
    rest = {r["id"]: r["language"] for r in langid.document_languages(read.withColumnsRenamed({"k": "id"}), "id", "t", "a", net, w, "site", ready=True).collect()}
    assert whole.keys() == rest.keys() and sum(whole[k] == v for k, v in rest.items()) > 0.98 * len(rest)


def test_lines_are_folded_word_by_word():
    for line in ("Ὁ Λόγος\u00a0 ἦν  12 ½ ", "a´ ´b", "\tx\x1cy ", " Straße  \u3000№ 7", "", " "):
        plain = "".join(c for c in unicodedata.normalize("NFKD", line) if not unicodedata.combining(c)).casefold()
        assert boilerplate.fold(line) == regex.sub(r"\s+", " ", regex.sub(r"\p{N}+", "0", plain)).strip().replace("ς", "σ")


def test_words_and_gaps_come_from_all_texts(spark, small, monkeypatch):
    from lexforge.llm import segment, spaceless

    df = spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet").where("lang = 'zh' and text is not null and doc_id % 3 = 0").select("doc_id", "text").limit(60)
    # a text above 50 KB, and texts without ten signs in a row
    rows = [tuple(r) for r in df.collect()]
    rows += [(-1, "天犇地，玄黄宇宙。\n" * 4000)] + [(-2 - k, "龘龘乙，甲龘龘丙。丁龘龘，龘龘戊！") for k in range(5)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = spaceless.fit([t for _, t in rows])
    got = segment.learn(texts, "text")
    assert "龘龘" in got.costs and "犇" in got.costs
    assert got.costs == want.costs and got.weights == pytest.approx(want.weights, abs=1e-6) and got.bias == pytest.approx(want.bias)
    monkeypatch.setattr(spaceless, "PART", 3000)  # several parts, the same weights
    monkeypatch.setattr(spaceless, "ROUNDS", 12)
    few, many = spaceless.fit([t for _, t in rows]), segment.learn(texts, "text")
    assert many.costs == few.costs and many.weights == pytest.approx(few.weights, abs=1e-6) and many.bias == pytest.approx(few.bias)
    assert segment.learn(texts.limit(0), "text").costs == {} and segment.learn(spark.createDataFrame([("没有标点",), (None,)], "text string"), "text").weights == {}
