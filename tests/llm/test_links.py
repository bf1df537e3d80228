import random

import numpy as np
import pytest
import regex

from lexforge.llm import boilerplate, langid, leakage, names, segment


@pytest.mark.parametrize(
    ("variant", "family", "given"),
    [("Drindogonini, W. V.", "drindogonini", ["w", "v"]), ("DRINDOGONINI W.", "drindogonini", ["w"]), ("Dr. Zoë Vamemi", "vamemi", ["zoe"]), ("Plato", "plato", []), ("SMR Tibil", "tibil", ["smr"]), ("Soc. of MS Readers, Tibil", "tibil", ["soc", "ms", "readers"]), ("Academy of Grammar at New Town", "new town", ["academy", "grammar"])],
)
def test_reading(variant, family, given):
    r = names.read(variant)
    assert (r["family"], r["given"]) == (family, given)


@pytest.mark.parametrize("unknown", ["Unknown", "anon.", "N/A", "", "  ", "?!", "Anonymous"])
def test_stand_ins(unknown):
    assert names.read(unknown) is None


def test_within_one():
    g = random.Random(4)
    for _ in range(400):
        a = "".join(g.choice("abc") for _ in range(g.randint(0, 6)))
        b = "".join(g.choice("abc") for _ in range(g.randint(0, 6)))
        edits = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        assert names.within_one(a, b) == (b in edits)


def test_links(spark):
    people = {
        "W": ["William Vasiliki Drindogonini"] * 9 + ["Bill Drindogonini", "DRINDOGONINI W. V.", "Drindogonini, William", "William Drindgonini", "Drindogonini William", "Wlliam Drindogonini"],
        "Z": ["Zoë Drindogonini"] * 4 + ["Zoe Drindogonini", "Z. Drindogonini"],
        "S": ["Society of Manuscript Readers at Tibilot"] * 3 + ["SMR Tibilot", "Soc. of MS Readers (Tibilot)", "Tibilot Society of Manuscript Readers", "Society of anuscript Readers at Tibilot"],
        "C": ["Circle of Lexicographers at Tibilot"],
        "F": [f"William {x}" for x in ("Aaaaander", "Bbbbbonder", "Ccccconder", "Dddddonder", "Eeeeeonder")],
    }
    rows = [(x,) for v in people.values() for x in v] + [(None,), ("",), ("Unknown",), ("anon.",)]
    df = spark.createDataFrame(rows, "name string").selectExpr("*", "'c' as canonical", "1 as n").repartition(4)
    linked = names.link(df)
    got = {r["name"]: r["canonical"] for r in linked.collect()}
    for k in "WZSC":
        assert len({got[x] for x in people[k]}) == 1, k
    assert len(set(got.values())) == 4 + 5 and set(got) == {x for v in people.values() for x in v}
    pairs = {tuple(r) for r in names.pairs(linked).collect()}
    assert all(a < b and got[a] == got[b] for a, b in pairs) and len(pairs) == sum(len(set(v)) * (len(set(v)) - 1) // 2 for k, v in people.items() if k != "F")
    assert names.link(df.limit(0)).count() == 0


WORDS = [f"w{a}{b}" for a in "abcdefghijk" for b in "lmnopqrst"]


def letters(word):
    return "".join(chr(97 + (ord(c) * 7) % 26) for c in word) + word[1:]


def passage(g, n):
    return [letters(g.choice(WORDS)) for _ in range(n)]


def test_leaks_by_both_rules(spark):
    g = random.Random(8)
    items = [(i, passage(g, 60)) for i in range(6)]
    docs = []

    def doc(middle):
        docs.append((len(docs), " ".join(passage(g, 80) + middle + passage(g, 80))))

    def edited(w, share):
        out = []
        for k, x in enumerate(w):
            out.append("changedword" if k % share == share - 1 else x)
        return out

    want = set()
    for i, w in items:
        doc(w[10:25])
        want.add((len(docs) - 1, i))  # fifteen words
        doc(w[10:24])  # fourteen
        doc([x.upper() + "," for x in w[20:40]])
        want.add((len(docs) - 1, i))
        doc(edited(w, 7))
        want.add((len(docs) - 1, i))  # one in seven changed
        doc(edited(w, 4))  # one in four
        dropped = [x for k, x in enumerate(w) if k % 9 != 8]
        doc(dropped)
        want.add((len(docs) - 1, i))
        doc([y for k, x in enumerate(w[:20]) for y in ([x, "[p. 12]", "7"] if k % 6 == 0 else [x])])
        want.add((len(docs) - 1, i))
    d = spark.createDataFrame([*docs, (900, None), (901, ""), docs[0]], "doc_id long, text string").selectExpr("*", "5 as item_id")
    q = spark.createDataFrame([(i, ("Translate this passage: " if i % 2 else "") + " ".join(w)) for i, w in items] + [(90, "short one"), (91, None)], "item_id long, text string")
    got = {tuple(r) for r in leakage.leaks(d, q).collect()}
    assert got == want
    blocks = {tuple(r) for r in leakage.leaks(d, q, block_bytes=900).collect()}
    assert {k for k in want if k[1] % 2 == 0} <= blocks  # in blocks an instruction is only known where the block shows it
    assert leakage.leaks(d.limit(0), q).count() == 0 and leakage.leaks(d, q.limit(0)).count() == 0


def test_the_exact_rule_holds_on_every_diagonal():
    w = [f"word{c}" for c in "abcdefghijklmnopqrstuvwx"]
    index = leakage.Items([(1, " ".join(w))])
    ids = index.encode(" ".join([*w[:8], "added", *w[8:]]))
    assert [index.contains(ids, n, hits) for _, n, hits in index.candidates([ids])] == [True]


def test_edited_passages_of_signs_are_found_at_the_limit():
    g = random.Random(3)
    sign = lambda: chr(0x4E00 + g.randrange(3000))
    items = [[sign() for _ in range(60 if k % 2 else 187)] for k in range(24)]
    index = leakage.Items([(k, "".join(w)) for k, w in enumerate(items)])
    for k, w in enumerate(items):
        at = g.randrange(len(w) - 59)
        even = [x for n, x in enumerate(w[at : at + 60]) if n % 6 != 5]  # each sixth dropped
        lone = [y for n, x in enumerate(w[at : at + 60]) for y in ([x, sign()] if n % 6 == 2 else [x])]  # one added in each six
        many = [x for n, x in enumerate(w[at : at + 60]) if n % 4 != 3]  # each fourth dropped
        for middle, found in ((even, True), (lone, True), (many, False)):
            ids = index.encode("".join([sign() for _ in range(80)] + middle + [sign() for _ in range(80)]))
            assert any(n == k and index.contains(ids, n, hits) for _, n, hits in index.candidates([ids])) is found


def test_gradients():
    g = np.random.default_rng(1)
    net = langid.Network(classes=3, hidden=4, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    frames, labels = g.integers(0, 256, (5, 6, langid.FRAME)), g.integers(0, 3, 5)
    net._run_dtype = np.float64
    _, grads = net.loss_and_gradients(frames, labels)
    for k in ("W", "Uf", "Ub", "af", "Eb"):
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old = net.p[k][i]
        values = []
        for step in (1e-3, -1e-3):
            net.p[k][i] = old + step
            values.append(net.loss_and_gradients(frames, labels)[0])
        net.p[k][i] = old
        assert abs((values[0] - values[1]) / 2e-3 - grads[k][i]) < 2e-2 * max(1e-2, abs(grads[k][i])), k


def test_lookalikes_reach_the_network_restored():
    assert langid.HIDDEN == 20
    text = "The quiet rivеr rеaсhed thе meadow, and the sсribе recorded it in full.​"  # Cyrillic letters in Latin words
    assert "".join(s for _, s in langid.prose(text, boilerplate.Weights())) == "The quiet river reached the meadow, and the scribe recorded it in full."


def test_languages_on_held_out_text(spark, small):
    rows = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").where("text is not null and lang is not null and length(text) < 4000").select("text", "lang").limit(700).collect()
    cut = int(len(rows) * 0.75)
    net, w = langid.train([(r["text"], langid.code_of(r["lang"])) for r in rows[:cut] if langid.code_of(r["lang"])], boilerplate.Weights()), boilerplate.Weights()
    df = spark.createDataFrame([(k, r["text"], r["lang"]) for k, r in enumerate(rows[cut:])] + [(9000, None, None), (9001, "", None), (9002, " \n", None)], "id long, content string, lang string").selectExpr("*", "'z' as language", "1 as segment_no")
    out = langid.languages(df, "id", "content", net, w).collect()
    whole = {r["id"]: r for r in langid.document_languages(df, "id", "content", "lang", net, w).collect()}
    assert all(r["language"] in r["languages"] and 0 <= r["confidence"] <= 1 for r in whole.values()) and not {9000, 9001, 9002} & set(whole)
    # verses in a second language behind an introduction in the first
    en = next(r["text"] for r in rows[cut:] if r["lang"] == "en" and len(segment.sentences(r["text"])) > 4)
    grc = next(r["text"] for r in rows[cut:] if r["lang"] == "grc" and len(r["text"]) > 600)
    words = regex.findall(r"\p{L}+", grc)
    verses = "\n".join(" ".join(words[k : k + 6]) for k in range(0, 60, 6))
    mixed = spark.createDataFrame([(1, en + "\n" + verses, "en")], "id long, content string, lang string")
    assert langid.document_languages(mixed, "id", "content", "lang", net, w).first()["languages"] == ["en", "grc"]
    main = {}
    for r in out:
        if r["id"] not in main or r["share"] > main[r["id"]][1]:
            main[r["id"]] = (r["language"], r["share"])
        assert 0 <= r["confidence"] <= 1 and r["start_pos"] <= r["end_pos"]
    truth = {k: langid.code_of(r["lang"]) for k, r in enumerate(rows[cut:])}
    right = sum(main.get(k, ("", 0))[0] == v for k, v in truth.items() if v)
    assert right / sum(v is not None for v in truth.values()) > 0.9  # some labels are wrong
    assert not {9000, 9001, 9002} & set(main)


@pytest.mark.parametrize(("label", "code"), [("GRC", "grc"), ("Ancient Greek", "grc"), ("en-GB", "en"), ("zho", "zh"), ("und", None), (None, None), ("Latin", "la"), ("el-GR", "el"), ("", None)])
def test_labels(label, code):
    assert langid.code_of(label) == code
