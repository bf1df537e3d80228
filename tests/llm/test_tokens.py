import os
import random

import numpy as np
import pytest

from lexforge.llm import bpe, budget, packing, splitting

if not os.path.exists(bpe.VOCABULARY):
    pytest.skip("no vocabulary here", allow_module_level=True)


@pytest.fixture(scope="module")
def coder():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Bpe.of(f.read())


def texts(n=60):
    g = random.Random(5)
    parts = ["The quiet river", " ", "\n\n", "ὁ λόγος", "数据 处理", "नदी गच्छति ।", "…", "1234567", "  x", "\t", "'s", "​", "é́", "😀"]
    return ["".join(g.choice(parts) for _ in range(g.randint(0, 40))) for _ in range(n)]


def test_counts_equal_the_encoder(coder):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for t in texts():
        assert coder.count(t) == len(enc.encode_ordinary(t)) == len(coder.starts(t))


def test_count_column(spark):
    df = spark.createDataFrame([(1, "a b", "n"), (2, None, "n"), (3, "", "n"), (1, "a b", "n")], "id int, text string, n_tokens string")
    got = [(r["id"], r["n_tokens"]) for r in bpe.with_token_counts(df, "text").collect()]
    assert got == [(1, 2), (2, None), (3, 0), (1, 2)]
    assert bpe.with_token_counts(df.limit(0), "text").count() == 0


def test_range_max():
    g = np.random.default_rng(2)
    v = g.integers(0, 4, 200)
    t = splitting.RangeMax(v)
    for _ in range(300):
        a, b = sorted(g.integers(0, 200, 2))
        b += 1
        best = v[a:b].max()
        assert t.query(a, b) == a + int(np.flatnonzero(v[a:b] == best)[-1])
        if b - a <= 24:
            assert splitting.RangeMax(v, 24).query(a, b) == t.query(a, b)


def test_pieces_cover_the_text(coder):
    g = random.Random(1)
    text = "".join(g.choice(["word ", "λόγος ", "河流。", "end.\n", "stop.\n\n", "x" * 30, "नदी "]) for _ in range(4000))
    out = splitting.pieces(text, coder, limit=300, overlap=20)
    assert out[0][0] == 0 and out[-1][1] == len(text) and len(out) > 3
    for (s, e, n), (s2, e2, _) in zip(out, out[1:]):
        assert n <= 300 and n == coder.count(text[s:e]) and s < s2 < e < e2
        assert 20 <= coder.count(text[s2:e]) <= 24  # the overlap, but for a token that begins inside a character
    assert splitting.pieces("short", coder)[0][:2] == (0, 5)
    run = splitting.pieces("x" * 20000, coder, limit=200, overlap=10)  # no boundary anywhere
    assert run[-1][1] == 20000 and all(n <= 200 for *_, n in run)


def test_split_prefers_paragraphs(coder):
    text = ("one two three four. " * 20 + "\n\n") * 10
    for s, e, _ in splitting.pieces(text, coder, limit=260, overlap=8)[:-1]:
        assert text[:e].endswith("\n\n")


def test_split_table(spark):
    df = spark.createDataFrame([(1, "a " * 6000), (2, "a " * 100), (3, None), (4, ""), (1, "a " * 6000)], "doc_id long, text string").selectExpr("*", "1 as piece_no", "'x' as n_tokens")
    rows = splitting.split(df, "doc_id", "text").collect()
    assert {r["doc_id"] for r in rows} == {1} and max(r["n_tokens"] for r in rows) <= 4096
    assert splitting.split(df.limit(0), "doc_id", "text").count() == 0


def test_sum_of_squares_is_tight():
    g = np.random.default_rng(3)
    sizes = np.sort(g.integers(1, 4097, 3000))[::-1]
    home = packing.sum_of_squares(sizes)
    load = np.bincount(home, weights=sizes)
    assert load.max() <= 4096 and len(load) <= 1.06 * sizes.sum() / 4096 + 60
    exact = packing.sum_of_squares(np.array([4096, 2048, 2048, 1]))
    assert len(set(exact)) == 3 and exact[1] == exact[2]


def test_every_placement_is_the_smallest_sum_of_squares():
    g = np.random.default_rng(6)
    capacity = 40
    sizes = g.integers(1, capacity + 1, 1500)
    home = packing.sum_of_squares(sizes, capacity)
    gap, open_at = {}, np.zeros(capacity + 1, dtype=np.int64)

    def after(old, new):
        n = open_at.copy()
        n[old] -= old < capacity or 0
        n[new] += new > 0
        return int((n[1:capacity] ** 2).sum())

    for s, c in zip(sizes.tolist(), home.tolist()):
        old = gap.get(c, capacity)
        every = {o: after(o, o - s) for o in {*gap.values(), capacity} if o >= s}
        assert every[old] == min(every.values())
        if old < capacity:
            open_at[old] -= 1
        gap[c] = old - s
        open_at[gap[c]] += gap[c] > 0


def test_pack_table(spark):
    rows = [(i, n) for i, n in enumerate([0, None, 4096, 4097, 9000, 100, 100, 3996, 1])]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n").collect()
    assert {r["doc_id"] for r in out} == set(range(9))
    used, parts = {}, {}
    for r in out:
        used[r["container"]] = used.get(r["container"], 0) + r["used"]
        parts.setdefault(r["doc_id"], []).append(r["used"])
    assert max(used.values()) <= 4096 and sum(used.values()) == sum(n or 0 for _, n in rows)
    assert len(parts[4]) == 3 and len(parts[3]) == 2 and len(parts[2]) == 1 and all(len(parts[k]) == 1 for k in (0, 1, 5, 6, 7, 8))
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n").count() == 0


def test_totals_are_exact(spark):
    df = spark.createDataFrame([(1, "a", "x", "d", "p", 5), (2, "a", "y", "d", "p", 7), (3, "b", "x", "e", "q", 11)], "id long, source string, language string, domain string, period string, n_tokens long")
    rows = {(r["source"], r["language"], r["domain"], r["period"]): (r["texts"], r["n_tokens"]) for r in budget.totals(df, "t").collect()}
    assert rows[("*",) * 4] == (3, 23) and rows[("a", "*", "*", "*")] == (2, 12) and rows[("*", "x", "*", "*")] == (2, 16) and rows[("a", "y", "d", "p")] == (1, 7)
