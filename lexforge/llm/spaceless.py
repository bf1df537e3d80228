"""Words and sentence gaps of scripts without spaces, learned from the corpus itself.

Words are the strings of signs that hold together and stand in varied company; a text is cut into them by the cheapest path through the lattice of all
words at all places. Where sentences end is learned from punctuated text: its marks are taken out, and every gap between two words is an example, with a
sentence end or without, told by the word before it (final particles among them) and the word behind it (opening words among them).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.boilerplate import _logistic
from lexforge.runtime import cut

#: The longest word in signs; how often a word must stand, beside how many different neighbours on either side, and how much oftener than its halves by chance.
LONGEST, LEAST, COMPANY, COHESION = 4, 5, 3, 8.0
UNKNOWN = 14.0
#: Words on either side of a gap that are looked at.
REACH = 4
PENALTY, ROUNDS = 0.3, 150
_RUN = regex.compile(r"[㐀-䶿一-鿿]+")
_STOP = regex.compile(r"[。！？!?]")
#: A sentence has at least so many signs where only gaps tell.
SHORTEST = 4


class Gaps:
    """A dictionary with costs, and log-odds of a sentence end by the words before and behind a gap."""

    def __init__(self, costs: dict[str, float] | None = None, weights: dict[str, float] | None = None, bias: float = -3.0):
        self.costs, self.weights, self.bias = costs or {}, weights or {}, bias

    def words(self, run: str) -> list[int]:
        """End offsets of the words on the cheapest path through the lattice."""
        return _path(run, self.costs)

    def odds(self, words: list[str], k: int) -> float:
        """Log-odds that a sentence ends behind word k."""
        return self.bias + sum(self.weights.get(f, 0.0) for f in _features(words, k))

    def ends(self, run: str) -> list[int]:
        """End offsets of the sentences inside a run of signs without any mark."""
        at = self.words(run)
        words = [run[a:b] for a, b in zip([0, *at], at)]
        out, last = [], 0
        for k, a in enumerate(at[:-1]):
            if a - last >= SHORTEST and len(run) - a >= SHORTEST and self.odds(words, k) > 0:
                out.append(a)
                last = a
        return out


def _path(run: str, costs: dict[str, float]) -> list[int]:
    n = len(run)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for i in range(n):
        at = best[i]
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            cost = costs.get(run[i:j])
            if cost is None:
                if j > i + 1:
                    continue
                cost = UNKNOWN
            if at + cost < best[j]:
                best[j], back[j] = at + cost, i
    ends, at = [], n
    while at:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def _features(words: list[str], k: int) -> list[str]:
    """What tells of the gap behind word k: REACH words on either side by their distance, the last and first sign, and the pair of words."""
    out = [f"{j}{words[k + j]}" for j in range(1 - REACH, REACH + 1) if 0 <= k + j < len(words)]
    return [*out, f"-{words[k][-1]}", f"+{words[k + 1][0]}", f"{words[k]} {words[k + 1]}"]


def _strings(runs: Iterable[tuple[str, int]]) -> tuple[Counter, dict[str, set], dict[str, set]]:
    """How often each string of up to LONGEST signs stands in the runs, and its neighbours on either side (COMPANY of them at most, as more tell nothing)."""
    count: Counter = Counter()
    left, right = defaultdict(set), defaultdict(set)
    for run, n in runs:
        for i in range(len(run)):
            for j in range(i + 1, min(len(run), i + LONGEST) + 1):
                w = run[i:j]
                count[w] += n
                if j > i + 1:
                    for side, sign in ((left[w], run[i - 1] if i else ""), (right[w], run[j] if j < len(run) else "")):
                        if len(side) < COMPANY:
                            side.add(sign)
    return count, left, right


def _recount(runs: Iterable[tuple[str, int]], costs: dict[str, float]) -> Counter:
    """How often each word stands on the cheapest paths."""
    again: Counter = Counter()
    for run, n in runs:
        start = 0
        for e in _path(run, costs):
            again[run[start:e]] += n
            start = e
    return again


def _settled(kept: dict[str, int], recount: Callable[[dict[str, float]], dict[str, int]]) -> dict[str, float]:
    """Costs of the words, counted again on the cheapest paths."""
    for again in (True, True, False):
        total = sum(kept.values()) or 1
        costs = {w: math.log(total / n) + (2.0 if len(w) == 1 else 0.0) for w, n in kept.items() if n > 0}
        if again:
            kept = {w: n for w, n in recount(costs).items() if len(w) == 1 or n >= 2}
    return costs


def _costs(runs: Counter) -> dict[str, float]:
    """Costs of the words that the runs are made of: strings that hold together, then counted again on the cheapest paths."""
    count, left, right = _strings(runs.items())
    signs = sum(n for w, n in count.items() if len(w) == 1) or 1
    kept = {w: n for w, n in count.items() if len(w) == 1}
    for w, n in count.items():
        if len(w) > 1 and n >= LEAST and min(len(left[w]), len(right[w])) >= COMPANY:
            chance = max(count[w[:k]] * count[w[k:]] / signs for k in range(1, len(w)))
            if n >= COHESION * chance:
                kept[w] = n
    return _settled(kept, lambda costs: _recount(runs.items(), costs))


def _gaps(paragraphs: Iterable[tuple[str, int]], costs: dict[str, float]) -> Counter:
    """How often each gap stands in the paragraphs: (words before, words behind, whether a sentence ends), REACH words on either side."""
    out: Counter = Counter()
    paths: dict[str, list[str]] = {}
    for p, n in paragraphs:
        words, ends, last = [], set(), 0
        for m in _RUN.finditer(p):
            if words and _STOP.search(p[last : m.start()]):
                ends.add(len(words) - 1)
            run, last = m.group(), m.end()
            got = paths.get(run)
            if got is None:
                if len(paths) > 100_000:
                    paths.clear()
                at = _path(run, costs)
                got = paths[run] = [run[a:b] for a, b in zip([0, *at], at)]
            words += got
        for k in range(len(words) - 1):
            out[tuple(words[max(0, k + 1 - REACH) : k + 1]), tuple(words[k + 1 : k + 1 + REACH]), k in ends] += n
    return out


def _told(gap: tuple) -> list[str]:
    before, behind, _ = gap
    return _features([*before, *behind], len(before) - 1)


def _gap_rows(gaps: list[tuple], vocabulary: dict[str, int]) -> list[list[int]]:
    return [[0, *(vocabulary[f] for f in _told(x) if f in vocabulary)] for x in gaps]


def _descend(gradient: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The steps of boilerplate._logistic for a gradient that is summed elsewhere."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    hold = np.full(size, PENALTY)
    hold[:1] = PENALTY / 20
    for i in range(1, ROUNDS + 1):
        g = gradient(w) + hold * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.25 * (1 - 0.9 * i / ROUNDS) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return w


def _model(costs: dict[str, float], vocabulary: dict[str, int], got: np.ndarray) -> Gaps:
    return Gaps(costs, {f: float(got[k]) for f, k in vocabulary.items() if k and abs(got[k]) > 1e-3}, float(got[0]))


def fit(texts: Iterable[str]) -> Gaps:
    """Words and gaps from punctuated texts; texts without signs, or without marks, teach nothing."""
    paragraphs = [(p, 1) for t in texts if isinstance(t, str) for p in t.split("\n") if len(_RUN.findall(p)) > 1]
    runs = Counter(m.group() for p, _ in paragraphs for m in _RUN.finditer(p))
    if not runs:
        return Gaps()
    costs = _costs(runs)
    gaps = _gaps(paragraphs, costs)
    if not any(end for _, _, end in gaps):
        return Gaps(costs)
    size: Counter = Counter()
    for x, n in gaps.items():
        for f in _told(x):
            size[f] += n
    vocabulary = {f: k for k, f in enumerate(["", *sorted(f for f, n in size.items() if n >= 2)])}
    got = _logistic(_gap_rows(list(gaps), vocabulary), len(vocabulary), np.array([x[-1] for x in gaps], dtype=float), np.array([math.sqrt(n) for n in gaps.values()]), 1, ROUNDS, PENALTY)
    return _model(costs, vocabulary, got)


#: Different gaps in a part, whose gradient one task takes.
PART = 200_000
_HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"


def fit_all(texts: DataFrame) -> Gaps:
    """Words and gaps from all texts (a column t), as `fit` takes them from a list.

    Strings, their neighbours, words on the cheapest paths and gaps are counted over all texts; every round of the fit sums the gradient over parts of PART different gaps. To the driver come the
    words, the weights and the gradient, summed in groups beforehand.
    """
    paragraphs = texts.where(F.col("t").rlike(_HAN)).select(F.explode(F.split("t", "\n")).alias("x")).where(F.col("x").rlike(f"{_HAN}[^{_HAN[1:]}+{_HAN}"))
    paragraphs = cut(paragraphs.groupBy("x").agg(F.count("*").alias("n")))
    runs = cut(paragraphs.select(F.explode(F.regexp_extract_all("x", F.lit(f"({_HAN}+)"))).alias("x"), "n").groupBy("x").agg(F.sum("n").alias("n")))
    pairs = lambda batches: ((x, n) for b in batches for x, n in zip(b["x"], b["n"].tolist()))

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, left, right = _strings(pairs(batches))
        yield pd.DataFrame([(w, n, sorted(left[w]) if len(w) > 1 else [], sorted(right[w]) if len(w) > 1 else []) for w, n in count.items()], columns=["w", "n", "before", "behind"])

    company = lambda side: F.size(F.array_distinct(F.flatten(F.collect_list(side))))
    counted = runs.mapInPandas(strings, "w string, n long, before array<string>, behind array<string>").groupBy("w").agg(F.sum("n").alias("n"), F.least(company("before"), company("behind")).alias("company"))
    counted = cut(counted.where((F.length("w") == 1) | (F.col("n") >= LEAST)))
    kept = {r["w"]: r["n"] for r in counted.where(F.length("w") == 1).collect()}
    if not kept:
        return Gaps()
    signs = sum(kept.values())
    halves = counted.where((F.length("w") > 1) & (F.col("company") >= COMPANY)).select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k"))
    halves = halves.select("w", "n", F.substring("w", F.lit(1), F.col("k")).alias("a"), F.substring("w", F.col("k") + 1, F.lit(LONGEST)).alias("b"))
    one, two = (counted.select(F.col("w").alias(x), F.col("n").alias("n" + x)) for x in "ab")
    chance = halves.join(one, "a").join(two, "b").groupBy("w", "n").agg(F.max(F.col("na") * F.col("nb") / signs).alias("chance"))
    kept |= {r["w"]: r["n"] for r in chance.where(F.col("n") >= COHESION * F.col("chance")).collect()}

    def recount(costs: dict[str, float]) -> dict[str, int]:
        held = texts.sparkSession.sparkContext.broadcast(costs)

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame(list(_recount(pairs(batches), held.value).items()), columns=["w", "n"])

        return {r["w"]: r["n"] for r in runs.mapInPandas(again, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}

    costs = _settled(kept, recount)
    held = texts.sparkSession.sparkContext.broadcast(costs)

    def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(" ".join(a), " ".join(b), end, n) for (a, b, end), n in _gaps(pairs(batches), held.value).items()], columns=["a", "b", "e", "n"])

    met = cut(paragraphs.mapInPandas(gaps, "a string, b string, e boolean, n long").groupBy("a", "b", "e").agg(F.sum("n").alias("n")))
    size = met.agg(F.count("*").alias("n"), F.max("e").alias("e")).first()
    if not size["e"]:
        return Gaps(costs)
    parts = -(-size["n"] // PART)
    groups = max(1, math.isqrt(parts))
    gaps_of = lambda b: [(tuple(x.split(" ")), tuple(y.split(" ")), e) for x, y, e in zip(b["a"], b["b"], b["e"].tolist())]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for x, n in zip(gaps_of(b), b["n"].tolist()):
                for f in _told(x):
                    held[f] += n
        yield pd.DataFrame(list(held.items()), columns=["f", "n"])

    named = met.mapInPandas(features, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n >= 2").select("f").collect()
    vocabulary = {f: k for k, f in enumerate(["", *sorted(r["f"] for r in named)])}
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols, lengths, target, weight = [], [], [], []
        for b in batches:
            for r in _gap_rows(gaps_of(b), known.value):
                cols += r
                lengths.append(len(r))
            target += b["e"].tolist()
            weight += np.sqrt(b["n"].to_numpy()).tolist()
        if lengths:
            yield pd.DataFrame({"g": [TaskContext.get().partitionId() % groups], "cols": [np.array(cols, np.int32).tobytes()], "lengths": [np.array(lengths, np.int32).tobytes()], "target": [np.array(target, float).tobytes()], "weight": [np.array(weight, float).tobytes()]})

    coded = cut(met.repartition(parts, "a", "b").mapInPandas(rows, "g int, cols binary, lengths binary, target binary, weight binary"))

    def push(c: bytes, n: bytes, t: bytes, u: bytes, w: np.ndarray) -> np.ndarray:
        col, lengths = np.frombuffer(c, np.int32), np.frombuffer(n, np.int32)
        row = np.repeat(np.arange(len(lengths)), lengths)
        off = np.frombuffer(u, float) * (1 / (1 + np.exp(-np.bincount(row, weights=w[col], minlength=len(lengths)))) - np.frombuffer(t, float))
        return np.bincount(col, weights=off[row], minlength=len(w))

    if parts == 1:  # small enough for the driver
        only = coded.first()
        return _model(costs, vocabulary, _descend(lambda w: push(*only[1:], w), len(vocabulary)))

    def gradient(w: np.ndarray) -> np.ndarray:
        now = texts.sparkSession.sparkContext.broadcast(w)

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for g, c, n, t, u in zip(b["g"], b["cols"], b["lengths"], b["target"], b["weight"]):
                    yield pd.DataFrame({"g": [g], "s": [push(c, n, t, u, now.value).tobytes()]})

        def total(b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"g": b["g"][:1], "s": [sum(np.frombuffer(x, float) for x in b["s"]).tobytes()]})

        got = coded.mapInPandas(summed, "g int, s binary")
        if groups > 1:
            got = got.groupBy("g").applyInPandas(total, "g int, s binary")
        out = sum(np.frombuffer(r["s"], float) for r in got.collect())
        now.unpersist()
        return out

    return _model(costs, vocabulary, _descend(gradient, len(vocabulary)))
