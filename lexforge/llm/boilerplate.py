"""Tell the text of a web page from its menus, notices, side lists and footers.

Every line is scored: its words and its shape (length, end, separators, list marks: what is left of a page's tags once it is stored as lines)
add up to the log-odds that it is text. The weights are fitted to a bounded sample of pages that label one another: a line that
comes again on pages with other texts belongs to the page. A linear scan then finds the runs of lines with the highest total; a run
takes its price to begin, so a doubtful line inside the text is kept and the same line between lines of the page is dropped. The heads of side
lists, and what their entries look like, are learned from the same pages.
"""

from __future__ import annotations

import ast
import hashlib
import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import sampling
from lexforge.llm.confusables import _CLEAN, normalise
from lexforge.llm.mojibake import repairer, suspect
from lexforge.runtime import cut

#: The bounded sample that the weights are fitted to: pages, and the longest of them in bytes (longer ones are scored, not learned from).
SAMPLE_PAGES, SAMPLE_BYTES = 4000, 50_000
#: A line is one of the page's if it comes again with so many other texts: this share of the sampled pages, and at least so many of them.
#: A sentence of this length without the site's name may be a quotation: its share must be greater.
SHARE, LEAST, SENTENCE, SENTENCE_SHARE = 0.001, 5, 60, 0.01
#: A line of the page is the head of a side list if two short lines of their own follow it so often.
HEADS = 0.85
#: What a run of text must be worth, what it takes to go on behind lines of the page, and the odds that a side list has a further entry.
RUN, RESUMED, FURTHER = 2.0, 0.5, 1.0
PENALTY, ROUNDS = 0.05, 250
#: Lines beyond this length have no shape but their end, and are read as they are stored.
LONG = 160
#: Evidence of a single line is bounded, as its words don't speak independently.
MOST = 12.0

_LIST_MARK = regex.compile(r"^[*•\-–·▪‣]\s+")
_NUMBERED = regex.compile(r"^(?:\p{N}+[.)]|[IVXLCDM]+[.)]|§|\p{L}{1,3}ʹ|\(\p{N}+\))\s?")
_ENDS = frozenset(".!?;:。！？；।॥|·,，»”\"“)")
_TOKEN = regex.compile(r"\p{Han}+|[\p{L}\p{M}]+")
_BLANK, _DIGITS, _DIGIT = regex.compile(r"\s+"), regex.compile(r"\p{N}+"), regex.compile(r"\p{N}")
_HAN, _INDIC, _HOST = regex.compile(r"\p{Han}"), regex.compile(r"[ऀ-ॿ]"), regex.compile(r"^[a-z]+://([^/:]+)")
_SEPARATOR = regex.compile(r"\s[|·»•/›>]\s|\s[|»›>]$|:\s")


class _Memo(dict):
    """What a function gives for strings that were met; bounded."""

    def __init__(self, f, most: int = 300_000):
        self.f, self.most = f, most

    def __missing__(self, x):
        if len(self) >= self.most:
            self.clear()
        got = self[x] = self.f(x)
        return got

    def __reduce__(self):
        return _Memo, (self.f, self.most)  # what was met is not sent along


def _fold_word(word: str) -> str:
    if not word.isascii():
        word = "".join([c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)])
    return _DIGITS.sub("0", word.casefold()).replace("ς", "σ")


_FOLDED = _Memo(_fold_word)


def fold(line: str) -> str:
    """Compared form of a line: no case, accents or numbers. All of it goes sign by sign or within a word, so words that were met are looked up."""
    line = " ".join(map(_FOLDED.__getitem__, line.split(" "))) if " " in line else _fold_word(line)
    if line.isprintable() and "  " not in line and line[:1] != " " != line[-1:]:  # no white space but single spaces
        return line
    return _BLANK.sub(" ", line).strip()


def site_of(url: str | None) -> str:
    """The name of the site in a url's host, folded."""
    host = _HOST.match(url) if isinstance(url, str) else None
    return fold(host.group(1).removeprefix("www.").split(".")[0]) if host else ""


_TERMS: dict[str, list[str]] = {}


def _terms(token: str) -> list[str]:
    """What is weighed of a token: a folded word, or the pairs of neighbouring ideographs. Those met are kept."""
    got = _TERMS.get(token)
    if got is None:
        if len(_TERMS) > 200_000:
            _TERMS.clear()
        got = _TERMS[token] = ([token[k : k + 2] for k in range(len(token) - 1)] or [token]) if _HAN.match(token) else [fold(token)]
    return got


def _shape(s: str, words: int) -> tuple[str, ...]:
    """Names of the features of a line's shape."""
    end = "…" if s.endswith(("…", "...")) else "." if s[-1] in _ENDS else "-"
    if len(s) > LONG:
        return (f"end {end}", f"long end {end}", "long")
    size = len(s) // 2 if words and _HAN.search(s) else words
    step = next((str(k) for k in (1, 2, 3, 4, 6, 10, 16) if size <= k), "+")
    out = [f"end {end}", f"words {step} end {end}", f"words {step}"]
    if _LIST_MARK.match(s):
        out.append("list mark")
    if _NUMBERED.match(s):
        out.append("numbered")
    if (m := _SEPARATOR.search(s)) and (mark := m.group().strip()) != ":":
        out.append(f"separator {mark}")
        if s.endswith("cod."):
            out.append("apparatus")
    elif m and m.start() < 24:
        out.append("label")
    if "©" in s:
        out.append("©")
    if _DIGIT.search(s):
        out.append("digit")
    if s[0].islower():
        out.append("small")
    return tuple(out)


def _entry_traits(s: str) -> tuple[tuple, ...]:
    """What tells an entry of a side list from other lines: its end and beginning, and the length of a line without an end."""
    end = "…" if s.endswith(("…", "...")) else "." if s[-1] in _ENDS else "-"
    out = [("end", end), ("numbered", bool(_NUMBERED.match(s))), ("small", s[:1].islower())]
    if end == "-":
        han = len(_HAN.findall(s))
        size = han if han else len(_TOKEN.findall(s))
        cuts = (3, 9, 16, 24, 40) if han else (1, 2, 3, 4, 5, 7, 10, 16)
        out.append(("han" if han else "indic" if _INDIC.search(s) else "size", next((k for k in cuts if size <= k), 99)))
    return tuple(out)


def _lines(text: str, whole: bool = False) -> list[tuple[int, str]]:
    """(number, restored form without white space around) of the non-empty lines; look-alikes are respelt in short lines, or with `whole` in all."""
    raw = text.split("\n")
    plain = raw
    if suspect(text):
        fix = repairer().repair
        plain = fix(text)[0].split("\n")
        if len(plain) != len(raw):
            plain = [fix(x)[0] for x in raw]
        plain = [x if len(x) > LONG and not whole or _CLEAN.fullmatch(x) else normalise(x)[0] for x in plain]
    return [(n, p.strip() or r.strip()) for n, (r, p) in enumerate(zip(raw, plain), 1) if r.strip()]


def _logistic(rows: list[list[int]], size: int, target: np.ndarray, weight: np.ndarray, free: int, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Weights of a logistic regression on 0/1 features by Adam over the whole sample; the first `free` weights aren't held down."""
    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return _adam(np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(lengths.sum())), lengths, size, target, weight, free, rounds, penalty)


def _adam(col: np.ndarray, lengths: np.ndarray, size: int, target: np.ndarray, weight: np.ndarray, free: int, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """_logistic for rows that lie one behind another in `col`. The entries are kept by row and by column, so both sums of a round run over neighbouring numbers."""
    held = np.flatnonzero(lengths)  # reduceat knows no empty rows
    starts = (np.cumsum(lengths) - lengths)[held]
    row = np.repeat(np.arange(len(lengths)), lengths)[np.argsort(col, kind="stable")]
    by = np.bincount(col, minlength=size)
    used = np.flatnonzero(by)
    tops = (np.cumsum(by) - by)[used]
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    hold = np.full(size, penalty)
    hold[:free] = penalty / 20
    z, g, each = np.zeros(len(lengths)), np.zeros(size), np.empty(len(col))
    for i in range(1, rounds + 1):
        if len(col):
            z[held] = np.add.reduceat(np.take(w, col, out=each, mode="clip"), starts)
        off = weight * (1 / (1 + np.exp(-z)) - target)
        if len(col):
            g[used] = np.add.reduceat(np.take(off, row, out=each, mode="clip"), tops)
        d = g + hold * w
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        w -= 0.25 * (1 - 0.9 * i / rounds) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return w


class Weights:
    """Log-odds of words and shapes for text against page, of words and shapes for heads of side lists, and of the classes of lines for entries."""

    def __init__(self):
        self.text: dict[str, float] = {}
        self.head: dict[str, float] = {}
        self.entry: dict[tuple, float] = {}
        self.bias, self.head_bias = 1.0, -3.0
        self._known: dict[str, float] = {}
        self._met: dict[tuple[str, str], tuple[float, float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_met": {}}

    def short_line(self, s: str, site: str) -> tuple[float, float]:
        """Log-odds as text and as a head of a short line; those of lines met are kept, for lines of pages come again."""
        got = self._met.get((s, site))
        if got is None:
            if len(self._met) > 50_000:
                self._met.clear()
            value = self.score(s, site)
            got = self._met[(s, site)] = value, self.head_odds(s, site) if value < 0 and self.head else -1.0
        return got

    def _sum(self, weights: dict[str, float], bias: float, tokens: set[str], shape: tuple[str, ...], site: str) -> float:
        own = [t for token in tokens for t in _terms(token)]
        return bias + sum(weights.get("@" if site and t == site else t, 0.0) for t in own) + sum(weights.get("\0" + f, 0.0) for f in shape)

    def score(self, s: str, site: str = "") -> float:
        """Log-odds that a line is text; the weights of tokens that were met are kept."""
        if len(s) <= LONG:
            tokens = set(_TOKEN.findall(s))
            shape = _shape(s, len(tokens))
        else:
            tokens = set(s.split())  # words with the marks beside them, taken apart when they are first met
            shape = _shape(s, 99)
        if site and len(s) <= LONG and site in s.casefold():
            value = self._sum(self.text, self.bias, tokens, shape, site)
        else:
            known = self._known
            if len(known) > 300_000:
                known.clear()
            for t in [t for t in tokens if t not in known]:
                known[t] = sum(self.text.get(x, 0.0) for w in _TOKEN.findall(t) for x in _terms(w))
            value = self.bias + sum(map(known.__getitem__, tokens))
            for f in shape:
                value += self.text.get("\0" + f, 0.0)
        return max(-MOST, min(MOST, value))

    def head_odds(self, s: str, site: str = "") -> float:
        """Log-odds that a line of the page is the head of a side list."""
        tokens = set(_TOKEN.findall(s))
        return self._sum(self.head, self.head_bias, tokens, _shape(s, len(tokens)), site)

    def entry_odds(self, s: str) -> float:
        """Log-odds of a line behind the head of a side list for being one of its entries rather than text."""
        return sum(self.entry.get(x, 0.0) for x in _entry_traits(s)) if self.entry else -MOST


def _folded(lines: list[tuple[int, str]], site: str) -> list[tuple[str, str, str]]:
    """(line, compared form, site) of the lines of a page."""
    out = []
    for _, s in lines:
        f = fold(s) if len(s) <= 2 * LONG else s  # as it is: only equal to itself
        out.append((s, f.replace(site, "@") if site else f, site))
    return out


def _opening(f: str):
    """The first separator of a line, if it begins within 40 signs; three signs hold it."""
    m = _SEPARATOR.search(f[:43])
    return m if m and m.start() < 40 else None


def _met(lines: list[tuple[str, str, str]]) -> set[str]:
    """What is counted of a page: its lines in compared form, and the beginnings of those with a separator."""
    out = set()
    for _, f, _ in lines:
        out.add(f)
        if m := _opening(f):
            out.add(f[: m.end()])
    return out


def _same(f: str) -> str:
    return f


def _digest(f: str) -> int:
    return int.from_bytes(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Marks:
    """Which lines are the page's: those in `often` come again with enough other texts, those with True also for a sentence."""

    def __init__(self, often: dict, key=_same):
        self.often, self.key = often, key
        self._known: dict[str, bool] = {}

    def again(self, f: str) -> bool:
        got = self.often.get(self.key(f))
        return got is not None and (got or len(f) < SENTENCE or "@" in f)

    def page(self, f: str) -> bool:
        got = self._known.get(f)
        if got is None:
            got = self._known[f] = self._page(f)
        return got

    def _page(self, f: str) -> bool:
        if self.again(f):
            return True
        m = _opening(f)  # a path or row of links, or a label with its values, of which the beginning comes again
        if not m or f.endswith("cod."):
            return False
        if m.group().strip() == ":":
            return len(f) <= LONG and f[-1] not in _ENDS and self.key(f[: m.end()]) in self.often
        return self.again(f[: m.start()].strip())

    def lemma(self, f: str) -> str:
        """What comes again of a line of the page: the whole of it, or its beginning."""
        m = None if self.again(f) else _SEPARATOR.search(f)
        return f[: m.end()] if m else f


def _follow(texts: Iterable[list[tuple[str, str, str]]], marks: Marks) -> dict[str, list[int]]:
    """For each line of the page how often two short lines of their own follow it, and how often it stands."""
    follow = defaultdict(lambda: [0, 0])
    for lines in texts:
        for k, (_, f, _) in enumerate(lines):
            if marks.page(f):
                x = follow[marks.lemma(f)]
                x[1] += 1
                two = lines[k + 1 : k + 3]
                x[0] += len(two) == 2 and all(not marks.page(g) and len(t) <= 90 and (t[-1] not in _ENDS or t.endswith(("…", "..."))) for t, g, _ in two)
    return follow


def _entries(after: Counter, other: Counter) -> dict[tuple, float]:
    """Log-odds of the traits of entries, from the first lines behind a head and from lines of text that stand elsewhere."""
    kinds = {"han": "size", "indic": "size"}  # the length is one trait, told for each kind of script
    a, b = Counter(), Counter()
    for have, total in ((after, a), (other, b)):
        for (kind, _), n in have.items():
            total[kinds.get(kind, kind)] += n
    return {x: max(-6.0, min(6.0, math.log((after[x] + 0.5) / (a[k] + 5)) - math.log((other[x] + 0.5) / (b[k] + 5)))) for x in {*after, *other} for k in [kinds.get(x[0], x[0])]}


def _part(texts: Iterable[list[tuple[str, str, str]]], marks: Marks, heads: set[str], least: int) -> tuple[Counter, Counter, dict[str, tuple[float, int]], dict[str, tuple[float, int]]]:
    """Traits behind heads and elsewhere, and the weights for text and for heads of the words and shapes with the number of lines that hold each ("" is the bias)."""
    after, other = Counter(), Counter()
    # distinct lines, weighed by their number
    count: Counter = Counter()
    kept: dict[tuple, tuple] = {}
    number: dict[str, int] = {}
    of = lambda x: number.setdefault(x, len(number))
    # the numbers of the terms in a word with the marks beside it, and its tokens: no token holds white space
    ids = _Memo(lambda word: tuple({of(x) for t in _TOKEN.findall(word) for x in _terms(t)}))
    tokens = _Memo(lambda word: tuple(_TOKEN.findall(word)))
    for lines in texts:
        listed = first = False
        for s, f, site in lines:
            page = marks.page(f)
            behind = False
            if page:
                first = listed = marks.lemma(f) in heads
            elif listed:
                if first:
                    after.update(_entry_traits(s))
                first, behind = False, True  # up to the next line of the page neither text nor page is certain
            else:
                other.update(_entry_traits(s))
            if not behind:
                words = set(s.split())
                key = (f, _shape(s, len(set(chain.from_iterable(map(tokens.__getitem__, words)))) if len(s) <= LONG else 99))
                count[key] += 1
                if key not in kept:
                    own = set(chain.from_iterable(map(ids.__getitem__, words)))
                    if site and number.get(site) in own:
                        own.remove(number[site])
                        own.add(of("@"))
                    kept[key] = np.fromiter(own, dtype=np.int32, count=len(own)), page, page and marks.lemma(f) in heads
    del ids, tokens
    n = np.fromiter((count[key] for key in kept), dtype=np.int64, count=len(kept))
    own = np.concatenate([np.zeros(0, np.int32), *(x for x, _, _ in kept.values())])
    size = np.fromiter((len(x) for x, _, _ in kept.values()), dtype=np.int64, count=len(kept))
    words = list(number)
    total = np.bincount(own, weights=np.repeat(n, size), minlength=len(words))
    shapes = sorted({"\0" + x for _, shape in kept for x in shape})
    names = ["", *shapes, *sorted(words[k] for k in np.flatnonzero((total > 0) & (total >= least)))]
    vocabulary = {x: k for k, x in enumerate(names)}
    place = np.array([vocabulary.get(x, -1) for x in words], dtype=np.int64)
    # the bias, then shapes, then words of every line
    fixed = [[0, *(vocabulary["\0" + x] for x in shape)] for _, shape in kept]
    lead = np.fromiter(map(len, fixed), dtype=np.int64, count=len(fixed))
    line = np.concatenate([np.repeat(np.arange(len(kept)), lead), np.repeat(np.arange(len(kept)), size)])
    col = np.concatenate([np.fromiter(chain.from_iterable(fixed), dtype=np.int64, count=int(lead.sum())), place[own] if len(own) else np.zeros(0, np.int64)])
    line, col = line[col >= 0], col[col >= 0]
    order = np.argsort(line, kind="stable")
    line, col = line[order], col[order]
    page, head = (np.fromiter((x[k] for x in kept.values()), dtype=bool, count=len(kept)) for k in (1, 2))
    del kept, count, order, own

    def weighed(some: np.ndarray, target: np.ndarray, free: int, penalty: float) -> dict[str, tuple[float, int]]:
        if not some.any():
            return {}
        held = some[line]
        mine, rows = col[held], line[held]
        got = _adam(mine, np.bincount(rows, minlength=len(some))[some], len(names), target[some].astype(float), np.sqrt(n[some]), free, penalty=penalty)
        lines_of = np.bincount(mine, weights=n[rows], minlength=len(names))
        return {names[k]: (float(got[k]), int(lines_of[k])) for k in np.flatnonzero(lines_of)}

    text = weighed(np.ones(len(page), dtype=bool), ~page, 1 + len(shapes), PENALTY)
    return after, other, text, weighed(page & bool(heads), head, 1, PENALTY / 3)


def _put(w: Weights, text: dict[str, float], head: dict[str, float]) -> Weights:
    w.bias, w.text = text.get("", w.bias), {x: v for x, v in text.items() if x and abs(v) > 1e-3}
    w.head_bias, w.head = head.get("", w.head_bias), {x: v for x, v in head.items() if x and abs(v) > 1e-3}
    return w


def fit(pages: Iterable[tuple[str, str | None]]) -> Weights:
    """Weights from (text, url) of pages that label one another; pages with the same longest line count as one. None or empty texts don't count; without
    pages, or without a line that comes again, all weights are 0 and every line is text."""
    w = Weights()
    seen, texts = defaultdict(set), []
    for text, url in pages:
        if not isinstance(text, str) or not text.strip():
            continue
        lines = _folded(_lines(text), site_of(url))
        longest = hash(max((f for _, f, _ in lines), key=len))
        texts.append(lines)
        for f in _met(lines):
            seen[f].add(longest)
    least = max(LEAST, SHARE * len(texts))
    often = max(LEAST, SENTENCE_SHARE * len(texts))
    marks = Marks({f: len(x) >= often for f, x in seen.items() if len(x) >= least})
    follow = _follow(texts, marks)
    if not follow:
        return w
    heads = {f for f, (a, n) in follow.items() if n >= LEAST and a >= HEADS * n}
    after, other, text, head = _part(texts, marks, heads, LEAST)
    if after:
        w.entry = _entries(after, other)
    return _put(w, {x: v for x, (v, _) in text.items()}, {x: v for x, (v, _) in head.items()})


#: Bytes of text in a part of the pages that one task fits weights to.
PART = 24 << 20


def restored(items: DataFrame, key: str, text: str, url: str | None = None, by=None, also: str | None = None) -> DataFrame:
    """(k, t, site, by, a): every page that isn't blank, its lines restored and stripped, with the name of its site and the columns `by` and `also`; in parts of about
    PART bytes, told by a hash of the key, kept in the shared folder."""
    u, null = F.col(url) if url else F.lit(None).cast("string"), F.lit(None).cast("string")
    df = items.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), u.alias("u"), (null if by is None else by).alias("by"), (F.col(also) if also else null).alias("a"))
    size = df.agg(F.sum(F.octet_length("t"))).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, u, by, a in zip(b["k"], b["t"], b["u"], b["by"], b["a"]):
                if t.strip():
                    lines = [""] * (t.count("\n") + 1)
                    for n, s in _lines(t, whole=True):
                        lines[n - 1] = s
                    rows.append((k, "\n".join(lines), site_of(u), by, a))
            yield pd.DataFrame(rows, columns=["k", "t", "site", "by", "a"])

    kind = items.schema[key].dataType.simpleString()
    return cut(df.repartition(-(-max(1, size) // PART), "k").mapInPandas(run, f"k {kind}, t string, site string, by string, a string"))


def kept_lines(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines of a restored page."""
    return [(n, s) for n, s in enumerate(text.split("\n"), 1) if s]


def fit_all(pages: DataFrame) -> Weights:
    """Weights from all pages (see `restored`), as `fit` takes them from a list.

    Lines that come again are counted over all pages, every value of `by` (few, such as the language that a label names) weighing the same, so that pages in rare
    languages label one another too. Heads and entries of side lists are counted over all pages. Words and shapes are weighed in each part, and a weight is the mean over the
    parts by the number of lines that hold the word. To the driver come the lines that a thousandth of the pages share, and the vocabulary.
    """
    w = Weights()
    sizes = {r["by"]: r["count"] for r in pages.groupBy(F.coalesce("by", F.lit("")).alias("by")).count().collect()}
    if not sizes:
        return w
    texts = lambda batches: (_folded(kept_lines(t), site) for b in batches for t, site in zip(b["t"], b["site"]))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, site, by in zip(b["t"], b["site"], b["by"]):
                lines = _folded(kept_lines(t), site)
                longest = _digest(max((f for _, f, _ in lines), key=len))
                rows += [(_digest(f), longest, by or "") for f in _met(lines)]
            yield pd.DataFrame(rows, columns=["f", "longest", "by"])

    share = F.try_element_at(F.create_map(*[F.lit(x) for by, n in sizes.items() for x in (by, 1.0 / n / len(sizes))]), F.col("by"))
    counted = pages.select("t", "site", "by").mapInPandas(met, "f long, longest long, by string").groupBy("f", "longest").agg(F.min("by").alias("by"))
    counted = counted.groupBy("f").agg(F.count("*").alias("n"), F.sum(share).alias("share")).where((F.col("n") >= LEAST) & (F.col("share") >= SHARE * (1 - 1e-9)))
    often = {r["f"]: r["share"] >= SENTENCE_SHARE * (1 - 1e-9) for r in counted.collect()}
    if not often:
        return w

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(f, a, n) for f, (a, n) in _follow(texts(batches), Marks(often, _digest)).items()], columns=["f", "a", "n"])

    followed = pages.select("t", "site").mapInPandas(follow, "f string, a long, n long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    lemmas = followed.collect()
    if not lemmas:
        return w
    heads = {r["f"] for r in lemmas if r["n"] >= LEAST and r["a"] >= HEADS * r["n"]}
    least = LEAST if pages.rdd.getNumPartitions() == 1 else 1  # a word that is rare in each part may not be so in all

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after, other, text, head = _part(texts(batches), Marks(often, _digest), heads, least)
        rows = [(kind, repr(x), 0.0, n) for kind, have in (("after", after), ("other", other)) for x, n in have.items()]
        rows += [(kind, x, v * n, n) for kind, have in (("text", text), ("head", head)) for x, (v, n) in have.items()]
        yield pd.DataFrame(rows, columns=["kind", "x", "v", "n"])

    got: dict[str, dict] = {"after": Counter(), "other": Counter(), "text": {}, "head": {}}
    summed = pages.select("t", "site").mapInPandas(part, "kind string, x string, v double, n long").groupBy("kind", "x").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    for r in summed.collect():
        if r["kind"] in ("after", "other"):
            got[r["kind"]][ast.literal_eval(r["x"])] = r["n"]
        elif r["kind"] == "head" or r["n"] >= LEAST or r["x"][:1] in ("", "\0"):
            got[r["kind"]][r["x"]] = r["v"] / r["n"]
    if got["after"]:
        w.entry = _entries(got["after"], got["other"])
    return _put(w, got["text"], got["head"])


def sample(items: DataFrame, key: str, text: str, url: str | None = None, by=None, most: int = SAMPLE_PAGES) -> list:
    """The bounded sample: rows (k, t, u, by) of about `most` pages, by a hash of their key; with `by` (a column expression of few values, such as the
    language that a label names) as many of each value, so that pages in rare languages label one another too."""
    held = items.where(F.col(text).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES))
    u = F.col(url) if url else F.lit(None).cast("string")
    part = F.lit("").alias("by") if by is None else F.coalesce(by, F.lit("")).alias("by")
    return sampling.rows(held.select(F.col(key).alias("k"), F.col(text).alias("t"), u.alias("u"), part), "k", most, "by")


OUTSIDE, INSIDE, ASIDE, WITHIN = range(4)  # outside the text, in a run of it, in a side list outside, in one within a run


def _scan(lines: list[tuple[int, float, float, float]]) -> set[int]:
    """Numbers of the lines of text of (number, log-odds as text, as a head, as an entry): the runs with the highest total, in one linear scan.

    Every run counts the log-odds of its lines and takes RUN to begin; a side list begins behind a line of the page that is a head, counts how much likelier
    its lines are as entries, and ends where that no longer pays. The best sums up to each line are kept for four states.
    """
    never = -math.inf
    state = (0.0, 0.0, never, never)  # a page may begin with its text
    back: list[tuple[int, int, int, int]] = []
    for _, value, head, entry in lines:
        o, i, a, w = state
        out = max(((o, OUTSIDE), (i, INSIDE), (a, ASIDE), (w, WITHIN)))
        goes = max(((i, INSIDE), (o - RUN, OUTSIDE), (w - RESUMED, WITHIN), (a - RUN, ASIDE)))
        more = entry + FURTHER
        aside = (a + more + value, ASIDE)
        within = (w + more + value, WITHIN)
        if head > 0 > value:  # the list begins with this line; the run goes on behind it
            aside, within = max(aside, (out[0] + head, out[1])), max(within, (i + head, INSIDE))
        back.append((out[1], goes[1], aside[1], within[1]))
        state = (out[0], goes[0] + value, aside[0], within[0])
    kept, at = set(), max(range(4), key=state.__getitem__)
    for (n, *_), whence in zip(reversed(lines), reversed(back)):
        if at == INSIDE:
            kept.add(n)
        at = whence[at]
    return kept or {n for n, value, *_ in lines if value > -RUN}  # where no run is worth its price, doubtful lines are the text


def page_lines(text: str, weights: Weights, site: str = "", lines: list[tuple[int, str]] | None = None, short: bool = False) -> list[int]:
    """Numbers (from 1, empty lines counted) of the non-empty lines that belong to the page; `lines` are those of _lines, if they are known. With
    `short` only lines up to LONG can be the page's and longer ones aren't weighed: quicker, for callers who ask what the text is and not where it ends."""
    rows, listed = [], False
    for n, s in _lines(text) if lines is None else lines:
        if len(s) <= LONG:
            value, head = weights.short_line(s, site)
        else:
            value, head = MOST if short else weights.score(s, site), -1.0
        rows.append((n, value, head, weights.entry_odds(s) if listed else -MOST))  # entries only stand behind a head
        listed = listed or head > 0
    kept = _scan(rows)
    return [n for n, *_ in rows if n not in kept]


def strip_pages(df: DataFrame, key: str, text: str, weights: Weights, url: str | None = None) -> DataFrame:
    """(key, main_text, page_lines): the text of each page without the lines of the page, and the numbers of those lines.

    `url` names the site, whose own name counts as part of the page. Null text gives null and no lines, empty text stays empty; lines are split at "\\n"
    only. Each row is handled alone; no shuffle. The weights (some hundred KB, whatever the input) are broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = held.value
        for b in batches:
            rows = []
            for t, u in zip(b["t"], b["u"]):
                if not isinstance(t, str):
                    rows.append((None, []))
                    continue
                drop = page_lines(t, w, site_of(u))
                gone = set(drop)
                rows.append(("\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in gone), drop))
            out = pd.DataFrame(rows, columns=["main_text", "page_lines"], index=b.index)
            out.insert(0, key, b["k"])
            yield out

    kind = df.schema[key].dataType.simpleString()
    site = F.col(url) if url else F.lit(None).cast("string")
    return df.select(F.col(key).alias("k"), F.col(text).alias("t"), site.alias("u")).mapInPandas(run, f"`{key}` {kind}, main_text string, page_lines array<long>")
