"""Sentence units in many languages.

Blank lines end units. In scripts with spaces every terminator is a node of a lattice: an edge is a sentence, its cost tells how well it
is closed (quotes, brackets) and how its end looks (abbreviation, initial, date, case of what follows); the cheapest path gives the
sentences. Devanagari has the same lattice with its own terminators. In scripts without spaces a text is first cut into dictionary words by the
best path through a word lattice; every gap between two words is classified by its mark, a final particle before it, an opening word behind it
and the distance of the marks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.mojibake import repairer, suspect
from lexforge.llm.spaceless import Gaps, fit, fit_all  # noqa: F401

#: Abbreviations that stand before a name, number or quotation (fixed values).
BEFORE = set("""
dr prof mr mrs ms st sr sra rev fr hl vol vols cap caps lib ed edd eds ca c cf cfr p pp s ss seq fol foll no nr n nn num núm pág págs pag pagg bd bde hg hrsg jh ch chap fig figs
art viz i.e e.g z.b z. d.h d. bzw u.a sog evtl ggf vgl env v vv av apr m mm mme mlle sig dott p.ej ej es op cit loc ibid id ap al sc v.l l. l.c ad q.v s.v f ff t tom tav abb anm
стр гл г см ср напр им т св ул проф с ст рис табл т.е в кн
σελ αρ βλ τ π.χ δηλ κ κ. αγ πρβλ σημ εκδ κεφ fr cod
""".split())
#: Abbreviations that may end a sentence: before a capital they do (fixed values).
ENDING = set("etc usw ecc κτλ κ.ά κ.λπ κλπ κ.τ.λ д п др пр u.s.w u.a.m &c al etc".split())
#: Months that follow a day's number (fixed values).
MONTHS = set("""
january february march april may june july august september october november december januar februar märz april mai juni juli august september oktober november dezember
janvier février mars avril mai juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre января февраля марта апреля мая июня июля августа сентября октября ноября декабря
ιανουαρίου φεβρουαρίου μαρτίου απριλίου μαΐου ιουνίου ιουλίου αυγούστου σεπτεμβρίου οκτωβρίου νοεμβρίου δεκεμβρίου ianuarii februarii martii aprilis maii iunii iulii augusti septembris octobris novembris decembris
""".split())
#: Verbs of saying that carry on after a quotation, where the script has no case or sentences begin small (fixed values).
SAYING = set("ἔφη φησί φησίν φησι εἶπε εἶπεν ἦ ἔφασαν ἔλεξε ἔλεξεν ἀπεκρίνατο ἠρώτησε ἠρώτα ἤρετο ρώτησε είπε λέει απάντησε inquit ait".split())
SAYING_SIGNS = regex.compile(r"^[^。！？；，：“”「」]{0,12}?(?:说道|问道|答道|说|问|答|道|曰|云|喊|叫)(?=[。！？，：])")
OPEN, CLOSE = "“«„‘‚「『‹", "”»’」』›"
_BLANK = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_IGNORED = "​‌‍⁠﻿­"
_TERMINATOR = regex.compile(r"(?:\.{2,}|…+|[.!?．！？;；\u037e]+)")
_DANDA = regex.compile(r"(?:॥|\|\|)\s*[०-९0-9]+\s*(?:॥|\|\|)|[।॥]+|(?<=[ऀ-ॿ]\s?)[.!?|]+(?=\s|$)")
_HAN_END = regex.compile(r"(?:……|[。！？!?]+)[”’」』》）\"]*")
_HAN = regex.compile(r"[㐀-䶿一-鿿]")
_HAN_RUN = regex.compile(r"[㐀-䶿一-鿿]+")
_INTRODUCED = regex.compile(r"[：:]\s*[“「『]")
#: Words of one syllable that can stand before a full stop (fixed values).
SHORT_WORDS = set("च न हि तु वा मा ह".split())
_SHORT_INDIC = regex.compile(r"(?<![\p{L}\p{M}])[क-ह]\p{M}?$")
#: Words of running Chinese, ancient and modern, the final particles and the openers among them (fixed values).
FINAL_SIGNS = set("也矣乎哉焉耳兮耶欤歟尔爾了吗嗎呢吧啊呀嘛")
OPENING_SIGNS = "夫 盖 蓋 故 然 且 若 则 則 是故 于是 於是 然则 然則 今 昔 初 但是 因为 因為 所以 虽然 雖然 而且 然而 如果 当时 當時 后来 後來 因此 有一天 其后 其後 子曰 或曰".split()
COMMON_SIGNS = "的 是 在 不 了 有 和 人 这 中 大 为 上 个 国 我 以 要 他 时 来 用 们 生 到 作 地 于 出 就 分 对 成 会 可 主 发 年 动 同 工 也 能 下 过 子 说 产 种 面 而 方 后 多 定 行 学 法 所 民 得 经 之 其 者 曰 与 何 无 乃 天下 君子 小人 先生 我们 他们 没有 什么 知道 可以 自己 学生 老师 方言 手稿 城墙".split()
DICTIONARY = {w: 3.0 if len(w) > 1 else 5.0 for w in [*OPENING_SIGNS, *COMMON_SIGNS]} | {w: 4.0 for w in FINAL_SIGNS}
#: Signs that mostly carry an aspect or a tone inside a sentence, and openers that mostly join clauses: weaker evidence (fixed values).
WEAK_FINALS = set("尔爾了啊呀嘛")
WEAK_OPENERS = set("且 若 则 則 故 然 初 但是 因为 因為 所以 虽然 雖然 而且 于是 於是 然而 如果 当时 當時 因此".split())
UNPUNCTUATED, SPARSE = 40, 20  # signs in a row without any mark: such a stretch alone, or the mean of its paragraph


_BLANKS = " \n\t\r\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u3000" + _IGNORED
_AFTER_GREEK = regex.compile(r"\p{Greek}[\p{M}»”\")]*$")
_NEXT = regex.compile(r"[^\p{L}\p{N}]*+([\p{L}\p{N}][\p{L}\p{M}\p{N}" + _IGNORED + r"]*+)")
_TOKEN = regex.compile(r"[\p{L}\p{M}&." + _IGNORED + r"]+$")
_CITED = regex.compile(r"(?<![\p{L}.])([\p{L}.]{1,5})\.\s\p{Lu}\p{Ll}{1,4}$")
_NUMBER = regex.compile(r"(\p{N}+)$")
_TAIL = regex.compile(r"[^\s\p{L}\p{N}]*+")
_LEVEL = regex.compile(r"[«(„“»)”]")


def words_of(run: str) -> list[int]:
    """End offsets of the words on the best path through the lattice of dictionary words; an unknown sign costs more than a word."""
    n = len(run)
    best, back = [0.0] + [1e18] * n, [0] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + 4) + 1):
            cost = DICTIONARY.get(run[i:j], 8.0 if j == i + 1 else 1e17)
            if best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, i
    ends, at = [], n
    while at:
        ends.append(at)
        at = back[at]
    return ends[::-1]


def _spaceless(part: str, model: Gaps | None = None) -> list[int]:
    """End offsets of the sentences of a paragraph in Chinese signs: the log-odds of every gap between two words of the lattice and of every
    mark decide, from punctuation, final particles, opening words and how far the marks are apart. With a `model`, the words and the
    log-odds of gaps in stretches without marks are those it has learned."""
    marks = {m.end(): m.start() for m in _HAN_END.finditer(part)}
    runs = {m.end(): m.start() for m in _HAN_RUN.finditer(part)}
    mean = sum(e - s for e, s in runs.items()) / max(1, len(runs))
    gaps: list[tuple[int, float, bool]] = []  # end, log-odds, whether an opening word follows
    for e, s in runs.items():
        run = part[s:e]
        length = e - s if e - s >= UNPUNCTUATED or (e - s >= SPARSE and mean >= SPARSE) else 0
        prior = 2 * math.log2(length / SPARSE) - 4 if length else -20.0  # between marks that stand close a gap without one ends nothing
        if model and model.weights:
            if length:
                gaps += [(s + a, 8.0, False) for a in model.ends(run)]
            continue
        words = words_of(run)
        for a, b in zip(words, words[1:]):
            odds, sign, word = prior, run[a - 1], run[a:b]
            if sign in FINAL_SIGNS:
                odds += (3 if sign in WEAK_FINALS else 5) - (6 if word in FINAL_SIGNS else 0)
            if word in OPENING_SIGNS:
                odds += 2.5 if word in WEAK_OPENERS else 3.5
            gaps.append((s + a, odds, word in OPENING_SIGNS and sign not in FINAL_SIGNS))
    ends, at, sentence = [], 0, 0  # the last end, and the last one by a mark
    for e, odds, opener in sorted([*gaps, *((e, 8.0, False) for e in marks)]):
        if e in marks:
            inside = part[sentence:e]
            if sum(map(inside.count, "“「『")) > sum(map(inside.count, "”」』")):
                odds -= 20  # within a quotation
            elif part[e - 1] in "”」』" and SAYING_SIGNS.match(part[e:]) and not _INTRODUCED.search(inside):
                odds -= 20  # its verb of saying follows
        elif opener and e - at <= 8:
            odds -= 4
        if odds > 0:
            ends.append(e)
            at = e
            sentence = e if e in marks else sentence
    return ends


def _danda(part: str) -> list[int]:
    """End offsets by the cheapest path through the lattice of terminators of a paragraph in Devanagari."""
    nodes = []
    for m in _DANDA.finditer(part):
        mark, end = m.group(), m.end()
        while end < len(part) and part[end] in "”’»)\"":
            end += 1
        odds = 6.0 if mark[0] in "।॥" or mark.startswith("||") else 5.0
        short = _SHORT_INDIC.search(part, max(0, m.start() - 4), m.start()) if mark == "." else None
        if short and short.group() not in SHORT_WORDS:
            odds = -5.0  # one syllable and a full stop: an abbreviation
        elif end > m.end() and part[end : end + 8].lstrip().startswith("इति"):
            odds = -6.0  # the mark of quotation follows
        nodes.append((end, odds))
    return _path(part, nodes)


def _doubt(part: str, m: regex.Match, end: int) -> float | None:
    """Log-odds that a terminator ends a sentence; None where it can't."""
    mark = m.group()
    before = part[max(0, m.start() - 30) : m.start()].rstrip(_IGNORED)
    if mark[0] in ";；\u037e":
        if not _AFTER_GREEK.search(before[-8:]):
            return None
    rest = part[end : end + 60].lstrip(_BLANKS)
    nxt = _NEXT.match(rest)
    if not nxt:
        return 6.0
    word = "".join(c for c in nxt.group(1) if c not in _IGNORED)
    opens = rest[0] in OPEN or rest[0] in "\"(“"
    small = word[0].islower() and not opens
    greek = "Ͱ" <= word[0] <= "Ͽ" or "ἀ" <= word[0] <= "῿"
    closed = part[m.end() : end].strip(_IGNORED)
    closes = any(c in CLOSE + "“\"" for c in closed)
    if closes and word.casefold() in SAYING:
        return -6.0
    if mark.startswith(("..", "…", "．．")):
        return -6.0 if small else 4.0
    if mark[0] in ".．":
        token = _TOKEN.search(before)
        token = "".join(c for c in token.group() if c not in _IGNORED).strip(".").casefold() if token else ""
        last = _NUMBER.search(before)
        if last and not token and not closed:
            if word.casefold() in MONTHS or word[0].isdigit():
                return -6.0
            if len(last.group(1)) <= 2 and small:
                return -4.0
        if word[0].isdigit() and token in BEFORE:
            return -6.0
        if token and not closes and not closed:
            first = regex.search(r"(\p{L})$", before)
            if len(token) == 1 and first and first.group(1).isupper():
                return -5.0 if not small else -6.0
            if len(token) == 1 and first and first.group(1).islower() and token not in ENDING and not greek:
                return -5.0  # one letter of an abbreviation in several
            cited = _CITED.search(before)
            if cited and cited.group(1).casefold() in BEFORE:
                return -4.0  # a short name after "cf." is itself cut short
            if token in ENDING:
                return -6.0 if small else 4.0
            if token in BEFORE:
                return -6.0 if small or word[0].isdigit() else -3.0
        if small and not greek:
            return -6.0
        return 5.0 if not small else 4.0
    if small and not greek:
        return -5.0
    return 5.0


def _spaced(part: str) -> list[int]:
    """End offsets by the cheapest path through the lattice of terminators."""
    nodes: list[tuple[int, float]] = []
    for m in _TERMINATOR.finditer(part):
        end = m.end()
        tail = _TAIL.match(part, end)
        end = tail.end()
        # opening marks belong to what follows
        while end > m.end() and (part[end - 1] in "«„‘‚(" or (part[end - 1] == "“" and part.count("„", 0, end) <= part.count("“", 0, end - 1))):
            end -= 1
        if end < len(part) and not part[end].isspace() and part[end] not in OPEN + "(":
            glued = part[end].isupper() and regex.search(r"\p{Ll}{3}$", part[: m.start()])
            if not glued and (m.group()[0] in ".．;…" or not part[end].isupper()):
                continue
        odds = _doubt(part, m, end)
        if odds is not None and (not nodes or nodes[-1][0] != end):
            nodes.append((end, odds))
    return _path(part, nodes)


def _path(part: str, nodes: list[tuple[int, float]]) -> list[int]:
    """End offsets of the sentences on the cheapest path through (end, log-odds) of terminators; any number of them may lie in one sentence."""
    n = len(nodes)
    level, deep, at = [0] * (n + 1), [], 0
    marks = [(m.start(), m.group()) for m in _LEVEL.finditer(part)]
    for k, (e, _) in enumerate(nodes):
        while at < len(marks) and marks[at][0] < e:
            c = marks[at][1]
            if c in "«(„" or (c == "“" and not deep):
                deep.append(k + 1)
            elif deep:
                deep.pop()
            at += 1
        level[k + 1] = len(deep)
    for _, c in marks[at:]:
        if deep and c not in "«(„":
            deep.pop()
    for k in deep:  # a mark that is never closed holds nothing together
        level[k:] = [x - 1 for x in level[k:]]
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    skipped, least, origin = 0.0, 0.0, 0  # log-odds of all terminators up to here; the lowest cost less them, and where it is
    for j in range(1, n + 1):
        odds = nodes[j - 1][1]
        best[j], back[j] = least + skipped - odds + (20.0 if level[j] > 0 else 0.0), origin
        skipped += max(0.0, odds)
        if best[j] - skipped <= least:
            least, origin = best[j] - skipped, j
    ends = []
    while origin:
        ends.append(nodes[origin - 1][0])
        origin = back[origin]
    return ends[::-1]


def sentences(text: str, model: Gaps | None = None) -> list[tuple[int, int]]:
    """(start, end) of the units in characters from 0; white space around a unit doesn't belong to it."""
    out = []
    at = 0
    for gap in [*((m.start(), m.end()) for m in _BLANK.finditer(text)), (len(text), len(text))]:
        part = text[at : gap[0]]
        han = len(_HAN.findall(part))
        letters = len(regex.findall(r"\p{L}", part))
        if han * 2 > letters:
            ends = _spaceless(part, model)
        elif len(regex.findall(r"[ऀ-ॿ]", part)) * 2 > letters:
            ends = _danda(part)
        else:
            ends = _spaced(part)
        s = 0
        for e in [*ends, len(part)]:
            unit = part[s:e]
            bare = unit.strip().strip(_IGNORED)
            if regex.search(r"[\p{L}\p{N}]", bare):
                lead = len(unit) - len(unit.lstrip())
                out.append((at + s + lead, at + s + len(unit.rstrip())))
            elif bare and out and out[-1][1] > at:
                out[-1] = (out[-1][0], at + s + len(unit.rstrip()))  # a stray mark stays with what it closes
            s = e
        at = gap[1]
    return out


def places(text: str, model: Gaps | None = None) -> list[tuple[int, int]]:
    """(start, end) of the units of a text that may be garbled in places: boundaries are found in the restored text and carried back."""
    if not suspect(text):
        return sentences(text, model)
    ends = list(range(1, len(text) + 1))
    plain, spans, _, _ = repairer().repair(text, ends)
    if not spans or plain == text:
        return sentences(text, model)
    out = []
    for s, e in sentences(plain, model):
        begin = ends[s - 1] if s else 0
        out.append((begin + len(text[begin : ends[e - 1]]) - len(text[begin : ends[e - 1]].lstrip()), ends[e - 1]))
    return out


def learn(df: DataFrame, text: str) -> Gaps:
    """Words and gaps of spaceless scripts from all texts."""
    return fit_all(df.select(F.col(text).alias("t")))


def split_sentences(df: DataFrame, key: str, text: str, model: Gaps | None = None) -> DataFrame:
    """(key, sentence_no, start_pos, end_pos, sentence): positions count characters from 1, both ends belong to the sentence.

    Null, empty and blank texts give no row; repeated rows give repeated units. Each row is handled alone, whole; no shuffle. The `model` (see `learn`;
    some hundred KB, whatever the input) is broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, s + 1, e, t[s:e]) for k, t in zip(b["k"], b["t"]) if isinstance(t, str) for n, (s, e) in enumerate(places(t, held.value))]
            yield pd.DataFrame(rows, columns=[key, "sentence_no", "start_pos", "end_pos", "sentence"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, sentence_no int, start_pos long, end_pos long, sentence string")
