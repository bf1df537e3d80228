"""Find and undo text that was decoded with a wrong character encoding.

The garbled form of every expected character is computed beforehand for each pair of encodings (right one, wrong one) and all forms
go into one Aho-Corasick automaton. A single scan of a text yields the matched spans; only they are replaced, so correct text beside
them is left as it is. The scan is repeated for text that was garbled twice. A pair of single-byte encodings turns letters into other
letters; there the automaton's patterns are all letters of the wrong form, a run of them is judged by letter frequencies.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 bytes are commonly read in by mistake (fixed values).
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "koi8-r", "cp866", "iso8859-7", "iso8859-15", "cp737")
#: Single-byte encodings of one script that are taken for another (right, wrong) (fixed values).
SINGLE = (
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("iso8859-5", "cp1251"), ("cp1251", "mac_roman"), ("cp1253", "cp1252"), ("iso8859-7", "latin-1"), ("cp1253", "mac_roman"), ("cp737", "cp1253"), ("cp1253", "cp1251"), ("iso8859-7", "cp1251"), ("cp1251", "cp1253"),
)
#: Letters in order of falling frequency in running text (fixed values).
FREQUENT = {"CYRILLIC": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", "GREEK": "αοιετσνηυρπκμλςωδγχθφβξζψάόέίήύώϊϋΐΰ"}
#: Punctuation outside ASCII that correct text uses (fixed values).
PUNCTUATION = set("«»·–—―‘’“”„‚…¡¿§©°ʹ†‡•№     ​‌‍⁠﻿­、。，！？：；（）《》「」『』｜．")
#: Accented Latin letters of the languages at hand (fixed values).
LATIN = "äöüßÄÖÜéèêàâîïçùûôœæñáíóúìòëÀÉÈÇÁÍÓÚÑŒÙÎÂÊÔÆËÏÛ"
#: Double-byte encodings of ideographs, and the single-byte ones they are taken for (fixed values).
DOUBLE, DOUBLE_WRONG = ("gb18030", "big5"), ("cp1252", "latin-1")
OPENING, CLOSING = "“„«‘\"'‚‹「『(", "”“»’\"'‘›」』)"
ROUNDS = 3
#: Letters of a run that prove a pair of single-byte encodings by themselves; in a run of words that can't be words as they are; shorter runs follow a proven pair.
PROVEN, SHORT = 8, 5
_LETTERS, _LOST = regex.compile(r"\p{L}+"), regex.compile(r"[�\u0080-\u0084\u0086-\u009f]+")
#: What is left of a quotation mark, dash or capital umlaut of which the control characters went missing: letters where no word of the languages has them.
_BARE = regex.compile(r"(?<![\p{L}\p{M}])â(?=\p{Lu}|\s|$)|(?<=[\p{L}\p{M}\p{P}])â(?=[\x00-\x40\x5b-\x60\x7b-\x7f]|$)|(?<=\p{Ll})Ã(?![\p{Lu}\u0080-\u00bf])|(?<!\p{L})Ã(?=\p{Ll})(?![\u0080-\u00bf])")
_ACCENTED = regex.compile(r"[\u0080-\u00ff\u0152-\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{6,}")

#: Characters and neighbours that may be garbled or spelt with look-alikes, as classes of characters; texts without any need no restoring.
_ODD = (
    r"[\u0080-\u009f�­​-‏⁠﻿  -  ０-９Ａ-Ｚａ-ｚ̀-ͅ─-╿ﬀ-ﬆ]",
    r"[άέήίόύώ]",
)
_ODD_PAIRS = (
    (r"[ÂÃÄÅÎÏÐÑØÙâãäåæçŒœ√¬‚┬├ΞΟΒΓРС]", r"[^\x00-\x7fÀ-ÿͰ-Ͽἀ-῿Ѐ-џ«»“”„’‘…–—·ʹऀ-ॿ一-鿿]"),
    (r"[ÂÃÎÏÐÑà-å]", r"[¡-¿]"),
    (r"[ΞΟΒΓ]", r"[¡-¶¸-º¼-¿‚†‡•΄-Ώ]"),
    (r"[а-я]", r"[А-Я]"),
    (r"[a-zA-Z]", r"[Ͱ-Ͽἀ-῿Ѐ-ӿ]"),
    (r"[Ͱ-Ͽἀ-῿Ѐ-ӿ]", r"[a-zA-Z]"),
    (r"[α-ω]", r"[Α-Ω]"),
    (r"[α-ω]", r"[Ѐ-ӿ]"),
    (r"[РС]", r"[ -º¼-¿‚†‡•]"),
)
_ODD_THREE = r"[À-ÿ]"
_PLANE = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))


def _bits(classes) -> np.ndarray:
    """For every character of the first plane a bit for each class that holds it."""
    out = np.zeros(0x10000, dtype=np.uint32)
    for k, x in enumerate(classes):
        out[[ord(c) for c in re.findall(x, _PLANE)]] |= np.uint32(1 << k)
    return out


_ALONE, _FIRST, _SECOND, _THREE = _bits(_ODD) > 0, _bits(x for x, _ in _ODD_PAIRS), _bits(x for _, x in _ODD_PAIRS), _bits([_ODD_THREE]) > 0

_LETTER = np.zeros(0x10000, dtype=bool)
_LETTER[[ord(c) for c in _PLANE if c.isalpha()]] = True


def suspect(text: str) -> bool:
    """Whether a text may be garbled or spelt with look-alikes somewhere: its characters and pairs of neighbours are looked up in tables."""
    if text.isascii():
        return False
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    if c.max() > 0xFFFF:
        c = np.where(c > 0xFFFF, np.uint32(0x20), c)
    if _ALONE[c].any() or (_FIRST[c[:-1]] & _SECOND[c[1:]]).any():
        return True
    three = _THREE[c]
    return bool((three[:-2] & three[1:-1] & three[2:]).any())


def _decode(raw: bytes, wrong: str) -> str:
    """As lenient decoders do: a byte without a meaning becomes the control character of its number."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _expected() -> list[str]:
    """Characters that garbled text may stand for: letters and marks of the scripts at hand and typographic signs."""
    spans = ((0x100, 0x180), (0x386, 0x3CF), (0x1F00, 0x1FFF), (0x401, 0x402), (0x410, 0x452), (0x900, 0x980), (0x300, 0x315), (0x3001, 0x3003), (0xFF01, 0xFF20))
    letters = [chr(c) for a, b in spans for c in range(a, b) if unicodedata.name(chr(c), "")]
    twice = [_decode(bytes([b]), "cp1252") for b in range(0x80, 0x100)]  # what a first garbling leaves
    return [*dict.fromkeys([*letters, *LATIN, *"«»·–—―‘’“”„‚…¡¿§©°ʹ´¨®º ª€†½", *twice])]


def _ordinary(ch: str) -> bool:
    o = ord(ch)
    if o < 128 or ch in PUNCTUATION or ch in LATIN:
        return True
    return 0x386 <= o <= 0x3CE or 0x1F00 <= o <= 0x1FFF or 0x400 <= o <= 0x45F or 0x900 <= o <= 0x97F or 0x3400 <= o <= 0x9FFF or 0x300 <= o <= 0x345


def _native(ch: str) -> bool:
    """A letter of a script that the wrong encodings share with ordinary text."""
    return ord(ch) < 128 or 0x370 <= ord(ch) < 0x460


class Repairer:
    def __init__(self):
        self.means: dict[str, dict[str, str]] = {}
        self.shape: dict[str, bool] = {}
        for wrong in WRONG:
            for ch in _expected():
                raw = ch.encode("utf-8")
                forms = {_decode(raw, wrong)}
                forms.add("".join("�" if 0x80 <= ord(c) <= 0x9F else c for c in next(iter(forms))))  # control characters lost on the way
                for form in forms:
                    if len(form) > 1 and any(ord(c) > 127 for c in form) and not set(form) <= {"�"}:
                        self.means.setdefault(form, {}).setdefault(wrong, ch if "�" not in form else "�")
            for lead in range(0xE3, 0xEA):  # the ideographs: their first two bytes, the third is read from the text
                for second in range(0x80, 0xC0):
                    form = _decode(bytes([lead, second]), wrong)
                    self.means.setdefault(form + "\0", {})[wrong] = ""
        self.automaton = ahocorasick.Automaton()
        for form in self.means:
            bare = form.rstrip("\0")
            self.automaton.add_word(bare, (len(bare), self.means.get(bare), self.means.get(bare + "\0")))
        self.automaton.make_automaton()
        self.third = {w: {_decode(bytes([b]), w): b for b in range(0x80, 0xC0)} for w in WRONG}
        self.back = {w: {_decode(bytes([b]), w): b for b in range(0x80, 0x100)} for w in WRONG}
        self.single, self.letters_of = [], []
        for right, wrong in SINGLE:
            table: dict[str, str] = {}
            for b in range(0x80, 0x100):
                try:
                    table[bytes([b]).decode(wrong)] = bytes([b]).decode(right)
                except UnicodeDecodeError:
                    continue
            script = "CYRILLIC" if right in ("cp1251", "koi8-r", "cp866", "iso8859-5") else "GREEK"
            keys = "".join(regex.escape(k) for k, v in table.items() if v.isalpha() and unicodedata.name(v).startswith(script))
            kinds = np.zeros(0x10000, dtype=bool)
            kinds[[ord(k) for k, v in table.items() if v.isalpha() and unicodedata.name(v).startswith(script)]] = True
            self.letters_of.append(kinds)
            self.single.append((right, wrong, str.maketrans(table), regex.compile(f"(?<![\\p{{L}}])[{keys}]+(?![\\p{{L}}])(?:[ ,.!?|]{{1,3}}[{keys}]+(?![\\p{{L}}]))*+")))
        cases = "[а-яё][А-Я]|[А-Я]{4}|[α-ω][Α-Ω]|[Α-Ω]{4}"
        self.cases, self.accents = regex.compile(cases), regex.compile("[\u0080-\u00ff]{3}")
        self.score = {}
        for script, order in FREQUENT.items():
            for k, ch in enumerate(order):
                self.score[ch] = -math.log(1 + k)

    def spans(self, text: str) -> list[tuple[int, int, str, str, bool]]:
        """(start, end, restored, wrong encoding, proven) of the matches, leftmost and longest first, without overlap."""
        found: list[tuple[int, int, dict[str, str]]] = []
        for end, (n, whole, prefix) in self.automaton.iter(text):
            start = end + 1 - n
            if prefix:
                for wrong in prefix:
                    if end + 1 < len(text) and text[end + 1] in self.third[wrong]:
                        back = self.back[wrong]
                        try:
                            ch = bytes([back[c] for c in text[start : end + 2]]).decode("utf-8")
                        except (KeyError, UnicodeDecodeError):
                            continue
                        if 0x4E00 <= ord(ch) <= 0x9FFF:
                            found.append((start, end + 2, {wrong: ch}))
            if whole:
                found.append((start, end + 1, whole))
        if not found:
            return []
        found.sort(key=lambda x: (x[0], -x[1]))
        chosen, at = [], 0
        for s, e, m in found:
            if s >= at:
                chosen.append((s, e, m))
                at = e
        shape = self.shape
        votes: dict[str, int] = {}
        for s, e, m in chosen:
            seq = text[s:e]
            if seq not in shape:
                if len(shape) > 100_000:
                    shape.clear()
                shape[seq] = not all(map(_ordinary, seq))
            if shape[seq] or e - s > 2:
                for w in m:
                    votes[w] = votes.get(w, 0) + 1
        order = {w: (n, -WRONG.index(w)) for w, n in votes.items()}
        none = {w: (0, -k) for k, w in enumerate(WRONG)}
        order = none | order
        out = []
        for s, e, m in chosen:
            wrong = next(iter(m)) if len(m) == 1 else max(m, key=order.__getitem__)
            seq = text[s:e]
            odd = shape[seq]
            out.append((s, e, m[wrong], wrong, odd or not (seq[0].isspace() or _native(seq[0]) or seq.isalpha())))
        return out

    def letters(self, text: str) -> list[tuple[int, int, str, str, bool]]:
        """Runs of words that become regular words of another script or case when read in the right single-byte encoding."""
        best: dict[int, tuple] = {}
        cases, accents = self.cases.search(text), self.accents.search(text)
        if not (cases or accents):
            return []
        code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        code = np.where(code > 0xFFFF, np.uint32(0x20), code)
        word = np.r_[False, _LETTER[code], False]
        starts, stops = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        held: list[tuple] = []  # short runs, which count where another place has proven their pair

        def judge(k: int, start: int, end: int, run: str, size: int, needed: int) -> None:
            right, wrong, table, _ = self.single[k]
            new = run.translate(table)
            words, old = _LETTERS.findall(new), _LETTERS.findall(run)
            if sum(w.islower() or w.istitle() for w in words) < 0.9 * len(words):
                return
            before = sum(w.islower() or w.istitle() for w in old) / max(1, len(old))
            value = self._mean(new)
            gain = value - self._mean(run)
            if value < -2.5 or gain < (0.25 if len(words) > 2 else 0.5) or (before > 0.5 and not gain > 0.9):
                return
            if size < needed and (before or not gain > 0.9):
                held.append((k, start, end, run, size))
            elif start not in best or best[start][0] < value:
                best[start] = (value, (start, end, new, f"{right} as {wrong}", True))

        for k, ((_, wrong, _, runs), kinds) in enumerate(zip(self.single, self.letters_of)):
            if not (accents if wrong in ("cp1252", "latin-1", "mac_roman") else cases):
                continue
            total = np.r_[0, np.cumsum(kinds[code])]
            inside = total[stops] - total[starts]
            if inside[inside == stops - starts].sum() < SHORT:  # words wholly of such letters
                continue
            for m in runs.finditer(text):
                size = sum(map(str.isalpha, m.group()))
                if size >= SHORT:
                    judge(k, m.start(), m.end(), m.group(), size, PROVEN)
                elif size > 1:
                    held.append((k, m.start(), m.end(), m.group(), size))
        proven = {x[1][3] for x in best.values()}
        for k, start, end, run, size in held[:] if proven else ():
            if f"{self.single[k][0]} as {self.single[k][1]}" in proven:
                judge(k, start, end, run, size, 0)
        out, at = [], 0
        for _, span in sorted(best.values(), key=lambda x: x[1][0]):
            if span[0] >= at:
                out.append(span)
                at = span[1]
        return out

    def readings(self, line: str) -> Iterator[str]:
        """The line as it would read under each pair of single-byte encodings: for callers that know what to expect."""
        for _, _, table, _ in self.single:
            new = line.translate(table)
            if new != line:
                yield new

    def ideographs(self, text: str) -> list[tuple[int, int, str, str, bool]]:
        """Runs of accented letters and signs that are common ideographs in a double-byte encoding."""
        best: dict[int, tuple] = {}
        for m in _ACCENTED.finditer(text):
            for wrong in DOUBLE_WRONG:
                back, run = self.back[wrong], m.group()
                if not all(c in back for c in run):
                    continue
                raw = bytes(back[c] for c in run)
                if len(raw.decode("utf-8", "ignore")) > len(raw) / 5:
                    continue
                for right in DOUBLE:
                    try:
                        new = raw.decode(right)
                    except UnicodeDecodeError:
                        try:
                            new = raw[:-1].decode(right) + run[-1]
                        except UnicodeDecodeError:
                            continue
                    common = sum(0x4E00 <= ord(c) <= 0x9FFF and b"\xb0" <= c.encode("gb18030")[:1] <= b"\xd7" for c in new)
                    if common >= 0.75 * len(new) and m.start() not in best:
                        best[m.start()] = (0, (m.start(), m.end(), new, f"{right} as {wrong}", True))
        return [span for _, span in best.values()]

    def _mean(self, text: str) -> float:
        marks = [self.score.get(c, -3.6) for c in text.lower() if c.isalpha()]
        return sum(marks) / max(1, len(marks))

    @staticmethod
    def quoted(text: str, s: int, e: int) -> bool:
        """The span alone stands between quotation marks: it is shown, not used."""
        return s > 0 and e < len(text) and text[s - 1] in OPENING and text[e] in CLOSING

    def repair(self, text: str, ends: list[int] | None = None) -> tuple[str, int, bool, str]:
        """The restored text, the number of proven spans, whether characters are lost, the wrong encodings seen.

        `ends`, if given, holds where each character of the text ends; it is changed along with the text, so that it still tells for each
        character of the restored text where the garbled one ended.
        """
        if text.isascii():
            return text, 0, False, ""
        proven, seen = 0, set()
        for turn in range(ROUNDS):
            if turn and not suspect(text):
                break
            spans = self.spans(text)
            if sum(x[1] - x[0] for x in spans if x[4]) * 2 < len(text) - len(text.encode("ascii", "ignore")):  # else they explain most of what isn't ASCII
                spans = self.letters(text) or spans
            if not any(x[4] for x in spans) or (self.accents.search(text) and sum(x[4] for x in spans) * 12 < len(text)):
                spans = self.ideographs(text) or spans
            sure = {x[3] for x in spans if x[4] and not self.quoted(text, x[0], x[1])}
            if not sure:
                break
            groups: list[list] = []
            for sp in spans:
                lead = text[sp[0]]
                if not sp[4] and sp[3] in sure and not lead.isspace() and not (_native(lead) and lead.islower()):
                    sp = (*sp[:4], True)
                if groups and groups[-1][-1][1] == sp[0]:
                    groups[-1].append(sp)
                else:
                    groups.append([sp])
            parts, at, changed = [], 0, 0
            marks: list[int] = []
            for g in groups:
                s, e = g[0][0], g[-1][1]
                if not any(x[4] for x in g) or self.quoted(text, s, e):
                    continue
                parts += [text[at:s], *(x[2] for x in g)]
                if ends is not None:
                    marks += ends[at:s]
                    for x in g:
                        # a span as long as its restored form keeps its places
                        marks += ends[x[0] : x[1]] if len(x[2]) == x[1] - x[0] else [ends[x[1] - 1]] * len(x[2])
                at, changed = e, changed + 1
                seen |= {x[3] for x in g}
            if not changed:
                break
            proven += changed
            if ends is not None:
                ends[:] = marks + ends[at:]
            text = "".join([*parts, text[at:]])
        lost = 0
        if "â" in text or "Ã" in text:
            # which sign it was can't be told but from where it stands; the places of the others don't move
            bare = [m.start() for m in _BARE.finditer(text) if not self.quoted(text, m.start(), m.end())]
            lost = len(bare)
            if bare:
                signs = list(text)
                for k in bare:
                    if signs[k] == "â":
                        after = text[k + 1 : k + 2]
                        signs[k] = "–" if (k == 0 or text[k - 1].isspace()) and (after.isspace() or not after) else "“" if after.isalpha() else "”"
                text = "".join(signs)
        for m in _LOST.finditer(text):
            lost += not self.quoted(text, m.start(), m.end())
        return text, proven + lost, lost > 0, ",".join(sorted(seen))


_REPAIRER: list[Repairer] = []


def repairer() -> Repairer:
    if not _REPAIRER:
        _REPAIRER.append(Repairer())
    return _REPAIRER[0]


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, spans, lossy, encodings), one row for each row of the input.

    Null text gives null restored and 0 spans; empty text stays empty. Rows are handled one by one, so repeated rows and ties come out
    as they went in; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repairer().repair
        for b in batches:
            rows = [fix(x) if isinstance(x, str) else (None, 0, False, "") for x in b["t"]]
            out = pd.DataFrame(rows, columns=["restored", "spans", "lossy", "encodings"], index=b.index)
            out.insert(0, key, b["k"])
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, restored string, spans int, lossy boolean, encodings string")
