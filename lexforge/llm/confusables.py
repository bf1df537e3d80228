"""One consistent form for text that looks alike but is stored in other characters.

Each letter has the set of scripts it can be read in (its own and those with a look-alike). The sets of a word are intersected: an
empty own-script intersection marks a mixed word, a word whose every letter has a look-alike in the script of its neighbours is a
whole-script confusable. The word is respelled in the consistent script. Remaining forms are normalised: composed letters, plain
spaces, no invisible characters, no width or ligature variants.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.mojibake import repairer

#: Look-alike letters, Latin Greek Cyrillic Armenian Cherokee Lisu, - where a script has none (fixed values).
ALIKE = """
A Α А - Ꭺ ꓮ|B Β В - Ᏼ ꓐ|C Ϲ С - Ꮯ ꓚ|E Ε Е - Ꭼ ꓰ|H Η Н - Ꮋ ꓧ|I Ι І - - ꓲ|J Ϳ Ј - Ꭻ ꓙ|K Κ К - Ꮶ ꓗ|M Μ М - Ꮇ ꓟ|N Ν - - - ꓠ|O Ο О Օ - ꓳ|P Ρ Р - Ꮲ ꓑ|S - Ѕ Տ Ꮪ ꓢ|T Τ Т - Ꭲ ꓔ|X Χ Х - - ꓫ|Y Υ У - Ꭹ ꓬ|Z Ζ - - Ꮓ ꓜ|- Γ Г - - -|- Π П - - -|- Φ Ф - - -|- Λ Л - - -
a α а - - -|c ϲ с - - -|e - е - - -|i ι і - - -|j ϳ ј յ - -|k κ к - - -|o ο о օ - -|p ρ р - - -|s - ѕ - - -|u υ - ս - -|v ν ѵ - - -|x χ х - - -|y γ у - - -|n η - ո - -|w ω ѡ - - -|h - һ հ - -|d - ԁ - - -|q - ԛ զ - -|- τ т - - -|- π п - - -|- φ ф - - -
D - - - Ꭰ ꓓ|F - - - - ꓝ|G - - - Ꮐ ꓖ|L - - Լ Ꮮ ꓡ|R - - - Ꭱ ꓣ|U - - Ս - ꓴ|V - - - Ꮩ ꓦ|W - - - Ꮤ ꓪ|l - ӏ - - -|I - Ӏ - - -|g - - ց - -
"""
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "LISU")
#: Look-alikes so near that a word made of them alone counts when its neighbours are of the other script (fixed values).
NEAR = set("ABCEHIJKMNOPSTXYZaceijopsxyuvΑΒΕΗΙΚΜΝΟΡΤΥΧΖαινορυχγϲАВЕКМНОРСТУХІЈЅаеорсухіјѕӏӀ")
INVISIBLE = "​‌‍⁠﻿­‎‏؜᠎⁡⁢⁣⁤"
SPACES = "              "
VIRAMA = "्"
_ROMAN = regex.compile(r"[IVXLCDM]+")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_HAN = regex.compile(r"\p{Han}")


def _tables():
    to: dict[str, dict[str, str]] = {}
    for row in ALIKE.strip().replace("\n", "|").split("|"):
        row = dict(zip(SCRIPTS, row.split()))
        for a, x in row.items():
            for b, y in row.items():
                if a != b and x != "-" and y != "-":
                    to.setdefault(x, {}).setdefault(b, y)
    return to


TO = _tables()
NEAR |= {x for x in TO if unicodedata.name(x).split(" ", 1)[0] in ("ARMENIAN", "CHEROKEE", "LISU")}


def script(ch: str) -> str | None:
    """LATIN, GREEK, CYRILLIC, or another script's name; None for what belongs to any script."""
    if not ch.isalpha() or ch in "ʹʺʼªºµ":
        return None
    name = unicodedata.name(ch, "")
    head = name.split(" ", 1)[0]
    return None if head in ("MODIFIER", "FEMININE", "MASCULINE", "MICRO", "FULLWIDTH", "IDEOGRAPHIC", "") else head


_SEEN: dict[str, tuple[str | None, str]] = {}


def _letter(ch: str) -> tuple[str | None, str]:
    """Script of a letter and its base letter without accents."""
    if ch not in _SEEN:
        _SEEN[ch] = (script(ch), unicodedata.normalize("NFD", ch)[0])
    return _SEEN[ch]


def resolved(word: str) -> set[str]:
    """The scripts that a whole word can be read in: the intersection of its letters' script sets, each a letter's own script and those with a look-alike."""
    out: set[str] | None = None
    for ch in word:
        own, base = _letter(ch)
        if own is not None:
            can = {own, *TO.get(base, ())}
            out = can if out is None else out & can
    return out or set()


def _respell(word: str, target: str) -> str | None:
    """The word in the target script, or None where a letter has no look-alike there."""
    out = []
    for ch in word:
        s, base = _letter(ch)
        if s is None or s == target:
            out.append(ch)
        elif target in TO.get(base, {}):
            out.append(TO[base][target] + unicodedata.normalize("NFD", ch)[1:])
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


def _compatible(text: str) -> str:
    """Width, ligature and font variants replaced; full-width punctuation stays beside ideographs."""
    out = []
    han = None
    for k, ch in enumerate(text):
        o = ord(ch)
        if o < 0x2000 and o != 0xB5 and not 0x132 <= o <= 0x133 and not 0x1C4 <= o <= 0x1F3:
            out.append(ch)
            continue
        kind = unicodedata.decomposition(ch)
        if kind.startswith(("<wide>", "<narrow>", "<font>", "<compat>")):
            plain = unicodedata.normalize("NFKC", ch)
            if 0xFF00 <= o <= 0xFF5E and not ch.isalnum():
                if han is None:
                    han = sum(1 for _ in _HAN.finditer(text)) * 4 > len(text)
                near = text[max(0, k - 3) : k + 4]
                if (han or _HAN.search(near)) and ch in "，！？：；（）～、｛｝［］％＂＇":
                    out.append(ch)
                    continue
            if plain.isalnum() or 0xFF00 <= o <= 0xFF5E:
                out.append(plain)
                continue
        out.append(ch)
    return "".join(out)


_SIGNS = r"\x00-\x40\x5B-\x60\x7B-\x7E“”„‘’‚«»…–—―¡¿§©·°"
#: Lines of one script in ordinary characters: nothing in them can be mixed, confusable or in another form.
_CLEAN = regex.compile(
    rf"[{_SIGNS}A-Za-zÀ-ÖØ-öø-ÿŒœŸ]*+|[{_SIGNS}Ά-ΈΉ-ώἀ-ὰὲὴὶὸὺὼᾀ-ᾺᾼῂῃῄῆῇῈῊῌῐ-ῒῖ-Ὶῠ-ῢῤ-ῪῬῲῳῴῶῷῸῺῼ]*+"
    rf"|[{_SIGNS}Ѐ-џ]*+|[{_SIGNS}ऀ-ॗॠ-ॿ]*+|[{_SIGNS}一-鿿　-〿，！？：；（）]*+"
)


def normalise(text: str, context: str | None = None) -> tuple[str, int]:
    """The consistent form of a text and the number of its places that were stored otherwise.

    `context` names the script of the surroundings for a text of one word.
    """
    out, changes = [], 0
    for line in text.split("\n"):
        if context is None and _CLEAN.fullmatch(line):
            out.append(line)
        else:
            new, n = _line(line, context)
            out.append(new)
            changes += n
    return "\n".join(out), changes


_SURE: dict[str, str | None] = {}


def _sure(word: str) -> str | None:
    """The script that a word stands for beyond doubt: it has letters of no other, and not only such as have look-alikes. Words met are kept."""
    if word not in _SURE:
        if len(_SURE) > 200_000:
            _SURE.clear()
        count = _scripts(word)
        only = next(iter(count)) if len(count) == 1 else None
        _SURE[word] = only if only and not all(_letter(c)[0] is None or _letter(c)[1] in NEAR for c in word) else None
    return _SURE[word]


_UNSEEN = regex.compile(f"[{INVISIBLE}{SPACES}]")
#: Characters that _compatible may replace.
_VARIANT = regex.compile("[" + "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000)]) if unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<font>", "<compat>"))) + "]")
_COUNTS: dict[str, Counter] = {}


def _scripts(word: str) -> Counter:
    """How many letters of a word belong to each script; counts of words met are kept."""
    got = _COUNTS.get(word)
    if got is None:
        if len(_COUNTS) > 200_000:
            _COUNTS.clear()
        got = _COUNTS[word] = Counter(s for c in word if (s := _letter(c)[0]))
    return got


def _line(text: str, context: str | None) -> tuple[str, int]:
    changes = 0
    if _UNSEEN.search(text):
        kept = []
        for k, ch in enumerate(text):
            if ch in INVISIBLE and not (ch in "‌‍" and k and text[k - 1] == VIRAMA):
                changes += 1
            elif ch in SPACES:
                kept.append(" ")
                changes += 1
            else:
                kept.append(ch)
        text = "".join(kept)
    new = unicodedata.normalize("NFC", text)
    if new != text:
        changes, text = changes + 1, new
    if _VARIANT.search(text):
        new = _compatible(text)
        if new != text:
            changes, text = changes + 1, new
    out, at = [], 0
    words = [(m.start(), m.group(), _scripts(m.group())) for m in _WORD.finditer(text)]
    sure = [_sure(w) for _, w, _ in words]
    for k, (s, w, count) in enumerate(words):
        if sure[k]:
            continue
        spelt = None
        end = s + len(w)
        if len(count) > 1:
            order = [x for x, _ in count.most_common() if x in SCRIPTS]
            firm = Counter(_letter(c)[0] for c in w if _letter(c)[0] in SCRIPTS and _letter(c)[1] not in NEAR)
            order.sort(key=lambda x: (-firm[x], -count[x]))
            can = resolved(w)  # no own script is in all sets' own part: the word is mixed; what is in all sets is how it can be read
            spelt = next((r for x in order if x in can and (r := _respell(w, x)) and r != w), None)
            if spelt is None and len(order) > 1:
                spelt = w  # mixed without a consistent spelling: counted, left as it is
                changes += 1
                continue
        elif len(count) == 1 and sure[k] is None:
            own = next(iter(count))
            if own in SCRIPTS:
                before = next((x for x in reversed(sure[:k]) if x), None)
                after = next((x for x in sure[k + 1 :] if x), None)
                around = {x for x in (before, after) if x} or ({context} if context else set())
                if len(around) == 1 and own not in around and (target := next(iter(around))) in SCRIPTS:
                    follows = text[end : end + 1]
                    numeral = own == "LATIN" and _ROMAN.fullmatch(w) or follows == "ʹ"
                    short = len(w) < 3 and follows == "."
                    if not numeral and not short:
                        spelt = _respell(w, target)
        if spelt and spelt != w:
            out += [text[at:s], spelt]
            at = end
            changes += 1
    return "".join([*out, text[at:]]), changes


_DAMAGED = regex.compile(r"[\u0080-\u009f\ufffd]")


def _beside_repairs(text: str, restored: str, spans: int) -> tuple[str, int]:
    """The consistent form of a restored text; where characters were wrongly decoded, only lines without such damage count."""
    new, n = normalise(restored)
    if not spans or not n:
        return new, n
    old = text.split("\n")
    lines = restored.split("\n")
    if len(old) != len(lines):
        return new, 0
    return new, sum(normalise(a)[1] for a, b in zip(old, lines) if a == b and not _DAMAGED.search(a) and not repairer().repair(a)[1])


def consistent(df: DataFrame, key: str, text: str, context: str | None = None) -> DataFrame:
    """(key, consistent, changes): the consistent form of each text, and how many places were stored in other characters.

    Characters that come from a wrong encoding are restored first and don't count. `context` is a column whose script a one-word text
    should have (the form beside a lemma). Null text gives null and 0, empty text stays empty; each row is handled alone, so repeated
    rows give repeated results. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = repairer().repair
        memory: dict[tuple, tuple] = {}
        for b in batches:
            rows = []
            for t, c in zip(b["t"], b["c"]):
                if not isinstance(t, str):
                    rows.append((None, 0))
                    continue
                if context is not None:
                    if (t, c) not in memory:
                        if len(memory) > 200_000:
                            memory.clear()
                        around = None
                        if isinstance(c, str):
                            seen = Counter(s for ch in c if (s := _letter(ch)[0]))
                            around = next(iter(seen)) if len(seen) == 1 else None
                        memory[(t, c)] = normalise(t, around)
                    rows.append(memory[(t, c)])
                elif t.isascii():
                    rows.append((t, 0))
                else:
                    rows.append(_beside_repairs(t, *fix(t)[:2]))
            out = pd.DataFrame(rows, columns=["consistent", "changes"], index=b.index)
            out.insert(0, key, b["k"])
            yield out

    kind = df.schema[key].dataType.simpleString()
    other = F.col(context) if context else F.lit(None).cast("string")
    return df.select(F.col(key).alias("k"), F.col(text).alias("t"), other.alias("c")).mapInPandas(run, f"`{key}` {kind}, consistent string, changes int")


#: Words of one script in composed letters; anything else goes to the full test (a bound for the JVM, not the decision itself).
_ONE = {
    "LATIN": r"[\x20-\x7EÀ-ÖØ-öø-ÿŒœ]*",
    "GREEK": r"[\x20-\x40Ά-ώἀ-ὰὲὴὶὸὺὼᾀ-Ὰᾼᾲ-ῈῊῌῐ-ῒῖ-Ὶῠῡῢῤ-ῪῬῲ-ῸῺῼ]*",
    "CYRILLIC": r"[\x20-\x40Ѐ-џ]*",
    "DEVANAGARI": r"[\x20-\x40ऀ-ॗॠ-ॿ]*",
    "HAN": r"[\x20-\x40一-鿿　-〿，？！：；（）]*",
}


def worth_a_look(text: str, context: str):
    """A JVM-side condition that holds for every (word, form) pair that `normalise` could change."""
    same = F.lit(False)
    for pattern in _ONE.values():
        same = same | (F.col(text).rlike(f"^{pattern}$") & F.col(context).rlike(f"^{pattern}$"))
    return F.col(text).isNotNull() & ~F.coalesce(same, F.lit(False))
