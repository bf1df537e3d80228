"""Rule-based text features: language by script, periods, stems, temporal expressions, discourse markers, morphology maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marker words and their functions (fixed values).
MARKERS = {
    "contrast": ("but", "however", "although", "aber", "doch", "mais", "cependant", "pero", "aunque", "sed", "ἀλλὰ", "δὲ"), "cause": ("because", "for", "since", "weil", "denn", "car", "porque", "quia", "nam", "γὰρ", "ὅτι"),
    "time": ("when", "while", "after", "before", "als", "während", "quand", "cuando", "dum", "ὅτε", "ἐπεὶ"), "result": ("therefore", "thus", "so", "deshalb", "donc", "entonces", "igitur", "οὖν"),
}
#: Forms of time expressions (fixed values).
TEMPORAL = {"century": r"\b\d{1,2}(?:st|nd|rd|th) century\b", "year_bc": r"\b\d{1,4} ?(?:BC|BCE)\b", "year_ad": r"\b(?:AD|CE) ?\d{1,4}\b", "year": r"\b1[0-9]{3}\b", "day": r"\b\d{1,2}\. [A-Z][a-zä]+ \d"}
#: Relations of the universal scheme and of the other (fixed values).
UD_TO_PROIEL = {"root": "pred", "nsubj": "sub", "csubj": "sub", "obj": "obj", "iobj": "obl", "obl": "obl", "advmod": "adv", "advcl": "adv", "amod": "atr", "nmod": "atr", "acl": "atr", "det": "aux", "case": "aux", "aux": "aux", "cop": "aux", "mark": "aux", "cc": "aux", "punct": "aux", "conj": "pred", "appos": "apos", "xcomp": "xobj", "ccomp": "comp", "vocative": "voc", "discourse": "adv", "parataxis": "parpred", "expl": "expl"}
#: Semantic roles by relation, case (fixed values).
ROLES = {"nsubj": "ARG0", "csubj": "ARG0", "obj": "ARG1", "iobj": "ARG2", "ccomp": "ARG1", "xcomp": "ARG1", "advmod": "ARGM-ADV"}
#: Endings of English words that a stem goes without, the longest first (fixed values).
ENDINGS = ("ations", "ation", "ments", "ment", "ness", "ings", "ing", "ies", "ed", "es", "ly", "s")


def language_by_script(c: Column) -> Column:
    """zh, sa, ru, grc, el or lat by the letters of a text; und without letters. Greek is ancient when a tenth of it is polytonic."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    letters, greek, poly = n(r"\p{L}"), n(r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]"), n(r"[\x{1F00}-\x{1FFF}]")
    half = letters / 2
    return (
        F.when(letters == 0, "und").when(n(r"[\x{4E00}-\x{9FFF}]") > half, "zh").when(n(r"[\x{0900}-\x{097F}]") > half, "sa").when(n(r"[\x{0400}-\x{04FF}]") > half, "ru")
        .when(greek > half, F.when(poly * 10 > greek, "grc").otherwise("el")).otherwise("lat")
    )


def marker_class(word: Column) -> Column:
    out = None
    for name, words in MARKERS.items():
        out = F.when(F.lower(word).isin(*words), name) if out is None else out.when(F.lower(word).isin(*words), name)
    return out


def stem(word: Column) -> Column:
    """The word without its longest known ending, if three letters remain."""
    w = F.lower(word)
    out = None
    for e in ENDINGS:
        test = w.endswith(e) & (F.length(w) >= len(e) + 3)
        cut = F.substring(w, F.lit(1), F.length(w) - len(e))
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return out.otherwise(w)


def period_of_year(year: Column) -> Column:
    """The period of a signed year, both ends included, the first that fits; null beyond them."""
    spans = (("archaic", -800, -500), ("classical", -500, -323), ("hellenistic", -323, -31), ("koine", -31, 330), ("medieval", 330, 1453), ("early_modern", 1453, 1830), ("modern", 1830, 2025))
    out = None
    for name, a, b in spans:
        out = F.when(year.between(a, b), name) if out is None else out.when(year.between(a, b), name)
    return out


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), key)
