"""Normal forms of texts by language, signs of damage, quality, and the plain sentence splitters: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions import text as tx

#: Signs that a language's normal form replaces (fixed values).
GREEK_SIGNS = (("«", '"'), ("»", '"'), ("·", ";"), ("᾽", "'"), ("᾿", "'"))
ENGLISH_SIGNS = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"))
MACRONS = (("ā", "a"), ("ē", "e"), ("ī", "i"), ("ō", "o"), ("ū", "u"))
#: Bounds of the quality score (fixed values).
SHORTEST, LONGEST, FEWEST_WORDS = 50, 10_000, 10
MARK = "\u0001"


def _replace(c: Column, signs) -> Column:
    for old, new in signs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def without_line_numbers(c: Column) -> Column:
    """Numbers at a line's beginning, bare or in brackets, and lone numbers between blanks go."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^[ \t\r\n\f]*[\[(]?[0-9]+[\])]?[ \t\r\n\f]*", ""), r"[ \t\r\n\f]+[0-9]+[ \t\r\n\f]+", " ")


def full(c: Column) -> Column:
    """The whole chain: composed letters, sigma, editorial marks, line numbers, white space."""
    return tx.collapse(without_line_numbers(tx.editorial_marks(tx.final_sigma(tx.nfc(c)))))


def by_language(c: Column, language: Column) -> Column:
    """Composed letters, no control characters but line breaks and tabs, single blanks, at most one empty line; then the signs of the language."""
    x = F.regexp_replace(tx.nfc(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\r\n?", "\n"), "\n{3,}", "\n\n")
    own = F.when(language.isin("grc", "el"), _replace(x, GREEK_SIGNS)).when(language == "la", _replace(x, MACRONS)).when(language == "en", _replace(x, ENGLISH_SIGNS))
    return F.trim(own.otherwise(x))


def damage(c: Column) -> Column:
    """(encoding, mixed_scripts, unusual): a question mark or replacement character, Greek beside Latin letters, and the number of signs from U+2001 to U+2FFF."""
    return F.struct(
        (c.contains("?") | c.contains("�")).alias("encoding"), (c.rlike(r"[\x{0370}-\x{03FF}]") & c.rlike("[A-Za-z]")).alias("mixed_scripts"),
        F.regexp_count(c, F.lit(r"[\x{2001}-\x{2FFF}]")).cast("long").alias("unusual"),
    )


def quality(c: Column) -> Column:
    """A score from 0 to 1: a product of penalties for length, few words, repetitive characters, markup and digits; 0 for a text that is null or too short."""
    n = F.length(c)
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != ""))
    variety = F.size(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("(?s)."), 0))) / n
    score = F.when(n > LONGEST, 0.8).otherwise(1.0) * F.when(words < FEWEST_WORDS, 0.5).otherwise(1.0)
    score = score * F.when(variety < 0.1, 0.3).when(variety < 0.3, 0.7).otherwise(1.0) * F.when(c.contains("<") & c.contains(">"), 0.6).otherwise(1.0)
    score = score * F.when(F.regexp_count(c, F.lit("[0-9]")) / n > 0.1, 0.7).otherwise(1.0)
    return F.when(c.isNull() | (n < SHORTEST), 0.0).otherwise(score)


def looks_like_text(c: Column) -> Column:
    """By the beginning of a download: no web page (but a page of a book collection), and a start mark or more than a thousand characters. The look at the
    first 2,000 characters is the feature."""
    head = F.lower(F.substring(c, 1, 2000))
    page = head.contains("<html") & ~head.contains("project gutenberg")
    return ~page & (head.contains("*** start of") | (F.length(F.trim(F.substring(c, 1, 2000))) > 1000))


def _pieces(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, MARK), lambda s: F.regexp_replace(s, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")), lambda s: s != "")


def split_behind(c: Column, marks: str = ".!?··;") -> Column:
    """Pieces cut at blanks behind one of the marks, which stay with what they end."""
    return _pieces(F.regexp_replace(c, rf"([{marks}])[ \t\r\n\f]+", "$1" + MARK))


def split_by_language(c: Column, language: Column) -> Column:
    """Greek and Latin end at more marks; elsewhere a capital must follow."""
    return F.when(language.isin("grc", "la"), split_behind(c, ".;:!?·")).otherwise(_pieces(F.regexp_replace(c, r"([.!?])[ \t\r\n\f]+([A-Z])", "$1" + MARK + "$2")))


def split_by_tokens(c: Column, enders: str = ".;·!?", abbreviations: tuple[str, ...] = ("κ", "δηλ", "πρβλ", "βλ", "cf", "fr", "cod", "vol", "p", "pp")) -> Column:
    """Pieces that end at a mark unless the word before it is an abbreviation."""
    short = "|".join(abbreviations)
    kept = F.regexp_replace(c, rf"(?<![\p{{L}}])({short})\.", "$1\u0002")
    return F.transform(_pieces(F.regexp_replace(kept, rf"([{enders}])", "$1" + MARK)), lambda s: F.replace(s, F.lit("\u0002"), F.lit(".")))
