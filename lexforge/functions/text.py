"""Text functions as column expressions; Python only where the JVM has no such function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Markup and its replacement, in this order (fixed values).
MARKUP = ((r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"<[^>]+>", " "), (r"\*\*([^*]+)\*\*", "$1"), (r"`([^`]+)`", "$1"))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_markup(c: Column) -> Column:
    for pattern, new in MARKUP:
        c = F.regexp_replace(c, pattern, new)
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return collapse(c)


def escape_xml(c: Column) -> Column:
    for sign, name in ESCAPES:
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def editorial_marks(c: Column) -> Column:
    """Brackets keep their content; daggers and asterisks go."""
    return collapse(F.regexp_replace(F.regexp_replace(c, r"[\[\]⟨⟩<>{}]", ""), r"[†‡*]", ""))


def line_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\s*\d+[.:)]?\s+", "")


def final_sigma(c: Column) -> Column:
    """Lunate sigma as sigma, final sigma at a word's end."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("ϲ"), F.lit("σ")), r"σ(?!\p{L})", "ς"), r"ς(?=\p{L})", "σ")


def greek_share(c: Column) -> Column:
    """Greek letters among letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]")) / letters).otherwise(0.0)


def words(c: Column) -> Column:
    """Runs of letters, marks and digits."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once: a lambda over an array of one element. Inside another lambda the value would be computed at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(c: Column, k: int) -> Column:
    """The distinct runs of k words of a text."""
    none = F.array().cast("array<string>")
    runs = lambda w: F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " ")))).otherwise(none)
    return let(F.split(collapse(F.lower(c)), " "), runs)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def without_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)), na_action="ignore")


def feature(feats: Column, name: str) -> Column:
    """One value of a K=V|K=V list; null without it."""
    return F.nullif(F.regexp_extract(feats, rf"(?:^|\|){name}=([^|]*)", 1), F.lit(""))


#: Letters of beta code, one for one (fixed values).
BETA, UNICODE = "abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω"
#: Blocks of pictographs (fixed values).
PICTOGRAPHS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE0F}]"


def beta_code(c: Column) -> Column:
    """Greek letters for the letters of beta code; other signs stay."""
    return final_sigma(F.translate(F.lower(c), BETA, UNICODE))


def without_pictographs(c: Column) -> Column:
    return F.regexp_replace(c, PICTOGRAPHS, "")


def newlines(c: Column) -> Column:
    """Line feeds only, no blanks at line ends, at most one empty line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")


def nonempty_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def digest(c: Column, size: int = 16) -> Column:
    """The first hexadecimal digits of the digest of a text without case and spacing."""
    return F.substring(F.md5(collapse(F.lower(c))), 1, size)


def domain(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://(?:www\.)?([^/:?#]+)", 1), F.lit(""))


@F.pandas_udf(StringType())
def monotonic(s: pd.Series) -> pd.Series:
    """Greek with one accent: breathings and iota subscript go, grave and circumflex become acute."""

    def one(x: str) -> str:
        out = []
        for c in unicodedata.normalize("NFD", x):
            if c in "̓̔ͅ":
                continue
            out.append("́" if c in "̀͂" else c)
        return unicodedata.normalize("NFC", "".join(out))

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def gunzip(s: pd.Series) -> pd.Series:
    """Text of gzip'd bytes."""
    import gzip

    return s.map(lambda b: gzip.decompress(b).decode("utf-8"), na_action="ignore")
