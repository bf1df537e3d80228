"""Readers of treebank, corpus and training formats; every one gives a DataFrame and reads its files in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "sentence_id string, token_index long, form string, lemma string, upos string, xpos string, feats string, head long, deprel string, misc string"


def _blank(c):
    return F.when(c != "_", c)


def parse_conllu(texts: DataFrame, column: str = "value", record: str | None = None) -> DataFrame:
    """Tokens of CoNLL-U texts: ten tab-separated columns, a blank line ends a sentence; ranges, empty nodes and lines of another shape are
    passed over. Columns as in TOKEN, and sentence_text from `# text`. A sentence without `# sent_id` has a null id;
    `block_no` tells it from others of its text, or with `record` (a number for each text) from all others."""
    own = F.col(record) if record else F.lit(None)
    blocks = texts.select(own.alias("r"), F.posexplode(F.split(F.regexp_replace(column, r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("block_no", "b"))
    lines = blocks.select(
        F.nullif(F.regexp_extract("b", r"(?m)^#\s*sent_id\s*=\s*(.*)$", 1), F.lit("")).alias("sentence_id"), F.nullif(F.regexp_extract("b", r"(?m)^#\s*text\s*=\s*(.*)$", 1), F.lit("")).alias("sentence_text"),
        (F.xxhash64("r", "block_no") if record else F.col("block_no").cast("long")).alias("block_no"), F.explode(F.split("b", "\n")).alias("line"),
    )
    cells = lines.where(~F.col("line").startswith("#")).withColumn("c", F.split("line", "\t")).where("size(c) = 10").where(F.col("c")[0].rlike(r"^\d+$"))
    c = lambda k: F.col("c")[k]
    return cells.select(
        "sentence_id", "block_no", c(0).cast("long").alias("token_index"), c(1).alias("form"), _blank(c(2)).alias("lemma"), _blank(c(3)).alias("upos"), _blank(c(4)).alias("xpos"), _blank(c(5)).alias("feats"),
        F.expr("try_cast(c[6] as bigint)").alias("head"), _blank(c(7)).alias("deprel"), _blank(c(9)).alias("misc"), "sentence_text",
    )


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """Files of CoNLL-U. The record separator is the blank line, so a large file is split, not held whole (but for one with carriage returns)."""
    return parse_conllu(spark.read.option("lineSep", "\n\n").text(path).withColumn("_r", F.monotonically_increasing_id()), record="_r")


#: Parts of speech of the PROIEL scheme (fixed values).
PROIEL_POS = {
    "V-": "VERB", "Nb": "NOUN", "Ne": "PROPN", "A-": "ADJ", "Df": "ADV", "Dq": "ADV", "Du": "ADV", "R-": "ADP", "C-": "CCONJ", "G-": "SCONJ", "S-": "DET", "Pp": "PRON", "Pk": "PRON", "Ps": "DET", "Pd": "DET", "Pi": "PRON", "Pr": "PRON",
    "Px": "PRON", "Pc": "PRON", "Ma": "NUM", "Mo": "ADJ", "I-": "INTJ", "N-": "PART", "X-": "PUNCT", "F-": "X",
}
#: Values of the ten positions of a morphology tag (fixed values).
PROIEL_MORPH = (
    ("Person", {"1": "1", "2": "2", "3": "3"}), ("Number", {"s": "Sing", "d": "Dual", "p": "Plur"}), ("Tense", {"p": "Pres", "i": "Imp", "a": "Past", "f": "Fut", "r": "Perf", "l": "Pqp", "t": "FutPerf", "u": "Past"}),
    ("Mood", {"i": "Ind", "s": "Sub", "m": "Imp", "o": "Opt", "n": "Inf", "p": "Part", "d": "Ger", "g": "Gdv", "u": "Sup"}), ("Voice", {"a": "Act", "m": "Mid", "p": "Pass", "e": "Mid"}), ("Gender", {"m": "Masc", "f": "Fem", "n": "Neut"}),
    ("Case", {"n": "Nom", "a": "Acc", "g": "Gen", "d": "Dat", "b": "Abl", "v": "Voc", "l": "Loc", "i": "Ins"}), ("Degree", {"p": "Pos", "c": "Cmp", "s": "Sup"}), ("Strength", {"w": "Weak", "s": "Strong"}), ("Inflection", {"i": "Infl", "n": "Non"}),
)
#: Values of the nine positions of the other packed tag, part of speech first (fixed values).
AGDT_POS = {"n": "NOUN", "v": "VERB", "a": "ADJ", "d": "ADV", "l": "DET", "g": "PART", "c": "CCONJ", "r": "ADP", "p": "PRON", "m": "NUM", "i": "INTJ", "u": "PUNCT", "x": "X"}
AGDT_MORPH = (
    ("Person", {"1": "1", "2": "2", "3": "3"}), ("Number", {"s": "Sing", "d": "Dual", "p": "Plur"}), ("Tense", {"p": "Pres", "i": "Imp", "r": "Perf", "l": "Pqp", "t": "FutPerf", "f": "Fut", "a": "Past"}),
    ("Mood", {"i": "Ind", "s": "Sub", "o": "Opt", "n": "Inf", "m": "Imp", "p": "Part"}), ("Voice", {"a": "Act", "p": "Pass", "m": "Mid", "e": "Mid"}), ("Gender", {"m": "Masc", "f": "Fem", "n": "Neut"}),
    ("Case", {"n": "Nom", "g": "Gen", "d": "Dat", "a": "Acc", "b": "Abl", "v": "Voc", "l": "Loc"}), ("Degree", {"p": "Pos", "c": "Cmp", "s": "Sup"}),
)


def _map(values: dict[str, str], key):
    return F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), key)


def decode_tag(tag, scheme, first: int = 1):
    """Features of a packed tag, one position a feature, `K=V` joined by bars in order of their names; null without any."""
    parts = [F.concat(F.lit(f"{name}="), _map(values, F.substring(tag, first + k, 1))) for k, (name, values) in enumerate(scheme)]
    return F.nullif(F.array_join(F.array_sort(F.array_compact(F.array(*parts))), "|"), F.lit(""))


def encode_tag(feats, scheme):
    """The packed tag of features; a position without a value is a hyphen."""
    m = F.str_to_map(F.coalesce(feats, F.lit("")), F.lit("[|]"), F.lit("="))
    return F.concat(*[F.coalesce(_map({v: k for k, v in reversed(values.items())}, F.try_element_at(m, F.lit(name))), F.lit("-")) for name, values in scheme])


def _xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).option("mode", "DROPMALFORMED").schema(schema).load(path)


_PROIEL = "_id string, token array<struct<_id: string, _form: string, _lemma: string, `_part-of-speech`: string, _morphology: string, _postag: string, `_head-id`: string, _relation: string>>"


def _proiel_tokens(s: DataFrame) -> DataFrame:
    t = s.select(F.col("_id").alias("sentence_id"), F.posexplode("token").alias("p", "t")).where("t._form is not null")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9]+)$', 1) as bigint)")
    own = F.col("t.`_part-of-speech`")  # a code without a meaning is an X
    pos = F.coalesce(_map(PROIEL_POS, own), F.when(own.isNotNull(), "X"), _map(AGDT_POS, F.substring("t._postag", 1, 1)))
    feats = F.coalesce(decode_tag(F.col("t._morphology"), PROIEL_MORPH), decode_tag(F.col("t._postag"), AGDT_MORPH, 2))
    return t.select(
        "sentence_id", F.coalesce(number("t._id"), (F.col("p") + 1).cast("long")).alias("token_index"), F.col("t._form").alias("form"), F.col("t._lemma").alias("lemma"), pos.alias("upos"), F.coalesce("t._morphology", "t._postag").alias("xpos"), feats.alias("feats"),
        F.coalesce(number("t.`_head-id`"), F.lit(0)).alias("head"), F.col("t._relation").alias("deprel"),
    )


def proiel(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of PROIEL XML files. Ids may be numbers or words with a number ("t12"); both tag dialects (part-of-speech with morphology, postag) are read."""
    return _proiel_tokens(_xml(spark, path, "sentence", _PROIEL))


def parse_proiel(sentences: DataFrame, column: str = "xml") -> DataFrame:
    """Tokens of single sentence elements in a column."""
    return _proiel_tokens(sentences.select(F.from_xml(column, _PROIEL).alias("s")).select("s.*"))


def agdt(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of dependency-treebank XML with `word` elements and nine-place tags."""
    s = _xml(spark, path, "sentence", "_id string, word array<struct<_id: string, _form: string, _lemma: string, _postag: string, _head: string, _relation: string>>")
    t = s.select(F.col("_id").alias("sentence_id"), F.explode("word").alias("t"))
    return t.select(
        "sentence_id", F.expr("try_cast(t._id as bigint)").alias("token_index"), F.col("t._form").alias("form"), F.col("t._lemma").alias("lemma"), _map(AGDT_POS, F.substring("t._postag", 1, 1)).alias("upos"), F.col("t._postag").alias("xpos"),
        decode_tag(F.col("t._postag"), AGDT_MORPH, 2).alias("feats"), F.coalesce(F.expr("try_cast(t._head as bigint)"), F.lit(0)).alias("head"), F.lower("t._relation").alias("deprel"),
    )


def tei(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(id, path, title, author, text) of TEI files with at least `least` characters of body text; the id is a digest of the path."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("x"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    part = lambda tag: F.nullif(plain(F.regexp_extract("x", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    body = plain(F.regexp_extract("x", r"(?s)<body[^>]*>(.*)</body>", 1))
    out = raw.select(F.substring(F.md5("path"), 1, 12).alias("id"), "path", part("title").alias("title"), part("author").alias("author"), body.alias("text"))
    return out.where(F.length("text") >= least)


def morphgnt(spark: SparkSession, path: str) -> DataFrame:
    """(ref, upos, parse, text, word, normalized, lemma) of lines with seven fields or more."""
    c = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where("size(c) >= 7")
    return c.select(*[F.col("c")[k].alias(n) for k, n in enumerate(("ref", "upos", "parse", "text", "word", "normalized", "lemma"))])


#: Marks that begin and end the text of a Gutenberg file (fixed values).
GUTENBERG_START = r"(?s)^.*?\*\*\* ?START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\n"
GUTENBERG_END = r"(?s)\*\*\* ?END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*$"


def gutenberg_text(c):
    """The text between the first start mark, whose line goes too, and the first end mark."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, GUTENBERG_START, ""), GUTENBERG_END, ""), r"^\s+|\s+$", "")


def labelled_csv(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).csv(path).select(F.col(text).alias("text"), F.col(label).alias("label")).where("text is not null and label is not null")


def labelled_directories(spark: SparkSession, path: str) -> DataFrame:
    """Text files whose folder is their label."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("value").alias("text"), F.element_at(F.split(F.input_file_name(), "/"), -2).alias("label"))


def labelled_xml(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "document", "_label string, text string").select("text", F.col("_label").alias("label")).where("text is not null")


def external_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON files: a list, an object with `items`, or one object; trimmed, with a word count and real booleans."""
    x = spark.read.option("multiLine", True).json(path)
    if "items" in x.columns:
        x = x.select(F.explode("items").alias("i")).select("i.*")
    for c, kind in x.dtypes:
        if kind == "string":
            x = x.withColumn(c, F.trim(c))
        if c.startswith("is_"):
            x = x.withColumn(c, F.lower(F.col(c).cast("string")).isin("1", "true", "yes", "y"))
    if "content" in x.columns and "word_count" not in x.columns:
        x = x.withColumn("word_count", F.when(F.coalesce(F.length("content"), F.lit(0)) > 0, F.size(F.split("content", r"\s+"))).otherwise(0))
    return x


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip or plain, with a given schema."""
    return spark.read.schema(schema).json(path)
