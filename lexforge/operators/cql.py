"""Token-sequence queries: [lemma="x" & upos!="VERB"] []{0,2} "form" within s, compiled to column expressions.

A query is read into a list of steps (predicate, least, most). Where few lengths are possible, its fixed-length variants become windows of `lead` over a
sentence, all in one pass over the tokens: one shuffle by sentence, no join. Repetition without an upper bound, or with many variants, runs as an
automaton over the sentence's array of step truths, which the JVM has computed. A sentence is bounded, so a window partition is as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Attribute names of the query language by column (fixed values).
ATTRIBUTES = {"word": "form", "form": "form", "lemma": "lemma", "pos": "upos", "tag": "upos", "upos": "upos", "deprel": "deprel", "rel": "deprel"}
#: Beyond so many tokens or variants of a query the automaton takes over from the windows; both give the same rows.
LONGEST, VARIANTS = 12, 64
#: Steps of a query whose truths fit into one number for each token.
MOST_STEPS = 62
_LEX = re.compile(r'\s*(?:(?P<str>"(?:\\.|[^"\\])*")|(?P<re>/(?:\\.|[^/\\])*/)|(?P<num>\d+)|(?P<id>[^\W\d][\w.\-]*)|(?P<op>!=|[\[\]{}(),&|!=?*+]))')


class QueryError(ValueError):
    """A query that can't be read; the message says where."""


@dataclass
class Test:
    attribute: str
    value: str
    regex: bool
    negated: bool

    def column(self, token: Column, ignore_case: bool = True) -> Column:
        name = ATTRIBUTES.get(self.attribute.lower())
        value = token.getField(name) if name else F.try_element_at(F.str_to_map(token.getField("feats"), F.lit("[|]"), F.lit("=")), F.lit(self.attribute))
        if self.regex:
            hit = value.rlike(f"{'(?iu)' if ignore_case else ''}^(?:{self.value})$")
        elif ignore_case and name in ("form", "lemma"):
            hit = F.lower(value) == self.value.lower()
        else:
            hit = value == self.value
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if self.negated else hit


@dataclass
class Junction:
    any: bool
    parts: list = field(default_factory=list)
    negated: bool = False

    def column(self, token: Column) -> Column:
        if not self.parts:
            out = F.lit(True)
        else:
            columns = [p.column(token) for p in self.parts]
            out = columns[0]
            for c in columns[1:]:
                out = (out | c) if self.any else (out & c)
        return ~out if self.negated else out


@dataclass
class Step:
    test: Junction
    least: int = 1
    most: int | None = 1  # None: any number


def lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(f"unreadable at {at}: {query[at:at + 10]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Reader:
    def __init__(self, query: str):
        self.items, self.at = lex(query), 0

    def peek(self) -> tuple[str, str] | tuple[None, None]:
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def take(self, text: str | None = None) -> tuple[str, str]:
        kind, value = self.peek()
        if kind is None or (text is not None and value != text):
            raise QueryError(f"expected {text or 'more'}, found {value!r}")
        self.at += 1
        return kind, value

    def value(self) -> tuple[str, bool]:
        kind, text = self.take()
        if kind == "re":
            return text[1:-1].replace("\\/", "/"), True
        if kind == "str":
            plain = re.sub(r"\\(.)", r"\1", text[1:-1])
            # a quoted value with signs of a pattern is one, as corpus users write it
            return (text[1:-1], True) if re.search(r"(?<!\\)[.*+?|\[\](){}^$]", text[1:-1]) else (plain, False)
        raise QueryError(f"expected a value, found {text!r}")

    def condition(self):
        kind, text = self.peek()
        if text == "!":
            self.take()
            inner = self.condition()
            inner.negated = not inner.negated
            return inner
        if text == "(":
            self.take()
            inner = self.disjunction()
            self.take(")")
            return inner
        kind, name = self.take()
        if kind != "id":
            raise QueryError(f"expected an attribute, found {name!r}")
        _, op = self.take()
        if op not in ("=", "!="):
            raise QueryError(f"expected = or !=, found {op!r}")
        value, regex = self.value()
        return Test(name, value, regex, op == "!=")

    def conjunction(self) -> Junction:
        parts = [self.condition()]
        while self.peek()[1] == "&":
            self.take()
            parts.append(self.condition())
        return Junction(False, parts)

    def disjunction(self) -> Junction:
        parts = [self.conjunction()]
        while self.peek()[1] == "|":
            self.take()
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Junction(True, parts)

    def step(self) -> Step:
        kind, text = self.peek()
        if text == "[":
            self.take()
            test = Junction(False) if self.peek()[1] == "]" else self.disjunction()
            self.take("]")
        elif kind in ("str", "re"):
            value, regex = self.value()
            test = Junction(False, [Test("word", value, regex, False)])
        else:
            raise QueryError(f"expected a token, found {text!r}")
        step = Step(test)
        _, text = self.peek()
        if text in ("?", "*", "+"):
            self.take()
            step.least, step.most = (0, 1) if text == "?" else (0 if text == "*" else 1, None)
        elif text == "{":
            self.take()
            step.least = int(self.take()[1])
            step.most = step.least
            if self.peek()[1] == ",":
                self.take()
                step.most = int(self.take()[1]) if self.peek()[0] == "num" else None
            self.take("}")
        if step.most is not None and (step.most < step.least or step.most == 0):
            raise QueryError(f"repetition {step.least}..{step.most} is out of range")
        return step


def parse(query: str) -> list[Step]:
    """The steps of a query; `within s` is what every query means and may be written."""
    r = _Reader(query)
    steps = []
    while r.peek()[0] is not None:
        if r.peek()[1] in ("within", "containing"):
            r.take()
            if r.peek()[1] == "<":
                r.take()
            if r.take()[1] not in ("s", "sentence"):
                raise QueryError("only sentences can be asked for with within")
            continue
        steps.append(r.step())
    if not steps or all(s.least == 0 for s in steps):
        raise QueryError("a query must ask for one token at least")
    return steps


def _closure(steps: list[Step], at: int) -> list[int]:
    """The steps that may come next from the beginning of step `at`; len(steps) is the end."""
    out = [at]
    while at < len(steps) and steps[at].least == 0:
        at += 1
        out.append(at)
    return out


def spans(steps: list[Step], truths: list[int]) -> list[tuple[int, int]]:
    """(first, length) of every place where the steps hold, from each token's truths (bit i for step i)."""
    end, out = len(steps), []
    begin = [(i, 0) for i in _closure(steps, 0) if i < end]
    for first in range(len(truths)):
        states = set(begin)
        for at in range(first, len(truths)):
            new: set[tuple[int, int]] = set()
            for i, n in states:
                if truths[at] >> i & 1:
                    step = steps[i]
                    if step.most is None:
                        n = min(n + 1, max(step.least, 1))  # further repetitions change nothing
                        new.add((i, n))
                    else:
                        n += 1
                        if n < step.most:
                            new.add((i, n))
                    if n >= step.least:
                        new.update((k, 0) for k in _closure(steps, i + 1))
            if (end, 0) in new:
                out.append((first, at - first + 1))
                new.discard((end, 0))
            if not new:
                break
            states = new
    return out


def _automaton(tokens: DataFrame, steps: list[Step]) -> DataFrame:
    if len(steps) > MOST_STEPS:
        raise QueryError(f"more than {MOST_STEPS} steps")
    token = F.struct("form", "lemma", "upos", "deprel", "feats")
    truths = sum((F.when(step.test.column(token), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, step in enumerate(steps)), F.lit(0).cast("long"))
    base = tokens.select("document_id", "sentence_id", F.struct("token_index", "form", truths.alias("truths")).alias("t"))
    rows = base.groupBy("sentence_id").agg(F.min("document_id").alias("document_id"), F.sort_array(F.collect_list("t")).alias("t"))
    rows = rows.select("document_id", "sentence_id", *[F.col(f"t.{c}").alias(c) for c in ("token_index", "form", "truths")])

    def run(batches):
        for b in batches:
            found = []
            for doc, sentence, index, form, bits in zip(b["document_id"], b["sentence_id"], b["token_index"], b["form"], b["truths"]):
                for first, n in spans(steps, [int(x) for x in bits]):
                    found.append((doc, sentence, int(index[first]), n, " ".join(x for x in form[first : first + n] if x is not None)))
            yield pd.DataFrame(found, columns=["document_id", "sentence_id", "start", "length", "matched"])

    kind = {c: tokens.schema[c].dataType.simpleString() for c in ("document_id", "sentence_id", "token_index")}
    return rows.mapInPandas(run, f"document_id {kind['document_id']}, sentence_id {kind['sentence_id']}, start {kind['token_index']}, length int, matched string")


def search(tokens: DataFrame, query: str) -> DataFrame:
    """(document_id, sentence_id, start, length, matched): every place where the query holds; `matched` are the forms.

    A shorter and a longer match at one place are both reported; repetition has no upper limit but the sentence. Null attributes match nothing but a
    negation. Extra columns don't matter.
    """
    steps = parse(query)
    count = 1
    for step in steps:
        count *= 99_999 if step.most is None else step.most - step.least + 1
    if count > VARIANTS or sum(step.most for step in steps) > LONGEST:
        return _automaton(tokens, steps)
    variants = sorted({tuple(i for i, n in enumerate(c) for _ in range(n)) for c in product(*[range(s.least, s.most + 1) for s in steps])}, key=lambda v: (len(v), v))
    variants = [v for v in variants if v]
    w = W.partitionBy("sentence_id").orderBy("token_index")
    token = F.struct("form", "lemma", "upos", "deprel", "feats")
    used = sorted({i for v in variants for i in v})
    # each step's truth for each token once, then shifted
    base = tokens.select("document_id", "sentence_id", "token_index", "form", *[steps[i].test.column(token).alias(f"s{i}") for i in used])
    longest = max(map(len, variants))
    shifted = base
    if longest > 1:
        flags = F.struct(*[F.col(f"s{i}") for i in used], F.col("form").alias("form"))
        shifted = base.select("*", *[F.lead(flags, k).over(w).alias(f"n{k}") for k in range(1, longest)])

    def holds(v) -> Column:
        out = F.lit(True)
        for k, i in enumerate(v):
            c = F.col(f"s{i}") if k == 0 else F.coalesce(F.col(f"n{k}").getField(f"s{i}"), F.lit(False))
            out = out & c
        return out

    lengths = sorted({len(v) for v in variants})
    hits = []
    for n in lengths:
        test = None
        for v in variants:
            if len(v) == n:
                test = holds(v) if test is None else test | holds(v)
        forms = [F.col("form"), *[F.col(f"n{k}").getField("form") for k in range(1, n)]]
        hits.append(F.when(test, F.struct(F.lit(n).alias("length"), F.concat_ws(" ", *forms).alias("matched"))))
    found = shifted.select("document_id", "sentence_id", F.col("token_index").alias("start"), F.explode(F.array_compact(F.array(*hits))).alias("m"))
    return found.select("document_id", "sentence_id", "start", "m.length", "m.matched")


def simple_search(tokens: DataFrame, word: str, ignore_case: bool = True) -> DataFrame:
    """Form or lemma equal to a word."""
    if ignore_case:
        hit = (F.lower("form") == word.lower()) | (F.lower("lemma") == word.lower())
    else:
        hit = (F.col("form") == word) | (F.col("lemma") == word)
    return tokens.where(hit).select("document_id", "sentence_id", F.col("token_index").alias("start"), F.lit(1).alias("length"), F.col("form").alias("matched"))


def find(tokens: DataFrame, query: str) -> DataFrame:
    """Token-sequence query where brackets stand, plain word else."""
    return search(tokens, query) if "[" in query else simple_search(tokens, query)


def concordance(hits: DataFrame, sentences: DataFrame, width: int = 50) -> DataFrame:
    """Keyword in context: up to `width` characters on either side of the match's first form in the sentence; hits whose form isn't found
    in the text are left out."""
    j = hits.join(sentences.select("sentence_id", "text"), "sentence_id")
    at = F.expr("locate(lower(substring_index(matched, ' ', 1)), lower(text))")
    j = j.withColumn("_at", at).where("_at > 0")
    size = F.length("matched")
    left = F.expr(f"trim(substring(text, greatest(_at - {width}, 1), _at - greatest(_at - {width}, 1)))")
    right = F.expr(f"trim(substring(text, _at + length(matched), {width}))")
    return j.select("document_id", "sentence_id", "start", left.alias("left_context"), F.col("matched").alias("keyword"), right.alias("right_context"), size.alias("size"))
