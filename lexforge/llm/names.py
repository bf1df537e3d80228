"""Link the spellings of names typed by people: noisy-channel attribution to canonical forms.

Spellings are counted, read (titles off, family name found, organisation and place told apart) and blocked by the family name with one
letter left out, so that spellings one typing error apart meet. A candidate canonical form is worth its frequency (prior) times the likelihoods of the typing
errors, abbreviations, nicknames, reorderings and omissions that lead to the variant; each variant goes to its maximum posterior.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.runtime import cut

#: Stand-ins for an unknown person, folded (fixed values).
UNKNOWN = ("unknown", "anonymous", "anon", "n a", "na", "none", "null", "unbekannt", "inconnu", "anonymus", "anonyme", "desconocido", "sconosciuto", "αγνωστος", "неизвестен", "неизвестный", "various", "var", "s n", "nn", "n n", "unk", "not known", "tba", "author unknown", "佚名")
#: Titles before a name, folded (fixed values).
TITLES = {"dr", "prof", "professor", "rev", "reverend", "sir", "mr", "mrs", "ms", "miss", "fr", "st", "lady", "lord", "hon", "dame", "herr", "frau", "mme", "mlle", "don", "dona", "padre"}
#: Nicknames and short forms, folded: nickname, then the names it stands for (fixed values).
NICKNAMES = """
alex alexander alexandra alexandros|aleko alexandros alexander|anni anneliese anna|anne anneliese|liese anneliese|bart bartholome bartholomew|bartek bartholome|beppe giuseppe|pino giuseppe|peppe giuseppe
bill william|will william|billy william|liam william|bob robert|rob robert|bert robert|chuck charles|charlie charles|carl charles|fritz friedrich|fred friedrich frederick|hans johannes|jan johannes|hannes johannes
giannis ioannes ioannis|yannis ioannes ioannis|jette henriette|henni henriette|hetty henriette|kate katherine|kathy katherine|katie katherine|kitty katherine|kolya nikolai|nick nikolai nicholas|niko nikolai
kostas konstantinos|dinos konstantinos|costas konstantinos|lenio eleni|lena eleni|nitsa eleni|liesl elisabeth|lisa elisabeth|lisbeth elisabeth|beth elisabeth|betty elisabeth|limpia olympia|pia olympia|olya olympia
mitsos dimitrios|dimitris dimitrios|mimis dimitrios|paca francisca|paquita francisca|frasquita francisca|peggy margaret|maggie margaret|meg margaret|greta margaret|quino quirin|renzo lorenzo|enzo lorenzo
sukey susannah|susan susannah|sue susannah|susie susannah|takis panagiotis|panos panagiotis|thodoris theodoros|theo theodore theodoros|vasso vasiliki|vaso vasiliki|vicky vasiliki|uli ulrich|utz ulrich|zhenya yevgenia|genia yevgenia
zo zoe|zoi zoe|jim james|tom thomas|mike michael|joe joseph|tony anthony|ned edward|ted edward|harry henry|jack john|dick richard|sasha alexander alexandra|misha mikhail|vanya ivan|katya ekaterina|masha maria|pepe jose|paco francisco|lola dolores
"""
MEANS = {row.split()[0]: set(row.split()[1:]) for row in NICKNAMES.strip().replace("\n", "|").split("|")}
CONNECTORS = {"of", "for", "at", "the", "f", "in", "and", "de", "des", "du", "der", "fur", "von"}
#: Natural logarithms of the chances that a typed name differs in this way (fixed values).
CHANCE = {k: math.log(v) for k, v in {"same": 1, "initial": 0.05, "short": 0.05, "nickname": 0.06, "typo": 0.03, "order": 0.1, "omitted": 0.2, "added": 0.02, "acronym": 0.05}.items()}
#: Spellings of a block that one task pairs with its candidates.
HOT = 2000
#: Least posterior for a link, beside the chance that another bearer of so similar a name exists.
STRANGER = math.log(1e-6)


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def within_one(a: str, b: str) -> bool:
    """At most one letter inserted, dropped, changed or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def read(name: str) -> dict | None:
    """Kind, family name (or place), given names (or the words of the organisation) and whether the order is certain."""
    plain = fold(name).strip()
    bare = regex.sub(r"[^\p{L}\p{N}]+", " ", plain).strip()
    if not bare or bare in UNKNOWN or not regex.search(r"\p{L}", bare):
        return None
    tokens = regex.findall(r"[\p{L}\p{N}'’\-]+\.?", plain)
    words = [t.rstrip(".") for t in tokens]
    raw = regex.findall(r"[\p{L}\p{N}'’\-]+", unicodedata.normalize("NFC", name))
    connector = any(w in CONNECTORS for w in words[:-1] if len(w) > 1) or "(" in name
    # short words in capitals before a name in mixed case: an acronym with its place
    acronym = len(raw) == 2 and 2 <= len(raw[0]) <= 6 and raw[0].isupper() and not raw[1].isupper() and "." not in tokens[0] and "," not in name
    dotted = sum(t.endswith(".") and len(t) > 3 for t in tokens) >= 2
    if connector or acronym or dotted:
        if words[0] == "the":
            words, tokens = words[1:], tokens[1:]
        if acronym:
            place, rest = words[-1], words[:-1]
        elif "at" in words[1:-1]:
            k = len(words) - 1 - words[::-1].index("at")
            place, rest = " ".join(words[k + 1 :]), words[:k]
        elif regex.search(r"[(,]\s*[^(),]+\)?\s*$", plain):
            place, rest = words[-1], words[:-1]
        elif len(words) > 3 and words[1] in ("of", "for"):
            place, rest = words[-1], words[:-1]  # the word before the place is misspelt
        elif len(words) > 2 and "of" not in words[:2] and "for" not in words[:2]:
            place, rest = words[0], words[1:]
        else:
            place, rest = "", words
        return {"kind": "o", "family": place, "given": [w for w in rest if w not in CONNECTORS and not (1 < len(w) < 5 and any(within_one(w, x) for x in ("of", "for", "at")))], "sure": True}
    while len(words) > 1 and words[0] in TITLES:
        words, tokens = words[1:], tokens[1:]
    if "," in plain and len(words) > 1:
        n = len(regex.findall(r"[\p{L}\p{N}'’\-]+", plain.partition(",")[0]))
        return {"kind": "p", "family": " ".join(words[:n]), "given": words[n:], "sure": True}
    if len(words) == 1:
        return {"kind": "p", "family": words[0], "given": [], "sure": True}
    if all(len(w) == 1 for w in words[1:]) and len(words[0]) > 1:
        return {"kind": "p", "family": words[0], "given": words[1:], "sure": True}
    short = any(len(w) == 1 or (t.endswith(".") and len(w) < 6) for w, t in zip(words[:-1], tokens))
    return {"kind": "p", "family": words[-1], "given": words[:-1], "sure": short}


def _one(v: str, c: str) -> float:
    """Likelihood that a given name c was typed as v."""
    if v == c:
        return 0.0
    if len(v) == 1 or len(c) == 1:
        return CHANCE["initial"] if v[0] == c[0] else -math.inf
    if c in MEANS.get(v, ()) or v in MEANS.get(c, ()):
        return CHANCE["nickname"]
    if 2 < len(v) < 6 and c.startswith(v) or 2 < len(c) < 6 and v.startswith(c):
        return CHANCE["short"]
    if within_one(v, c):
        return CHANCE["typo"]
    if any(x != v and within_one(v, x) and c in m for x, m in MEANS.items() if len(x) > 3) or any(x != c and within_one(c, x) and v in m for x, m in MEANS.items() if len(x) > 3):
        return CHANCE["nickname"] + CHANCE["typo"]
    return -math.inf


def likelihood(kind: str, vf: str, vg: list[str], cf: str, cg: list[str]) -> float:
    """Log-likelihood of reading (family vf, given vg) when (cf, cg) was meant."""
    if not within_one(vf, cf):
        return -math.inf
    total = 0.0 if vf == cf else CHANCE["typo"]
    if kind == "o":
        if len(vg) == 1 and len(cg) > 1 and vg[0] == "".join(w[0] for w in cg) or len(cg) == 1 and len(vg) > 1 and cg[0] == "".join(w[0] for w in vg):
            return total + CHANCE["acronym"]
        if len(vg) != len(cg):
            return -math.inf
        for v, c in zip(vg, cg):
            if v != c:
                a, b = sorted((v, c), key=len)
                if b.startswith(a) or (a == "ms" and b == "manuscript"):
                    total += CHANCE["short"] / 3
                elif within_one(v, c):
                    total += CHANCE["typo"]
                else:
                    return -math.inf
        return total
    if not vg or not cg:
        return total + CHANCE["omitted"] * 3 if vg == cg else -math.inf
    total += _one(vg[0], cg[0])
    for k in range(1, max(len(vg), len(cg))):
        if k >= len(vg):
            total += CHANCE["omitted"]
        elif k >= len(cg):
            total += CHANCE["added"]
        else:
            total += _one(vg[k], cg[k])
    return total


def openings(kind: str, given: list[str]) -> list[str]:
    """Letters that the first given name may begin with in the spellings it can be linked to: its first two (one may be mistyped), and those of the
    names that a nickname, or a nickname with a typing error, stands for. Two spellings with a likelihood share one."""
    if not given:
        return [""]
    first = given[0]
    out = set(first[:2])
    if kind == "p" and len(first) > 1:
        for nick, names in MEANS.items():
            if nick == first or (len(nick) > 3 and within_one(first, nick)):
                out.update(x for name in names for x in name[:2])
    return sorted(out)


def _turned(names: DataFrame) -> DataFrame:
    """Settle the order of names like 'Family Given': the roles that their words have in all other spellings decide."""
    open_ = names.where((F.col("kind") == "p") & ~F.col("sure") & (F.size("given") > 0))
    ends = open_.select(F.explode(F.array(F.struct(F.col("given")[0].alias("w"), F.lit(1).alias("first")), F.struct(F.col("family").alias("w"), F.lit(0).alias("first")))).alias("x"))
    role = ends.groupBy("x.w").agg(F.sum("x.first").alias("first"), F.count("*").alias("all"))
    g = role.select(F.col("w").alias("_g"), F.col("first").alias("g_first"), F.col("all").alias("g_all"))
    f = role.select(F.col("w").alias("_f"), F.col("first").alias("f_first"), F.col("all").alias("f_all"))
    j = names.withColumn("_given", F.col("given")[0]).join(g, F.col("_given") == F.col("_g"), "left").join(f, F.col("family") == F.col("_f"), "left")
    looks = (F.col("f_first") > 0.8 * F.col("f_all")) & (F.col("f_all") >= 4) & ~((F.col("g_first") > 0.5 * F.col("g_all")) & (F.col("g_all") >= 4))
    turn = F.coalesce((F.col("kind") == "p") & ~F.col("sure") & (F.size("given") == 1) & looks, F.lit(False))
    # three words: the family name comes first, then its given names
    turn3 = F.coalesce((F.col("kind") == "p") & ~F.col("sure") & (F.size("given") > 1) & looks, F.lit(False))
    family = F.when(turn | turn3, F.col("given")[0]).otherwise(F.col("family"))
    given = F.when(turn, F.array("family")).when(turn3, F.concat(F.slice("given", 2, 9), F.array("family"))).otherwise(F.col("given"))
    return j.select("name", "n", "kind", family.alias("family"), given.alias("given"), "sure", (turn | turn3).alias("turned"))


def spellings(names: DataFrame, column: str = "name") -> DataFrame:
    """The distinct spellings with their readings: name, n, kind, family, given, sure, turned."""
    counted = names.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, n in zip(b["name"], b["n"]):
                r = read(name)
                if r:
                    rows.append((name, n, r["kind"], r["family"], r["given"], r["sure"]))
            yield pd.DataFrame(rows, columns=["name", "n", "kind", "family", "given", "sure"])

    parsed = counted.mapInPandas(run, "name string, n long, kind string, family string, given array<string>, sure boolean")
    return _with_openings(_turned(parsed))


def _with_openings(read_: DataFrame) -> DataFrame:
    """The readings with the openings of their first given name."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read_.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(openings=[openings(k, list(g)) for k, g in zip(b["kind"], b["given"])])

    return read_.mapInPandas(run, f"{kinds}, openings array<string>")


def link(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, n, canonical, posterior): every spelling with the canonical form it is attributed to; canonical forms name themselves.

    Stand-ins for unknown persons, empty and null values give no row; equal values are counted once. A form whose posterior isn't above that of
    a stranger with a similar name stays its own. Blocks hold the spellings of one family name (or place) with the same opening letters of the first given name; a block above HOT is
    spread over tasks, each of which holds a part of the variants and all candidates.
    """
    forms = cut(spellings(names, column))
    # keys: the family name, and it with each letter left out
    lengths = F.sequence(F.lit(1), F.length("family"))
    keys = F.array_distinct(F.concat(F.array("family"), F.when(F.length("family") > 3, F.transform(lengths, lambda i: F.concat(F.substring("family", F.lit(1), i - 1), F.substring("family", i + 1, F.length("family"))))).otherwise(F.array().cast("array<string>"))))
    keyed = forms.select("name", "n", "kind", "family", "given", F.explode(keys).alias("key"), "openings").withColumn("opening", F.explode("openings")).drop("openings")
    full = F.size(F.filter("given", lambda g: F.length(g) > 2)) + F.when(F.col("kind") == "o", F.when(F.size("given") > 1, F.lit(0)).otherwise(F.lit(-1))).otherwise(F.lit(0))
    weighed = keyed.withColumn("full", full)
    block = ["key", "kind", "opening"]
    parts = weighed.groupBy(*block).agg(F.ceil(F.count("*") / F.lit(HOT)).cast("int").alias("parts")).where("parts > 1")
    weighed = weighed.join(parts, block, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    v = weighed.select(*block, F.pmod(F.xxhash64("name"), F.col("parts").cast("long")).cast("int").alias("part"), F.col("name").alias("v"), F.col("n").alias("vn"), F.col("family").alias("vf"), F.col("given").alias("vg"), F.col("full").alias("vfull"))
    c = weighed.select(*block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("c"), F.col("n").alias("cn"), F.col("family").alias("cf"), F.col("given").alias("cg"), F.col("full").alias("cfull"))
    # a canonical form ranks above its variants: more complete, then more frequent, then first by code point
    above = (F.col("cfull") > F.col("vfull")) | ((F.col("cfull") == F.col("vfull")) & ((F.col("cn") > F.col("vn")) | ((F.col("cn") == F.col("vn")) & (F.col("c") < F.col("v")))))
    pairs = v.join(c, [*block, "part"]).where(above).drop("key", "opening", "part").dropDuplicates(["v", "c"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, name, n, vf, vg, can, cn, cf, cg in zip(b["kind"], b["v"], b["vn"], b["vf"], b["vg"], b["c"], b["cn"], b["cf"], b["cg"]):
                value = likelihood(kind, vf, list(vg), cf, list(cg)) + math.log(cn)
                # against a stranger who is as often named as the variant, or the candidate if that is more
                if value > STRANGER + math.log(max(n, cn)):
                    rows.append((name, can, math.exp(value), max(n, cn) * math.exp(STRANGER)))
            yield pd.DataFrame(rows, columns=["v", "c", "value", "stranger"])

    scored = pairs.mapInPandas(run, "v string, c string, value double, stranger double")
    # Bayes: each candidate's share in the sum over all candidates and the stranger
    best = scored.groupBy("v").agg(F.max_by("c", F.struct("value", "c")).alias("c"), (F.max("value") / (F.sum("value") + F.max("stranger"))).alias("posterior"))
    out = cut(forms.select("name", "n").join(best.withColumnRenamed("v", "name"), "name", "left").select("name", "n", F.coalesce("c", "name").alias("canonical"), "posterior"))
    while True:  # a canonical form may be a variant of a fuller one: follow the links to their end, twice as far each time
        up = out.select(F.col("name").alias("canonical"), F.col("canonical").alias("next"))
        new = cut(out.join(up, "canonical").select("name", "n", F.col("next").alias("canonical"), "posterior", (F.col("next") != F.col("canonical")).alias("moved")))
        if new.where("moved").limit(1).count() == 0:
            return new.drop("moved")
        out = new.drop("moved")


def pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: all two spellings of one person or organisation. A person has few spellings."""
    a = linked.select("canonical", F.col("name").alias("name_a"))
    b = linked.select("canonical", F.col("name").alias("name_b"))
    return a.join(b, "canonical").where("name_a < name_b").select("name_a", "name_b")
