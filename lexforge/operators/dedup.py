"""Exact and near-duplicate texts: an exact set-similarity join on word shingles, classes by connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.runtime import cut


#: Texts of one shingle that a task pairs; a shingle of more is spread over so many tasks that each has its part.
HOT = 2000


def similar(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, same, jaccard), a < b: all pairs of rows of `sets` (rep, s: array of distinct hashes) whose Jaccard similarity reaches the threshold, exactly.

    Elements are ordered from the rarest on; two sets that similar share one of their first n - ceil(t n) + 1 (prefix filter), are of like size (bands), and
    the first that they share leaves enough behind it in both (position filter), so few pairs reach the count. The group of a frequent element is
    split by size band and by salt: one side is spread, the other repeated. Null and empty sets give no pair; rows of equal `rep` must not occur.
    """
    sized = sets.where(F.size("s") > 0).select("rep", "s", F.size("s").alias("n"))
    flat = sized.select("rep", "n", F.explode("s").alias("x"))
    freq = flat.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")  # an element of one set links nothing
    known = flat.join(freq, "x").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("o"))
    known = cut(known)
    lone = F.col("n") - F.size("o")  # elements of one set come first in the order
    reach = F.greatest(F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - lone, F.lit(0)).cast("int")
    head = known.select("rep", "n", lone.alias("lone"), F.posexplode(F.slice("o", F.lit(1), reach)).alias("i", "e"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    parts = F.ceil(F.col("e.f") / F.lit(HOT)).cast("int")
    keys = head.select("rep", "n", (F.col("lone") + F.col("i")).alias("at"), F.col("e.x").alias("x"), band.alias("band"), parts.alias("parts"))
    one = keys.select("x", "band", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int").alias("part"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    two = keys.select("x", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "parts", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    two = two.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    needed = (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    like = smaller & (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= needed)
    pairs = one.join(two, ["x", "band", "part"]).where(like).select("a", "b", "na", "nb").distinct()
    full = known.select("rep", F.transform("o", lambda y: y["x"]).alias("x"))
    j = pairs.join(full.select(F.col("rep").alias("a"), F.col("x").alias("xa")), "a").join(full.select(F.col("rep").alias("b"), F.col("x").alias("xb")), "b")
    j = j.select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).alias("same")).where(F.col("same") >= needed)
    return j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same", (F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))).alias("jaccard"))


def copies(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(k, h) of every row and (h, rep, t) of every different text, case and white space apart: its smallest key stands for all its copies."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.md5(tx.collapse(F.lower(F.col(text)))).alias("h"))
    return rows.select("k", "h"), rows.groupBy("h").agg(F.min("k").alias("rep"), F.min_by("t", "k").alias("t"))


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(rep, s): the distinct hashes of the word shingles of each text; texts with fewer than k words have none."""
    return texts.select("rep", F.array_distinct(F.transform(tx.shingles(F.col("t"), k), lambda s: F.xxhash64(s))).alias("s")).where("size(s) > 0")


def links(df: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(a, b, same, jaccard): the different texts, each by the smallest key of its copies, whose shingles reach the threshold. Null texts give no row."""
    return similar(shingle_sets(copies(df, key, text)[1], k), threshold)


def classes(df: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, class_id, links): the smallest key of the class of near-duplicates, and the number of different texts it is linked to.

    Copies are first reduced to one text each; texts with fewer than k words only have exact copies. Null texts give no row.
    """
    rows, texts = copies(df, key, text)
    texts = cut(texts)
    found = cut(similar(shingle_sets(texts, k), threshold).select("a", "b"))
    label = components(texts.select("rep"), found)
    both = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    out = texts.select("h", "rep").join(label, "rep").join(both, "rep", "left").select("h", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(out, "h").select(F.col("k").alias(key), "class_id", "links")


def components(nodes: DataFrame, links: DataFrame, key: str = "rep") -> DataFrame:
    """(key, class_id): the smallest key of each component; labels spread along links and jump to their label's label, so the rounds grow with the
    logarithm of a component's length. Each round is written to the shared folder."""
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    label = cut(nodes.select(F.col(key).alias("u"), F.col(key).alias("l")))
    for _ in range(math.ceil(math.log2(1 << 40))):
        near = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(near, "u", "left").select("u", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = label.select(F.col("u").alias("l"), F.col("l").alias("j"))
        new = cut(step.join(jump, "l").select("u", "old", F.least("l", "j").alias("l")))
        changed = new.where("l <> old").limit(1).count()
        label = new.select("u", "l")
        if not changed:
            break
    return label.select(F.col("u").alias(key), F.col("l").alias("class_id"))
