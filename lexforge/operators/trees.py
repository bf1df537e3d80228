"""Dependency trees: depth, crossing arcs, validation, statistics, subtrees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _trees(tokens: DataFrame) -> DataFrame:
    """One row for each sentence with its (index, head) pairs in order; a sentence is bounded."""
    return tokens.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("token_index", "head"))).alias("t"), F.count("*").alias("n"))


def depths(tokens: DataFrame) -> DataFrame:
    """(sentence_id, token_index, depth): steps to the root, 0 for a root; -1 for a token that reaches none (a cycle or a missing head).

    Trees are walked inside each sentence's array, every token once (the depths that are known end a walk), without a join per level.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, tree in zip(b["sentence_id"], b["t"]):
                head = {int(r["token_index"]): (int(r["head"]) if r["head"] is not None else 0) for r in tree}
                known: dict[int, int] = {}
                for start in head:
                    path, i = [], start
                    while i in head and i not in known and i not in path[-1:] and len(path) <= len(head):
                        path.append(i)
                        i = head[i]
                    base = known.get(i, -1 if i == 0 else None)
                    if base is None or len(path) > len(head):
                        known.update(dict.fromkeys(path, -1))
                        continue
                    if i in known and base == -1:
                        known.update(dict.fromkeys(path, -1))
                        continue
                    for k, node in enumerate(reversed(path), 1):
                        known[node] = base + k
                out += [(sid, i, known.get(i, -1)) for i in head]
            yield pd.DataFrame(out, columns=["sentence_id", "token_index", "depth"])

    return _trees(tokens).select("sentence_id", "t").mapInPandas(run, "sentence_id long, token_index long, depth long")


def crossing(tokens: DataFrame) -> DataFrame:
    """(sentence_id, arcs, crossings): pairs of arcs of a sentence that cross, found inside its array."""
    t = _trees(tokens.where("head > 0"))
    ends = F.transform("t", lambda x: F.struct(F.least(x["token_index"], x["head"]).alias("a"), F.greatest(x["token_index"], x["head"]).alias("b")))
    t = t.select("sentence_id", F.col("n").alias("arcs"), ends.alias("e"))
    count = F.expr("aggregate(transform(e, x -> size(filter(e, y -> x.a < y.a and y.a < x.b and x.b < y.b))), 0, (s, v) -> s + v)")
    return t.select("sentence_id", "arcs", count.alias("crossings"))


def problems(tokens: DataFrame) -> DataFrame:
    """(sentence_id, rule, n): broken rules of the trees: no root, several roots, a head outside the sentence, a repeated index."""
    s = tokens.groupBy("sentence_id").agg(F.count_if(F.col("head") == 0).alias("roots"), F.count("*").alias("n"), F.count_distinct("token_index").alias("d"), F.max("token_index").alias("most"), F.collect_list("head").alias("h"))
    outside = F.size(F.filter("h", lambda x: (x > F.col("most")) | (x < 0)))
    s = s.withColumn("outside", outside)
    broken = lambda test, rule, n: F.when(test, F.struct(F.lit(rule).alias("rule"), n.cast("long").alias("n")))
    rules = F.array(
        broken(F.col("roots") == 0, "no_root", F.lit(1)), broken(F.col("roots") > 1, "several_roots", F.col("roots")),
        broken(F.col("n") > F.col("d"), "repeated_index", F.col("n") - F.col("d")), broken(F.col("outside") > 0, "head_outside", F.col("outside")),
    )
    return s.select("sentence_id", F.explode(F.array_compact(rules)).alias("x")).select("sentence_id", "x.rule", "x.n")


def arc_lengths(tokens: DataFrame) -> DataFrame:
    """(length, arcs): how many arcs span how many places."""
    return tokens.where("head > 0").groupBy(F.abs(F.col("head") - F.col("token_index")).alias("length")).agg(F.count("*").alias("arcs"))


def subtree_sizes(tokens: DataFrame) -> DataFrame:
    """(sentence_id, token_index, size): tokens governed directly or not, itself included. Sizes are handed up from the leaves, each token once; only
    tokens on or below a cycle are walked one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, tree in zip(b["sentence_id"], b["t"]):
                head = {int(r["token_index"]): (int(r["head"]) if r["head"] is not None else 0) for r in tree}
                size = dict.fromkeys(head, 1)
                waiting = dict.fromkeys(head, 0)
                for h in head.values():
                    if h in waiting:
                        waiting[h] += 1
                leaves, done = [i for i, n in waiting.items() if not n], set()
                while leaves:
                    i = leaves.pop()
                    done.add(i)
                    h = head[i]
                    if h in size:
                        size[h] += size[i]
                        waiting[h] -= 1
                        if not waiting[h]:
                            leaves.append(h)
                ring = set(head) - done  # what a cycle keeps waiting: every token of it governs all the others
                while ring:
                    i, cycle = next(iter(ring)), []
                    while i not in cycle:
                        cycle.append(i)
                        i = head[i]
                    own = {k: size[k] for k in cycle}
                    for k in cycle:
                        size[k] = sum(own.values())
                    ring -= set(cycle)
                out += [(sid, i, n) for i, n in size.items()]
            yield pd.DataFrame(out, columns=["sentence_id", "token_index", "size"])

    return _trees(tokens).select("sentence_id", "t").mapInPandas(run, "sentence_id long, token_index long, size long")
