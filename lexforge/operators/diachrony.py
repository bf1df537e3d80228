"""Change over periods: relative frequencies, consecutive comparison, distribution shift, effect size, resampling, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_million(tokens: DataFrame, item: str, period: str = "period") -> DataFrame:
    """(item, period, freq, per_million) for the periods in which an item occurs."""
    size = tokens.where(F.col(period).isNotNull()).groupBy(period).agg(F.count("*").alias("size"))
    freq = tokens.where(F.col(period).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(item).alias("item"), period).agg(F.count("*").alias("freq"))
    return freq.join(F.broadcast(size), period).select("item", F.col(period).alias("period"), "freq", (F.col("freq") * 1e6 / F.col("size")).alias("per_million"))


def changes(trend: DataFrame, rank: Column, threshold: float = 2.0) -> DataFrame:
    """(item, from_period, to_period, ratio, kind): neighbours in time whose ratio is at least the threshold or at most its inverse.

    An item that was absent before doesn't count as changed. `trend` is what `per_million` gives; items without a known rank are left out.
    """
    w = W.partitionBy("item").orderBy("_rank")
    t = trend.withColumn("_rank", rank).where("_rank is not null")
    t = t.select("item", F.lag("period").over(w).alias("from_period"), F.col("period").alias("to_period"), (F.col("per_million") / F.lag("per_million").over(w)).alias("ratio"))
    t = t.where("from_period is not null").where((F.col("ratio") >= threshold) | (F.col("ratio") <= 1 / threshold))
    return t.withColumn("kind", F.when(F.col("ratio") > 1, "rise").otherwise("fall"))


def distribution_change(counts: DataFrame, key: str, group: str, first: str, second: str) -> DataFrame:
    """(key, share_first, share_second, difference, relative): two groups' relative distributions, absent keys as 0; relative is null from nothing."""
    side = lambda g, n: counts.where(F.col(group) == g).groupBy(key).agg(F.sum("n").alias(n))
    one, two = side(first, "a"), side(second, "b")
    total = counts.where(F.col(group).isin(first, second)).agg(F.sum(F.when(F.col(group) == first, F.col("n"))).alias("ta"), F.sum(F.when(F.col(group) == second, F.col("n"))).alias("tb"))
    j = one.join(two, key, "full_outer").crossJoin(F.broadcast(total))
    x, y = F.coalesce(F.col("a") / F.col("ta"), F.lit(0.0)), F.coalesce(F.col("b") / F.col("tb"), F.lit(0.0))
    return j.select(key, x.alias("share_first"), y.alias("share_second"), (y - x).alias("difference"), F.when(x > 0, (y - x) / x).alias("relative"))


def cohens_d(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """(n1, n2, mean1, mean2, d, label) with the pooled standard deviation; d is 0 where it vanishes."""
    g = lambda x, f: f(F.when(F.col(group) == x, F.col(value)))
    s = df.agg(g(first, F.count).alias("n1"), g(second, F.count).alias("n2"), g(first, F.avg).alias("mean1"), g(second, F.avg).alias("mean2"), g(first, F.var_samp).alias("v1"), g(second, F.var_samp).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    d = F.when((F.col("n1") > 1) & (F.col("n2") > 1) & (pooled > 0), (F.col("mean1") - F.col("mean2")) / pooled).otherwise(0.0)
    label = F.when(F.abs("d") < 0.2, "negligible").when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large")
    return s.withColumn("d", d).select("n1", "n2", "mean1", "mean2", "d", label.alias("label"))


#: Chances of 0, 1, 2 ... events of a Poisson variable of mean 1, added up (fixed values).
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940581)


def _chance(key: Column, part: int) -> Column:
    """An even number between 0 and 1 from eight hexadecimal digits of a digest."""
    return (F.conv(F.substring(F.md5(key), 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def _normal(key: Column) -> Column:
    return F.sqrt(-2 * F.ln(_chance(key, 0))) * F.cos(2 * F.pi() * _chance(key, 1))


def _key(*parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def bootstrap_mean(df: DataFrame, value: str, group: str, rounds: int = 200, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """(group, mean, low, high, rounds): percentile interval of a mean.

    Rows are first counted by group and value, so what is multiplied by the rounds is the table of values, not the rows. How often a value that
    occurs c times is drawn in a round is a Poisson number of mean c, by a digest of group, value and round (from 2 on by its normal approximation): no
    collected sample, and the same result whatever the partitions.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    rolls = cells.select("g", "x", "c", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b"))
    key = _key(F.col("g"), F.col("x").cast("decimal(38,6)"), F.col("b"), F.lit(seed))
    one = F.lit(len(POISSON))
    for k, p in reversed(list(enumerate(POISSON))):
        one = F.when(_chance(key, 0) < p, F.lit(k)).otherwise(one)
    weight = F.when(F.col("c") == 1, one.cast("double")).otherwise(F.greatest(F.lit(0.0), F.round(F.col("c") + F.sqrt("c") * _normal(key))))
    means = rolls.withColumn("w", weight).groupBy("g", "b").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    whole = cells.groupBy("g").agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"))
    ends = means.groupBy("g").agg(F.expr(f"percentile(m, array({alpha / 2}, {1 - alpha / 2}))").alias("q"))
    return whole.join(ends, "g").select(F.col("g").alias(group), "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.lit(rounds).alias("rounds"))


def slope(df: DataFrame, item: str, rank: str, value: str, flat: float = 0.1, least: int = 3) -> DataFrame:
    """(item, periods, slope, trend): least-squares slope over period ranks, of items with `least` periods or more."""
    s = df.groupBy(item).agg(F.count("*").alias("periods"), F.regr_slope(F.col(value), F.col(rank)).alias("slope")).where(F.col("periods") >= least)
    return s.withColumn("trend", F.when(F.col("slope") > flat, "rising").when(F.col("slope") < -flat, "falling").otherwise("stable"))


def semantic_shift(vectors: DataFrame, vector: str, group: str) -> DataFrame:
    """(group_a, group_b, distance, cosine) of the centroids of groups of vectors; the groups are few, their pairs are made from the centroids."""
    dims = vectors.select(F.col(group).alias("g"), F.posexplode(vector).alias("i", "x")).groupBy("g", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    a = dims.select(F.col("g").alias("group_a"), "i", F.col("c").alias("ca"))
    b = dims.select(F.col("g").alias("group_b"), "i", F.col("c").alias("cb"))
    return a.join(b, "i").where("group_a < group_b").groupBy("group_a", "group_b").agg(
        F.sqrt(F.sum(F.pow(F.col("ca") - F.col("cb"), F.lit(2.0)))).alias("distance"),
        (F.sum(F.col("ca") * F.col("cb")) / F.sqrt(F.sum(F.col("ca") * F.col("ca")) * F.sum(F.col("cb") * F.col("cb")))).alias("cosine"),
    )


def two_sample(df: DataFrame, value: str, group: str, first: str, second: str, rounds: int = 200, seed: int = 11) -> DataFrame:
    """(observed, p, rounds): difference of two means and the share of random relabellings with one at least as large.

    Rows are first counted by value; of the n rows of a value a binomial number (by its normal approximation from 2 on) gets the first label in a
    round, by a digest of value and round. So the table of values is multiplied by the rounds, not the rows.
    """
    x = df.where(F.col(value).isNotNull() & F.col(group).isin(first, second)).groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(F.col(group) == first).alias("a"), F.count("*").alias("n"))
    sums = x.agg(F.sum("a").alias("na"), F.sum("n").alias("nn"), F.sum(F.col("a") * F.col("x")).alias("sa"), F.sum(F.col("n") * F.col("x")).alias("sn"))
    seen = sums.select(F.abs(F.col("sa") / F.col("na") - (F.col("sn") - F.col("sa")) / (F.col("nn") - F.col("na"))).alias("observed"), (F.col("na") / F.col("nn")).alias("share"), "nn", "sn")
    rolls = x.select("x", "n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b")).crossJoin(F.broadcast(seen))  # one row
    key = _key(F.col("x").cast("decimal(38,6)"), F.col("b"), F.lit(seed))
    some = F.round(F.col("n") * F.col("share") + F.sqrt(F.col("n") * F.col("share") * (1 - F.col("share"))) * _normal(key))
    drawn = F.when(F.col("n") == 1, (_chance(key, 0) < F.col("share")).cast("double")).otherwise(F.least(F.greatest(some, F.lit(0.0)), F.col("n").cast("double")))
    r = rolls.withColumn("k", drawn).groupBy("b").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("x")).alias("s"), F.first("nn").alias("nn"), F.first("sn").alias("sn"), F.first("observed").alias("observed"))
    d = F.abs(F.col("s") / F.nullif("k", F.lit(0.0)) - (F.col("sn") - F.col("s")) / F.nullif(F.col("nn") - F.col("k"), F.lit(0.0)))
    return r.agg(F.first("observed").alias("observed"), F.avg(F.when(d >= F.col("observed"), 1.0).otherwise(0.0)).alias("p"), F.count("*").alias("rounds"))
