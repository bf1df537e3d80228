"""Named entities by word lists and patterns, merged over several models; benchmarks of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recognise(tokens: DataFrame, gazetteer: DataFrame, patterns: dict[str, str], keys: tuple[str, ...] = ("sentence_id", "token_index")) -> DataFrame:
    """(keys, form, type, source, confidence): a form of the list (form, type), else the first pattern that fits it, else a proper-noun tag, which means
    a person with confidence 0.7. A form with several types in the list takes the first by order."""
    known = gazetteer.groupBy("form").agg(F.min("type").alias("_g"))
    x = tokens.where("form is not null").select(*keys, "form", "upos").join(known, "form", "left")
    by_pattern = F.coalesce(*[F.when(F.col("form").rlike(p), F.lit(k)) for k, p in patterns.items()], F.lit(None).cast("string"))
    x = x.withColumn("_p", by_pattern)
    source = F.when(F.col("_g").isNotNull(), "gazetteer").when(F.col("_p").isNotNull(), "pattern").when(F.col("upos") == "PROPN", "tag")
    kind = F.coalesce("_g", "_p", F.when(F.col("upos") == "PROPN", "PER"))
    return x.select(*keys, "form", kind.alias("type"), source.alias("source"), F.when(source == "tag", 0.7).otherwise(1.0).alias("confidence")).where("type is not null")


def merge(found: DataFrame, keys: tuple[str, ...] = ("sentence_id",), least: int = 2, above: float = 0.6) -> DataFrame:
    """(keys, start, end, label, models, confidence): spans that `least` models or more give with a mean confidence above a bound. Counts are combined
    before the shuffle."""
    g = found.groupBy(*keys, "start", "end", "label").agg(F.count("*").alias("models"), F.avg("confidence").alias("confidence"))
    return g.where((F.col("models") >= least) & (F.col("confidence") > above))


def benchmark(runs: DataFrame) -> DataFrame:
    """(model, samples, average_time, success_rate, average_confidence, score) of runs (model, seconds, ok, confidence); the score weighs success 0.7 and speed 0.3."""
    g = runs.groupBy("model").agg(
        F.count("*").alias("samples"), F.avg("seconds").alias("average_time"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg(F.when(F.col("ok"), F.col("confidence"))).alias("average_confidence")
    )
    return g.withColumn("score", F.col("success_rate") * 0.7 + 0.3 / (1 + F.col("average_time")))
