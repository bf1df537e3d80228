"""Nearest vectors of a set of queries: queries are held in blocks of bounded size, every block scans all rows once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors that are broadcast together; more are taken in blocks.
BLOCK = 20_000


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, cosine, k): the k nearest rows of each query by cosine, the query itself left out; exact.

    Each task keeps its k best for each query, so what is shuffled is k rows a query and task. Null vectors are left out, a zero vector has cosine 0.
    """
    spark = vectors.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(key, vector)
    n = q.count()
    out = None
    for b in range(max(1, -(-n // BLOCK))):
        part = q if n <= BLOCK else q.where(F.pmod(F.xxhash64(key), F.lit(-(-n // BLOCK))) == b)
        rows = part.collect()  # at most about BLOCK query vectors
        if not rows:
            continue
        held = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, m = held.value
            ids = np.array(ids)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                v = np.array(batch[vector].tolist(), dtype=np.float64)
                if not len(v):
                    continue
                other = batch[key].to_numpy()
                c = np.round((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)) @ m.T, 6)
                for j in range(len(ids)):
                    col = c[:, j]
                    near = np.argpartition(-col, min(k + 1, len(col) - 1))[: k + 1]
                    floor = col[near].min()
                    take = np.flatnonzero(col >= floor) if len(col) > k + 1 else np.arange(len(col))
                    best[j] = sorted(best[j] + [(-col[i], other[i]) for i in take if other[i] != ids[j]])[:k]
            yield pd.DataFrame([(ids[j], o, -s) for j in range(len(ids)) for s, o in best[j]], columns=["query_id", key, "cosine"])

        kind = vectors.schema[key].dataType.simpleString()
        found = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"query_id {kind}, `{key}` {kind}, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, `{key}` long, cosine double, k int")
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), key)
    return out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
