"""Statistics and nearest neighbours of embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of one pass: 2,048 vectors of 1,024 floats are 8 MB.
QUERY_BLOCK = 2048


def vector_stats(vector: Column) -> dict[str, Column]:
    """Mean, population deviation, least and greatest of a vector's numbers, by one fold each."""
    size = F.size(vector)
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    mean = total / size
    deviation = F.sqrt(F.greatest(F.lit(0.0), squares / size - mean * mean))
    return {"mean": mean, "deviation": deviation, "least": F.array_min(vector), "greatest": F.array_max(vector)}


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """(query, neighbour, cosine): for each query the nearest other row, ties to the smaller key.

    The query set goes against all rows in blocks of QUERY_BLOCK, so each broadcast is bounded
    whatever the size of the set; a task sends on only its best row per query. Null and zero
    vectors are nobody's neighbour.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    passes = []
    for block in range(blocks):
        rows = queries.where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(blocks)) == block)).select(key, vector).collect()
        asked = np.array([r[0] for r in rows], np.int64)
        points = np.array([r[1] for r in rows], np.float64) if rows else np.empty((0, 0))
        shared = vectors.sparkSession.sparkContext.broadcast((asked, points))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, points = shared.value
            if not len(asked):
                return
            unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                keys = batch.column(0).to_numpy()
                flat = batch.column(1).flatten().to_numpy().astype(np.float64)
                own = flat.reshape(len(keys), -1) if len(keys) else flat.reshape(0, points.shape[1])
                norm = np.linalg.norm(own, axis=1)
                order = np.argsort(keys, kind="stable")
                order = order[norm[order] > 0]
                if not len(order):
                    continue
                cosine = np.round(unit @ (own[order] / norm[order, None]).T, 9)
                cosine[asked[:, None] == keys[order][None, :]] = -2
                best = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked), pa.array(keys[order][best]), pa.array(cosine[np.arange(len(asked)), best])],
                    names=["query", "neighbour", "cosine"],
                )

        found = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector)
        passes.append(found.mapInArrow(run, "query long, neighbour long, cosine double"))
    every = reduce(DataFrame.unionByName, passes).where("cosine > -2")
    first = F.max(F.struct("cosine", (-F.col("neighbour")).alias("minus")))
    return every.groupBy("query").agg(first.alias("b")).select("query", (-F.col("b.minus")).alias("neighbour"), F.col("b.cosine").alias("cosine"))
