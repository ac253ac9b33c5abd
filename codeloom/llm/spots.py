"""Bit filters: which rows may have one of some keys, told without moving the rows.

A filter has 2 ** FILTER_BITS bits (4 MB) at any size and is folded in Spark. Where it fills up,
more rows pass than have a key; the joins that follow drop them, so it only saves movement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 25


def spot(*columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - FILTER_BITS).alias("spot")


def bit_filter(keys: DataFrame, *columns: str) -> np.ndarray:
    """The filter of all keys, 32 bits a number."""
    bits = (
        keys.select(spot(*columns))
        .groupBy(F.shiftright("spot", 5).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(spot & 31 AS int)))").alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    return words


def hits(words: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return ((words[spots >> 5] >> (spots & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)


def pick(rows: DataFrame, keys: tuple[str, ...], words: np.ndarray) -> DataFrame:
    """At least the rows whose ``keys`` are in the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            yield batch.filter(pa.array(hits(shared.value, batch.column(last).to_numpy()))).select(list(range(last)))

    return rows.select("*", spot(*keys)).mapInArrow(run, rows.schema)
