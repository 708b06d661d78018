"""Distributed building of the bounded sketches: counts in a fixed number of slots, and bitmaps of keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.llm.shingles import Sketch

#: Parts of one block that a task merges at most, about; beyond it they are merged in two levels.
FAN_IN = 64


def merged_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of (part, block, counts) rows, one for each task and block; only 2 ** bits counts, a fixed number, reach the driver."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [Sketch.merge(list(pdf["counts"]))]})

    n = parts.rdd.getNumPartitions()
    if n > FAN_IN:
        salted = parts.withColumn("_salt", F.pmod(F.xxhash64("part"), F.lit(max(2, int(n**0.5)))))
        parts = salted.groupBy("block", "_salt").applyInPandas(merged, "block int, counts binary")
    summed = parts.groupBy("block").applyInPandas(merged, "block int, counts binary")
    return Sketch.unpack(bits, [(r["block"], r["counts"]) for r in summed.collect()])


def bits_for(n: int, slots: int, least: int, most: int) -> int:
    """Bits of a sketch with ``slots`` slots for each of ``n`` keys, within its bounds."""
    return min(max(least, (max(n, 1) * slots - 1).bit_length()), most)


def share(df: DataFrame, value: object) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(value)


def key_bitmap(keys: DataFrame, column: str, bits: int, mixed: bool = False) -> np.ndarray:
    """A bitmap of 2 ** bits slots, packed, in which each key of ``column`` sets one: no key is missed, others pass at the fill rate.

    The slot is taken from xxhash64 of the key, or from the key itself where that is ``mixed``, a hash already."""
    words = (
        keys.select(F.pmod(F.col(column) if mixed else F.xxhash64(column), F.lit(1 << bits)).alias("h"))
        .groupBy((F.shiftright("h", 6)).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(pmod(h, 64) as int)))").alias("v"))
    )
    table = np.zeros((1 << bits) // 64, dtype="<i8")
    found = words.toArrow()
    table[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return table.view(np.uint8)


def passes(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
