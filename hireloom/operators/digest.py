"""Digest messages of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom.common import materialise
from hireloom.functions.text import html_escape

LIMIT = 4000
#: Lines that one task of a whole digest folds, about.
BLOCK = 20_000


def job_line() -> Column:
    e = lambda c: html_escape(F.coalesce(F.col(c), F.lit("")))
    return F.concat(F.lit('• <a href="'), e("url"), F.lit('">'), e("title"), F.lit("</a> — "), e("company"), F.lit(" ("), e("location"), F.lit(")"))


def pack(lines: DataFrame, key: str, order: str, line: str, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(key, part, message): each key's lines packed in order into messages of at most ``limit`` signs, behind a header with their number.

    A line longer than the limit is a message of its own, uncut; lines of equal order follow their texts. No task holds more than a
    block of lines, however many a key has: rows are sorted into blocks, each block is folded, for the key that it goes on with for
    every length that the message before it can have (2 * ``limit`` numbers a block), the blocks are chained on the driver, and each
    then numbers the messages of its lines.
    """
    kind = dict(lines.dtypes)[key]
    rows = lines.select(F.col(key).alias("k"), F.lit(1).alias("f"), F.col(order).alias("o"), F.col(line).alias("l"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    header = F.concat(F.lit("<b>"), F.col("n").cast("string"), F.lit(" fresh job(s)</b>"))
    rows = rows.unionByName(counts.select("k", F.lit(0).alias("f"), F.lit(None).cast(dict(rows.dtypes)["o"]).alias("o"), header.alias("l")))
    rows = materialise(rows, "digest-lines")
    total = rows.count()
    ranges = rows.repartitionByRange(max(1, -(-total // block)), "k", "f", "o", "l")
    placed = materialise(ranges.select("k", "f", "o", "l", F.spark_partition_id().alias("b")), "digest-blocks")

    def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("k", "f", "o", "l")], null_placement="at_start"))  # as Spark sorts
        return t, np.array([len(x) for x in t.column("l").to_pylist()], np.int64), np.flatnonzero(t.column("f").to_numpy() == 0)

    def walked(sizes: np.ndarray, heads: set[int], at: int, part: int) -> list[tuple[int, int]]:
        out = []
        for i, n in enumerate(sizes):
            if i in heads:
                at, part = int(min(n, limit)), 0
            else:
                at, part = (int(min(n, limit)), part + 1) if at + n + 1 > limit else (int(at + n + 1), part)
            out.append((at, part))
        return out

    def summed(t: pa.Table) -> pa.Table:
        t, sizes, heads = ordered(t)
        if len(heads):  # the last key of the block begins in it
            at, part = walked(sizes[heads[-1] :], {0}, 0, 0)[-1]
            ends = (np.array([at], np.int32), np.array([part], np.int32))
        else:
            ends = _folded(sizes, limit)
        return pa.table({"b": t.column("b")[:1].cast(pa.int32()), "at": pa.array([ends[0].astype(np.int32).tobytes()]), "begun": pa.array([ends[1].astype(np.int32).tobytes()])})

    at, part, starts = 0, 0, {}
    for r in sorted(placed.groupBy("b").applyInArrow(summed, "b int, at binary, begun binary").toLocalIterator(), key=lambda r: r["b"]):
        starts[r["b"]] = (at, part)
        ends, begun = np.frombuffer(r["at"], np.int32), np.frombuffer(r["begun"], np.int32)
        at, part = (int(ends[0]), int(begun[0])) if len(ends) == 1 else (int(ends[at]), part + int(begun[at]))

    def parted(t: pa.Table) -> pa.Table:
        t, sizes, heads = ordered(t)
        parts = [p for _, p in walked(sizes, {*heads.tolist()}, *starts[t.column("b")[0].as_py()])]
        return pa.table({"k": t.column("k"), "part": pa.array(parts, pa.int32()), "b": t.column("b"), "i": pa.array(range(len(parts)), pa.int32()), "l": t.column("l")})

    cut = placed.groupBy("b").applyInArrow(parted, f"k {kind}, part int, b int, i int, l string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "i", "l"))), lambda x: x["l"]), "\n")  # at most limit lines a message
    return cut.groupBy(F.col("k").alias(key), "part").agg(joined.alias("message"))


def summary_lines(lines: DataFrame, order: str, line: str, most: int = 50) -> DataFrame:
    """The first lines that a summary is written from."""
    return lines.orderBy(order).limit(most).select(order, line)


def _folded(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of the last message, messages begun) behind lines of these ``sizes``, for each length from 0 to ``limit`` that the message before them can have."""
    to, at, begun = np.arange(limit + 1), np.arange(limit + 1), np.zeros(limit + 1, np.int64)
    for n in sizes:
        over = at + n + 1 > limit
        at, begun = np.where(over, min(n, limit), at + n + 1), begun + over  # a message beyond the limit takes no line, like a full one
        if len(at) > 64:  # most beginnings have met by then
            (at, begun), back = np.unique(np.stack([at, begun]), axis=1, return_inverse=True)
            to = back.reshape(-1)[to]
    return at[to], begun[to]


def pack_whole(lines: DataFrame, order: str, line: str, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(part, message) of all lines as one digest."""
    return pack(lines.select(F.lit(0).alias("whole"), order, line), "whole", order, line, limit, block).select("part", "message")


def assemble(summary: str | None, jobs: DataFrame, alerts: DataFrame) -> DataFrame:
    """(part, message) of a whole digest: summary, packed jobs (part, message) and one block of alerts (company, message); none where all are empty."""
    spark = jobs.sparkSession
    out = jobs.select((F.col("part") + 1).alias("part"), "message")
    text = F.concat(F.lit("⚠️ <b>Health alerts</b>\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("company", html_escape(F.col("message")).alias("m")))), lambda x: x["m"]), "\n"))
    out = out.unionByName(alerts.agg(F.count(F.lit(1)).alias("_n"), text.alias("message")).where("_n > 0").select(F.lit(1_000_000).alias("part"), "message"))
    if summary:
        out = out.unionByName(spark.createDataFrame([(0, "✨ " + summary.strip())], "part int, message string"))
    return out
