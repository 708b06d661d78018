"""Detecting texts that were cut off, with a backward character n-gram model (problem 10).

The model is trained on the whole corpus. It reads backward: for the last n signs before a place, n in ORDERS, it knows how often
the text went on there and how often a line, item or sentence ended. For each text the contexts of its end are looked up from
the shortest to the longest, each order's counts smoothing the next; the text's own end doesn't count. The log-odds of an end
against a continuation then decide, with a threshold for each language and column at the valley between both modes.

Only contexts that end some text are counted, so the model stays as small as the number of distinct ends; a bitmap, sized by their
number, drops all other places before anything leaves a task, and each batch is added up before it is sent. A place is looked at
under a longer order only where a shorter one passed: whatever ends a text ends it under the shorter orders too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.common import lookup, materialise
from hireloom.llm.shingles import mix
from hireloom.llm.sketching import bits_for, key_bitmap, passes, share

#: Lengths of the contexts.
ORDERS = (1, 2, 4, 6, 8, 11, 14, 18, 23, 30)
#: The longest context reaches back to the start of the line, if that is within so many signs.
LINE = 120
#: Contexts of this length or more are trusted with a sign of omission; shorter ones are looked up without it.
WHOLE_SIGN = 11
#: Slots of the bitmap of contexts for each of them, and its least and greatest size (128 MB) in bits. Beyond 2 ** 26 contexts more
#: other places pass, up to all of them; results stay the same.
BITMAP_SLOTS, BITMAP_LEAST, BITMAP_MOST = 16, 20, 30
#: Places that a context must have been seen at to be used, weight of the shorter context's estimate in observations, and how many
#: orders shorter that context is at least. Neighbouring orders count the same places, so only one shorter context is taken in.
ENOUGH_PLACES, SMOOTHING, SHORTER = 12, 2.0, 3
#: Share of places at which a line, item or sentence ends, before any context is known.
BASE = 0.05
#: Log-odds taken off for a sign of omission and for a length at which a source's texts pile up.
SIGN, CAPPED = 4.0, 1.5
#: A length, in signs or bytes, is a cap when it holds this share of a source's texts, and so many of them.
CAP_SHARE, CAP_LEAST, CAP_BITS = 0.02, 8, 20
#: The threshold of a language and column lies in the emptiest stretch of this range, the nearest to the default of equal ones.
LOWEST, HIGHEST, DEFAULT = -7.0, -3.5, -5.0
#: Texts that the odds of all languages together weigh as much as beside a language's own, however many it has.
PRIOR = 250.0

#: Signs whose places are counted together, small enough for a core's cache, and portions that are added up before they are sent.
SIGNS_AT_ONCE, PARTS_AT_ONCE = 60_000, 8
#: Texts whose ends are looked at together.
TEXTS_AT_ONCE = 250

_BASE = 0x9E3779B97F4A7C15 | 1
_OMISSION = re.compile(r"[\s]*(?:…|\.{3,}|\[(?:…|\.{3})\]|\((?:…|\.{3})\))\s*$")
_STOP_SIGNS = ".!?…。！？:;"
_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)
_IS_STOP = np.zeros(1 << 16, dtype=bool)
_IS_STOP[[ord(c) for c in _STOP_SIGNS]] = True


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _signs(text: str) -> np.ndarray:
    """Code points of a text without blanks at its end, all digits alike."""
    text = text.rstrip()
    if text.isascii():
        return np.frombuffer(text.encode("ascii").translate(_DIGITS), dtype=np.uint8).astype(np.uint32)
    return np.frombuffer(re.sub(r"\d", "0", text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _key(hashes: np.ndarray, order: int) -> np.ndarray:
    """Even keys: the lowest bit is free to tell whether a place is an end."""
    return mix(hashes * np.uint64(2) + np.uint64(order)).view(np.int64) & np.int64(-2)


@dataclass
class _Layout:
    """Texts one after the other, each closed by a 0, with running sums from which the hash of any stretch follows."""

    text: np.ndarray
    finals: np.ndarray
    reach: np.ndarray
    line_start: np.ndarray
    total: np.ndarray
    down: np.ndarray

    @staticmethod
    def of(parts: list[np.ndarray]) -> _Layout:
        zero = np.zeros(1, np.uint32)
        text = np.concatenate([x for p in parts for x in (p, zero)])
        n, sizes = len(text), np.array([len(p) + 1 for p in parts])
        place = np.arange(n)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        up, down = _powers(1 << max(12, int(n).bit_length()))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        line_start = np.maximum.accumulate(np.where(np.concatenate(([True], (text[:-1] == 10) | (text[:-1] == 0))), place, 0))
        return _Layout(text, np.cumsum(sizes) - 2, (place - begin + 1).astype(np.int32), line_start, total, down)

    def key(self, begin: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        return _key((self.total[at + 1] - self.total[begin]) * self.down[begin], order)


def end_keys(texts: list[str]) -> pa.Array:
    """For each text, none of them blank, the key of its last n signs for each order, then of its last line; null where it is too short or the line too long."""
    n_orders = len(ORDERS) + 1
    if not texts:
        return pa.array([], pa.list_(pa.int64()))
    at = _Layout.of([_signs(t.rstrip()[-LINE - 2 :]) for t in texts])  # no context reaches further back
    keys, known = np.zeros((len(texts), n_orders), np.int64), np.zeros((len(texts), n_orders), bool)
    for order, size in enumerate(ORDERS):
        known[:, order] = ok = at.reach[at.finals] >= size
        keys[ok, order] = at.key(at.finals[ok] + 1 - size, at.finals[ok], order)
    known[:, -1] = ok = at.finals - at.line_start[at.finals] < LINE
    keys[ok, -1] = at.key(at.line_start[at.finals[ok]], at.finals[ok], len(ORDERS))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n_orders, pa.int32()), pa.array(keys.ravel(), mask=~known.ravel()))


def count_contexts(texts: list[str | None], wanted, capped: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, ends, places) to be added up by key, over all places of the texts whose key passes ``wanted``; ends of ``capped`` texts count only behind a stop."""
    live_texts = [(t, c) for t, c in zip(texts, capped or [False] * len(texts)) if t and not t.isspace()]
    if not live_texts:
        return (np.zeros(0, np.int64),) * 3
    at_ = _Layout.of([_signs(t) for t, _ in live_texts])
    text, n, zero = at_.text, len(at_.text), np.zeros(1, np.uint32)
    after = np.concatenate((text[1:], zero))
    beyond = np.concatenate((text[2:], zero, zero))[:n]
    space = after == 32
    stop = _IS_STOP[np.minimum(text, (1 << 16) - 1)]
    end = (after == 0) | (after == 10) | (after == 13) | (stop & space) | (space & (beyond == 10)) | (after == ord("<"))
    live = text != 0
    live &= text != 32
    live &= text != 10
    live[at_.finals[np.array([c for _, c in live_texts], dtype=bool) & ~stop[at_.finals]]] = False
    keys, ends = [], []
    at = np.flatnonzero(live)
    # The largest order that each place passed, or failed to; the line's own context is looked up where no shorter order failed.
    line = at - at_.line_start[at] + 1
    whole = np.ones(len(at), dtype=bool)
    alive = np.arange(len(at))
    for order, size in enumerate(ORDERS):
        alive = alive[at_.reach[at[alive]] >= size]
        place = at[alive]
        key = at_.key(place + 1 - size, place, order)
        fits = wanted(key)
        keys.append(key[fits])
        ends.append(end[place[fits]].astype(np.int64))
        failed = alive[~fits]
        whole[failed[line[failed] >= size]] = False
        alive = alive[fits]
    place = at[whole & (line <= LINE)]
    key = at_.key(at_.line_start[place], place, len(ORDERS))
    fits = wanted(key)
    keys.append(key[fits])
    ends.append(end[place[fits]].astype(np.int64))
    # Sorting the keys with their end bit needs no second array beside them; a context comes out once for each bit.
    distinct, n_places = np.unique(np.concatenate(keys) | np.concatenate(ends), return_counts=True)
    return distinct & np.int64(-2), np.where(distinct & 1 == 1, n_places, 0), n_places


def added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of several portions, added up by key."""
    keys, ends, places = (np.concatenate([p[i] for p in parts]) for i in range(3))
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(at, weights=x, minlength=len(distinct)).astype(np.int64) for x in (ends, places))


def with_odds(df: DataFrame, counts: str, into: str) -> DataFrame:
    """Adds the log-odds of an end from an array of (place, ends, places), null where there is no array.

    The longest context seen often enough decides; a context some orders shorter smooths it, and is itself smoothed by the share of
    ends among all places. Without such a context that share is all there is. Longer contexts that are rarer count where another
    text ended there. Each step is a column of its own, so that no array is sorted and filtered twice.
    """
    last = lambda array: F.try_element_at(array, F.lit(-1))
    df = df.withColumn("_sorted", F.array_sort(counts)).withColumn("_usable", F.filter("_sorted", lambda x: x["places"] >= ENOUGH_PLACES))
    df = df.withColumn("_best", last(F.col("_usable"))).withColumn("_rare", last(F.filter("_sorted", lambda x: (x["places"] >= 1) & (x["ends"] >= 1))))
    df = df.withColumn("_shorter", last(F.filter("_usable", lambda x: x["place"] <= F.col("_best.place") - SHORTER)))
    df = df.withColumn("_p", F.coalesce((F.col("_shorter.ends") + SMOOTHING * BASE) / (F.col("_shorter.places") + SMOOTHING), F.lit(BASE)))
    df = df.withColumn("_p", F.coalesce((F.col("_best.ends") + SMOOTHING * F.col("_p")) / (F.col("_best.places") + SMOOTHING), F.lit(BASE)))
    more = F.col("_rare.place") > F.coalesce("_best.place", F.lit(-1))
    df = df.withColumn("_p", F.when(more, (F.col("_rare.ends") + SMOOTHING * F.col("_p")) / (F.col("_rare.places") + SMOOTHING)).otherwise(F.col("_p")))
    df = df.withColumn("_p", F.least(F.greatest("_p", F.lit(1e-6)), F.lit(1 - 1e-6)))
    return df.withColumn(into, F.log(F.col("_p") / (1 - F.col("_p")))).drop("_sorted", "_usable", "_best", "_rare", "_shorter", "_p")


def score_ends(docs: DataFrame, key: str, text: str, lang: str, source: str, bitmap_bits: int | None = None) -> DataFrame:
    """(key, lang, source, column, n_chars, log_odds, threshold, capped, cut) for each text that is neither null, empty nor blank;
    ``column`` is the name of the column of the text.

    ``cut`` says whether the text stops before its author's end. Null languages and sources form a group of their own. The whole
    corpus trains the model, repeated rows included, and each text's own end is left out of its score. Long texts are read whole.
    """
    picked = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.xxhash64(text).alias("hash")).where(F.trim("text") != "")
    kinds = dict(picked.dtypes)
    whole = ORDERS.index(WHOLE_SIGN)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TEXTS_AT_ONCE) for b in batches for i in range(0, len(b), TEXTS_AT_ONCE)):
            texts = batch.column(3).to_pylist()
            live = [bool(t.strip()) for t in texts]
            batch, texts = batch.filter(pa.array(live, pa.bool_())), [t for t, x in zip(texts, live) if x]
            signs = [_OMISSION.search(t[-40:]) for t in texts]
            stripped = [t[: len(t) - len(m.group())] if m else "" for t, m in zip(texts, signs)]
            some = [i for i, t in enumerate(stripped) if t.strip()]
            at = np.full(len(texts), -1)
            at[some] = np.arange(len(some))
            bare = end_keys([stripped[i] for i in some]).take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(t) for t in texts], pa.int64()), batch.column(4), batch.column(5), pa.array([t.rstrip()[-1] in _STOP_SIGNS for t in texts], pa.bool_()), end_keys(texts), bare],
                names=["key", "lang", "source", "n_chars", "n_bytes", "hash", "stopped", "full", "bare"],
            )

    ends = picked.mapInArrow(ended, f"key {kinds['key']}, lang string, source string, n_chars bigint, n_bytes bigint, hash bigint, stopped boolean, full array<bigint>, bare array<bigint>")
    ends = materialise(ends.withColumn("row", F.monotonically_increasing_id()), "truncation-ends")
    # Lengths at which a source's texts pile up: at most 1 / CAP_SHARE of each kind for a source.
    lengths = ends.select(F.coalesce("source", F.lit("\x00")).alias("_s"), F.explode(F.array(F.col("n_chars"), -F.col("n_bytes"))).alias("_n"))
    caps = lengths.groupBy("_s", "_n").agg(F.count(F.lit(1)).alias("n"))
    caps = caps.join(caps.groupBy("_s").agg((F.sum("n") / 2).alias("of")), "_s").where((F.col("n") >= CAP_LEAST) & (F.col("n") >= CAP_SHARE * F.col("of")))
    caps = materialise(caps.select(F.xxhash64("_s", "_n").alias("cap")), "truncation-caps")
    piled = share(docs, key_bitmap(caps, "cap", CAP_BITS, mixed=True))
    slot = lambda n: F.pmod(F.xxhash64(F.coalesce("source", F.lit("\x00")), n), F.lit(1 << CAP_BITS))
    by_signs, by_bytes = slot(F.length("text").cast("bigint")), slot(-F.col("n_bytes"))
    marks = ends.select("row", F.explode(F.array(slot(F.col("n_chars")), slot(-F.col("n_bytes")))).alias("slot")).join(caps.select(F.pmod("cap", F.lit(1 << CAP_BITS)).alias("slot")).distinct(), "slot", "left_semi")
    copies = materialise(ends.groupBy(F.col("hash").alias("same")).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("copies")), "truncation-copies")
    n_texts = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ends = lookup(ends, copies, "hash", "same", ["copies"], "n", n_texts).drop("hash")
    ends = ends.join(marks.select("row").distinct().withColumn("capped", F.lit(True)), "row", "left").withColumn("capped", F.coalesce("capped", F.lit(False)))
    # Copies of a text tell nothing of each other's ends: all are left out of its counts, where they were counted.
    ends = materialise(ends.withColumn("own_ends", F.when(F.col("capped") & ~F.col("stopped"), 0).otherwise(F.col("copies"))), "truncation-capped")
    asked = ends.select("row", "own_ends", "copies", F.posexplode("full").alias("place", "ctx"), F.lit(1).alias("own")).unionByName(
        ends.where("bare is not null").select("row", "own_ends", "copies", F.posexplode("bare").alias("place", "ctx"), F.lit(0).alias("own"))
    )
    asked = asked.where(F.col("ctx").isNotNull())
    weights = materialise(asked.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")), "truncation-contexts")
    bitmap_bits = bitmap_bits or bits_for(weights.count(), BITMAP_SLOTS, BITMAP_LEAST, BITMAP_MOST)
    bitmap = share(docs, key_bitmap(weights, "ctx", bitmap_bits, mixed=True))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = lambda keys: passes(bitmap.value, slots(keys, bitmap_bits))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            capped = (passes(piled.value, batch.column(1).to_numpy()) | passes(piled.value, batch.column(2).to_numpy())).tolist()
            start, size, parts = 0, 0, []
            for i, t in enumerate(texts, 1):
                size += len(t or "")
                if size > SIGNS_AT_ONCE or i == len(texts):
                    parts.append(count_contexts(texts[start:i], wanted, capped[start:i]))
                    start, size = i, 0
                if parts and (len(parts) == PARTS_AT_ONCE or i == len(texts)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(parts)], names=["ctx", "ends", "places"])
                    parts = []

    model = picked.select("text", by_signs.alias("signs"), by_bytes.alias("bytes")).mapInArrow(counted, "ctx bigint, ends bigint, places bigint").groupBy("ctx").agg(F.sum("ends").alias("ends"), F.sum("places").alias("places"))
    known = materialise(weights.join(model, "ctx", "left").select(F.col("ctx").alias("entry"), "n", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("places", F.lit(0)).alias("places")), "truncation-model")
    total = weights.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = lookup(asked, known, "ctx", "entry", ["ends", "places"], "n", total)
    # Without its sign of omission a text's end is a place that went on.
    each = F.struct("place", (F.col("ends") - F.col("own") * F.col("own_ends")).alias("ends"), (F.col("places") - F.when(F.col("own") == 1, F.col("own_ends")).otherwise(F.col("copies"))).alias("places"))
    scored = found.groupBy("row").agg(
        F.collect_list(F.when(F.col("own") == 1, each)).alias("full_counts"),
        F.collect_list(F.when(F.col("own") == 0, each)).alias("bare_counts"),
        F.max(F.when((F.col("own") == 1) & (F.col("place") == whole), F.col("places"))).alias("seen"),
    )
    scored = ends.drop("full").join(scored, "row")
    scored = with_odds(with_odds(scored, "full_counts", "usual"), "bare_counts", "without_sign")
    odds = F.when(F.col("bare").isNull() | (F.coalesce("seen", F.lit(0)) >= 3), F.col("usual")).otherwise(F.col("without_sign") - SIGN)
    final = odds - F.when(F.col("capped"), CAPPED).otherwise(0.0)
    scored = materialise(scored.select("key", "lang", "source", "n_chars", final.alias("log_odds"), "capped"), "truncation-scores")
    named = scored.withColumn("column", F.lit(text)).withColumn("_l", F.struct(F.coalesce("lang", F.lit("\x00")).alias("lang"), "column"))
    low, high = int(LOWEST * 2), int(HIGHEST * 2)
    bins = named.groupBy("_l", F.floor(F.col("log_odds") * 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    near = [F.coalesce(F.sum(F.when(F.col("bin").between(b - 1, b), F.col("n"))), F.lit(0)).alias(f"b{b - low}") for b in range(low, high + 1)]
    own = bins.groupBy("_l").agg(*near)
    every = bins.groupBy(F.col("_l.column").alias("column")).agg(F.sum("n").alias("of"), *near)
    every = every.select("column", *[(F.col(f"b{b - low}") / F.col("of") * PRIOR).alias(f"p{b - low}") for b in range(low, high + 1)])
    own = own.withColumn("column", F.col("_l.column")).join(F.broadcast(every), "column")  # one row for each column
    edges = [F.struct((F.col(f"b{b - low}") + F.col(f"p{b - low}")).alias("n"), F.lit(abs(b / 2 - DEFAULT)).alias("far"), F.lit(b / 2).alias("at")) for b in range(low, high + 1)]
    valley = own.select("_l", F.array_min(F.array(*edges))["at"].alias("threshold"))  # the edge with the fewest texts within half a unit
    out = named.join(valley, "_l").select("key", "lang", "source", "column", "n_chars", "log_odds", "threshold", "capped", (F.col("log_odds") < F.col("threshold")).alias("cut"))
    return out.withColumnRenamed("key", key)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap slot of context keys, which are hashes already."""
    return keys & np.int64((1 << bits) - 1)
