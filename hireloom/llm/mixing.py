"""Mixing sources to target shares of the total token count (problem 9).

Shares follow a temperature path between the wanted shares and what the sources hold: weight of a source is proportional to
target ** (1 - e) * held ** e, where e = 0 gives the targets and e = 1 what is held. The exponent is bisected to the smallest at
which no source needs more than its repetition limit. Without a size budget the largest size is taken at which e = 0 is
possible. With a wanted entropy the targets give way to plain temperature: weights are proportional to held ** e, and the exponent
is bisected to that entropy. Weights are then realised as budgeted block permutations: each pass over a source permutes its documents by a seeded
hash, cut into equal blocks; whole blocks are taken while the pass's budget lasts, only the last block is ranked document by
document. No group of a source's documents ever meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hireloom.common import materialise

#: Blocks that each pass over a source is cut into.
BLOCKS = 4096
#: As a budget: as many tokens as the sources hold together.
HELD = "held"
#: As an entropy: that of the targets.
TARGETS = "targets"


def entropy_of(shares: list[float]) -> float:
    """Entropy of shares in nats."""
    total = sum(shares)
    return -sum(x / total * math.log(x / total) for x in shares if x > 0)


def weights(held: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: int | str | None, entropy: float | str | None = None) -> tuple[dict[str, float], int, float]:
    """(weight of each source, size of the mixture in tokens, exponent). Sources that hold nothing get weight 0.

    An ``entropy`` beyond what exponents from 0 to 1 reach is met as nearly as they can.
    """
    live = [s for s in targets if held.get(s, 0) > 0 and targets[s] > 0 and repeats.get(s, 0) > 0]
    if not live:
        return dict.fromkeys(targets, 0.0), 0, 0.0
    total_target, total_held = sum(targets[s] for s in live), sum(held[s] for s in live)
    most = {s: held[s] * repeats[s] for s in live}

    def at(e: float) -> dict[str, float]:
        logs = {s: (1 - e) * (math.log(targets[s] / total_target) if entropy is None else 0.0) + e * math.log(held[s] / total_held) for s in live}
        top = max(logs.values())
        raw = {s: math.exp(x - top) for s, x in logs.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    if budget == HELD:
        budget = total_held
    start = 0.0
    if entropy is not None:  # entropy falls from that of equal shares at 0 to that of what is held at 1
        wanted, low, high = entropy_of([targets[s] for s in live]) if entropy == TARGETS else float(entropy), 0.0, 1.0
        for _ in range(60):
            e = (low + high) / 2
            low, high = (low, e) if entropy_of([*at(e).values()]) <= wanted else (e, high)
        start = high
    fits = lambda w, size: all(w[s] * size <= most[s] * (1 + 1e-12) for s in live)
    size = int(min(most[s] / at(start)[s] for s in live)) if budget is None else min(budget, sum(most.values()))
    low, high = start, 1.0
    if entropy is not None or fits(at(start), size):
        high = start
    elif fits(at(1.0), size):
        for _ in range(60):
            e = (low + high) / 2
            low, high = (low, e) if fits(at(e), size) else (e, high)
    w = at(high)
    # Beyond the limit of every exponent the capped sources are full and the others share the rest in proportion.
    full: set[str] = set()
    while over := {s for s in live if s not in full and w[s] * size > most[s] * (1 + 1e-12)}:
        full |= over
        rest, share = size - sum(most[s] for s in full), sum(w[s] for s in live if s not in full)
        w = {s: most[s] / size if s in full else w[s] * rest / size / share for s in live}
    return {s: w.get(s, 0.0) for s in targets}, size, high


def mix(sizes: DataFrame, targets: DataFrame, key: str, source: str, n_tokens: str, budget: int | str | None = None, entropy: float | str | None = None, seed: int = 7, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) for ``sizes`` (key, source, n_tokens) and ``targets`` (source, target_share, max_repeats); ``budget`` (tokens,
    or HELD) and ``entropy`` (nats, or TARGETS) choose what the exponent is bisected for.

    mixture: (key, source, repeat_no from 1, n_tokens, position), a row for each use of a document; sorting by position
    interleaves the sources evenly. shares: a row for each target source with held and used tokens, documents, the wanted and
    the actual share and whether the target is met within one document per pass.

    Targets are one row for each source, so they are read to the driver, as are the totals of those sources alone; documents of
    null or other sources aren't used. Documents without tokens belong to every pass of their source. A repeated target row
    counts once (largest share). Empty tables give an empty mixture and the targets with share 0.
    """
    wanted = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("r"))
    names = wanted.select(F.col(source).alias("source"), F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    rows = names.collect()
    docs = sizes.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.col(n_tokens), F.lit(0)).alias("n")).join(
        F.broadcast(names.select("source")), "source", "left_semi"
    )
    docs = materialise(docs, "mix-sizes")
    held = {r["source"]: (r["tokens"] or 0, r["docs"]) for r in docs.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    targets_by, repeats_by = {r["source"]: float(r["t"]) for r in rows}, {r["source"]: int(r["r"]) for r in rows}
    w, size, exponent = weights({s: t for s, (t, _) in held.items()}, targets_by, repeats_by, budget, entropy)
    passes = []
    for s, share in w.items():
        quota, each, p = round(share * size), held.get(s, (0, 0))[0], 0
        while quota > 0 and each > 0 and p < repeats_by[s]:
            p += 1
            passes.append((s, p, min(quota, each), min(quota, each) >= each))
            quota -= each
    schema = "source string, repeat_no int, quota bigint, whole boolean"
    spark = sizes.sparkSession
    plan = F.broadcast(spark.createDataFrame(passes, schema))
    used = docs.join(plan, "source").withColumn("_h", F.xxhash64(F.lit(seed), "repeat_no", "key"))
    used = used.withColumn("_b", F.pmod("_h", F.lit(blocks)))
    partial = used.where(~F.col("whole"))
    by_block = partial.groupBy("source", "repeat_no", "_b").agg(F.sum("n").alias("bn"))
    order = Window.partitionBy("source", "repeat_no").orderBy("_b")  # at most BLOCKS rows a group
    before = by_block.withColumn("_before", F.sum("bn").over(order) - F.col("bn")).join(plan.drop("whole"), ["source", "repeat_no"]).where(F.col("_before") < F.col("quota"))
    before = before.select("source", "repeat_no", "_b", "_before", (F.col("_before") + F.col("bn") <= F.col("quota")).alias("fits"))
    placed = partial.join(F.broadcast(before), ["source", "repeat_no", "_b"])  # at most BLOCKS rows for each partial pass
    inside = Window.partitionBy("source", "repeat_no").orderBy("_h", "key").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(~F.col("fits"))  # one block of each partial pass
    ranked = last.withColumn("_upto", F.col("_before") + F.sum("n").over(inside)).where(F.col("_upto") <= F.col("quota"))
    ranked = placed.where("fits").select("key", "source", "repeat_no", "n", "_h", "_b").unionByName(ranked.select("key", "source", "repeat_no", "n", "_h", "_b"))
    columns = ["key", "source", "repeat_no", "n", "_h", "_b"]
    taken = used.where("whole").select(*columns).unionByName(ranked.select(*columns))
    n_passes = {s: sum(1 for x in passes if x[0] == s) for s in w}
    parts = spark.createDataFrame([(s, n) for s, n in n_passes.items()], "source string, _passes int")
    position = (F.col("repeat_no") - 1 + (F.col("_b") + F.pmod(F.shiftright("_h", 16), F.lit(65536)) / 65536.0) / blocks) / F.col("_passes")
    mixture = taken.join(F.broadcast(parts), "source").select(
        F.col("key").alias(key), "source", "repeat_no", F.col("n").alias("n_tokens"), position.alias("position")
    )
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("used_rows"), F.max("repeat_no").alias("most_repeats"))
    stats = spark.createDataFrame(
        [(s, targets_by[s], repeats_by[s], *held.get(s, (0, 0)), float(w[s]), float(exponent)) for s in targets_by],
        "source string, target_share double, max_repeats int, held_tokens bigint, held_docs bigint, weight double, exponent double",
    )
    shares = F.broadcast(stats).join(got, "source", "left").na.fill(0, ["used_tokens", "used_rows", "most_repeats"])
    shares = shares.crossJoin(F.broadcast(got.agg(F.sum("used_tokens").alias("_all"))))
    actual = F.coalesce(F.col("used_tokens") / F.col("_all"), F.lit(0.0))
    return mixture, shares.withColumn("actual_share", actual).withColumn("target_met", F.abs(actual - F.col("target_share")) <= 0.005).drop("_all")
