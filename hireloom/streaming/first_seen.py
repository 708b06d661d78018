"""First-seen deduplication and error streaks as streams: each micro-batch adds what it changes to a state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hireloom.common import materialise
from hireloom.operators.store import DeltaState, KeyedLog, MergeResult


def run_first_seen(
    stream: DataFrame, state: DeltaState, announced: KeyedLog, checkpoint: str, order: str, now: Callable[[int], str], on_batch: Callable[[MergeResult, int], None] | None = None
) -> StreamingQuery:
    """Starts a query that merges all available rows and ends; the state is unbounded and never forgets an id.

    A micro-batch writes its new ids and changed flags, nothing else. They are written before anything is announced, so an id is
    announced at most once. A batch that is run again after a failure finds its ids in the state and announces nothing twice.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        result = state.merge(batch, order, now(epoch), f"epoch{epoch}")
        announced.write(result.fresh, f"epoch{epoch}")
        if on_batch:
            on_batch(result, epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def error_streaks(log: DataFrame) -> DataFrame:
    """Current run of errors of each company over all of its runs, in the order of seq; batch form."""
    runs = log.where("status <> 'skipped'")
    last_good = runs.groupBy("company").agg(F.max(F.when(F.col("status") != "error", F.col("seq"))).alias("good"))
    joined = runs.join(last_good, "company").where("status = 'error' and (good is null or seq > good)")
    return joined.groupBy("company").agg(F.count(F.lit(1)).alias("streak"))


STREAKS = "company string, streak bigint, last_seq bigint"


def merge_streaks(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The streaks (STREAKS) after more runs (company, seq, status): errors behind the batch's last other run, added to the old streak where there is none.

    Runs at or below a company's last_seq were counted before, so a batch that comes twice changes nothing.
    """
    runs = batch.where("status <> 'skipped'").join(state.select("company", F.col("last_seq").alias("_seen")), "company", "left")
    runs = runs.where(F.col("_seen").isNull() | (F.col("seq") > F.col("_seen")))
    good = F.max(F.when(F.col("status") != "error", F.col("seq")))
    part = runs.groupBy("company").agg(good.alias("_good"), F.max("seq").alias("_last"), F.sort_array(F.collect_set(F.when(F.col("status") == "error", F.col("seq")))).alias("_errors"))
    after = F.when(F.col("_good").isNull(), F.size("_errors")).otherwise(F.size(F.filter("_errors", lambda s: s > F.col("_good"))))
    joined = state.join(part, "company", "full")
    streak = F.when(F.col("_last").isNull(), F.col("streak")).otherwise(after + F.when(F.col("_good").isNull(), F.coalesce("streak", F.lit(0))).otherwise(0))
    return joined.select("company", streak.cast("bigint").alias("streak"), F.coalesce("_last", "last_seq").alias("last_seq"))


def run_streaks(stream: DataFrame, state: KeyedLog, checkpoint: str) -> StreamingQuery:
    """Keeps the streaks of all companies up to date from a stream of run-log rows; a micro-batch writes those of its companies."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = materialise(batch, "streaks-batch")
        named = batch.select("company").distinct()
        held = state.read(named).join(named, "company", "left_semi")
        state.write(merge_streaks(held, batch), f"epoch{epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
