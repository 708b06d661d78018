"""Health of sources, from the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Runs looked back on, and consecutive errors that make an alert.
LAST_RUNS, STREAK = 10, 2


def _latest(log: DataFrame, n: int) -> DataFrame:
    """The last n rows of each company by seq, numbered from the newest; a rank limit in each task precedes the shuffle."""
    order = Window.partitionBy("company").orderBy(F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def run_state(log: DataFrame) -> DataFrame:
    """(company, streak, last_status, last_error) over the last runs that weren't skipped; streak counts leading errors."""
    last = _latest(log.where("status <> 'skipped'"), LAST_RUNS)
    return last.groupBy("company").agg(
        F.coalesce(F.min(F.when(F.col("status") != "error", F.col("rn"))) - 1, F.count(F.lit(1))).alias("streak"),
        F.max(F.when(F.col("rn") == 1, F.col("status"))).alias("last_status"),
        F.max(F.when(F.col("rn") == 1, F.col("error"))).alias("last_error"),
    )


def health_alerts(log: DataFrame) -> DataFrame:
    """(company, kind, streak, cur, prev, message): failing sources, newly blocked ones, and ones whose postings fell to none."""
    ok = _latest(log.where("status = 'ok'"), 2)
    two = ok.groupBy("company").agg(F.max(F.when(F.col("rn") == 1, F.col("jobs_found"))).alias("cur"), F.max(F.when(F.col("rn") == 2, F.col("jobs_found"))).alias("prev"), F.count(F.lit(1)).alias("n_ok"))
    w = run_state(log).join(two, "company", "left")
    failing, blocked = F.col("streak") >= STREAK, F.col("last_status") == "blocked"
    kind = F.when(failing, "failing").when(blocked & F.col("n_ok").isNotNull(), "blocked").when(~blocked & (F.col("cur") == 0) & (F.col("prev") > 0), "zero_drop")
    error = F.substring(F.coalesce("last_error", F.lit("")), 1, 120)
    message = (
        F.when(F.col("kind") == "failing", F.concat("company", F.lit(": "), F.col("streak").cast("string"), F.lit(" consecutive failed runs ("), error, F.lit(")")))
        .when(F.col("kind") == "blocked", F.concat("company", F.lit(": blocked — "), error))
        .otherwise(F.concat("company", F.lit(": 0 jobs found (was "), F.col("prev").cast("string"), F.lit(") — parser may be broken")))
    )
    return w.withColumn("kind", kind).where("kind is not null").select("company", "kind", "streak", "cur", "prev", message.alias("message"))
