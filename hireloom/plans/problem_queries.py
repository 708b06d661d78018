"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.common import table
from hireloom.operators.timestamps import TimestampDictionary, normalise


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of postings.posted_at and jobs.first_seen that names one instant; jobs reuse the entries that postings left."""
    dictionary = TimestampDictionary(spark)
    found = []
    for src, name, key, raw, zone, reference in (
        ("postings", "postings", "row_id", "posted_at", "board_tz", "fetched_at"),
        ("jobs", "jobs", "seq", "first_seen", "runner_tz", None),
    ):
        columns = [key, raw, zone, *([reference] if reference else [])]
        done = normalise(table(spark, sf_dir, name).select(*columns), raw, zone, reference, dictionary)
        found.append(done.where(F.col("epoch_s").isNotNull()).select(F.lit(src).alias("src"), F.col(key).alias("row_key"), "epoch_s"))
    return found[0].unionByName(found[1])


def queries() -> dict:
    return {"p2_found": p2_found}


def oracle_sql() -> dict[str, str]:
    return {}
