"""Helpers shared by all operators: scratch tables, lineage cuts and skew-safe lookups."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where it is unset, a temporary one is set on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        existing = spark.sparkContext.getCheckpointDir()
        if existing:
            return existing.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hireloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/hireloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the application's own one in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Removes all scratch tables of this application; results that read them must have been written before."""
    discard(spark, scratch_root(spark))


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of scratch tables that nothing will read again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are removed as soon as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, a table is broadcast only where its rows were counted at run time, never by the planner's guess: that starts from the
    compressed size of files and knows nothing of how many rows an explode makes, so it can be a hundred times too low."""
    guessed, counted = spark.conf.get(_GUESSED), spark.conf.get(_COUNTED, None)
    spark.conf.set(_COUNTED, counted or guessed)
    spark.conf.set(_GUESSED, "-1")
    try:
        yield
    finally:
        spark.conf.set(_GUESSED, guessed)
        if counted:
            spark.conf.set(_COUNTED, counted)
        else:
            spark.conf.unset(_COUNTED)


_GUESSED, _COUNTED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark application, so that they need not have it installed."""
    sc = spark.sparkContext
    if _shipped.get("application") == sc.applicationId:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="hireloom-"), "hireloom-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("hireloom", os.path.relpath(full, package)))
    sc.addPyFile(target)
    _shipped["application"] = sc.applicationId


_shipped: dict[str, str] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    return stored(df, scratch_path(df.sparkSession, name))


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """The same in a given folder, for tables that are discarded before the end."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def hot_rows(total: int) -> int:
    """Rows above which a key counts as hot; at most 1 / HOT_SHARE keys of any table are."""
    return max(1000, int(total * HOT_SHARE))


def lookup(rows: DataFrame, dictionary: DataFrame, key: str, entry: str, payload: list[str], weight: str, total: int) -> DataFrame:
    """Left-joins a dictionary of distinct keys (column ``entry``) to its rows without sending a hot key to one task.

    ``weight`` is an entry's number of rows, of ``total``. Hot entries, at most 1 / HOT_SHARE of them, are broadcast; all others
    meet in a shuffled join, in which null keys and rows that are already answered get a key of their own, so they spread evenly.
    """
    hot = dictionary.where(F.col(weight) > hot_rows(total)).select(F.col(entry).alias("_hot_key"), F.struct(*payload).alias("_hot"))
    rest = dictionary.where(F.col(weight) <= hot_rows(total)).select(F.col(entry).alias("_rest_key"), F.struct(*payload).alias("_rest"))
    kind = dict(dictionary.dtypes)[entry]
    own = F.monotonically_increasing_id()
    own = F.concat(F.lit("\x00"), own.cast("string")) if kind == "string" else (-own - 2).cast(kind)
    joined = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    joined = joined.withColumn("_probe", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own))
    joined = joined.join(rest, F.col("_probe") == F.col("_rest_key"), "left")
    for p in payload:
        joined = joined.withColumn(p, F.coalesce(F.col("_hot")[p], F.col("_rest")[p]))
    return joined.drop("_hot_key", "_hot", "_rest_key", "_rest", "_probe")


#: Members of a group that meet in one task's cell, about.
SLOT = 2_000


def slots(members: DataFrame, group: str, key: str, slot: int = SLOT) -> tuple[DataFrame, DataFrame]:
    """(members with ``slot``, sizes (group, n_slots)): groups of more than ``slot`` members are dealt by a hash of their keys."""
    sizes = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(slot)).cast("int").alias("n_slots"))
    return members.join(sizes, group).select(group, key, F.pmod(F.xxhash64(key), F.col("n_slots").cast("bigint")).cast("int").alias("slot"), "n_slots"), sizes


def pairs_within(placed: DataFrame, sizes: DataFrame, group: str, key: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of each two members of a group, from ``slots``: each two slots meet in a cell of their own."""
    cells = sizes.select(group, "n_slots").withColumn("slot_a", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)))
    cells = cells.withColumn("slot_b", F.explode(F.sequence(F.col("slot_a"), F.col("n_slots") - 1))).drop("n_slots")
    a, b = (placed.select(group, F.col("slot").alias(f"slot_{s}"), F.col(key).alias(f"_{s}")) for s in ("a", "b"))
    met = cells.join(a, [group, "slot_a"]).join(b, [group, "slot_b"])
    met = met.where((F.col("_a") < F.col("_b")) | ((F.col("slot_a") != F.col("slot_b")) & (F.col("_a") != F.col("_b"))))
    return met.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b"))
