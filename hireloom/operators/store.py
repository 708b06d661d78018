"""First-seen state: deduplication, merge of batches, change detection and small caches."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hireloom.common import materialise
from hireloom.functions.dates import utc


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order of a unique column: one aggregation with partial results, not an arbitrary pick."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row written for each key: replace by key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def collapse(batch: DataFrame, order: str) -> DataFrame:
    """One row for each id: attributes of the first copy, matched where any copy is."""
    rows = batch.groupBy("id").agg(F.min_by(F.struct(*[c for c in batch.columns if c not in ("id", "matched")]), order).alias("_row"), F.max(F.col("matched").cast("int")).alias("matched"))
    return rows.select("id", "_row.*", "matched").drop(order)


@dataclass
class MergeResult:
    state: DataFrame
    new: DataFrame
    fresh: DataFrame
    seed: bool


def merge(state: DataFrame, batch: DataFrame, order: str, now: str) -> MergeResult:
    """Adds never-seen ids to the state and refreshes ``matched`` of seen ones.

    state has STATE's columns, batch the same without first_seen plus ``order``. ``new`` are the ids the state didn't have,
    ``fresh`` those of them that match; with an empty state (seed) nothing is fresh. Null ids are no postings.
    """
    seed = state.isEmpty()
    rows = collapse(batch.where(F.col("id").isNotNull()), order)
    new = rows.join(state.select("id"), "id", "left_anti").withColumn("first_seen", F.lit(now)).select(*state.columns)
    flags = rows.select("id", F.col("matched").alias("_new"))
    kept = state.join(flags, "id", "left").withColumn("matched", F.coalesce("_new", "matched")).drop("_new").select(*state.columns)
    fresh = new.where(F.lit(not seed) & (F.col("matched") == 1))
    return MergeResult(kept.unionByName(new), new, fresh, seed)


class VersionedTable:
    """A table as numbered Parquet folders and a pointer: readers never see a half-written version, a path is never overwritten."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        if not self._fs.exists(self._at(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> int:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        return v

    def append(self, df: DataFrame) -> None:
        """For logs: rows are added to the newest version."""
        df.write.mode("append").parquet(f"{self.path}/v{max(1, self.version())}")


class KeyedLog:
    """Rows of a key as they were written, in folders that are only ever added: the last one written is what a key holds.

    A marker written last makes a folder count, so a write that was killed is simply made again; a write of a name that counts
    already is none. A folder is split by a hash of the key into as many parts as its rows need, so reading some keys opens only
    their parts; what a write costs follows its rows, not the table. Folders are put together when they become many.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, part_rows: int = 100_000, most_folders: int = 24):
        self.spark, self.path, self.schema, self.key, self.part_rows, self.most_folders = spark, path.rstrip("/"), schema, key, part_rows, most_folders
        self.columns = [c.split()[0] for c in schema.split(", ")]
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> dict[str, int]:
        """The folders that count, in the order of writing, with their number of parts; what a later one replaces doesn't."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))] if self._fs.exists(self._at(self.path)) else []
        marks = sorted(n[: -len(".done")] for n in names if n.endswith(".done"))
        whole = [m for m in marks if m.split("~")[1] == "all"]
        return {m: int(m.split("~")[3]) for m in marks if not whole or m >= whole[-1]}

    def _bucket(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(parts)).cast("int")

    def _write(self, df: DataFrame, kind: str, name: str, at: int) -> None:
        df = materialise(df.select(*self.columns), "log-rows")
        parts = max(1, -(-df.count() // self.part_rows))
        folder = f"{at:012d}~{kind}~{name}~{parts}"
        df.withColumn("_bucket", self._bucket(parts)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        self._fs.create(self._at(f"{self.path}/{folder}.done"), True).close()

    def write(self, df: DataFrame, name: str) -> None:
        """Adds rows, one for each key, under a name of letters and digits; rows of a key written before no longer count."""
        held = self.folders()
        if any(m.split("~")[2] == name for m in held):
            return
        last = max((int(m.split("~")[0]) for m in held), default=0)
        self._write(df, "add", name, last + 1)
        if len(held) + 1 > self.most_folders:
            self._write(self.read(), "all", name, last + 2)

    def read(self, asked: DataFrame | None = None) -> DataFrame:
        """What each key holds; with ``asked``, a table with the key, only from the parts that its keys fall into."""
        out = None
        for place, (m, parts) in enumerate(self.folders().items()):
            df = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/{m}")
            if asked is not None and parts > 1:
                df = df.where(F.col("_bucket").isin([r[0] for r in asked.select(self._bucket(parts).alias("b")).distinct().collect()]))
            df = df.select(*self.columns, F.lit(place).alias("_place"))
            out = df if out is None else out.unionByName(df)
        if out is None:
            return self.spark.createDataFrame([], self.schema)
        return out.groupBy(self.key).agg(F.max_by(F.struct(*self.columns), "_place").alias("_row")).select("_row.*")


class DeltaState:
    """The first-seen state as new rows and as changes of ``matched``: what a batch writes follows the batch, not the state."""

    def __init__(self, spark: SparkSession, path: str, schema: str, **sizes: int):
        kinds = dict(c.split() for c in schema.split(", "))
        self.rows, self.flags = KeyedLog(spark, f"{path}/rows", schema, "id", **sizes), KeyedLog(spark, f"{path}/flags", f"id string, matched {kinds['matched']}", "id", **sizes)

    def read(self, asked: DataFrame | None = None) -> DataFrame:
        flags = self.flags.read(asked).withColumnRenamed("matched", "_new")
        return self.rows.read(asked).join(flags, "id", "left").withColumn("matched", F.coalesce("_new", "matched")).select(*self.rows.columns)

    def is_empty(self) -> bool:
        return not self.rows.folders() or self.rows.read().isEmpty()

    def merge(self, batch: DataFrame, order: str, now: str, name: str) -> MergeResult:
        """As ``merge``, but reads only the parts of the batch's ids, and writes only its new ids and changed flags; ``state`` of the
        result holds the ids of the batch. A batch of a name that was merged before adds nothing and has nothing new."""
        batch = materialise(batch.where(F.col("id").isNotNull()), "state-batch")
        seed = self.is_empty()
        old = self.read(batch)
        result = merge(old.join(batch.select("id").distinct(), "id", "left_semi"), batch, order, now)
        new = materialise(result.new, "state-new")
        changed = old.select("id", F.col("matched").alias("_old")).join(result.state.select("id", "matched"), "id").where("matched <> _old").select("id", "matched")
        changed = materialise(changed, "state-changed")
        state = materialise(result.state, "state-seen")
        self.rows.write(new, name)
        self.flags.write(changed, name)
        return MergeResult(state, new, new.where(F.lit(not seed) & (F.col("matched") == 1)), seed)


def page_changes(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """(url, status_code, body, ...) against (url, body_sha1): adds body_sha1 and ``outcome``, 'unchanged' for status 304 or an equal hash, else 'changed'.

    Pages are only marked; the cache is replaced after the changed ones were parsed, so a failed parse is fetched again.
    """
    known = cache.select("url", F.col("body_sha1").alias("_old"))
    hashed = pages.withColumn("body_sha1", F.sha1(F.col("body").cast("binary")))
    same = (F.col("status_code") == 304) | (F.col("body_sha1") == F.col("_old"))
    return hashed.join(known, "url", "left").withColumn("outcome", F.when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")).drop("_old")


def live(cache: DataFrame, fetched_at: str, ttl_seconds: int, as_of: datetime) -> DataFrame:
    """Entries younger than the time to live; an unreadable time is a miss, an empty body a hit."""
    age = F.unix_seconds(utc(as_of)) - F.unix_seconds(F.col(fetched_at).try_cast("timestamp"))
    return cache.where(age < ttl_seconds)


def log_run(log: DataFrame, outcomes: DataFrame, run_date: str) -> DataFrame:
    """The rows (seq, run_date, company, status, jobs_found, error) that a run adds to the log, one for each company of its outcomes,
    numbered on from the log's last row; a registry's length, so they are numbered in one task."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    numbered = outcomes.withColumn("_n", F.row_number().over(Window.orderBy("company"))).crossJoin(F.broadcast(last))  # one row
    seq = (F.col("_last") + F.col("_n")).cast("bigint")
    return numbered.select(seq.alias("seq"), F.lit(run_date).alias("run_date"), "company", "status", "jobs_found", F.coalesce("error", F.lit("")).alias("error"))


def commit_pages(cache: DataFrame, pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """The page cache after a run: pages (url, body_sha1, outcome, ...) replace their entry only where they were changed and their
    parse is among ``parsed`` (url), so a page whose parse failed is read again next time. A 304 has nothing to store."""
    good = pages.where((F.col("outcome") == "changed") & F.col("body_sha1").isNotNull()).join(parsed.select("url").distinct(), "url", "left_semi")
    fresh = good.groupBy("url").agg(F.max("body_sha1").alias("body_sha1"))
    return cache.select("url", "body_sha1").join(fresh.select("url"), "url", "left_anti").unionByName(fresh)
