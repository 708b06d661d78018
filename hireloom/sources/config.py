"""Registry and filters from YAML, token files from text, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.functions.match import Filters
from hireloom.operators.discovery import token_lines

#: Columns of the registry table; ``entry`` holds the whole entry as YAML.
REGISTRY = "name string, tier int, ats string, token string, entry string"


class ConfigFile:
    """A YAML file below one path: read whole, and only ever replaced by a whole new one, so that no reader sees half of it."""

    def __init__(self, spark: SparkSession, path: str):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.spark, self.path = spark, hadoop.Path(path)
        self.making = hadoop.Path(path + ".making")
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def text(self) -> str:
        if not self.fs.exists(self.path):
            return ""
        stream = self.fs.open(self.path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def value(self):
        import yaml

        return yaml.safe_load(self.text())

    def replace(self, text: str) -> None:
        out = self.fs.create(self.making, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        self.fs.delete(self.path, False)
        self.fs.rename(self.making, self.path)

    def with_entries(self, entries: list[dict], keep: bool) -> None:
        """Writes checked entries, behind what the file holds, comments too, or in its place."""
        import yaml

        wrong = [e for e in entries if not isinstance(e, dict) or not e.get("name")]
        if wrong:
            raise ValueError(f"an entry needs a name: {wrong[0]!r}")
        held = self.text() if keep else ""
        made = "".join(yaml.safe_dump([e], sort_keys=False, allow_unicode=True) for e in entries)
        self.replace(held + ("" if not held or held.endswith("\n") else "\n") + made)


def valid_entry(name: Column, ats: Column) -> Column:
    """Whether an entry can be run: it has a name and a kind."""
    return (F.coalesce(name, F.lit("")) != "") & (F.coalesce(ats, F.lit("")) != "")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry table of a YAML list of entries; items that are no mapping or can't be run are left out."""
    import yaml

    items = [e for e in ConfigFile(spark, path).value() or () if isinstance(e, dict)]
    rows = [(e.get("name"), int(e.get("tier") or 0), e.get("ats"), e.get("token"), yaml.safe_dump(e, allow_unicode=True)) for e in items]
    return spark.createDataFrame(rows, REGISTRY).where(valid_entry(F.col("name"), F.col("ats")))


def add_entry(path: str, entry: dict) -> None:
    """One more entry behind those of a file."""
    ConfigFile(SparkSession.active(), path).with_entries([entry], keep=True)


def rewrite(path: str, entries: list[dict]) -> None:
    """A file of these entries only."""
    ConfigFile(SparkSession.active(), path).with_entries(entries, keep=False)


def filters(path: str) -> Filters:
    held = ConfigFile(SparkSession.active(), path).value() or {}
    listed = {k: tuple(held.get(k) or ()) for k in ("roles", "locations")}
    return Filters(**listed, include_remote=bool(held.get("include_remote")), experience=str(held.get("experience") or ""), max_days_old=held.get("max_days_old"))


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """Names of a token file; none where the file is missing."""
    lines = ConfigFile(spark, path).text().splitlines()
    return token_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
