"""Landed sitemap files, plain or compressed."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file, compressed or inflated, that are read.
BODY_LIMIT = 10 * 1024 * 1024


@F.pandas_udf(T.StringType())
def inflate(bodies: pd.Series) -> pd.Series:
    """Text of a gzip file up to the limit; null where it is larger compressed, or broken."""

    def one(b: bytes | None) -> str | None:
        if b is None or len(b) > BODY_LIMIT:
            return None
        try:
            return zlib.decompressobj(31).decompress(b, BODY_LIMIT).decode("utf-8", "replace")
        except zlib.error:
            return None

    return bodies.map(one)


@F.pandas_udf(T.BinaryType())
def deflate(texts: pd.Series) -> pd.Series:
    """Texts as gzip files."""
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8", "replace"), mtime=0))


def bodies(files: DataFrame) -> DataFrame:
    """(url, body) as text from (url, content binary)."""
    zipped = F.lower("url").endswith(".gz")
    return files.select("url", F.when(zipped, inflate("content")).otherwise(F.substring(F.decode("content", "UTF-8"), 1, BODY_LIMIT)).alias("body"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder whose path below it is the URL without its scheme."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "^.*" + path.rstrip("/").rsplit("/", 1)[-1] + "/"
    return found.select(F.concat(F.lit("https://"), F.regexp_replace("path", root, "")).alias("url"), "content")
