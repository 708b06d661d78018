"""Every core query with SQL beside it gives the same rows in DuckDB, over whole tables."""

import glob
import os
from html import unescape

import duckdb
import pandas as pd
import pytest

from hireloom.plans import core_queries
from hireloom.plans.core_sql import SQL
from hireloom.sources.html import clean_text


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "null"
        return str(v) if isinstance(v, (str, bool)) or str(v) in ("True", "False") else f"{float(v):.6f}"

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    assert rows(core_queries.queries()[name](spark, data).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(core_queries.queries()) - set(SQL)))
def test_texts_are_those_of_the_functions(spark, data, duck, name):
    """Queries that SQL can't express: each row's text by the function itself, over the whole table."""
    one = {"page_text": clean_text, "unescaped": lambda t: None if t is None else unescape(t)}[name]
    want = {r[0]: one(r[1]) for r in duck.execute("SELECT row_id, description FROM postings").fetchall()}
    assert {r["row_id"]: r["text"] for r in core_queries.queries()[name](spark, data).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "company", "title", "first_seen", "matched"]
    assert set(e.oracle_sql()) <= set(e.queries())
