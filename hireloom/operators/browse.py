"""Search, facets and totals over the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hireloom.functions.text import contains_like

PAGE = 50


def search_predicate(q: str = "", company: str = "", matched: str = "") -> Column:
    out = F.lit(True)
    if q:
        out = out & (contains_like(F.col("title"), q) | contains_like(F.col("location"), q))
    if company:
        out = out & (F.col("company") == company)
    if matched:
        out = out & (F.col("matched") == 1)
    return out


def search(state: DataFrame, q: str = "", company: str = "", matched: str = "", offset: int = 0, tie: str = "id") -> tuple[DataFrame, DataFrame]:
    """(total, page): the number of hits and one page, newest first; ties are ordered by ``tie`` so that pages never overlap."""
    hits = state.where(search_predicate(q, company, matched))
    page = hits.orderBy(F.desc("first_seen"), F.desc("posted_at"), tie).offset(offset).limit(PAGE)
    return hits.agg(F.count(F.lit(1)).alias("total")), page.select("company", "title", "location", "url", "posted_at", "first_seen", "matched")


def facets(state: DataFrame) -> DataFrame:
    return state.groupBy("company").agg(F.count(F.lit(1)).alias("n_jobs")).orderBy("company")


def totals(state: DataFrame, log: DataFrame) -> DataFrame:
    """One row: total, matched (0 where there is none) and the last run."""
    jobs = state.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"))
    return jobs.crossJoin(log.agg(F.max("run_date").alias("last_run")))  # one row each


_PLAIN = {"ignoreNullFields": "false"}


def jobs_object(state: DataFrame, q: str = "", company: str = "", matched: str = "", offset: int = 0, tie: str = "id") -> DataFrame:
    """One row, one JSON object: the number of hits and one page of them in their order; a page has PAGE rows at most."""
    total, page = search(state, q, company, matched, offset, tie)
    hits = state.where(search_predicate(q, company, matched)).orderBy(F.desc("first_seen"), F.desc("posted_at"), tie).offset(offset).limit(PAGE)
    columns = page.columns
    placed = hits.select(F.struct(F.lit(0).alias("_"), *columns).alias("j"), F.row_number().over(Window.orderBy(F.desc("first_seen"), F.desc("posted_at"), tie)).alias("_n"))
    listed = placed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "j"))), lambda x: F.struct(*[x["j"][c].alias(c) for c in columns])).alias("jobs"))
    return total.crossJoin(listed).select(F.to_json(F.struct("total", "jobs"), _PLAIN).alias("json"))  # one row each


def meta_object(state: DataFrame, log: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row, one JSON object: companies with their number of jobs, totals, the last run and the alerts' texts. Its lists are as
    long as the registry, which one reader's page shows whole."""
    by = facets(state).select(F.struct(F.col("company").alias("name"), F.col("n_jobs").alias("count")).alias("c"))
    listed = by.agg(F.array_sort(F.collect_list("c")).alias("companies"))
    texts = alerts.agg(F.transform(F.array_sort(F.collect_list(F.struct("company", "message"))), lambda x: x["message"]).alias("alerts"))
    return listed.crossJoin(totals(state, log)).crossJoin(texts).select(F.to_json(F.struct("companies", "total", "matched", "last_run", "alerts"), _PLAIN).alias("json"))  # one row each


def as_json(page: DataFrame) -> DataFrame:
    """A page as JSON objects, nulls included."""
    return page.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def run_summary(batch: DataFrame, new_ids: DataFrame) -> DataFrame:
    """(company, jobs, matched, new) of a run."""
    flagged = batch.join(new_ids.select("id").distinct().withColumn("_new", F.lit(1)), "id", "left")
    return flagged.groupBy("company").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("matched") == 1).alias("matched"), F.count_distinct(F.when(F.col("_new") == 1, F.col("id"))).alias("new")
    )
