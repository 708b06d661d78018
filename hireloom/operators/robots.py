"""Crawl rules over tables of robots files and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hireloom.common import lookup, materialise
from hireloom.functions.urls import blocked_reason, is_ats_api, part, url_path

#: Characters of a robots file that are read.
BODY_LIMIT = 512 * 1024
#: Hosts whose intervals are broadcast at most; more are shuffled.
MOST_DELAYS = 100_000


def rule_lines(files: DataFrame, agent: str) -> DataFrame:
    """(host, seq, field, value) of the lines that count for ``agent``, from (host, body).

    Blank lines and comments go; user-agent lines after rules start a new group; the first group that names the agent beats the
    groups of *, of which the first holds. Sitemap lines count wherever they stand.
    """
    lines = files.select("host", F.posexplode(F.split(F.substring("body", 1, BODY_LIMIT), r"\r\n|\r|\n")).alias("seq", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").contains(":"))
    field, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("host", "seq", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap"))
    inside = lines.where("field <> 'sitemap'")
    order = Window.partitionBy("host").orderBy("seq")
    names = F.col("field") == "user-agent"
    starts = names & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    grouped = inside.withColumn("group", F.sum(starts.cast("int")).over(order)).where("group > 0")
    called = F.lower("value")
    named = (called != "") & (called != "*") & F.lit(agent.lower()).contains(F.substring_index(called, "/", 1))
    groups = grouped.where(names).groupBy("host", "group").agg(F.max(named.cast("int")).alias("own"), F.max((called == "*").cast("int")).alias("any"))
    chosen = groups.where("own = 1 or any = 1").groupBy("host").agg(F.min_by("group", F.struct(-F.col("own"), F.col("group"))).alias("group"))
    rules = grouped.where(~names).join(chosen, ["host", "group"]).select("host", "seq", "field", "value")
    return rules.unionByName(lines.where("field = 'sitemap'").select("host", "seq", "field", "value"))


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression from the start of the path: * matches anything, a last $ the end."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.+?()\[\]{}|^$])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))


def decide(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """(url, allowed) for distinct URLs: of the rules that match, the longest wins, allow at a tie; without one all is allowed.

    The rules of a host, as many as a robots file of bounded size holds, are one row; URLs look it up, without sending the URLs of
    a host with many of them to one task.
    """
    rules = rule_lines(files, agent).where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    each = F.struct(F.length("value").alias("size"), (F.col("field") == "allow").alias("allow"), pattern_regex(F.col("value")).alias("regex"))
    by_host = rules.groupBy("host").agg(F.collect_list(each).alias("rules"))
    probes = urls.select("url").distinct().withColumn("host", F.lower(part(F.col("url"), "authority"))).withColumn("path", url_path(F.col("url")))
    sizes = materialise(probes.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("n")), "robots-hosts")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dictionary = materialise(sizes.join(by_host, F.col("_host") == F.col("host")).select(F.col("_host").alias("entry"), "n", "rules"), "robots-rules")
    met = lookup(probes, dictionary, "host", "entry", ["rules"], "n", total)
    hits = F.filter("rules", lambda r: F.rlike(F.col("path"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    return met.select("url", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def gate(urls: DataFrame, files: DataFrame, agent: str, least: float = 1.0) -> DataFrame:
    """(url, outcome, reason, seconds) for distinct URLs: what a request would meet, in this order.

    A URL that may not be fetched at all is blocked, with why; an API of boards is fetched without asking the crawl rules; a URL
    that they disallow is blocked ("robots"); all else is fetched, at the interval its host asks for but never below ``least``.
    """
    probes = urls.select("url").distinct()
    facts = probes.select("url", blocked_reason(F.col("url")).alias("why"), is_ats_api(F.col("url")).alias("api"), F.lower(part(F.col("url"), "authority")).alias("host"))
    asked = facts.where(F.col("why").isNull() & ~F.col("api"))
    rules = decide(asked, files, agent).select("url", "allowed")
    delays = request_interval(files, agent, least).select("host", F.col("seconds").alias("asked_s"))
    met = facts.join(rules, "url", "left").join(F.broadcast(delays), "host", "left") if delays.count() <= MOST_DELAYS else facts.join(rules, "url", "left").join(delays, "host", "left")
    reason = F.coalesce("why", F.when(~F.col("allowed"), "robots"))
    seconds = F.when(reason.isNull(), F.when(F.col("api"), F.lit(least)).otherwise(F.coalesce("asked_s", F.lit(least))))
    return met.select("url", F.when(reason.isNull(), "fetch").otherwise("blocked").alias("outcome"), reason.alias("reason"), seconds.alias("seconds"))


def request_interval(files: DataFrame, agent: str, least: float = 1.0) -> DataFrame:
    """(host, seconds): the larger of the own floor and what the host asks for."""
    delays = rule_lines(files, agent).where("field = 'crawl-delay'").groupBy("host").agg(F.min_by("value", "seq").alias("value"))
    joined = files.select("host").distinct().join(delays, "host", "left")
    return joined.select("host", F.greatest(F.lit(least), F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))).alias("seconds"))
