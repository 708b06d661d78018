"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.common import materialise, table
from hireloom.llm import boilerplate, history, linking, mixing, markup, names, neardup, tokens, truncation


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document and how many joins its tree took."""
    return tokens.tree_shape(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str, budget: int | str | None = None, entropy: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(tokens.count_tokens(docs, "text"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens", budget, entropy)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture that meets every target share: a row for each use of a document."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual share of each source in that mixture."""
    return _mixed(spark, sf_dir)[1]


def p9_shares_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture as large as all repeats allow, where the targets can't be met."""
    return _mixed(spark, sf_dir, budget=1 << 62)[1]


def p9_mix_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of as many tokens as the sources hold: shares leave the targets as far as the repetition limits make them."""
    return _mixed(spark, sf_dir, budget=mixing.HELD)[0]


def p9_shares_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual share of each source in that mixture, and the exponent it was found at."""
    return _mixed(spark, sf_dir, budget=mixing.HELD)[1]


def p9_shares_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of as many tokens as are held, at the temperature at which they are as evenly spread as the targets."""
    return _mixed(spark, sf_dir, budget=mixing.HELD, entropy=mixing.TARGETS)[1]


def _neardup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "postings").select("row_id", "title", "description")
    return neardup.near_duplicates(rows, "row_id", "title", "description", k=3, threshold=0.7, least_words=30)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of postings alike in at least 0.7 of their three-word runs."""
    pairs = neardup.all_pairs(*_neardup(spark, sf_dir))
    return pairs.select(F.col("key_a").alias("row_id_a"), F.col("key_b").alias("row_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of alike postings that each posting belongs to."""
    groups = neardup.components(*_neardup(spark, sf_dir))
    return groups.select(F.col("key").alias("row_id"), "rep", "class_id", "n_links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list entry of each location and title, -1 where there is none."""
    postings = table(spark, sf_dir, "postings").select("row_id", "location", "title")
    locations = linking.map_values(postings, "row_id", "location", linking.location_gazetteer(table(spark, sf_dir, "ref_locations")))
    roles = linking.map_values(postings, "row_id", "title", linking.role_gazetteer(table(spark, sf_dir, "ref_roles")))
    return locations.select("row_id", F.lit("location").alias("field"), "ref_id").unionByName(roles.select("row_id", F.lit("title").alias("field"), "ref_id"))


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry and their number of rows."""
    postings = table(spark, sf_dir, "postings").select("row_id", "location", "title")
    found = []
    for name, gazetteer in (("location", linking.location_gazetteer(table(spark, sf_dir, "ref_locations"))), ("title", linking.role_gazetteer(table(spark, sf_dir, "ref_roles")))):
        mapped = linking.map_values(postings, "row_id", name, gazetteer).where(F.col("ref_id") == linking.UNMATCHED)
        found.append(mapped.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("field"), "value", "n_rows"))
    return found[0].unionByName(found[1])


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "postings").select(F.col("company").alias("name")).unionByName(table(spark, sf_dir, "companies").select("name"))
    return names.link_names(written, "name")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one organisation."""
    return names.name_pairs(_names(spark, sf_dir))


def p7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical spelling of each spelling."""
    return _names(spark, sf_dir).select("name", "n", "root")


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each arrival repeats a job or an earlier arrival: jobs fill the index first, then the arrivals come in their order."""
    aliases = linking.short_forms(table(spark, sf_dir, "ref_roles"))
    jobs = table(spark, sf_dir, "jobs").select("company", "location", "title", "id", F.lit(-1).cast("bigint").alias("at"))
    arrivals = table(spark, sf_dir, "job_arrivals").select("company", "location", "title", "id", "arrival_id", "batch_no")
    # Arrivals count in the order of batch and then id; 2 ** 40 ids fit into one batch.
    at = F.coalesce("batch_no", F.lit(0)).cast("bigint") * (1 << 40) + F.col("arrival_id")
    arrivals = arrivals.select("company", "location", "title", "id", F.col("arrival_id").alias("key"), at.alias("at"))
    index = history.SegmentIndex(spark)
    old = materialise(history.standardise(jobs, aliases, "id", "at"), "history-jobs")
    new = materialise(history.standardise(arrivals, aliases, "key", "id", "at"), "history-arrivals")
    index.append(old)
    return history.check_batch(new, index)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that repeat a job or an earlier arrival."""
    return _arrivals(spark, sf_dir).where("repeats").select(F.col("key").alias("arrival_id"))


def p4_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that are new jobs."""
    return _arrivals(spark, sf_dir).where(~F.col("repeats")).select(F.col("key").alias("arrival_id"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.score_ends(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id", "text", "lang", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return _scored(spark, sf_dir).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts, over its texts that aren't blank."""
    by = _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return by.withColumn("cut_rate", F.col("n_cut") / F.col("n_texts"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of postings.description outside the main body."""
    rows = table(spark, sf_dir, "postings").select("row_id", "title", "description")
    return boilerplate.page_noise(rows, "row_id", "title", "description")


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_markup(table(spark, sf_dir, "postings").select("row_id", "description"), "row_id", "description")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose description holds markup."""
    return _markup(spark, sf_dir).where(F.col("n_pieces") > 0).select("row_id")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of each description."""
    return _markup(spark, sf_dir).select("row_id", "n_pieces", "clean")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_clean": p1_clean, "p3_found": p3_found, "p10_found": p10_found, "p10_rates": p10_rates, "p4_found": p4_found, "p4_new": p4_new, "p7_found": p7_found, "p7_canonical": p7_canonical, "p6_found": p6_found, "p6_unmatched": p6_unmatched, "p5_found": p5_found, "p5_groups": p5_groups, "p8_ids": p8_ids, "p8_joins": p8_joins, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shares_beyond": p9_shares_beyond, "p9_mix_held": p9_mix_held, "p9_shares_held": p9_shares_held, "p9_shares_entropy": p9_shares_entropy}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": """
            WITH w AS (SELECT row_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || description), '[a-z0-9]+') w FROM postings WHERE len(regexp_extract_all(lower(description), '[a-z0-9]+')) >= 30),
            s AS (SELECT DISTINCT row_id, g FROM (SELECT row_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g FROM w)),
            n AS (SELECT row_id, count(*) n FROM s GROUP BY row_id),
            p AS (SELECT a.row_id x, b.row_id y, count(*) c FROM s a JOIN s b USING (g) WHERE a.row_id < b.row_id GROUP BY ALL)
            SELECT x row_id_a, y row_id_b FROM p JOIN n a ON a.row_id = x JOIN n b ON b.row_id = y WHERE c >= 0.7 * (a.n + b.n - c) - 1e-9""",
    }
