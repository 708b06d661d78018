import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hireloom.llm import neardup, shingles


def word_runs(text, k):
    w = re.findall("[a-z0-9]+", text.lower())
    return frozenset(zip(*[w[i:] for i in range(k)]))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6), st.integers(1, 4))
def test_runs_are_those_of_the_words(texts, k):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    array = pa.array(texts, pa.large_string())
    tokens, edges, counts = shingles.runs(array, k)
    assert list(np.diff(edges)) == [len(word_runs(t, k)) for t in texts]
    assert list(counts) == [len(re.findall("[a-z0-9]+", t.lower())) for t in texts]
    sets = [word_runs(t, k) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            common = np.intersect1d(tokens[edges[i] : edges[i + 1]], tokens[edges[j] : edges[j + 1]])
            assert len(common) == len(sets[i] & sets[j])


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=2, max_size=40), st.sets(st.integers(0, 60), min_size=2, max_size=40), st.sampled_from([0.55, 0.7, 0.8, 1.0]))
def test_bounds_hold(x, y, t):
    if jaccard(x, y) < t:
        return
    bounds = neardup.Bounds(t)
    a, b = sorted(x), sorted(y)
    common = len({*zip(a, a[1:])} & {*zip(b, b[1:])})
    assert common >= bounds.pair_share * (len(a) + len(b)) - 1 - 1e-9
    assert len(x & y) >= bounds.overlap(np.array([len(x) + len(y)]))[0]
    if min(len(a), len(b)) > bounds.single:
        assert common >= max(bounds.common_pairs(np.array([len(a)]))[0], bounds.common_pairs(np.array([len(b)]))[0], 1)
    else:
        assert max(len(a), len(b)) <= bounds.single or min(len(a), len(b)) >= bounds.least


def made(n, seed, words=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 1)] = [f"w{r.randrange(words)}"]
        else:
            w = [f"w{int(r.paretovariate(0.6)) % words}" for _ in range(r.choice([3, 8, 30, 60, 150]))]
        out.append(" ".join(w))
    return out


def check(spark, texts, k, t, least=0):
    df = spark.createDataFrame([(i, None if i % 7 else "T", x, i) for i, x in enumerate(texts)], "key bigint, title string, tokens string, rep int")
    members, links = neardup.near_duplicates(df, "key", "title", "tokens", k=k, threshold=t, least_words=least, block_entries=2000)
    got = {tuple(r) for r in neardup.all_pairs(members, links).collect()}
    sets = {i: word_runs(("" if i % 7 else "T") + " " + x, k) for i, x in enumerate(texts) if x is not None and len(re.findall("[a-z0-9]+", x.lower())) >= least}
    sets = {i: s for i, s in sets.items() if s}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= t}
    assert got == want, (len(got - want), len(want - got))
    return members, links, want


def test_against_brute_force(spark):
    assert check(spark, [*made(150, 1), None, "", " ", "short", "Kelvin İstanbul one two three four", "Kelvin i̇stanbul one two three four"], 3, 0.7)[2]


def test_training_default_of_five_words(spark):
    check(spark, made(120, 2), 5, 0.8)


def test_groups_and_copies(spark):
    texts = made(60, 3) + ["same text of some words that is here again and again"] * 40
    members, links, want = check(spark, texts, 3, 0.7)
    groups = {r["key"]: r["class_id"] for r in neardup.components(members, links).collect()}
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in want:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    assert all((groups[i] == groups[j]) == (root(i) == root(j)) for i in groups for j in groups)


def test_groups_of_long_chains_are_whole(spark):
    # The chain's labels fall towards 1 at its far end, 120 links from 0; beside it a chain of mixed order and two lone records.
    n = 120
    chain = [0, *range(n, 0, -1)]
    mixed = random.Random(9).sample(range(1000, 1000 + n), n)
    links = [(min(p), max(p)) for c in (chain, mixed) for p in zip(c, c[1:])]
    members = spark.createDataFrame([(i, i) for i in [*chain, *mixed, 5000, 5001]], "key bigint, rep bigint")
    got = {r["key"]: (r["class_id"], r["n_links"]) for r in neardup.components(members, spark.createDataFrame(links, "rep_a bigint, rep_b bigint")).collect()}
    assert {got[i][0] for i in chain} == {0} and {got[i][0] for i in mixed} == {1000} and got[5000] == (5000, 0) and got[5001] == (5001, 0)
    assert got[0][1] == got[1][1] == 1 and got[2][1] == 2


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "key bigint, title string, body string")
    members, links = neardup.near_duplicates(df, "key", "title", "body")
    assert members.count() == links.count() == 0 and neardup.components(members, links).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    members, links = neardup.near_duplicates(spark.createDataFrame([(1, None, long), (2, "x", long + " y")], "key bigint, title string, body string"), "key", "title", "body")
    assert [(r["rep_a"], r["rep_b"]) for r in links.collect()] == [(1, 2)]


def test_the_postings(spark, data):
    import duckdb

    from hireloom.llm import queries

    duckdb.sql(f"CREATE OR REPLACE VIEW postings AS SELECT * FROM '{data}/postings.parquet'")
    assert {tuple(r) for r in queries.p5_found(spark, data).collect()} == set(duckdb.sql(queries.oracle_sql()["p5_found"]).fetchall())


def test_hot_entries_and_large_classes_are_split_without_loss(spark, monkeypatch):
    from hireloom import common

    base = made(1, 5)[0] + " " + " ".join(f"u{i}" for i in range(80))
    texts = [*made(40, 4), *[base + f" z{i}" for i in range(60)], *[base] * 50]
    df = spark.createDataFrame([(i, None, x) for i, x in enumerate(texts)], "key bigint, title string, body string")
    sets = {i: word_runs(" " + x, 3) for i, x in enumerate(texts)}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.7}
    monkeypatch.setattr(common.slots, "__defaults__", (7,))
    for hot in (4, 16_384):
        members, links = neardup.near_duplicates(df, "key", "title", "body", k=3, threshold=0.7, block_entries=500, hot_entry=hot)
        got = [tuple(r) for r in neardup.all_pairs(members, links).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_ties_of_the_order_are_global():
    whole = np.array([5, 3, 9, 1, 7], np.uint64)
    assert list(whole[neardup._in_order(np.array([1, 1, 0, 1, 1], np.uint64), whole)]) == [9, 1, 3, 5, 7]
    entry = np.array([8, 12], np.uint64)
    sets = np.arange(2, dtype=np.int64)
    cells, of = neardup._cells(entry, np.array([0, 1]), np.array([0, 80]), sets, 100)  # about 2 ** 10 records: eleven lots
    assert cells[0] == 8 and list(of) == [0] + [1] * 11 and len(set(cells.tolist())) == 12


def test_many_blocks_are_compared_in_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = made(300, 8)
    df = spark.createDataFrame([(i, "", x) for i, x in enumerate(texts)], "key bigint, title string, body string")
    sent, plain = [], type(df).repartitionById

    def measured(self, n, by):
        row = self.agg(*[F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(c) for c in ("entry", "doc", "sets", "sizes", "parity")]).first()
        sent.append((sum(row), row["entry"] + row["doc"]))
        return plain(self, n, by)

    monkeypatch.setattr(type(df), "repartitionById", measured)
    found = []
    for block_entries in (1 << 40, 50):
        sent.clear()
        members, links = neardup.near_duplicates(df, "key", "title", "body", k=3, threshold=0.7, block_entries=block_entries)
        found.append({tuple(r) for r in neardup.all_pairs(members, links).collect()})
    assert found[0] == found[1] and found[0]
    # However many blocks a record has entries in, what is sent at once stays near the size of the index.
    assert max(s for s, _ in sent) < 2 * sum(e for _, e in sent), sent
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
