import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hireloom.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.rank_file()), reason="no tokenizer files here")
TEXT = st.text(st.one_of(st.sampled_from(" \n\t'ab1.é東"), st.characters(exclude_categories=["Cs"])), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 20), st.integers(1, 5))
def test_tree_equals_the_whole(text, leaf, window):
    enc = tokens.encoder(tokens.rank_file())
    ids = enc.encode(text, leaf, window)
    assert ids == enc.encoding.encode_ordinary(text)
    assert enc.decode(ids) == text


def test_same_as_the_json_tokenizer():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    enc = tokens.encoder(tokens.rank_file())
    for text in ("", " ", "<|endoftext|> a", "Größe  東京\r\n\x1c\x1d ''s", "a" * 20_000, "word " * 20_000, " " * 9000 + "x"):
        assert enc.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Hello there", 9), (3, "Hello there", 9), (4, "<|endoftext|>", 9), (5, "x y " * 300_000, 9)], "doc_id bigint, text string, ids int")
    got = {}
    for r in tokens.encode_corpus(df, "doc_id", "text").collect():
        got.setdefault(r["doc_id"], []).append(r["ids"])
    enc = tokens.encoder(tokens.rank_file())
    assert got[1] == [[]] and got[2] == [[]] and got[3] == [enc.encoding.encode_ordinary("Hello there")] * 2 and 50256 not in got[4][0] and len(got[5][0]) == len(enc.encoding.encode_ordinary("x y " * 300_000))
    assert {(r["doc_id"], r["ids"], r["n_tokens"]) for r in tokens.count_tokens(df, "text").collect()} >= {(1, 9, 0), (2, 9, 0), (3, 9, 2)}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n bigint")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def mixed(spark, rows, wanted, **kw):
    mixture, shares = mixing.mix(sizes(spark, rows), targets(spark, wanted), "doc_id", "source", "n", **kw)
    return mixture.collect(), {r["source"]: r for r in shares.collect()}


def test_targets_are_met(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(2000)] + [(5000 + i, "b", 20) for i in range(100)] + [(9000, None, 5), (9001, "other", 5), (9002, "a", None), (9003, "a", 0)]
    got, shares = mixed(spark, rows, [("a", 0.7, 1), ("b", 0.3, 4)])
    assert all(r["target_met"] for r in shares.values()) and shares["b"]["most_repeats"] == 4
    times = {}
    for r in got:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) == 4 and not {9000, 9001} & set(times) and all(n == 1 for d, n in times.items() if d < 5000)
    assert {(r["doc_id"], r["repeat_no"]) for r in got} == {(r["doc_id"], r["repeat_no"]) for r in mixed(spark, rows, [("a", 0.7, 1), ("b", 0.3, 4)])[0]}  # the seed decides


def test_targets_that_cannot_be_met(spark):
    rows = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(10)]
    _, shares = mixed(spark, rows, [("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 3)], budget=1000)
    assert not shares["b"]["target_met"] and shares["b"]["used_tokens"] <= 200 and shares["none"]["actual_share"] == 0.0
    assert 0 < shares["a"]["exponent"] <= 1
    _, everything = mixed(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)], budget=1 << 60)
    assert everything["a"]["used_tokens"] == 1000 and everything["b"]["used_tokens"] == 200


def test_nothing_to_mix(spark):
    got, shares = mixed(spark, [], [("a", 1.0, 1)])
    assert got == [] and shares["a"]["actual_share"] == 0.0 and not shares["a"]["target_met"]
    assert mixed(spark, [(1, "a", 5)], []) == ([], {})
    got, _ = mixed(spark, [(1, "a", 5), (1, "a", 5)], [("a", 0.5, 2), ("a", 1.0, 1)])
    assert len(got) == 4  # repeated rows are documents of their own


def test_weights():
    w, size, e = mixing.weights({"a": 100, "b": 100}, {"a": 0.9, "b": 0.1}, {"a": 2, "b": 1}, None)
    assert size == 222 and e == 0.0 and abs(w["a"] - 0.9) < 1e-9
    w, size, e = mixing.weights({"a": 100, "b": 300}, {"a": 0.9, "b": 0.1}, {"a": 2, "b": 1}, 400)
    assert 0 < e < 1 and abs(w["a"] * 400 - 200) < 1e-6 and abs(sum(w.values()) - 1) < 1e-9


def test_a_registered_mixture_bisects_the_exponent(spark, data):
    from hireloom.llm import queries

    rows = queries.queries()["p9_shares_held"](spark, data).collect()
    held, used = sum(r["held_tokens"] for r in rows), sum(r["used_tokens"] for r in rows)
    assert all(0 < r["exponent"] < 1 and r["most_repeats"] <= r["max_repeats"] and r["used_tokens"] <= r["held_tokens"] * r["max_repeats"] for r in rows)
    assert any(r["used_tokens"] >= 0.95 * r["held_tokens"] * r["max_repeats"] for r in rows) and 0.97 * held <= used <= held
    assert not all(r["target_met"] for r in rows)


def test_documents_go_through_the_tree(spark):
    text = "The quick brown fox, it is said, jumps. " * 60
    rows = [(1, text), (2, None), (3, ""), (4, "short"), (5, text[: tokens.LEAF]), (6, text[: tokens.LEAF + 1])]
    got = {r["doc_id"]: r for r in tokens.tree_shape(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert {k: r["n_joins"] for k, r in got.items()} == {1: 7, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}
    ids = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    whole = tokens.encoder(tokens.rank_file()).encoding.encode_ordinary
    assert all(ids[k] == whole(t or "") and got[k]["n_tokens"] == len(ids[k]) for k, t in rows)


def test_entropy_is_met():
    held, targets, repeats = {"a": 8000, "b": 1500, "c": 500}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 9, "c": 9}
    w, size, e = mixing.weights(held, targets, repeats, mixing.HELD, mixing.TARGETS)
    assert 0 < e < 1 and size == 10_000 and abs(mixing.entropy_of([*w.values()]) - mixing.entropy_of([0.5, 0.3, 0.2])) < 1e-6
    assert abs(w["a"] / w["b"] - (8000 / 1500) ** e) < 1e-6
    assert mixing.weights(held, targets, repeats, None, 0.0)[2] == 1.0 and mixing.weights(held, targets, repeats, None, 9.0)[2] < 1e-12
    low = mixing.weights(held, targets, {"a": 1, "b": 1, "c": 1}, mixing.HELD, mixing.TARGETS)[0]
    assert all(abs(low[s] * 10_000 - held[s]) < 1e-6 for s in held)
    assert 0 < mixing.weights(held, targets, {"a": 1, "b": 1, "c": 2}, mixing.HELD)[2] <= 1
