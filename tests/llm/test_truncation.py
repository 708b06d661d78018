import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hireloom.llm import truncation as tr


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab1 .\n", max_size=50), max_size=5))
def test_counts_are_those_of_every_place(texts):
    """Against a count sign by sign."""
    want: dict[int, list[int]] = {}
    for t in texts:
        signs = tr._signs(t)
        if not len(signs):
            continue
        s = "".join(chr(c) for c in signs)
        for i, c in enumerate(s):
            if c in " \n":
                continue
            after = s[i + 1 : i + 2]
            end = after in ("", "\n") or (c in ".!?:;" and after == " ") or s[i + 1 : i + 3] == " \n"
            for key in tr.end_keys([s[: i + 1]]).to_pylist()[0]:
                if key is not None:
                    e = want.setdefault(key, [0, 0])
                    e[0] += end
                    e[1] += 1
    keys, ends, places = tr.count_contexts(texts, lambda k: np.ones(len(k), bool))
    got: dict[int, list[int]] = {}
    for k, e, p in zip(keys.tolist(), ends.tolist(), places.tolist()):
        held = got.setdefault(k, [0, 0])
        held[0] += e
        held[1] += p
    assert got == want


ITEMS = ["Keep the reports of the team below nine open defects", "Help the crews of the harbour to plan their weeks", "You will share an office with the people of the press", "We answer every letter within nine days"]


def text(i, n=6):
    return "\n".join(f"{ITEMS[(i + k) % 4]}." for k in range(n))


def test_cut_texts(spark):
    rows = [(i, text(i), "en", "s") for i in range(120)] + [(1000 + i, text(i)[: -(7 + i % 20)], "en", "s") for i in range(10)] + [(2000, text(3)[:-9] + "…", "en", None), (2001, None, "en", "s"), (2002, "", None, "s"), (2003, " \n", None, "s"), (2004, text(1), None, None)]
    rows += [(2000, text(3)[:-9] + "…", "en", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, source string, cut string")
    got = {}
    for r in tr.score_ends(df, "doc_id", "text", "lang", "source", bitmap_bits=16).collect():
        got.setdefault(r["doc_id"], []).append(r["cut"])
    assert not any(got[i][0] for i in range(120))
    assert all(got[1000 + i] == [True] for i in range(10))
    assert got[2000] == [True, True] and got[2004] == [False] and not {2001, 2002, 2003} & set(got)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert tr.score_ends(df, "doc_id", "text", "lang", "source", bitmap_bits=16).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000, None, None)], "doc_id bigint, text string, lang string, source string")
    assert tr.score_ends(long, "doc_id", "text", "lang", "source", bitmap_bits=16).collect()[0]["n_chars"] == 1_500_000


def test_a_longer_context_is_wanted_only_with_its_shorter_ones():
    """Filtering by the shorter orders first loses no place of any wanted context."""
    import random

    r = random.Random(5)
    texts = ["".join(r.choice("ab .\n") for _ in range(r.randint(1, 90))) for _ in range(60)]
    wanted = {k for t in texts[:20] if t.strip() for k in tr.end_keys([t]).to_pylist()[0] if k is not None}
    some = np.array(sorted(wanted))
    every, few = tr.count_contexts(texts, lambda k: np.ones(len(k), bool)), tr.count_contexts(texts, lambda k: np.isin(k, some))
    add = lambda found: {k: (sum(e for x, e, _ in zip(*(a.tolist() for a in found)) if x == k), sum(p for x, _, p in zip(*(a.tolist() for a in found)) if x == k)) for k in wanted}
    assert add(every) == add(few) and set(few[0].tolist()) <= wanted


def test_small_languages_have_thresholds_of_their_own(spark):
    rows = [(i, text(i), "en", "s") for i in range(40)] + [(100 + i, text(i)[: -(7 + i % 20)], "en", "s") for i in range(5)] + [(200, text(1), "xx", "s")]
    got = tr.score_ends(spark.createDataFrame(rows, "doc_id bigint, body string, lang string, source string"), "doc_id", "body", "lang", "source").collect()
    assert {r["column"] for r in got} == {"body"} and all(tr.LOWEST <= r["threshold"] <= tr.HIGHEST for r in got)
    assert len({(r["lang"], r["threshold"]) for r in got}) == 2 and not next(r["cut"] for r in got if r["doc_id"] == 200)


def test_portions_add_up():
    texts = [text(i) for i in range(9)]
    every = lambda k: np.ones(len(k), bool)
    whole, parts = tr.added([tr.count_contexts(texts, every)]), tr.added([tr.count_contexts(texts[i : i + 2], every) for i in range(0, 9, 2)])
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == len(set(whole[0].tolist()))
