import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from hireloom.llm import boilerplate as b

NAV = ["Home", "Careers", "About us", "Log in", "Cookie settings", "Privacy notice", "Follow us", "Accept all"]
BODY = ["We look for a calm colleague who can build reports with us.", "You will plan the work of the team and keep it small.", "At least three years in a role close to ours", "A transit pass and paid leave for everyone in the team"]


def page(i, tags=True):
    nav = [NAV[(i + k) % len(NAV)] for k in range(3)]
    body = [BODY[(i + k) % len(BODY)] for k in range(4)]
    if tags:
        return "<nav>\n" + "\n".join(f"<a>{x}</a>" for x in nav) + "\n</nav>\n<main>\n" + "\n".join(f"<p>{x}</p>" for x in body) + "\n</main>\n<footer>\n<li>Privacy notice</li>\n</footer>"
    return "\n".join([*nav, *body[:2], "Accept all", *body[2:], "Privacy notice"])


def test_lines_that_show_text():
    text = "<div>\nOne\n<script>\nvar x;\n</script>\n<!-- a\nb -->Two\n<nav>Menu</nav>\n---\n</div>"
    assert [(n, s, label) for n, s, label, _ in b.visible_lines(text)] == [(2, "One", 0), (7, "Two", 0), (8, "Menu", -1)]
    assert [n for n, *_ in b.visible_lines("&lt;p&gt;a&lt;/p&gt;\n\n&amp;nbsp;\nb")] == [1, 4]  # escaped twice: a blank


@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_run_is_the_highest_sum(scores):
    start, end, total = b.best_run(scores)
    every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert total == max([0, *every]) and sum(scores[start:end]) == total


def test_learned_on_named_pages_and_used_on_plain_ones(spark):
    rows = [(i, None, page(i)) for i in range(40)] + [(100 + i, "x", page(i, False)) for i in range(8)] + [(200, None, None), (201, "", ""), (202, "t", " \n "), (203, "t", "\n".join(BODY))]
    df = spark.createDataFrame([(*r, "own") for r in rows], "row_id bigint, title string, text string, line_no string")
    got = {}
    for r in b.page_noise(df, "row_id", "title", "text").collect():
        got.setdefault(r["row_id"], set()).add(r["line_no"])
    for i in range(40):
        assert got[i] == {2, 3, 4, 13}
    for i in range(8):
        assert got[100 + i] == {1, 2, 3, 6, 9}
    assert not {200, 201, 202, 203} & set(got)
    assert b.page_noise(df.limit(0), "row_id", "title", "text").count() == 0
    assert b.page_noise(df.where("row_id > 150"), "row_id", "title", "text").count() == 0  # nothing is labelled


def test_held_out_lines(spark, data):
    import os

    from hireloom.common import table

    bigger = data.replace("sf0.001", "sf0.01")
    rows = table(spark, bigger if os.path.isdir(bigger) else data, "postings").where("description like '%<main>%' or description like '%<article>%'").select("title", "description").collect()
    pages = [(r["title"], r["description"]) for r in rows]
    half = len(pages) // 2
    weights = b.learn(pages[:half])
    right = wrong = 0
    for (t, x), found in zip(pages[half:], b.outside([t for t, _ in pages[half:]], [x for _, x in pages[half:]], weights)):
        for n, _, label, _ in b.visible_lines(x):
            right += label != 0 and (n in found) == (label < 0)
            wrong += label != 0 and (n in found) != (label < 0)
    assert right + wrong == 0 or right / (right + wrong) > 0.95


def test_nothing_learned_means_nothing_found():
    assert b.outside(["t"], ["a\nb"], np.zeros(1 << b.FEATURE_BITS, dtype=np.float32)) == [[]]


def test_crumbs_behind_a_long_menu():
    menu = "".join(f"<li>Menu {i}</li>\n" for i in range(40))
    assert b.crumbs_of(b.visible_lines(f"<ul>{menu}</ul>\n<div>Home / Jobs / Site Manager</div>\n<h1>Site Manager</h1>")) == {"site manager"}
