import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hireloom.llm import markup

PLAIN = [
    "Grade 38/60 [see note 10] applies.", "Ask for desk #3 (next to_do board) in week 3.", r"Shared folders such as \\nas34\plans keep storefronts.", r"Guides live under S:\teams\2\plans on the drive.",
    "We value T-shaped people {breadth first} who design.", "Rated 4.6 * by advisers, with ~29 reviews.", "Shortcuts like Ctrl+[ and Ctrl+] or a | b are shown.", "If load <b and cost> c, the crew decides.",
    "A rule like a[i] == b[j] && x < y should not scare you.", "Response times stay < 23 ms for reads and > 99.1 % of calls.", "Our stack includes C#, F# and Go.", "Legend: * optional, ** paid extra, *** for visitors.",
    "Columns use snake_case such as user_id.", "Generics such as Map<String, Integer> in Go.", "R&D and Q&A; travel", "The budget is 30 % up ^ on last year.", "$85k to $116k, paid; $ 47,000 - $ 555,000.", "Home > Careers > Sr. Dev", "A · B | C",
    "• one\n• two", "– one\n– two", "AT&T & Sons", "", "   ", "#hiring #Launch", "5 * 8 with 60",
]
MARKED = [
    "a <b>word</b>", "line<br>", "cut <p Your background", "</li> alone", "<!-- meet -->", "what&nbsp;", "&#8217;s", "&#x2014;", "&amp;amp; more", "&lt;p&gt;x", "# Heading", "text ===", "== Tasks ==", "===\nx", "Title\n-----",
    "**bold**", "a **·** b", "_You_ will", "__a__ role", "~~old~~", "`code`", "[x](https://a.example)", "![x](https://a.example/1.png)", "[[a|b]]", "[https://a.example x]", "{{note|x}}", "''offer:''", "{| class=\"wikitable\"",
    "| a | b |", r"\textbf{a} role", r"\item one", r"close\\ to", r"head \% of", r"now~\cite{k27} helps", r"$\sqrt{m^2}$", r"\(x^2\)", "$O(n \\log n)$", "- one\n- two", "1. one\n1. two", "* one\n* two", "<https://a.example>", "```\nx\n```", "> quoted",
]


@pytest.mark.parametrize("text", PLAIN)
def test_prose_is_no_markup(text):
    assert markup.marked_lines(text) == 0, markup.pieces(text)


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert markup.marked_lines(text) > 0


def test_ambiguous_lines_follow_their_neighbours():
    assert markup.marked_lines("Some prose here.\n- lone line\nMore prose.") == 0
    assert markup.marked_lines("# Heading\n- lone line\nMore prose.") == 2
    assert markup.marked_lines("Prose.\n- a\n- b\nProse.") == 2


def test_structure_stays():
    page = "<h2>Tasks</h2><ul><li>Build <b>it</b><li>Run &amp; fix it</ul><pre>a < b\n  c</pre><p>Cost \\(x_1^2\\) is fine for all of us in the team.</p><script>no()</script>"
    blocks = markup.blocks(page)
    assert [(b.kind, b.text) for b in blocks] == [("heading", "Tasks"), ("item", "Build it"), ("item", "Run & fix it"), ("code", "a < b\n  c"), ("text", "Cost x_1^2 is fine for all of us in the team.")]
    markup.label_blocks(blocks)
    assert markup.render(blocks) == "Tasks\n• Build it\n• Run & fix it\n    a < b\n      c\nCost x_1^2 is fine for all of us in the team."
    wiki = "==Tasks==\n# One\n* [[a|Two]]\n{|\n! Step !! Weeks\n|-\n| Call || 4\n|}\n```\nx = 1\n```"
    assert [(b.kind, b.text) for b in markup.blocks(wiki)] == [("heading", "Tasks"), ("heading", "One"), ("item", "Two"), ("row", "Step | Weeks"), ("row", "Call | 4"), ("code", "x = 1")]


def test_links_and_stop_words_decide():
    menu = "<div>" + "".join(f'<p><a href="/{i}">A longer entry of the menu number {i}</a></p>' for i in range(3)) + "<p>Next</p></div><p>" + "This is what we do in the team and how you are to work with all of us. " * 4 + "</p>"
    blocks = markup.blocks(menu)
    markup.label_blocks(blocks)
    assert [b.label for b in blocks][:3] == ["bad"] * 3 and blocks[-1].label == "good"
    assert "menu" not in markup.render(blocks)


def test_rows(spark):
    long = "prose " * 200_000 + "<b>x</b>"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "a <b>c</b>"), (4, "a <b>c</b>"), (5, long), (6, "plain\ntext")], "key bigint, text string").withColumnRenamed("text", "clean")
    got = markup.clean_markup(df, "key", "clean").orderBy("key").collect()
    assert [(r["key"], r["n_pieces"]) for r in got] == [(1, 0), (2, 0), (3, 0), (4, 2), (4, 2), (5, 2), (6, 0)]
    assert [r["clean"] for r in got][:5] == [None, "", "", "a c", "a c"] and got[-1]["clean"] == "plain\ntext" and got[5]["clean"].endswith("prose x")
    assert markup.clean_markup(df.limit(0), "key", "clean").count() == 0


def test_clean_text_has_no_markup_left(spark, data):
    from hireloom.common import table

    df = markup.clean_markup(table(spark, data, "postings"), "row_id", "description")
    left = [r["clean"] for r in df.where("n_pieces > 0").collect() if markup.marked_lines("\n".join(x for x in r["clean"].split("\n") if not x.startswith("    ")))]
    assert len(left) <= 0.01 * df.count(), left[:2]


def test_long_emphasis_and_formulas_and_linked_items():
    words = "some words of a longer text " * 12
    for t in (f"so *{words.strip()}* it is", f"so $x^2 + {words.strip()}$ it is", f"so $1{'+x' * 150}^2$ it is", rf"so \({words}\) it is", rf"so \[{words}\] it is"):
        assert len(t) > 300 and markup.marked_lines(t) > 0, t
    for t in ("a * b and c * d, 5*3 and $100 or $200", "so *" + words, r"so \( " * 5000):
        assert markup.marked_lines(t) == 0, t[:40]
    found = markup.blocks('<p><a href="/a">Home</a></p><h2><a href="/b">Our offices</a></h2><ul><li><a href="/c">Berlin</a></li><li><a href="/d">Paris</a></li></ul><p><a href="/e">Next</a></p>')
    markup.label_blocks(found)
    assert markup.render(found).split("\n") == ["Our offices", "• Berlin", "• Paris"]


def clean(text):
    found = markup.blocks(text)
    markup.label_blocks(found)
    return markup.render(found)


def test_lines_inherit_past_short_ones():
    lines = markup.label_lines("We do this for all of the people in our team.\nDuties\n- lone line\nAnd that is what we are here for.")
    assert [x.label for x in lines] == ["prose"] * 4
    lines = markup.label_lines("# Heading\nDuties\n- lone line\n\nAnd that is what we are here for.")
    assert [x.label for x in lines if x.text] == ["markup", "markup", "markup", "prose"] and sum(x.found for x in lines) == 2
    long = "We do this for all of the people in our team and for those who will be in it with us when it is what they and you want of it, as we have it from all of them and from you."
    assert markup.marked_lines(f"Prose of the day for us.\n- {long}\nMore of the same for us all.") == 0
    assert markup.stops_of("wir sind die und der mit ein zu auf") is not None and markup.stops_of("xq zz yy") is None


def test_nothing_visible_is_lost():
    assert clean('Text one here.<ref name="a"/> More text of it.') == "Text one here. More text of it."
    assert clean("Before it.<script>var x<p>and after it") == "Before it.var x\nand after it"
    assert clean("Before.<style>p {}</style><p>After") == "Before.\nAfter"
    assert clean("One <!-- cut and the rest") == "One cut and the rest" and clean("One <!-- gone --> two") == "One two"
    assert clean('<ul><li><a href="/a">Berlin office</a></li><li><a href="/b">Paris office</a></li></ul>') == "• Berlin office\n• Paris office"
    lines = "<br>".join(f"Plain line number {i}" for i in range(5))
    assert clean(f'<p>{lines}<br><a href="/x">{"A long link that says what there is to see " * 3}</a></p>').split("\n") == [f"Plain line number {i}" for i in range(5)]
    assert clean('<p>See <a href="/x">our guide</a> first</p>') == "See our guide first" and clean('<p><a href="/x">Alone</a></p>') == "Alone"
    assert clean('<a href="/x">never closed <p>Text of the page') == "never closed\nText of the page"
    assert clean("<nav>Short<p>Text of the page") == "Short\nText of the page"
    assert clean(r"\noindent This stays \begin{itemize} and this \LaTeX\ too\footnote{a note}") == "This stays and this LaTeX\\ too (a note)"
    assert clean("{| class=\"wikitable\"\n|+ Caption\n| a || b\n|}") == "Caption\na | b"


WORDS = st.lists(st.sampled_from("alpha bravo charlie delta echo foxtrot golf hotel india".split()), min_size=1, max_size=9).map(" ".join)
WRAPS = ["{}", "<p>{}</p>", "<p>{}", "<li>{}</li>", "<h2>{}</h2>", "{}<br>", "<div>{}</div>", "<b>{}</b> ", "**{}**", "# {}", "== {} ==", "- {}", "1. {}", "''{}''", "\\textbf{{}}", "\\item {}", "| {} |", "`{}`", "> {}", "<ref name=\"a\"/>{}", "a <a>{} end</a> tail of the line, as it is", "<pre>{}</pre>", "<td>{}</td>", "so [{}](https://a.example)", "[[x|{}]]", "\\section{{}}", "&lt;p&gt;{}", "<script> {}", "{}\n\n", "<!-- {}", "\\noindent {}", "{{note|{}}}"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WRAPS), WORDS), min_size=1, max_size=12))
def test_every_visible_word_stays(parts):
    """But for blocks that are chrome by their own links, of which there are none here."""
    text = "\n".join(wrap.replace("{}", words) for wrap, words in parts)
    want = Counter(w for _, words in parts for w in words.split())
    got = Counter(re.findall("[a-z]+", clean(text)))
    assert all(got[w] >= n for w, n in want.items()), (text, clean(text))


def test_no_posting_comes_out_empty(spark, data):
    from hireloom.common import table

    df = markup.clean_markup(table(spark, data, "postings"), "row_id", "description").where("n_pieces > 0")
    assert df.where("trim(clean) = ''").count() == 0
