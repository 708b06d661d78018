from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hireloom.llm import history as h

ALIASES = {"swe": "software engineer", "csm": "customer success manager"}


def test_canonical_titles():
    same = ["Senior Software Engineer, Grid Anchor", "SENIOR SWE - grid anchor", "Grid Anchor: Sr. Software Engr", "Software Eng., Senior – Grid Anchor (m/f/d)", "Sr SWE / Grid Anchor NEW! [Remote]", "Snr Software Engineer (Grid Anchor) - 2 openings #1234"]
    assert {h.canonical(t, ALIASES) for t in same} == {("senior", "software engineer grid anchor")}
    assert h.canonical("Engineer 2, X", {}) == ("ii", "engineer x") and h.canonical("", {}) is None and h.canonical(None, {}) is None and h.canonical("—", {}) is None
    assert h.canonical("Tech Writer", {}) == ("", "technical writer")


def edits(text, ops):
    for kind, at, c in ops:
        at = at % max(1, len(text))
        if kind == 0:
            text = text[:at] + c + text[at:]
        elif kind == 1:
            text = text[:at] + text[at + 1 :]
        elif kind == 2:
            text = text[:at] + c + text[at + 1 :]
        else:
            text = text[:at] + text[at : at + 2][::-1] + text[at + 2 :]
    return text


@settings(max_examples=500, deadline=None)
@given(st.text("abcde ", min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.sampled_from("abcxyz")), max_size=2))
def test_two_edits_always_meet_in_the_index(text, ops):
    assert set(h.index_keys(text)) & set(h.probe_keys(edits(text, ops)))


def test_known_words_differ():
    known = frozenset(["sensor", "senior", "engineer"])
    assert not h.same_title("sensor engineer", "senior engineer", known)
    assert h.same_title("sensr engineer", "sensor engineer", known) and h.same_title("sensor enginere", "sensor engineer", known)


def rows(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], "company string, location string, title string, id string, key bigint, at bigint, text string")


JOBS = [("C", "L", "Senior Engineer, Grid", "1", 0, -1), ("C", "L", "Analyst II, Tax", "2", 0, -1), ("C", None, "Cook", "3", 0, -1), (None, "L", "Cook", None, 0, -1), ("C", "L", None, "4", 0, -1)]
BATCH = [
    ("C", "L", "Sr Engineer - Gird", "n1", 1, 1, True), ("C", "L", "Engineer, Grid", "n2", 2, 2, False), ("C", "M", "Senior Engineer, Grid", "n3", 3, 3, False), ("C", "L", "Analyst III, Tax", "n4", 4, 4, False), ("C", "L", "Anaylst 2 (Tax)", "n5", 5, 5, True),
    ("X", "Y", "Z", "1", 6, 6, True), ("C", "L", "Baker, Fleet", "n7", 7, 7, False), ("C", "L", "baker – fleet", "n8", 8, 8, True), ("C", "L", "Baker", "n9", 9, 9, False), ("C", None, "Cook", "n10", 10, 10, False), (None, None, None, None, 11, 11, False), ("C", "L", "", "n12", 12, 12, False), ("Q", "Q", "Q", "n3", 13, 13, True),
]


def test_batches_one_by_one_or_together(spark):
    want = {r[4]: r[6] for r in BATCH}

    def run(sizes):
        index, out, at = h.SegmentIndex(spark), {}, 0
        index.append(h.standardise(rows(spark, JOBS), ALIASES, "id", "at"))
        for n in sizes:
            batch = h.standardise(rows(spark, [r[:6] for r in BATCH[at : at + n]]), ALIASES, "key", "id", "at")
            out |= {r["key"]: r["repeats"] for r in h.check_batch(batch, index, frozenset(["baker", "engineer", "analyst"])).collect()}
            at += n
        again = h.check_batch(h.standardise(rows(spark, [(*r[:4], r[4], r[5] + 100) for r in BATCH[:3]]), ALIASES, "key", "id", "at"), index.compact(), frozenset()).collect()
        assert all(r["repeats"] for r in again)
        return out

    assert run([13]) == want
    assert run([4, 5, 4]) == want


def test_empty_tables(spark):
    index = h.SegmentIndex(spark)
    empty = h.standardise(rows(spark, []), {}, "key", "id", "at")
    index.append(empty.select("id", "at", "block", "text"))
    assert h.check_batch(empty, index, frozenset()).count() == 0
    assert h.check_batch(h.standardise(rows(spark, [("C", "L", "Cook " * 30_000, "1", 1, 1)]), {}, "key", "id", "at"), index, frozenset()).collect()[0]["repeats"] is False


def test_brute_force_on_the_tables(spark, data):
    """Against every earlier row, by the same verification."""
    from hireloom.common import table
    from hireloom.llm import queries

    roles = table(spark, data, "ref_roles").where(F.col("short_form").isNotNull()).collect()
    aliases = {h.fold(r["short_form"]): h.fold(r["name"]) for r in roles}
    old = [(r["id"], r["company"], r["location"], h.canonical(r["title"], aliases)) for r in table(spark, data, "jobs").collect()]
    arrivals = sorted(table(spark, data, "job_arrivals").collect(), key=lambda r: (r["batch_no"], r["arrival_id"]))
    titles = {(c, p, t[0], t[1]) for _, c, p, t in [*old, *[(0, r["company"], r["location"], h.canonical(r["title"], aliases)) for r in arrivals]] if t and c is not None and p is not None}
    count = {}
    for *_, t in titles:
        for w in set(t.split()):
            count[w] = count.get(w, 0) + 1

    def same(x, y):
        pairs = h.differences(x, y)
        return pairs is not None and not any(h.own_words(count[v], count[w] if w else count[v]) for v, w in pairs)

    found = set()
    for r in arrivals:
        t = h.canonical(r["title"], aliases)
        if any((r["id"] is not None and r["id"] == i) or (t and u and (c, p) == (r["company"], r["location"]) and u[0] == t[0] and same(t[1], u[1])) for i, c, p, u in old):
            found.add(r["arrival_id"])
        old.append((r["id"], r["company"], r["location"], t))
    assert {r["arrival_id"] for r in queries.p4_found(spark, data).collect()} == found


def role(i):
    return f"Role {''.join(chr(97 + i // 26**k % 26) for k in range(3))}{i % 7} of the desk"


def history(spark, n):
    return h.standardise(rows(spark, [(f"C{i // 4}", "L", role(i), f"j{i}", i, i - 10**6) for i in range(n)]), {}, "id", "at")


def test_a_probe_reads_as_much_of_a_larger_history(spark, monkeypatch):
    monkeypatch.setattr(h, "PART_ROWS", 50)
    batch = h.standardise(rows(spark, [("C5", "L", role(21), "j5", 1, 1), ("C6", "L", "Other", "x", 2, 2)]), {}, "key", "id", "at")
    read = {}
    for n in (400, 4000):
        index = h.SegmentIndex(spark)
        index.append(history(spark, n))
        read[n] = (index.read("texts", batch.select("block")).count(), index.read("ids", batch.select("id")).count(), index.read("texts").count())
        assert {r["key"]: r["repeats"] for r in h.check_batch(batch, index).collect()} == {1: True, 2: False}
    assert read[400][2] == 2000 and read[4000][2] == 20_000
    assert read[4000][0] <= 2 * read[400][0] and read[4000][1] <= 2 * read[400][1] and read[4000][0] < 500


def test_a_killed_append_is_made_again(spark, monkeypatch):
    index = h.SegmentIndex(spark)
    index.append(history(spark, 50))

    def killed(*_):
        raise RuntimeError("killed")

    batch = h.standardise(rows(spark, [("C5", "L", role(21).replace("desk", "dsek"), "n1", 1, 1), ("C5", "L", "Night Cook", "n2", 2, 2)]), {}, "key", "id", "at")
    real = h.SegmentIndex._mark
    monkeypatch.setattr(h.SegmentIndex, "_mark", killed)
    try:
        h.check_batch(batch, index)
        raise AssertionError("it was killed")
    except RuntimeError:
        pass
    assert len(index.folders()) == 1  # what was written doesn't count
    monkeypatch.setattr(h.SegmentIndex, "_mark", real)
    for _ in range(2):  # and a batch that is checked once more after its append finds only what stood before it
        assert {r["key"]: r["repeats"] for r in h.check_batch(batch, index).collect()} == {1: True, 2: False}
    again = h.SegmentIndex(spark, index.path)
    assert again.folders() == index.folders() and again.read("ids").count() == 52


def test_many_appends_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(h, "MOST_FOLDERS", 3)
    index = h.SegmentIndex(spark)
    for i in range(5):
        h.check_batch(h.standardise(rows(spark, [("C", "L", f"Role number {chr(97 + i)} {'x' * i * 3}", f"i{i}", i, i)]), {}, "key", "id", "at"), index)
    assert len(index.folders()) <= 3 and index.read("ids").count() == 5
    got = h.check_batch(h.standardise(rows(spark, [("Q", "Q", "Q", f"i{i}", i, 100 + i) for i in range(5)]), {}, "key", "id", "at"), index)
    assert all(r["repeats"] for r in got.collect())


def test_words_of_their_own_at_every_size(spark):
    assert h.own_words(3, 3) and h.own_words(30, 500) and not h.own_words(2, 2) and not h.own_words(30, 900)
    assert h.differences("a grid", "a gird") == [("grid", "gird")] and h.differences("front end", "frontend") == [] and h.differences("head x it", "head it") == [("x", "")]
    for n in (1, 30):  # the same parts of a larger history
        old = [(f"D{k}-{i}", "L", t, f"{k}{t}{i}", 0, -1) for k in range(n) for i in range(40) for t in ("Sensor Lead Team", "Tensor Lead Team")] + [("C", "L", "Sensor Lead Team", "q", 0, -1)]
        index = h.SegmentIndex(spark)
        index.append(h.standardise(rows(spark, old), {}, "id", "at"))
        got = {r["key"]: r["repeats"] for r in h.check_batch(h.standardise(rows(spark, [("C", "L", "Tensor Lead Team", "n1", 1, 1), ("C", "L", "Snesor Lead Team", "n2", 2, 2)]), {}, "key", "id", "at"), index).collect()}
        assert got == {1: False, 2: True}


def test_every_short_form_counts(spark):
    from hireloom.llm import linking

    refs = spark.createDataFrame([(i, f"Occupation number {i}", f"zz{i}") for i in range(700)] + [(900, None, "x"), (901, "y", None)], "role_id bigint, name string, short_form string")
    aliases = linking.short_forms(refs)
    assert len(aliases) == 700 and h.canonical("Senior zz699, Grid", aliases) == ("senior", "occupation number 699 grid")
