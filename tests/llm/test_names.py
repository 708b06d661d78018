from hireloom.llm import names as nm


def test_likelihoods():
    c = nm.parse("Bawumnordek Global Insurance")
    for v in ("BAWUMNORDEK GLOBAL INSURANCE", "Bawumnordek Global Insurance, Inc.", "Bawumnordek Global Insurance (APAC)", "The Bawumnordek Global Insurance Company", "Bawumnordek-Global-Insurance", "Báwümnördék Global Insurance"):
        assert nm.likelihood(nm.parse(v), c) == 0.0, v
    for v in ("Bawumnordek G. Insurance", "Bawumnordek Global Ins. Pvt Ltd", "Insurance, Bawumnordek Global", "Bawmnordek Global Insurance", "BawumnordekGlobalInsurance", "Bawumnor Global Insurance", "Bawumnordek Global Isnurance"):
        assert nm.likelihood(nm.parse(v), c) < 0, v
    for v in ("Bawumnordek Robotics", "Kalbranwum Global Insurance", "Bawumnordek", "", "Bawumnordek Global Instruments", "Global Insurance"):
        assert nm.likelihood(nm.parse(v), c) is None, v


def test_links(spark):
    rows = ["Bawumnordek Global Insurance"] * 30 + ["Bawumnordek Global Ins."] * 3 + ["bawumnordek global insurance gmbh"] + ["Bawumnordek Robotics"] * 20 + ["Bawumnordek Robtoics"] + [None, "", "  ", "—", "X" * 30_000] + ["Cel & Sons"] * 2 + ["Cel and Sons"]
    df = spark.createDataFrame([(r, "root") for r in rows], "name string, root string")
    roots = nm.link_names(df, "name")
    got = {r["name"]: (r["n"], r["root"]) for r in roots.collect()}
    assert got["Bawumnordek Global Ins."] == (3, "Bawumnordek Global Insurance") and got["bawumnordek global insurance gmbh"][1] == "Bawumnordek Global Insurance"
    assert got["Bawumnordek Robtoics"][1] == "Bawumnordek Robotics" and got["Bawumnordek Robotics"] == (20, "Bawumnordek Robotics") and got["—"][1] == "—"
    assert len(got) == 9 and None not in got
    pairs = {tuple(r) for r in nm.name_pairs(roots).collect()}
    assert ("Cel & Sons", "Cel and Sons") in pairs and all(a < b for a, b in pairs) and len(pairs) == 5
    assert nm.link_names(df.limit(0), "name").count() == 0


def test_hot_key_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nm, "HOT_KEY", 3)
    rows = [f"Commonword {chr(97 + i)}{chr(97 + i)}xyzzy Systems" for i in range(20)] + ["Commonword aaxyzzy System"]
    got = {r["name"]: r["root"] for r in nm.link_names(spark.createDataFrame([(r,) for r in rows], "name string"), "name").collect()}
    assert got["Commonword aaxyzzy Systems"] == "Commonword aaxyzzy System" or got["Commonword aaxyzzy System"] == "Commonword aaxyzzy Systems"


def test_every_likely_pair_is_compared(spark, monkeypatch):
    import itertools
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    names = ["stripe", "strpie", "brightway", "brightwayy", "plaid", "plad", "intercontinental", "intl", "interco", "kalbranwum", "kalbarnwmu", "Bawumnordek Global Insurance", "B G I", "Bawumnrdek Globl Insuranec", "a b c d e f g h", "abcdefgh", "x" * 70, "x" * 69 + "y", "z" + "x" * 69, "—"]
    for _ in range(150):  # made names and what one or two edits in each of their words make of them
        words = ["".join(r.choices("abcde", k=r.randint(4, 12))) for _ in range(r.randint(1, 3))]
        names.append(" ".join(words))
        for i, w in enumerate(words):
            for _ in range(r.randint(1, 2)):
                p = r.randrange(len(w))
                w = r.choice((w[:p] + w[p + 1 :], w[:p] + r.choice("abcde") + w[p:], w[:p] + r.choice("abcde") + w[p + 1 :], w[:p] + w[p : p + 2][::-1] + w[p + 2 :])) or "a"
            words[i] = w
        names.append(" ".join(words))
    names = sorted(set(names))
    words = {n: nm.parse(n) for n in names}
    want = {(v, c) for v, c in itertools.permutations(names, 2) if nm.likelihood(words[v], words[c]) is not None}
    df = spark.createDataFrame([(n, words[n], "".join(words[n])) for n in names], "name string, words array<string>, joined string")
    for hot in (500, 3):
        monkeypatch.setattr(nm, "HOT_KEY", hot)
        got = {tuple(x) for x in nm._candidates(df).collect()}
        assert want <= got, sorted(want - got)[:5]
    assert nm.link_names(spark.createDataFrame([("stripe",), ("stripe",), ("strpie",)], "name string"), "name").where(F.col("root") == "stripe").count() == 2


def test_no_broadcast_by_the_size_of_a_file(spark, monkeypatch):
    import random

    r = random.Random(5)
    rows = [f"{''.join(r.choices('abcdefghijklmno', k=11))} {r.choice(('Global', 'Data'))} Insurance" for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in [*rows, *rows[:200], *(x.replace("Insurance", "Ins.") for x in rows[:100])]], "name string")
    plans, plain = [], nm.materialise

    def planned(d, name):
        plans.append(d._jdf.queryExecution().sparkPlan().toString())
        return plain(d, name)

    monkeypatch.setattr(nm, "materialise", planned)
    roots = nm.link_names(df, "name")
    got = {x["name"]: x["root"] for x in roots.collect()}
    assert all(got[x.replace("Insurance", "Ins.")] == x for x in rows[:100])
    assert nm.name_pairs(roots).count() >= 100
    assert len(plans) > 4 and not [p for p in plans if "BroadcastHashJoin" in p]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
