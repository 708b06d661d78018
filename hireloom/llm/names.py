"""Variant spellings of organisation names, by noisy-channel attribution (problem 7).

Distinct spellings are ranked by how often they are written; the more frequent are candidate canonical forms of the less
frequent. A spelling and its candidates meet over keys cut from the rarest words of both, so no two names without a shared key
are ever compared. The posterior of a candidate is its frequency prior times the likelihood that its writer produced the
spelling by typos, abbreviations, truncation, reordering, joining, legal forms and branches; each spelling is attached to the
candidate of the highest posterior, unless a name of its own is likelier. Attachments are followed to their root.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.common import materialise, measured_broadcasts, pairs_within, slots
from hireloom.llm.linking import fold, within_one_edit, within_two_edits

# Legal forms, and places that name a branch.
LEGAL = frozenset(
    "inc incorporated ltd limited llc llp lp gmbh ag kg ug corp corporation co company plc sa sas sarl srl spa bv nv ab as oy oyj aps pvt pte pty private se kk group holding holdings".split()
)
BRANCHES = frozenset(
    "us usa uk eu uae apac emea latam amer americas asia europe africa india germany france canada japan china australia singapore ireland spain italy "
    "netherlands sweden norway denmark finland poland austria switzerland belgium portugal brazil mexico israel deutschland united states kingdom".split()
)

#: Log-likelihoods of what a writer does to one word or to the name.
ONE_EDIT, TWO_EDITS, SHORTENED, INITIAL, CUT, REORDERED, JOINED = -4.0, -9.0, -3.0, -4.0, -4.5, -2.0, -2.0
#: Log-likelihood, with the log ratio of frequencies, below which a spelling counts as a name of its own.
OWN_NAME = -13.0
#: Names that a spelling's most telling word may meet before its next word is asked for too.
HOT_KEY = 500


def parse(name: str) -> list[str]:
    """The words that tell an organisation: folded, without legal forms and branches at the end."""
    text = fold(name).replace("&", " and ").replace("+", " and ")
    text = re.sub(r"\b(\w)\.(?=\w\b)", r"\1", text).replace("'", "")
    words = re.findall(r"\w+", text)
    kept = words[1:] if len(words) > 1 and words[0] == "the" else list(words)
    while len(kept) > 1 and (kept[-1] in LEGAL or kept[-1] in BRANCHES):
        kept.pop()
    return kept


def _word(v: str, c: str) -> float | None:
    """Log-likelihood that the canonical word c was written as v."""
    if v == c:
        return 0.0
    if len(c) >= 5 and len(v) >= 4 and within_one_edit(v, c):
        return ONE_EDIT
    if v[0] == c[0] and len(v) < len(c):
        if len(v) == 1:
            return INITIAL
        if c.startswith(v):
            return CUT if len(v) >= 5 else SHORTENED
        rest = iter(c)
        if len(v) <= len(c) - 2 and (v[-1] == c[-1] or len(v) <= 6) and all(x in rest for x in v):
            return SHORTENED - 0.5 * (v[-1] != c[-1])
    if len(c) >= 8 and within_two_edits(v, c):
        return TWO_EDITS
    return None


def likelihood(v: list[str], c: list[str]) -> float | None:
    """log P(v | c), or None where no writer makes v out of c."""
    if not v or not c:
        return None
    if v == c:
        return 0.0
    if len(v) == len(c):
        best = None
        straight = [_word(x, y) for x, y in zip(v, c)]
        if all(s is not None for s in straight):
            best = sum(straight)
        left, total = list(c), REORDERED  # words in another order: each takes its likeliest counterpart, exact ones first
        for x in sorted(v, key=lambda x: (x not in c, -len(x))):
            costs = [(p, y) for y in left if (p := _word(x, y)) is not None]
            if not costs:
                break
            p, y = max(costs)
            left.remove(y)
            total += p
        if not left and (best is None or total > best):
            best = total
        if best is not None and best >= 2 * TWO_EDITS:
            return best
    x, y = "".join(v), "".join(c)
    if len(v) != len(c) and len(y) >= 8:
        if x == y:
            return JOINED
        if within_one_edit(x, y):
            return JOINED + ONE_EDIT
    return None


def _edit_keys(w: str) -> set[str]:
    """Keys of which any two words within one edit share one: the word and its one-letter deletions, for long words both ends."""
    out = {f"d{w}", *(f"d{w[:i]}{w[i + 1 :]}" for i in range(len(w)))} if len(w) <= 66 else set()
    return out | {f"<{w[:30]}", f">{w[-30:]}"} if len(w) >= 64 else out


def _two_edit_keys(w: str) -> set[str]:
    """Keys of which any two words within two edits share one where one has 8 letters or more: runs of 6 letters out of the first 8."""
    return {"t" + "".join(x) for x in itertools.combinations(w[:8], 6)}


def _word_keys(w: str) -> tuple[list[str], list[str]]:
    """Keys of a word as written and as canonical: wherever _word(v, c) gives a value and v is not c, both share one."""
    edits, two = _edit_keys(w), _two_edit_keys(w)
    written = (edits if len(w) >= 4 else set()) | (two if len(w) >= 6 else set())
    canonical = (edits if len(w) >= 5 else set()) | (two if len(w) >= 8 else set())
    # Short forms keep the first letter and the order of the others: their first three letters lie in this order in the canonical word.
    written.add(f"i{w}" if len(w) == 1 else f"p{w}" if len(w) == 2 else f"s{w[:3]}")
    if len(w) >= 3:
        written.add(f"l{w[:2]}")
    first, last = {}, {}
    for i, x in enumerate(w[1:]):
        first.setdefault(x, i)
        last[x] = i
    canonical |= {f"i{w[0]}", *(f"p{w[0]}{x}" for x in first)}
    if len(first) <= 64:
        canonical |= {f"s{w[0]}{x}{y}" for x in first for y in last if first[x] < last[y]}
    else:  # words of more different letters than an alphabet's
        canonical |= {f"l{w[0]}{x}" for x in first}
    return sorted(written), sorted(canonical)


def _word_pairs(words: DataFrame) -> DataFrame:
    """(x, y): words y of ``words`` (word, once each) as which x may have been meant, itself included."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_word_keys(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([k[i] for k in keys], pa.list_(pa.string())) for i in (0, 1))], names=["word", "written", "canonical"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_word(x, y) is not None for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    keys = materialise(words.mapInArrow(keyed, "word string, written array<string>, canonical array<string>"), "names-word-keys")
    written, canonical = (keys.select(F.col("word").alias(n), F.explode(side).alias("key")) for n, side in (("x", "written"), ("y", "canonical")))
    met = written.join(canonical, "key").where(F.col("x") != F.col("y")).select("x", "y").distinct()
    return met.mapInArrow(kept, "x string, y string").unionByName(words.select(F.col("word").alias("x"), F.col("word").alias("y")))


def _candidates(spelled: DataFrame) -> DataFrame:
    """(name_v, name_c), once each: every two of ``spelled`` (name, words, joined) for which likelihood() may give a value.

    Names of equally many words are likely only where each word of v stands for one of c. So v looks for names with the meanings
    of the one of its words that meets the fewest, and where these are still more than HOT_KEY, with those of its next word too.
    Names of other numbers of words are likely only where they are within one edit when joined.
    """
    placed = spelled.select("name", F.size("words").alias("k"), F.posexplode("words").alias("at", "word"))
    meanings = materialise(_word_pairs(placed.select("word").distinct()), "names-word-pairs")
    sizes = placed.select("name", "k", "word").distinct().groupBy("k", F.col("word").alias("y")).agg(F.count(F.lit(1)).alias("size"))
    costs = meanings.join(sizes, "y").groupBy("k", F.col("x").alias("word")).agg(F.sum("size").alias("cost"))
    probes = placed.join(costs, ["k", "word"]).groupBy("name", "k").agg(F.array_sort(F.collect_list(F.struct("cost", "word", "at"))).alias("w"))
    second = F.when((F.col("k") > 1) & (F.col("w")[0]["cost"] > HOT_KEY), F.col("w")[F.least(F.lit(1), F.col("k") - 1)]["word"]).otherwise("")
    probes = probes.select(F.col("name").alias("name_v"), "k", F.col("w")[0]["word"].alias("x1"), second.alias("x2"))
    nothing = meanings.sparkSession.createDataFrame([("", "")], "x2 string, y2 string")
    probes = probes.join(meanings.withColumnsRenamed({"x": "x1", "y": "y1"}), "x1").join(meanings.withColumnsRenamed({"x": "x2", "y": "y2"}).unionByName(nothing), "x2")
    # The words of c alone, and two by two where a probe asks for both.
    alone = placed.select(F.col("name").alias("name_c"), "k", F.col("word").alias("y1"), F.lit("").alias("y2")).distinct()
    asked = probes.where("x2 <> ''").select("k", "y1", "y2").distinct()
    one, other = (placed.select("name", "k", F.col("at").alias(f"at{i}"), F.col("word").alias(f"y{i}")) for i in (1, 2))
    one, other = (d.join(asked.select("k", f"y{i}").distinct(), ["k", f"y{i}"], "left_semi") for i, d in ((1, one), (2, other)))
    both = one.join(other, ["name", "k"]).where("at1 <> at2").select(F.col("name").alias("name_c"), "k", "y1", "y2").distinct()
    same = probes.join(alone.unionByName(both), ["k", "y1", "y2"]).select("name_v", "name_c")
    keys = spelled.where(F.length("joined") >= 7).select("name", F.size("words").alias("k"), "joined")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = pa.array([sorted(_edit_keys(x)) for x in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), of], names=["name", "k", "keys"])

    near = keys.mapInArrow(edits, "name string, k int, keys array<string>").select("name", "k", F.explode("keys").alias("key")).withColumn("key", F.xxhash64("key"))
    v, c = (near.withColumnsRenamed({x: f"{x}_{s}" for x in ("name", "k")}) for s in ("v", "c"))
    return same.unionByName(v.join(c, "key").where("k_v <> k_c").select("name_v", "name_c")).where("name_v <> name_c").distinct()


def link_names(names: DataFrame, name: str) -> DataFrame:
    """(name, n, root, log_posterior): each distinct non-blank spelling of ``names`` once, exactly as stored, with its number of
    rows and the canonical spelling it was attributed to (itself where it has a name of its own).

    Null, empty and blank names give no row; names without a letter or digit stay alone. Ties of frequency go to the spelling with
    fewer signs, then to the lower by code points, so the result doesn't depend on the order of rows. Repeated rows count.
    """
    with measured_broadcasts(names.sparkSession):
        return _link_names(names, name)


def _link_names(names: DataFrame, name: str) -> DataFrame:
    counted = names.where(F.col(name).isNotNull() & (F.trim(F.col(name)) != "")).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [parse(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(["".join(w) for w in words], pa.string())], names=["name", "n", "words", "joined"]
            )

    spelled = materialise(counted.mapInArrow(parsed, "name string, n bigint, words array<string>, joined string"), "names-parsed")
    v, c = (spelled.select(*[F.col(x).alias(f"{x}_{s}") for x in ("name", "n", "words")]) for s in ("v", "c"))
    higher = (F.col("n_c") > F.col("n_v")) | (
        (F.col("n_c") == F.col("n_v")) & (F.struct(F.length("name_c"), F.col("name_c")) < F.struct(F.length("name_v"), F.col("name_v")))
    )
    pairs = _candidates(spelled).join(v, "name_v").join(c, "name_c").where(higher).select("name_v", "n_v", "words_v", "name_c", "n_c", "words_c")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nv, kv, wv, nc, kc, wc = (batch.column(i).to_pylist() for i in range(6))
            keep, score = [], []
            for i in range(len(batch)):
                p = likelihood(wv[i], wc[i])
                if p is not None and p + math.log(kc[i] / kv[i]) >= OWN_NAME:
                    keep.append(i)
                    score.append(p + math.log(kc[i]))
            yield pa.RecordBatch.from_arrays([pa.array([nv[i] for i in keep], pa.string()), pa.array([nc[i] for i in keep], pa.string()), pa.array(score, pa.float64())], names=["name", "to", "score"])

    scores = pairs.mapInArrow(scored, "name string, to string, score double")
    best = scores.groupBy("name").agg(F.max(F.struct("score", "to")).alias("best"))
    roots = spelled.select("name", "n").join(best, "name", "left")
    roots = materialise(roots.select("name", "n", F.coalesce("best.to", "name").alias("root"), F.col("best.score").alias("log_posterior")), "names-roots")
    while True:  # ranks rise along attachments, and each round halves the way to the root
        up = roots.select(F.col("name").alias("mid"), F.col("root").alias("above"))
        step = roots.join(up, F.col("root") == F.col("mid")).select("name", "n", "above", "log_posterior", "root")
        step = materialise(step, "names-roots")
        done = step.where(F.col("above") != F.col("root")).isEmpty()
        roots = step.select("name", "n", F.col("above").alias("root"), "log_posterior")
        if done:
            return roots


def name_pairs(roots: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code points: all pairs of spellings of one organisation; large groups meet in cells."""
    with measured_broadcasts(roots.sparkSession):
        placed, sizes = slots(roots.select("root", "name"), "root", "name")
        pairs = pairs_within(placed, sizes, "root", "name").withColumnsRenamed({"key_a": "name_a", "key_b": "name_b"})
        return materialise(pairs, "names-pairs")
