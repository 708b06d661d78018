"""Mapping of freely entered values to the entries of a reference list (problem 6).

Each distinct value is mapped once and joined back to its rows. A multi-pattern automaton over the names and aliases of the
list finds the mentions embedded in a value; of overlapping mentions the longest wins. Values without a mention go to token-set
similarity: tokens of a name and of neighbouring tokens of the value, in any order, are matched one to one, equal, abbreviated or
some edits away; the sum of their likenesses over all tokens of both must reach a threshold, and the highest wins. Names are found
by their rarest token and tokens by what is left of them without some letters, never by going through the list. Entries that share a name are told apart by what else the value says (region, country or their codes). What is left is
reported as unmatched.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.common import lookup, materialise
from hireloom.llm.sketching import share

#: Entries that a reference list may have at most; the list is compiled into one automaton for each worker.
MOST_ENTRIES = 1_000_000
UNMATCHED = -1
#: Likeness of tokens that are one edit or an abbreviation apart, and two edits; least similarity of a name and a part of a value.
ONE_APART, TWO_APART, SIMILAR = 0.9, 0.8, 0.8

# Letters that have no canonical decomposition.
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in plain if not unicodedata.combining(c)).translate(_LETTERS)


def within_one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours, or none, turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def within_two_edits(a: str, b: str) -> bool:
    """Whether two of those edits, or fewer, turn a into b."""
    if abs(len(a) - len(b)) > 2:
        return False
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > 2:
            return False
        before, last = last, row
    return last[-1] <= 2


def abbreviates(short: str, word: str) -> bool:
    """A beginning of three letters or more, or first to last letter with some between left out."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if len(short) >= 3 and word.startswith(short):
        return True
    rest = iter(word)
    return len(short) >= 3 and short[-1] == word[-1] and all(c in rest for c in short)


def _deletions(word: str) -> set[str]:
    """Keys of which two words within one edit share one: the word and what is left of it without one letter, of long words both ends."""
    out = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) <= 66 else set()
    return out | {f"<{word[:30]}", f">{word[-30:]}"} if len(word) >= 64 else out


def _beginnings(word: str) -> set[str]:
    """Keys of which two words within two edits share one where one has six letters or more: four of the first six letters, in order."""
    return {"".join(x) for x in itertools.combinations(word[:6], 4)} if len(word) >= 4 else set()


@dataclass
class Gazetteer:
    """names: (id, name); context: id -> texts that tell entries of one name apart; short_whole: names of up to three letters must fill a segment."""

    names: list[tuple[int, str]]
    context: dict[int, list[str]] = field(default_factory=dict)
    noise: frozenset[str] = frozenset()
    short_whole: bool = False

    def compile(self) -> Gazetteer:
        import ahocorasick

        self.ids: dict[tuple[str, ...], list[tuple[int, str]]] = {}
        for i, name in self.names:
            tokens = tuple(re.findall(r"\w+", fold(name)))
            if tokens:
                self.ids.setdefault(tokens, []).append((i, name.lower()))
        self.automaton = ahocorasick.Automaton()
        for tokens in self.ids:
            self.automaton.add_word(f" {' '.join(tokens)} ", tokens)
        if self.ids:
            self.automaton.make_automaton()
        count = Counter(t for tokens in self.ids for t in set(tokens))
        self.vocabulary = {*count}
        self.near: dict[str, dict[str, float]] = {}
        self.by_deletion: dict[str, list[str]] = {}
        self.by_beginning: dict[str, list[str]] = {}
        self.by_start: dict[str, list[str]] = {}
        self.by_ends: dict[str, list[str]] = {}
        for w in self.vocabulary:
            for index, keys in ((self.by_deletion, _deletions(w)), (self.by_beginning, _beginnings(w)), (self.by_start, (w[:3],)), (self.by_ends, (w[0] + w[-1],))):
                for k in keys:
                    index.setdefault(k, []).append(w)
        self.by_rarest: dict[str, list[tuple[str, ...]]] = {}
        self.compact = {"".join(t): t for t in self.ids}
        self.compact_by: dict[str, list[str]] = {}
        for tokens in self.ids:
            self.by_rarest.setdefault(min(tokens, key=lambda t: (count[t], t)), []).append(tokens)
            if len(tokens) > 1 and len(joined := "".join(tokens)) >= 6:
                for k in _deletions(joined):
                    self.compact_by.setdefault(k, []).append(joined)
        self.regions = {i: [fold(x) for x in texts if x] for i, texts in self.context.items()}
        return self

    def map(self, value: str) -> int:
        folded = fold(value)
        segments = [re.findall(r"\w+", s) for s in re.split(r"[,;:/|()\[\]·•]|\s[-–—]\s|(?<=^\w\w)-", folded)]
        tokens = [t for s in segments for t in s]
        if not tokens or not self.ids:
            return UNMATCHED
        whole = {tuple(t for t in s if t not in self.noise) for s in segments}
        found = self._mentions(tokens, whole) or self._similar([s for s in segments if s])
        return self._resolve(found, tokens, value.lower()) if found else UNMATCHED

    def _mentions(self, tokens: list[str], whole: set[tuple[str, ...]]) -> tuple[str, ...] | None:
        text, best = f" {' '.join(tokens)} ", None
        for end, name in self.automaton.iter(text):
            if self.short_whole and len(name) == 1 and len(name[0]) <= 3 and name[0].isascii() and name not in whole:
                continue
            size = len(" ".join(name))
            rank = (-size, end)
            if best is None or rank < best[0]:
                best = (rank, name)
        return best and best[1]

    def _counterparts(self, token: str) -> dict[str, float]:
        """Words of the list that the token may stand for, with their likeness."""
        if token not in self.near:
            if len(self.near) > 200_000:
                self.near.clear()
            found = {token: 1.0} if token in self.vocabulary else {}
            pools = [(self.by_deletion, _deletions(token), ONE_APART, lambda w: len(w) >= 4 and len(token) >= 3 and within_one_edit(token, w))]
            if not self.short_whole:
                pools += [(x, k, ONE_APART, lambda w: abbreviates(token, w)) for x, k in ((self.by_start, (token[:3],)), (self.by_ends, (token[0] + token[-1],)))]
                pools += [(self.by_beginning, _beginnings(token), TWO_APART, lambda w: len(w) >= 6 and token[0] == w[0] and within_two_edits(token, w))]
            for index, keys, likeness, fits in pools:
                for w in {w for k in keys for w in index.get(k, ())}:
                    if found.get(w, 0.0) < likeness and fits(w):
                        found[w] = likeness
            self.near[token] = found
        return self.near[token]

    def similarity(self, tokens: list[str], name: tuple[str, ...]) -> float:
        """Sum of the likenesses of tokens matched one to one, in order where that is as good, over all tokens of both."""
        straight = [self._counterparts(t).get(n, 0.0) for t, n in zip(tokens, name)] if len(tokens) == len(name) else [0.0]
        if all(straight):
            return sum(straight) / len(name)
        left, total, matched = list(name), 0.0, 0
        for t in sorted(tokens, key=lambda t: -max(self._counterparts(t).values(), default=0.0)):
            best = max(((self._counterparts(t).get(n, 0.0), n) for n in left), default=(0.0, ""))
            if best[0] > 0.0:
                left.remove(best[1])
                total, matched = total + best[0], matched + 1
        return total / (len(tokens) + len(name) - matched)

    def _similar(self, segments: list[list[str]]) -> tuple[str, ...] | None:
        tokens = [t for s in segments for t in s]
        part = [k for k, s in enumerate(segments) for _ in s]
        for i in range(len(tokens) - 1):  # a word of the list written in two
            if (joined := tokens[i] + tokens[i + 1]) in self.vocabulary and len(joined) > 4:
                tokens, part = [*tokens[:i], joined, *tokens[i + 2 :]], [*part[: i + 1], *part[i + 2 :]]
                break
        size = Counter(part)
        best = None
        for i, token in enumerate(tokens):
            for rarest in self._counterparts(token):
                for name in self.by_rarest.get(rarest, ()):
                    if len(name) == 1 and len(name[0]) < 4:
                        continue
                    for a in range(max(0, i - len(name) + 1), min(i, len(tokens) - len(name)) + 1):
                        window = tokens[a : a + len(name)]
                        score = self.similarity(window, name)
                        straight = all(self._counterparts(t).get(n) for t, n in zip(window, name))
                        if score < SIMILAR or not (straight or self._alone(part[a : a + len(name)], size)):
                            continue
                        rank = (not straight, -len(name), -sum(t == n for t, n in zip(window, name)), -score, a, name)
                        if best is None or rank < best[0]:
                            best = (rank, name)
        if best:
            return best[1]
        joins = ["".join(tokens[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(tokens) - n + 1)]  # blanks lost, added or moved
        for joined in joins:
            if joined in self.compact and len(joined) > 3:
                return self.compact[joined]
        for joined in joins:
            near = {c for k in _deletions(joined) for c in self.compact_by.get(k, ()) if within_one_edit(joined, c)}
            if near:
                return self.compact[min(near)]
        return None

    @staticmethod
    def _alone(parts: list[int], size: Counter) -> bool:
        """Whether tokens in another order are all that is said in their parts, or stand in one part."""
        return len({*parts}) == 1 or all(size[p] == n for p, n in Counter(parts).items())

    def _resolve(self, name: tuple[str, ...], tokens: list[str], lower: str) -> int:
        entries = self.ids[name]
        if len({i for i, _ in entries}) == 1:
            return entries[0][0]
        rest = list(tokens)  # what else is said: the tokens without one mention of the name
        for i in range(len(tokens) - len(name) + 1):
            if tuple(tokens[i : i + len(name)]) == name:
                rest = tokens[:i] + tokens[i + len(name) :]
                break

        def score(entry: tuple[int, str]) -> tuple:
            points = 0.0
            for region in self.regions.get(entry[0], ()):
                parts = re.findall(r"\w+", region)
                if len(region) <= 2:
                    points += 2.0 * (region in rest)
                    continue
                points += 3.0 * (bool(parts) and all(any(t == p or (len(p) >= 4 and within_one_edit(t, p)) for t in rest) for p in parts))
                codes = [t for t in rest if len(t) == 2 and t[0] == region[0] and t[1] in region[1:]]
                points += max((1.5 if region.startswith(t) else 1.0 for t in codes), default=0.0)
            return (-points, entry[1] not in lower, entry[0])

        return min(entries, key=score)[0]


def map_values(rows: DataFrame, key: str, column: str, gazetteer: Gazetteer, into: str = "ref_id") -> DataFrame:
    """(key, column, into): the entry meant by each value that is neither null nor empty, UNMATCHED where the list has none.

    Null and empty values give no row; a blank value is unmatched. Ties between equally long mentions go to the first one,
    between entries of one name to the least id. Repeated rows and keys stay; other columns are pruned. An empty list matches
    nothing.
    """
    if len(gazetteer.names) > MOST_ENTRIES:
        raise ValueError(f"a reference list may have {MOST_ENTRIES} names at most")
    compiled = share(rows, gazetteer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = compiled.value
        if not hasattr(g, "automaton"):  # once for each Python worker
            g.compile()
        for batch in batches:
            ids = pa.array([g.map(v) for v in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["value", "n", "id"])

    picked = rows.where(F.col(column) != "").select(F.col(key), F.col(column))
    values = picked.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = materialise(values.mapInArrow(run, "value string, n bigint, id bigint"), "linked-values")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return lookup(picked, known, column, "value", ["id"], "n", total).select(key, column, F.col("id").alias(into))


def location_gazetteer(refs: DataFrame) -> Gazetteer:
    """From (loc_id, name, admin_area, country, country_code, other_names); read to the driver up to MOST_ENTRIES names."""
    rows = refs.where(F.col("name").isNotNull()).limit(MOST_ENTRIES + 1).collect()
    names = [(r["loc_id"], n.strip()) for r in rows for n in [r["name"], *(r["other_names"] or "").split("|")] if n and n.strip()]
    context = {r["loc_id"]: [r["admin_area"] or "", r["country"] or "", r["country_code"] or ""] for r in rows}
    return Gazetteer(names, context, frozenset("remote hybrid onsite on site office hq greater area region metro".split()), short_whole=True)


def role_gazetteer(refs: DataFrame) -> Gazetteer:
    rows = refs.where(F.col("name").isNotNull()).limit(MOST_ENTRIES + 1).collect()
    return Gazetteer([(r["role_id"], n) for r in rows for n in (r["name"], r["short_form"]) if n and n.strip()])


def short_forms(refs: DataFrame) -> dict[str, str]:
    """Short form -> name of a list's entries, of the least id where two share one; a list is read whole or refused."""
    rows = refs.where(F.col("short_form").isNotNull() & F.col("name").isNotNull()).orderBy(F.desc("role_id")).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a reference list may have {MOST_ENTRIES} names at most")
    return {fold(r["short_form"]): fold(r["name"]) for r in rows}
