"""Main body of pages by maximum-scoring subsequence (problem 3).

Each line that shows text is scored: its words, shape and tags carry weights that are learned from labelled pages, a bounded
sample of pages whose own markup names the parts (main, article against nav, footer, aside and the like). Words of the body
count up, controls and tags count down, and one linear scan finds the contiguous run of lines with the highest sum: the main
body. Within it the same scan over the negated scores finds the asides that interrupt it.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.llm.shingles import _powers, mix
from hireloom.llm.sketching import share

#: Labelled pages that the weights are learned from, at most; they are drawn by a hash of the key.
LABELLED_PAGES = 1200
FEATURE_BITS = 18
EPOCHS = 4
#: Texts that are scored together.
TEXTS_AT_ONCE = 200
#: Sum of scores that an aside within the body must reach, and sum of log-odds that any run outside the body must.
ASIDE, EVIDENCE = 0.6, 5.0

# Names of elements, and of their classes and ids, that tell what a part of a page is.
BODY_TAGS = frozenset("main article".split())
CHROME_TAGS = frozenset("nav footer aside form header dialog menu button select".split())
BODY_NAMES = re.compile(r"\b(?:job[-_]?(?:description|content|body|detail\w*)|posting[-_]?(?:body|content)|main[-_]?content|article)\b")
CHROME_NAMES = re.compile(
    r"\b(?:nav\w*|menu\w*|breadcrumb\w*|footer|header|cookie\w*|consent|overlay|modal|popup|banner|widget|sidebar|share|sharing|social[-\w]*|cta|apply|lang\w*[-_]selector|newsletter|subscribe|related|similar|recommend\w*|promo)\b"
)
_VOID = frozenset("br hr img input meta link wbr col area base embed source track".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>|<![a-zA-Z][^>]*>", re.S)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_SHOWN = re.compile(r"[^\W_]|[^\x00-\u2fff]")


def visible_lines(text: str) -> list[tuple[int, str, int, tuple[str, ...]]]:
    """(line number from 1, text shown, label, tags on the line) of each line that shows text.

    Tags, comments, scripts and styles show nothing, also across lines; character references are read. The label is 1 or -1 where
    the innermost named element says that the text belongs to the body or to the page around it, else 0.
    """
    if "<" not in text and "&lt;" in text:
        text = html.unescape(text)
    if "<" not in text and "&" not in text:
        return [(i, " ".join(x.split()), 0, ()) for i, x in enumerate(text.split("\n"), 1) if _SHOWN.search(x)]
    lines, tags = [[]], [[]]
    labels: list[int] = [0]
    stack: list[tuple[str, int]] = []
    silent = ""

    def put(chunk: str) -> None:
        for i, piece in enumerate(chunk.split("\n")):
            if i:
                lines.append([])
                tags.append([])
                labels.append(0)
            if not silent and piece.strip():
                lines[-1].append(piece)
                labels[-1] = stack[-1][1] if stack else 0

    at = 0
    for m in _TAG.finditer(text):
        put(text[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if name:
            closing, attributes = m.group(1), m.group(3)
            if silent:
                if closing and name == silent:
                    silent = ""
            elif not closing and name in ("script", "style"):
                silent = name
            elif closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in _VOID and not attributes.endswith("/"):
                named = " ".join(_ATTR.findall(attributes)).lower()
                own = 1 if name in BODY_TAGS or BODY_NAMES.search(named) else -1 if name in CHROME_TAGS or CHROME_NAMES.search(named) else None
                stack.append((name, own if own is not None else stack[-1][1] if stack else 0))
            tags[-1].append(name)
        elif "\n" in m.group():
            for _ in range(m.group().count("\n")):
                lines.append([])
                tags.append([])
                labels.append(0)
    put(text[at:])
    out = []
    for i, (parts, label, on) in enumerate(zip(lines, labels, tags)):
        shown = " ".join(html.unescape("".join(parts)).split())
        if _SHOWN.search(shown):
            out.append((i + 1, shown, label, tuple(on)))
    return out


# Signs of layout keep a byte of their own; other typographic signs are blanks.
_LAYOUT = {"·": "\x10", "»": "\x11", "©": "\x12", "•": "\x13", "›": "\x11"} | dict.fromkeys("–—«…®™’‘“”„", " ")
_TRANSLATE = str.maketrans(_LAYOUT)
_SIGN_BYTES = (*b"|/>", 0x10, 0x11, 0x12, 0x13)
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[0x30:0x3A] = 0x30
# Salts that keep kinds of features apart.
_W, _B, _N, _FIRST, _LAST, _END, _LINE, _SIGN, _CAPS, _TITLE, _CRUMB, _TAGS, _NEXT = (np.uint64((k * 0x9E3779B97F4A7C15 + 1) % (1 << 64)) for k in range(13))
_MASK = np.uint64((1 << FEATURE_BITS) - 1)


def crumbs_of(lines: list[tuple[int, str, int, tuple[str, ...]]]) -> frozenset[str]:
    """Last steps of the paths ("Home / Jobs / title") among the lines of a page."""
    return frozenset(x.lower().strip(" :") for _, shown, _, _ in lines if len(steps := re.split(r" [/»>›] ", shown)) > 2 for x in steps[-1:])


@dataclass
class Lines:
    """Lines of many texts, one after the other."""

    shown: list[str] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    tags: list[tuple[str, ...] | None] = field(default_factory=list)
    crumb: list[bool] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)

    def add(self, title: str | None, lines: list[tuple[int, str, int, tuple[str, ...]]], marked: bool) -> None:
        crumbs = crumbs_of(lines) if lines else frozenset()
        for _, shown, _, on in lines:
            self.shown.append(shown)
            self.page.append(len(self.titles))
            self.tags.append(on if marked else None)
            self.crumb.append(bool(crumbs) and shown.lower().strip(" :") in crumbs)
        self.titles.append(title or "")


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, text of each word, whether it starts with a capital, bytes, edges of the texts)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    edges = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8) if raw else np.zeros(0, np.uint8)
    inside = _INSIDE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    up, down = _powers(max(1 << 16, 1 << int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(edges, starts, side="right") - 1, (first >= 0x41) & (first <= 0x5A), data, edges


def features(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, rows, whether the feature tells words): each feature of each line; a feature of its words, shape, place or tags."""
    n = len(lines.shown)
    h, row, capital, data, edges = _hashed([s.translate(_TRANSLATE) for s in lines.shown])
    slots, rows, kinds = [], [], []

    def put(salt: np.uint64, values: np.ndarray, where: np.ndarray, words: bool = False) -> None:
        slots.append(mix(values.astype(np.uint64) * np.uint64(2) + salt) & _MASK)
        rows.append(where)
        kinds.append(np.full(len(where), words))

    every = np.arange(n)
    count = np.bincount(row, minlength=n)
    put(_W, h, row, True)
    same = row[1:] == row[:-1]
    put(_B, (h[:-1] * np.uint64(3) + mix(h[1:]))[same], row[1:][same], True)
    put(_N, np.where(count < 4, count, 4 + np.minimum(count // 4, 6)), every)
    begin = np.searchsorted(row, every)
    some = count > 0
    put(_FIRST, h[begin[some]], every[some])
    put(_LAST, h[(begin + count - 1)[some]], every[some])
    put(_END, np.where(_INSIDE[data[edges[1:] - 2]], 1, data[edges[1:] - 2]) if n else every, every)
    inner = np.arange(len(h)) - begin[row]
    cover = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + inner.astype(np.uint64)), dtype=np.uint64)))
    short = some & (count <= 10)
    put(_LINE, (cover[begin + count] - cover[begin])[short], every[short], True)
    line_of = np.searchsorted(edges, np.flatnonzero(np.isin(data, _SIGN_BYTES)), side="right") - 1
    sign = data[np.isin(data, _SIGN_BYTES)].astype(np.int64)
    pair, times = np.unique(line_of * 256 + sign, return_counts=True)
    put(_SIGN, (pair % 256) * 4 + np.minimum(times, 3), pair // 256)
    put(_CAPS, 4 * np.bincount(row, weights=capital, minlength=n) // np.maximum(count, 1), every)
    title, of, _, _, _ = _hashed([t.translate(_TRANSLATE) for t in lines.titles])
    page = np.array(lines.page, dtype=np.int64)
    size = np.bincount(of, minlength=max(len(lines.titles), 1))
    known = np.unique(mix(title + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    asked = mix(h + page[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if n else h
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    hit = (known[at] == asked) if len(known) else np.zeros(len(asked), bool)
    common = np.bincount(row, weights=hit, minlength=n)
    near = some & (count <= 20) & (size[page] > 0 if n else some)
    put(_TITLE, (4 * common // np.maximum(count + (size[page] if n else count) - common, 1))[near], every[near])
    # A short line before a long one is a heading of what follows.
    after = np.concatenate((count[1:], [0])) * np.concatenate((page[1:] == page[:-1], [False])) if n else count
    put(_NEXT, (np.minimum(count, 15) // 5) * 8 + np.minimum(after, 24) // 6 + 64 * np.concatenate(([True], page[1:] != page[:-1]))[:n], every)
    put(_CRUMB, every[np.array(lines.crumb, dtype=bool)] * 0, every[np.array(lines.crumb, dtype=bool)])
    tags = [(i, zlib.crc32(t.encode())) for i, on in enumerate(lines.tags) if on is not None for t in (set(on) or ("none",))]
    put(_TAGS, np.array([t for _, t in tags], dtype=np.uint64), np.array([i for i, _ in tags], dtype=np.int64))
    return np.concatenate(slots).astype(np.int64), np.concatenate(rows).astype(np.int64), np.concatenate(kinds)


# How lists, headings and emphasis are written without tags, and lines that only set a body's layout.
_DRESSES = ("{}", "{}:", "· {}", "– {}", "* {}", "- {}", "## {}", "== {} ==", "**{}**", "| {} |", "\\item {}", "\\section{{{}}}", "{} $x^2$", "| {} || 1", "    {}", "{}, \\(x\\)", "1. {}", "! {} !! n")
_LAYOUT_LINES = (
    "\\begin{itemize}", "\\end{itemize}", "\\begin{enumerate}", "\\end{enumerate}", '{| class="wikitable"', "|-", "|}", "```", "```python", "while x:", "x = f(y)", "return x", "| --- | --- |",
    "\\(y\\)", "$O(n)$", "\\[x\\]", "SELECT a FROM b", "print(x)", "def f(x):", "if x > 1:", "----", "====",
)


def _fit(slots: np.ndarray, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, seen: np.ndarray, epochs: int) -> None:
    """Logistic regression with a step size of its own for each weight."""
    order = np.argsort(rows, kind="stable")
    slots, cuts = slots[order], np.searchsorted(rows[order], np.arange(len(labels) + 1))
    random = np.random.default_rng(7)
    for _ in range(epochs):
        for i in random.permutation(len(labels)):
            own = slots[cuts[i] : cuts[i + 1]]
            gradient = -labels[i] / (1 + math.exp(min(labels[i] * weights[own].sum(), 50.0)))
            seen[own] += gradient * gradient
            weights[own] -= 0.3 * gradient / np.sqrt(seen[own])


def learn(pages: list[tuple[str | None, str]]) -> np.ndarray:
    """Weights by logistic regression over the lines of labelled pages (title, text).

    Each labelled line is seen with its tags and, dressed as texts without tags write it, without them. The titles of the pages
    and the lines that only set a layout are lines of bodies too.
    """
    weights, seen = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-8)
    lines, labels, dress = Lines(), [], 0
    for page, (title, text) in enumerate(pages):
        found = [x for x in visible_lines(text) if x[2]]
        lines.add(title, found, True)
        dressed = []
        for i, shown, label, on in found:
            dress += 1
            dressed.append((i, _DRESSES[dress % len(_DRESSES)].format(shown) if label > 0 else shown, label, on))
        if found:
            dressed += [(0, _LAYOUT_LINES[(page * 2 + k) % len(_LAYOUT_LINES)], 1, ()) for k in range(2)]
            dressed += [(0, _DRESSES[page % len(_DRESSES)].format(title), 1, ())] if title and page % 2 else []
        lines.add(title, dressed, False)
        labels += [x[2] for x in found] + [x[2] for x in dressed]
    if not labels:
        return weights.astype(np.float32)
    slots, rows, _ = features(lines)
    _fit(slots, rows, np.array(labels, dtype=np.float64), weights, seen, EPOCHS)
    return weights.astype(np.float32)


def best_run(scores: list[float]) -> tuple[int, int, float]:
    """(start, end, sum) of the contiguous run with the highest sum, by one linear scan; the first and longest of equal ones."""
    best, start, total = (0, 0, 0.0), 0, 0.0
    for i, s in enumerate(scores):
        if total <= 0:
            start, total = i, 0.0
        total += s
        if total > best[2] or (total == best[2] > 0 and start == best[0]):
            best = (start, i + 1, total)
    return best


def negative_runs(scores: list[float], least: float) -> list[tuple[int, int]]:
    """All runs found by taking the lowest-sum run out again and again, as long as its sum is -least or lower."""
    out, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        i, j, total = best_run([-s for s in scores[a:b]])
        if j > i and total >= least:
            out.append((a + i, a + j))
            todo += [(a, a + i), (a + j, b)]
    return sorted(out)


def outside(titles: list[str | None], texts: list[str], weights: np.ndarray) -> list[list[int]]:
    """Numbers of the lines of each text that show text outside the main body."""
    lines, parts = Lines(), []
    for title, text in zip(titles, texts):
        found = visible_lines(text)
        lines.add(title, found, "<" in text)
        parts.append([x[0] for x in found])
    if not lines.shown:
        return [[] for _ in texts]
    slots, rows, _ = features(lines)
    odds = np.bincount(rows, weights=weights[slots], minlength=len(lines.shown))
    x = np.tanh(odds / 2)
    n = np.array([s.count(" ") + 1 for s in lines.shown])
    scores = np.where(x > 0, x * np.minimum(n, 20), x * np.minimum(n, 2)).tolist()
    out, at = [], 0
    for numbers in parts:
        own = scores[at : at + len(numbers)]
        at += len(numbers)
        if not own or max(own) <= 0:
            out.append([])
        elif min(own) >= 0:
            out.append([])
        else:
            start, end, _ = best_run(own)
            off = [(0, start), *[(start + a, start + b) for a, b in negative_runs(own[start:end], ASIDE)], (end, len(own))]
            first = at - len(own)
            out.append([numbers[k] for a, b in off if odds[first + a : first + b].sum() <= -EVIDENCE for k in range(a, b)])
    return out


def page_noise(rows: DataFrame, key: str, title: str, text: str, labelled_pages: int = LABELLED_PAGES) -> DataFrame:
    """(key, line_no): the lines of ``text`` that show text to a reader outside the main body.

    Lines are split at the line feed and counted from 1. Null, empty and blank texts give no row, nor does a text without a line
    that scores as body, nor any text where no page is labelled. Repeated rows and keys stay; other columns are pruned.
    """
    picked = rows.select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(text).alias("text")).where(F.trim("text") != "")
    body, chrome = r"(?i)<(main|article)\b|<\w+ [^>]*\bjob[-_]?(description|content)", r"(?i)<(nav|footer|aside)\b|<\w+ [^>]*\b(navbar|footer|sidebar)"
    named = F.col("text").contains("<") & F.col("text").rlike(body) & F.col("text").rlike(chrome)
    n = picked.agg(F.count_if(named)).first()[0]
    # A bound of the hash keeps what reaches the driver to about as many pages as are wanted; pages beyond it aren't even looked at.
    slot = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    bound = 1 << 40 if n <= labelled_pages else int((1 << 40) * min(1.0, 1.2 * labelled_pages / n))
    drawn = picked.where(slot < bound).where(named).orderBy(slot, "key").limit(labelled_pages).select("title", "text")
    weights = share(rows, learn([(r["title"], r["text"]) for r in drawn.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, titles, texts = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                part = slice(i, i + TEXTS_AT_ONCE)
                found += [(k, n) for k, numbers in zip(keys[part], outside(titles[part], texts[part], weights.value)) for n in numbers]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], batch.schema.field(0).type), pa.array([n for _, n in found], pa.int64())], names=["key", "line_no"])

    return picked.mapInArrow(run, f"key {dict(picked.dtypes)['key']}, line_no bigint").withColumnRenamed("key", key)
