"""Markup residue in text documents (problem 1).

A text is judged in blocks by two-pass rules. The blocks of the source are its lines: the first pass labels a line as markup by
its signs, or as prose by its length and its density of stop words; short lines, and lines whose only sign is an ambiguous one
such as a leading hyphen, stay undecided and inherit in the second pass from the nearest decided neighbours. A text is marked up
where a line is. Its markup is then taken out, and what it meant stays as the kind of a block: heading, list item, code, formula,
table row or text. These blocks are labelled once more, by link density, length and stop words: blocks that are links and little
else are page chrome, short ones with links or inside navigation inherit. A block without such evidence of its own is never
dropped, and a text is never dropped as a whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Block rules: lengths in characters, densities as shares.
SHORT, LONG, FEW_STOPS, MANY_STOPS, MOST_LINKS = 40, 160, 0.12, 0.25, 0.5
#: Characters that a block of links has outside them at most, or a fifth of its length.
OUTSIDE = 20

# Names of elements of HTML and wiki markup.
TAGS = frozenset(
    "html head body title meta link base style script noscript template header footer main nav section article aside h1 h2 h3 h4 h5 h6 hgroup div p br hr pre blockquote ol ul li dl dt dd "
    "figure figcaption a em strong small s cite q code var samp kbd sub sup i b u mark abbr acronym address bdi bdo span time wbr ins del img picture source iframe embed object param video audio track "
    "map area table caption colgroup col tbody thead tfoot tr td th form fieldset legend label input button select datalist optgroup option textarea output progress meter details summary dialog menu "
    "svg path g math canvas slot font center big strike tt dir frame frameset noframes marquee nobr ref references nowiki gallery noinclude includeonly onlyinclude syntaxhighlight poem blink".split()
)
#: Elements whose short blocks may be chrome.
CHROME_TAGS = frozenset("nav footer menu button select".split())
BLOCK_TAGS = frozenset(
    "html head body title header footer main nav section article aside div p br hr pre blockquote ol ul li dl dt dd figure figcaption table caption tbody thead tfoot tr form fieldset legend button select option textarea details summary dialog menu center h1 h2 h3 h4 h5 h6 address".split()
)
COMMANDS = (
    "item begin end section subsection subsubsection chapter paragraph part textbf textit texttt textsc textrm textsf emph underline cite citep citet ref label href url footnote caption includegraphics centering noindent par newline linebreak newpage clearpage "
    "hfill hspace vspace bigskip medskip smallskip quad qquad maketitle title author date documentclass usepackage newcommand bf em tt sc large Large huge small tiny normalsize footnotesize LaTeX TeX ldots dots cdots "
    "alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega leq geq neq approx times cdot sum prod int frac sqrt log ln exp sin cos lim infty partial nabla in to rightarrow left right mathrm mathbf mathbb mathcal text"
).split()
# Frequent function words by language.
STOPS = {
    "en": "a about after all also an and are as at be because been before behind but by can each every for from has have how if in into is it its more no not of on one only or other our out own should so some than that the their them then there these they this to together we were what when which who will with without would you your",
    "de": "aber als am an auch auf aus bei das dein dem den der des die du ein eine einen einer es für ihr im in ist mit nach nicht oder sich sie sind und uns unter vom von vor wir wird zu zum zur über",
    "fr": "au aux avec ce cette ces dans de des du elle en est et il la le les leur mais nous notre ou par pas plus pour que qui sa se ses son sous sur un une vous votre",
    "es": "al como con cada del desde el ella ellos en entre es esta este hasta junto la las lo los más no nos nuestra o para pero por que se ser sin sobre su sus te tu una uno y",
}
_STOPS = {k: frozenset(v.split()) for k, v in STOPS.items()}
#: Share of a text's words that must be stop words of a language for it to count as written in it.
KNOWN_LANGUAGE = 0.08
_WORD = re.compile(r"[^\W\d_]+")


def stops_of(text: str) -> frozenset[str] | None:
    """The stop words of the language that a text is written in; None where it is none of those known."""
    words = _WORD.findall(text.lower())
    hits, name = max((sum(map(x.__contains__, words)), k) for k, x in _STOPS.items())
    return _STOPS[name] if hits and hits >= KNOWN_LANGUAGE * len(words) else None


def density(text: str, stops: frozenset[str] | None) -> float | None:
    """Share of stop words among the words of a block; None where the language is unknown."""
    if stops is None:
        return None
    words = _WORD.findall(text.lower())
    return sum(map(stops.__contains__, words)) / max(1, len(words))


_SHOWN = frozenset(["LaTeX", "TeX", *COMMANDS[COMMANDS.index("alpha") :]]) - {"left", "right", "mathrm", "mathbf", "mathbb", "mathcal", "text"}
_ENTITIES = frozenset(n[:-1] for n in html5 if n.endswith(";"))
_ATTRIBUTES = r"(?:\s+[A-Za-z_:@][\w:.-]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+)|\s+(?:disabled|checked|selected|hidden|required|readonly|async|defer|controls|open|reversed|nowrap|novalidate|multiple))*"
# A whole tag of any name, a comment, a declaration, an address in brackets; and a tag that is cut off before its bracket.
_WHOLE = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9:-]*)({_ATTRIBUTES})\s*/?\s*>|<!--.*?-->|<!--|<!\s*(?:doctype|\[cdata\[)[^>]*>?|<\?xml[^>]*>|<((?:https?://|mailto:)[^\s<>]+)>", re.I | re.S)
_CUT = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?=\s[^<>\n]*(?:\Z|<|\n)|/?\Z|/?\n|<)(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>\n]*\"?|'[^'<>\n]*'?|[^\s<>\"']*))*")


@dataclass(slots=True)
class Tag:
    start: int
    end: int
    name: str = ""
    closing: bool = False
    cut: bool = False
    address: str = ""
    empty: bool = False


def tags(text: str) -> list[Tag]:
    """Each tag, whole or cut off, and each comment or declaration of a text, in order."""
    out, at = [], text.find("<")
    while at >= 0:
        m = _WHOLE.match(text, at)
        if m and (m[4] or not m[2]):
            out.append(Tag(*m.span(), address=m[4] or ""))
        elif m and (m[1] or m[2].lower() in TAGS):
            out.append(Tag(*m.span(), m[2].lower(), bool(m[1]), empty=text[m.end() - 2] == "/"))
        elif (m := _CUT.match(text, at)) and m[1].lower() in TAGS:
            out.append(Tag(*m.span(), m[1].lower(), text[at + 1] == "/", True))
        at = text.find("<", out[-1].end if out and out[-1].end > at else at + 1)
    if "-->" in text:
        inside = [(t.start, t.end) for t in out if not t.name]
        out += [Tag(m.start(), m.end()) for m in re.finditer("-->", text) if not any(a <= m.start() < b for a, b in inside)]
        out.sort(key=lambda t: t.start)
    return out


_REFERENCE = re.compile(r"&(?:#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});?|([A-Za-z][A-Za-z0-9]{1,31});|(?:nbsp|amp|lt|gt|quot|apos|ndash|mdash|hellip|[lr][sd]quo|bull|middot|copy|reg|trade)(?![A-Za-z0-9=]))")
_LATEX = re.compile(
    r"(?<![A-Za-z0-9:\\.])\\(?:[A-Za-z]+\*?\s?(?=[\[{])|(?:" + "|".join(sorted(COMMANDS, key=len, reverse=True)) + r")\*?(?![A-Za-z]))"
    r"|(?<![A-Za-z0-9:\\])\\[%&$#_{}](?!\w*\\)|(?<=[^\s\\])\\\\(?=\s|$|\[)|^\\\\(?=\s|$)|\\\((?:(?!\\[()])[^\n])+\\\)|\\\[(?:(?!\\[\[\]])[^\n])+\\\]|~\\(?=[a-z]+\{)",
    re.M,
)
_FORMULA = re.compile(r"\$\$[^$]+\$\$|\$(?=[A-Za-z\\{(|-])(?=[^$\n]*[\\^_{}])[^$\n]+(?<=\S)\$(?![\dA-Za-z])|\$(?=\d[^\s$]*[\\^_{}])[^\s$]+\$")
#: Patterns within a line and at its ends, each with the signs without which it can't match.
_SIGNED = [
    ("`", re.compile(r"`+")),
    ("~~", re.compile(r"~~")),
    ("**", re.compile(r"\*{2,}(?=[^\s*])|(?<=[^\s*])\*{2,}")),
    ("*", re.compile(r"(?<![\w*])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])")),
    ("_", re.compile(r"(?<![\w_])_{1,3}(?=[^\W_])|(?<=[^\W_])_{1,3}(?![\w_])|(?<![\w_])__\w+__(?![\w_])")),
    ("](", re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|\]\((?:https?:|/|#|mailto:)")),
    ("[[", re.compile(r"\[\[")),
    ("]]", re.compile(r"\]\]")),
    ("[", re.compile(r"\[(?:(?:https?|mailto|ftp):|\^\w+\])")),
    ("{{", re.compile(r"\{\{")),
    ("}}", re.compile(r"\}\}")),
    ("''", re.compile(r"'{2,5}(?=\S)|(?<=\S)'{2,5}")),
    ("#", re.compile(r"^[ \t]*#{1,6}(?=[ \t]+\S)|(?<=\S)[ \t]+#{2,6}[ \t]*$", re.M)),
    ("==", re.compile(r"^[ \t]*(?:={2,6}(?=[ \t]*\S)|(?:=[ \t]*){3,}$)|(?<=\S)[ \t]*={2,6}[ \t]*$", re.M)),
    ("= ", re.compile(r"^[ \t]*=(?=[ \t][^=\n]+[ \t]=[ \t]*$)", re.M)),
    ("---", re.compile(r"^[ \t]*-{3,}[ \t]*$", re.M)),
    ("***", re.compile(r"^[ \t]*\*{3,}[ \t]*$", re.M)),
    ("___", re.compile(r"^[ \t]*_{3,}[ \t]*$", re.M)),
    ("~~~", re.compile(r"^[ \t]*~{3,}", re.M)),
    (">", re.compile(r"^[ \t]*>{1,3}(?=[ \t]+\S)", re.M)),
    ("|", re.compile(r"^[ \t]*(?:\{\||\|[}+-]?|:{1,4}\{\|)", re.M)),
    ("!!", re.compile(r"^[ \t]*![ \t]*\S[^\n]*!!", re.M)),
]
_AMBIGUOUS = re.compile(r"^[ \t]*([-*+]|\d{1,3}[.)])[ \t]+(?=\S)", re.M)


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of each piece of markup that is decided by itself, in order of start; pieces may nest."""
    out = []
    if "<" in text or "-->" in text:
        out += [(t.start, t.end) for t in tags(text)]
    if "&" in text:
        out += [m.span() for m in _REFERENCE.finditer(text) if not m.group(1) or m.group(1) in _ENTITIES]
    if "\\" in text:
        out += [m.span() for m in _LATEX.finditer(text)]
    if "$" in text:
        out += [m.span() for m in _FORMULA.finditer(text)]
    for sign, pattern in _SIGNED:
        if sign in text:
            out += [m.span() for m in pattern.finditer(text)]
    return sorted(out)


@dataclass(slots=True)
class Line:
    """A block of the source: its decided pieces, its ambiguous sign, and the label 'markup', 'prose' or '' while undecided."""

    text: str
    pieces: int = 0
    sign: str = ""
    label: str = ""

    @property
    def found(self) -> int:
        return (self.pieces + bool(self.sign)) * (self.label == "markup")


def label_lines(text: str) -> list[Line]:
    """The lines of a text, labelled.

    First pass: a line with a decided piece is markup, as are neighbouring lines of one ambiguous sign, which make a list; a line
    without any sign is prose if it is longer than SHORT or has stop words; so is a long line of many stop words behind a lone
    ambiguous sign. Second pass: what is left, lone signs and short lines, is markup where the nearest decided line before or
    after it is.
    """
    lines = [Line(x) for x in text.split("\n")]
    starts = [0, *accumulate(len(x.text) + 1 for x in lines)]
    for a, _ in pieces(text):
        lines[bisect(starts, a) - 1].pieces += 1
    for m in _AMBIGUOUS.finditer(text):
        lines[bisect(starts, m.start()) - 1].sign = "1" if m[1][0].isdigit() else m[1]
    doubtful = any(x.sign and not x.pieces for x in lines)
    stops = stops_of(text) if doubtful else None
    shown = [x for x in lines if x.text.strip()]
    for i, x in enumerate(lines):
        around = [lines[k] for k in (i - 1, i + 1) if 0 <= k < len(lines)]
        if x.pieces or (x.sign and any(y.sign == x.sign and not y.pieces for y in around)):
            x.label = "markup"
        elif not doubtful:
            x.label = "prose"
        else:
            size, dense = len(x.text.strip()), density(x.text, stops) or 0.0
            if (size > LONG and dense >= MANY_STOPS) if x.sign else (size > SHORT or dense >= FEW_STOPS):
                x.label = "prose"
    if doubtful:
        before, after, last = [], [], ""
        for way, out in ((shown, before), (shown[::-1], after)):
            last = ""
            for x in way:
                out.append(last)
                last = x.label or last
        for x, a, b in zip(shown, before, after[::-1]):
            x.label = x.label or ("markup" if "markup" in (a, b) else "prose")
    return lines


def marked_lines(text: str) -> int:
    """Number of pieces of markup in the lines that are labelled so."""
    return sum(x.found for x in label_lines(text))


@dataclass
class Block:
    kind: str
    level: int
    text: str
    links: int = 0
    label: str = ""
    chrome: bool = False


def _undo_references(text: str) -> str:
    for _ in range(3):
        if "&" not in text:
            break
        read = _REFERENCE.sub(lambda m: html.unescape(m.group() if m.group().endswith(";") else m.group() + ";") if not m.group(1) or m.group(1) in _ENTITIES else m.group(), text)
        if read == text:
            break
        text = read
    return text.replace("\xa0", " ")


_ESCAPED = re.compile(r"&(?:amp;)*lt;(/?[A-Za-z][A-Za-z0-9:-]*(?:\s(?:[^<>&]|&(?!(?:amp;)*[lg]t;))*)?/?)&(?:amp;)*gt;")
_SPECIAL = re.compile(r"[*_`~\[\]{}\\$'=#|>]")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*$")
_HEADING = re.compile(r"^[ \t]*(?:(#{1,6})[ \t]+(.*?)[ \t]*#*|(={1,6})[ \t]*(.+?)[ \t]*=*)[ \t]*$")
_SECTION = re.compile(r"^[ \t]*\\(sub)*(?:section|chapter|paragraph|part)\*?\s*\{(.*)\}[ \t]*$")
_ITEM = re.compile(r"^[ \t]*(?:\\item\b|([*#:;]{1,6}|[-+]|\d{1,3}[.)])[ \t]+)[ \t]*(.*)$")
_RULE = re.compile(r"^[ \t]*(?:[-=*_]{3,}|\{\|.*|\|-(?:[ \t]*[\w-]+[ \t]*=.*)?|\|\}|(?:\\(?:begin|end)\s*\{[^{}]*\}(?:\[[^\]]*\])?|\\(?:centering|maketitle|noindent|newpage|clearpage)\b[ \t]*)+|[|: -]*-{3,}[|: -]*)[ \t]*$")
_ROW = re.compile(r"^[ \t]*[|!](.*?)\|?[ \t]*$")
_BOLD_LINE = re.compile(r"^[ \t]*(?:\*\*|__|''')([^*_'\n]{1,80})(?:\*\*|__|''')[ \t]*:?[ \t]*$")
_SUBSTITUTIONS = [
    (re.compile(r"\\(?:href|hyperref)\s*\{[^{}]*\}\s*\{([^{}]*)\}"), r"\1"),
    (re.compile(r"~?\\(?:cite[pt]?|ref|label|includegraphics|vspace|hspace|begin|end|documentclass|usepackage)\*?\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}"), ""),
    (re.compile(r"\\footnote\s*\{([^{}]*)\}"), r" (\1)"),
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|mailto|ftp):\S*\s*([^\[\]\n]*)\]"), r"\1"),
    (re.compile(r"\{\{[^{}]*\|([^{}|=]*)\}\}"), r"\1"),  # a template shows its last unnamed parameter
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"(?<![A-Za-z0-9:\\])\\([%&$#_{}])"), r"\1"),
    (re.compile(r"(?<=[^\s\\])\\\\(?=\s|$|\[)|^\\\\(?=\s|$)"), " "),
    (re.compile(r"~~|`+|\*{2,}(?=[^\s*])|(?<=[^\s*])\*{2,}|'{2,5}"), ""),
    (re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]*)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_])_{1,3}(?=[^\W_])|(?<=[^\W_])_{1,3}(?![\w_])"), ""),
    (re.compile(r"\]\(\S*\)?|\[\[|\]\]|\{\{|\}\}|\[(?:https?|mailto):\S*|\[\^\w+\]"), " "),
    (re.compile(r"[ \t]*={2,6}[ \t]*$|^[ \t]*={2,6}[ \t]*|[ \t]+#{2,6}[ \t]*$|^[ \t]*#{1,6}[ \t]+|^[ \t]*>{1,3}[ \t]+|^[ \t]*\|[}+-]?[ \t]*"), ""),
]
_STYLED = re.compile(r"\\(?:text(?:bf|it|tt|sc|rm|sf)?|emph|underline|math(?:rm|bf|bb|cal)|title|author|url|caption)\s*\{([^{}]*)\}")
_LEFT = re.compile(r"(?<![A-Za-z0-9:\\.])\\(?:[A-Za-z]+\*?\s?(?=[\[{])|(?:" + "|".join(COMMANDS) + r")\*?(?![A-Za-z]))")
_MATH = re.compile(_FORMULA.pattern + r"|\\\((?:(?!\\[()])[^\n])+\\\)|\\\[(?:(?!\\[\[\]])[^\n])+\\\]")
_TEX_WORDS = re.compile(r"\\([A-Za-z]+)\s?")


def formula(source: str) -> str:
    """A formula without its delimiters, commands as words."""
    inner = re.sub(r"^\$+|\$+$|^\\[(\[]|\\[)\]]$", "", source.strip()).strip()
    inner = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)", inner)
    inner = _TEX_WORDS.sub(r"\1 ", inner)
    inner = re.sub(r"_\{([^{}]*)\}", r"[\1]", inner)
    return " ".join(re.sub(r"\{([^{}]*)\}", r"(\1)", inner).replace("\\", "").split())


def _command(m: re.Match) -> str:
    """What a command left alone shows: dots, a name or a symbol's word; commands of layout show nothing."""
    name = m.group().lstrip("\\").rstrip("*[{ \t\n")
    return "…" if name.endswith("dots") else name if name in _SHOWN else ""


def _inline(text: str) -> str:
    if not _SPECIAL.search(text):
        return " ".join(text.split())
    text = _MATH.sub(lambda m: formula(m.group()), text)
    for pattern, by in _SUBSTITUTIONS[:3]:
        text = pattern.sub(by, text)
    while (out := _STYLED.sub(r"\1", text)) != text:
        text = out
    for pattern, by in _SUBSTITUTIONS[3:]:
        text = pattern.sub(by, text)
    text = re.sub(r"\s?(?<!\S)\{([^{}\n]*)\}(?=\\)", r"\1", _LEFT.sub(_command, text))
    return " ".join(text.split())


#: Marks around the text of links while a text is cut into blocks; non-characters, which no text shows.
_LINK, _UNLINK = "\ufdd0", "\ufdd1"


def _closed(found: list[Tag], names: frozenset[str]) -> set[int]:
    """Indexes of those opening tags of ``names`` that a later tag closes: an element never closed rules nothing."""
    left, out = dict.fromkeys(names, 0), set()
    for i in range(len(found) - 1, -1, -1):
        t = found[i]
        if t.name in left:
            if t.closing:
                left[t.name] += 1
            elif not t.empty and left[t.name] > 0:
                left[t.name] -= 1
                out.add(i)
    return out


_SILENT = frozenset(["script", "style", "ref"])


def blocks(text: str) -> list[Block]:
    """The blocks of a text with their kinds: heading (with level), item, code, row, formula or text."""
    if "lt;" in text:  # escaped tags are tags
        text = _ESCAPED.sub(lambda m: f"<{html.unescape(html.unescape(m[1]))}>", text)
    out: list[Block] = []
    buffer: list[str] = []
    kind, level, silent, pre, anchor, chrome = "text", 0, "", False, 0, 0

    def flush() -> None:
        raw = "".join(buffer)
        buffer.clear()
        if pre:
            raw = raw.replace(_LINK, "").replace(_UNLINK, "")
            if raw.strip():
                out.append(Block("code", 0, _undo_references(raw).strip("\n")))
        elif raw.strip():
            _lines(_undo_references(raw), out, kind, level, chrome > 0)

    at, found = 0, tags(text) if "<" in text or "-->" in text else []
    closed = _closed(found, _SILENT | CHROME_TAGS | {"a"})
    for i, tag in enumerate(found):
        chunk = text[at : tag.start]
        at = max(at, tag.end)
        if not silent:
            buffer.append(f"{_LINK}{chunk}{_UNLINK}" if anchor and chunk.strip() else chunk)
        name, closing = tag.name, tag.closing
        if tag.address and not silent:
            buffer.append(tag.address)
        if silent and closing and name == silent:
            silent = ""
        elif not silent and name in _SILENT and i in closed:
            silent = name
        if not name or silent:
            continue
        if name == "a":
            anchor = max(0, anchor - 1) if closing else anchor + (i in closed)
        elif name == "pre":
            flush()
            pre = not closing
        elif name in ("td", "th"):
            buffer.append(" " if closing else "")
        elif name in BLOCK_TAGS and not tag.cut:
            flush()
            heading = re.fullmatch(r"h([1-6])", name)
            if name in CHROME_TAGS:
                chrome = chrome + 1 if i in closed else max(0, chrome - closing)
            if closing:
                kind, level = "text", 0
            elif heading:
                kind, level = "heading", int(heading[1])
            elif name in ("li", "dt", "dd"):
                kind, level = "item", 1
            elif name == "tr":
                kind, level = "row", 0
    if not silent:
        rest = text[at:]
        buffer.append(f"{_LINK}{rest}{_UNLINK}" if anchor and rest.strip() else rest)
    flush()
    return out


def _lines(text: str, out: list[Block], kind: str, level: int, chrome: bool) -> None:
    """Blocks of a stretch without tags, line by line; a paragraph's lines are one block each, as written, each with its own links."""
    fence: list[tuple[str, int]] | None = None
    inside, rows = False, []
    for line in text.split("\n"):
        links = 0
        if inside or _LINK in line:
            kept = []
            for part in re.split(f"([{_LINK}{_UNLINK}])", line):
                if part in (_LINK, _UNLINK):
                    inside = part == _LINK
                else:
                    kept.append(part)
                    links += len(part.strip()) * inside
            line = "".join(kept)
        rows.append((line, links))
    for line, links in rows:
        if _FENCE.match(line):
            if fence is None:
                fence = []
            else:
                out.append(Block("code", 0, "\n".join(x for x, _ in fence)))
                fence = None
            continue
        if fence is not None:
            fence.append((line, links))
            continue
        _line(line, links, out, kind, level, chrome)
    for line, links in fence or ():  # never closed: no code, but lines as any
        _line(line, links, out, kind, level, chrome)


def _line(line: str, links: int, out: list[Block], kind: str, level: int, chrome: bool) -> None:
    if not line.strip():
        return
    if _RULE.match(line):
        under = out[-1] if out else None  # a rule under a line of text makes it a heading
        if re.fullmatch(r"[ \t]*(?:-{3,}|={3,})[ \t]*", line) and under and under.kind == "text" and len(under.text) <= 80:
            under.kind, under.level = "heading", 1 if "=" in line else 2
        return
    own, depth, body = kind, level, line
    if m := _SECTION.match(line):
        own, depth, body = "heading", 1 + line.count("sub"), m[2]
    elif m := _HEADING.match(line) if line.lstrip()[:1] in "#=" and not (line.lstrip().startswith("# ") and out and out[-1].kind == "item") else None:
        own, depth, body = "heading", len(m[1] or m[3]), m[2] if m[1] else m[4]
        if own == "heading" and m[1] == "#" and len(body) > 60:
            own, depth = "item", 1
    elif m := _BOLD_LINE.match(line):
        own, depth, body = "heading", 3, m[1]
    elif m := _ITEM.match(line):
        own, depth, body = "item", len(m[1]) if m[1] and not m[1][0].isdigit() else 1, m[2]
    elif m := _ROW.match(line):
        own, body = "row", " | ".join(x.strip() for x in re.split(r"\|\|?|!!", m[1].lstrip("+}")))
    shown = _inline(body)
    if own == "text" and _MATH.fullmatch(body.strip()):
        own = "formula"
    if shown:
        out.append(Block(own, depth, shown, min(links, len(shown)), chrome=chrome))


_ADDRESS = re.compile(r"[@/]|www\.")


def label_blocks(found: list[Block]) -> None:
    """Labels each block good or bad by the two-pass rules; code, formulas, rows, linked headings and linked items are structure and stay good.

    First pass, on each block alone: links and little else, and no long text of many stop words or an address, is bad; without any
    link, long, or with stop words it is good; short blocks with some links, and short ones inside navigation, are undecided.
    Second pass: these are bad only between two bad neighbours, the nearest decided ones. A text all of whose blocks are bad is
    no chrome of any page: all stay.
    """
    stops = stops_of("\n".join(b.text for b in found)) if any(b.links for b in found) else None
    first: list[str] = []
    for b in found:
        size = len(b.text)
        linked = b.links > MOST_LINKS * size and size - b.links < max(OUTSIDE, 0.2 * size)
        dense = density(b.text, stops) if b.links or b.chrome else None
        if b.kind in ("code", "formula", "row") or (b.links and b.kind in ("heading", "item")):
            first.append("good")
        elif linked:
            first.append("good" if (size > LONG and (dense or 0.0) >= MANY_STOPS) or _ADDRESS.search(b.text) else "bad")
        elif (b.links or b.chrome) and size < SHORT and (dense or 0.0) < FEW_STOPS:
            first.append("")
        else:
            first.append("good" if size >= SHORT or (dense or 0.0) >= FEW_STOPS else "short")
    sides: list[list[str]] = [[], []]
    for way, out in ((first, sides[0]), (first[::-1], sides[1])):
        last = ""
        for x in way:
            out.append(last)
            last = x if x in ("good", "bad") else last
    for b, own, before, after in zip(found, first, sides[0], sides[1][::-1]):
        b.label = "bad" if own == "bad" or (own == "" and before == after == "bad") else "good"
    if all(b.label == "bad" for b in found):
        for b in found:
            b.label = "good"


def render(found: list[Block]) -> str:
    """Clean text: good blocks on lines of their own, headings after a blank line, items with a bullet, code indented."""
    out: list[str] = []
    for b in found:
        if b.label == "bad":
            continue
        if b.kind == "heading" and out:
            out.append("")
        if b.kind == "item":
            out.append("• " + b.text.lstrip("•·–»- "))
        elif b.kind == "code":
            out += ["    " + x for x in b.text.split("\n")]
        else:
            out.append(b.text)
    return "\n".join(out)


def clean_markup(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_pieces, clean, kinds): for each row the number of pieces of markup in ``text``, the clean text, and how many blocks
    of each kind it has.

    Null texts give 0 pieces and a null clean text, empty and blank ones 0 and an empty one. A text without markup keeps its lines;
    of one with markup every visible word stays unless its block is chrome by its links or its place in navigation.
    Whole texts are read, however long; repeated rows and keys stay; other columns are pruned.
    """
    picked = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts, kinds = [], [], []
            for t in batch.column(1).to_pylist():
                n = marked_lines(t) if t else 0
                found = blocks(t) if n else []
                label_blocks(found)
                counts.append(n)
                texts.append(render(found) if n else t if t is None else t.strip())
                by: dict[str, int] = {}
                for b in found:
                    by[b.kind] = by.get(b.kind, 0) + 1
                kinds.append(sorted(by.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(texts, pa.string()), pa.array(kinds, pa.map_(pa.string(), pa.int32()))], names=["key", "n_pieces", "clean", "kinds"]
            )

    return picked.mapInArrow(run, f"key {dict(picked.dtypes)['key']}, n_pieces int, clean string, kinds map<string, int>").withColumnRenamed("key", key)
