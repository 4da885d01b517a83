"""Markup residue in text documents: HTML, Markdown, wiki and LaTeX become clean text.

A text is read into nodes, each with the path of the marks it stands in, from the root to itself. For every path the
length of its texts and their punctuation are added up and divided by its nodes; along the text the ratios are smoothed
and fused, and paths below a threshold - link lists, navigation, image captions, references, templates - are left out. Lines
outside of all elements, lines that hold a sentence and those that carry structure (headings, list items, quotes, code,
formulas, tables) always stay, unless they stand in an element apart from the content (as nav or footer) or are list
items that are nothing but links. Scripts and style sheets are no text.

The clean text has one form for all families: "## Title" for headings, "- item" and "1. item" for lists, a fence of
three backticks around code, backticks within a line, $...$ and $$...$$ around formulas, " | " between table cells.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "markdown", "wiki", "latex")
#: Paths of a fused ratio below this part of the text's best path are no content.
THRESHOLD = 0.4

# Names of HTML elements, and LaTeX commands that need no argument.
_ELEMENTS = (
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col "
    "colgroup data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 "
    "h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript "
    "object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike "
    "strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_SYMBOLS = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega Gamma Delta Theta Lambda "
    "Xi Pi Sigma Phi Psi Omega le leq ge geq neq approx cdot times pm sum prod int infty partial nabla forall exists in subset cup cap to "
    "rightarrow leftarrow ldots dots quad qquad hline newline noindent maketitle item bf it em tt sc rm par clearpage centering LaTeX TeX"
)

_TAG = re.compile(rf"<(/\s*)?({'|'.join(_ELEMENTS.split())})(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]*));")
_BLOCKS = re.compile(
    r"^(?P<fence>[ \t]{0,3}(?P<mark>`{3,}+|~{3,}+)[^\n`]*+\n(?P<code>.*?)(?:^[ \t]{0,3}(?P=mark)[`~]*[ \t]*$|\Z))"
    r"|(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?P<raw>.*?)(?:\\end\{(?P=env)\}|\Z))"
    r"|(?P<pre><pre\b[^>]*>(?P<pretext>.*?)(?:</pre\s*>|\Z))"
    r"|(?P<nowiki><nowiki>(?P<asis>(?:(?!<nowiki>).)*?)</nowiki>)"
    r"|(?P<comment><!--(?:(?!<!--).)*?-->)",
    re.M | re.S | re.I,
)
_DISPLAY = re.compile(r"\$\$(?=\S|\s*\S)(.+?)\$\$|\\\[((?:(?!\\\[).)+?)\\\]|\\begin\{(equation|align|displaymath|math|gather)\*?\}(.+?)\\end\{\3\*?\}", re.S)
_INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$\d])((?:[^$\n]|\n(?!\s*\n))*?(?<=[^\s\\]))\$(?![\d$])|\\\(((?:(?!\\\().)+?)\\\)", re.S)
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\s?\{|(?<![A-Za-z0-9_:\\/.])\\(?:" + "|".join(_SYMBOLS.split()) + r")(?![A-Za-z])")
_MD_LINE = re.compile(
    r"^[ \t]{0,3}#{1,6}[ \t]+\S|^[ \t]*[-*+][ \t]+\S|^[ \t]*\d{1,9}\.[ \t]+\S|^[ \t]{0,3}>(?:[ \t]|$)|^[ \t]{0,3}\[[^\]\n]+\]:[ \t]+\S"
    r"|^[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$",
    re.M,
)
_SETEXT = re.compile(r"^(?=[^\n]*\w)([^\n]+)\n[ \t]{0,3}(={2,}|-{2,})[ \t]*$", re.M)
_MD_DELIMITER = re.compile(r"^(?=[^\n]*\|)[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+(?:[ \t]*:?-+:?)?[ \t]*$", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|[^\n]*\|[^\n]*\|[ \t]*$", re.M)


class Delimited:
    """Stretches between two equal runs of a sign, as emphasis has them; they take linear time, however long they are.

    A run opens a stretch if its length is one of ``lengths`` and nothing of ``before`` stands before it, and closes one
    if nothing of ``after`` follows it. With ``tight`` a stretch neither begins nor ends with white space. No stretch runs
    over what ``stop`` finds. The next closing run of the same length ends a stretch.
    """

    def __init__(self, sign: str, lengths: tuple[int, ...], before: str, after: str = "", tight: bool = True, stop: str = r"\n\s*\n"):
        self.lengths, self.tight, self.stop = lengths, tight, re.compile(stop)
        self.sign, self.run = sign, re.compile(f"{re.escape(sign)}+")
        self.before, self.after = re.compile(before), re.compile(after) if after else None

    def _bounds(self, text: str, start: int, end: int) -> tuple[bool, bool]:
        prev, follow = text[start - 1 : start], text[end : end + 1]
        opens, closes = not (prev and self.before.match(prev)), bool(prev)
        if self.tight:
            opens, closes = opens and not follow.isspace(), closes and not prev.isspace()
        return opens and bool(follow), closes and not (follow and self.after and self.after.match(follow))

    def spans(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(begin of the opening run, its end, begin of the closing run, its end), without overlaps."""
        if self.sign not in text:
            return
        runs = [m.span() for m in self.run.finditer(text) if m.end() - m.start() in self.lengths]
        if len(runs) < 2:
            return
        opening = []
        closing: dict[int, list[int]] = {n: [] for n in self.lengths}
        for lo, hi in runs:
            opens, closes = self._bounds(text, lo, hi)
            if opens:
                opening.append((lo, hi))
            if closes:
                closing[hi - lo].append(lo)
        stops = [m.start() for m in self.stop.finditer(text)] if opening else []
        at = 0
        for lo, hi in opening:
            ends = closing[hi - lo]
            i = bisect_left(ends, hi)
            if lo < at or i == len(ends) or bisect_left(stops, hi) < bisect_left(stops, ends[i]):
                continue
            at = ends[i] + hi - lo
            yield lo, hi, ends[i], at

    def search(self, text: str) -> bool:
        return next(self.spans(text), None) is not None

    def subn(self, put: Callable[[str], str], text: str) -> tuple[str, int]:
        """The text with ``put`` of each stretch in place of it and its runs, and how many there were."""
        out, at, n = [], 0, 0
        for lo, hi, end, stop in self.spans(text):
            out += [text[at:lo], put(text[hi:end])]
            at, n = stop, n + 1
        return "".join([*out, text[at:]]), n


class WikiUrls:
    """Links in single brackets, [address label]; their ends are looked for once."""

    start = re.compile(r"(?<!\[)\[((?:https?|ftp)://[^\s\]]+)")

    def spans(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(begin, end, label or address)."""
        at = close = 0
        for m in self.start.finditer(text):
            if m.start() < at or close < 0:
                continue
            if close < m.end():
                close = text.find("]", m.end())
            labelled = text[m.end() : m.end() + 1] in (" ", "\t", "\n") and close > m.end() + 1
            if close < 0 or not (labelled or close == m.end()) or text[close + 1 : close + 2] == "(":
                continue
            at = close + 1
            yield m.start(), at, text[m.end() + 1 : close] if labelled else m[1]

    def search(self, text: str) -> bool:
        return "[" in text and next(self.spans(text), None) is not None

    def sub(self, put: Callable[[str], str], text: str) -> str:
        out, at = [], 0
        for lo, hi, label in self.spans(text):
            out += [text[at:lo], put(label)]
            at = hi
        return "".join([*out, text[at:]])


_STARS = Delimited("*", (1, 2, 3), r"[\w\\]", r"\w")
_BARS = Delimited("_", (1, 2, 3), r"[\w\\]", r"\w")
_STRIKE = Delimited("~", (2,), r"\\")
_CODE = Delimited("`", (1, 2), r"\\", tight=False)
_WIKI_QUOTES = Delimited("'", (2, 3, 5), r"\w", stop=r"\n")
_WIKI_URL = WikiUrls()
_LINK = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*?)\]\(\s*<?([^\s()<>]+(?:\([^\s()]*\))?)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_REF_LINK = re.compile(r"(?<![\w\]])(!?)\[((?:[^\[\]\n]|\n(?!\n))+)\]\[([^\[\]\n]*)\]")
_REF_DEF = re.compile(r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]+\S+[^\n]*$", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[([^\[\]]+)\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{([^{}]+)\}\}")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.M | re.S)
_WIKI_REDIRECT = re.compile(r"^[ \t]*#REDIRECT\b:?[ \t]*", re.M | re.I)
_WIKI_MAGIC = re.compile(r"(?<!\w)__[A-Z]{3,}__(?!\w)")


# Text without any of these carries no markup.
_SIGNS = re.compile(r"[<&$\\`*_\[{|~#>=]|''|^[ \t]*[-+][ \t]|^[ \t]*\d+\.[ \t]|--", re.M)


def _entities(text: str) -> bool:
    return any(not m[1] or m[1] + ";" in html5 for m in _ENTITY.finditer(text))


def _wiki_link(text: str) -> bool:
    """A link in double brackets; an index of a name in code, as in a[[1]], is none."""
    return any(not (m[1].strip().isdigit() and m.start() and text[m.start() - 1].isalnum()) for m in _WIKI_LINK.finditer(text))


def _without_blocks(text: str, found: set[str], put: Callable[[re.Match], str]) -> str:
    def note(m: re.Match) -> str:
        found.add("markdown" if m["fence"] else "latex" if m["verb"] else "wiki" if m["nowiki"] else "html")
        return put(m)

    return _BLOCKS.sub(note, text)


def families(text: str | None) -> set[str]:
    """The families whose markup a text carries. What stands in a fenced or verbatim block counts only as that block."""
    found: set[str] = set()
    if not text or not _SIGNS.search(text):
        return found
    text = _without_blocks(text.replace("\r\n", "\n").replace("\r", "\n"), found, lambda m: "\n" if m["comment"] is None else " ")
    if ("<" in text and _TAG.search(text)) or ("&" in text and _entities(text)):
        found.add("html")
    if _DISPLAY.search(text) or _INLINE_MATH.search(text) or ("\\" in text and _COMMAND.search(text)):
        found.add("latex")
    plain = _INLINE_MATH.sub("x", _DISPLAY.sub("x", text))
    tables = _WIKI_TABLE.search(plain)
    if tables or _WIKI_HEAD.search(plain) or _wiki_link(plain) or _WIKI_URL.search(plain) or _WIKI_TEMPLATE.search(plain):
        found.add("wiki")
    elif _WIKI_QUOTES.search(plain) or _WIKI_REDIRECT.search(plain) or _WIKI_MAGIC.search(plain):
        found.add("wiki")
    if tables:
        plain = _WIKI_TABLE.sub("\n", plain)
    for rx in (_MD_LINE, _SETEXT, _MD_DELIMITER, _MD_ROW, _STARS, _STRIKE, _CODE, _LINK, _REF_LINK, _AUTOLINK):
        if rx.search(plain):
            found.add("markdown")
            break
    else:
        if "_" in plain and _BARS.search(_WIKI_MAGIC.sub("", plain)):
            found.add("markdown")
    return found


@dataclass
class Node:
    path: str
    text: str
    structural: bool
    inline: bool = False
    prose: bool = False


class Paths:
    """Paths of elements from the root as numbers, 0 for the root itself: a tree, so that deep nesting takes linear room."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.apart = [False]

    def below(self, path: int, name: str) -> int:
        n = self.numbers.setdefault((path, name), len(self.apart))
        if n == len(self.apart):
            self.apart.append(self.apart[path] or name in _APART)
        return n


# Elements beside the content; what they hold stays only by its ratio.
_APART = frozenset("nav footer aside menu form figcaption select button dialog".split())


# Private-use marks that stand for finished parts while the rest is converted.
_KEEP, _END = "\ue000", "\ue001"
_KEPT = re.compile(f"{_KEEP}(\\d+){_END}")
# A link's begin and end, and a line that gives the number of the path in which the next ones stand (base 64, no word characters).
_LINKED, _UNLINKED, _QUOTED = "\ue004", "\ue005", "\ue008"
_AT = re.compile("\ue006([\ue100-\ue13f]+)\ue007")
_LINKS = re.compile(f"[{_LINKED}{_UNLINKED}]")


def _at(path: int) -> str:
    digits = chr(0xE100 + path % 64)
    while path := path // 64:
        digits = chr(0xE100 + path % 64) + digits
    return f"\n\ue006{digits}\ue007"


def _path_of(digits: str) -> int:
    n = 0
    for c in digits:
        n = n * 64 + ord(c) - 0xE100
    return n


class _Store:
    def __init__(self) -> None:
        self.parts: list[str] = []

    def keep(self, text: str) -> str:
        self.parts.append(text)
        return f"{_KEEP}{len(self.parts) - 1}{_END}"

    def back(self, text: str) -> str:
        while _KEPT.search(text):
            text = _KEPT.sub(lambda m: self.parts[int(m[1])] if int(m[1]) < len(self.parts) else "", text)
        return text


_HTML_HEAD = re.compile(r"h([1-6])", re.I)
_PARAGRAPHS = frozenset(
    "p div section article blockquote table ul ol dl pre header footer main aside nav figure form hr address figcaption dt dd menu".split()
)
_EMPTY = frozenset("br hr img input meta link wbr col area base".split())
#: What an opening element ends, if it is open within the nearest of the others.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


def _from_html(text: str, paths: Paths) -> str:
    """Tags as line breaks and list or heading marks; marks of paths note the elements that the lines after them stand in."""
    out: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, each with the path of the blocks up to it
    missing: set[str] = set()
    at = 0
    for m in _TAG.finditer(text):
        if m.start() < at:
            continue
        out.append(text[at : m.start()])
        at = m.end()
        name, closing = m[2].lower(), bool(m[1])
        if name in ("script", "style"):
            if not closing and name not in missing:
                end = re.compile(rf"</\s*{name}\s*>", re.I).search(text, at)
                at = end.end() if end else at
                if not end:
                    missing.add(name)
            continue
        head = _HTML_HEAD.fullmatch(name)
        block = bool(head) or name in _PARAGRAPHS or name in ("li", "tr")
        alone = name in _EMPTY or m[3].rstrip().endswith("/")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif block:
            if stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
                stack.pop()
            ended, within = _ENDS.get(name, ((), ()))
            for i in range(len(stack) - 1, -1, -1) if ended else ():
                if stack[i][0] in within:
                    break
                if stack[i][0] in ended:
                    del stack[i:]
                    break
        parent = stack[-1][1] if stack else 0
        listed = [n for n, _ in stack[-2:]]
        if not closing and not alone:
            stack.append((name, paths.below(parent, name) if block or name in _APART else parent))
        if block:
            out.append(_at(stack[-1][1] if stack else 0))
        if name in ("br", "tr"):
            out.append("\n")
        elif name in ("td", "th"):
            if not closing and out and "".join(out[-3:]).rstrip(" ")[-1:] not in ("", "\n"):
                out.append(" | ")
        elif head:
            out.append("\n\n" if closing else f"\n\n{'#' * int(head[1])} ")
        elif name == "li":
            out.append("\n" if closing else "\n1. " if "ol" in listed else "\n- ")
        elif name in _PARAGRAPHS:
            out.append("\n\n")
        elif name == "code" and not any(n == "pre" for n, _ in stack):
            out.append("`")
        elif name == "a" and not alone:
            out.append(_UNLINKED if closing else _LINKED)
        elif name == "img" and (alt := re.search(r"alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[3], re.I)):
            out.append(f"\ue002image\ue003{alt[1] or alt[2] or ''}")
    out.append(text[at:])
    return "".join(out)


_GROUP = re.compile(r"\{([^{}]*)\}")
_ONE_ARG = re.compile(r"\\([a-zA-Z]+)\*?(?:\[[^\]\n]*\])?\s?\{([^{}]*)\}")
_LATEX_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


def _from_latex(text: str) -> str:
    def table(m: re.Match) -> str:
        rows = [r.strip() for r in re.split(r"\\\\|\\hline", m[1])]
        return "\n\n" + "\n".join(re.sub(r"\s*(?<!\\)&\s*", " | ", r) for r in rows if r) + "\n\n"

    def command(m: re.Match) -> str:
        name, arg = m[1], m[2]
        if name in _LATEX_LEVEL:
            return f"\n\n{'#' * _LATEX_LEVEL[name]} {arg}\n\n"
        if name in ("begin", "end"):
            return "\n"
        if name in ("label", "vspace", "hspace", "usepackage", "documentclass", "input", "includegraphics", "pagestyle"):
            return ""
        if name in ("cite", "citep", "citet", "ref", "eqref"):
            return f"[{arg}]"
        return f" ({arg})" if name == "footnote" else arg

    text = re.sub(r"\\begin\{tabular\}(?:\[[^\]]*\])?\{[^}]*\}(.*?)(?:\\end\{tabular\}|\Z)", table, text, flags=re.S)
    text = re.sub(r"~(?=\\)", " ", text)
    while True:  # arguments may hold commands
        text, n = _ONE_ARG.subn(command, text)
        if not n:
            break
    text = re.sub(r"(?m)^[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", "- ", text)
    text = re.sub(r"\{\\(?:bf|it|em|tt|sc|rm)\s+([^{}]*)\}", r"\1", text)
    return re.sub(r"(?<![A-Za-z0-9_:\\/.])\\(?:hline|newline|noindent|maketitle|par|clearpage|centering)(?![A-Za-z])[ \t]*", "", text)


def _from_wiki(text: str) -> str:
    def table(m: re.Match) -> str:
        rows: list[list[str]] = [[]]
        for line in m[0].split("\n")[1:]:
            line = line.strip()
            if line.startswith("|}"):
                break
            if line.startswith("|-"):
                rows.append([])
            elif line[:1] in ("|", "!"):
                rows[-1] += [c.strip() for c in re.split(r"\|\||!!", line[1:])]
        return "\n\n" + "\n".join(" | ".join(r) for r in rows if r) + "\n\n"

    text = _WIKI_TABLE.sub(table, text)
    text = _WIKI_HEAD.sub(lambda m: f"{'#' * len(m[1])} {m[2]}", text)
    text = _WIKI_REDIRECT.sub("\ue002redirect\ue003", text)

    def link(m: re.Match) -> str:
        parts = m[1].split("|")
        if re.match(r"\s*(?:File|Image|Category)\s*:", parts[0], re.I):
            return f"\ue002image\ue003{parts[-1] if len(parts) > 1 else ''}"
        return _LINKED + (parts[-1].strip(" ") or parts[0]) + _UNLINKED

    while True:
        text, n = _WIKI_LINK.subn(link, text)
        if not n:
            break
    text = _WIKI_URL.sub(lambda label: _LINKED + label + _UNLINKED, text)
    n = 1
    while n:  # templates may hold templates
        text, n = _WIKI_TEMPLATE.subn(lambda m: "\ue002template\ue003" + " ".join(p.split("=", 1)[-1].strip() for p in m[1].split("|")), text)
    return _WIKI_MAGIC.sub("", _WIKI_QUOTES.subn(str, text)[0])


def _from_markdown(text: str) -> str:
    text = _REF_DEF.sub(lambda m: "\ue002reference\ue003" + m[0].strip(), text)
    text = _SETEXT.sub(lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1].strip()}", text)
    text = re.sub(r"(?m)^[ \t]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", r"\1 \2", text)
    text = _MD_DELIMITER.sub("", text)
    text = _MD_ROW.sub(lambda m: " | ".join(c.strip() for c in m[0].strip().strip("|").split("|")), text)
    text = re.sub(r"(?m)^[ \t]{0,3}(?:>[ \t]?)+([^\n]*)$", rf"\1{_QUOTED}", text)
    text = re.sub(rf"(?m)^[ \t]{{0,3}}(?:(?:-[ \t]*){{3,}}|(?:\*[ \t]*){{3,}}|(?:_[ \t]*){{3,}}){_QUOTED}?$", "", text)
    text = re.sub(r"(?m)^([ \t]*)[*+](?=[ \t]+\S)", r"\1-", text)
    text = re.sub(r"(?m)^([ \t]*- )\[[ xX]\][ \t]+", r"\1", text)
    while True:
        text, n = _LINK.subn(lambda m: "\ue002image\ue003" + m[2] if m[1] else _LINKED + m[2] + _UNLINKED, text)
        text, k = _REF_LINK.subn(lambda m: _LINKED + m[2] + _UNLINKED, text)
        if not n + k:
            break
    text = _AUTOLINK.sub(_LINKED + r"\1" + _UNLINKED, text)
    while True:
        text, n = _STARS.subn(str, text)
        text, k = _BARS.subn(str, text)
        if not n + k:
            break
    return _STRIKE.subn(str, text)[0]


_BULLET = re.compile(r"[ \t]*(?:- |\d+\. )")
_STRUCTURE = re.compile(rf"#{{1,6}} |[ \t]*- |[ \t]*\d+\. |{_KEEP}|[^\n]* \| ")
_PUNCTUATION = re.compile(r"[.,;!?…](?=\s|$)|[。、！？]")  # that of sentences, not of addresses or names


def _linked(line: str) -> bool:
    """Whether a line holds links and nothing but links beside signs."""
    if _LINKED not in line:
        return False
    depth, word = 0, False
    for c in line:
        depth = depth + 1 if c == _LINKED else max(0, depth - 1) if c == _UNLINKED else depth
        if c.isalnum() and not depth:
            return False
        word = word or c.isalnum()
    return word


def _nodes(text: str, paths: Paths) -> Iterator[Node]:
    """Lines with the path of the elements and marks they stand in; marked parts within a line are nodes of their own.

    A list item that is nothing but links has "a" at the end of its path and is no structure; neither is anything in an
    element apart from the content.
    """
    at = 0
    for line in text.split("\n"):
        if "\ue006" in line:
            at = [_path_of(d) for d in _AT.findall(line)][-1:] or [at]
            at = at[0] if at[0] < len(paths.apart) else 0
            line = _AT.sub("", line)
            if not line:
                continue
        base, apart = f"root/{at}" if at else "root", paths.apart[at]
        quoted = _QUOTED in line
        line = line.replace(_QUOTED, "")
        if quoted:
            base += "/quote"
        if "\ue002" not in line:
            bullet = _BULLET.match(line)
            linked = bool(bullet) and _linked(line[bullet.end() :])
            line = _LINKS.sub("", line)
            kind = _STRUCTURE.match(line)
            depth = (len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())) // 2 if bullet else 0
            path = f"{base}/{(kind[0].strip() or 'item')[:2]}{'-' * min(depth, 50)}" if kind else base
            yield Node(path + "/a" * linked, line, (bool(kind) or quoted) and not linked and not apart, prose=not apart and not linked)
            continue
        head, *marked = re.split("\ue002(\\w+)\ue003", _LINKS.sub("", line))
        yield Node(base, head, (bool(_STRUCTURE.match(head)) or quoted) and not apart, prose=not apart)
        for kind, rest in zip(marked[::2], marked[1::2], strict=True):
            yield Node(f"{base}/{kind}", rest, False, inline=True)


def path_scores(nodes: list[Node]) -> dict[str, float]:
    """Fused ratio of each path: text length and punctuation, each by the nodes of the path, smoothed along the text.

    A node's smoothed ratio is the weighted mean of its own (six eighths) and its neighbours' (one each); a path has the
    mean over its nodes. Fused is the square root of the product, punctuation counted from one. Blank nodes don't count.
    """
    nodes = [n for n in nodes if n.text.strip()]
    length, points, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for n in nodes:
        length[n.path] += len(n.text.strip())
        points[n.path] += len(_PUNCTUATION.findall(n.text))
        count[n.path] += 1
    raw = [(length[n.path] / count[n.path], 1 + points[n.path] / count[n.path]) for n in nodes]
    total: dict[str, float] = defaultdict(float)
    for i, n in enumerate(nodes):
        a, b = raw[max(0, i - 1)], raw[min(len(raw) - 1, i + 1)]
        smooth = [(6 * own + x + y) / 8 for own, x, y in zip(raw[i], a, b, strict=True)]
        total[n.path] += (smooth[0] * smooth[1]) ** 0.5
    return {p: total[p] / count[p] for p in count}


def clean(text: str | None, threshold: float = THRESHOLD, found: set[str] | None = None) -> str | None:
    """The text without markup; unchanged if it carries none. Null stays null. ``found``: its families, if known."""
    found = families(text) if found is None else found
    if not text or not found:
        return text
    store, paths = _Store(), Paths()

    def block(m: re.Match) -> str:
        if m["comment"]:
            return ""
        if m["nowiki"]:
            return store.keep(m["asis"])
        code = m["code"] or m["raw"] or ""
        if m["pre"]:
            code = html.unescape(_TAG.sub("", m["pretext"] or ""))
        return "\n\n" + store.keep("```\n" + code.strip("\n") + "\n```") + "\n\n"

    text = _without_blocks(re.sub("[\ue000-\ue008]", "", text).replace("\r\n", "\n").replace("\r", "\n"), set(), block)
    if "latex" in found:
        text = _DISPLAY.sub(lambda m: store.keep("$$" + (m[1] or m[2] or m[4]).strip() + "$$"), text)
        text = _INLINE_MATH.sub(lambda m: store.keep("$" + (m[1] or m[2]).strip() + "$"), text)
    if "markdown" in found:
        text, _ = _CODE.subn(lambda x: store.keep(f"`{x.strip()}`"), text)
    for family, convert in (("html", lambda t: _from_html(t, paths)), ("wiki", _from_wiki), ("latex", _from_latex), ("markdown", _from_markdown)):
        if family in found:
            text = convert(text)
    nodes = list(_nodes(text, paths))
    score = path_scores(nodes)
    least = threshold * max(score.values(), default=0.0)
    lines: list[str] = []
    for n in nodes:
        stays = n.structural or n.path == "root" or (n.prose and bool(_PUNCTUATION.search(n.text)))
        part = n.text if stays or score.get(n.path, 0.0) >= least else ""
        if n.inline and lines:
            lines[-1] += part
        else:
            lines.append(part)
    text = "\n".join(x.rstrip() for x in lines)
    text = _LINKS.sub("", html.unescape(text) if "html" in found else text)
    return store.back(re.sub(r"\n{3,}", "\n\n", text)).strip()


def clean_heading(heading: str | None) -> str | None:
    """A heading trail; each title is a text of its own."""
    if not heading:
        return heading
    return " > ".join(t if not (f := families(t)) else re.sub(r"^#+ ", "", clean(t, found=f) or "") for t in heading.split(" > "))


def heading_families(heading: str | None) -> set[str]:
    return set().union(*map(families, heading.split(" > "))) if heading else set()


_CLEANED = "passage_id bigint, text string, heading string, text_families array<string>, heading_families array<string>"


def clean_passages(passages: DataFrame, passage_id: str = "passage_id", text: str = "text", heading: str = "heading") -> DataFrame:
    """(passage_id, text, heading, text_families, heading_families) of every distinct row with an id.

    Null and empty texts and headings stay as they are and carry nothing. Extra columns are ignored; an empty table
    gives an empty one. The families are in the order of FAMILIES.
    """
    rows = passages.select(F.col(passage_id).cast("long").alias("p"), F.col(text).alias("t"), F.col(heading).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, headings = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [families(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([clean(t, found=f) for t, f in zip(texts, found, strict=True)], pa.string()),
                    pa.array(map(clean_heading, headings), pa.string()),
                    pa.array([sorted(f, key=FAMILIES.index) for f in found], pa.list_(pa.string())),
                    pa.array([sorted(heading_families(h), key=FAMILIES.index) for h in headings], pa.list_(pa.string())),
                ],
                names=["passage_id", "text", "heading", "text_families", "heading_families"],
            )

    return rows.where("p is not null").distinct().mapInArrow(run, _CLEANED)


def markup_found(cleaned: DataFrame) -> DataFrame:
    """(passage_id, field_name, family) out of ``clean_passages``."""
    both = F.array(
        *[
            F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_families").alias("families"))
            for f in ("text", "heading")
        ]
    )
    fields = cleaned.select("passage_id", F.explode(both).alias("f"))
    return fields.select("passage_id", "f.field_name", F.explode("f.families").alias("family")).distinct()
