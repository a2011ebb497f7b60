"""Markup residue in text documents (problem 4): HTML, Markdown, wiki and LaTeX.

Method: minimum-cut labelling. The marks of a document (tags, references, emphasis signs, macros, braces) and the text
hidden between comment or script marks are nodes. A classifier's log-odds for being markup become capacities to the two
terminals; nearness in the text, pairing (opening and closing tag or sign, macro and brace, begin and end) and containment
of hidden text become edges. The maximum flow gives the labels: what ends on the markup side is residue, the rest content.

The classifier is fitted without labels, by self-training over all texts: it starts from prior log-odds of each form, the
cut labels every node with the help of its edges, and the log-odds of each signature (form and surroundings) are estimated
anew from those labels, shrunk to the prior. So a sign that structure usually confirms becomes evidence where it stands alone.

Code blocks, code spans and formulas are set apart first, by a graph of their own marks, and nothing inside them is read
or changed. No rule has a length bound; every pattern stops at the next mark of its kind, so scanning is linear.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import cut

KINDS = ("html", "markdown", "wiki", "latex")
#: Edges: strength and reach (characters) of nearness, strength of pairing and of containment.
NEAR, REACH, PAIR, INSIDE = 0.6, 60.0, 2.0, 1.5
#: Self-training: rounds, weight of the prior in labels, and how far log-odds may move from it.
ROUNDS, PRIOR_N, SHIFT = 2, 20.0, 1.5
#: Prior log-odds of hidden text for being markup, and of a closing brace: both are content unless their edges say otherwise.
HIDDEN, BRACE = -1.0, -0.2

# Names of HTML elements and of LaTeX macros.
TAGS = set("a abbr address area article aside audio b base blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param pre q s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr o:p".split())
MACROS = set("section subsection subsubsection chapter paragraph item emph textbf textit texttt textsc underline footnote href url cite ref label vspace hspace begin end documentclass usepackage title author date maketitle cventry cvitem cvline newline linebreak noindent bigskip medskip smallskip large Large small tiny huge centering includegraphics caption frac sqrt sum int alpha beta gamma delta lambda mu sigma pi theta omega times cdot leq geq le ge neq approx infty ldots dots left right text mathrm mathbf quad qquad hline hfill par input include".split())
# Macros whose argument is no text, environments of code and of formulas, elements whose text is not shown, elements of code.
SILENT = "usepackage|documentclass|vspace|hspace|label|includegraphics|cite|ref|bibliographystyle|bibliography|input|include|pagestyle|setlength|begin|end"
CODE_ENV, MATH_ENV = "verbatim|lstlisting|minted", "equation|align|gather|displaymath|math|eqnarray|multline"
UNSHOWN, CODE_TAGS = "script|style|noscript|template", "pre|code|math"
BLOCK = set("p div br hr li ul ol table tr h1 h2 h3 h4 h5 h6 pre dl dt dd section article header footer blockquote title".split())

Rule = tuple[str, str, "re.Pattern", Callable[[re.Match], float], Callable[[re.Match], str]]


def keep(m: re.Match) -> str:
    return m[0]


def tag_weight(m: re.Match) -> float:
    name = m["n"].lower()
    t, a = m.string, m.start()
    glued = a > 0 and (t[a - 1].isalnum() or t[a - 1] == "_") and not t[a : a + 2] == "</"
    if name in TAGS:
        return 1.0 if glued and len(name) == 1 and m["n"].isupper() else 3.0
    if t[a : a + 2] == "</":
        return 2.0
    return -3.0 if glued or m["n"][0].isupper() else 0.6 if ":" in name or "=" in m[0] else -1.0


def tag_text(m: re.Match) -> str:
    name, close = m["n"].lower(), m[0].lstrip("<&ampltLT;#60").startswith("/")
    if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "\n" if close else "\n# "
    if name in ("li", "dt"):
        return "" if close else "\n- "
    if name in ("pre",):
        return "\n```\n"
    if name in ("td", "th"):
        return " |" if close else " "
    if name == "tr":
        return "\n" if close else "\n|"
    if name == "img":
        alt = re.search(r"alt=(?:\"([^\"]*)\"|'([^']*)'|(\S+?)[ />])", m[0])
        return next((x for x in alt.groups() if x), "") if alt else ""
    return "\n" if name in BLOCK else "" if name in TAGS else " "


def entity_weight(m: re.Match) -> float:
    return 3.0 if html.unescape(m[0]) != m[0] else -1.0


def macro_weight(m: re.Match) -> float:
    t, a, b = m.string, m.start(), m.end()
    b = m.end("n") + (t[m.end("n") : m.end("n") + 1] == "*")
    if m["n"] in ("begin", "end"):
        return 0.5
    args = t[b : b + 1] in ("{", "[")
    path = bool(re.search(r"(?:\b[A-Za-z]:|[\w.$%-]\\[\w.$ %-]*|\\\\[\w.-]+)$", t[max(0, a - 60) : a])) or bool(re.match(r"[\w. -]*\\[A-Za-z]", t[b : b + 40]) and not args and m["n"] not in MACROS)
    if path and not args:
        return -3.0
    return 3.0 if m["n"] in MACROS else 2.0 if args else -0.5


def macro_text(m: re.Match) -> str:
    n = m["n"]
    if n in ("section", "subsection", "subsubsection", "chapter", "paragraph", "title"):
        return "\n# "
    return "\n- " if n == "item" else m[0] if n in ("frac", "sqrt", "sum", "int", "alpha", "beta", "times", "cdot", "leq", "geq", "le", "ge") else "\n" if n in ("newline", "par", "linebreak", "hline") else ""


def math_weight(m: re.Match) -> float:
    s = m[0].strip("$")
    if re.search(r"\\[A-Za-z]|\^|_\{|[A-Za-z]\s*=|=\s*[A-Za-z]", s):
        return 3.0
    return 0.8 if re.fullmatch(r"\s*[A-Za-z]\s*", s) else -3.0


def star_weight(m: re.Match) -> float:
    t, a, b = m.string, m.start(), m.end()
    left, right = t[a - 1 : a], t[b : b + 1]
    if left.isdigit() and right.isdigit():
        return -2.0
    return 1.5 if (right and not right.isspace()) or (left and not left.isspace()) else -1.0


def quotes_weight(m: re.Match) -> float:
    t, a, b = m.string, m.start(), m.end()
    if len(m[0]) == 2 and t[a - 1 : a].isdigit():
        return -0.8
    return 2.5 if len(m[0]) in (3, 5) else 1.2 if (t[b : b + 1] and not t[b : b + 1].isspace()) or (t[a - 1 : a] and not t[a - 1 : a].isspace()) else -0.5


def const(w: float) -> Callable[[re.Match], float]:
    return lambda m: w


def rule(kind: str, name: str, pattern: str, weight, text="", flags: int = re.M) -> Rule:
    return kind, name, re.compile(pattern, flags), weight if callable(weight) else const(weight), text if callable(text) else (lambda m, text=text: m.expand(text) if "\\" in text else text)


RULES: list[Rule] = [
    rule("html", "comment", r"<!--|-->|<!\[CDATA\[|\]\]>|<!DOCTYPE[^<>]*>|<\?xml[^<>]*>", lambda m: 3.0 if m[0] != "-->" else 0.2),
    rule("html", "tag", r"</?(?P<n>[A-Za-z][A-Za-z0-9]*(?::[A-Za-z]+)?)(?:\s[^<>]*)?/?>", tag_weight, tag_text),
    rule("html", "broken", r"</(?P<n>[A-Za-z][A-Za-z0-9]*(?::[A-Za-z]+)?)(?![A-Za-z0-9:]*(?:\s[^<>]*)?>)[ \t]*", 2.5, " "),
    rule("html", "cut", r"<(?P<n>[A-Za-z][A-Za-z0-9]*)(?=\s*$|\s+[a-z-]+\s*=)(?!(?:\s[^<>]*)?/?>)(?:\s+[a-z-]+\s*=\s*(?:\"[^\"\n]*\"?|'[^'\n]*'?|[^\s<>]*))*", lambda m: 2.0 if m["n"].lower() in TAGS else -1.5, " "),
    rule("html", "escaped", r"&(?:amp;)*(?:lt|LT|#60|#x3[cC]);/?(?P<n>[A-Za-z][A-Za-z0-9]*(?::[A-Za-z]+)?)(?:\s[^<>&\n]*(?:&(?!(?:amp;)*(?:gt|GT|lt|LT|#6[02]|#x3[cCeE]);)[^<>&\n]*)*)?/?&(?:amp;)*(?:gt|GT|#62|#x3[eE]);", 3.0, tag_text),
    rule("html", "entity", r"&(?:amp;)*(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});", entity_weight, lambda m: html.unescape(html.unescape(html.unescape(m[0])))),
    rule("markdown", "fence", r"^[ \t]*(?:`{3,}[\w+-]*|~{3}[\w+-]*)[ \t]*$", 3.0, "```"),
    rule("markdown", "heading", r"^#{1,6}[ \t]+(?=\S)", 2.0, "# "),
    rule("markdown", "heading_end", r"(?<=\S)[ \t]+#{2,6}[ \t]*$", 1.0, ""),
    rule("markdown", "underline", r"(?<=\S)[ \t]*\n(?:={3,}|-{3,})[ \t]*$", 2.5, ""),
    rule("markdown", "break", r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]+){2,}-|_{3,})[ \t]*$", 2.5, ""),
    rule("markdown", "code", r"(?<!`)(`{1,2})(?!`)([^`\n]+)(?<!`)\1(?!`)", 2.5, r"\2"),
    rule("markdown", "strong", r"(?<!\*)\*{2,3}(?!\*)(?!(?<=^\*\*)[ \t])(?!(?<=^\*\*\*)[ \t])", star_weight, ""),
    rule("markdown", "strong_", r"(?<![\w_])__(?=[^\s_])|(?<=[^\s_])__(?![\w_])", 1.5, ""),
    rule("markdown", "strike", r"(?<!~)~~(?!~)", 1.5, ""),
    rule("markdown", "emphasis", r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]+)(?<=[^\s_])_(?![\w_])", 1.5, lambda m: m[1] or m[2]),
    rule("markdown", "image", r"!\[([^\]\n]*)\]\([^)\n]*\)", 3.5, r"\1"),
    rule("markdown", "link", r"(?<!!)\[([^\[\]\n]+)\]\((?:https?:|mailto:|#|/|\.|[\w-]+[./])[^)\n]*\)", 3.5, r"\1"),
    rule("markdown", "ref_link", r"(?<![\[\]!])\[([^\[\]\n]*[A-Za-z][^\[\]\n]*)\]\[[^\[\]\n]*\]", 2.0, r"\1"),
    rule("markdown", "ref", r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*(?:\S+)", 2.5, ""),
    rule("markdown", "footnote", r"\[\^[^\[\]\s]+\]", 2.5, ""),
    rule("markdown", "task", r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]", 3.0, "- "),
    rule("markdown", "table", r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", 3.0, ""),
    rule("markdown", "quote", r"^[ ]{0,3}>+(?:[ \t]|$)(?![\d=-])", 1.5, ""),
    rule("markdown", "escape", r"\\[*`~>!]", 1.0, lambda m: m[0][1]),
    rule("wiki", "heading", r"^[ \t]*(={2,6})[ \t]*(?=[^=\s])([^=\n]+?)[ \t]*\1[ \t]*$", 3.0, r"# \2"),
    rule("wiki", "quotes", r"(?<!')'{2,3}(?!')|(?<!')'{5}(?!')", quotes_weight, ""),
    rule("wiki", "link", r"\[\[(?![\d\s,.\[-])(?:[^\[\]\n|]*\|)*([^\[\]\n|]+)\]\]", 3.0, lambda m: "" if re.match(r"\[\[(?:Category|File|Image|Kategorie|Datei)\s*:", m[0], re.I) and "|" not in m[0] else m[1]),
    rule("wiki", "open_link", r"\[\[(?=[A-Za-z][^\[\]\n]*$)", 1.0, ""),
    rule("wiki", "template", r"\{\{[^{}\n]+\}\}|\{\{(?=[A-Za-z])|(?<=\w)\}\}", 2.5, lambda m: re.sub(r"^\{\{[^|}]*\|?|\}\}$", "", m[0]).replace("|", ", ")),
    rule("wiki", "table", r"^[ \t]*\{\|.*$|^[ \t]*\|\}|^[ \t]*\|-[ \t]*$|^!.*!!.*$|^\|[^|\n]*\|\|.*$", 2.5, lambda m: "" if m[0].strip()[:2] in ("{|", "|}", "|-") else "| " + re.sub(r"\s*(?:!!|\|\|)\s*", " | ", m[0].strip("!| ")) + " |"),
    rule("wiki", "signature", r"(?<!~)~{4,5}(?!~)", 2.5, ""),
    rule("wiki", "external", r"\[(?:https?|ftp|mailto):[^\s\[\]]+[ \t]+([^\[\]\n]+)\]", 3.0, r"\1"),
    rule("wiki", "definition", r"^;[ \t]*(?=\S[^\n]*\n:)|^:{1,5}[ \t]*(?=\S)(?<=\n.)", lambda m: 2.0 if m[0][0] == ";" else 0.3, "- "),
    rule("wiki", "list", r"^[*#]*(?:\*\*|\*#|#\*)[*#]*[ \t]+(?=\S)", 1.5, "- "),
    rule("wiki", "magic", r"(?<!\w)__[A-Z]{3,}__(?!\w)|^#REDIRECT\b|</?(?:ref|nowiki|gallery)\b[^<>]*>", 2.5, ""),
    rule("latex", "silent", rf"\\(?P<n>{SILENT})\*?(?:\[[^\[\]\n]*\])*\{{[^{{}}\n]*\}}(?:\[[^\[\]\n]*\]|\{{[a-z|]*\}})*", lambda m: 4.0 if m["n"] in ("begin", "end") else 3.0, lambda m: ""),
    rule("latex", "href", r"\\href\{[^{}\n]*\}\{", 3.0),
    rule("latex", "macro", r"\\(?P<n>[A-Za-z]+)\*?(?:(?:\[[^\[\]\n]*\])?\{)?", macro_weight, macro_text),
    rule("latex", "brace", r"\}(?:\{)?", BRACE, lambda m: " " if m[0][1:] else ""),
    rule("latex", "math", r"(?<![\\$])\$(?!\$)[^$\n]+(?<!\\)\$(?!\$)", math_weight, keep),
    rule("latex", "display", r"(?<!\\)\$\$|(?<!\\)\\[\[\]()](?![A-Za-z]*\\)", 2.0, lambda m: "$$"),
    rule("latex", "newline", r"(?<!\\)\\\\(?!\\)(?![A-Za-z])", 1.2, "\n"),
    rule("latex", "escape", r"(?<![\\\w])\\[%&_#${}](?!\\)|(?<=[\w)])\\[%&#$](?!\w*\\)", 2.0, lambda m: m[0][1]),
    rule("latex", "tie", r"(?<=\w)~(?=\\)", 1.0, " "),
]
TRIGGER = {"html": re.compile(r"[<&]|\]\]>"), "markdown": re.compile(r"[*_`~#|>\[\\]|^[=-]{3,}", re.M), "wiki": re.compile(r"==|''|\[\[|\{\{|\{\||\|\}|~~~~|\[(?:https?|ftp|mailto):|^[;*#]|__", re.M), "latex": re.compile(r"\\|\$")}


class Cut:
    """A minimum cut of a small graph with capacities to two terminals."""

    def __init__(self, unary: list[float]):
        self.u = list(unary)  # > 0: capacity to the markup side
        self.e: list[dict[int, float]] = [{} for _ in unary]

    def join(self, i: int, j: int, c: float) -> None:
        if i != j:
            self.e[i][j] = self.e[i].get(j, 0.0) + c
            self.e[j][i] = self.e[j].get(i, 0.0) + c

    def labels(self) -> list[bool]:
        n = len(self.u)
        out: list[bool | None] = [None] * n
        todo = deque(range(n))
        while todo:  # whoever outweighs all open edges is settled, and pulls the neighbours
            i = todo.popleft()
            if out[i] is None and abs(self.u[i]) > sum(c for j, c in self.e[i].items() if out[j] is None):
                out[i] = self.u[i] > 0
                for j, c in self.e[i].items():
                    if out[j] is None:
                        self.u[j] += c if out[i] else -c
                        todo.append(j)
        rest = [i for i in range(n) if out[i] is None]
        if rest:
            side = self.flow(rest)
            for i in rest:
                out[i] = i in side
        return [bool(x) for x in out]

    def flow(self, rest: list[int]) -> set[int]:
        """The open nodes on the markup side, by blocking flows over level graphs (as many phases as the longest shortest path)."""
        at = {i: k + 2 for k, i in enumerate(rest)}  # 0 is the markup terminal, 1 the content terminal
        head: list[list[int]] = [[] for _ in range(len(rest) + 2)]
        to: list[int] = []
        cap: list[float] = []

        def arc(x: int, y: int, c: float, back: float) -> None:
            head[x].append(len(to))
            to.append(y)
            cap.append(c)
            head[y].append(len(to))
            to.append(x)
            cap.append(back)

        for i in rest:
            if self.u[i] > 0:
                arc(0, at[i], self.u[i], 0.0)
            elif self.u[i] < 0:
                arc(at[i], 1, -self.u[i], 0.0)
            for j, c in self.e[i].items():
                if j in at and i < j:
                    arc(at[i], at[j], c, c)
        while True:
            level, q = [-1] * len(head), deque([0])
            level[0] = 0
            while q:
                x = q.popleft()
                for k in head[x]:
                    if cap[k] > 1e-9 and level[to[k]] < 0:
                        level[to[k]] = level[x] + 1
                        q.append(to[k])
            if level[1] < 0:
                return {i for i in rest if level[at[i]] >= 0}
            tried, path, x = [0] * len(head), [], 0
            while True:
                if x == 1:
                    f = min(cap[k] for k in path)
                    for k in path:
                        cap[k] -= f
                        cap[k ^ 1] += f
                    cut_at = next(n for n, k in enumerate(path) if cap[k] <= 1e-9)
                    x = to[path[cut_at] ^ 1]
                    del path[cut_at:]
                elif tried[x] < len(head[x]):
                    k = head[x][tried[x]]
                    if cap[k] > 1e-9 and level[to[k]] == level[x] + 1:
                        path.append(k)
                        x = to[k]
                    else:
                        tried[x] += 1
                elif path:
                    k = path.pop()
                    x = to[k ^ 1]
                    tried[x] += 1
                else:
                    break


class Mark(NamedTuple):
    """A node: its place, form, prior log-odds, signature, and what stands in its place if it is residue."""

    start: int
    end: int
    kind: str
    name: str
    prior: float
    new: str
    sig: str


def _side(c: str) -> str:
    return "s" if not c or c.isspace() else "w" if c.isalpha() else "d" if c.isdigit() else "p"


def mark(text: str, a: int, b: int, kind: str, name: str, prior: float, new: str = "") -> Mark:
    left = text[a - 1 : a] if a else ""
    return Mark(a, b, kind, name, prior, new, f"{kind[:2]}.{name} {prior:g} {'^' if not left or left == chr(10) else _side(left)}{_side(text[b : b + 1])}")


def candidates(text: str, kind: str) -> list[Mark]:
    """The marks of a kind without overlaps: earlier first, then longer."""
    if not TRIGGER[kind].search(text):
        return []
    found = []
    for k, name, pattern, weight, repl in RULES:
        if k == kind:
            for m in pattern.finditer(text):
                if m.end() > m.start():
                    found.append((m.start(), m.end(), name, weight(m), repl(m)))
    found.sort(key=lambda x: (x[0], -(x[1] - x[0])))
    out, at = [], -1
    for x in found:
        if x[0] >= at:
            out.append(mark(text, x[0], x[1], kind, x[2], x[3], x[4]))
            at = x[1]
    return _paired_braces(text, out) if kind == "latex" else out


def _paired_braces(text: str, c: list[Mark]) -> list[Mark]:
    """Without the closing braces that end no macro's argument: plain braces are content and no marks."""
    out, depth, at = [], [], 0
    for m in c:
        depth += [False] * text.count("{", at, m.start)
        at = m.end
        if m.name == "brace":
            if not (depth and depth.pop()):
                continue
        if text[m.end - 1] == "{" and m.name in ("macro", "href", "brace"):
            depth.append(True)
        out.append(m)
    return out


ESCAPED_LT = re.compile(r"&(?:amp;)*(?:lt|LT|#60|#x3[cC]);")
TAG_NAME = re.compile(r"<?(/?)([A-Za-z][A-Za-z0-9:]*)")


def edges(text: str, c: list[Mark]) -> list[tuple[int, int, float]]:
    """Nearness of neighbouring marks, and pairs of opening and closing marks by the nesting of tags, signs, braces and environments."""
    out: list[tuple[int, int, float]] = []
    open_: dict[str, list[int]] = defaultdict(list)
    for i, m in enumerate(c):
        if i and m.name not in ("entity", "brace"):
            gap = m.start - c[i - 1].end
            if gap < 4 * REACH:
                out.append((i - 1, i, NEAR * math.exp(-gap / REACH)))
        s = text[m.start : m.end]
        if m.name in ("tag", "escaped"):
            t = TAG_NAME.match(ESCAPED_LT.sub("<", s))
            key = f"{m.name}:{t[2].lower()}" if t else m.name
            if t and t[1] and open_[key]:
                out.append((open_[key].pop(), i, PAIR))
            elif t and not t[1]:
                open_[key].append(i)
        elif m.name in ("strong", "strong_", "strike", "quotes", "fence", "display"):
            key = f"{m.name}:{s.strip()}"
            if open_[key]:
                out.append((open_[key].pop(), i, PAIR))
            else:
                open_[key].append(i)
        elif m.name == "silent" and s.startswith(("\\begin", "\\end")):
            if s.startswith("\\begin"):
                open_["env"].append(i)
            elif open_["env"]:
                out.append((open_["env"].pop(), i, PAIR))
        elif m.name in ("macro", "href", "brace"):
            root = i  # every brace of a macro with several arguments is joined to the macro itself
            if m.name == "brace" and open_["brace"]:
                root = open_["brace"].pop()
                out.append((root, i, PAIR))
            if s.endswith("{"):
                open_["brace"].append(root)
    return out


def labels(c: list[Mark], joins: list[tuple[int, int, float]], costs: dict[str, float]) -> list[bool]:
    g = Cut([costs.get(m.sig, m.prior) for m in c])
    for i, j, w in joins:
        g.join(i, j, w)
    return g.labels()


class Region(NamedTuple):
    """A span set apart: code, a formula or hidden text, with its nodes (opening and closing mark, hidden text if any) and their edges."""

    start: int
    end: int
    what: str
    body: tuple[int, int]
    nodes: list[Mark]
    joins: list[tuple[int, int, float]]


OPENER = re.compile(
    rf"(?P<comment><!--)|<(?P<raw>{UNSHOWN}|{CODE_TAGS})\b[^<>]*(?<!/)>|^[ \t]*(?P<fence>`{{3,}}|~{{3}})[\w+-]*[ \t]*$|(?P<tick>(?<!`)(?P<t>`{{1,2}})(?!`)[^`\n]+(?<!`)(?P=t)(?!`))"
    rf"|(?P<display>(?<!\\)\$\$|(?<!\\)\\[\[(])|(?P<math>(?<![\\$])\$(?!\$)[^$\n]+(?<!\\)\$(?!\$))|\\begin\{{(?P<env>{CODE_ENV}|{MATH_ENV})(?P<star>\*?)\}}(?:\[[^\[\]\n]*\])?",
    re.M | re.I,
)
WORTH_A_LOOK = re.compile(r"<!--|<(?:script|style|noscript|template|pre|code|math)\b|`|~~~|\$|\\\[|\\\(|\\begin\{", re.I)
CLOSERS: dict[str, re.Pattern] = {}


def closer(what: str) -> re.Pattern:
    if what not in CLOSERS:
        fixed = {"comment": r"-->", "`": r"^[ \t]*`{3,}[ \t]*$", "~": r"^[ \t]*~{3}[ \t]*$", "$$": r"(?<!\\)\$\$", "\\[": r"\\\]", "\\(": r"\\\)"}
        CLOSERS[what] = re.compile(fixed.get(what) or (rf"</{what[4:]}\s*>" if what.startswith("raw:") else rf"\\end\{{{re.escape(what[4:])}\}}"), re.M | re.I)
    return CLOSERS[what]


def regions(text: str, costs: dict[str, float]) -> list[Region]:
    """The spans set apart by the minimum cut of their own marks. Each closer is searched once from each place, so repeated openers cost no more."""
    if not WORTH_A_LOOK.search(text):
        return []
    out: list[Region] = []
    known: dict[str, re.Match | None] = {}
    at = 0
    while m := OPENER.search(text, at):
        a, b, at = m.start(), m.end(), m.end()
        if m["tick"] or m["math"]:
            n = len(m["t"]) if m["tick"] else 1
            one = mark(text, a, b, "markdown", "code", 2.5) if m["tick"] else mark(text, a, b, "latex", "math", math_weight(m))
            made = Region(a, b, "span" if m["tick"] else "$", (a + n, b - n), [one], [])
        else:
            if m["comment"]:
                what, kind, prior = "comment", "html", 3.0
            elif m["raw"]:
                what, kind, prior = f"raw:{m['raw'].lower()}", "html", 3.0 if m["raw"].lower() != "math" else -1.0
            elif m["fence"]:
                what, kind, prior = m["fence"][0], "markdown", 3.0
            elif m["display"]:
                what, kind, prior = m["display"], "latex", 2.0
            else:
                what, kind, prior = f"env:{m['env']}{m['star']}", "latex", 4.0
            if what not in known or (known[what] is not None and known[what].start() < b):
                known[what] = closer(what).search(text, b) if known.get(what, 0) is not None else None
            end = known[what]
            if end is None:
                continue
            nodes = [mark(text, a, b, kind, what, prior), mark(text, *end.span(), kind, "/" + what, 2.0 if what == "raw:math" else prior)]
            joins = [(0, 1, PAIR)]
            if what == "comment" or what[4:] in UNSHOWN.split("|"):
                nodes.append(Mark(b, end.start(), kind, "hidden", HIDDEN, "", f"{kind[:2]}.hidden {what}"))
                joins += [(0, 2, INSIDE), (1, 2, INSIDE)]
            made = Region(a, end.end(), what, (b, end.start()), nodes, joins)
        if all(labels(made.nodes, made.joins, costs)):
            out.append(made)
            at = made.end
    return out


def blank_sign(text: str) -> str:
    """A character that the text does not hold, to stand for a region."""
    return next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text)


def set_apart(text: str, costs: dict[str, float]) -> tuple[str, str, list[Region]]:
    """The text with each region as one sign, the sign, and the regions in order."""
    found = regions(text, costs)
    if not found:
        return text, "", found
    sign, parts, at = blank_sign(text), [], 0
    for r in found:
        parts += [text[at : r.start], sign]
        at = r.end
    return "".join([*parts, text[at:]]), sign, found


def graphs(text: str, costs: dict[str, float]) -> list[tuple[list[Mark], list[tuple[int, int, float]]]]:
    """All graphs of a text: one for each region and one for each kind's marks outside them."""
    rest, _, found = set_apart(text, costs)
    out = [(r.nodes, r.joins) for r in found]
    for kind in KINDS:
        c = candidates(rest, kind)
        if c:
            out.append((c, edges(rest, c)))
    return out


def kinds(text: str, costs: dict[str, float] | None = None) -> list[str]:
    """The kinds of residue in a text, in the order of KINDS."""
    hit = {m.kind for c, joins in graphs(text, costs or {}) for m, x in zip(c, labels(c, joins, costs or {})) if x}
    return [k for k in KINDS if k in hit]


ANY_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def shown(r: Region, text: str) -> str:
    """What stands for a region in clean text: code as it is, in fences or as a span; formulas between their signs; hidden text is dropped."""
    body = text[r.body[0] : r.body[1]]
    if r.what in ("`", "~"):
        lang = re.sub(r"^[ \t]*(?:`{3,}|~{3})", "", text[r.start : r.body[0]]).strip()
        return f"```{lang}{body if body.endswith(chr(10)) else body + chr(10)}```"
    if r.what in ("span", "raw:code"):
        return body if r.what == "span" else html.unescape(ANY_TAG.sub("", body))
    if r.what == "raw:pre":
        return "\n```\n" + html.unescape(ANY_TAG.sub("", body)).strip("\n") + "\n```\n"
    if r.what in ("$", "\\(", "raw:math"):
        return f"${body}$"
    if r.what in ("$$", "\\["):
        return f"$${body}$$"
    if r.what.startswith("env:"):
        code = r.what[4:].rstrip("*").lower() in CODE_ENV.split("|")
        return "\n```\n" + body.strip("\n") + "\n```\n" if code else f"$${body}$$"
    return ""


def clean(text: str, costs: dict[str, float] | None = None) -> str:
    """The text without residue; headings begin with `# `, list items with `- `, code stands in ``` fences as it was, table rows in bars, formulas keep their signs."""
    costs = costs or {}
    rest, sign, apart = set_apart(text, costs)
    for kind in ("markdown", "wiki", "latex", "html"):
        c = candidates(rest, kind)
        if not c:
            continue
        out, at = [], 0
        for m, x in zip(c, labels(c, edges(rest, c), costs)):
            if x:
                out += [rest[at : m.start], m.new]
                at = m.end
        rest = "".join([*out, rest[at:]])
    rest = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", rest))
    if apart:
        parts = rest.split(sign)
        rest = "".join(x for p, r in zip(parts, [*apart, None]) for x in (p, shown(r, text) if r else ""))
    return rest.strip()


GRAPH = "kind array<string>, sig array<string>, prior array<double>, a array<int>, b array<int>, w array<double>"


def packed(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys and the graph of every text with marks: nodes (kind, signature, prior) and edges (a, b, w). Regions are told by the priors."""
    types = dict(texts.dtypes)
    cols = [*keys, "kind", "sig", "prior", "a", "b", "w"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *k, t in pdf[[*keys, "_t"]].itertuples(index=False):
                nodes: list[Mark] = []
                joins: list[tuple[int, int, float]] = []
                for c, e in graphs(t, {}):
                    joins += [(i + len(nodes), j + len(nodes), w) for i, j, w in e]
                    nodes += c
                if nodes:
                    rows.append((*k, [m.kind for m in nodes], [m.sig for m in nodes], [m.prior for m in nodes], [e[0] for e in joins], [e[1] for e in joins], [e[2] for e in joins]))
            yield pd.DataFrame(rows, columns=cols)

    rows = texts.select(*keys, F.col(text).alias("_t")).where(F.length("_t") > 0)
    return rows.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + GRAPH)


def _labelled(sig, prior, a, b, w, costs: dict[str, float]) -> list[bool]:
    g = Cut([costs.get(s, p) for s, p in zip(sig, prior)])
    for i, j, c in zip(a, b, w):
        g.join(int(i), int(j), c)
    return g.labels()


def fit(nodes: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """Log-odds by signature from the graphs of all texts (see packed): the cut labels every node, labels are counted by signature and shrunk to the prior.

    Signatures are forms with their surroundings, a few thousand at most, so their counts may come to the driver. Without
    texts the prior stands.
    """
    costs: dict[str, float] = {}
    for _ in range(rounds):

        def run(batches: Iterator[pd.DataFrame], costs=costs) -> Iterator[pd.DataFrame]:
            c: dict[str, list[float]] = {}
            for pdf in batches:
                for sig, prior, a, b, w in pdf[["sig", "prior", "a", "b", "w"]].itertuples(index=False):
                    for s, p, x in zip(sig, prior, _labelled(sig, prior, a, b, w, costs)):
                        n = c.setdefault(s, [p, 0.0, 0.0])
                        n[1] += x
                        n[2] += 1
            yield pd.DataFrame([(s, *v) for s, v in c.items()], columns=["sig", "prior", "yes", "n"])

        counted = nodes.select("sig", "prior", "a", "b", "w").mapInPandas(run, "sig string, prior double, yes double, n double").groupBy("sig").agg(F.max("prior").alias("prior"), F.sum("yes").alias("yes"), F.sum("n").alias("n"))
        fresh = {}
        for r in counted.collect():
            p = (r.yes + PRIOR_N / (1 + math.exp(-r.prior))) / (r.n + PRIOR_N)
            fresh[r.sig] = min(max(math.log(p / (1 - p)), r.prior - SHIFT), r.prior + SHIFT)
        costs = fresh
    return costs


def found(texts: DataFrame, keys: list[str], text: str, rounds: int = ROUNDS) -> DataFrame:
    """The keys and `kind`, once per kind of residue in a row.

    Null, empty and clean texts give no rows; repeated rows are found alike. Texts are scanned once, whole: their graphs are
    kept, the classifier is fitted to all of them, and the cut with its costs decides.
    """
    types = dict(texts.dtypes)
    nodes = cut(packed(texts, keys, text))
    costs = fit(nodes, rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *k, kind, sig, prior, a, b, w in pdf.itertuples(index=False):
                hit = {x for x, y in zip(kind, _labelled(sig, prior, a, b, w, costs)) if y}
                rows += [(*k, x) for x in KINDS if x in hit]
            yield pd.DataFrame(rows, columns=[*keys, "kind"])

    return nodes.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", kind string")


def cleaned(texts: DataFrame, keys: list[str], text: str, costs: dict[str, float] | None = None) -> DataFrame:
    """The keys and the clean text of every row; null stays null. Without given costs the classifier is fitted to these texts."""
    types = dict(texts.dtypes)
    costs = fit(cut(packed(texts, keys, text))) if costs is None else costs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(clean_text=[None if t is None else clean(t, costs) for t in pdf["_t"]])[[*keys, "clean_text"]]

    return texts.select(*keys, F.col(text).alias("_t")).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", clean_text string")
