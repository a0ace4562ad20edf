"""Markup residue in text documents: one tree builder for HTML, Markdown, wiki and LaTeX.

A scanner turns the four syntaxes into the same events (open, close, text, verbatim text); a tree
builder with implied end tags arranges them; a layout pass with visibility rules renders all visible
text, keeping block spacing, list markers, aligned table cells, code and formulas.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame

from foliora.functions.rows import map_rows, spread

# Element names of the HTML standard, by their role in the layout.
TAGS = frozenset(
    "a abbr address article aside audio b base big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option p param picture pre q s samp script section "
    "select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr ref nowiki references".split()
)
#: Names that after a letter more likely belong to a type parameter than to an element.
TYPES = frozenset("object time input select option map var data form table link source title button label".split())
BLOCKS = frozenset("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table ul math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head template title noscript iframe object svg select".split())
#: A start tag implies the end of these open elements, up to the nearest element of the second set.
IMPLIED = {
    "li": ({"li", "p"}, {"ul", "ol"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
TIGHT = frozenset("ul ol dl div html body dt dd".split())  #: blocks without an empty line around them
KEEPING = frozenset("html body div pre #root".split())  #: blocks that keep the space within them as it is
P_ENDS = BLOCKS - {"li", "dt", "dd", "html", "body"}

# Commands of LaTeX whose braces hold text to keep, and those whose argument is not text.
TEX_KEEP = frozenset("textbf textit emph underline texttt textsc textrm textsf footnote caption title author mbox text".split())
TEX_HEAD = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
TEX_DROP = frozenset("cite citep citet ref eqref label documentclass usepackage bibliographystyle bibliography includegraphics pagestyle thispagestyle vspace hspace input include index".split())
TEX_MARK = frozenset("it bf em tt sc rm sf item hline centering maketitle tableofcontents newpage noindent par small large Large tiny clearpage appendix newline linebreak".split())
TEX_MATH = frozenset(
    "frac sqrt sum prod int alpha beta gamma delta epsilon lambda mu pi sigma theta omega leq geq neq approx times cdot infty partial nabla left right log exp lim le ge ne in to rightarrow forall exists".split()
)

LINE = r"""
 (?P<fence>(?P<f>```|~~~)[^\n`]*\n(?P<fcode>.*?)(?:^(?P=f)[ \t]*$|\Z))
|(?P<wtable>\{\|[^\n]*\n(?P<wbody>.*?)^\|\}[ \t]*$)
|(?P<whead>(?P<we>={1,6})[ \t]*(?P<wtext>[^=\n][^\n]*?)[ \t]*(?P=we)[ \t]*$)
|(?P<redirect>\#REDIRECT\b[ \t]*)
|(?P<mhead>(?P<mh>\#{1,6})[ \t]+(?P<mtext>[^\n]*?)[ \t]*\#*[ \t]*$)
|(?P<setext>(?P<stext>[^\s|>=\-#*+<][^\n]*)\n(?P<su>={3,}|-{3,})[ \t]*$)
|(?P<mtable>\|[^\n]*\|[ \t]*\n\|[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*(?:\n\|[^\n]*)*)
|(?P<quote>>[ ]?(?=\S))
|(?P<fnote>\[\^[\w-]+\]:[ \t]*)
|(?P<wlist>(?:[*\#]{1,4}|:{1,4}|;)(?=[^\s*\#:;=_`\-])(?![^\n]*\*\*)(?!\*[^*\n]*\*(?!\*)))
|(?P<mlist>(?:[-+*][ ]+(?:\[[ xX]\][ ]+)?|\d{1,3}\.[ ]+)(?=\S))
"""
INLINE = r"""
 <!--(?P<comment>.*?)(?:-->|\Z)
|(?P<doctype><!DOCTYPE[^>\n]*>)
|<(?P<raw>script|style|pre|textarea)\b(?P<rattr>[^<>]*)>(?P<rbody>.*?)(?:</(?P=raw)\s*>|\Z)
|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?P<attr>(?:\s+[^<>]*|\s*))/?>
|(?P<entity>&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,24});)
|\\begin\{(?P<verb>verbatim|lstlisting|Verbatim)\*?\}(?P<vbody>.*?)(?:\\end\{(?P=verb)\*?\}|\Z)
|\\begin\{(?P<meq>equation|align|displaymath|math|gather)\*?\}(?P<mbody>.*?)(?:\\end\{(?P=meq)\*?\}|\Z)
|\$\$(?P<dd>[^$]+?)\$\$
|\\\[(?P<db>.+?)\\\]
|\\\((?P<dp>.+?)\\\)
|\$(?P<dm>(?=\S)[^$\n]*?[\\=^_][^$\n]*?)(?<=\S)\$(?!\d)
|\\(?P<env>begin|end)\{(?P<ename>[A-Za-z]+\*?)\}(?:\{[^{}\n]*\})?
|\\href\{(?P<url>[^{}\n]*)\}\{
|\\(?P<cmd>[A-Za-z]+)\*?(?P<cend>[ \t]*\{|(?![A-Za-z])[ \t]?)
|\\(?P<esc>[%&_\#\\${}])
|(?P<open>\{)(?=\\[a-z])
|\{\{(?P<tmpl>[A-Za-z][^{}]*)\}\}
|\[\[(?P<link>(?:[^\[\]\n]|\n(?!\s*\n))+)\]\]
|(?P<switch>__[A-Z]{3,}__)
|(?P<quotes>'{2,5})
|!\[(?P<alt>(?:[^\[\]\n]|\n(?!\s*\n))*)\]\((?P<src>[^()\s]*)\)
|\[(?P<ltext>(?:[^\[\]\n]|\n(?!\s*\n))*)\]\((?P<href>[^()\s]+)\)
|\[(?P<ext>https?://[^\s\[\]]+)(?:[ ](?P<etext>(?:[^\[\]\n]|\n(?!\s*\n))*))?\](?!\()
|(?P<fref>\[\^[\w-]+\])
|(?P<bt>`+)(?P<btext>(?:[^`\n]|\n(?!\s*\n))+)(?P=bt)
|(?P<strong>\*\*)(?P<sb>(?=\n?[^\s*])(?:[^*\n]|\*(?!\*)|\n(?!\s*\n))++)\*\*(?!\*)
|(?P<under>__)(?P<ub>(?=\n?[^\s_])(?:[^_\n]|_(?!_)|\n(?!\s*\n))++)__
|~~(?P<del>(?=\n?\S)(?:[^~\n]|\n(?!\s*\n))+?)~~
|(?<![\w*])\*(?P<emph>[^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])
|(?P<tie>~)(?=\\cite|\\ref)
"""
SCAN = re.compile(rf"(?:^(?:{LINE})|(?=[<&\\$`*_~\[{{'!])(?:{INLINE}))", re.X | re.M | re.S)
#: The same where only inline markup counts, as within a heading; its groups are those of SCAN.
SCAN_INLINE = re.compile(rf"(?:(?!)(?:{LINE})|(?=[<&\\$`*_~\[{{'!])(?:{INLINE}))", re.X | re.M | re.S)
#: No event of SCAN can begin in a text in which this finds nothing.
HINT = re.compile(r"[<&\\$`*_~\[{]|''|^(?:[=#|>+\-:;]|\d{1,3}\. )|^[=\-]{3,}", re.M)
#: Table environments of LaTeX and the number of their arguments; what bounds cells and rows, or keeps them together; rules between rows; cells over several columns or rows.
TEX_TABLES = {"tabular": 1, "tabular*": 2, "tabularx": 2, "longtable": 1}
TEX_CELL = re.compile(r"(?P<row>\\\\\*?(?:\[[^\]\n]*\])?|\\tabularnewline\b)|(?P<env>\\(?:begin|end)\{[^{}\n]*\})|\\.|(?P<entity>&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,24});)|(?P<sign>[{}&])", re.S)
TEX_RULE = re.compile(r"\s*\\(?:hline|toprule|midrule|bottomrule|endhead|endfoot|endfirsthead|endlastfoot|(?:cline|cmidrule)(?:\([a-z]*\))?\{[^{}\n]*\})(?![A-Za-z])(?:\[[^\]\n]*\])?")
TEX_SPAN = re.compile(r"\s*\\multi(?P<kind>column|row)\{(?P<n>\d+)\}\{[^{}\n]*\}(?=\{)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WIDE = 120  #: widest cell that the others of its column are aligned with
FILE_PATH = re.compile(r"[A-Za-z]:$|[A-Za-z]:(?:\\\w+)+$")


class Node:
    """An element: tag, its children (text is a str, verbatim text a one-item tuple) and attributes."""

    __slots__ = ("tag", "kids", "attr")

    def __init__(self, tag: str, attr: str = ""):
        self.tag, self.attr, self.kids = tag, attr, []


class Tree:
    """Builder with implied end tags; ``stack[0]`` is the root, ``at`` has the places of the open elements of each tag."""

    def __init__(self):
        self.stack = [Node("#root")]
        self.at: defaultdict[str, list[int]] = defaultdict(list)

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].kids.append(s)

    def leaf(self, tag: str, s: str, attr: str = "") -> None:
        if tag in P_ENDS:
            self.end("p")
        node = Node(tag, attr)
        node.kids.append((s,))
        self.stack[-1].kids.append(node)

    def push(self, node: Node) -> None:
        self.stack[-1].kids.append(node)
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, size: int) -> None:
        """Close all but the first ``size`` open elements."""
        while len(self.stack) > size:
            self.at[self.stack.pop().tag].pop()

    def _top(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 for none."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def open(self, tag: str, attr: str = "") -> None:
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            floor = self._top(stop)
            inner = [places[k] for t in ends if (k := bisect_right(places := self.at[t], floor)) < len(places)]
            if inner:
                self.cut(min(inner))
        elif tag in P_ENDS:
            self.end("p")
        node = Node(tag, attr)
        if tag in VOID:
            self.stack[-1].kids.append(node)
        else:
            self.push(node)

    def end(self, tag: str) -> None:
        """Close the innermost ``tag``; from within a table or line only what was opened there."""
        if self.at[tag] and (tag in ("table", "#line") or self._top(("table", "#line")) < self.at[tag][-1]):
            self.cut(self.at[tag][-1])

    def line_end(self) -> None:
        """Close what a line-based syntax opened."""
        if self.at["#line"]:
            self.cut(self.at["#line"][0])


def parse(text: str) -> tuple[Node, set[str]]:
    """The tree of ``text`` and the kinds of markup in it."""
    tree, kinds = Tree(), set()
    if not HINT.search(text):
        tree.text(text)
        return tree.stack[0], kinds
    events = list(SCAN.finditer(text))
    wlists = sum(m.group("wlist") is not None for m in events)
    strong_wiki = any(m.group("whead") or m.group("link") or m.group("tmpl") or m.group("redirect") or m.group("switch") or m.group("wtable") or m.group("ext") for m in events)
    take_wlist = strong_wiki or wlists >= 2
    _scan(tree, kinds, text, take_wlist)
    return tree.stack[0], kinds


def _scan(tree: Tree, kinds: set[str], text: str, wlist: bool, scan: re.Pattern = SCAN) -> None:
    pos, braces = 0, []
    search = scan.search
    while True:
        m = search(text, pos)
        if m is None:
            break
        at = m.start()
        _put(tree, text[pos:at], braces)
        g = m.groupdict()
        nxt = m.end()
        if nxt == at:
            tree.text(text[at : at + 1])
            pos = at + 1
            continue
        if g["fence"] is not None:
            kinds.add("markdown")
            tree.leaf("pre", g["fcode"].rstrip("\n"))
        elif g["wtable"] is not None:
            kinds.add("wiki")
            _wiki_table(tree, g["wbody"])
        elif g["whead"] is not None:
            kinds.add("wiki")
            tree.line_end()
            _inline(tree, f"h{len(g['we'])}", g["wtext"], kinds)
        elif g["redirect"] is not None or g["switch"] is not None:
            kinds.add("wiki")
        elif g["mhead"] is not None:
            kinds.add("markdown")
            _inline(tree, f"h{len(g['mh'])}", g["mtext"], kinds)
        elif g["setext"] is not None:
            if g["su"][0] == "-" and not kinds & {"markdown"} and len(g["su"]) < 4:
                tree.text(text[at : at + 1])
                nxt = at + 1
            else:
                kinds.add("markdown")
                _inline(tree, "h1" if g["su"][0] == "=" else "h2", g["stext"], kinds)
        elif g["mtable"] is not None:
            kinds.add("markdown")
            rows = [r.strip().strip("|").split("|") for r in g["mtable"].split("\n")]
            _table(tree, [rows[0], *rows[2:]])
        elif g["quote"] is not None:
            kinds.add("markdown")
        elif g["fnote"] is not None or g["fref"] is not None:
            kinds.add("markdown")
        elif g["wlist"] is not None:
            if wlist:
                kinds.add("wiki")
                depth = len(g["wlist"])
                _line(tree, "ol" if "#" in g["wlist"] else "dl" if g["wlist"][0] in ":;" else "ul", depth)
            else:
                tree.text(g["wlist"])
        elif g["mlist"] is not None:
            kinds.add("markdown")
            _line(tree, "ul" if g["mlist"][0] in "-+*" else "ol", 1)
        elif g["comment"] is not None or g["doctype"] is not None:
            kinds.add("html")
        elif g["raw"] is not None:
            kinds.add("html")
            if (name := g["raw"].lower()) in ("pre", "textarea"):
                tree.leaf("pre", html.unescape(re.sub(r"</?code[^<>]*>", "", g["rbody"])).strip("\n"))
        elif g["tag"] is not None:
            name = g["tag"].lower()
            typed = not g["close"] and not g["attr"] and name in TYPES and text[at - 1 : at].isalnum() and text[at - 1].isascii()
            if name not in TAGS or typed:
                tree.text(m.group())
            else:
                kinds.add("html")
                tree.end(name) if g["close"] else tree.open(name, g["attr"].strip(" /"))
        elif g["entity"] is not None:
            if (s := html.unescape(g["entity"])) != g["entity"]:
                kinds.add("html")
            tree.text(s)
        elif g["verb"] is not None:
            kinds.add("latex")
            tree.leaf("pre", g["vbody"].strip("\n"))
        elif g["meq"] is not None:
            kinds.add("latex")
            tree.leaf("math", g["mbody"].strip())
        elif (f := g["dd"] or g["db"]) is not None:
            kinds.add("latex")
            tree.leaf("math", f.strip())
        elif (f := g["dp"] or g["dm"]) is not None:
            kinds.add("latex")
            tree.text(f.strip())
        elif g["env"] is not None:
            kinds.add("latex")
            if g["env"] == "begin" and g["ename"] in TEX_TABLES:
                nxt = _tabular(tree, kinds, text, m)
            else:
                _environment(tree, g["env"] == "begin", g["ename"].rstrip("*"))
        elif g["url"] is not None:
            kinds.add("latex")
            braces.append("")
        elif g["cmd"] is not None:
            nxt = _command(tree, kinds, text, m, braces)
        elif g["esc"] is not None:
            if g["esc"] in "{}$" and "latex" not in kinds:
                tree.text(m.group())
            else:
                if g["esc"] in "\\%":
                    kinds.add("latex")
                tree.text("\n" if g["esc"] == "\\" else g["esc"])
        elif g["open"] is not None:
            braces.append("")
        elif g["tmpl"] is not None:
            kinds.add("wiki")
            _template(tree, g["tmpl"])
        elif g["link"] is not None:
            kinds.add("wiki")
            if not re.match(r"(?:Category|File|Image|Kategorie|Catégorie|Категория|分类)\s*:", g["link"]):
                tree.text(g["link"].rpartition("|")[2])
        elif g["ext"] is not None:
            kinds.add("wiki")
            tree.text(g["etext"] or g["ext"])
        elif g["quotes"] is not None:
            kinds.add("wiki")
        elif g["alt"] is not None or g["ltext"] is not None:
            kinds.add("markdown")
            _inline(tree, "span", g["alt"] if g["alt"] is not None else g["ltext"], kinds)
        elif g["btext"] is not None:
            kinds.add("markdown")
            tree.leaf("code", g["btext"])
        elif (f := g["sb"] or g["ub"] or g["del"] or g["emph"]) is not None:
            kinds.add("markdown")
            _inline(tree, "span", f, kinds)
        pos = nxt
    _put(tree, text[pos:], braces)


def _put(tree: Tree, s: str, braces: list[str]) -> None:
    """Add text; a line break ends what a line-based syntax opened, a brace what a command opened."""
    if not s:
        return
    if braces and "}" in s:
        kept, depth = [], 0
        for part in re.split(r"([{}])", s):
            if part == "{":
                depth += 1
                kept.append(part)
            elif part == "}":
                if depth:
                    depth -= 1
                    kept.append(part)
                elif braces:
                    if tag := braces.pop():
                        _put(tree, "".join(kept), [])
                        kept = []
                        tree.end(tag)
                else:
                    kept.append(part)
            else:
                kept.append(part)
        s = "".join(kept)
    if "\n" in s and tree.at["#line"]:
        head, _, rest = s.partition("\n")
        tree.text(head)
        tree.line_end()
        s = rest
    tree.text(s)


def _line(tree: Tree, kind: str, depth: int) -> None:
    tree.line_end()
    tree.open("#line")
    tree.push(Node("li", f"{kind} {depth}"))


def _inline(tree: Tree, tag: str, s: str, kinds: set[str]) -> None:
    """An element whose content is scanned for inline markup only."""
    tree.open(tag)
    size, here = len(tree.stack), tree.stack[-1]
    _scan(tree, kinds, s, False, SCAN_INLINE) if s and not s.isspace() else tree.text(s)
    if len(tree.stack) > size and tree.stack[size - 1] is here:
        tree.cut(size)
    tree.end(tag)


def _table(tree: Tree, rows: list[list[str]]) -> None:
    tree.open("table")
    for row in rows:
        tree.open("tr")
        for cell in row:
            tree.open("td")
            tree.text(cell.strip())
        tree.end("tr")
    tree.end("table")


def _tex_rows(text: str, pos: int, stop: int) -> tuple[list[list[str]], int | None]:
    """Cells of the rows of a LaTeX table's body from ``pos``, and the place behind its end tag, if it has one before ``stop``."""
    rows: list[list[str]] = [[""]]
    braces = inner = 0
    at = pos
    for t in TEX_CELL.finditer(text, pos, stop):
        rows[-1][-1] += text[at : t.start()]
        at = t.end()
        if t["env"]:
            inner += 1 if t["env"].startswith("\\begin") else -1
            if inner < 0:
                return rows, at
        elif t["sign"] in ("{", "}"):
            braces = max(0, braces + (1 if t["sign"] == "{" else -1))
        elif not (braces or inner):
            if t["row"]:
                rows.append([""])
                continue
            if t["sign"] == "&" or t["entity"] and html.unescape(t["entity"]) == t["entity"]:
                rows[-1].append(t["entity"][1:] if t["entity"] else "")
                continue
        rows[-1][-1] += t[0]
    rows[-1][-1] += text[at:stop]
    return rows, None


def _bare(cell: str) -> str:
    """A cell without braces around the whole of it."""
    cell = cell.strip()
    depth = 0
    for k, c in enumerate(cell):
        depth += (c == "{") - (c == "}")
        if not depth:
            return cell[1:-1] if c == "}" and k == len(cell) - 1 else cell
    return cell


def _tabular(tree: Tree, kinds: set[str], text: str, m: re.Match) -> int:
    """The table of a LaTeX environment opened by ``m``, and where it ends (without its end tag, with the paragraph)."""
    pos = m.end()
    for _ in range(TEX_TABLES[m["ename"]] - (text.find("}", m.start()) + 1 < pos)):
        if opt := re.compile(r"\s*\[[^\]\n]*\]").match(text, pos):
            pos = opt.end()
        if text[pos : pos + 1] == "{":
            depth = 0
            for k in range(pos, len(text)):
                depth += (text[k] == "{") - (text[k] == "}")
                if not depth:
                    pos = k + 1
                    break
    rows, nxt = _tex_rows(text, pos, len(text))
    if nxt is None:
        blank = re.compile(r"\n[^\S\n]*\n").search(text, pos)
        nxt = blank.start() if blank else len(text)
        rows, _ = _tex_rows(text, pos, nxt)
    tree.open("table")
    for row in rows:
        while rule := TEX_RULE.match(row[0]):
            row[0] = row[0][rule.end() :]
        if not any(c.strip() for c in row):
            continue
        tree.open("tr")
        for cell in row:
            more = 0
            while span := TEX_SPAN.match(cell):
                cell = cell[span.end() :]
                more += int(span["n"]) - 1 if span["kind"] == "column" else 0
            cell = cell if TEX_SPAN.match(cell) or re.match(r"\s*\{\\[a-z]", cell) else _bare(cell)
            _inline(tree, "td", " ".join(cell.split()), kinds)
            for _ in range(min(more, 100)):
                _inline(tree, "td", "", kinds)
        tree.end("tr")
    tree.end("table")
    return nxt


def _wiki_table(tree: Tree, body: str) -> None:
    rows: list[list[str]] = [[]]
    for line in body.split("\n"):
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows.append([line[2:]])
        elif line[:1] in ("|", "!"):
            rows[-1] += [c.rpartition("|")[2] for c in re.split(r"\|\||!!", line[1:])]
    _table(tree, [r for r in rows if r])


def _environment(tree: Tree, begin: bool, name: str) -> None:
    tag = {"itemize": "ul", "enumerate": "ol", "description": "dl", "quote": "blockquote", "table": "div", "figure": "div"}.get(name)
    if tag and begin:
        tree.open(tag)
    elif tag:
        tree.end(tag)


def _template(tree: Tree, body: str) -> None:
    name, _, arg = body.partition("|")
    name = name.strip().lower()
    if name == "code":
        tree.leaf("pre", arg)
    elif name == "math":
        tree.leaf("math", arg)
    elif name.startswith("infobox"):
        _table(tree, [[x.strip() for x in a.split("=", 1)] for a in arg.split("|") if "=" in a])


def _command(tree: Tree, kinds: set[str], text: str, m: re.Match, braces: list[str]) -> int:
    """A LaTeX command; unknown names without an argument (such as parts of file paths) stay text."""
    name, braced, at = m["cmd"], m["cend"].endswith("{"), m.start()
    if FILE_PATH.search(text, max(0, at - 60), at) or not (braced or name in TEX_MARK or name in TEX_MATH):
        tree.text(m.group())
        return m.end()
    kinds.add("latex")
    if name in TEX_DROP:
        return k + 1 if braced and (k := text.find("}", m.end())) >= 0 else m.end()
    if name in TEX_HEAD and braced:
        tree.open(tag := f"h{TEX_HEAD[name]}")
        braces.append(tag)
    elif name == "item":
        tree.open("li")
    elif name in TEX_MATH:
        tree.text(m.group())
        if braced:
            return m.end()
    elif braced:
        braces.append("")
    return m.end()


def _hidden(node: Node) -> bool:
    if node.tag in HIDDEN:
        return True
    for name, value in ATTRIBUTE.findall(node.attr) if node.attr else ():
        if (name := name.lower()) == "hidden":
            return True
        if name == "style" and re.search(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", value.strip("\"'").lower()):
            return True
    return False


def render(root: Node) -> str:
    """All visible text of a tree, however deep."""
    out: list[str] = []
    open_: list[Iterator] = [_layout(root, out, "", True)]
    while open_:
        inner = next(open_[-1], None)
        if inner is None:
            open_.pop()
        else:
            open_.append(inner)
    lines = [x.rstrip() for x in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def _layout(node: Node, out: list[str], indent: str, keep: bool) -> Iterator[Iterator]:
    """Render the children of ``node`` into ``out``; yields the layouts to be run before it goes on."""
    number = 0
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(kid if keep else re.sub(r"\s+", " ", kid))
        elif isinstance(kid, tuple):
            out.append(kid[0])
        elif _hidden(kid):
            continue
        elif kid.tag == "br":
            out.append("\n")
        elif kid.tag == "hr":
            out.append("\n\n")
        elif kid.tag == "#line":
            yield _layout(kid, out, indent, keep)
        elif kid.tag == "table":
            out.append("\n\n")
            yield _cells(kid, out)
            out.append("\n\n")
        elif kid.tag == "li":
            kind, _, depth = kid.attr.partition(" ") if kid.attr[:3] in ("ul ", "ol ", "dl ") else (node.tag, "", "1")
            number += 1
            pad = indent + "  " * (int(depth) - 1 if depth.isdigit() else 0)
            inner: list[str] = []
            yield _layout(kid, inner, pad + "  ", False)
            mark = "" if kind == "dl" else f"{number}. " if kind == "ol" and node.tag == "ol" else "1. " if kind == "ol" else "- "
            gap = "" if node.tag == "#line" or (out and out[-1].endswith("\n")) else "\n"
            out.append(f"{gap}{pad}{mark}{''.join(inner).strip()}\n")
        elif kid.tag in BLOCKS:
            gap, kept = "\n" if kid.tag in TIGHT else "\n\n", keep
            # of a block that holds nothing but another block only the outer space is seen
            while len(kid.kids) == 1 and isinstance(only := kid.kids[0], Node) and only.tag in BLOCKS and only.tag not in ("li", "table", "pre", "hr") and kid.tag != "pre" and not _hidden(only):
                kept, kid = kept and kid.tag in KEEPING, only
            inner = []
            yield _layout(kid, inner, indent, kept and kid.tag in KEEPING)
            body = "".join(inner)
            out += [gap, body if kid.tag == "pre" else body.strip(), gap]
        else:
            yield _layout(kid, out, indent, keep)


def _cells(table: Node, out: list[str]) -> Iterator[Iterator]:
    """Render a table with the cells of each column aligned, as far as they aren't wider than ``WIDE``."""
    rows: list[list[str]] = []
    todo: list[Node] = [table]
    while todo:
        n = todo.pop()
        if n is not table and _hidden(n):
            continue
        if n.tag == "tr":
            rows.append([])
        if n.tag in ("td", "th", "caption"):
            inner: list[str] = []
            yield _layout(n, inner, "", False)
            if not rows:
                rows.append([])
            rows[-1].append(" ".join("".join(inner).split()))
        else:
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    widths = [0] * max(map(len, rows), default=0)
    for r in rows:
        for i, c in enumerate(r):
            if widths[i] < len(c) <= WIDE:
                widths[i] = len(c)
    out.append("\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows if r))


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """``text`` without markup, and the kinds of markup it had, sorted."""
    if text is None:
        return None, []
    root, kinds = parse(text)
    return (render(root) if kinds else text), sorted(kinds)


def strip_markup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, clean text and the kinds of markup found (sorted array).

    Null text gives null text and no kinds; empty or blank text comes back unchanged; repeated rows
    are kept; other columns of ``df`` are not read. An empty table gives an empty table."""
    kind = df.schema[key].dataType.simpleString()
    src = spread(df.select(key, text))
    return map_rows(src, [key, text], lambda k, t: [(k, *clean(t))], f"`{key}` {kind}, clean string, kinds array<string>")


def found(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and kind, one row for each kind of markup in each document, from the same parse as ``strip_markup``."""

    def kinds(k, t) -> Iterator[tuple]:
        return ((k, x) for x in sorted(parse(t)[1])) if t else iter(())

    kind = df.schema[key].dataType.simpleString()
    return map_rows(spread(df.select(key, text)), [key, text], kinds, f"`{key}` {kind}, markup string")
