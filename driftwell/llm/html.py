"""HTML to text as a browser lays it out: a tree builder, visibility rules, and a block renderer.

The tree builder supplies tags that authors leave out (a paragraph ends where a block begins, a
list item where the next begins, rows and cells likewise), ignores stray end tags and keeps all
text. Scripts, styles, heads, templates, closed details, elements hidden by attribute, by style
or by a simple rule of a style sheet (tag, .class, #id) are not seen; visibility can be turned
on again inside. Text is emitted whole: blocks on lines of their own, paragraphs set apart by a
blank line, list items marked and indented, cells of a table aligned in columns. Words are never
cut, but layout is: indentation ends at INDENT characters, columns wider than WIDE are not padded,
tables more than TABLES deep are laid out as blocks, and a table that needs much more padding
than it has text has its cells parted by two spaces. So the text stays within a small multiple of
the page.

Null and empty pages give the empty text. The scanner only moves forward, and neither builder nor
renderer recurses, so no page takes time beyond its length and nesting has no limit. A tag that
never ends is text. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm.common import map_texts, table

WIDE = 60
INDENT = 24
TABLES = 8
PADDING = (4, 2000)  # spaces for each character of a table, and spaces that any table may have

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"[^\s\"'>/=]++")
_SPACE = re.compile(r"\s*+")
_BARE = re.compile(r"[^\s\"'>]++")
_STOP = re.compile(r"[=>]")
_COMMENT = re.compile(r"--!?>")
_SELECTOR = re.compile(r"[.#]?[\w-]+")
_NONE, _HIDDEN, _SHOWN = (re.compile(p) for p in (r"display\s*+:\s*+none", r"visibility\s*+:\s*+(?:hidden|collapse)", r"visibility\s*+:\s*+visible"))

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes object audio video canvas datalist base link meta".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul caption tr thead tbody tfoot td th xmp".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table pre blockquote figure fieldset hr xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
#: A start tag ends these open elements, up to one of the bounds.
ENDS = {
    "li": (("li",), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))),
    "option": (("option",), frozenset(("select", "datalist", "optgroup"))), "optgroup": (("option", "optgroup"), frozenset(("select",))),
    "tr": (("tr", "caption"), frozenset(("table",))), "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))),
    "thead": (("thead", "tbody", "tfoot", "caption"), frozenset(("table",))), "tbody": (("thead", "tbody", "tfoot", "caption"), frozenset(("table",))), "tfoot": (("thead", "tbody", "tfoot", "caption"), frozenset(("table",))),
}
SCOPE = frozenset("table td th caption html template button object".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Scanner:
    """Finds tags from left to right; what one search learns about where tags cannot end serves all later ones."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()  # signs = outside quotes from which no tag ends
        self.run = (0, -1)  # the place of the next = or > for all places in this run
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def stop(self, at: int) -> int:
        a, b = self.run
        if not a <= at <= b:
            m = _STOP.search(self.page, at)
            self.run = at, m.start() if m else len(self.page)
        return self.run[1]

    def end(self, at: int) -> int:
        """The > that ends a tag whose attributes begin at ``at``, or -1. Only after = does a quote hide it."""
        page, size, went = self.page, len(self.page), []
        while (at := self.stop(at)) < size and at not in self.dead:
            if page[at] == ">":
                return at
            went.append(at)
            at = _SPACE.match(page, at + 1).end()
            if at < size and page[at] in "\"'" and self.last[page[at]] > at:
                at = page.find(page[at], at + 1) + 1
        self.dead.update(went)
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, int] | None:
        """The next tag or comment: its start and end, the tag's name (none for a comment), whether it closes, where attributes begin."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                if page.startswith((">", "->"), at + 4):
                    return at, page.find(">", at) + 1, "", False, 0
                m = _COMMENT.search(page, at + 4)
                return at, m.end() if m else len(page), "", False, 0
            if at >= self.last[">"]:
                return None
            closes = page.startswith("/", at + 1)
            name = _NAME.match(page, at + 1 + closes)
            if name:
                if (end := self.end(name.end())) >= 0:
                    return at, end + 1, name[0], closes, name.end()
            elif page[at + 1] in "!?/":
                return at, page.find(">", at) + 1, "", False, 0
            at += 1
        return None

    def attributes(self, at: int, end: int) -> dict[str, str]:
        page, found = self.page, {}
        while at < end:
            m = _ATTR.match(page, at, end)
            if not m:
                at += 1
                continue
            name, value = m[0].lower(), ""
            at = _SPACE.match(page, m.end(), end).end()
            if at < end and page[at] == "=":
                at = _SPACE.match(page, at + 1, end).end()
                close = page.find(page[at], at + 1, end) if at < end and page[at] in "\"'" else -1
                if close >= 0:
                    value, at = page[at + 1 : close], close + 1
                elif m := _BARE.match(page, at, end):
                    value, at = m[0], m.end()
            found[name] = value
        return found


def parse(page: str) -> tuple[Node, str]:
    """The tree under a root, whose leaves are strings, and the text of all style sheets."""
    root = Node("html", {})
    stack, depths, styles = [root], {"html": [0]}, []  # for each tag the depths at which it is open
    scanner = _Scanner(page)
    at, size = 0, len(page)

    def close(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((d[-1] for t in tags if (d := depths.get(t))), default=0)

    def last(tags, bounds) -> int:
        """Depth of the innermost open element among ``tags``, 0 if a bound is further in."""
        depth = innermost(tags)
        return depth if depth and depth >= innermost(bounds) else 0

    while at < size:
        m = scanner.next(at)
        if m is None:
            _text(stack, page[at:])
            break
        start, stop, tag, closes, begins = m
        if start > at:
            _text(stack, page[at:start])
        at = stop
        if not tag:
            continue
        tag = tag.lower()
        if closes:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not last(("p",), SCOPE):
                stack[-1].children.append(Node("p", {}))
            elif depths.get(tag) and tag not in ("html", "body"):
                bounds = () if tag in ("table", "td", "th", "tr", "caption", "template") else ("table", "td", "th") if tag in BLOCKS else BOUND_INLINE
                if depth := last((tag,), bounds):
                    close(depth)
            continue
        attrs = scanner.attributes(begins, stop - 1)
        if tag in ("html", "body"):
            if tag == "body" and (depth := last(("head",), ())):
                close(depth)
            if len(stack) == 1:
                root.attrs = attrs | root.attrs
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            close(len(stack) - 1)
        if tag in ENDS_P and (depth := last(("p",), SCOPE)):
            close(depth)
        if tag in ENDS and (depth := last(*ENDS[tag])):
            close(depth)
            if tag in ("thead", "tbody", "tfoot") and (depth := last(("tr",), ENDS[tag][1])):
                close(depth)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            _open(stack, depths, Node("tr", {}))
        if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            close(len(stack) - 1)
        node = Node(tag, attrs)
        if tag in VOID:
            stack[-1].children.append(node)
        elif tag in RAW:
            stack[-1].children.append(node)
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            body = page[at : end.start()] if end else page[at:]
            if tag == "textarea":
                node.children.append(unescape(body))
            elif tag == "xmp":
                node.children.append(body)  # entities stand as they are
            elif tag == "style":
                styles.append(body)
            if not end:
                break
            at = page.find(">", end.end()) + 1 or size
        else:
            _open(stack, depths, node)
    return root, "\n".join(styles)


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BOUND_INLINE = frozenset(("table", "td", "th", "li", "div", "section", "article", "blockquote"))


def _open(stack: list[Node], depths: dict[str, list[int]], node: Node) -> None:
    stack[-1].children.append(node)
    depths.setdefault(node.tag, []).append(len(stack))
    stack.append(node)


def _text(stack: list[Node], raw: str) -> None:
    if stack[-1].tag == "head" and not raw.isspace():
        stack[0].children.append(unescape(raw))  # the head ends where text begins
    else:
        stack[-1].children.append(unescape(raw) if "&" in raw else raw)


def _sheet(styles: str) -> frozenset[str]:
    """Simple selectors that hide what they match."""
    if "none" not in styles and "hidden" not in styles:
        return frozenset()
    plain, *more = styles.split("/*")
    parts = [plain, *(c.partition("*/")[2] for c in more)]
    found = set()
    for rule in "".join(parts).split("}"):
        head, _, body = rule.rpartition("{")
        if _NONE.search(body) or _HIDDEN.search(body):
            for s in head.rpartition("{")[2].split(","):
                s = s.strip()
                if _SELECTOR.fullmatch(s):
                    found.add(s if s[0] in ".#" else s.lower())
    return frozenset(found)


def _seen(node: Node, sheet: frozenset[str]) -> bool | None:
    """False: nothing of it shows. None: as its parent. True: its own text shows even in a hidden parent."""
    tag, attrs = node.tag, node.attrs
    if tag in UNSEEN or "hidden" in attrs or (tag == "input" and attrs.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in attrs):
        return False
    if sheet and (tag in sheet or ("id" in attrs and f"#{attrs['id']}" in sheet) or any(f".{c}" in sheet for c in attrs.get("class", "").split())):
        return False
    style = attrs.get("style")
    if style:
        style = style.lower()
        if _NONE.search(style):
            return False
        if _SHOWN.search(style):
            return True
    return None


class Flow:
    """Lines of the page, or of one table or cell. Inline text gathers in ``parts`` until its line ends.

    Open lists, items and quotes are levels: each has what stands before its lines, a mark for its
    first one, and the blank lines that wait for a next line inside it. Levels from ``used`` on have no line yet.
    """

    __slots__ = ("lines", "parts", "space", "pre", "kinds", "before", "marks", "counts", "blanks", "used", "waiting", "rows", "caption")

    def __init__(self, pre: int = 0):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space, self.pre, self.used = False, pre, 0
        self.kinds, self.before, self.marks, self.counts, self.blanks = ["flow"], [""], [""], [0], [[0, 0]]  # blanks: lines, and whether a gap follows
        self.waiting: list[int] = []  # levels with blanks
        self.rows: list[list] | None = None
        self.caption: list[str] = []

    def text(self, s: str) -> None:
        if self.pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.parts.append(first)
            for line in rest:
                self.flush(True)
                self.parts.append(line)
            return
        words = s.split()
        if not words:
            self.space = self.space or bool(self.parts)
            return
        if self.parts and (self.space or s[0].isspace()):
            self.parts.append(" ")
        self.parts.append(" ".join(words))
        self.space = s[-1].isspace()

    def flush(self, always: bool = False) -> None:
        if self.parts or always:
            self.put("".join(self.parts).rstrip())
            self.parts = []
        self.space = False

    def block(self, apart: bool) -> None:
        self.flush()
        if apart:
            self._blank(1)

    def _blank(self, which: int) -> None:
        level = len(self.kinds) - 1
        if self.used == len(self.kinds):  # no blank line comes first in a level
            if not any(self.blanks[level]):
                self.waiting.append(level)
            self.blanks[level][which] = 1 if which else self.blanks[level][0] + 1 + self.blanks[level][1]
            if not which:
                self.blanks[level][1] = 0

    def put(self, line: str) -> None:
        if not line:
            self._blank(0)
            return
        for level in self.waiting:
            self.lines += [self.before[level].rstrip()] * sum(self.blanks[level])
            self.blanks[level] = [0, 0]
        self.waiting = []
        if self.used < len(self.kinds):
            old = self.before[self.used - 1] if self.used else ""
            line = old + "".join(self.marks[self.used :]) + line
            self.used = len(self.kinds)
        else:
            line = self.before[-1] + line
        self.lines.append(line)

    def enter(self, kind: str, mark: str = "", quote: bool = False, count: int = 0) -> None:
        own = (mark if quote else " " * len(mark)) if len(self.before[-1]) + len(mark) <= INDENT else ""
        self.kinds.append(kind)
        self.before.append(self.before[-1] + own)
        self.marks.append(own if quote else mark)
        self.counts.append(count)
        self.blanks.append([0, 0])

    def leave(self) -> None:
        self.flush()
        for held in (self.kinds, self.before, self.marks, self.counts, self.blanks):
            held.pop()
        self.used = min(self.used, len(self.kinds))
        if self.waiting and self.waiting[-1] == len(self.kinds):
            self.waiting.pop()

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def _number(value: str | None, default: int, most: int = 1000) -> int:
    return max(1, min(most, int(value))) if value and len(value) < 20 and value.isascii() and value.strip().isdigit() else default


def _table(rows: list[list]) -> list[str]:
    """Cells (lines, columns, rows) in a grid, each column as wide as its widest line up to WIDE."""
    cells = sum(map(len, rows))
    steps = 64 * cells + 1000  # for cells of rows above; rows beyond are laid out without them
    placed: list[list[tuple]] = []
    above: list[list[int]] = []  # columns [start, end) that cells above still cover, for how many rows; in order
    for own in rows:
        at, column, out, fresh = 0, 0, [], []
        for lines, across, down in own:
            while at < len(above) and above[at][0] <= column:
                column = max(column, above[at][1])
                at += 1
            out.append((column, across, lines))
            if down > 1:
                fresh.append([column, column + across, down])
            column += across
        placed.append(out)
        steps -= len(above)
        if steps < 0:
            above, fresh = [], []
        merged: list[list[int]] = []
        for start, end, down in sorted([*([a, b, n - 1] for a, b, n in above if n > 1), *([a, b, n - 1] for a, b, n in fresh)]):
            if merged and merged[-1][1] == start and merged[-1][2] == down:
                merged[-1][1] = end
            else:
                merged.append([start, end, down])
        above = merged
    width: dict[int, int] = {}
    chars = 0
    for own in placed:
        for column, across, lines in own:
            chars += sum(map(len, lines))
            if across == 1 and lines:
                width[column] = max(width.get(column, 0), max((len(x) for x in lines if len(x) <= WIDE), default=0))
    columns = sorted(c for c, w in width.items() if w)
    upto = [0]
    for c in columns:
        upto.append(upto[-1] + width[c] + 2)
    for aligned in (True, False):
        out, spaces = [], 0
        for own in placed:
            by_line: list[list[tuple[int, str]]] = []
            for column, _, lines in own:
                start = upto[bisect.bisect_left(columns, column)] if aligned else 0
                for i, x in enumerate(lines):
                    if i == len(by_line):
                        by_line.append([])
                    if x:
                        by_line[i].append((start, x))
            for found in by_line:
                line, held = [], 0
                for start, x in found:
                    pad = max(start - held, 2 if held else 0)
                    spaces += pad
                    if spaces > PADDING[0] * chars + PADDING[1]:
                        break
                    line.append(" " * pad + x)
                    held += pad + len(x)
                if line:
                    out.append("".join(line))
            if spaces > PADDING[0] * chars + PADDING[1]:
                break
        else:
            break
    return out


def render(page: str) -> str:
    """The visible text of a page, laid out."""
    if not page:
        return ""
    root, styles = parse(page)
    sheet = _sheet(styles)
    flows = [Flow()]
    # steps: (node or string, shown) to enter; (node, None) to leave
    steps: list[tuple] = [(root, True)]
    while steps:
        node, shown = steps.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if shown:
                flow.text(node)
            continue
        tag = node.tag
        if shown is None:
            _leave(node, flows)
            continue
        seen = _seen(node, sheet)
        if seen is False:
            continue
        style = node.attrs.get("style")
        if seen:
            shown = True
        elif style and _HIDDEN.search(style.lower()):
            shown = False
        if tag == "br":
            if shown:
                flow.flush(True)
            continue
        if tag == "input":
            if shown and node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                flow.text(unescape(node.attrs["value"]))
            continue
        if tag in BLOCKS or tag == "textarea":
            _enter(node, flows)
            steps.append((node, None))
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        steps += [(c, shown) for c in reversed(children)]
    return "\n".join(flows[0].done())


LISTS = frozenset(("ul", "ol", "menu", "dir"))
LEVELS = LISTS | {"li", "dd", "blockquote"}
CELLS = frozenset(("td", "th", "caption"))


def _grid(flows: list[Flow]) -> bool:
    """Whether what opens here stands in a table that is laid out."""
    return flows[-1].rows is not None


def _enter(node: Node, flows: list[Flow]) -> None:
    flow, tag = flows[-1], node.tag
    if tag in LEVELS:
        flow.block(tag in APART and not (tag in LISTS and flow.kinds[-1] == "li"))
        if tag == "li":
            ordered = flow.kinds[-1] == "ol"
            if ordered:
                flow.counts[-1] = _number(node.attrs.get("value"), flow.counts[-1] + 1, 10**9)
            flow.enter(tag, f"{flow.counts[-1]}. " if ordered else "- ")
        elif tag == "ol":
            flow.enter(tag, count=_number(node.attrs.get("start"), 1, 10**9) - 1)
        else:
            flow.enter(tag, {"dd": "  ", "blockquote": "> "}.get(tag, ""), tag == "blockquote")
    elif tag == "table" and len(flows) < 2 * TABLES:
        flow.block(True)
        flows.append(Flow(flow.pre))
        flows[-1].rows = []
    elif tag in CELLS and _grid(flows):
        flow.flush()
        flows.append(Flow(flow.pre))
    elif tag == "tr":
        flow.flush()
        if _grid(flows):
            flow.rows.append([])
    else:
        flow.block(tag in APART)
        if tag in ("pre", "textarea", "xmp"):
            flow.pre += 1


def _leave(node: Node, flows: list[Flow]) -> None:
    tag, flow = node.tag, flows[-1]
    if tag in LEVELS and flow.kinds[-1] == tag:
        flow.leave()
        flow.block(tag in APART and not (tag in LISTS and flow.kinds[-1] == "li"))
        return
    if tag in CELLS and len(flows) > 1 and flow.rows is None and flows[-2].rows is not None:
        own, into = flows.pop().done(), flows[-1]
        if tag == "caption":
            into.caption += own
        else:
            if not into.rows:
                into.rows.append([])
            into.rows[-1].append((own, _number(node.attrs.get("colspan"), 1), _number(node.attrs.get("rowspan"), 1, 65534)))
        return
    if tag == "table" and _grid(flows):
        flows.pop()
        into = flows[-1]
        for line in [*flow.caption, *flow.done(), *_table(flow.rows)]:
            into.put(line)
        into.block(True)
        return
    if tag in ("pre", "textarea", "xmp"):
        flow.flush()
        flow.pre -= 1
    flow.block(tag in APART)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def run(part, texts):
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": [render(t) for t in texts]}

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_texts(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string", column="html")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
