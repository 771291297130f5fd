"""Layout-aware HTML rendering to text: tree with implied tags, visibility rules, block spacing, lists, aligned tables.

Hidden are elements that are never shown, those with a hidden attribute, those that an inline style or a style element's rule turns
off (display: none, visibility: hidden), closed dialogs, and what a closed details element has beside its summary. Of style
rules, selectors of one element by tag, classes and id are applied; those with combinators, attributes or states, and rules within
at-rules, are not.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements by the role they play in building and laying out the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
RCDATA = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template title meta link base iframe object noembed noframes datalist audio video canvas col colgroup param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp plaintext table figure fieldset hr menu".split())
LINED = frozenset("address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr td th thead tbody tfoot select svg text".split())
CLOSES_P = SPACED | frozenset("address article aside center details dialog div figcaption footer form header hgroup main nav search section summary dd dt li".split())
CELL_SCOPE = frozenset("td th caption table html template button object marquee applet".split())
#: Start tag: open elements that it ends, and elements beyond which it doesn't look.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"}) | CELL_SCOPE),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"}) | CELL_SCOPE),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"}) | CELL_SCOPE),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "template"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table", "template"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table", "template"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table", "template"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"}) | CELL_SCOPE),
    "optgroup": (frozenset({"optgroup", "option"}), frozenset({"select"}) | CELL_SCOPE),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
TABLE_PARTS = frozenset({"table", "tbody", "thead", "tfoot", "tr"})
#: Parts of a table: the elements that they stand in. What else stands straight in TABLE_PARTS goes before the table.
STANDS_IN = {"tr": TABLE_PARTS - {"tr"}, "td": TABLE_PARTS, "th": TABLE_PARTS} | dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup", "col"), frozenset({"table"}))
IN_PLACE = frozenset({"script", "style", "template"})
#: Drawn only where referred to, or not at all, within svg and math.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
TAG = re.compile(r"""</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*+>""")
LOOSE_TAG = re.compile(r"</?[A-Za-z][^>]*>?")
SPACE = re.compile(r"[ \t\n\f\r]+")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)
SHOWING = re.compile(r"(?:^|;)\s*(?:display|visibility)\s*:", re.IGNORECASE)
CSS_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.DOTALL)
BRACE = re.compile("[{}]")
SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][A-Za-z_][\w-]*)*)")
#: The padding of a table may have so many times its visible characters, by its depth in other tables. Where full alignment needs more,
#: columns are aligned to these widths only, and longer cells push the rest of their line on; at 0, cells are two spaces apart.
PADDING, ALIGNED = 4, (1 << 30, 100, 40, 16, 0)
#: Columns within which cells that span rows push later rows' cells on.
SPANNED_COLUMNS = 1000
#: Elements nested deeper stand beside each other at this depth, as in browsers, so each tag looks at so many open ones at most.
MAX_DEPTH = 512


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def tokens(html: str):
    """('text', str), ('start', tag, attributes source), ('end', tag); comments, declarations and instructions are left out."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        second = html[lt + 1 : lt + 2]
        if second in ("!", "?") or second == "/" and not html[lt + 2 : lt + 3].isalpha():
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        name = NAME.match(m[0])[1].lower()
        at = m.end()
        if second == "/":
            yield "end", name, ""
            continue
        yield "start", name, m[0][len(name) + 1 : -1 if m[0].endswith(">") else None]
        if name in RAW or name in RCDATA:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            body = html[at : close.start() if close else n]
            if name in RCDATA | {"xmp", "plaintext", "style"} and body:
                yield "text", body, ""
            yield "end", name, ""
            at = close.end() if close else n


def build(html: str) -> Node:
    """The element tree. Optional end tags are implied, unmatched ones ignored; text and elements straight in a table go before it,
    and forms there are left out but not what they hold."""
    root = Node("html")
    stack = [root]

    def close(tags: frozenset[str], until: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    def before_table(x: Node | str) -> None:
        k = max(i for i, y in enumerate(stack) if y.tag in ("table", "html"))
        if stack[k].tag == "table" and k:
            stack[k - 1].children.insert(len(stack[k - 1].children) - 1, x)
        else:
            stack[-1].children.append(x)

    for kind, value, source in tokens(html):
        if stack[-1].tag == "colgroup" and (kind == "text" and value.strip(" \t\n\f\r") or kind == "start" and value not in ("col", "template")):
            stack.pop()
        if kind == "text":
            text = unescape(value) if "&" in value and stack[-1].tag not in ("xmp", "plaintext", "style") else value
            if stack[-1].tag in TABLE_PARTS:
                if text.strip(" \t\n\f\r"):
                    before_table(text)
                continue
            stack[-1].children.append(text)
        elif kind == "start":
            if value in ("html", "body", "head") and value == "html":
                continue
            if value in CLOSES_P:
                close(frozenset({"p"}), CELL_SCOPE)
            if value == "body":
                close(frozenset({"head"}), frozenset())
            if value in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if value in ENDS:
                ends, until = ENDS[value]
                close(ends, until)
                if value == "tr" or value in ("tbody", "thead", "tfoot"):
                    while stack[-1].tag in ("td", "th", "tr", "caption", "colgroup"):
                        stack.pop()
            if stack[-1].tag == "head" and value not in UNSEEN and value != "noscript":
                stack.pop()
            if value in STANDS_IN:
                k = max(i for i, x in enumerate(stack) if x.tag in ("table", "template", "html"))
                if stack[k].tag == "table":
                    while stack[-1].tag not in STANDS_IN[value]:
                        stack.pop()
            astray = stack[-1].tag in TABLE_PARTS and value not in STANDS_IN and value not in IN_PLACE
            if astray and any(x.tag == "table" for x in stack):
                if value == "form":
                    continue
                if value == "table":
                    close(frozenset({"table"}), frozenset())
                    astray = False
            if value in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
            node = Node(value, {k.lower(): unescape(a or b or c) for k, a, b, c in ATTR.findall(source)} if source.strip(" /") else None)
            if value in UNDRAWN and any(x.tag in ("svg", "math") for x in stack):
                node.attrs["hidden"] = ""
            if astray:
                before_table(node)
            else:
                stack[-1].children.append(node)
            if source.endswith("/") and any(x.tag in ("svg", "math") for x in [*stack, node]):
                continue
            if value not in VOID and len(stack) < MAX_DEPTH:
                stack.append(node)
        elif value == "br":
            stack[-1].children.append(Node("br"))
        elif value == "p" and not any(x.tag == "p" for x in stack):
            stack[-1].children.append(Node("p"))
        elif value not in ("html", "body"):
            until = frozenset({"table", "template"}) if value in ("tr", "tbody", "thead", "tfoot", "td", "th") else frozenset() if value in ("table", "td", "th") else CELL_SCOPE
            close(HEADINGS if value in HEADINGS else frozenset({value}), until - {value})
    return root


class Rules:
    """Which elements the page's style elements hide: rules by their rarest part, the last of the most specific ones deciding. Of rules with one
    selector the last is kept, and elements with one tag, class and id are decided once."""

    def __init__(self):
        self.by_part: dict[str, dict[tuple[str, frozenset[str]], tuple[tuple[int, int], bool]]] = {}
        self.decided: dict[tuple[str, str, str], bool] = {}
        self.count = 0

    def add(self, css: str) -> None:
        """Takes the rules of a style element in, from brace to brace; text without braces is no rule."""
        depth, skipped, head, at = 0, False, "", 0
        css = CSS_NOISE.sub("", css)
        for m in BRACE.finditer(css):
            text, at = css[at : m.start()], m.end()
            if m[0] == "{":
                if depth == 0:
                    head = text.rpartition(";")[2] if text.lstrip().startswith("@") else text
                    skipped = head.strip().startswith("@")
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0 and not skipped and SHOWING.search(text):
                    self._add(head, bool(HIDING.search(text)))

    def _add(self, selectors: str, hides: bool) -> None:
        for one in selectors.split(","):
            m = SELECTOR.fullmatch(one.strip())
            if m and m[0]:
                parts = frozenset(re.findall(r"[.#][^.#]+", m[2]))
                tag = "" if m[1] in (None, "*") else m[1].lower()
                weight = 100 * sum(x[0] == "#" for x in parts) + 10 * sum(x[0] == "." for x in parts) + bool(tag)
                self.count += 1
                self.by_part.setdefault(min(parts) if parts else tag, {})[tag, parts] = ((weight, self.count), hides)

    def hide(self, node: Node) -> bool:
        if not self.by_part:
            return False
        key = node.tag, node.attrs.get("class", ""), node.attrs.get("id", "")
        if key not in self.decided:
            own = {f".{c}" for c in key[1].split()} | ({f"#{key[2]}"} if key[2] else set())
            fit = [rule for part in (*own, node.tag, "") for (tag, parts), rule in self.by_part.get(part, {}).items() if tag in ("", node.tag) and parts <= own]
            self.decided[key] = bool(fit) and max(fit)[1]
        return self.decided[key]


def style_rules(root: Node) -> Rules:
    rules, todo = Rules(), [root]
    while todo:
        x = todo.pop()
        if x.tag == "style":
            rules.add("".join(c for c in x.children if isinstance(c, str)))
        todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return rules


def unseen(node: Node, rules: Rules) -> bool:
    a = node.attrs
    style = a.get("style") or ""
    return (
        node.tag in UNSEEN
        or "hidden" in a
        or (bool(HIDING.search(style)) if SHOWING.search(style) else rules.hide(node))
        or node.tag == "input" and a.get("type", "text").lower() not in ("submit", "button", "reset")
        or node.tag == "dialog" and "open" not in a
    )


def children(node: Node) -> list[Node | str]:
    """What of an element's children shows: of a closed details element only its summary."""
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


class Writer:
    """Lines of text with collapsed white space, blank lines between spaced blocks, and list markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").replace("\t", "    ").split("\n")
            self._add(first)
            for line in rest:
                self.end_line(keep=True)
                self._add(line)
            return
        s = SPACE.sub(" ", s)
        if not self.now or self.now[-1].endswith(" "):
            s = s.lstrip(" ")
        self._add(s)

    def _add(self, s: str) -> None:
        if s:
            self.now.append(s)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if not line and not keep:
            return
        if self.lines and self.gap == 2 and self.lines[-1] != "":
            self.lines.append("")
        self.gap = 0
        lead = "".join(self.indent)
        if self.marker:
            lead, self.marker = lead[: len(lead) - len(self.marker)] + self.marker, ""
        self.lines.append((lead + line).rstrip(" "))

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def result(self) -> str:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)


def rows_of(table: Node, rules: Rules) -> tuple[list[list[Node]], list[Node]]:
    """Rows of visible cells, and captions, of one table, without those of tables inside it."""
    rows, captions, todo = [], [], list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or unseen(x, rules):
            continue
        if x.tag == "tr":
            rows.append([c for c in x.children if isinstance(c, Node) and c.tag in ("td", "th") and not unseen(c, rules)])
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag in ("tbody", "thead", "tfoot"):
            todo.extend(reversed(x.children))
    return rows, captions


def whole(value: str | None, default: int, low: int, high: int) -> int:
    value = (value or "").strip()
    return min(max(int(value), low), high) if re.fullmatch("-?[0-9]{1,9}", value) else default


def grid(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """First column, number of columns and cell, row by row: cells that span rows keep their columns from the rows below."""
    out, taken = [], []  # taken: (first column, end, first row that is free again), in order
    for y, row in enumerate(rows):
        taken = [t for t in taken if t[2] > y]
        placed, new, at, k = [], [], 0, 0
        for cell in row:
            while k < len(taken) and taken[k][0] <= at:
                at, k = max(at, taken[k][1]), k + 1
            cols, down = whole(cell.attrs.get("colspan"), 1, 1, 1000), whole(cell.attrs.get("rowspan"), 1, 0, 65_534) or len(rows) - y
            placed.append((at, cols, cell))
            if down > 1 and at < SPANNED_COLUMNS:
                if new and new[-1][1] == at and new[-1][2] == y + down:
                    new[-1] = (new[-1][0], at + cols, y + down)
                else:
                    new.append((at, at + cols, y + down))
            at += cols
        taken = sorted(taken + new)
        out.append(placed)
    return out


def table_lines(table: Node, rules: Rules, depth: int) -> list[str]:
    """Cells start where their column starts, two spaces behind the widest cell of the column before; cells of several lines stay side by side."""
    rows, captions = rows_of(table, rules)
    laid = [[(at, cols, render(cell, rules, depth + 1).split("\n")) for at, cols, cell in row] for row in grid(rows)]
    out = [line for c in captions for line in render(c, rules, depth + 1).split("\n") if line]
    lines: list[list[tuple[int, str]]] = []
    widths: dict[int, list[int]] = {}
    visible = 0
    for row in laid:
        first = len(lines)
        lines += [[] for _ in range(max((len(text) for _, _, text in row), default=0))]
        for at, cols, text in row:
            own = widths.setdefault(at, [])
            for k, x in enumerate(text):
                if x:
                    lines[first + k].append((at, x))
                    visible += len(x) - x.count(" ")
                    if cols == 1:
                        own.append(len(x))
    for most in ALIGNED:
        start, at = {}, 0
        for c in sorted(widths):
            start[c] = at
            at += max((w for w in widths[c] if w <= most), default=0) + 2 if most else 0
        drawn, padding = [], 0
        for line in lines:
            parts, now = [], 0
            for c, x in line:
                gap = max(start[c] - now, 2 if now else 0)
                padding += gap
                parts += [" " * gap, x] if not most or padding <= PADDING * visible / (depth + 1) + 64 else [x]
                now += gap + len(x)
            drawn.append("".join(parts))
        if not most or padding <= PADDING * visible / (depth + 1) + 64:
            break
    return out + drawn


#: Counters of list items by the type attribute: a counter's text in base 26 letters or Roman numerals (fixed values).
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def counter(n: int, kind: str) -> str:
    text = ""
    if kind in ("a", "A") and n > 0:
        while n:
            n, k = divmod(n - 1, 26)
            text = chr(97 + k) + text
    elif kind in ("i", "I") and 0 < n < 4000:
        for value, sign in ROMAN:
            text, n = text + sign * (n // value), n % value
    else:
        return str(n)
    return text.upper() if kind.isupper() else text


def list_counter(node: Node) -> list | None:
    """Next number, step and type of an ordered list's items; None for other lists."""
    if node.tag != "ol":
        return None
    a = node.attrs
    down = "reversed" in a
    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if down else 1
    return [whole(a.get("start"), items, -(10**9), 10**9), -1 if down else 1, a.get("type", "1").strip()]


def render(root: Node, rules: Rules | None = None, depth: int = 0) -> str:
    """Visible text of a tree. The walk keeps its own stack; only tables within tables call it anew, of which MAX_DEPTH allows some 170."""
    rules = style_rules(root) if rules is None else rules
    w = Writer()
    counters: list[list | None] = []
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(c, True) for c in reversed(children(root))]
    while todo:
        x, enter = todo.pop()
        if isinstance(x, str):
            w.text(x, pre > 0)
            continue
        tag = x.tag
        gap = 2 if tag in SPACED else 1 if tag in LINED else 0
        if tag in ("ul", "ol", "menu") and counters and gap == 2:
            gap = 1
        if enter:
            if unseen(x, rules):
                continue
            if tag == "br":
                w.end_line(keep=True)
                continue
            if tag in ("img", "wbr"):
                continue
            if tag == "hr":
                w.block(2)
                continue
            if tag == "input":
                w.text(x.attrs.get("value", ""))
                continue
            if tag == "table":
                w.block(2)
                for line in table_lines(x, rules, depth):
                    w._add(line)
                    w.end_line(keep=True)
                w.block(2)
                continue
            if gap:
                w.block(gap)
            if tag in ("ul", "ol", "menu"):
                counters.append(list_counter(x))
            elif tag == "li":
                mark = "- "
                if counters and counters[-1] is not None:
                    now, step, kind = counters[-1]
                    now = whole(x.attrs.get("value"), now, -(10**9), 10**9)
                    mark, counters[-1][0] = f"{counter(now, kind)}. ", now + step
                w.indent.append(" " * len(mark))
                w.marker = mark
            elif tag in ("blockquote", "dd"):
                w.indent.append("  ")
            elif tag in ("pre", "xmp", "plaintext"):
                pre += 1
            elif tag == "q":
                w.text('"')
            todo.append((x, False))
            todo.extend((c, True) for c in reversed(children(x)))
            continue
        if tag == "q":
            w.text('"')
        if gap:
            w.block(gap)
        if tag in ("ul", "ol", "menu"):
            counters.pop()
        elif tag in ("li", "blockquote", "dd"):
            w.indent.pop()
            w.marker = ""
        elif tag in ("pre", "xmp", "plaintext"):
            pre -= 1
    return w.result()


def html_to_text(html: str | None) -> str:
    """All visible text of a page; null and empty pages give the empty text."""
    return render(build(html)) if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines for every page: each row on its own, whole, whatever its size.

    Null and empty pages have the empty text, of no lines; repeated rows come back as often as they go in; ids may be of any type; other columns are
    not read; an empty table gives an empty result. The padding of tables is bounded by their text, so a text's size is in
    proportion to its page's.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            text = [html_to_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["page_id", "text"])

    out = rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, text string")
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
