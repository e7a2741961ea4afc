"""A small element tree over the standard parser, for the HTML operators' per-page helpers."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

BLOCKS = ENDS_P | {"body", "button", "caption", "figure", "li", "td", "th"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """The elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, selector: str) -> Node | None:
        return next((n for n in self.walk() if n.matches(selector)), None)

    def matches(self, selector: str) -> bool:
        """A tag, ids and classes, and parts of attributes' values: ``a.b#c[style*='x']``; each may be absent."""
        tag, marks, parts = _selector(selector)
        if tag and tag != self.tag:
            return False
        classes = self.attrs.get("class", "").split()
        return all(self.attrs.get("id") == m[1:] if m[0] == "#" else m[1:] in classes for m in marks) and all(x in self.attrs.get(k, "") for k, x in parts)

    def outside(self, *tags: str):
        """The elements below that are in none of ``tags``, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            if n.tag not in tags:
                todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self, gap: str = " ", skip: tuple[str, ...] = ("script", "style")) -> str:
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                if x.strip():
                    out.append(x.strip())
            elif x.tag not in skip:
                todo.extend(reversed(x.children))
        return gap.join(out)

    def drop(self, *selectors: str) -> None:
        """Takes the elements that match out of the tree, each parent's list made anew once."""
        hit, parents = _any_of(selectors), {}
        for n in self.walk():
            if n.parent is not None and hit(n):
                parents.setdefault(id(n.parent), (n.parent, set()))[1].add(id(n))
        for parent, gone in parents.values():
            parent.children = [c for c in parent.children if id(c) not in gone]

    def inner_html(self) -> str:
        """The markup of what the element holds."""
        out: list[str] = []
        todo: list = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                out.append("<" + x.tag + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag not in VOID:
                    todo.append(_End(f"</{x.tag}>"))
                    todo.extend(reversed(x.children))
            else:
                out.append(x if isinstance(x, _End) or self.tag in ("script", "style") else escape(x, quote=False))
        return "".join(out)


class _End(str):
    """An end tag among the texts of an element."""


@functools.cache
def _selector(selector: str) -> tuple[str, tuple[str, ...], tuple[tuple[str, str], ...]]:
    """A selector's tag, its .classes and #ids, and its [attribute*='part'] pairs."""
    m = re.fullmatch(r"""([a-z0-9]*)((?:[.#][\w-]+)*)((?:\[[\w-]+\*=["'][^"']*["']\])*)""", selector)
    if not m:
        raise ValueError(f"selector {selector!r} is not understood")
    return m[1], tuple(re.findall(r"[.#][\w-]+", m[2])), tuple(re.findall(r"""\[([\w-]+)\*=["']([^"']*)["']\]""", m[3]))


@functools.cache
def _any_of(selectors: tuple[str, ...]):
    """Whether a node matches any of the selectors; lone tags, classes and ids are looked up, the rest tried."""
    plain = {kind: frozenset(s[len(kind) :] for s in selectors if re.fullmatch(re.escape(kind) + r"[\w-]+", s)) for kind in ("", ".", "#")}
    rest = [s for s in selectors if not re.fullmatch(r"[.#]?[\w-]+", s)]

    def hit(n: Node) -> bool:
        attrs = n.attrs
        if n.tag in plain[""] or (attrs and (attrs.get("id") in plain["#"] or ("class" in attrs and not plain["."].isdisjoint(attrs["class"].split())))):
            return True
        return bool(attrs) and any(n.matches(s) for s in rest)

    return hit


class _Builder(HTMLParser):
    """Builds the tree. Where each tag is open last is known, so that no tag makes a search of all open elements."""

    def __init__(self, references: bool = True):
        super().__init__(convert_charrefs=True)
        self.references = references
        self.root = Node("", {}, None)
        self.open, self.at = [self.root], {}

    def _cut(self, place: int) -> None:
        """Closes the elements from this place up."""
        for n in self.open[place:]:
            self.at[n.tag].pop()
        del self.open[place:]

    def _last(self, tags: set[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def handle_starttag(self, tag, attrs):
        if tag == "p" or tag in ENDS_P:
            p = self._last({"p"})
            if p > self._last({"td", "th", "li", "div", "body", "button"} - {tag}):
                self._cut(p)
        if tag == "a":  # no link is inside another
            a = self._last({"a"})
            if a > self._last(BLOCKS):
                self._cut(a)
        if tag in CLOSES and tag != "p":
            fence = self._last(FENCES.get(tag, set()))
            over = [places[k] for t in CLOSES[tag] if (places := self.at.get(t)) and (k := bisect_right(places, fence)) < len(places)]
            if over:
                self._cut(min(over))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open[-1]))

    def handle_endtag(self, tag):
        place = self._last({tag})
        if place:
            self._cut(place)

    def handle_data(self, data):
        raw = not self.references and self.open[-1].tag in ("script", "style")  # the parser decodes nothing in these
        self.open[-1].children.append(data.replace("&amp;", "&") if raw else data)


# text, or a tag without < in it: no try at it goes beyond the next <
TOKEN = re.compile(r"""[^<]+|<(/?)([a-zA-Z][^\s/<>]*+)([^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+)>""")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"[>\"']")
_PLAIN = re.compile(r"""(?:[^<]++|</?[a-zA-Z][^\s/<>]*+[^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+>|<!--(?:[^-]++|-(?!->))*+-->|<![a-zA-Z][^<>]*+>)*+""")


def tag_end(html: str, at: int, doomed: set[int]) -> int:
    """Where the > of the tag is whose name ends at ``at``, quoted values left out; -1 if there is none.

    ``doomed`` has the opening quotes from which no end was found, so that none is tried again.
    """
    tried = []
    while m := _STOP.search(html, at):
        q = m.start()
        if m[0] == ">":
            return q
        if q in doomed:
            break
        tried.append(q)
        at = html.find(m[0], q + 1) + 1
        if not at:
            break
    doomed.update(tried)
    return -1


def finished(html: str) -> str:
    """The page without tags that the parser would look for the end of again and again: a < that begins no whole tag is
    escaped, a tag with an open quote goes up to its first > and loses its quotes, an open comment ends the page."""
    if _PLAIN.fullmatch(html):
        return html
    out: list[str] = []
    at, end, last_end, doomed = 0, len(html), html.rfind(">"), set()
    while at < end:
        m = TOKEN.match(html, at)
        begin, raw = at, None
        if m:
            at, raw = m.end(), m[2] if not m[1] else None
            out.append(m[0])
        elif at < last_end and (m := TAG.match(html, at)):
            stop = tag_end(html, m.end(), doomed)
            if stop >= 0:
                at, raw = stop + 1, m[2] if not m[1] else None
                out.append(html[begin:at])
            elif (stop := html.find(">", m.end())) >= 0:
                at = stop + 1
                out.append(m[0] + re.sub("[<\"']", "", html[m.end() : at]))
            else:
                out.append("&lt;")
                at += 1
        elif html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            out.append(html[begin:at] if stop >= 0 else "")
        elif at < last_end and html[at + 1] in "!?/":
            at = html.find(">", at) + 1
            out.append(html[begin:at])
        else:
            out.append("&lt;")
            at += 1
        if raw and raw.lower() in ("script", "style"):
            close = re.compile(f"</{raw}(?=[\\s/>])", re.I).search(html, at)
            stop = close.start() if close else end
            out.append(html[at:stop])
            at = stop
    return "".join(out)


def tree(html: str | None, references: bool = True) -> Node:
    """The page's element tree; time grows with its length, whatever its markup. Without ``references`` character references stay as they stand."""
    b = _Builder(references)
    whole = finished(html or "")
    b.feed(whole if references else whole.replace("&", "&amp;"))
    b.close()
    return b.root


def grid(table: Node) -> list[list[tuple[str, bool]]]:
    """Cells of a table with row and column spans filled in: (text, is header)."""
    rows: list[list[tuple[str, bool]]] = []
    held: dict[int, tuple[int, tuple[str, bool]]] = {}  # column: rows still to fill, cell
    for tr in (n for n in table.outside("table") if n.tag == "tr"):
        row: list[tuple[str, bool]] = []

        def fill() -> None:
            while len(row) in held:
                left, cell = held.pop(len(row))
                if left > 1:
                    held_next[len(row)] = (left - 1, cell)
                row.append(cell)

        held_next: dict[int, tuple[int, tuple[str, bool]]] = {}
        for c in (x for x in tr.children if isinstance(x, Node) and x.tag in ("td", "th")):
            fill()
            cell = (" ".join(c.text().split()), c.tag == "th")
            down = _span(c, "rowspan", MOST_ROWS)
            for _ in range(_span(c, "colspan", MOST_COLUMNS)):
                if down > 1:
                    held_next[len(row)] = (down - 1, cell)
                row.append(cell)
        fill()
        held = held | held_next
        rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [("", False)] * (width - len(r)) for r in rows]


# The largest spans that the HTML standard lets a cell have.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _span(n: Node, name: str, most: int) -> int:
    v = n.attrs.get(name, "1")
    return max(1, min(most, int(v))) if v.isascii() and v.isdigit() else 1


def table_markdown(rows: list[list[tuple[str, bool]]]) -> str:
    """A pipe table. Empty columns go; header rows join as 'a > b'; a table without headers gets 컬럼N."""
    keep = [j for j in range(len(rows[0]))] if rows else []
    keep = [j for j in keep if any(r[j][0] for r in rows)]
    if not keep:
        return ""
    cells = [[r[j] for j in keep] for r in rows]
    head = 0
    while head < len(cells) and all(h or not t for t, h in cells[head]):
        head += 1
    names = []
    for j in range(len(keep)):
        parts = list(dict.fromkeys(r[j][0] for r in cells[:head] if r[j][0]))
        names.append(" > ".join(parts) or f"컬럼{j + 1}")
    esc = lambda t: re.sub(r"([\\|*_`])", r"\\\1", t)
    lines = ["| " + " | ".join(map(esc, names)) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    return "\n".join(lines + ["| " + " | ".join(esc(t) for t, _ in r) + " |" for r in cells[head:]])


# The signs around emphasised and code text.
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


def inline(node: Node) -> str:
    """An element's text with its links, emphasis and code as Markdown; images are columns of their own."""
    frames: list[tuple[Node, list, list[str]]] = [(node, list(reversed(node.children)), [])]
    while True:
        n, todo, parts = frames[-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append(" ")
            elif c.tag not in ("script", "style"):
                frames.append((c, list(reversed(c.children)), []))
                break
        else:
            frames.pop()
            t, bare = "".join(parts), " ".join("".join(parts).split())
            if n.tag == "a" and bare and n.attrs.get("href"):
                t = f"[{bare}]({n.attrs['href']})"
            elif n.tag in MARKS and bare:
                t = f"{MARKS[n.tag]}{bare}{MARKS[n.tag]}"
            if not frames:
                return " ".join(t.split())
            if n.tag in ENDS_P or n.tag in ("p", "li", "td", "th"):
                t = f" {t} "
            frames[-1][2].append(t)


def markdown(node: Node) -> str:
    """Headings, paragraphs, lists and tables of an element as Markdown blocks, links and emphasis inside them."""
    out: list[str] = []
    frames: list[tuple[list, list[str]]] = [(list(reversed(node.children)), [])]

    def flush(run: list[str]) -> None:
        t = " ".join("".join(run).split())
        if t:
            out.append(t)
        run.clear()

    while frames:
        todo, run = frames[-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                run.append(c)
            elif c.tag in ("script", "style"):
                continue
            elif re.fullmatch("h[1-6]", c.tag):
                flush(run)
                t = " ".join(c.text().split())
                if t:
                    out.append("#" * int(c.tag[1]) + " " + t)
            elif c.tag == "table":
                flush(run)
                t = table_markdown(grid(c))
                if t:
                    out.append(t)
            elif c.tag in ("ul", "ol"):
                flush(run)
                items = [inline(li) for li in c.children if isinstance(li, Node) and li.tag == "li"]
                if any(items):
                    out.append("\n".join(f"- {i}" for i in items if i))
            elif c.tag in ENDS_P or c.tag in ("p", "body", "html", "li", "td", "figure"):
                flush(run)
                frames.append((list(reversed(c.children)), []))
                break
            else:
                # the element itself, so that its own link or emphasis shows
                holder = Node("", {}, None)
                holder.children = [c]
                edge = (" " if _edge(c, 0) else "", " " if _edge(c, -1) else "")
                run.append(edge[0] + inline(holder) + edge[1])
        else:
            frames.pop()
            flush(run)
    return "\n\n".join(out)


def _edge(n: Node, at: int) -> bool:
    """Whether an inline element begins or ends with white space."""
    while n.children and isinstance(n.children[at], Node):
        n = n.children[at]
    x = n.children[at] if n.children else ""
    return bool(x) and x[at].isspace()
