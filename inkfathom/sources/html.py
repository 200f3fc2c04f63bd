"""Sections of an HTML page, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

SKIPPED = frozenset(("nav", "header", "footer", "script", "style", "noscript"))
HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = frozenset(("p", "li", "td", "th", "tr", "pre", "div", "article", "section", "br", "table"))


class _Sections(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[int, int, str, str]] = []
        self.level, self.title, self.text = 0, "", []
        self.skip, self.heading = 0, ""
        self.in_title = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in HEADINGS and not self.skip:
            self.close_section()
            self.level, self.heading = HEADINGS[tag], tag
        elif tag in BLOCKS:
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == self.heading:
            self.heading = ""
        elif tag in BLOCKS:
            self.text.append("\n")

    def handle_data(self, data: str) -> None:
        if self.skip or self.in_title:
            return
        if self.heading:
            self.title += data
        else:
            self.text.append(data)

    def close_section(self) -> None:
        body = "\n".join(t for t in (" ".join(x.split()) for x in "".join(self.text).split("\n")) if t)
        if self.level or len(body) > 10:
            self.done.append((len(self.done), self.level or 1, " ".join(self.title.split()), body))
        self.level, self.title, self.text = 0, "", []


def sections_of(html: str) -> list[tuple[int, int, str, str]]:
    parser = _Sections()
    parser.feed(html)
    parser.close()
    parser.close_section()
    return parser.done


# -- a page as a tree ----------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element that the key's start ends, if it is open inside the nearest of the fences.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Starts that end an open paragraph.
_AFTER_P = frozenset("p div ul ol dl table pre h1 h2 h3 h4 h5 h6 blockquote section article main nav header footer form hr".split())
_MAIN = re.compile("content|article|main", re.I)
_TAKEN = frozenset((*HEADINGS, "p", "pre", "code", "table", "ul", "ol", "div"))
_BARRED = frozenset(("nav", "header", "footer"))


class Node:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str | None], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in the order of their starts."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.kids))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                todo += reversed(x.kids)

    def text(self) -> str:
        return "".join(self.strings())

    def spaced(self, by: str = " ") -> str:
        return by.join(t for t in map(str.strip, self.strings()) if t)

    def inside(self, tags: frozenset[str] | set[str]) -> bool:
        at = self.up
        while at is not None:
            if at.tag in tags:
                return True
            at = at.up
        return False


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags: set[str], fences: set[str]) -> None:
        """Ends the outermost open element of ``tags`` that no fence encloses more closely."""
        found, at = None, self.at
        while at.up is not None and at.tag not in fences:
            if at.tag in tags:
                found = at
            at = at.up
        if found is not None:
            self.at = found.up

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _AFTER_P:
            self._close({"p"}, {"td", "th", "li", "table", "div", "section", "article", "main", "body", "button"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.at.kids.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at.up is not None and at.tag != tag:
            if at.tag == "table" and tag != "table" and tag not in ("body", "html"):
                return  # the end of nothing that is open in this table
            at = at.up
        if at.up is not None:
            self.at = at.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def main_of(root: Node) -> Node:
    """The first main, article, div of a telling class, or body."""
    every = list(root.walk())
    for wanted in (
        lambda x: x.tag == "main", lambda x: x.tag == "article", lambda x: x.tag == "div" and bool(_MAIN.search(x.attrs.get("class") or "")), lambda x: x.tag == "body",
    ):
        for x in every:
            if wanted(x):
                return x
    return root


def title_of(root: Node) -> str:
    every = list(root.walk())
    for tag in ("title", "h1"):
        for x in every:
            if x.tag == tag:
                return x.text().strip()
    for x in every:
        if x.tag == "meta" and x.attrs.get("property") == "og:title" and x.attrs.get("content"):
            return x.attrs["content"].strip()
    return "Untitled"


def table_text(table: Node) -> str:
    """Rows of cells joined by bars; a table within a cell is part of the cell, and its rows come too."""
    rows = [[c.text().strip() for c in row.walk() if c.tag in ("td", "th")] for row in table.walk() if row.tag == "tr"]
    return "\n".join(" | ".join(r) for r in rows if r)


def slug_of(text: str) -> str:
    text = re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", text.lower()))
    return text.strip("-") or "section"


def tree_sections(html: str) -> list[tuple[int, int, str, str, str, list[str], list[str]]]:
    """order, level, title, anchor, text, code blocks and tables of each section of a page's main part."""
    root = tree(html)
    main = main_of(root)
    done: list[tuple] = []
    for x in main.walk():
        if x.tag not in _TAKEN or x.inside(_BARRED):
            continue
        if x.tag in HEADINGS:
            title = x.text().strip()
            done.append((HEADINGS[x.tag], title, x.attrs.get("id") or slug_of(title), [], [], []))
        elif done:
            _, _, _, said, codes, tables = done[-1]
            if x.tag in ("pre", "code"):
                if not x.inside({"pre"}) and x.text().strip():
                    codes.append(x.text())
                    said.append(f"[CODE]\n{x.text()}\n[/CODE]")
            elif x.tag == "table":
                if (rows := table_text(x)).strip():
                    tables.append(rows)
                    said.append(f"[TABLE]\n{rows}\n[/TABLE]")
            elif len(text := x.spaced()) > 10:
                said.append(text)
    if not done:
        done = [(1, title_of(root), "content", [main.spaced("\n")], [], [])]
    return [(n, level, title, anchor, "\n\n".join(said), codes, tables) for n, (level, title, anchor, said, codes, tables) in enumerate(done)]
