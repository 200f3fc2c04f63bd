"""Blocks of a Markdown text with the lines they stand on, and its front matter.

A text is read line by line into top-level blocks: headings (``#`` and underlined),
fenced and indented code, tables, bullet and numbered lists, quotes, rules, HTML
and paragraphs. Quotes and list items are containers: their own lines, with the
marker taken off, are read in the same way, which gives nested lists. What makes
sections of blocks is done by Spark (``operators.markup``).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: Containers within containers that are read as such; what lies deeper is text.
DEEPEST = 40

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( {1,4})(?=\S)|([ \t]+)|$)")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:!--|\?|!|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_FRONT = re.compile(r"---\s*\n(.*?)\n---\s*\n", re.S)


@dataclass
class Block:
    kind: str  # heading, code, table, list, blockquote, paragraph, html, rule
    start: int
    end: int
    text: str = ""
    level: int = 0
    lang: str = ""
    ordered: bool = False
    items: list[list[Block]] = field(default_factory=list)


def _cells(line: str) -> list[str]:
    row = re.split(r"(?<!\\)\|", line.strip())
    row = row[1:] if row and not row[0].strip() else row
    row = row[:-1] if row and not row[-1].strip() else row
    return [c.strip().replace("\\|", "|") for c in row]


def _begins_table(lines: list[str], i: int) -> bool:
    return i + 1 < len(lines) and "|" in lines[i] and bool(_DELIMITER.match(lines[i + 1])) and len(_cells(lines[i])) == len(_cells(lines[i + 1]))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _interrupts(lines: list[str], i: int) -> bool:
    """Whether a line ends the paragraph before it."""
    line = lines[i]
    item = _ITEM.match(line)
    return bool(
        _ATX.match(line) or _QUOTE.match(line) or _RULE.match(line) or _HTML.match(line) or _opens_fence(line) or _begins_table(lines, i)
        or (item and line[item.end() :].strip() and item[2] in ("-", "+", "*", "1.", "1)"))
    )


def _opens_fence(line: str) -> re.Match | None:
    m = _FENCE.match(line)
    return m if m and not (m[2][0] == "`" and "`" in m[3]) else None


def blocks(lines: list[str], first: int = 0, depth: int = 0) -> list[Block]:
    """Blocks of the lines, the first of which has the number ``first``."""
    done: list[Block] = []
    i, n = 0, len(lines)

    def put(kind: str, end: int, **more) -> None:
        nonlocal i
        done.append(Block(kind, first + i, first + end, **more))
        i = end

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            end = i
            for j in range(i, n):
                if lines[j].strip() and _indent(lines[j]) < 4:
                    break
                end = j + 1 if lines[j].strip() else end
            put("code", end, text="".join(x[4:] + "\n" for x in lines[i:end]))
        elif fence := _opens_fence(line):
            close = re.compile(r" {0,3}" + re.escape(fence[2][0]) + "{" + str(len(fence[2])) + r",}[ \t]*$")
            stop = next((j for j in range(i + 1, n) if close.match(lines[j])), n)
            own = [x[min(len(fence[1]), _indent(x)) :] for x in lines[i + 1 : stop]]
            put("code", min(stop + 1, n), text="".join(x + "\n" for x in own), lang=fence[3])
        elif atx := _ATX.match(line):
            put("heading", i + 1, level=len(atx[1]), text=(atx[2] or "").strip())
        elif _RULE.match(line):
            put("rule", i + 1)
        elif _QUOTE.match(line) and depth < DEEPEST:
            end = i + 1
            while end < n and lines[end].strip() and (_QUOTE.match(lines[end]) or not _interrupts(lines, end)):
                end += 1
            put("blockquote", end, items=[blocks([_QUOTE.sub("", x, count=1) for x in lines[i:end]], first + i, depth + 1)])
        elif (item := _ITEM.match(line)) and depth < DEEPEST:
            _put_list(lines, i, item, first, depth, put)
        elif _HTML.match(line):
            stop = next((j for j in range(i, n) if "-->" in lines[j]), n - 1) + 1 if line.lstrip().startswith("<!--") else next((j for j in range(i, n) if not lines[j].strip()), n)
            put("html", stop)
        elif _begins_table(lines, i):
            width, end = len(_cells(line)), i + 2
            while end < n and lines[end].strip() and not _interrupts(lines[: end + 1], end):
                end += 1
            rows = [_cells(x) for x in (line, *lines[i + 2 : end])]
            put("table", end, text="\n".join(" | ".join((r + [""] * width)[:width]) for r in rows))
        elif _DEFINITION.match(line):
            i += 1
        else:
            end = i + 1
            while end < n and lines[end].strip() and not (mark := _UNDERLINE.match(lines[end])) and not _interrupts(lines, end):
                end += 1
            text = "\n".join(x.strip() for x in lines[i:end])
            if end < n and lines[end].strip() and (mark := _UNDERLINE.match(lines[end])):
                put("heading", end + 1, level=1 if mark[1][0] == "=" else 2, text=text)
            else:
                put("paragraph", end, text=text)
    return done


def _put_list(lines: list[str], i: int, item: re.Match, first: int, depth: int, put) -> None:
    """A list: items of one kind of marker, each with its lines up to the next."""
    n, items, at, kind = len(lines), [], i, item[2][-1]
    ordered, last = kind in ".)", i
    while at < n and (m := _ITEM.match(lines[at])) and m[2][-1] == kind and not (not ordered and _RULE.match(lines[at])):
        inner = m.end() if m[3] else len(m[1]) + len(m[2]) + 1
        own, end, blank = [lines[at][inner:]], at + 1, False
        while end < n:
            line = lines[end]
            if not line.strip():
                blank = True
                own.append("")
            elif _indent(line) >= inner:
                own.append(line[inner:])
                blank = False
            elif not blank and not _interrupts(lines, end) and not _ITEM.match(line) and own[-1].strip():
                own.append(line.strip())  # a paragraph goes on without its indent
            else:
                break
            end += 1
        items.append(blocks(own, first + at, depth + 1))
        at = last = end
    put("list", last, ordered=ordered, items=items)


def list_text(b: Block) -> str:
    """Items by hyphens or numbers; nested lists are indented by two blanks."""
    out = []
    for number, item in enumerate(b.items, 1):
        parts = [x.text if x.kind == "paragraph" else "\n".join("  " + t for t in list_text(x).split("\n")) for x in item if x.kind in ("paragraph", "list")]
        out.append(f"{number}. " * b.ordered + "- " * (not b.ordered) + " ".join(parts).strip())
    return "\n".join(out)


def rendered(b: Block) -> str | None:
    """What a section's text has of a block; None of those that leave nothing."""
    if b.kind == "code":
        return f"[CODE]\n{b.text}\n[/CODE]"
    if b.kind == "table":
        return f"[TABLE]\n{b.text}\n[/TABLE]"
    if b.kind == "list":
        return list_text(b)
    if b.kind == "blockquote":
        said = [x.text for x in b.items[0] if x.kind == "paragraph"]
        return "\n".join(f"> {t}" for t in said) if said else None
    return b.text if b.kind == "paragraph" and b.text.strip() else None


def front_matter(text: str) -> tuple[str, str]:
    """The front matter as JSON, and the text after it; ``{}`` and the whole text if there is none that can be read."""
    m = _FRONT.match(text)
    if not m:
        return "{}", text
    try:
        import yaml
    except ImportError:  # without that library, only plain ``key: value`` lines
        found = dict(re.findall(r"^(\w[\w -]*):[ \t]*(.*?)[ \t]*$", m[1], re.M))
        return json.dumps(found), text[m.end() :]
    try:
        found = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return "{}", text
    return json.dumps(found if isinstance(found, dict) else {}, default=str, sort_keys=True), text[m.end() :]


def document_blocks(text: str | None) -> tuple[str, str, list[Block]]:
    """Front matter, the text after it, and its blocks."""
    front, body = front_matter((text or "").replace("\r\n", "\n"))
    lines = body.expandtabs(4).split("\n")
    return front, body, blocks(lines[:-1] if lines and not lines[-1] else lines)
