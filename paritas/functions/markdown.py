"""Markdown to plain text, block by block and then inline: a small state machine over the lines of one text.

Blocks: headings (# and underlined), quotes, lists of any depth, fenced and indented code, tables, rules, link definitions,
paragraphs.  Inline: escapes, code spans, emphasis, links and images (inline, by reference, automatic), tags, entities.  The
text of a block keeps its line breaks; blocks are parted by one line break, the cells of a table's row by a tab.
"""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDER = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:( {1,4})(?=\S)|[ \t]*$| )")
_CELLS = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINED = re.compile(r"^ {0,3}\[([^\]]+)\]:[ \t]*(\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|<\?.*?\?>|<![A-Z][^<>]*>", re.S)
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_TO = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def inline(text: str, names: frozenset[str] = frozenset()) -> str:
    """A block's text without its marks; names are the link definitions that are known."""
    out: list[str] = []
    marks: list[list] = []  # [place in out, character, how many, may open, may close]
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in string.punctuation:
            out.append(text[i + 1])
            i += 2
        elif c == "`":
            run = re.match("`+", text[i:]).group()
            end = re.compile(rf"(?<!`){run}(?!`)").search(text, i + len(run))
            if end:
                code = text[i + len(run) : end.start()].replace("\n", " ")
                out.append(code[1:-1] if code.strip() and code[0] == code[-1] == " " else code)
                i = end.end()
            else:
                out.append(run)
                i += len(run)
        elif c == "<" and (met := _AUTO.match(text, i)):
            out.append(met.group(1))
            i = met.end()
        elif c == "<" and (met := _TAG.match(text, i)):
            i = met.end()
        elif c == "&" and (met := _ENTITY.match(text, i)):
            out.append(html.unescape(met.group()))
            i = met.end()
        elif (c == "[" or text.startswith("![", i)) and (link := _link(text, i + (c == "!"), names)):
            out.append(inline(link[0], names))
            i = link[1]
        elif c in "*_" or text.startswith("~~", i):
            run = re.match(rf"{re.escape(c)}+", text[i:]).group()
            before, after = text[i - 1] if i else " ", text[i + len(run)] if i + len(run) < len(text) else " "
            punct = lambda x: not x.isalnum() and not x.isspace()
            opens = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
            closes = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
            if c == "_":
                opens, closes = opens and (not closes or punct(before)), closes and (not opens or punct(after))
            marks.append([len(out), c, len(run), opens, closes])
            out.append(run)
            i += len(run)
        else:
            end = i + 1
            while end < len(text) and text[end] not in "\\`<&[!*_~":
                end += 1
            out.append(text[i:end])
            i = end
    for k, mark in enumerate(marks):  # each closing run takes from the nearest opening one
        if mark[4]:
            for other in reversed(marks[:k]):
                if not mark[2]:
                    break
                if other[1] == mark[1] and other[3] and other[2]:
                    taken = min(mark[2], other[2])
                    other[2] -= taken
                    mark[2] -= taken
                    for between in marks[marks.index(other) + 1 : k]:
                        between[3] = False
    for place, c, left, _, _ in marks:
        out[place] = c * left
    return re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"\\\n", "\n", "".join(out)))


def _link(text: str, at: int, names: frozenset[str]) -> tuple[str, int] | None:
    """The label of a link that begins at a bracket, and where the link ends."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] == "[":
            depth += 1
        elif text[i] == "]":
            depth -= 1
            if not depth:
                break
        i += 1
    else:
        return None
    label, after = text[at + 1 : i], i + 1
    if met := _TO.match(text, after):
        return label, met.end()
    if (met := re.compile(r"\[([^\]]*)\]").match(text, after)) and (met.group(1) or label).lower() in names:
        return label, met.end()
    return (label, after) if label.lower() in names else None


def _cells(line: str) -> list[str]:
    cells = re.split(r"(?<!\\)\|", line.strip())
    return [x.strip() for x in cells[1 if line.strip().startswith("|") else 0 : -1 if len(cells) > 1 and not cells[-1].strip() else None]]


def blocks(lines: list[str], names: frozenset[str]) -> Iterator[str]:
    """The plain text of each block."""
    held: list[str] = []  # the paragraph that is being read
    i = 0

    def paragraph() -> Iterator[str]:
        if held:
            yield inline("\n".join(x.strip() for x in held), names)
            held.clear()

    while i < len(lines):
        line = lines[i].expandtabs(4)
        if not line.strip():
            yield from paragraph()
        elif met := _FENCE.match(line):
            yield from paragraph()
            close, i, first = re.compile(rf"^ {{0,3}}{re.escape(met.group(1)[0])}{{{len(met.group(1))},}}\s*$"), i + 1, i + 1
            while i < len(lines) and not close.match(lines[i]):
                i += 1
            yield "\n".join(lines[first:i])
        elif not held and line.startswith("    "):
            first = i
            while i + 1 < len(lines) and (lines[i + 1].startswith("    ") or not lines[i + 1].strip()):
                i += 1
            yield "\n".join(x[4:] for x in lines[first : i + 1]).rstrip()
        elif held and (under := _UNDER.match(line)) and (under.group(1)[0] == "=" or not _ITEM.match(line)):
            yield from paragraph()
        elif _RULE.match(line):
            yield from paragraph()
        elif met := _HEADING.match(line):
            yield from paragraph()
            yield inline(met.group(2) or "", names)
        elif _QUOTE.match(line):
            yield from paragraph()
            first = i
            while i + 1 < len(lines) and lines[i + 1].strip() and (_QUOTE.match(lines[i + 1]) or not _starts(lines[i + 1])):
                i += 1
            yield from blocks([_QUOTE.sub("", x) for x in lines[first : i + 1]], names)
        elif (met := _ITEM.match(line)) and not (held and (not line[met.end() :].strip() or met.group(2)[0].isdigit() and met.group(2)[:-1] != "1")):
            yield from paragraph()
            width = len(met.group(1)) + len(met.group(2)) + len(met.group(3) or " ")
            own = [line[width:] if len(line) > width else ""]
            while i + 1 < len(lines):
                after = lines[i + 1].expandtabs(4)
                inside = after.startswith(" " * width) or not after.strip()
                if not inside and (_starts(after) or not own[-1].strip()):
                    break
                own.append(after[width:] if inside else after)
                i += 1
            yield from blocks(own, names)
        elif not held and "|" in line and i + 1 < len(lines) and _CELLS.match(lines[i + 1]) and "-" in lines[i + 1] and len(_cells(line)) == len(_cells(lines[i + 1])):
            rows = [line]
            i += 1
            while i + 1 < len(lines) and lines[i + 1].strip() and "|" in lines[i + 1]:
                i += 1
                rows.append(lines[i])
            yield from ("\t".join(inline(x.replace("\\|", "|"), names) for x in _cells(row)) for row in rows)
        elif held or not _DEFINED.match(line):
            held.append(line)
        i += 1
    yield from paragraph()


def _starts(line: str) -> bool:
    """Whether a line begins a block of its own."""
    return any(p.match(line) for p in (_FENCE, _HEADING, _RULE, _QUOTE, _ITEM))


def plain_text(text: str | None) -> str | None:
    """A markdown text without its marks; null stays null."""
    if text is None:
        return None
    lines = re.split(r"\r\n|\r|\n", text)
    names = frozenset(met.group(1).lower() for line in lines if (met := _DEFINED.match(line)))
    return "\n".join(b for b in blocks(lines, names) if b.strip())


def markdown_text(text: Column) -> Column:
    """plain_text of a column; a pandas function."""
    def run(some: pd.Series) -> pd.Series:
        return some.map(plain_text, na_action="ignore")

    return F.pandas_udf(run, "string")(text)
