"""Outline and citations of a Markdown file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from plumbline.model import TAGS
from plumbline.sources.tags import lines, tags

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.DOTALL)
_HEADING = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)(.*)", re.DOTALL)
_ANCHOR = re.compile(r"\s*\{#((?a:[^\W_][\w:.-]*))\}\s*$")
_COMMENT = re.compile(r"<!--(.*?)-->", re.DOTALL)


def slug(title: str) -> str:
    """Lower case, letters, numbers and '_'; one '-' for each run of blanks and '-'."""
    kept = "".join(c if c.isalpha() or c.isnumeric() or c == "_" else "-" if c == "-" or c.isspace() else "" for c in title.lower())
    return re.sub(r"-+", "-", kept).strip("-")


def heading(line: str) -> tuple[int, str] | None:
    m = _HEADING.match(line)
    if not m:
        return None
    title = m[2].strip()
    bare = title.rstrip("#")
    if bare != title and (not bare or bare[-1] in " \t"):
        title = bare.strip()
    return len(m[1]), title


def _states(rows: Iterable[str]) -> Iterator[tuple[str, bool, bool]]:
    """(line, fenced, hidden from headings) of each line."""
    marker, comment = "", False
    for raw in rows:
        line = raw.removesuffix("\r")
        m = _FENCE.match(line)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            if not marker:
                marker = m[1]
            elif m[1][0] == marker[0] and len(m[1]) >= len(marker) and not m[2].strip():
                marker = ""
            yield raw, True, True
        elif marker:
            yield raw, True, True
        elif comment:
            comment = "-->" not in line
            yield raw, False, True
        elif (rest := line.lstrip(" \t")).startswith("<!--"):
            comment = "-->" not in rest[4:]
            yield raw, False, True
        else:
            yield raw, False, False


def scan(path: str, text: str, words: tuple[str, str] = TAGS) -> dict:
    """The scan row of one file."""
    units, problems, declarations = [], [], []
    usable = not re.search(r"\s", path)

    def unit(symbol: str, parent: str | None, target: str, line: int, readable: str) -> str:
        name = f"markdown:{path}:{symbol}" + ("" if symbol == "file" else f":{line}")
        units.append({"id": name, "parent_id": parent, "target": target, "identity": None, "aliases": [], "artifact": "markdown", "symbol": symbol, "path": path, "line": line, "readable": readable})
        return name

    whole = unit("file", None, path, 1, "Markdown file") if usable else None
    if not usable:
        problems.append({"code": "md_path_whitespace", "symbol": "*", "message": f"Markdown file '{path}' can't be cited: its path has blanks"})
    host, open_at, at = "file", {}, 0
    comments = _COMMENT.finditer(text)
    comment = next(comments, None)
    for k, (raw, fenced, hidden) in enumerate(_states(lines(text))):
        found = None if hidden else heading(raw.removesuffix("\r"))
        if found:
            level, title = found
            host = f"h{level}"
            if level <= 4:
                open_at = {n: i for n, i in open_at.items() if n < level}
                if usable:
                    named = _ANCHOR.search(title)
                    anchor = named[1] if named else slug(title)
                    if anchor:
                        clean = _ANCHOR.sub("", title).strip() if named else title
                        parent = open_at[max(open_at)] if open_at else whole
                        open_at[level] = unit(host, parent, f"{path}#{anchor}", k + 1, f"Markdown {host.upper()} '{clean}'")
                    else:
                        problems.append({"code": "md_no_anchor", "symbol": host, "message": f"Markdown heading at {path}:{k + 1} can't be cited: it has no anchor"})
        while comment and comment.start() <= at + len(raw):
            for t in [] if fenced else tags(comment[1], words):
                seq, line = len(declarations) + 1, k + 1 + t.offset
                declarations.append({"id": f"markdown:{path}:{line}:{seq}", "artifact": "markdown", "tag": t.tag, "target": t.target, "is_link": t.is_link, "reason": t.reason, "hosts": [host], "path": path, "line": line, "seq": seq})
            comment = next(comments, None)
        at += len(raw) + 1
    return {"path": path, "artifact": "markdown", "units": units, "declarations": declarations, "problems": problems}
