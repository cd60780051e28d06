"""Citation tags within comments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from plumbline.model import TAGS

_LINK = re.compile(r"\{@link(?:code|plain)?+([^}]*)\}(.*)", re.DOTALL)
#: Characters of a text that are cut into lines together.
BLOCK = 1 << 16


def lines(text: str) -> Iterator[str]:
    """text.split("\\n"), of which only a block is held: a line takes some 60 bytes besides its text."""
    at = 0
    while at >= 0:
        end = text.find("\n", at + BLOCK)
        yield from text[at : end if end >= 0 else None].split("\n")
        at = end + 1 if end >= 0 else -1


@cache
def _tag(words: tuple[str, str]) -> re.Pattern[str]:
    return re.compile(rf"@({'|'.join(map(re.escape, words))})(?=[ \t]|$)(.*)", re.DOTALL)


@dataclass(frozen=True)
class Tag:
    tag: str
    target: str
    is_link: bool
    reason: str
    offset: int


def body_of(text: str) -> tuple[str, bool, str]:
    """(target, whether it is an inline link, reason) of a tag's text."""
    text = text.strip()
    if m := _LINK.match(text):
        inner = m[1].strip()
        if inner and not re.search(r"\s", inner):
            return inner, True, m[2].strip()
    first = re.match(r"\S*", text)[0]
    return first, False, text[len(first) :].strip()


def tags(comment: str, words: tuple[str, str] = TAGS) -> list[Tag]:
    """Tags of a comment, offset counting the lines before them; words are their names.

    A tag starts a line, after a '*' if there is one, and goes on to the next
    tag; in a documentation block any other '@' word ends it too.
    """
    text = comment.lstrip()
    skipped = comment[: len(comment) - len(text)].count("\n")
    block = text.startswith("/**")
    text = re.sub(r"^/\*\*?", "", text).removesuffix("*/")
    out: list[Tag] = []
    name, at, held = "", 0, []

    def close() -> None:
        if name:
            out.append(Tag(name, *body_of("\n".join(held)), skipped + at))

    for k, raw in enumerate(lines(text)):
        line = raw.strip().removeprefix("*").strip()
        if m := _tag(words).match(line):
            close()
            name, at, held = m[1], k, [m[2]]
        elif block and line.startswith("@"):
            close()
            name = ""
        elif name:
            held.append(line)
    close()
    return out
