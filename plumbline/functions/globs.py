"""Path patterns: compiling, ordered membership and pruning.

A pattern is a path whose segments may hold ``*`` (any run within a segment) and
``?`` (one character); the segment ``**`` stands for any number of segments. A
leading ``!`` excludes. Of the patterns that match a path the last one decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class GlobError(ValueError):
    """A pattern that can't be used."""


@dataclass(frozen=True)
class Glob:
    raw: str
    segments: tuple[str, ...]
    exclude: bool

    @property
    def regex(self) -> str:
        """Anchored expression with one meaning in Java, RE2 and Python."""
        # several ** in a row mean what one does
        segs = [x for i, x in enumerate(self.segments) if x != "**" or self.segments[i - 1 : i] != ("**",)]
        out = ""
        for i, seg in enumerate(segs):
            last = i == len(segs) - 1
            if seg == "**":
                if last:
                    if not out:
                        return "^.*$"
                    # the separator before is part of what may be absent
                    return f"^{out[:-1]}(?:/.*)?$" if out.endswith("/") else f"^{out}(?:.*)?$"
                out += "(?:[^/]+/)*"
            else:
                out += _segment(seg) + ("" if last else "/")
        return f"^{out}$"

    @property
    def prefix(self) -> str:
        """The folders before the first wildcard, with a slash at the end if any."""
        fixed = []
        for seg in self.segments[:-1]:
            if "*" in seg or "?" in seg:
                break
            fixed.append(seg)
        return "".join(f"{s}/" for s in fixed)


def _segment(seg: str) -> str:
    parts = re.split(r"(\*+|\?)", seg)
    return "".join("[^/]*" if p.startswith("*") else "[^/]" if p == "?" else re.escape(p).replace("\\-", "-").replace("\\ ", " ") for p in parts if p)


def compile_glob(raw: str) -> Glob:
    """Parse one pattern; GlobError if it is empty, absolute, leaves the project or has an empty segment."""
    exclude = raw.startswith("!")
    text = (raw[1:] if exclude else raw).replace("\\", "/")
    while text.startswith("./"):
        text = text[2:]
    if text.endswith("/"):
        text = text[:-1]
    if not text or text == ".":
        raise GlobError("the pattern is empty")
    if text.startswith("/"):
        raise GlobError(f"the pattern {raw!r} is absolute")
    if re.match(r"^[A-Za-z]:", text):
        raise GlobError(f"the pattern {raw!r} names a drive")
    segments = tuple(text.split("/"))
    if "" in segments:
        raise GlobError(f"the pattern {raw!r} has an empty segment")
    if ".." in segments:
        raise GlobError(f"the pattern {raw!r} leaves the project")
    return Glob(raw, segments, exclude)


class GlobSet:
    """Patterns in order, one of them positive at least."""

    def __init__(self, patterns: list[str]) -> None:
        self.globs = [compile_glob(p) for p in patterns]
        if all(g.exclude for g in self.globs):
            raise GlobError("at least one pattern must include files")
        self._compiled = [(re.compile(g.regex, re.DOTALL), g.exclude) for g in self.globs]

    def matches(self, path: str) -> bool:
        """The last matching pattern decides; false if none matches."""
        found = False
        for regex, exclude in self._compiled:
            if regex.match(path):
                found = not exclude
        return found

    def below(self, folder: str) -> bool:
        """Whether a positive pattern can match something below a folder; exclusions are left out of it."""
        parts = [p for p in folder.replace("\\", "/").split("/") if p not in ("", ".")]
        return any(_below(g.segments, parts) for g in self.globs if not g.exclude)

    def roots(self) -> list[str]:
        """Folders that hold all that the positive patterns can match, none within another."""
        found = sorted({g.prefix for g in self.globs if not g.exclude})
        return [p for i, p in enumerate(found) if not any(p.startswith(q) for q in found[:i])]


def _below(pattern: tuple[str, ...], folder: list[str]) -> bool:
    states = {0}
    for name in folder:
        after: set[int] = set()
        for s in _free(states, pattern):
            if s < len(pattern):
                if pattern[s] == "**":
                    after.add(s)
                elif re.fullmatch(_segment(pattern[s]), name, re.DOTALL):
                    after.add(s + 1)
        states = after
    return any(s < len(pattern) for s in _free(states, pattern))


def _free(states: set[int], pattern: tuple[str, ...]) -> set[int]:
    """States with those that ** can skip to."""
    out, todo = set(states), list(states)
    while todo:
        s = todo.pop()
        if s < len(pattern) and pattern[s] == "**" and s + 1 not in out:
            out.add(s + 1)
            todo.append(s + 1)
    return out


GLOB_SCHEMA = "owner string, ord int, raw string, regex string, exclude boolean"


def glob_table(spark: SparkSession, sets: dict[str, GlobSet]) -> DataFrame:
    """The patterns of all sets, one row each."""
    return spark.createDataFrame([(owner, i, g.raw, g.regex, g.exclude) for owner, s in sets.items() for i, g in enumerate(s.globs)], GLOB_SCHEMA)


def members(paths: DataFrame, globs: DataFrame, path: Column) -> DataFrame:
    """(owner and the columns of paths) of the paths that each owner's patterns select.

    Patterns come from a configuration and are few, so they are the side of the
    nested-loop join that is broadcast; of a path's matches the last decides.
    """
    cols = paths.columns
    hit = paths.withColumn("_path", path).join(F.broadcast(globs.select("owner", "ord", "regex", "exclude")), F.expr("_path rlike regex"))
    return hit.groupBy("owner", *cols).agg(F.max_by(~F.col("exclude"), "ord").alias("_in")).filter("_in").drop("_in")


def selected(path: Column, sets: list[GlobSet]) -> Column:
    """Whether one of the sets selects the path: a filter without a join, for few patterns."""
    chosen = F.lit(False)
    for s in sets:
        last = F.lit(False)
        for g in s.globs:  # the last match decides
            last = F.when(path.rlike(g.regex), F.lit(not g.exclude)).otherwise(last)
        chosen = chosen | last
    return chosen
